"""Operator 8: packing token sequences by cutting-stock column generation.

Every document is cut into full pieces of ``capacity`` ids and one remainder.  The histogram of remainder lengths, in
steps of ``step`` ids, has at most capacity / step rows whatever the input.  A linear program over patterns (how many
remainders of each length share one sequence) is solved on it by column generation: the dual prices of the program are
the values of a knapsack, whose best filling is the next pattern.  Rounded down, the patterns cover all but a few
remainders; those few are filled in by first fit decreasing.  Remainders of less than ``short`` ids, for which a step
would be much, are packed by their exact lengths into bundles of ``bundle`` ids first, in the same way; a bundle then
counts as one remainder.  Pieces are ranked inside their length class, and tables of rank ranges, bounded by the number
of classes and patterns, tell each one its bundle, sequence and place.

The rounds end within 0.01 % of a lower bound of the program's optimum, whatever their number.

Cases: a null or empty text has one id (the end id); repeated rows are packed as rows of their own, and ties between
pieces of one length go by doc_id and start; an empty table gives no pieces; very long texts are tokenised whole and
give many full pieces.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import logging
import os
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playmill.llm.common import Remembered, arrow_map, global_rank, materialize, parts_for, per_worker


@dataclass
class Pattern:
    """``times`` sequences, each with ``counts[c]`` remainders of class c."""

    counts: np.ndarray
    times: int


def _knapsack(values: np.ndarray, weights: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming over the used room; weights ascend."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for used in range(1, room + 1):
        fits = np.searchsorted(weights, used, side="right")
        best[used] = best[used - 1]
        if fits:
            got = values[:fits] + best[used - weights[:fits]]
            k = int(got.argmax())
            if got[k] > best[used] + 1e-12:
                best[used], choice[used] = got[k], k
    counts, used = np.zeros(len(weights), dtype=np.int64), room
    while used > 0:
        if choice[used] < 0:
            used -= 1
        else:
            counts[choice[used]] += 1
            used -= weights[choice[used]]
    return float(best[room]), counts


def _first_fit_basis(need: np.ndarray, classes: np.ndarray, per: np.ndarray, room: int) -> np.ndarray:
    """A basis of patterns filled with the largest items left; each pattern is used until one of its classes has run out.

    A class that has run out is in no later pattern, so in that order the matrix is triangular; its solution is what
    was used, at least 0.
    """
    m = len(classes)
    basis, left = np.zeros((m, m)), need.copy()
    alive = np.ones(m, dtype=bool)
    for k in range(m):
        counts, space = np.zeros(m), room
        for c in np.flatnonzero(alive)[::-1]:
            if space < classes[0]:
                break
            counts[c] = min(space // classes[c], np.ceil(left[c]))
            space -= int(counts[c]) * int(classes[c])
        if not counts.any():  # what is left has run out together with others
            c = int(np.flatnonzero(alive)[-1])
            counts[c] = per[c]
        held = counts > 0
        times = np.where(held, left / np.where(held, counts, 1), np.inf)
        out = int(times.argmin())
        left = np.maximum(left - times[out] * counts, 0)
        left[out], alive[out] = 0, False
        basis[:, k] = counts
    return basis


def solve_patterns(demand: dict[int, int], room: int, max_columns: int = 20_000, gap: float = 1e-4) -> list[Pattern]:
    """Patterns that together hold exactly ``demand`` (class weight -> number of items) in sequences of ``room``.

    Revised simplex on the covering program min sum(x), A x = d, from the patterns of a fractional first fit: each round
    prices the basis, asks the knapsack for a pattern with reduced cost below zero and pivots it in.  The value of the
    program divided by the knapsack's is a lower bound of the optimum, as is the total weight over ``room``; the rounds
    end once the value is within ``gap`` of the better bound.  The counts of each pattern refer to the classes in
    ascending order.
    """
    classes = np.array(sorted(w for w, n in demand.items() if n > 0), dtype=np.int64)
    need = np.array([demand[int(w)] for w in classes], dtype=np.float64)
    m = len(classes)
    if not m:
        return []
    per = room // classes
    basis = _first_fit_basis(need, classes, per, room)
    inverse = np.linalg.inv(basis)
    x, bound = np.maximum(inverse @ need, 0), float(classes @ need) / room
    for tried in range(max_columns + 1):
        total = x.sum()
        if total - bound <= gap * bound:
            break
        value, column = _knapsack(np.maximum(inverse.sum(axis=0), 0), classes, room)
        bound = max(bound, total / max(value, 1))
        if value <= 1 + 1e-7 or total - bound <= gap * bound:
            break
        if tried == max_columns:
            logging.getLogger(__name__).warning("column generation left after %d patterns, %.2f %% above the bound", tried, 100 * (total / bound - 1))
            break
        step = inverse @ column
        ratios = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratios.argmin())
        if not np.isfinite(ratios[out]):
            break
        basis[:, out] = column
        if tried % 100 == 99:  # rounding errors of the updates go
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ need, 0)
            continue
        x -= ratios[out] * step
        x[out] = ratios[out]
        x = np.maximum(x, 0)
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
    logging.getLogger(__name__).info("%d classes: %d patterns tried, %.3f %% above the bound", m, tried, 100 * (x.sum() / bound - 1))
    patterns, left = [], need.astype(np.int64)
    for k in np.argsort(-x, kind="stable"):
        counts = np.rint(basis[:, k]).astype(np.int64)
        whole = np.flatnonzero(counts)
        times = min(int(x[k] + 1e-6), *(int(left[c]) // int(counts[c]) for c in whole))
        if times > 0:
            patterns.append(Pattern(counts, times))
            left -= times * counts
    open_room: list[int] = []
    filled: list[np.ndarray] = []
    for c in range(m - 1, -1, -1):  # at most a few items a class are left: first fit decreasing
        for _ in range(int(left[c])):
            k = next((i for i, r in enumerate(open_room) if r >= classes[c]), -1)
            if k < 0:
                open_room.append(room)
                filled.append(np.zeros(m, dtype=np.int64))
            open_room[k] -= int(classes[c])
            filled[k][c] += 1
    return patterns + [Pattern(f, 1) for f in filled]


def rank_ranges(demand: dict[int, int], patterns: list[Pattern], first: int) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, rank behind the last, first sequence, items a sequence, place of the first item) of every use of a class."""
    classes = sorted(w for w, n in demand.items() if n > 0)
    used, out, sequence = dict.fromkeys(classes, 0), [], first
    for p in patterns:
        place = 0
        for c in np.flatnonzero(p.counts)[::-1]:
            a, w = int(p.counts[c]), classes[c]
            out.append((w, used[w], used[w] + a * p.times, sequence, a, place))
            used[w] += a * p.times
            place += a
        sequence += p.times
    return out


class WordIds:
    """Ids of texts and words, as little-endian bytes; remembers words and the parts they are made of.

    The vocabulary's pre-tokens encode on their own, and white space never survives its normaliser.  Texts and words of
    plain letters, digits and marks are cut into pre-tokens here; any other text is cut into words first, and its words
    that are not plain are handed to the tokenizer whole.
    """

    #: ASCII without white space, and the letters of Latin-1 with the two signs among them; all in composed form.
    PLAIN = re.compile("[!-~\u00c0-\u00ff]+")
    #: The pre-tokens: contractions, letters, single digits, other marks.
    PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")

    #: The white space of the vocabulary's normaliser, which is not quite Python's, and what Python takes for some.
    WHITE, OTHERS = re.compile("[\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"), re.compile("[\x1c-\x1f]")
    #: What a plain text does not hold, and its pre-tokens, between white space.
    ODD = re.compile("[^\t-\r -~\u0085\u00a0\u00c0-\u00ff]|<\\|")
    TEXT_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff\t-\r \u0085\u00a0]+")

    def __init__(self, tokenizer_file: str, slice_of: int = 4000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.slice_of = Tokenizer.from_file(tokenizer_file), slice_of
        self.last = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(self.tokenizer.get_vocab_size())])
        self.words, self.parts = Remembered(), Remembered()

    def of_texts(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts."""
        plain = [not self.ODD.search(t) for t in texts]
        split = [self.TEXT_PARTS.findall(t.lower()) if ok else self._words_of(t) for t, ok in zip(texts, plain)]
        parts = self.parts.fill(set().union(*(ps for ps, ok in zip(split, plain) if ok)), self._new_parts)
        words = self.of(set().union(*(ws for ws, ok in zip(split, plain) if not ok)))
        return [b"".join(map((parts if ok else words).__getitem__, xs)) for xs, ok in zip(split, plain)]

    def _words_of(self, text: str) -> list[str]:
        return text.split() if text.isascii() and not self.OTHERS.search(text) else [w for w in self.WHITE.split(text) if w]

    def of(self, found: set[str]) -> dict[str, bytes]:
        """A dict with the ids of every word of ``found``."""
        return self.words.fill(found, self._new_words)

    def _new_words(self, words: list[str]) -> list[bytes]:
        cut = [[w.lower()] if w.isascii() and w.isalpha() else self.PARTS.findall(w.lower()) if self.PLAIN.fullmatch(w) and "<|" not in w else None for w in words]
        known = self.parts.fill({p for ps in cut if ps for p in ps}, self._new_parts)
        return [(known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps])) if ps else self._ids(w) for w, ps in zip(words, cut)]

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _new_parts(self, parts: list[str]) -> list[bytes]:
        """Parts are encoded side by side; each ends with a token that ends a word."""
        out: list[bytes] = []
        for at in range(0, len(parts), self.slice_of):
            some = parts[at : at + self.slice_of]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1) * 4
            if len(ends) != len(some):
                out += map(self._ids, some)
                continue
            raw, begin = ids.tobytes(), 0
            for end in ends.tolist():
                out.append(raw[begin:end])
                begin = end
        return out


def tokenize_pieces(docs: DataFrame, tokenizer_file: str, end_id: int = 2, capacity: int = 4096) -> DataFrame:
    """Per document: doc_tokens and the pieces (start, length, ids_crc32) that ``capacity`` cuts its ids into."""

    def make():
        words = per_worker(("word ids", tokenizer_file), lambda: WordIds(tokenizer_file))
        end = np.array([end_id], dtype="<u4").tobytes()

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            lengths, pieces = [], []
            for ids in words.of_texts([x or "" for x in batch.column(1).to_pylist()]):
                raw = ids + end
                lengths.append(len(raw) // 4)
                pieces.append([{"start": at // 4, "length": min(capacity, (len(raw) - at) // 4), "ids_crc32": zlib.crc32(raw[at : at + 4 * capacity])} for at in range(0, len(raw), 4 * capacity)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(pieces, kind)], ["doc_id", "doc_tokens", "pieces"])

        return apply

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, make, "doc_id long, doc_tokens long, pieces array<struct<start:long,length:long,ids_crc32:long>>")


def bundle_ranges(demand: dict[int, int], bundle: int, step: int, after: dict[int, int]) -> tuple[list[tuple[int, int, int, int, int, int, int]], dict[int, int]]:
    """Short pieces (length -> number) in bundles, and how many bundles there are of each class.

    Each row of the first: length, first rank, rank behind the last, class of the bundles, rank of the first one in
    that class (behind the ``after`` pieces it has), pieces a bundle, place of the first piece.
    """
    lengths = np.array(sorted(n for n, c in demand.items() if c > 0), dtype=np.int64)
    patterns, bundles, first_of, number = solve_patterns(demand, bundle), {}, {}, 0
    for p in patterns:
        kind = -(-int(p.counts @ lengths) // step)
        first_of[number] = (kind, after.get(kind, 0) + bundles.get(kind, 0))
        bundles[kind] = bundles.get(kind, 0) + p.times
        number += p.times
    return [(n, low, high, *first_of[first], each, place) for n, low, high, first, each, place in rank_ranges(demand, patterns, 0)], bundles


def pack_documents(docs: DataFrame, tokenizer_file: str, end_id: int = 2, capacity: int = 4096, step: int = 8, short: int = 64, bundle: int = 512) -> DataFrame:
    """One row per piece with its sequence and offset; see the module's text for the method."""
    spark = docs.sparkSession
    bundle, short = min(bundle, capacity), min(short, bundle, capacity)
    cut = tokenize_pieces(docs, tokenizer_file, end_id, capacity)
    pieces = cut.select("doc_id", "doc_tokens", F.explode("pieces").alias("p")).select("doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens")
    # short lengths are classes of their own, below zero
    kind = F.when(F.col("length") < short, -F.col("length")).otherwise(F.ceil(F.col("length") / F.lit(step))).cast("int")
    classed = materialize(pieces.withColumn("__class", kind), "pieces")
    room = capacity // step
    demand = {r["__class"]: r["n"] for r in classed.groupBy("__class").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most room + short rows
    full = demand.get(room, 0)
    rest = {w: n for w, n in demand.items() if 0 < w < room}
    inner, bundles = bundle_ranges({-w: n for w, n in demand.items() if w < 0}, bundle, step, demand)
    full += bundles.pop(room, 0)
    rest |= {w: rest.get(w, 0) + n for w, n in bundles.items()}
    ranges = [(room, 0, full, 0, 1, 0)] * bool(full) + rank_ranges(rest, solve_patterns(rest, room), full)
    in_bundles = spark.createDataFrame([(-r[0], *r[1:]) for r in inner] or [(0, 0, 0, 0, 0, 1, 0)], "__class long, __low long, __high long, __kind int, __first long, __each long, __place long")
    table = spark.createDataFrame(ranges or [(0, 0, 0, 0, 1, 0)], "__kind int, __low long, __high long, __sequence long, __each long, __place long")
    ranked = global_rank(classed, "__class", ["doc_id", "start", "ids_crc32"], ["doc_id", "start", "ids_crc32"], parts_for(max(demand.values(), default=0)))
    row = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    within = F.col("rank") - F.col("__low")
    # Both tables have a row for each class of each pattern: at most short x short and room x room, so they are broadcast.
    bundled = ranked.join(F.broadcast(in_bundles), (ranked["__class"] == in_bundles["__class"]) & (F.col("rank") >= F.col("__low")) & (F.col("rank") < F.col("__high")), "left").select(
        *row, F.coalesce("__kind", ranked["__class"]).alias("__kind"), F.coalesce((F.col("__first") + F.floor(within / F.col("__each"))).cast("long"), "rank").alias("rank"), F.coalesce(F.col("__place") + within % F.col("__each"), F.lit(0)).alias("__inner")
    )
    placed = bundled.join(F.broadcast(table), "__kind").where("rank >= __low and rank < __high").select(
        *row, (F.col("__sequence") + F.floor(within / F.col("__each"))).cast("long").alias("sequence_id"), (F.col("__place") + within % F.col("__each")).alias("__slot"), "__inner"
    )
    before = Window.partitionBy("sequence_id").orderBy("__slot", "__inner").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).select(*row, "sequence_id", "offset")
