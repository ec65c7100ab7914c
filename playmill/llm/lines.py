"""Operator 3: removal of repeated lines and passages by global hashing of units.

A text is cut into units: its lines, inside a line its sentences (up to ., ! or ? before white space), and sentences of
more than ``WINDOW`` words at words that a hash of the words on both sides chooses (the smallest hash of each ``WINDOW``
places in a row).  The choice depends on nearby words only, so a passage is cut alike wherever it stands, and no
``WINDOW`` places go without a cut.  A sentence in one unit is a key; of a sentence in several, each two neighbouring
units are one, so that a key holds more than a common phrase.  Keys are normalised (lower case, white space squeezed)
and hashed to 128 bits; digests are grouped over the whole corpus and the earliest occurrence, by doc_id, hash of the
text and start, keeps its place.  Every later one is repeated, and so are its units.  Neighbouring repeated units of a
document make a run; a run of at least ``min_words`` words is removed, so that short sentences that recur by chance, or
stock lines of a few words, stay where they are.  What was removed is returned with its offsets in the original text.

Digests that hold more than 1 / ``hot_share`` of all repeated keys are at most ``hot_share`` many; their first
occurrences are broadcast, and the keys of all others meet theirs in a shuffle.

Cases: null texts stay null and have no units; empty texts stay empty; very long texts are cut and compared whole; a
document removed in full keeps its row with an empty text; repeated rows of one doc_id with one text count as one
document and are not held against each other; rows of one doc_id with different texts are documents of their own,
ranked by a hash of the text; rows without a doc_id rank before all others and are never cut; extra columns are kept as
they are, whatever their names, but for one named ``removed``, whose place the result's takes; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from playmill.llm.common import arrow_map, join_hot, materialize, quoted
from playmill.llm.near import mix

WORD = re.compile(r"\S+")
#: Whether a character, by its code, is white space; the last place stands for all codes from there on.
WHITE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])
#: Places between words of a sentence of which one is cut at least; few enough for runs of 15 words in passages of 50.
WINDOW = 10
STEP, OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Cut:
    """Units and keys of several documents; words, units and keys are numbered through all of them."""

    bounds: np.ndarray  # first word of each unit, and the number of words at the end
    unit_ends: np.ndarray  # x document: number of units up to its end
    first: np.ndarray  # x key: its first unit
    last: np.ndarray  # x key: its last unit
    key_ends: np.ndarray  # x document: number of keys up to its end
    digests: np.ndarray  # x key: 16 bytes as two 64-bit numbers


def _sums(scrambled: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """128 bits of each part of an array of scrambled numbers: their sum, and that of another function of them."""
    twisted = (scrambled ^ (scrambled >> np.uint64(29))) * OTHER
    return np.stack([np.add.reduceat(scrambled, starts), np.add.reduceat(twisted ^ (twisted >> np.uint64(32)), starts)], axis=1)


class Cutter:
    """Cuts documents into units, many at a time: all work is done on the codes of their characters, laid end to end."""

    def cut(self, texts: list[str]) -> Cut:
        """Units are runs of whole words; a line ends a unit, and so does a word that ends with ., ! or ?."""
        low = [t.lower() for t in texts]
        codes = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        white = WHITE[np.minimum(codes, len(WHITE) - 1)]
        edge = np.flatnonzero(np.diff(white, prepend=True))  # words start and end in turn; the last newline ends the last
        starts, ends = edge[::2], edge[1::2]
        n, doc_ends = len(starts), np.cumsum(np.array([len(t) + 1 for t in low], dtype=np.int64))
        docs = np.searchsorted(starts, doc_ends)
        if not n:
            none = np.zeros(0, dtype=np.int64)
            return Cut(np.zeros(1, dtype=np.int64), docs, none, none, docs, np.zeros((0, 2), np.uint64))
        line = np.searchsorted(np.flatnonzero(codes == 10), starts)
        final = codes[ends - 1]
        closes = (final == ord(".")) | (final == ord("!")) | (final == ord("?"))
        closes[:-1] |= line[1:] != line[:-1]
        begins = np.concatenate([[0], np.flatnonzero(closes[:-1]) + 1])
        with np.errstate(over="ignore"):
            rows = self._words(codes[~white], ends - starts)
            bounds = np.union1d(begins, self._places(rows[:, 0], begins, np.diff(np.append(begins, n))))
            sentence = np.searchsorted(begins, bounds, side="right") - 1
            follows = np.append(sentence[1:] == sentence[:-1], False)
            alone = ~follows & np.append(True, ~follows[:-1])
            first = np.flatnonzero(follows | alone)
            last = first + follows[first]
            bounds = np.append(bounds, n)
            digests = self._digests(rows, bounds[first], bounds[last + 1])
        unit_ends = np.searchsorted(bounds[:-1], docs)
        return Cut(bounds, unit_ends, first, last, np.searchsorted(first, unit_ends), digests)

    @staticmethod
    def _words(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """128 bits of each word: sums over its characters, each scrambled with its place in the word."""
        starts = np.cumsum(lengths) - lengths
        place = np.arange(len(codes), dtype=np.uint64) - np.repeat(starts.astype(np.uint64), lengths)
        return _sums(mix((codes.astype(np.uint64) << np.uint64(32)) ^ ((place + np.uint64(1)) * STEP)), starts)

    @staticmethod
    def _places(h: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Words before which long sentences are cut: of each WINDOW places in a row the smallest hash, the last of equal ones."""
        value = mix(h[:-1] * STEP + h[1:])
        stop = np.repeat(begins + lengths, lengths)
        starts = np.arange(len(h))
        starts = starts[starts + WINDOW < stop]
        out = []
        for at in range(0, len(starts), 65_536):
            some = starts[at : at + 65_536]
            seen = value[some[:, None] + np.arange(WINDOW - 1, -1, -1)]
            out.append(np.unique(some + WINDOW - 1 - seen.argmin(axis=1)) + 1)
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

    @staticmethod
    def _digests(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """128 bits of the words low to high - 1 of each key: sums of the words' bits, scrambled with their place."""
        counts = high - low
        starts = np.cumsum(counts) - counts
        place = np.arange(int(counts.sum())) - np.repeat(starts, counts)
        at, turn = np.repeat(low, counts) + place, (place.astype(np.uint64) + np.uint64(1)) * STEP
        return np.stack([np.add.reduceat(mix(mix(rows[at, k]) ^ turn), starts) for k in (0, 1)], axis=1)


def _binaries(digests: np.ndarray) -> pa.Array:
    """Rows of two 64-bit numbers as binary values of 16 bytes."""
    ends = pa.py_buffer(np.arange(0, 16 * len(digests) + 1, 16, dtype=np.int32))
    return pa.Array.from_buffers(pa.binary(), len(digests), [None, ends, pa.py_buffer(np.ascontiguousarray(digests))])


def units(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the digests of its keys in order, and the hash of its text."""

    def make():
        cutter = Cutter()

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = cutter.cut([t or "" for t in batch.column(1).to_pylist()])
            offsets = pa.array(np.append(0, found.key_ends).astype(np.int32))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, _binaries(found.digests)), batch.column(2)], ["doc_id", "digests", "text_hash"])

        return apply

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return arrow_map(rows, make, "doc_id long, digests array<binary>, text_hash long")


def repeated_units(docs: DataFrame, hot_share: int = 10_000) -> DataFrame:
    """(doc_id, repeated, text_hash): the positions of the keys that occur earlier in the corpus."""
    rows = units(docs).select("doc_id", "text_hash", F.posexplode("digests").alias("pos", "digest"))
    place = F.struct("doc_id", "text_hash", "pos")
    firsts = rows.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = materialize(firsts, "firsts")
    # keys of hot digests have theirs already: a key of their own spreads them over all tasks
    own = F.concat(F.lit("hot"), F.col("doc_id").cast("string"), F.lit("/"), F.col("text_hash").cast("string"), F.lit("/"), F.col("pos").cast("string")).cast("binary")
    keyed = join_hot(rows.where("doc_id is not null"), firsts, "digest", "n", own, hot_share)
    later = keyed.where(place > F.col("first"))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("__repeated")).select("doc_id", "__repeated", "text_hash")


def remove_repeats(docs: DataFrame, min_words: int = 15) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text`` and ``removed``: array of (start, end) in the original text."""
    names = [c for c in docs.columns if c not in ("text", "removed")]

    def spans_of(text: str, found: Cut, d: int, repeated: list[int]) -> list[tuple[int, int]]:
        """Where the runs of repeated units stand in the text: behind the word before, or from the start of the line."""
        key0, unit0 = (ends[d - 1] if d else 0 for ends in (found.key_ends, found.unit_ends))
        keys = np.array(repeated, dtype=np.int64) + key0
        marks = np.union1d(found.first[keys], found.last[keys])
        runs = np.split(marks, np.flatnonzero(np.diff(marks) > 1) + 1)
        long = [(low, high) for r in runs if (high := found.bounds[r[-1] + 1]) - (low := found.bounds[r[0]]) >= min_words]
        if not long:
            return []
        places, word0 = [m.span() for m in WORD.finditer(text)], found.bounds[unit0]
        out = []
        for low, high in long:
            begin, end = places[low - word0][0], places[high - 1 - word0][1]
            line = text.rfind("\n", 0, begin) + 1
            out.append((max(line, places[low - word0 - 1][1] if low > word0 else 0), end))
        return out

    def without(text: str, spans: list[tuple[int, int]]) -> str:
        kept, at = [], 0
        for start, end in spans:
            kept.append(text[at:start])
            line_end = text.find("\n", end)
            whole = (start == 0 or text[start - 1] == "\n") and line_end >= 0 and not text[end:line_end].strip()
            at = line_end + 1 if whole else end
        return "".join([*kept, text[at:]])

    def make():
        cutter = Cutter()

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, repeated = batch.column("__text").to_pylist(), batch.column("__repeated").to_pylist()
            asked = [i for i, (t, r) in enumerate(zip(texts, repeated)) if t and r]
            found, removed = cutter.cut([texts[i] for i in asked]), [[] for _ in texts]
            for d, i in enumerate(asked):
                if spans := spans_of(texts[i], found, d, repeated[i]):
                    texts[i], removed[i] = without(texts[i], spans), [{"start": a, "end": b} for a, b in spans]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            return pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(texts, pa.string()), pa.array(removed, kind)], ["__row", "__text", "removed"])

        return apply

    repeated = repeated_units(docs).withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    text = F.col("text").cast("string")
    # the columns that stay get numbers for names on the way
    row = F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(names)])
    wide = docs.select(row.alias("__row"), F.col("doc_id").cast("long").alias("__id"), F.xxhash64(text).alias("__hash"), text.alias("__text"))
    joined = wide.join(repeated, ["__id", "__hash"], "left").select("__row", "__text", "__repeated")
    span = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
    done = arrow_map(joined, make, StructType([joined.schema["__row"], StructField("__text", StringType()), StructField("removed", ArrayType(span))]))
    kept = {c: F.col(f"__row.c{i}").alias(c) for i, c in enumerate(names)} | {"text": F.col("__text").alias("text")}
    return done.select(*[kept[c] for c in docs.columns if c in kept], F.col("removed"))
