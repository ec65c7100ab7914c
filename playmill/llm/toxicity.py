"""Operator 6: toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Document labels become token labels first: a word or word beginning that stands in many more toxic than clean
documents of the training sample (log-likelihood ratio and rate ratio over fixed thresholds) marks its tokens in toxic
documents as toxic.  A two-state chain over word and word-beginning features learns from those tokens.  Forward and
backward messages over whole texts give each token's probability; a document's score is a logistic function of its
highest token log-odds and its number of likely tokens, and tokens at 0.5 or more are returned with their offsets.

The sample of labelled rows that the model is fitted on holds each pair of whole text and label once and is bounded by
``max_toxic`` and ``max_clean`` (rows with the smallest hash of doc_id) and by ``max_chars`` (longer texts are not learnt
from), so it is 80 MB of characters at most.  Everything is scored whole.

Cases: a null or empty text, or one of white space only, has no tokens and gets the score of a text without toxic
words; very long texts are tagged whole, row after row of tokens; without labels of both kinds the score is the share of
toxic labels (0 without labels); a doc_id with both labels counts as toxic, and one text with both labels is learnt from
under each; a doc_id with several texts is learnt from by one of them; ties in the sample go to the smaller doc_id;
repeated rows get equal results; other columns are not read by ``toxicity_scores``, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playmill.llm.common import Remembered, arrow_map

EDGE = re.compile(r"^\W+|\W+$")
BEGINNINGS = (3, 4, 5, 6)
ROW = 128
LIMIT = 12.0


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` when divided by ``folds``."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(folds)) == fold, F.lit(False))


def word_features(token: str) -> list[str]:
    """The word without outer marks, and its beginnings."""
    word = EDGE.sub("", token.lower())
    return ["w" + word] + [f"{k}{word[:k]}" for k in BEGINNINGS if len(word) > k] if word else []


@dataclass
class TokenChain:
    """A fitted chain: feature weights, bias, transition factors and the document-level logistic function."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -LIMIT
    stay: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))
    level: tuple[float, float, float] = (0.0, 0.0, 0.0)
    constant: float | None = 0.0

    def unary(self, token: str) -> float:
        """Log-odds of the toxic state from the token alone."""
        return float(np.clip(self.bias + sum(self.weights.get(f, 0.0) for f in word_features(token)), -LIMIT, LIMIT))

    def marginals(self, unary: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Toxic log-odds of every token of several documents laid end to end.

        Texts are laid out in rows of ROW tokens.  The message through a row is a Möbius map of the incoming odds;
        maps of whole rows are composed first, then handed from row to row of a document, then each row is walked.
        """
        rows_of = -(-lengths // ROW)
        first_row = np.cumsum(rows_of) - rows_of
        doc = np.repeat(np.arange(len(lengths)), lengths)
        within = np.arange(len(unary)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        row, col = first_row[doc] + within // ROW, within % ROW
        n = int(rows_of.sum())
        w, live = np.ones((n, ROW)), np.zeros((n, ROW), dtype=bool)
        w[row, col], live[row, col] = np.exp(unary), True
        (a00, a01), (a10, a11) = self.stay
        ahead = self._incoming(w, live, first_row, rows_of, 0.0, lambda w: (w * a11, w * a01, np.full_like(w, a10), np.full_like(w, a00)), False)
        behind = self._incoming(w, live, first_row, rows_of, 1.0, lambda w: (w * a11, np.full_like(w, a10), w * a01, np.full_like(w, a00)), True)
        odds, r, b = np.empty((n, ROW)), ahead, behind
        for t in range(ROW):
            r = np.where(live[:, t], w[:, t] * (a01 + a11 * r) / (a00 + a10 * r), r)
            odds[:, t] = r
        for t in range(ROW - 1, -1, -1):
            odds[:, t] *= b
            v = w[:, t] * b
            b = np.where(live[:, t], (a10 + a11 * v) / (a00 + a01 * v), b)
        return np.log(np.maximum(odds[row, col], 1e-30))

    @staticmethod
    def _incoming(w, live, first_row, rows_of, start, step, backward) -> np.ndarray:
        """What each row gets from its neighbour."""
        n = len(w)
        p, q, s, u = np.ones(n), np.zeros(n), np.zeros(n), np.ones(n)
        for t in range(ROW - 1, -1, -1) if backward else range(ROW):
            e, f, g, h = step(w[:, t])
            on = live[:, t]
            p2, q2, s2, u2 = e * p + f * s, e * q + f * u, g * p + h * s, g * q + h * u
            scale = np.where(on, np.maximum(np.maximum(p2, q2), np.maximum(s2, u2)), 1.0)
            p, q, s, u = np.where(on, p2 / scale, p), np.where(on, q2 / scale, q), np.where(on, s2 / scale, s), np.where(on, u2 / scale, u)
        got = np.full(n, start)
        for k in range(1, int(rows_of.max(initial=0))):
            has = np.flatnonzero(rows_of > k)
            at = first_row[has] + (rows_of[has] - 1 - k if backward else k)
            near = at + 1 if backward else at - 1
            got[at] = (p[near] * got[near] + q[near]) / (s[near] * got[near] + u[near])
        return got

    def scores(self, log_odds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Document scores from token log-odds."""
        if self.constant is not None:
            return np.full(len(lengths), self.constant)
        x = self._document_features(log_odds, lengths)
        return 1 / (1 + np.exp(-np.clip(self.level[0] + x @ np.array(self.level[1:]), -30, 30)))

    @staticmethod
    def _document_features(log_odds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        top, likely = np.full(len(lengths), -LIMIT), np.zeros(len(lengths))
        ends = np.cumsum(lengths)
        some = np.flatnonzero(lengths)
        if len(some):
            starts = (ends - lengths)[some]
            top[some] = np.clip(np.maximum.reduceat(log_odds, starts), -LIMIT, LIMIT)
            likely[some] = np.log1p(np.add.reduceat(np.where(log_odds >= 0, 1 / (1 + np.exp(-log_odds)), 0), starts))
        return np.stack([top, likely], axis=1)


class Vocabulary:
    """Words of a sample as numbers, and the numbers of their features (padded with the number of features)."""

    def __init__(self, texts: list[str]):
        index: dict[str, int] = {}
        self.tokens = [np.array([index.setdefault(w, len(index)) for w in t.split()], dtype=np.int32) for t in texts]
        names: dict[str, int] = {}
        self.features = np.full((len(index), 1 + len(BEGINNINGS)), -1, dtype=np.int32)
        for i, w in enumerate(index):
            own = [names.setdefault(f, len(names)) for f in word_features(w)]
            self.features[i, : len(own)] = own
        self.names = list(names)
        self.features[self.features < 0] = len(names)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """Distinct features of a document."""
        found = np.unique(self.features[np.unique(tokens)])
        return found[found < len(self.names)]


def _indicative(docs: list[np.ndarray], toxic: np.ndarray, size: int) -> np.ndarray:
    """Features (as flags) that stand in toxic documents far more often than in clean ones."""
    in_docs = lambda y: np.bincount(np.concatenate([np.zeros(0, dtype=np.int32), *[d for d, t in zip(docs, toxic) if t == y]]), minlength=size)
    n0, n1 = in_docs(0), in_docs(1)
    total = (int((toxic == 0).sum()), int((toxic == 1).sum()))
    base, least = total[1] / len(toxic), max(3, 0.005 * total[1])
    often = (n1 >= least) & ((n1 + 0.5) / (total[1] + 1) >= 10 * (n0 + 0.5) / (total[0] + 1))
    share = np.where(often, n1 / np.maximum(n1 + n0, 1), 0.5)
    clean = np.where(n0 > 0, n0 * np.log(np.maximum(1 - share, 1e-12) / max(1 - base, 1e-12)), 0.0)
    return often & (n1 * np.log(share / base) + clean >= 7)


def fit_chain(texts: list[str], toxic: list[int], weight_clean: float = 1.0, length: int = 64, rounds: int = 120, seed: int = 0) -> TokenChain:
    """Fit the chain and its document-level function on labelled texts."""
    share = sum(toxic) / len(toxic) if toxic else 0.0
    if not 0 < share < 1:
        return TokenChain(constant=share)
    words = Vocabulary(texts)
    tokens, size = words.tokens, len(words.names)
    left, of_left = [words.of(ts) for ts in tokens], np.array(toxic)
    marks = np.zeros(size + 1, dtype=bool)
    while (of_left == 1).any() and (found := _indicative(left, of_left, size)).any():  # then the toxic documents that nothing explains yet
        marks[:size] |= found
        stay = [y == 0 or not found[fs].any() for fs, y in zip(left, of_left)]
        left, of_left = [fs for fs, ok in zip(left, stay) if ok], of_left[stay]
    del left
    if not marks.any():
        return TokenChain(constant=share)
    marked = marks[words.features].any(axis=1)
    rng = np.random.default_rng(seed)
    chosen: list[tuple[np.ndarray, int]] = []
    others: list[tuple[np.ndarray, int]] = []
    for ts, y in zip(tokens, toxic):
        if y == 1 and not marked[ts].any():
            continue
        for at in range(0, len(ts), length):
            part = ts[at : at + length]
            (chosen if marked[part].any() else others).append((part, y))
    extra = rng.permutation(len(others))[: max(2000, 3 * len(chosen))]
    parts = chosen + [others[i] for i in sorted(extra)]
    seen = np.bincount(words.features[np.concatenate([ts for ts, _ in parts])].ravel(), minlength=size + 1)[:size]
    used = np.flatnonzero(seen >= 5)
    k, width = len(used), 1 + len(BEGINNINGS)
    place = np.full(size + 1, k, dtype=np.int32)
    place[used] = np.arange(k)
    grid = np.full((len(parts), length, width), k, dtype=np.int32)
    y, live = np.zeros((len(parts), length)), np.zeros((len(parts), length), dtype=bool)
    for i, (ts, toxic_doc) in enumerate(parts):
        y[i, : len(ts)], live[i, : len(ts)] = marked[ts] * toxic_doc, True
        grid[i, : len(ts)] = place[words.features[ts]]
    theta, chain = np.zeros(k + 1 + 4), TokenChain(constant=None)
    theta[k], m, v = -3.0, np.zeros(k + 5), np.zeros(k + 5)
    before = np.concatenate([np.zeros((len(parts), 1)), y[:, :-1]], axis=1).astype(int)
    seen_pairs = np.bincount((2 * before + y.astype(int))[live], minlength=4)
    flat = np.ascontiguousarray(grid[live].T)  # one row for each kind of feature
    del grid
    for i in range(1, rounds + 1):
        padded = np.append(theta[:k], 0.0)
        u = np.full(live.shape, 0.0)
        u[live] = np.clip(sum(padded[column] for column in flat) + theta[k], -LIMIT, LIMIT)
        p, pairs = _expectations(np.exp(u), live, np.exp(np.clip(theta[k + 1 :], -6, 6)).reshape(2, 2))
        gap = p[live] - y[live]
        grad = np.empty_like(theta)
        grad[:k] = sum(np.bincount(column, weights=gap, minlength=k + 1) for column in flat)[:k] + 0.02 * theta[:k]
        grad[k], grad[k + 1 :] = gap.sum(), pairs - seen_pairs + 1.0 * theta[k + 1 :]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= 0.2 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    weight = np.append(np.where(np.abs(theta[:k]) > 0.02, theta[:k], 0.0), 0.0)
    chain.weights = {words.names[f]: float(w) for f, w in zip(used, weight) if w}
    chain.bias, chain.stay = float(theta[k]), np.exp(np.clip(theta[k + 1 :], -6, 6)).reshape(2, 2)
    unary = np.clip(chain.bias + weight[place[words.features]].sum(axis=1), -LIMIT, LIMIT)
    lengths = np.array([len(ts) for ts in tokens])
    log_odds = chain.marginals(unary[np.concatenate(tokens)], lengths)
    x = np.column_stack([np.ones(len(tokens)), chain._document_features(log_odds, lengths)])
    target, weight = np.array(toxic, dtype=float), np.where(np.array(toxic) == 1, 1.0, weight_clean)
    level = np.zeros(3)
    for _ in range(40):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ level, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 0.05, 0.05])
        level = level - np.linalg.solve(hess, x.T @ (weight * (p - target)) + np.array([1e-3, 0.05, 0.05]) * level)
        level[1:] = np.maximum(level[1:], 0)
    chain.level = tuple(map(float, level))
    return chain


def _expectations(w: np.ndarray, live: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token probabilities and expected transition counts of short sequences, all starting from the clean state."""
    (a00, a01), (a10, a11) = stay
    n, length = w.shape
    r_in, b_out = np.zeros((n, length)), np.ones((n, length))
    r = np.zeros(n)
    for t in range(length):
        r_in[:, t] = r
        r = np.where(live[:, t], w[:, t] * (a01 + a11 * r) / (a00 + a10 * r), r)
    b = np.ones(n)
    for t in range(length - 1, -1, -1):
        b_out[:, t] = b
        v = w[:, t] * b
        b = np.where(live[:, t], (a10 + a11 * v) / (a00 + a01 * v), b)
    v = w * b_out
    part = live / (a00 + a01 * v + a10 * r_in + a11 * r_in * v)
    toxic = part * v * (a01 + a11 * r_in)
    return toxic, np.array([a00 * part.sum(), a01 * (part * v).sum(), a10 * (part * r_in).sum(), a11 * (part * r_in * v).sum()])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, skip: Column, sizes: dict[int, int], max_chars: int) -> tuple[list[str], list[int], dict[int, int]]:
    """Texts and labels of a bounded sample, one row for each whole text and label, and how many labels of each kind there are to learn from."""
    usable = labels.where(F.col(label).isin(0, 1) & ~skip).groupBy("doc_id").agg(F.max(label).cast("int").alias("__y"))
    totals = {r["__y"]: r["n"] for r in usable.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("__text")).where(F.length("text") <= max_chars)
    # one text a document, then one document a text and label; partial sums keep a hot doc_id or text out of one task
    single = texts.groupBy("doc_id").agg(F.min("__text").alias("__text")).join(usable, "doc_id")
    least = single.groupBy("__text", "__y").agg(F.min(F.struct(F.xxhash64("doc_id").alias("order"), "doc_id")).alias("__least")).select("__text", "__y", "__least.*")
    picks = [least.where(F.col("__y") == y).orderBy("order", "doc_id").limit(n) for y, n in sizes.items()]
    chosen = picks[0].unionByName(picks[1]).select("doc_id", "__text", "__y")
    # at most sum(sizes) rows, so it is broadcast
    found = texts.join(F.broadcast(chosen), ["doc_id", "__text"]).groupBy("doc_id", "__y").agg(F.min("text").alias("text")).select("text", "__y").toPandas()
    found = found.sort_values(["text", "__y"])
    return found["text"].tolist(), found["__y"].tolist(), totals


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_toxic: int = 1000, max_clean: int = 3000, max_chars: int = 20_000) -> TokenChain:
    """The chain learnt from the labelled rows outside the held-out fifth."""
    texts, toxic, totals = labelled_sample(docs, labels, "toxic", held_out(F.col("doc_id"), 5, 0), {1: max_toxic, 0: max_clean}, max_chars)
    ours = {y: max(1, toxic.count(y)) for y in (0, 1)}
    clean = (totals.get(0, 1) / ours[0]) / max(1e-9, totals.get(1, 1) / ours[1])
    return fit_chain(texts, toxic, weight_clean=clean)


def toxicity_scores(docs: DataFrame, model: TokenChain, with_spans: bool = True) -> DataFrame:
    """Per row: doc_id, score, predicted and the toxic spans (start, end, probability) in characters."""

    def make():
        known = Remembered(60_000)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [t.split() for t in texts]
            lengths = np.array([len(ts) for ts in tokens], dtype=np.int64)
            unary = known.fill({w for ts in tokens for w in ts}, lambda new: [model.unary(w) for w in new])
            u = np.fromiter((unary[w] for ts in tokens for w in ts), dtype=float, count=int(lengths.sum()))
            log_odds = model.marginals(u, lengths)
            score = model.scores(log_odds, lengths)
            columns = {"doc_id": batch.column(0), "score": pa.array(score), "predicted": pa.array((score >= 0.5).astype("int32"))}
            if with_spans:
                spans, ends = [[] for _ in texts], np.cumsum(lengths)
                hits = np.flatnonzero(log_odds >= 0)
                for d in np.unique(np.searchsorted(ends, hits, side="right")):
                    own = log_odds[ends[d] - lengths[d] : ends[d]]
                    # the words are found one after another, as split() cut them
                    at, places = 0, []
                    for w in tokens[d]:
                        at = texts[d].index(w, at)
                        places.append((at, at + len(w)))
                        at += len(w)
                    spans[d] = [{"start": places[i][0], "end": places[i][1], "probability": float(1 / (1 + np.exp(-own[i])))} for i in np.flatnonzero(own >= 0)]
                columns["spans"] = pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])))
            return pa.RecordBatch.from_pydict(columns)

        return apply

    schema = "doc_id long, score double, predicted int" + ", spans array<struct<start:int,end:int,probability:double>>" * with_spans
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, schema)
