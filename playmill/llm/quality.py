"""Operator 10: document quality by a sparse ensemble of rules.

Statistics of a text are Spark expressions.  Small trees are grown by gradient boosting on a bounded sample of labelled
rows; each path from a root is a conjunctive rule over the statistics; a lasso logistic regression weights the rules
and drops most of them; what is left is compiled back into one Spark column, so scoring runs in the JVM without Python.

The sample is bounded by ``max_rows`` (doc_ids with the smallest hash); a doc_id stands in it once, with the smallest
hash of its texts.

Cases: a null text counts as empty; an empty text has zero for every statistic and is scored like any other; very long
texts are counted whole; without labels of both kinds the score is the share of good labels (1 without labels); a doc_id
with both labels counts as good; ties in the sample go to the smaller doc_id; repeated rows get equal scores; other
columns are not read and stay as they are in ``with_stats``, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playmill.llm.common import free_name, quoted
from playmill.llm.toxicity import held_out

STATS = ["chars", "words", "word_length", "distinct_words", "distinct_parts", "upper", "marks", "odd_marks", "digits", "lines", "distinct_lines", "line_words"]


def with_stats(docs: DataFrame, out: str = "__stats", text: str = "text") -> DataFrame:
    """``docs`` with one struct column ``out`` of doubles more."""
    names = [free_name(docs, n) for n in ("__text", "__words", "__lines", "__parts")]
    t, w, lines, parts = map(F.col, names)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    split = docs.withColumn(names[0], F.coalesce(F.col(quoted(text)), F.lit("")))
    split = split.withColumn(names[1], F.filter(F.split(t, r"\s+"), lambda x: x != "")).withColumn(names[2], F.filter(F.split(t, "\n"), lambda x: x != "")).withColumn(names[3], F.split(t, r"[.!?|\n]+"))
    n, words, n_lines = F.length(t).cast("double"), F.size(w).cast("double"), F.size(lines).cast("double")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    distinct = lambda c: F.size(F.array_distinct(c)).cast("double")
    return split.withColumn(
        out,
        F.struct(
            n.alias("chars"),
            words.alias("words"),
            ratio(n, words).alias("word_length"),
            ratio(distinct(w), words).alias("distinct_words"),
            ratio(distinct(parts), F.size(parts).cast("double")).alias("distinct_parts"),
            ratio(count(r"\p{Lu}"), n).alias("upper"),
            ratio(count(r"[^\p{L}\p{N}\s]"), words).alias("marks"),
            ratio(count(r"[^\p{L}\p{N}\s.,;:'\"!?()-]"), words).alias("odd_marks"),
            ratio(count(r"\p{N}"), n).alias("digits"),
            n_lines.alias("lines"),
            ratio(distinct(lines), n_lines).alias("distinct_lines"),
            ratio(words, n_lines).alias("line_words"),
        ),
    ).drop(*names)


@dataclass
class RuleModel:
    """Rules (tuples of (statistic, is greater, cut)), their weights and the intercept."""

    rules: list[tuple[tuple[str, bool, float], ...]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def column(self, stats: str = "__stats") -> Column:
        """The score as a Spark expression."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            holds = None
            for name, greater, cut in rule:
                x = F.col(f"{stats}.{name}")
                one = x > cut if greater else x <= cut
                holds = one if holds is None else holds & one
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def apply(self, x: np.ndarray) -> np.ndarray:
        """The same score in numpy."""
        total = self.intercept + rule_matrix(x, self.rules) @ np.array(self.weights) if self.rules else np.full(len(x), self.intercept)
        return 1 / (1 + np.exp(-total))


def rule_matrix(x: np.ndarray, rules: list) -> np.ndarray:
    """Rows x rules: 1 where a rule holds."""
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for name, greater, cut in rule:
            v = x[:, STATS.index(name)]
            out[:, j] *= (v > cut) if greater else (v <= cut)
    return out


def _grow(x: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, path: tuple, leaves: list, least: int) -> None:
    """Split on the largest gain; every node but the root is a rule, leaves also get a value."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, -1, 0.0)
    if depth and len(rows) >= 2 * least:
        for j, cs in enumerate(cuts):
            if not len(cs):
                continue
            k = np.searchsorted(cs, x[rows, j], side="left")  # bin k: x <= cs[k]
            gs = np.cumsum(np.bincount(k, weights=grad[rows], minlength=len(cs) + 1))[:-1]
            hs = np.cumsum(np.bincount(k, weights=hess[rows], minlength=len(cs) + 1))[:-1]
            ns = np.cumsum(np.bincount(k, minlength=len(cs) + 1))[:-1]
            gain = np.where((ns >= least) & (len(rows) - ns >= least), gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1), -1)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), j, float(cs[i]))
    if best[1] < 0:
        leaves.append((path, -g / (h + 1), rows))
        return
    _, j, cut = best
    low = x[rows, j] <= cut
    for greater, part in ((False, rows[low]), (True, rows[~low])):
        leaves.append((own := (*path, (STATS[j], greater, cut)), None, None))
        _grow(x, cuts, grad, hess, part, depth - 1, own, leaves, least)


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 3, penalty: float = 0.002, rounds: int = 400) -> RuleModel:
    """Boosted trees, their paths as rules, and the lasso over them."""
    share = float(y.mean()) if len(y) else 1.0
    limit = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    if not 0 < share < 1:
        return RuleModel(intercept=limit)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 60))) for j in range(x.shape[1])]
    margin, rules = np.full(len(y), limit), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        leaves: list = []
        _grow(x, cuts, p - y, p * (1 - p), np.arange(len(y)), depth, (), leaves, max(3, len(y) // 500))
        for path, value, rows in leaves:
            if path:
                rules[path] = True
            if rows is not None:
                margin[rows] += 0.3 * value
    kept, seen = [], set()
    matrix = rule_matrix(x, list(rules))
    for j, rule in enumerate(rules):
        key = matrix[:, j].tobytes()
        if key not in seen and 0 < matrix[:, j].mean() < 1:
            seen.add(key)
            kept.append(j)
    matrix, names = matrix[:, kept], [list(rules)[j] for j in kept]
    w, b = np.zeros(len(names)), limit
    z, c, t = w.copy(), b, 1.0
    rate = 4.0 / max(1.0, float(np.linalg.eigvalsh(matrix.T @ matrix / len(y)).max()) + 1)
    for _ in range(rounds):  # accelerated proximal gradient
        gap = (1 / (1 + np.exp(-(matrix @ z + c))) - y) / len(y)
        new = z - rate * (matrix.T @ gap)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        c_new, t_new = c - rate * gap.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, c = new + (t - 1) / t_new * (new - w), c_new + (t - 1) / t_new * (c_new - b)
        w, b, t = new, c_new, t_new
    live = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel([names[j] for j in live], [float(w[j]) for j in live], float(b))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> RuleModel:
    """The rules learnt from labelled rows outside the held-out third."""
    usable = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"), 3, 1)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("__y"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # at most max_rows ids, so they are broadcast; one text of each
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "__y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = with_stats(texts).select("__y", "__stats.*").toPandas()
    rows = rows.sort_values(list(rows.columns))
    return fit_rules(rows[STATS].to_numpy(dtype=float), rows["__y"].to_numpy(dtype=float))


def quality_scores(docs: DataFrame, model: RuleModel) -> DataFrame:
    """Per row: doc_id, score and predicted."""
    scored = with_stats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
