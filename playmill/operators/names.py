"""Names matched through inverted indexes: a ladder of rules, similar word sets, and names inside texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: words that say nothing about a name
COMMON_WORDS = ("the", "of", "and", "in", "at", "to", "for")

#: Rungs of the ladder, best first.
RUNGS = ("name", "full", "code", "word")


def significant_words(name: Column) -> Column:
    """The distinct lower-cased words of a name that are not common ones."""
    return F.array_distinct(F.array_except(F.split(F.lower(name), r"\s+"), F.array(*[F.lit(w) for w in (*COMMON_WORDS, "")])))


def _rung_keys(df: DataFrame, id: str, name: str, known: DataFrame) -> DataFrame:
    """(id, rung, key) of each name: itself, its full name, its code and its words, as an index to be joined on."""
    by_code = known.select(F.col("code").alias("__code"), F.col("full").alias("__full_of"))
    by_full = known.select(F.col("full").alias("__full"), F.col("code").alias("__code_of"))
    both = df.where(F.col(name).isNotNull()).select(F.col(id).alias("__id"), F.col(name).alias("__name"))
    both = both.join(by_code, F.col("__name") == F.col("__code"), "left").join(by_full, F.col("__name") == F.col("__full"), "left")
    single = [("__name", 0), (F.coalesce("__full_of", "__name"), 1), (F.coalesce("__code_of", "__name"), 2)]
    keys = F.array(*[F.struct(F.lit(rung).alias("rung"), (F.col(c) if isinstance(c, str) else c).alias("key")) for c, rung in single])
    words = F.transform(significant_words(F.col("__name")), lambda w: F.struct(F.lit(3).alias("rung"), w.alias("key")))
    return both.select("__id", F.explode(F.array_union(keys, words)).alias("k")).select("__id", "k.rung", "k.key")


def ladder(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_name: str, right_name: str, known: DataFrame) -> DataFrame:
    """(left_id, right_id, rung) of all pairs that some rung matches, with the best one.

    Rungs: equal names, equal full names, equal codes, a shared significant word.  ``known`` holds ``code`` and ``full``,
    each once.  One equi-join on (rung, key) finds all pairs, so nothing is compared that shares no key; a frequent word
    yields as many pairs as there are matches by it.  Null names match nothing.
    """
    a = _rung_keys(left, left_id, left_name, known).withColumnRenamed("__id", left_id)
    b = _rung_keys(right, right_id, right_name, known).withColumnRenamed("__id", right_id)
    met = a.join(b, ["rung", "key"]).groupBy(left_id, right_id).agg(F.min("rung").alias("rung"))
    return met.withColumn("rung", F.element_at(F.array(*[F.lit(r) for r in RUNGS]), F.col("rung") + 1))


def similar(df: DataFrame, name: str, percent: int = 60) -> DataFrame:
    """(a, b, shared, words) of distinct names, a before b, whose significant words overlap by ``percent`` of their union.

    A set-similarity join: words are ordered rarest first over the whole table, and two names can only reach the
    threshold if they share one of their first n - ceil(percent * n) + 1 words, so only these are indexed.  A pair is
    emitted at its first shared index word alone, lengths are compared before words.  Frequent words are thus hardly
    ever joined on.  Names that are null or have no significant word match nothing.
    """
    names = df.select(F.col(name).alias("name")).where("name is not null").distinct().withColumn("w", F.explode(significant_words(F.col("name"))))
    counts = names.groupBy("w").agg(F.count(F.lit(1)).alias("f"))
    ordered = names.join(counts, "w").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("f", "w"))).alias("s"))
    sets = ordered.select("name", F.col("s.w").alias("s"), F.size("s").alias("n"))
    first = F.col("n") - F.ceil(F.col("n") * percent / 100.0 - 1e-9).cast("int") + 1
    index = sets.withColumn("p", F.slice("s", F.lit(1), first)).withColumn("w", F.explode("p"))
    a = index.select("w", F.col("name").alias("a"), F.col("s").alias("sa"), F.col("p").alias("pa"), F.col("n").alias("na"))
    b = index.select("w", F.col("name").alias("b"), F.col("s").alias("sb"), F.col("p").alias("pb"), F.col("n").alias("nb"))
    lengths = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    met = a.join(b, "w").where(F.col("a") < F.col("b")).where(lengths).where(F.array_intersect("pa", "pb")[0] == F.col("w"))
    shared = met.withColumn("shared", F.size(F.array_intersect("sa", "sb"))).withColumn("words", F.col("na") + F.col("nb") - F.col("shared"))
    return shared.where(F.col("shared") * 100 >= F.col("words") * percent).select("a", "b", "shared", "words")


def contained(texts: DataFrame, text: str, needles: DataFrame, needle: str, gram: int = 3) -> DataFrame:
    """(text, needle) of distinct texts and the needles inside them.

    Each needle is indexed under its gram that fewest texts hold (under itself where it is shorter); texts meet it by
    that gram alone and are then searched.  Null and empty needles match nothing.
    """
    grams = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n) if isinstance(n, int) else n)))
    asked = needles.select(F.col(needle).alias("__needle")).where(F.length("__needle") > 0).distinct()
    given = texts.select(F.col(text).alias("__text")).where(F.length("__text") > 0).distinct()
    size = F.least(F.length("__needle"), F.lit(gram))
    keys = asked.withColumn("__g", F.explode(grams(F.col("__needle"), size)))
    pieces = [F.when(F.length("__text") >= n, grams(F.col("__text"), n)).otherwise(F.array().cast("array<string>")) for n in range(1, gram + 1)]
    wanted = keys.select("__g").distinct()
    index = given.withColumn("__g", F.explode(F.array_distinct(F.concat(*pieces)))).join(wanted, "__g", "left_semi")
    held = index.groupBy("__g").agg(F.count(F.lit(1)).alias("__f"))
    rarest = keys.join(held, "__g").groupBy("__needle").agg(F.min_by("__g", F.struct("__f", "__g")).alias("__g"))
    met = index.join(rarest, "__g").where(F.contains("__text", "__needle"))
    return met.select(F.col("__text").alias(text), F.col("__needle").alias(needle))
