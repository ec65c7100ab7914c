"""Leakage-free as-of statistics, prior-period fallback and the one-component profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playmill.functions.maths import ratio
from playmill.functions.matrices import top_component


def totals(df: DataFrame, keys: list[str], sums: list[str], means: list[str] = ()) -> DataFrame:
    """Sums, means and the number of rows per key; sums of nothing are 0."""
    return df.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in sums], *[F.avg(c).alias(c) for c in means], F.count(F.lit(1)).alias("games"))


def day_number(day: Column) -> Column:
    """Days since 1970 as an integer, for range frames."""
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def running_before(df: DataFrame, keys: list[str], day: str, sums: list[str]) -> DataFrame:
    """For each (key, day) of ``df``, sums and counts over strictly earlier days.

    Days are pre-aggregated, so the window holds one row per key and day whatever the input.
    """
    daily = df.groupBy(*keys, day).agg(*[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("games"))
    earlier = Window.partitionBy(*keys).orderBy(day_number(F.col(day))).rangeBetween(Window.unboundedPreceding, -1)
    return daily.select(*keys, day, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in [*sums, "games"]])


def as_of(facts: DataFrame, asked: DataFrame, keys: list[str], day: str, sums: list[str]) -> DataFrame:
    """Totals of all facts before each asked (key, day): a union ordered by day, not a range join."""
    daily = facts.groupBy(*keys, day).agg(*[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("games"))
    both = daily.withColumn("__asked", F.lit(False)).unionByName(asked.select(*keys, day).distinct().withColumn("__asked", F.lit(True)), allowMissingColumns=True)
    earlier = Window.partitionBy(*keys).orderBy(day_number(F.col(day))).rangeBetween(Window.unboundedPreceding, -1)
    done = both.select(*keys, day, "__asked", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in [*sums, "games"]])
    return done.where("__asked").drop("__asked")


def ratios(df: DataFrame) -> DataFrame:
    """Shooting, per-game and per-minute figures of box-score totals, 0 where the base is 0, three decimals."""
    c, g, m = F.col, F.col("games"), F.col("mins")
    found = {
        "p2": c("fg") - c("p3"),
        "mpg": ratio(m, g),
        "p3_pct": ratio(c("p3"), c("p3a")),
        "ft_pct": ratio(c("ft"), c("fta")),
        "efg": ratio(c("fg") + c("p3") * 0.5, c("fga")),
        "ts": ratio(c("pts"), (c("fga") + c("fta") * 0.44) * 2),
        "p3r": ratio(c("p3a"), c("fga")),
        "ftr": ratio(c("fta"), c("fga") + c("fta")),
        "pfft": ratio(c("ft"), c("pts")),
        "ppg": ratio(c("pts"), g),
        "rpg": ratio(c("orb") + c("drb"), g),
        "drpg": ratio(c("drb"), g),
        "orpg": ratio(c("orb"), g),
        "apg": ratio(c("ast"), g),
        "spg": ratio(c("stl"), g),
        "bpg": ratio(c("blk"), g),
        "bpm": ratio(c("blk"), m),
        "spm": ratio(c("stl"), m),
        "tpg": ratio(c("tov"), g),
        "fpg": ratio(c("pf"), g),
        "fpm": ratio(c("pf"), m),
    }
    return df.select("*", *[F.round(v, 3).alias(k) for k, v in found.items()])


def medians_before(facts: DataFrame, asked: DataFrame, key: str, day: str, measures: list[str]) -> DataFrame:
    """Exact medians, games, last day and rest days of each asked (key, day) over earlier facts.

    Each fact goes to the first asked day behind it; the medians are then carried along the asked days of a key, so a
    fact is read once however many days are asked for.  Asked days without earlier facts are left out.
    """
    rows = facts.select(key, F.col(day).alias("__day"), *measures).withColumn("__asked", F.lit(None).cast("date"))
    points = asked.select(key, F.col(day).alias("__asked")).distinct().withColumn("__day", F.col("__asked"))
    both = rows.unionByName(points, allowMissingColumns=True)
    later = Window.partitionBy(key).orderBy(-day_number(F.col("__day"))).rangeBetween(Window.unboundedPreceding, -1)
    placed = both.withColumn("__bucket", F.coalesce("__asked", F.min("__asked").over(later))).where("__bucket is not null")
    so_far = Window.partitionBy(key).orderBy(day_number(F.col("__bucket"))).rangeBetween(Window.unboundedPreceding, 0)
    fact = F.col("__asked").isNull()
    carried = placed.select(
        key,
        F.col("__asked").alias(f"as_of_{day}"),
        *[F.round(F.percentile(m, 0.5).over(so_far), 1).alias(m) for m in measures],
        F.sum(fact.cast("long")).over(so_far).alias("games"),
        F.max(F.when(fact, F.col("__day"))).over(so_far).alias("last_day"),
    )
    kept = carried.where(F.col(f"as_of_{day}").isNotNull() & (F.col("games") > 0))
    return kept.withColumn("rest_days", F.datediff(f"as_of_{day}", "last_day"))


def with_fallback(current: DataFrame, prior: DataFrame, keys: list[str], columns: list[str], least_games: int, default_rest: int | None = None) -> DataFrame:
    """Current figures where there are enough games, else those of the prior period, with where they come from."""
    p = prior.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.col("games").alias("__games"))
    joined = current.join(p, keys, "full")
    enough = F.coalesce(F.col("games") >= least_games, F.lit(False))
    out = [F.when(enough, F.col(c)).otherwise(F.coalesce(F.col(f"__{c}"), F.lit(0.0))).alias(c) for c in columns]
    source = F.when(enough, "current").when(F.col("__games").isNotNull(), "prior").otherwise("none").alias("source")
    rest = [F.when(F.coalesce("games", F.lit(0)) == 0, F.lit(default_rest)).otherwise(F.col("rest_days")).alias("rest_days")] if default_rest is not None else []
    return joined.select(*keys, *out, *rest, F.coalesce("games", F.lit(0)).alias("original_games"), source)


def season_fallback(current: DataFrame, whole: DataFrame, entity: str, season: str, columns: list[str], least_games: int) -> DataFrame:
    """Figures of the season so far; with too few games, those of the whole season before it, if that has enough.

    ``whole`` holds only the seasons that may be fallen back to.  What fell back names its season in ``fallback_from``;
    ``original_games`` is the number of games of the season so far.  Without a season to fall back to, the few games
    stay.  Both tables have one row for each entity and season, and ``games`` among ``columns``.
    """
    prior = whole.where(F.col("games") >= least_games).select(F.col(entity).alias("__entity"), (F.col(season) + 1).alias("__next"), F.struct(*columns).alias("__prior"))
    joined = current.join(prior, (F.col(entity) == F.col("__entity")) & (F.col(season) == F.col("__next")), "left")
    falls = (F.col("games") < least_games) & F.col("__prior").isNotNull()
    chosen = joined.withColumn("__falls", falls).withColumn("__own", F.struct(*columns)).withColumn("__chosen", F.when(F.col("__falls"), F.col("__prior")).otherwise(F.col("__own")))
    return chosen.select(entity, season, F.col("games").alias("original_games"), F.when(F.col("__falls"), F.col(season)).alias("fallback_from"), *[F.col(f"__chosen.{c}").alias(c) for c in columns])


def two_row_games(df: DataFrame, game: str, venue: str, team: str, points: str, spread: str, order: list[str]) -> DataFrame:
    """One row per game of exactly two: R is away and H home; N and N goes by the sign of the first row's spread."""
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(venue).alias("v"), F.col(team).alias("t"), F.col(points).alias("p"), F.col(spread).alias("s"))))
    pairs = df.groupBy(game).agg(F.count(F.lit(1)).alias("n"), rows.alias("r")).where("n = 2")
    first, second = F.col("r")[0], F.col("r")[1]
    road = (first["v"] == "R") & (second["v"] == "H")
    back = (first["v"] == "H") & (second["v"] == "R")
    neutral = (first["v"] == "N") & (second["v"] == "N")
    away_first = road | (neutral & F.coalesce(first["s"] > 0, F.lit(False)))
    pairs = pairs.where(road | back | neutral).withColumn("a", F.when(away_first, first).otherwise(second)).withColumn("h", F.when(away_first, second).otherwise(first))
    return pairs.select(game, F.col("a.t").alias("away_team"), F.col("h.t").alias("home_team"), F.col("a.p").alias("away_score"), F.col("h.p").alias("home_score"), neutral.alias("neutral_site"))


def profile_scores(df: DataFrame, group: list[str], name: str, features: list[str], least_rows: int = 5) -> DataFrame:
    """First principal component of standardised features within each group.

    Population deviation; a constant feature is scaled by 1; the loading of largest size is positive.  Means and
    products are aggregates, their small matrix, a row for each group, is decomposed by Jacobi rotations: all of it in
    the JVM.  Rows with a null feature take no part; groups of less than ``least_rows`` get 0.
    """
    known = df.na.drop(subset=features)
    k = len(features)
    scale = [F.when(F.stddev_pop(f) > 0, F.stddev_pop(f)).otherwise(1.0) for f in features]
    figures = known.groupBy(*group).agg(
        F.count(F.lit(1)).alias("__n"),
        F.array(*[F.avg(f) for f in features]).alias("__mean"),
        F.array(*scale).alias("__scale"),
        F.array(*[F.covar_pop(a, b) for a in features for b in features]).alias("__products"),
    )
    matrix = F.transform("__products", lambda v, x: v / (F.get("__scale", F.floor(x / k).cast("int")) * F.get("__scale", x % k)))
    fitted = figures.withColumn("__load", F.zip_with(top_component(matrix, k), "__scale", lambda v, s: v / s)).drop("__scale", "__products")
    keyed = fitted.withColumnsRenamed({g: f"__{g}" for g in group})
    same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group]
    joined = known.select(*group, name, *features).join(keyed, reduce(lambda a, b: a & b, same))
    parts = [(F.col(f) - F.col("__mean")[i]) * F.col("__load")[i] for i, f in enumerate(features)]
    return joined.select(*group, name, F.when(F.col("__n") >= least_rows, sum(parts[1:], parts[0])).otherwise(0.0).alias("score"))


def pair_profile(df: DataFrame, group: list[str], name: str, x: str, y: str) -> DataFrame:
    """The same for two features without leaving the JVM: the component is (1, sign of correlation) / sqrt 2."""
    known = df.na.drop(subset=[x, y])
    deviation = lambda c: F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0)
    sign = F.when(F.covar_pop(x, y) < 0, -1.0).otherwise(1.0)
    figures = known.groupBy(*[F.col(g).alias(f"__{g}") for g in group]).agg(F.avg(x).alias("__mx"), F.avg(y).alias("__my"), deviation(x).alias("__sx"), deviation(y).alias("__sy"), sign.alias("__sign"))
    joined = known.join(figures, reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group]))
    score = (F.col(x) - F.col("__mx")) / F.col("__sx") + F.col("__sign") * (F.col(y) - F.col("__my")) / F.col("__sy")
    return joined.select(*group, name, (score / F.sqrt(F.lit(2.0))).alias("score"))


def cohorts(current: DataFrame, prior: DataFrame, keys: list[str], least_games: int) -> DataFrame:
    """Entities sorted into sufficient, prior and none, each with the figures its own fit may use."""
    p = prior.select(*keys, F.col("games").alias("__prior"))
    joined = current.join(p, keys, "left")
    return joined.withColumn("cohort", F.when(F.col("games") >= least_games, "sufficient").when(F.col("__prior").isNotNull(), "prior").otherwise("none")).drop("__prior")
