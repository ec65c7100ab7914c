"""Feature building: as-of totals, ratios, medians, fallback, game pivots and profiles, with oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playmill.functions import clock, text
from playmill.operators import asof, joins, names, running
from playmill.plans.registry import query

SUMS = ["mins", "fg", "fga", "p3", "p3a", "ft", "fta", "orb", "drb", "trb", "ast", "pf", "stl", "tov", "blk", "pts"]
SUMS_SQL = ", ".join(f"sum({c}) AS {c}" for c in SUMS)
#: Each ratio as numerator and base, 0 where the base is 0.
RATIOS = {
    "mpg": ("mins", "games"), "p3_pct": ("p3", "p3a"), "ft_pct": ("ft", "fta"), "efg": ("(fg + p3 * 0.5)", "fga"), "ts": ("pts", "(2 * (fga + fta * 0.44))"), "p3r": ("p3a", "fga"),
    "ftr": ("fta", "(fga + fta)"), "pfft": ("ft", "pts"), "ppg": ("pts", "games"), "rpg": ("(orb + drb)", "games"), "drpg": ("drb", "games"), "orpg": ("orb", "games"), "apg": ("ast", "games"),
    "spg": ("stl", "games"), "bpg": ("blk", "games"), "bpm": ("blk", "mins"), "spm": ("stl", "mins"), "tpg": ("tov", "games"), "fpg": ("pf", "games"), "fpm": ("pf", "mins"),
}
RATIO_SQL = "round(fg - p3, 3) AS p2, " + ", ".join(f"round(coalesce({a} / nullif({b}, 0), 0), 3) AS {name}" for name, (a, b) in RATIOS.items())


def component_sql(rows: str, group: str, name: str, features: list[str]) -> str:
    """The profile score in SQL: a matrix squared over and over turns into its first component."""
    k = len(features)
    every = lambda f: "[" + ", ".join(f(c) for c in features) + "]"
    products = "[" + ", ".join(f"covar_pop({a}, {b})" for a in features for b in features) + "]"
    trace = " + ".join(f"m[{i * k + i + 1}]" for i in range(k))
    diagonal = "[" + ", ".join(f"m[{i * k + i + 1}]" for i in range(k)) + "]"
    return f"""WITH RECURSIVE f AS ({rows}), g AS (SELECT {group}, count(*) AS n, {every(lambda c: f'avg({c})')} AS mean, {every(lambda c: f'CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END')} AS scale, {products} AS c FROM f GROUP BY {group}),
p({group}, step, m) AS (SELECT {group}, 0, list_transform(range({k * k}), lambda x: c[x + 1] / (scale[x // {k} + 1] * scale[x % {k} + 1])) FROM g
 UNION ALL SELECT {group}, step + 1, list_transform(range({k * k}), lambda x: list_sum(list_transform(range({k}), lambda y: m[(x // {k}) * {k} + y + 1] * m[y * {k} + x % {k} + 1])) / (({trace}) * ({trace}))) FROM p WHERE step < 40),
v AS (SELECT {group}, list_transform(range({k}), lambda x: m[x * {k} + place]) AS v FROM (SELECT {group}, m, list_position({diagonal}, list_max({diagonal})) AS place FROM p WHERE step = 40)),
u AS (SELECT {group}, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM v)
SELECT {group}, {name}, round(CASE WHEN n < 5 THEN 0 ELSE {' + '.join(f'({c} - mean[{i}]) / scale[{i}] * u[{i}]' for i, c in enumerate(features, 1))} END, 4) AS score FROM f JOIN g USING ({group}) JOIN u USING ({group})"""


PROFILE_ROWS = f"SELECT season, player, {RATIO_SQL} FROM (SELECT season, player, {SUMS_SQL}, count(*) AS games FROM box GROUP BY season, player)"
COHORT_ROWS = f"""SELECT CASE WHEN t.games >= 70 THEN 'sufficient' WHEN b.player IS NOT NULL THEN 'prior' ELSE 'none' END AS cohort, t.* FROM (SELECT player, games, {RATIO_SQL} FROM (SELECT player, {SUMS_SQL}, count(*) AS games FROM box WHERE season = 2001 GROUP BY player)) t
 LEFT JOIN (SELECT DISTINCT player FROM box WHERE season = 2000) b USING (player)"""


@query("a01_season_totals", f"SELECT player, season, {SUMS_SQL}, round(avg(usage_rate), 4) AS usage_rate, count(*) AS games FROM box GROUP BY player, season", "box")
def season_totals(box: DataFrame) -> DataFrame:
    """A1: season totals per player."""
    return asof.totals(box, ["player", "season"], SUMS, ["usage_rate"]).withColumn("usage_rate", F.round("usage_rate", 4))


@query("a02_ratios", f"SELECT player, season, {RATIO_SQL} FROM (SELECT player, season, {SUMS_SQL}, count(*) AS games FROM box GROUP BY player, season)", "box")
def season_ratios(box: DataFrame) -> DataFrame:
    """A2, F-M1, F-M2: guarded ratios of the totals."""
    return asof.ratios(asof.totals(box, ["player", "season"], SUMS)).drop(*SUMS, "games")


@query("j06_running_totals", "SELECT player, season, day, CAST(coalesce(sum(pts) OVER w, 0) AS DOUBLE) AS pts, CAST(coalesce(sum(games) OVER w, 0) AS BIGINT) AS games FROM (SELECT player, season, day, sum(pts) AS pts, count(*) AS games FROM box GROUP BY ALL) WINDOW w AS (PARTITION BY player, season ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "box")
def running_totals(box: DataFrame) -> DataFrame:
    """Totals strictly before each day played."""
    return asof.running_before(box, ["player", "season"], "day", ["pts"])


@query("a03_asof_totals", "WITH asked AS (SELECT DISTINCT player, season, make_date(season, m, 15) AS day FROM (SELECT DISTINCT player, season FROM box), (VALUES (3), (6), (9), (12)) t(m)) SELECT a.player, a.season, a.day, CAST(coalesce(sum(b.pts), 0) AS DOUBLE) AS pts, count(b.pts) AS games FROM asked a LEFT JOIN box b ON a.player = b.player AND a.season = b.season AND b.day < a.day GROUP BY ALL", "box")
def asof_totals(box: DataFrame) -> DataFrame:
    """Totals of all entities at target dates, by a union and one window."""
    asked = box.select("player", "season").distinct().withColumn("m", F.explode(F.array(*[F.lit(m) for m in (3, 6, 9, 12)])))
    return asof.as_of(box, asked.select("player", "season", F.make_date("season", "m", F.lit(15)).alias("day")), ["player", "season"], "day", ["pts"])


@query("a04_asof_medians", "WITH asked AS (SELECT DISTINCT player, make_date(season, 7, 1) AS d FROM box WHERE season >= 2000) SELECT a.player, a.d AS as_of_day, round(CAST(median(pts) AS DOUBLE), 1) AS pts, round(CAST(median(mins) AS DOUBLE), 1) AS mins, count(*) AS games, max(day) AS last_day, date_diff('day', max(day), a.d) AS rest_days FROM asked a JOIN box b ON a.player = b.player AND b.day < a.d GROUP BY a.player, a.d", "box")
def asof_medians(box: DataFrame) -> DataFrame:
    """A4, F-D6: exact medians and rest days at target dates."""
    asked = box.where("season >= 2000").select("player", F.make_date("season", F.lit(7), F.lit(1)).alias("day"))
    return asof.medians_before(box.select("player", "day", "pts", "mins"), asked, "player", "day", ["pts", "mins"])


MEDIANS = ["pts", "mins", "trb", "ast", "fga"]


@query("a04_every_day", f"""SELECT DISTINCT player, day AS as_of_day, {', '.join(f'round(CAST(median({m}) OVER w AS DOUBLE), 1) AS {m}' for m in MEDIANS)}, count(*) OVER w AS games, max(day) OVER w AS last_day, date_diff('day', max(day) OVER w, day) AS rest_days
FROM box WINDOW w AS (PARTITION BY player ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) QUALIFY games > 0""", "box")
def medians_every_day(box: DataFrame) -> DataFrame:
    """A4: exact medians before every game day of every player, by one pass over each player's days."""
    found = running.running_medians(box, None, ["player"], "day", MEDIANS)
    return found.select("player", "as_of_day", *[F.round(m, 1).alias(m) for m in MEDIANS], "games", "last_day", "rest_days")


@query("j07_fallback", """WITH cur AS (SELECT player, sum(pts) / count(*) AS ppg, count(*) AS games, date_diff('day', max(day), DATE '2000-02-01') AS rest_days FROM box WHERE season = 2000 AND day < DATE '2000-02-01' GROUP BY player),
pri AS (SELECT player, sum(pts) / count(*) AS ppg, count(*) AS games FROM box WHERE season = 1999 GROUP BY player)
SELECT player, round(CASE WHEN c.games >= 8 THEN c.ppg ELSE coalesce(p.ppg, 0) END, 4) AS ppg, CASE WHEN coalesce(c.games, 0) = 0 THEN 10 ELSE c.rest_days END AS rest_days, coalesce(c.games, 0) AS original_games,
 CASE WHEN c.games >= 8 THEN 'current' WHEN p.games IS NOT NULL THEN 'prior' ELSE 'none' END AS source FROM cur c FULL JOIN pri p USING (player)""", "box")
def fallback(box: DataFrame) -> DataFrame:
    """The current season where it has enough games, else the prior one."""
    on = F.lit("2000-02-01").cast("date")
    ppg = (F.sum("pts") / F.count(F.lit(1))).alias("ppg")
    cur = box.where((F.col("season") == 2000) & (F.col("day") < on)).groupBy("player").agg(ppg, F.count(F.lit(1)).alias("games"), F.datediff(on, F.max("day")).alias("rest_days"))
    prior = box.where("season = 1999").groupBy("player").agg(ppg, F.count(F.lit(1)).alias("games"))
    return asof.with_fallback(cur, prior, ["player"], ["ppg"], 8, default_rest=10).withColumn("ppg", F.round("ppg", 4))


#: The seasons that a fallback may use.
PRIOR_SEASONS = (1992, 1994, 1995, 1997)


@query("j08_season_fallback", f"""WITH asked AS (SELECT DISTINCT player, season, make_date(season, 1, 25) AS day FROM box),
cur AS (SELECT a.player, a.season, {', '.join(f'coalesce(sum(b.{c}), 0) AS {c}' for c in SUMS)}, count(b.player) AS games FROM asked a LEFT JOIN box b ON a.player = b.player AND a.season = b.season AND b.day < a.day GROUP BY a.player, a.season),
pri AS (SELECT player, season + 1 AS season, {SUMS_SQL}, count(*) AS games FROM box WHERE season IN {PRIOR_SEASONS} GROUP BY player, season HAVING count(*) >= 5),
met AS (SELECT c.*, p.player IS NOT NULL AND c.games < 5 AS fell, {', '.join(f'p.{c} AS p_{c}' for c in [*SUMS, 'games'])} FROM cur c LEFT JOIN pri p USING (player, season)),
chosen AS (SELECT player, season, games AS original_games, CASE WHEN fell THEN season END AS fallback_from, {', '.join(f'CASE WHEN fell THEN p_{c} ELSE {c} END AS {c}' for c in [*SUMS, 'games'])} FROM met)
SELECT player, season, original_games, fallback_from, games, {RATIO_SQL} FROM chosen""", "box")
def season_fallback(box: DataFrame) -> DataFrame:
    """Every player's season so far, or the whole season before it where that is a known one, with its tags."""
    asked = box.select("player", "season").distinct().withColumn("day", F.make_date("season", F.lit(1), F.lit(25)))
    current = asof.as_of(box, asked, ["player", "season"], "day", SUMS).drop("day")
    whole = asof.totals(box.where(F.col("season").isin(*PRIOR_SEASONS)), ["player", "season"], SUMS)
    return asof.ratios(asof.season_fallback(current, whole, "player", "season", [*SUMS, "games"], least_games=5)).drop(*SUMS)


@query("a06_game_pivot", """WITH t AS (SELECT game_id, line, player, CASE venue WHEN 'A' THEN 'H' ELSE venue END AS venue, pts, CASE WHEN line % 3 = 0 THEN NULL ELSE CAST(line - 4 AS DOUBLE) END AS spread, row_number() OVER (PARTITION BY game_id ORDER BY line, player, pts) AS rn, count(*) OVER (PARTITION BY game_id) AS n FROM box),
p AS (SELECT a.game_id, a.venue AS v1, b.venue AS v2, a.player AS t1, b.player AS t2, a.pts AS p1, b.pts AS p2, (a.venue = 'R' AND b.venue = 'H') OR (a.venue = 'N' AND b.venue = 'N' AND coalesce(a.spread > 0, FALSE)) AS af FROM t a JOIN t b USING (game_id) WHERE a.n = 2 AND a.rn = 1 AND b.rn = 2)
SELECT game_id, CASE WHEN af THEN t1 ELSE t2 END AS away_team, CASE WHEN af THEN t2 ELSE t1 END AS home_team, CASE WHEN af THEN p1 ELSE p2 END AS away_score, CASE WHEN af THEN p2 ELSE p1 END AS home_score, v1 = 'N' AS neutral_site
FROM p WHERE (v1 = 'R' AND v2 = 'H') OR (v1 = 'H' AND v2 = 'R') OR (v1 = 'N' AND v2 = 'N')""", "box")
def game_pivot(box: DataFrame) -> DataFrame:
    """Games of exactly two rows as one row by the venue rules."""
    rows = box.withColumn("venue", F.when(F.col("venue") == "A", "H").otherwise(F.col("venue"))).withColumn("spread", F.when(F.col("line") % 3 != 0, (F.col("line") - 4).cast("double")))
    return asof.two_row_games(rows, "game_id", "venue", "player", "pts", "spread", ["line", "player", "pts"])


@query("v10_not_two_rows", "SELECT game_id, count(*) AS n FROM box GROUP BY game_id HAVING count(*) <> 2", "box")
def not_two(box: DataFrame) -> DataFrame:
    """Games without exactly two rows."""
    return box.groupBy("game_id").agg(F.count(F.lit(1)).alias("n")).where("n <> 2")


@query("a30_pair_profile", "WITH f AS (SELECT season, player, avg(pts) AS x, avg(trb) AS y FROM box GROUP BY season, player), m AS (SELECT season, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy, covar_pop(x, y) AS c FROM f GROUP BY season) SELECT season, player, round(((x - mx) / CASE WHEN sx > 0 THEN sx ELSE 1 END + CASE WHEN c < 0 THEN -1 ELSE 1 END * (y - my) / CASE WHEN sy > 0 THEN sy ELSE 1 END) / sqrt(2), 4) AS score FROM f JOIN m USING (season)", "box")
def pair_profile(box: DataFrame) -> DataFrame:
    """One-component profile of two features in closed form."""
    f = box.groupBy("season", "player").agg(F.avg("pts").alias("x"), F.avg("trb").alias("y"))
    return asof.pair_profile(f, ["season"], "player", "x", "y").withColumn("score", F.round("score", 4))


@query("a30_profiles", component_sql(PROFILE_ROWS, "season", "player", ["efg", "ts", "ft_pct", "ppg"]), "box")
def profiles(box: DataFrame) -> DataFrame:
    """One-component profile of four features per season."""
    f = asof.ratios(asof.totals(box, ["season", "player"], SUMS)).select("season", "player", "efg", "ts", "ft_pct", "ppg")
    return asof.profile_scores(f, ["season"], "player", ["efg", "ts", "ft_pct", "ppg"]).withColumn("score", F.round("score", 4))


@query("a31_cohort_profiles", component_sql(COHORT_ROWS, "cohort", "player", ["efg", "ts", "ppg"]), "box")
def cohort_profiles(box: DataFrame) -> DataFrame:
    """Profiles fitted apart for entities with enough games, with a prior season only, and with neither."""
    f = asof.ratios(asof.totals(box.where("season = 2001"), ["player"], SUMS))
    prior = asof.totals(box.where("season = 2000"), ["player"], SUMS)
    sorted_in = asof.cohorts(f, prior, ["player"], 70).select("cohort", "player", "efg", "ts", "ppg")
    return asof.profile_scores(sorted_in, ["cohort"], "player", ["efg", "ts", "ppg"]).withColumn("score", F.round("score", 4))


@query("a32_modal_season", "SELECT player, season FROM (SELECT player, season, row_number() OVER (PARTITION BY player ORDER BY count(*) DESC, season) AS rn FROM box GROUP BY player, season) WHERE rn = 1", "box")
def modal_season(box: DataFrame) -> DataFrame:
    """The season with most games, ties to the earliest."""
    counts = box.groupBy("player", "season").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("player").agg(F.max_by("season", F.struct("n", -F.col("season"))).alias("season"))


@query("a33_ids_by_season", "SELECT season, string_agg(CAST(player AS STRING), ',' ORDER BY player) AS players FROM (SELECT DISTINCT season, player FROM box) GROUP BY season", "box")
def ids_by_season(box: DataFrame) -> DataFrame:
    """Ids listed by season."""
    ids = F.transform(F.array_sort(F.collect_set("player")), lambda x: x.cast("string"))
    return box.groupBy("season").agg(F.array_join(ids, ",").alias("players"))


@query("a37_rosters", "SELECT game_id, string_agg(CAST(player AS STRING), ',' ORDER BY line, player, pts) AS roster FROM box GROUP BY game_id", "box")
def rosters(box: DataFrame) -> DataFrame:
    """Players of a game in row order."""
    rows = F.array_sort(F.collect_list(F.struct("line", "player", "pts")))
    return box.groupBy("game_id").agg(F.array_join(F.transform(rows, lambda r: r["player"].cast("string")), ",").alias("roster"))


@query("j04_dimension_lookup", "SELECT s_suppkey AS supplier, coalesce(t.full_name, 'unknown') AS name FROM supplier LEFT JOIN teams t ON s_nationkey = t.team_id AND t.conference <> 'ASIA'", "t:supplier", "teams")
def dimension(supplier: DataFrame, teams: DataFrame) -> DataFrame:
    """Names from a small dimension, a fallback where it has none."""
    return supplier.join(teams.where("conference <> 'ASIA'"), supplier.s_nationkey == teams.team_id, "left").select(F.col("s_suppkey").alias("supplier"), F.coalesce("full_name", F.lit("unknown")).alias("name"))


@query("j05_substring_match", "SELECT DISTINCT n.n_name AS nation, t.full_name FROM nation n JOIN teams t ON contains(t.full_name, n.n_name)", "t:nation", "teams")
def substring_match(nation: DataFrame, teams: DataFrame) -> DataFrame:
    """The names that each full name holds, met by their rarest three letters."""
    return names.contained(teams, "full_name", nation, "n_name").withColumnRenamed("n_name", "nation")


MENTIONS = """(SELECT DISTINCT CASE s_suppkey % 5 WHEN 0 THEN n_name WHEN 1 THEN n_name || ' of ' || r_name WHEN 2 THEN 'the  ' || lower(n_name) WHEN 3 THEN 'Club at ' || r_name ELSE s_name END AS mention
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
WORDS_SQL = "list_filter(string_split_regex(lower({}), '\\s+'), lambda w: w NOT IN ('the', 'of', 'and', 'in', 'at', 'to', 'for', ''))"


@query("j18_name_ladder", f"""WITH m AS (SELECT mention, coalesce(c.full_name, mention) AS f, coalesce(d.abbr, mention) AS k, {WORDS_SQL.format('mention')} AS w FROM {MENTIONS} LEFT JOIN teams c ON mention = c.abbr LEFT JOIN teams d ON mention = d.full_name)
SELECT mention, team_id, CASE WHEN mention = full_name THEN 'name' WHEN f = full_name THEN 'full' WHEN k = abbr THEN 'code' ELSE 'word' END AS rung FROM m, teams
WHERE mention = full_name OR f = full_name OR k = abbr OR len(list_intersect(w, {WORDS_SQL.format('full_name')})) > 0""", "t:supplier", "t:nation", "t:region", "teams")
def name_ladder(supplier: DataFrame, nation: DataFrame, region: DataFrame, teams: DataFrame) -> DataFrame:
    """Names as they are mentioned against teams, by the best rung that matches."""
    rows = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    which, n = F.col("s_suppkey") % 5, F.col("n_name")
    mention = F.when(which == 0, n).when(which == 1, F.concat(n, F.lit(" of "), "r_name")).when(which == 2, F.concat(F.lit("the  "), F.lower(n))).when(which == 3, F.concat(F.lit("Club at "), "r_name")).otherwise(F.col("s_name"))
    known = teams.select(F.col("abbr").alias("code"), F.col("full_name").alias("full"))
    return names.ladder(rows.select(mention.alias("mention")).distinct(), teams, "mention", "team_id", "mention", "full_name", known)


PART_NAME = "p_name || ' of ' || p_brand || ' ' || p_type"


@query("j18_similar_names", f"""WITH n AS (SELECT DISTINCT {PART_NAME} AS name FROM part), w AS (SELECT DISTINCT name, unnest({WORDS_SQL.format('name')}) AS w FROM n), s AS (SELECT name, count(*) AS n FROM w GROUP BY name),
o AS (SELECT x.name AS a, y.name AS b, count(*) AS shared FROM w x JOIN w y ON x.w = y.w AND x.name < y.name GROUP BY ALL)
SELECT a, b, CAST(shared AS INT) AS shared, CAST(p.n + q.n - shared AS INT) AS words FROM o JOIN s p ON a = p.name JOIN s q ON b = q.name WHERE shared * 100 >= (p.n + q.n - shared) * 75""", "t:part")
def similar_names(part: DataFrame) -> DataFrame:
    """Names of parts whose words overlap by three quarters, through an index of their rarest words."""
    return names.similar(part.select(F.expr(PART_NAME).alias("name")), "name", 75)


@query("j18_shared_words", f"SELECT a.team_id AS a, b.team_id AS b FROM teams a JOIN teams b ON a.team_id < b.team_id WHERE len(list_intersect({WORDS_SQL.format('a.full_name')}, {WORDS_SQL.format('b.full_name')})) > 0", "teams")
def shared_words(teams: DataFrame) -> DataFrame:
    """Names that share a word, met by that word."""
    words = teams.select("team_id", F.explode(names.significant_words(F.col("full_name"))).alias("w"))
    a, b = words.withColumnRenamed("team_id", "a"), words.withColumnRenamed("team_id", "b")
    return a.join(b, "w").where("a < b").select("a", "b").distinct()


@query("j19_rivals", "SELECT a.abbr AS team, b.abbr AS rival, a.conference = b.conference AS same_conference FROM teams a JOIN teams b ON a.division = b.division AND a.team_id <> b.team_id", "teams")
def rivals(teams: DataFrame) -> DataFrame:
    """Teams of one division."""
    a, b = teams.alias("a"), teams.alias("b")
    pairs = a.join(b, (F.col("a.division") == F.col("b.division")) & (F.col("a.team_id") != F.col("b.team_id")))
    return pairs.select(F.col("a.abbr").alias("team"), F.col("b.abbr").alias("rival"), (F.col("a.conference") == F.col("b.conference")).alias("same_conference"))


@query("j11_lookup_default", "SELECT p_partkey AS part, round(coalesce(q, 0.0), 4) AS score FROM part LEFT JOIN (SELECT l_partkey, avg(l_discount) AS q FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey", "t:part", "t:lineitem")
def lookup_default(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Feature lookup with a default."""
    q = lineitem.groupBy("l_partkey").agg(F.avg("l_discount").alias("q"))
    return part.join(q, part.p_partkey == q.l_partkey, "left").select(F.col("p_partkey").alias("part"), F.round(F.coalesce("q", F.lit(0.0)), 4).alias("score"))


@query("fd07_prior_season", "SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 <> 3 THEN CAST(1999 + n_nationkey AS STRING) || '-' || CAST(2000 + n_nationkey AS STRING) END AS prior FROM nation", "t:nation")
def prior_season(nation: DataFrame) -> DataFrame:
    """F-D7: the season before, null for what is no season."""
    k = F.col("n_nationkey")
    season = F.when(k % 4 != 3, F.format_string("%d-%d", k + 2000, k + 2001)).otherwise(F.format_string("%d-%d", k + 2000, k + 2003))
    return nation.select(k.alias("k"), clock.prior_season(season).alias("prior"))


@query("fd08_date_ranges", "SELECT n_nationkey AS k, unnest(generate_series(DATE '2024-01-01', DATE '2024-01-01' + CAST(n_nationkey AS INT), INTERVAL 3 DAY))::DATE AS day FROM nation", "t:nation")
def date_ranges(nation: DataFrame) -> DataFrame:
    """F-D8: every third day of a range."""
    first = F.lit("2024-01-01").cast("date")
    return nation.select(F.col("n_nationkey").alias("k"), F.explode(clock.every_days(first, F.date_add(first, F.col("n_nationkey").cast("int")), 3)).alias("day"))


@query("fs15_game_numbers", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE '222' END AS season_code, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE CAST(o_orderkey % 90000 AS INT) END AS number FROM orders", "t:orders")
def game_numbers(orders: DataFrame) -> DataFrame:
    """F-S15, F-S16: season code and number of 8- and 10-character ids."""
    k = F.col("o_orderkey")
    tail = F.lpad((k % 90000).cast("string"), 5, "0")
    gid = F.when(k % 3 == 0, F.concat(F.lit("00222"), tail)).when(k % 3 == 1, F.concat(F.lit("222"), tail)).otherwise(F.concat(F.lit("x"), tail))
    return orders.select(k.alias("k"), text.game_number(gid).alias("g")).select("k", "g.season_code", "g.number")
