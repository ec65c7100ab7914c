"""Sequence windows over plays and conversations, with oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playmill.operators import sequence as seq
from playmill.plans.registry import query

K, O = ["game_id"], ["play_id"]  # noqa: E741
KEPT = "k AS (SELECT * FROM plays WHERE description IS NOT NULL)"


@query("w01_sliding_context", f"WITH {KEPT} SELECT game_id, play_id, array_to_string(list(CAST(play_id AS STRING) || event_type) OVER (PARTITION BY game_id ORDER BY play_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ',') AS context FROM k", "plays")
def sliding_context(plays: DataFrame) -> DataFrame:
    """The last five plays with a description."""
    kept = plays.na.drop(subset=["description"])
    return kept.select("game_id", "play_id", F.array_join(seq.sliding(F.concat(F.col("play_id").cast("string"), "event_type"), K, O, 5), ",").alias("context"))


@query("w02_exclusive_context", f"WITH {KEPT} SELECT game_id, play_id, event_type AS label, coalesce(array_to_string(list(event_type) OVER (PARTITION BY game_id ORDER BY play_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ','), '') AS context FROM k", "plays")
def exclusive_context(plays: DataFrame) -> DataFrame:
    """The three plays before, the current one as label."""
    kept = plays.na.drop(subset=["description"])
    return kept.select("game_id", "play_id", F.col("event_type").alias("label"), F.array_join(seq.sliding(F.col("event_type"), K, O, 3, False), ",").alias("context"))


@query("w03_frame_then_drop", "SELECT game_id, play_id, len(list_filter(list(description) OVER (PARTITION BY game_id ORDER BY play_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), lambda x: x IS NOT NULL)) AS kept FROM plays", "plays")
def frame_then_drop(plays: DataFrame) -> DataFrame:
    """A frame of ten rows whose nulls are dropped afterwards."""
    return plays.select("game_id", "play_id", F.size(F.filter(seq.sliding(F.col("description"), K, O, 10), lambda x: x.isNotNull())).cast("long").alias("kept"))


@query("w04_points_added", "SELECT game_id, play_id, CASE WHEN da > 0 THEN da WHEN dh > 0 THEN dh ELSE 0 END AS points, CASE WHEN da > 0 THEN 'A' WHEN dh > 0 THEN 'H' END AS side FROM (SELECT *, away_score - lag(away_score, 1, 0) OVER w AS da, home_score - lag(home_score, 1, 0) OVER w AS dh FROM plays WINDOW w AS (PARTITION BY game_id ORDER BY play_id))", "plays")
def points_added(plays: DataFrame) -> DataFrame:
    """W4, W9, W14, F-M3: score deltas, away first."""
    points, side = seq.points_added(K, O, "away_score", "home_score")
    return plays.select("game_id", "play_id", points.alias("points"), side.alias("side"))


@query("w05_skip_first", "SELECT game_id, play_id, CASE WHEN row_number() OVER (PARTITION BY game_id ORDER BY play_id) > 10 THEN event_type ELSE '{}' END AS context FROM plays", "plays")
def skip_first(plays: DataFrame) -> DataFrame:
    """An empty object for the first ten plays of a game."""
    return seq.skip_first(plays, K, O, 10, F.col("event_type"), "context").select("game_id", "play_id", "context")


@query("w06_first_n", "SELECT game_id, string_agg(event_type, ',' ORDER BY play_id) AS label FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY play_id) AS rn FROM plays) WHERE rn <= 8 GROUP BY game_id", "plays")
def first_n(plays: DataFrame) -> DataFrame:
    """The first eight plays as one label."""
    return seq.first_n(plays, K, O, 8, F.col("event_type"), "label").withColumn("label", F.array_join("label", ","))


@query("w07_next_play", "SELECT game_id, play_id, next_id, next_type FROM (SELECT *, lead(play_id) OVER w AS next_id, lead(event_type) OVER w AS next_type FROM plays WINDOW w AS (PARTITION BY game_id ORDER BY play_id)) WHERE description IS NOT NULL", "plays")
def next_play(plays: DataFrame) -> DataFrame:
    """The raw successor of every kept play."""
    w = seq.ordered(K, O)
    nxt = plays.withColumn("n", F.lead(F.struct("play_id", "event_type")).over(w))
    return nxt.where("description is not null").select("game_id", "play_id", F.col("n.play_id").alias("next_id"), F.col("n.event_type").alias("next_type"))


@query("w08_dictionary_codes", """WITH c AS (SELECT game_id, play_id, list(player) OVER (PARTITION BY game_id ORDER BY play_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS p FROM plays),
e AS (SELECT game_id, play_id, i, p[i] AS v, list_position(p, p[i]) AS f FROM c, unnest(generate_series(1, len(p))) t(i)),
r AS (SELECT *, dense_rank() OVER (PARTITION BY game_id, play_id ORDER BY f) - 1 AS code FROM e)
SELECT game_id, play_id, string_agg(CAST(code AS STRING), ',' ORDER BY i) AS codes, max(code) + 1 AS size FROM r GROUP BY game_id, play_id""", "plays")
def dictionary_codes(plays: DataFrame) -> DataFrame:
    """W8, F-A3: codes by first appearance inside a context."""
    words, codes = seq.first_appearance_codes(F.col("p"))
    return plays.select("game_id", "play_id", seq.sliding(F.col("player"), K, O, 6).alias("p")).select("game_id", "play_id", F.array_join(F.transform(codes, lambda c: c.cast("string")), ",").alias("codes"), F.size(words).cast("long").alias("size"))


@query("w09_deltas_within", """WITH c AS (SELECT game_id, play_id, list(away_score) OVER (PARTITION BY game_id ORDER BY play_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS p FROM plays)
SELECT game_id, play_id, array_to_string(list_transform(generate_series(1, len(p)), lambda i: CAST(p[i] - CASE WHEN i = 1 THEN 0 ELSE p[i - 1] END AS STRING)), ',') AS deltas FROM c""", "plays")
def deltas_within(plays: DataFrame) -> DataFrame:
    """Deltas inside the collected window, the first against 0."""
    held = plays.select("game_id", "play_id", seq.sliding(F.col("away_score"), K, O, 4).alias("p"))
    return held.select("game_id", "play_id", F.array_join(F.transform(seq.deltas_within(F.col("p")), lambda x: x.cast("string")), ",").alias("deltas"))


@query("w10_first_scorers", "WITH d AS (SELECT *, away_score > lag(away_score, 1, 0) OVER w AS ra, home_score > lag(home_score, 1, 0) OVER w AS rh FROM plays WINDOW w AS (PARTITION BY game_id ORDER BY play_id)) SELECT game_id, coalesce(arg_min(team, play_id) FILTER (ra), 'Unknown') AS away_team, coalesce(arg_min(team, play_id) FILTER (rh), 'Unknown') AS home_team FROM d GROUP BY game_id", "plays")
def first_scorers(plays: DataFrame) -> DataFrame:
    """The first team to raise each score."""
    return seq.first_scorers(plays, K, "play_id", "team", "away_score", "home_score")


ISLANDS_SQL = """WITH b AS (SELECT *, event_type = 'view' AS s, clock[1:4] AS minute FROM plays WHERE description IS NOT NULL), l AS (SELECT *, CASE WHEN s AND lag(s) OVER w AND minute = lag(minute) OVER w THEN 0 ELSE 1 END AS nw FROM b WINDOW w AS (PARTITION BY game_id ORDER BY play_id)),
i AS (SELECT *, sum(nw) OVER (PARTITION BY game_id ORDER BY play_id) AS island FROM l)
SELECT game_id, min(play_id) AS play_id, CASE WHEN count(*) > 1 THEN 'SUBS: ' || string_agg(description, ', ' ORDER BY play_id) ELSE min(description) END AS description, CASE WHEN count(*) = 1 THEN min(player) END AS player, count(*) AS rows FROM i GROUP BY game_id, island"""


@query("w11_islands_collapse", ISLANDS_SQL, "plays")
def islands_collapse(plays: DataFrame) -> DataFrame:
    """Runs of substitutions at one clock become one row."""
    kept = plays.na.drop(subset=["description"]).withColumn("minute", F.substring("clock", 1, 4))
    return seq.collapse_runs(kept, K, "play_id", "description", "minute", "player", F.col("event_type") == "view", "SUBS").drop("minute")


@query("w13_first_valid", "SELECT game_id, arg_min(play_id, play_id) AS play_id FROM plays WHERE value > 100 GROUP BY game_id", "plays")
def first_valid(plays: DataFrame) -> DataFrame:
    """The first row of a game that is valid."""
    return plays.groupBy("game_id").agg(F.min_by("play_id", F.when(F.col("value") > 100, F.col("play_id"))).alias("play_id")).where("play_id is not null")


@query("w15_tail", "SELECT game_id, play_id FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY play_id DESC) AS rn FROM plays) WHERE rn <= 20", "plays")
def tail(plays: DataFrame) -> DataFrame:
    """The last twenty plays of a game, in their own order."""
    return seq.last_n(plays, K, [F.desc("play_id")], 20).select("game_id", "play_id")


@query("w16_last_known", "SELECT game_id, play_id, last_value(description IGNORE NULLS) OVER (PARTITION BY game_id ORDER BY play_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known FROM plays", "plays")
def last_known(plays: DataFrame) -> DataFrame:
    """The last text that is not null so far."""
    return plays.select("game_id", "play_id", F.last("description", ignorenulls=True).over(seq.ordered(K, O).rowsBetween(Window.unboundedPreceding, 0)).alias("known"))


@query("w17_run_length", "WITH l AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS nw FROM plays WINDOW w AS (PARTITION BY game_id ORDER BY play_id)), i AS (SELECT *, sum(nw) OVER (PARTITION BY game_id ORDER BY play_id) AS island FROM l) SELECT game_id, play_id, row_number() OVER (PARTITION BY game_id, island ORDER BY play_id) AS run FROM i", "plays")
def run_length(plays: DataFrame) -> DataFrame:
    """How long the current value has lasted."""
    return seq.run_length(K, O, "event_type", plays).select("game_id", "play_id", F.col("run").cast("long").alias("run"))


@query("w18_chunks", "SELECT event_id, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / ceil(count(*) OVER () / 7.0)) AS BIGINT) AS chunk FROM events", "t:events")
def chunks(events: DataFrame) -> DataFrame:
    """Contiguous chunks by a distributed row number."""
    return seq.chunk_of(events.select("event_id"), ["event_id"], 7)


@query("p08_long_games", "SELECT game_id, play_id FROM plays WHERE game_id IN (SELECT game_id FROM plays GROUP BY game_id HAVING count(*) >= 70)", "plays")
def long_games(plays: DataFrame) -> DataFrame:
    """Plays of games with enough plays."""
    enough = plays.groupBy("game_id").count().where("count >= 70")
    return plays.join(enough, "game_id", "left_semi").select("game_id", "play_id")


@query("p17_first_games", "SELECT play_id FROM plays WHERE game_id IN (SELECT DISTINCT game_id FROM plays ORDER BY game_id LIMIT 5)", "plays")
def first_games(plays: DataFrame) -> DataFrame:
    """The plays of the first few games."""
    few = plays.select("game_id").distinct().orderBy("game_id").limit(5)
    return plays.join(few, "game_id", "left_semi").select("play_id")


@query("a38_rosters_from_lineups", "SELECT game_id, team, array_to_string(list_sort(list(DISTINCT player))[1:12], ',') AS roster FROM plays GROUP BY game_id, team", "plays")
def lineups(plays: DataFrame) -> DataFrame:
    """A38, F-A4: distinct players of a side, at most twelve."""
    return plays.groupBy("game_id", "team").agg(F.array_join(F.slice(F.sort_array(F.collect_set("player")), 1, 12), ",").alias("roster"))


@query("a39_last_team", "SELECT game_id, player, arg_max(team, play_id) AS team FROM plays GROUP BY game_id, player", "plays")
def last_team(plays: DataFrame) -> DataFrame:
    """A player's team, the last write wins."""
    return plays.groupBy("game_id", "player").agg(F.max_by("team", "play_id").alias("team"))


@query("a40_team_pair", "SELECT game_id, list_sort(list(DISTINCT team))[1] AS first, list_sort(list(DISTINCT team))[2] AS second FROM plays WHERE len(team) = 3 GROUP BY game_id", "plays")
def team_pair(plays: DataFrame) -> DataFrame:
    """The two team codes of a game in order."""
    pair = F.sort_array(F.collect_set("team"))
    return plays.where(F.length("team") == 3).groupBy("game_id").agg(pair.alias("t")).select("game_id", F.get("t", F.lit(0)).alias("first"), F.get("t", F.lit(1)).alias("second"))


@query("a41_scoring_runs", "WITH d AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 1 + play_id % 3 ELSE 0 END AS pts FROM plays) SELECT game_id, CAST(sum(pts) AS BIGINT) AS total, round(avg(pts), 4) AS mean, CASE WHEN sum(pts) FILTER (team = 'AWY') >= sum(pts) FILTER (team = 'HOM') THEN 'AWY' ELSE 'HOM' END AS hottest FROM d GROUP BY game_id", "plays")
def scoring_runs(plays: DataFrame) -> DataFrame:
    """Points in all, on average, and the team with most."""
    pts = F.when(F.col("event_type") == "purchase", F.col("play_id") % 3 + 1).otherwise(0)
    per = plays.groupBy("game_id", "team").agg(F.sum(pts).alias("pts"), F.count(F.lit(1)).alias("n"))
    top = F.min_by("team", F.struct(-F.col("pts"), F.col("team")))
    return per.groupBy("game_id").agg(F.sum("pts").alias("total"), F.round(F.sum("pts") / F.sum("n"), 4).alias("mean"), top.alias("hottest"))


@query("w07_next_turn", "SELECT conv_id, turn, role, lead(role) OVER w AS next_role, length(lead(text) OVER w) AS next_chars FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)", "turns")
def next_turn(turns: DataFrame) -> DataFrame:
    """W7, F-A10: each turn with the turn that answers it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns.select("conv_id", "turn", "role", F.lead("role").over(w).alias("next_role"), F.length(F.lead("text").over(w)).alias("next_chars"))


@query("j13_play_lookup", "SELECT e.event_id, coalesce(p.description, 'no play') AS description FROM events e LEFT JOIN plays p ON e.event_id + 1 = p.play_id AND e.user_id = p.game_id", "t:events", "plays")
def play_lookup(events: DataFrame, plays: DataFrame) -> DataFrame:
    """Lookup by a two-part key with a default play."""
    p = plays.select("game_id", "play_id", "description")
    return events.join(p, (F.col("event_id") + 1 == F.col("play_id")) & (F.col("user_id") == F.col("game_id")), "left").select("event_id", F.coalesce("description", F.lit("no play")).alias("description"))
