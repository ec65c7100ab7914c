"""Data-quality rules, with oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playmill.functions import clock
from playmill.operators import checks
from playmill.plans.registry import query

LINES = """CASE event_id % 6 WHEN 0 THEN '{"messages":[{"role":"user","content":"{}"},{"role":"assistant","content":"{}"}]}' WHEN 1 THEN '{"messages":[{"role":"user","content":"{}"}]}' WHEN 2 THEN '{"messages":[{"role":"system","content":"{}"},{"role":"assistant","content":"{}"}]}'
 WHEN 3 THEN 'not json' WHEN 4 THEN '{"other":1}' ELSE '{"messages":[{"role":"user","content":"x y"},{"role":"assistant","content":"{}"}]}' END"""


@query("v01_chat_lines", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'count' WHEN 2 THEN 'role' WHEN 3 THEN 'json' WHEN 4 THEN 'messages' ELSE 'content' END AS errors FROM events", "t:events")
def chat_lines(events: DataFrame) -> DataFrame:
    """V1, V2, V6: chat-format lines by rule."""
    return events.select("event_id", F.expr(LINES).alias("line")).select("event_id", F.array_join(checks.chat_errors(F.col("line")), ",").alias("errors"))


@query("a43_error_report", "SELECT CASE event_id % 6 WHEN 0 THEN 'valid' WHEN 1 THEN 'count' WHEN 2 THEN 'role' WHEN 3 THEN 'json' WHEN 4 THEN 'messages' ELSE 'content' END AS category, count(*) AS n FROM events GROUP BY 1", "t:events")
def error_report(events: DataFrame) -> DataFrame:
    """Errors by category."""
    return checks.report(events.select(checks.chat_errors(F.expr(LINES)).alias("errors")))


@query("v03_time_consistency", "SELECT play_id, CASE WHEN period = np AND nt > t THEN 'error' WHEN period = np AND nt = t THEN 'warning' END AS verdict FROM (SELECT play_id, period, 719 - (play_id * 7) % 720 AS t, lead(period) OVER w AS np, lead(719 - (play_id * 7) % 720) OVER w AS nt FROM plays WINDOW w AS (PARTITION BY game_id ORDER BY play_id)) WHERE np IS NOT NULL", "plays")
def time_consistency(plays: DataFrame) -> DataFrame:
    """V3: the clock against the next play."""
    w = Window.partitionBy("game_id").orderBy("play_id")
    t = plays.withColumn("t", clock.clock_seconds(F.col("clock")))
    nxt = t.withColumn("np", F.lead("period").over(w)).withColumn("nt", F.lead("t").over(w)).where("np is not null")
    return nxt.select("play_id", checks.time_rule(F.col("period"), F.col("t"), F.col("np"), F.col("nt")).alias("verdict"))


#: Plays with words of all kinds put behind their own, one kind a play.
WORDS = ("rebound", "sub", "miss", "turnover", "foul", "timeout", "violation", "ejection", "technical", "flagrant", "jump ball", "steal", "block", "end of", "makes", "assist")


@query("v04_scoring_consistency", "WITH w AS (SELECT play_id, upper(CASE WHEN play_id % 3 = 0 THEN description ELSE 'P1 ' || ['" + "', '".join(WORDS) + "'][1 + play_id % 16] END) AS d FROM plays) SELECT play_id FROM w WHERE play_id % 4 > 0 AND (" + " OR ".join(f"contains(d, '{w.upper()}')" for w in WORDS[:11]) + ")", "plays")
def scoring_consistency(plays: DataFrame) -> DataFrame:
    """Points on plays that cannot score."""
    word = F.element_at(F.array(*map(F.lit, WORDS)), (F.lit(1) + F.col("play_id") % len(WORDS)).cast("int"))
    said = F.when(F.col("play_id") % 3 == 0, F.col("description")).otherwise(F.concat(F.lit("P1 "), word))
    return plays.where(checks.scoring_rule(said, F.col("play_id") % 4)).select("play_id")


@query("v05_json_validity", "SELECT event_id, json_valid(CASE WHEN event_id % 4 = 0 THEN substring(props, 2) ELSE props END) AS valid FROM events", "t:events")
def json_validity(events: DataFrame) -> DataFrame:
    """V5: line-level JSON validity, every line."""
    line = F.when(F.col("event_id") % 4 == 0, F.expr("substring(props, 2)")).otherwise(F.col("props"))
    return events.select("event_id", checks.is_json(line).alias("valid"))


@query("v07_alignment", "SELECT play_id FROM (SELECT play_id, abs(away_score - home_score) AS d FROM plays) WHERE d > 10", "plays")
def alignment(plays: DataFrame) -> DataFrame:
    """Score differences above ten, over all rows."""
    return plays.where(F.abs(F.col("away_score") - F.col("home_score")) > 10).select("play_id")


@query("v08_responses", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'description' WHEN 2 THEN 'time' WHEN 3 THEN 'points' ELSE 'next_play' END AS errors FROM events", "t:events")
def responses(events: DataFrame) -> DataFrame:
    """V8, V9: verbose responses by rule."""
    line = F.expr("""CASE event_id % 5 WHEN 0 THEN '{"next_play":{"description":"a","quarter":1,"time_remaining":"11:20"}}' WHEN 1 THEN '{"next_play":{"description":" ","quarter":1,"time_remaining":"11:20"}}'
      WHEN 2 THEN '{"next_play":{"description":"a","quarter":1,"time_remaining":"soon"}}' WHEN 3 THEN '{"next_play":{"description":"a","quarter":2,"time_remaining":"1:20","shot_details":{"points":7}}}' ELSE '{"x":1}' END""")
    return events.select("event_id", F.array_join(checks.response_errors(line), ",").alias("errors"))


@query("v11_season_report", "SELECT o_orderstatus AS season, count(*) AS games, count(*) FILTER (o_orderpriority <> '1-URGENT') AS mismatched FROM orders GROUP BY 1", "t:orders")
def season_report(orders: DataFrame) -> DataFrame:
    """Games and mismatches by derived season."""
    return orders.groupBy(F.col("o_orderstatus").alias("season")).agg(F.count(F.lit(1)).alias("games"), F.count_if(F.col("o_orderpriority") != "1-URGENT").alias("mismatched"))


@query("a45_completeness", "SELECT user_id, CASE WHEN n / 70.0 >= 0.99 THEN 'complete' WHEN n / 70.0 >= 0.95 THEN 'nearly complete' WHEN n > 0 THEN 'partial' ELSE 'missing' END AS verdict FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)", "t:events")
def completeness(events: DataFrame) -> DataFrame:
    """A verdict by the share found."""
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", checks.completeness(F.lit(70), F.col("n")).alias("verdict"))


@query("a44_rosters", """WITH r AS (SELECT user_id, event_type AS team, count(DISTINCT event_id % 37) AS n FROM events GROUP BY ALL)
SELECT user_id, count(*) AS team_count, CAST(sum(n) AS BIGINT) AS total_players, string_agg(CASE WHEN n < 5 THEN 'Team ' || team || ' has only ' || n || ' players (expected 5+)' WHEN n > 15 THEN 'Team ' || team || ' has ' || n || ' players (unusually high)' END, '; ' ORDER BY team) AS warnings
FROM r GROUP BY user_id""", "t:events")
def rosters(events: DataFrame) -> DataFrame:
    """The rosters of each game held against their usual sizes."""
    players = events.select("user_id", F.col("event_type").alias("team"), F.concat(F.lit("P"), F.expr("event_id % 37")).alias("player")).distinct()
    teams = players.groupBy("user_id", "team").agg(F.collect_list("player").alias("players"))
    games = teams.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("team", "players"))).alias("teams"))
    found = games.select("user_id", checks.roster(F.col("teams")).alias("r"))
    return found.select("user_id", "r.team_count", F.col("r.total_players").cast("long").alias("total_players"), F.when(F.size("r.warnings") > 0, F.array_join("r.warnings", "; ")).alias("warnings"))
