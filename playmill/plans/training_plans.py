"""Training lines of nested contexts and their rules, with oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playmill.functions import text
from playmill.operators import training_lines as rules
from playmill.plans.registry import query

TEAMS = ["AWY", "HOM"]
SPAN = 4
#: Some plays get a quarter, a clock or points that cannot be.
FACTS = """SELECT game_id, play_id, CASE WHEN play_id % 13 = 4 THEN 12 ELSE period END AS quarter, CASE WHEN play_id % 17 = 3 THEN 'soon' ELSE substring(clock, 3, 5) END AS time_remaining,
 CAST(719 - (play_id * 7) % 720 AS INT) AS t, description, CAST(CASE WHEN play_id % 19 = 5 THEN 7 WHEN event_type = 'purchase' OR play_id % 23 = 0 THEN 1 + play_id % 3 ELSE 0 END AS INT) AS points, team, away_score, home_score FROM plays"""

#: What is wrong with play r at path p.
PLAY_SQL = """list_filter([CASE WHEN {r}.q NOT BETWEEN 1 AND 10 THEN 'warning play_validation ' || {p} || '.quarter' END, CASE WHEN {r}.t IS NULL THEN 'error play_validation ' || {p} || '.time_remaining' END,
 CASE WHEN {r}.d IS NULL THEN 'error play_structure ' || {p} || '.description' END, CASE WHEN {r}.n > 4 THEN 'warning play_validation ' || {p} || '.points_scored' END], lambda x: x IS NOT NULL)"""
CANNOT = " OR ".join(f"contains(upper(nxt.d), '{w}')" for w in ("REBOUND", "SUB", "MISS", "TURNOVER", "FOUL", "TIMEOUT", "VIOLATION", "EJECTION", "TECHNICAL", "FLAGRANT", "JUMP BALL"))
ROWS_SQL = f"""f AS (SELECT *, {{'q': quarter, 't': CASE WHEN time_remaining <> 'soon' THEN t END, 'd': description, 'n': points}} AS r FROM ({FACTS})),
w AS (SELECT game_id, play_id, list(r) OVER (PARTITION BY game_id ORDER BY play_id ROWS BETWEEN {SPAN - 1} PRECEDING AND CURRENT ROW) AS recent, lead(r) OVER (PARTITION BY game_id ORDER BY play_id) AS nxt, game_id % 10 AS g FROM f)"""


def _facts(plays: DataFrame) -> DataFrame:
    return plays.sparkSession.sql(FACTS.replace("FROM plays", "FROM {plays}"), plays=plays)


def _play() -> Column:
    """A play of the verbose layout; an unknown description is left out of its JSON."""
    team = F.when(F.col("points") > 0, F.col("team")).otherwise("")
    score = text.score_text(F.col("away_score"), F.col("home_score"), F.lit("AWY"), F.lit("HOM"))
    return F.struct("quarter", "time_remaining", "description", score.alias("score"), team.alias("scoring_team"), F.col("points").alias("points_scored"))


def _line(plays: DataFrame) -> DataFrame:
    """(game_id, play_id, line): the last plays of a game as context, the next as answer, in a chat line.

    By its number a game lacks its players, has a team nobody knows, negative rest days, or a rating in words.
    """
    g = F.col("game_id") % 10
    order = Window.partitionBy("game_id").orderBy("play_id")
    rows = _facts(plays).withColumn("play", _play())
    seen = rows.select("game_id", "play_id", F.collect_list("play").over(order.rowsBetween(1 - SPAN, 0)).alias("recent"), F.lead("play").over(order).alias("nxt")).where("nxt is not null")
    stats = F.struct(F.when(g == 3, "high").otherwise("101.5").alias("OEFF"), F.lit(99.5).alias("DEFF"), F.lit(98).alias("PACE"), F.when(g == 2, -1).otherwise(1).alias("REST_DAYS"))
    away = F.struct(F.when(g == 1, "XXX").otherwise("AWY").alias("name"), stats.alias("stats"))
    user = F.struct(away.alias("away_team"), F.struct(F.lit("HOM").alias("name")).alias("home_team"), F.when(g != 0, F.array(F.lit("P1"), F.lit("P2"))).alias("players"), F.col("recent").alias("recent_plays"))
    # a rating that is a number stands without quotation marks
    context = F.regexp_replace(F.to_json(user), '"OEFF":"([0-9.]+)"', '"OEFF":$1')
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    line = F.to_json(F.struct(F.array(message("user", context), message("assistant", F.to_json(F.struct(F.col("nxt").alias("next_play"))))).alias("messages")))
    i = F.col("play_id")
    broken = F.when(i % 29 == 1, F.substring(line, 2, 10_000_000)).when(i % 31 == 2, F.regexp_replace(line, '"role":"user"', '"role":"system"')).when(i % 37 == 3, F.lit('{"messages":[]}')).otherwise(line)
    return seen.select("game_id", "play_id", broken.alias("line"))


LINES_SQL = f"""WITH {ROWS_SQL}, e AS (SELECT game_id, play_id, CASE WHEN play_id % 29 = 1 THEN ['error json_format line'] WHEN play_id % 31 = 2 THEN ['error chat_format messages[0].role'] WHEN play_id % 37 = 3 THEN ['error chat_format messages'] ELSE list_concat(
  flatten(list_transform(range(len(recent)), lambda i: {PLAY_SQL.format(r="recent[i + 1]", p="'user.recent_plays[' || i || ']'")})), {PLAY_SQL.format(r="nxt", p="'next_play'")},
  list_filter([CASE g WHEN 0 THEN 'error user_context user.players' WHEN 1 THEN 'warning team_validation user.away_team.name' WHEN 2 THEN 'warning team_stats user.away_team.stats.REST_DAYS' WHEN 3 THEN 'warning team_stats user.away_team.stats.OEFF' END,
   CASE WHEN recent[-1].q = nxt.q AND nxt.t > recent[-1].t THEN 'error time_consistency next_play.time_remaining' WHEN recent[-1].q = nxt.q AND nxt.t = recent[-1].t THEN 'warning time_consistency next_play.time_remaining' END,
   CASE WHEN nxt.n > 0 AND ({CANNOT}) THEN 'error scoring_consistency next_play.points_scored' END], lambda x: x IS NOT NULL)) END AS found FROM w WHERE nxt IS NOT NULL)"""


@query("v01_training_lines", LINES_SQL + " SELECT game_id, play_id, array_to_string(list_sort(found), ';') AS findings FROM e", "plays")
def training_lines(plays: DataFrame) -> DataFrame:
    """V1, V2, V3, V4, V6: chat lines of whole contexts against all rules, each finding with its place."""
    return _line(plays).select("game_id", "play_id", rules.said(rules.line_findings(F.col("line"), TEAMS)).alias("findings"))


@query("a43_findings", LINES_SQL + " SELECT string_split(x, ' ')[1] AS severity, string_split(x, ' ')[2] AS category, count(*) AS n FROM (SELECT unnest(found) AS x FROM e) GROUP BY ALL", "plays")
def findings(plays: DataFrame) -> DataFrame:
    """Findings by severity and category."""
    each = _line(plays).select(F.explode(rules.line_findings(F.col("line"), TEAMS)).alias("f"))
    return each.groupBy("f.severity", "f.category").agg(F.count(F.lit(1)).alias("n"))


@query("v09_play_lists", f"""WITH {ROWS_SQL}, b AS (SELECT game_id, play_id, r, row_number() OVER (PARTITION BY game_id ORDER BY play_id) - 1 AS place FROM f),
c AS (SELECT *, place // (40 + game_id % 20) AS part, place % (40 + game_id % 20) AS i FROM b)
SELECT game_id, CAST(part AS INT) AS part, array_to_string(list_sort(list_concat(flatten(list({PLAY_SQL.format(r="r", p="'plays[' || i || ']'")})), CASE WHEN count(*) > 50 THEN ['error play_count plays'] ELSE [] END)), ';') AS findings FROM c GROUP BY game_id, part""", "plays")
def play_lists(plays: DataFrame) -> DataFrame:
    """V9: responses of one to fifty plays; games are cut into lists of 40 to 59."""
    span = 40 + F.col("game_id") % 20
    rows = _facts(plays).withColumn("place", F.row_number().over(Window.partitionBy("game_id").orderBy("play_id")) - 1).withColumn("part", F.floor(F.col("place") / span).cast("int"))
    lists = rows.groupBy("game_id", "part").agg(F.array_sort(F.collect_list(F.struct("play_id", _play().alias("play")))).alias("p"))
    response = F.to_json(F.struct(F.col("p.play").alias("plays")))
    return lists.select("game_id", "part", rules.said(rules.play_list_findings(response)).alias("findings"))


@query("fa10_chat_texts", """SELECT conv_id, turn, '{"messages":[{"role":"user","content":' || CAST(to_json(text) AS VARCHAR) || '},{"role":"assistant","content":' || CAST(to_json(n) AS VARCHAR) || '}]}' AS pair FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM turns) WHERE n IS NOT NULL AND text IS NOT NULL""", "turns")
def chat_texts(turns: DataFrame) -> DataFrame:
    """F-A9, F-A10: each text and the one after it as a chat line, whole."""
    rows = turns.withColumn("n", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("n is not null and text is not null")
    message = lambda role, content: F.struct(F.lit(role).alias("role"), F.col(content).alias("content"))
    return rows.select("conv_id", "turn", F.to_json(F.struct(F.array(message("user", "text"), message("assistant", "n")).alias("messages"))).alias("pair"))
