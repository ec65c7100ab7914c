"""Scalar rules over plays and runs, with oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playmill.functions import clock, maths, nested, text
from playmill.plans.registry import query


@query("fs01_without_parentheses", r"SELECT play_id, trim(regexp_replace(regexp_replace(description, '\([^)]*\)', '', 'g'), '\s+', ' ', 'g')) AS clean FROM plays", "plays")
def clean(plays: DataFrame) -> DataFrame:
    """F-S1, F-S10: parentheses and white space."""
    return plays.select("play_id", text.without_parentheses(F.col("description")).alias("clean"))


@query("fs02_distance", r"SELECT play_id, nullif(regexp_extract(description, '(\d+)''', 1), '') AS feet FROM plays", "plays")
def feet(plays: DataFrame) -> DataFrame:
    """F-S2: distance in a description."""
    return plays.select("play_id", text.distance(F.col("description")).alias("feet"))


@query("fs05_score_text", "SELECT play_id, 'AWY ' || away_score || ' - HOM ' || home_score AS score FROM plays", "plays")
def score(plays: DataFrame) -> DataFrame:
    """F-S5: score text."""
    return plays.select("play_id", text.score_text(F.col("away_score"), F.col("home_score"), F.lit("AWY"), F.lit("HOM")).alias("score"))


@query("fs06_structured_events", """SELECT play_id, CASE WHEN shot AND kind LIKE '%3pt%' THEN CASE WHEN made OR pts = 3 THEN '3pm' ELSE '3pa' END || sfx WHEN shot AND kind LIKE '%layup%' THEN CASE WHEN made OR pts = 2 THEN 'layup' ELSE 'layupa' END || sfx
 WHEN shot AND kind LIKE '%dunk%' THEN CASE WHEN made OR pts = 2 THEN 'dunk' ELSE 'dunka' END || sfx WHEN shot AND (kind LIKE '%jump shot%') THEN CASE WHEN made OR pts = 2 THEN '2pm' ELSE '2pa' END || sfx
 WHEN shot AND pts = 3 THEN '3pm' || sfx WHEN shot AND pts = 2 THEN '2pm' || sfx WHEN shot AND pts = 1 THEN 'ftm' WHEN shot THEN CASE WHEN d >= 23 THEN '3pa' ELSE '2pa' END || sfx
 WHEN kind LIKE '%free throw%' THEN CASE WHEN made OR pts = 1 THEN 'ftm' ELSE 'ftx' END WHEN kind LIKE '%rebound%' THEN CASE WHEN kind LIKE '%offensive%' THEN 'o_reb' ELSE 'd_reb' END
 WHEN kind LIKE '%foul%' THEN CASE WHEN kind LIKE '%offensive%' THEN 'o_foul' WHEN kind LIKE '%shooting%' THEN 's_foul' ELSE 'p_foul' END WHEN kind LIKE '%timeout%' THEN 'timeout' WHEN pts = 1 THEN 'ftm' WHEN pts = 2 THEN '2pm' || sfx WHEN pts = 3 THEN '3pm' || sfx ELSE 'unknown' END AS code
FROM (SELECT event_id AS play_id, event_id % 4 AS pts, event_id % 35 AS d, CASE WHEN event_id % 35 > 0 THEN CAST(event_id % 35 AS STRING) ELSE '' END AS sfx, event_id % 2 = 0 AS made, (event_type = 'click' OR k LIKE '%shot%' OR k LIKE '%layup%' OR k LIKE '%dunk%') AS shot, k AS kind
 FROM (SELECT *, ['3pt jump shot', 'driving layup', 'dunk', 'jump shot', 'free throw 1 of 2', 'offensive rebound', 'offensive foul', 'shooting foul', 'timeout', 'hm'][event_id % 10 + 1] AS k FROM events))""", "t:events")
def structured(events: DataFrame) -> DataFrame:
    """F-S6: event codes of structured plays."""
    kinds = F.array(*[F.lit(k) for k in ("3pt jump shot", "driving layup", "dunk", "jump shot", "free throw 1 of 2", "offensive rebound", "offensive foul", "shooting foul", "timeout", "hm")])
    i = F.col("event_id")
    code = text.structured_event(F.get(kinds, (i % 10).cast("int")), F.when(i % 2 == 0, "made").otherwise("missed"), F.when(F.col("event_type") == "click", "shot").otherwise(""), (i % 4).cast("int"), (i % 35).cast("double"), F.lit(None).cast("string"))
    return events.select(i.alias("play_id"), code["code"].alias("code"))


@query("fs07_described_events", r"""SELECT play_id, CASE WHEN d IS NULL THEN 'unknown' WHEN d LIKE '%3PT%' THEN CASE WHEN d LIKE '%MISS%' THEN '3pa' ELSE '3pm' END || f WHEN d LIKE '%LAYUP%' THEN CASE WHEN d LIKE '%MISS%' THEN 'layupa' ELSE 'layup' END || f
 WHEN d LIKE '%FREE THROW%' THEN CASE WHEN d LIKE '%MISS%' OR pts = 0 THEN 'ftx' ELSE 'ftm' END WHEN d LIKE '%TURNOVER%' THEN 'tov' ELSE 'unknown' END AS code,
 CASE WHEN d LIKE '%3PT%' AND d NOT LIKE '%MISS%' THEN CASE WHEN pts > 0 THEN pts ELSE 3 END WHEN d LIKE '%3PT%' OR d LIKE '%LAYUP%' THEN NULL WHEN d LIKE '%FREE THROW%' AND pts > 0 THEN 1 END AS points
FROM (SELECT play_id, upper(description) AS d, coalesce(nullif(regexp_extract(description, '(\d+)''', 1), ''), '') AS f, play_id % 3 AS pts FROM plays)""", "plays")
def described(plays: DataFrame) -> DataFrame:
    """F-S7: event codes of described plays."""
    code = text.described_event(F.col("description"), F.lit(None).cast("int"), (F.col("play_id") % 3).cast("int"))
    return plays.select("play_id", code["code"].alias("code"), code["points"].alias("points"))


@query("fs11_normalized", r"SELECT run_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(final_score || ' at 01:23 of ' || run_id), '\d{1,2}:\d{2}', 'TIME', 'g'), '[A-Z]{2,4} \d+ - [A-Z]{2,4} \d+', 'SCORE', 'g'), '\d+', 'NUM', 'g'), '\s+', ' ', 'g')) AS t FROM runs", "runs")
def normalized(runs: DataFrame) -> DataFrame:
    """F-S11: normalised text."""
    return runs.select("run_id", text.normalized(F.concat(F.col("final_score"), F.lit(" at 01:23 of "), F.col("run_id"))).alias("t"))


@query("u06_word_overlap", r"SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS overlap FROM (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)), '\s+'), lambda w: w <> '')) AS b FROM turns) WHERE b IS NOT NULL", "turns")
def overlap(turns: DataFrame) -> DataFrame:
    """Word overlap of neighbouring turns."""
    from pyspark.sql import Window

    nxt = turns.withColumn("n", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("n is not null")
    return nxt.select("conv_id", "turn", F.round(text.word_overlap(F.col("text"), F.col("n")), 6).alias("overlap"))


@query("fd01_clocks", "SELECT play_id, secs, CASE WHEN period <= 4 THEN secs + (4 - period) * 720 ELSE secs END AS game_secs, clock[3:7] AS short, CASE WHEN period <= 4 THEN 'Q' || period ELSE 'OT' END AS name, TRUE AS valid, secs < 5 AS low FROM (SELECT *, CAST(719 - (play_id * 7) % 720 AS INT) AS secs FROM plays)", "plays")
def clocks(plays: DataFrame) -> DataFrame:
    """F-D1 to F-D5, F-D10, F-D11: clock arithmetic and names."""
    secs, short = clock.clock_seconds(F.col("clock")), clock.short_clock(F.col("clock"))
    return plays.select("play_id", secs.alias("secs"), clock.game_seconds_left(F.col("period"), F.col("clock")).alias("game_secs"), short.alias("short"), clock.period_name(F.col("period")).alias("name"), clock.valid_clock(short).alias("valid"), (secs < 5).alias("low"))


@query("fd09_mixed_dates", "SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day FROM orders", "t:orders")
def mixed_dates(orders: DataFrame) -> DataFrame:
    """F-D9: two date formats in one column."""
    written = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "M/d/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return orders.select(F.col("o_orderkey").alias("k"), clock.mixed_date(written).alias("day"))


@query("fm04_half_court", "SELECT play_id, CASE WHEN ok THEN round(fx, 1) END AS x, CASE WHEN ok THEN round(fy, 1) END AS y FROM (SELECT *, fx BETWEEN 0 AND 50 AND fy BETWEEN 0 AND 47 AS ok FROM (SELECT play_id, CASE WHEN y > 47 THEN 50 - x ELSE x END AS fx, CASE WHEN y > 47 THEN y - 47 ELSE y END AS fy FROM plays))", "plays")
def half_court(plays: DataFrame) -> DataFrame:
    """F-M4: shots mirrored onto one half."""
    return plays.select("play_id", maths.half_court(F.col("x"), F.col("y")).alias("p")).select("play_id", "p.x", "p.y")


@query("fm09_score_state", "SELECT play_id, CASE WHEN away_score > home_score THEN 'AWY' WHEN home_score > away_score THEN 'HOM' ELSE 'TIE' END AS leader, abs(away_score - home_score) AS margin, CASE play_id % 6 WHEN 1 THEN 'Free Throw' WHEN 2 THEN '2-Point Field Goal' WHEN 3 THEN '3-Point Field Goal' WHEN 4 THEN 'Multiple Scoring Plays' WHEN 5 THEN 'Multiple Scoring Plays' ELSE 'No Score' END AS kind, round(coalesce(away_score / nullif(play_id % 7, 0), 0), 4) AS efficiency FROM plays", "plays")
def score_state(plays: DataFrame) -> DataFrame:
    """F-M9: leader, margin, class and efficiency."""
    a, h, i = F.col("away_score"), F.col("home_score"), F.col("play_id")
    return plays.select("play_id", maths.leader(a, h, F.lit("AWY"), F.lit("HOM")).alias("leader"), F.abs(a - h).alias("margin"), maths.scoring_class(i % 6).alias("kind"), F.round(maths.ratio(a, i % 7), 4).alias("efficiency"))


@query("fm10_pseudo_scores", "SELECT p_partkey AS k, round(-2.0 + ((CAST('0x' || substring(md5(p_name), 1, 8) AS BIGINT) >> 4) % 1000) / 999.0 * 4.0, 6) AS score, CAST(round_even(p_retailprice * 100, 0) AS INT) AS cents FROM part", "t:part")
def pseudo(part: DataFrame) -> DataFrame:
    """F-M10, F-M11: repeatable numbers from names, and hundredths."""
    return part.select(F.col("p_partkey").alias("k"), F.round(maths.pseudo_score(F.col("p_name"), 4, -2.0, 2.0), 6).alias("score"), maths.hundredths(F.col("p_retailprice")).alias("cents"))


@query("fm12_backoff", "SELECT n_nationkey AS k, least(30.0, 0.5 * pow(2.0, n_nationkey)) AS wait FROM nation", "t:nation")
def backoff(nation: DataFrame) -> DataFrame:
    """F-M12: exponential wait."""
    return nation.select(F.col("n_nationkey").alias("k"), maths.backoff(F.col("n_nationkey"), 0.5, 30.0).alias("wait"))


TUPLE_SQL = """SELECT play_id, '[' || period || ',' || (719 - (play_id * 7) % 720) || ',[' || away_score || ',' || home_score || '],["' || CASE team WHEN 'AWY' THEN 'A' ELSE 'H' END || '",' || play_id % 10 || '],"' || event_type || '",' || CASE WHEN play_id % 4 > 0 THEN (play_id % 4) || ',' ELSE '' END || play_id % 6 || ']' AS t FROM plays"""


def _tuples(plays: DataFrame) -> DataFrame:
    i = F.col("play_id")
    play = F.struct(F.col("period").alias("q"), clock.clock_seconds(F.col("clock")).alias("t"), F.col("away_score").alias("a"), F.col("home_score").alias("h"), F.when(F.col("team") == "AWY", "A").otherwise("H").alias("side"), (i % 10).cast("int").alias("idx"), F.col("event_type").alias("ev"), (i % 4).cast("int").alias("pts"), (i % 6).cast("int").alias("lineup"))
    return plays.select("play_id", "game_id", play.alias("p"))


@query("fa08_tuples", TUPLE_SQL, "plays")
def tuples(plays: DataFrame) -> DataFrame:
    """F-A1, F-A8: plays as tuple texts of six or seven elements."""
    return _tuples(plays).select("play_id", nested.tuple_text(F.col("p")).alias("t"))


@query("fa12_parsed_tuples", "SELECT play_id, period AS q, away_score AS a, home_score AS h, CASE team WHEN 'AWY' THEN 'A' ELSE 'H' END AS side, event_type AS ev, CASE WHEN play_id % 4 > 0 THEN play_id % 4 END AS pts, play_id % 6 AS lineup FROM plays", "plays")
def parsed(plays: DataFrame) -> DataFrame:
    """F-A2, F-A12: tuple texts read back."""
    return _tuples(plays).select("play_id", nested.tuple_fields(nested.tuple_text(F.col("p"))).alias("r")).select("play_id", "r.q", "r.a", "r.h", "r.side", "r.ev", "r.pts", "r.lineup")


@query("fa05_actors", "SELECT play_id, CASE WHEN play_id % 10 IN (0, 2, 4) THEN 'A' WHEN play_id % 10 IN (1, 3) THEN 'H' WHEN team = 'AWY' THEN 'A' ELSE 'H' END AS side, CASE play_id % 10 WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 2 WHEN 1 THEN 0 WHEN 3 THEN 1 ELSE -1 END AS place FROM plays", "plays")
def actors(plays: DataFrame) -> DataFrame:
    """F-A5, J15: actors by roster, then team."""
    words = lambda *n: F.array(*[F.lit(x) for x in n])
    who = nested.actor(F.col("player"), F.col("team"), words("P0", "P2", "P4"), words("P1", "P3"), F.lit("AWY"), F.lit("HOM"))
    return plays.select("play_id", who.alias("w")).select("play_id", "w.side", F.col("w.index").alias("place"))


@query("fa14_capped_append", "SELECT n_nationkey AS k, array_to_string(list_slice(list_append(generate_series(1, n_nationkey), 99), greatest(n_nationkey + 1 - 19, 1), n_nationkey + 1), ',') AS kept FROM nation", "t:nation")
def capped(nation: DataFrame) -> DataFrame:
    """F-A14: append with a cap of twenty."""
    n = F.col("n_nationkey")
    items = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return nation.select(n.alias("k"), F.array_join(F.transform(nested.capped_append(items, F.lit(99)), lambda x: x.cast("string")), ",").alias("kept"))


@query("fa11_compact_format", "SELECT event_id, event_id % 3 = 0 AS compact FROM events", "t:events")
def compact(events: DataFrame) -> DataFrame:
    """F-A11: which texts are compact records."""
    i = F.col("event_id") % 3
    record = F.when(i == 0, F.lit('{"A":"X","p":[]}')).when(i == 1, F.lit('{"A":"X","recent_plays":[]}')).otherwise(F.lit('{"k":1}'))
    return events.select("event_id", nested.is_compact(record).alias("compact"))


@query("fa10_chat_pairs", """SELECT conv_id, turn, '{"messages":[{"role":"user","content":"' || length(text) || '"},{"role":"assistant","content":"' || length(n) || '"}]}' AS pair FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM turns) WHERE n IS NOT NULL""", "turns")
def chat_pairs(turns: DataFrame) -> DataFrame:
    """F-A9, F-A10, K4: question and answer as one JSON line."""
    from pyspark.sql import Window

    nxt = turns.withColumn("n", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("n is not null")
    return nxt.select("conv_id", "turn", nested.chat_pair(F.length("text").cast("string"), F.length("n").cast("string")).alias("pair"))


@query("fa16_nested_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events", "t:events")
def nested_json(events: DataFrame) -> DataFrame:
    """F-A16, S8: a field of JSON text."""
    return events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("u09_repeated_elements", "SELECT conv_id, turn, len(w) <> len(list_distinct(w)) AS repeated FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM turns)", "turns")
def repeated(turns: DataFrame) -> DataFrame:
    """Arrays with a repeated element."""
    w = F.split("text", " ")
    return turns.select("conv_id", "turn", (F.size(w) != F.size(F.array_distinct(w))).alias("repeated"))
