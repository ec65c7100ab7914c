"""Record repair, sentences, player objects and shapes of aggregates, with oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playmill import facade
from playmill.functions import nested, text
from playmill.operators import checks, runs as ops, sequence
from playmill.plans.registry import query


@query("fs04_team_scores", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 < 5 THEN 'AWY' END AS first_team, CASE WHEN o_orderkey % 6 < 5 THEN a END AS first_score, CASE WHEN o_orderkey % 6 < 5 THEN 'HOM' END AS second_team, CASE WHEN o_orderkey % 6 < 5 THEN h END AS second_score FROM (SELECT o_orderkey, 80 + o_orderkey * 7 % 100 AS a, 82 + o_orderkey * 13 % 96 AS h FROM orders)", "t:orders")
def team_scores(orders: DataFrame) -> DataFrame:
    """F-S4, X3: score texts of five layouts and one that is none, as four columns."""
    k = F.col("o_orderkey")
    a, h = (k * 7 % 100 + 80).cast("string"), (k * 13 % 96 + 82).cast("string")
    layouts = ["AWY %s - HOM %s", "awy %s, hom %s", "AWY: %s HOM: %s", "AWY  %s HOM %s", "\t AWY%s-HOM  %s ", "A %s - HOM %s"]
    score = F.get(F.array(*[F.format_string(x, a, h) for x in layouts]), (k % 6).cast("int"))
    return orders.select(k.alias("k"), text.team_scores(score).alias("s")).select("k", "s.*")


#: (code, sentence with a name, sentence without)
TOLD = [
    ("2pm7", "Bell made 7'' jumper", "7'' jumper made"), ("2pa", "Bell missed jumper", "2-point shot missed"), ("3PM24", "Bell made 24'' three-pointer", "24'' three-pointer made"), ("3pa", "Bell missed three-pointer", "Three-pointer missed"),
    ("layupa3", "Bell missed layup", "Layup missed"), ("dunk1", "Bell dunked", "Dunk"), ("hook4", "Bell hook shot (4'')", "Hook shot (4'')"), ("hook", "Bell hook shot", "Hook shot"), ("ftm", "Bell made free throw", "Free throw made"),
    ("fta", "Bell missed free throw", "Free throw missed"), ("d_reb", "Bell defensive rebound", "Defensive rebound"), ("o", "Bell offensive rebound", "Offensive rebound"), ("tov", "Bell turnover", "Turnover"), ("p_foul", "Bell personal foul", "Personal foul"),
    ("s_foul", "Bell shooting foul", "Shooting foul"), ("t_foul", "Bell technical foul", "Technical foul"), ("steal", "Bell steal", "Steal"), ("b", "Bell block", "Block"), ("sub", "Substitution", "Substitution"), ("period", "Bell period", "period"),
]


@query("fs13_sentences", "SELECT play_id, CASE play_id % 3 WHEN 0 THEN alone WHEN 1 THEN named ELSE replace(named, 'Bell', 'Player') END AS sentence FROM plays JOIN (VALUES " + ", ".join(f"({i}, '{n}', '{a}')" for i, (_, n, a) in enumerate(TOLD)) + f") v(i, named, alone) ON play_id % {len(TOLD)} = i", "plays")
def sentences(plays: DataFrame) -> DataFrame:
    """F-S13: plays in words, with a known player, an unknown one and none."""
    i = F.col("play_id")
    code = F.get(F.array(*[F.lit(c) for c, _, _ in TOLD]), (i % len(TOLD)).cast("int"))
    return plays.select("play_id", text.play_sentence(code, F.when(i % 3 == 0, -1).otherwise(2), F.when(i % 3 == 1, "Ann Bell")).alias("sentence"))


@query("fs14_repaired_json", r"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"a": ' || event_id || '}' WHEN 1 THEN '{"a":' || event_id || ',"b":null,"c":[true,"x"]}' WHEN 2 THEN '{"role":"user","content":"{\"k\":{\"v\":' || event_id || '}}"}' WHEN 4 THEN '{"n":"' || chr(92) || 'u00e9"}' END AS line FROM events""", "t:events")
def repaired(events: DataFrame) -> DataFrame:
    """F-S14: JSON lines, Python literals, contents without escapes, and lines that are nothing."""
    line = F.expr(r"""CASE event_id % 5 WHEN 0 THEN concat('{"a": ', event_id, '}') WHEN 1 THEN concat("{'a': ", event_id, ", 'b': None, 'c': [True, 'x']}")
      WHEN 2 THEN concat('{"role":"user","content":"{"k":{"v":', event_id, '}}"}') WHEN 3 THEN concat('no line ', event_id) ELSE "{'n': 'é'}" END""")
    return events.select("event_id", nested.repaired_json(line).alias("line"))


@query("fs08_doubled_turnovers", "SELECT play_id, CASE WHEN play_id % 3 = 0 THEN 'o_foul,tov,sub' ELSE 'ftm,sub' END AS codes FROM plays", "plays")
def doubled(plays: DataFrame) -> DataFrame:
    """F-S8: an offensive foul is a turnover as well."""
    play = lambda ev: F.struct(F.col("period").alias("q"), ev.alias("ev"))
    both = F.array(play(F.when(F.col("play_id") % 3 == 0, "o_foul").otherwise("ftm")), play(F.lit("sub")))
    return plays.select("play_id", F.array_join(F.transform(nested.doubled_turnovers(both), lambda p: p["ev"]), ",").alias("codes"))


@query("fs09_enriched", "SELECT play_id, CASE play_id % 3 WHEN 0 THEN player || ' ' || CASE WHEN play_id % 2 = 0 THEN 'OFF' ELSE 'DEF' END || '.REBOUND' WHEN 1 THEN player || ' foul on HOM' ELSE player || ' steal' END AS description FROM plays", "plays")
def enriched(plays: DataFrame) -> DataFrame:
    """F-S9: rebounds by kind and fouls with whom they were committed on."""
    i = F.col("play_id")
    told = F.concat_ws(" ", "player", F.get(F.array(F.lit("rebound"), F.lit("foul"), F.lit("steal")), (i % 3).cast("int")))
    return plays.select("play_id", text.enriched(told, i % 2 == 0, F.lit("HOM")).alias("description"))


@query("fa06_player_objects", "SELECT player, season, CAST(player AS STRING) AS name, round_even(avg(pts) / 7, 2) AS offense, CASE WHEN count(*) > 70 THEN round_even(avg(trb), 2) END AS defense, CAST(round_even(avg(mins), 0) AS INT) AS mpg, CASE WHEN count(*) > 75 THEN CAST(round_even(avg(usage_rate), 0) AS INT) END AS usage FROM box GROUP BY player, season", "box")
def player_objects(box: DataFrame) -> DataFrame:
    """F-A6: nested player objects with rounded profiles."""
    n = F.count(F.lit(1))
    rows = box.groupBy("player", "season").agg((F.avg("pts") / 7).alias("o"), F.when(n > 70, F.avg("trb")).alias("d"), F.avg("mins").alias("m"), F.when(n > 75, F.avg("usage_rate")).otherwise(F.lit(float("nan"))).alias("u"))
    made = nested.player_object(F.col("player").cast("string"), {"offense": F.col("o"), "defense": F.col("d")}, F.col("m"), F.col("u"))
    return rows.select("player", "season", made.alias("p")).select("player", "season", "p.name", "p.profile.offense", "p.profile.defense", F.col("p.profile.MPG").alias("mpg"), F.col("p.profile.usage").alias("usage"))


@query("fa13_quarter_start", """WITH t AS (SELECT *, (719 - (play_id * 7) % 720) AS t, row_number() OVER (PARTITION BY game_id ORDER BY play_id DESC) AS rn FROM plays)
SELECT game_id, coalesce(string_agg(CASE WHEN t <> 0 THEN CAST(play_id AS STRING) END, ',' ORDER BY play_id), '') || ',' || '-1' AS lineups, 3 AS q, 720 AS t, arg_max(away_score, play_id) AS a, arg_max(home_score, play_id) AS h, 'quarter_start' AS ev FROM t WHERE rn <= 20 GROUP BY game_id""", "plays")
def quarter_start(plays: DataFrame) -> DataFrame:
    """F-A13: the last twenty plays of a game with a fresh play that starts the third quarter."""
    i = F.col("play_id")
    play = F.struct(F.col("period").alias("q"), (719 - i * 7 % 720).cast("int").alias("t"), F.col("away_score").alias("a"), F.col("home_score").alias("h"), F.lit("A").alias("side"), F.lit(0).alias("idx"), F.col("event_type").alias("ev"), F.lit(0).alias("pts"), i.cast("int").alias("lineup"))
    last = sequence.last_n(plays, ["game_id"], [F.desc("play_id")], 20)
    held = last.groupBy("game_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("play_id", play.alias("p")))), lambda x: x["p"]).alias("p"))
    made = held.select("game_id", nested.quarter_start(F.col("p"), F.lit(3)).alias("p"))
    end = F.element_at("p", -1)
    lineups = F.transform(F.slice("p", 1, F.size("p") - 1), lambda x: x["lineup"].cast("string"))
    return made.select("game_id", F.concat(F.array_join(lineups, ","), F.lit(",-1")).alias("lineups"), end["q"].alias("q"), end["t"].alias("t"), end["a"].alias("a"), end["h"].alias("h"), end["ev"].alias("ev"))


@query("fa15_first_iterations", "SELECT user_id, CAST(to_json(list_slice(list(event_type ORDER BY event_id), 1, 10)) AS STRING) AS first_ten FROM events GROUP BY user_id", "t:events")
def first_iterations(events: DataFrame) -> DataFrame:
    """F-A15: the first ten iterations of a run as JSON."""
    return sequence.first_n(events, ["user_id"], ["event_id"], 10, F.col("event_type"), "items").select("user_id", nested.first_items(F.col("items")).alias("first_ten"))


@query("p13_flat_names", "SELECT game_id, round(avg(successful_predictions), 4) AS predictions_avg, max(successful_predictions) AS predictions_max, round(stddev(duration_seconds), 4) AS duration_deviation FROM runs GROUP BY game_id", "runs")
def flat_names(runs: DataFrame) -> DataFrame:
    """Aggregates of several columns under flat names by patterns."""
    flat = ops.flat_aggregates(runs, ["game_id"], {"successful_predictions": ["avg", "max"], "duration_seconds": ["stddev"]}, {r"^successful_": "", r"_seconds_": "_", r"_stddev$": "_deviation"})
    return flat.select("game_id", F.round("predictions_avg", 4).alias("predictions_avg"), "predictions_max", F.round("duration_deviation", 4).alias("duration_deviation"))


@query("o02_game_order", "SELECT play_id, row_number() OVER (PARTITION BY game_id ORDER BY period, play_id) AS place FROM plays", "plays")
def game_order(plays: DataFrame) -> DataFrame:
    """O2: each game's plays in order, ties by play."""
    return plays.select("play_id", F.row_number().over(sequence.ordered(["game_id"], ["period", "play_id"])).cast("long").alias("place"))


@query("x01_row_rules", "SELECT run_id, CASE WHEN scoring_rate > 25 THEN 'high' WHEN scoring_rate < 15 THEN 'low' ELSE 'middle' END AS label, round(successful_predictions / total_predictions, 4) AS success_rate FROM runs", "runs")
def row_rules(runs: DataFrame) -> DataFrame:
    """Row functions as native expressions."""
    rate = F.col("scoring_rate")
    return runs.select("run_id", F.when(rate > 25, "high").when(rate < 15, "low").otherwise("middle").alias("label"), F.round(F.col("successful_predictions") / F.col("total_predictions"), 4).alias("success_rate"))


@query("x02_own_aggregates", "SELECT platform, string_agg(DISTINCT status, '|' ORDER BY status) AS statuses, round(count(*) FILTER (scoring_rate > 25) / count(*), 4) AS high_share, count(DISTINCT game_id) AS games FROM runs GROUP BY platform", "runs")
def own_aggregates(runs: DataFrame) -> DataFrame:
    """Joined sets, conditional counts and ratios as native aggregates."""
    return runs.groupBy("platform").agg(F.array_join(F.sort_array(F.collect_set("status")), "|").alias("statuses"), F.round(F.count_if(F.col("scoring_rate") > 25) / F.count(F.lit(1)), 4).alias("high_share"), F.count_distinct("game_id").alias("games"))


PAIRS = """SELECT play_id, lead(play_id) OVER w AS n, CASE WHEN row_number() OVER w = 1 THEN '[' || play_id || ']' ELSE '[' || lag(play_id) OVER w || ',' || play_id || ']' END AS q FROM plays WINDOW w AS (PARTITION BY game_id ORDER BY play_id)"""


@query("x04_formatters", f"""WITH p AS ({PAIRS}) SELECT '{{"messages":[{{"role":"user","content":"' || q || '"}},{{"role":"assistant","content":"{{\\"next\\":' || n || '}}"}}]}}' AS line FROM p WHERE n IS NOT NULL UNION ALL SELECT '{{"contents":[{{"role":"user","parts":[{{"text":"' || q || '"}}]}},{{"role":"model","parts":[{{"text":"{{\\"next\\":' || n || '}}"}}]}}]}}' FROM p WHERE n IS NOT NULL""", "plays")
def formatters(plays: DataFrame) -> DataFrame:
    """Training lines of both registered layouts."""
    return facade.generate(plays, "messages", n=2, value="play_id").unionByName(facade.generate(plays, "contents", n=2, value="play_id"))


@query("x06_layout_counts", f"WITH p AS ({PAIRS}) SELECT k.layout, count(*) AS n FROM p, (VALUES ('contents'), ('messages')) k(layout) WHERE n IS NOT NULL GROUP BY k.layout", "plays")
def layout_counts(plays: DataFrame) -> DataFrame:
    """Every layout of the facade, with the lines it gives."""
    return facade.all_layouts(plays, n=2, value="play_id").groupBy("layout").agg(F.count(F.lit(1)).alias("n"))


@query("t17_retries", "SELECT event_id, CASE WHEN event_id % 6 <= 3 THEN 'answer ' || event_id END AS answer, least(event_id % 6, 3) + 1 AS attempts FROM events", "t:events")
def retries(events: DataFrame) -> DataFrame:
    """A predictor asked until its answer is valid, four times at most."""
    questions = events.select("event_id", (F.col("event_id") % 6).cast("string").alias("question"), F.col("event_id").cast("string").alias("context"))
    return facade.predict(questions, "countdown", lambda answer: answer.startswith("answer"), max_retries=3).select("event_id", "answer", F.col("attempts").cast("long").alias("attempts"))


@query("v08_play_responses", """SELECT play_id, array_to_string(list_filter([CASE WHEN trim(coalesce(description, '')) = '' THEN 'description' END, CASE WHEN period NOT BETWEEN 1 AND 10 THEN 'quarter' END, CASE WHEN play_id % 7 = 0 THEN 'time' END, CASE WHEN play_id % 6 > 3 THEN 'points' END], lambda x: x IS NOT NULL), ',') AS errors FROM plays""", "plays")
def play_responses(plays: DataFrame) -> DataFrame:
    """V8, V9: responses built from real plays, by rule."""
    i = F.col("play_id")
    play = F.struct("description", F.col("period").alias("quarter"), F.when(i % 7 == 0, F.lit("soon")).otherwise(F.substring("clock", 3, 5)).alias("time_remaining"), F.struct((i % 6).cast("int").alias("points")).alias("shot_details"))
    return plays.select("play_id", F.array_join(checks.response_errors(F.to_json(F.struct(play.alias("next_play")))), ",").alias("errors"))


@query("v11_game_report", "SELECT g.game_id, count(*) AS plays, count(*) FILTER (lower(description) LIKE '%foul%') AS fouls, count(description) AS described, max(away_score + home_score) AS points, CASE WHEN count(*) >= 50 THEN 'complete' ELSE 'short' END AS state FROM plays g GROUP BY g.game_id", "plays")
def game_report(plays: DataFrame) -> DataFrame:
    """What each game holds."""
    n = F.count(F.lit(1))
    return plays.groupBy("game_id").agg(n.alias("plays"), F.count_if(F.lower("description").contains("foul")).alias("fouls"), F.count("description").alias("described"), F.max(F.col("away_score") + F.col("home_score")).alias("points"), F.when(n >= 50, "complete").otherwise("short").alias("state"))


@query("v07_alignment_share", "SELECT game_id, round(avg(CASE WHEN abs(coalesce(next_away, away_score) - away_score) > 2 THEN 1.0 ELSE 0.0 END), 6) AS far FROM (SELECT *, lead(away_score) OVER (PARTITION BY game_id ORDER BY play_id) AS next_away FROM plays) GROUP BY game_id", "plays")
def alignment_share(plays: DataFrame) -> DataFrame:
    """V7: the share of plays of each game whose label lies far from its context."""
    nxt = F.coalesce(F.lead("away_score").over(Window.partitionBy("game_id").orderBy("play_id")), F.col("away_score"))
    return plays.withColumn("n", nxt).groupBy("game_id").agg(F.round(F.avg(F.when(F.abs(F.col("n") - F.col("away_score")) > 2, 1.0).otherwise(0.0)), 6).alias("far"))
