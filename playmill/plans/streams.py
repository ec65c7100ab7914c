"""Stateful validation and event-time windows over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playmill.functions import clock
from playmill.plans import automaton
from playmill.plans.registry import query
from playmill.streaming import replay, rules, stateful, validator, windows


def _as_runs(plays: DataFrame) -> DataFrame:
    i = F.col("play_id")
    return plays.select(F.col("game_id").alias("run_id"), i.alias("seq"), "period", "clock", "away_score", "home_score", "description").select(
        "run_id", "seq", F.col("period").alias("quarter"), clock.clock_seconds(F.col("clock")).alias("seconds"), F.col("away_score").alias("away"), F.col("home_score").alias("home"), (F.col("seq") % 4).cast("int").alias("points"), "description"
    )


def _flat(verdicts: DataFrame) -> DataFrame:
    """Verdicts with the restored plays as text, which both engines compare."""
    return verdicts.withColumn("restored", F.array_join(F.transform("restored", lambda s: s.cast("string")), ","))


FLAT = "SELECT run_id, seq, verdict, reason, trigger, consecutive, attempts, array_to_string(restored, ',') AS restored, next_quarter FROM judged"
AS_RUNS = "(SELECT game_id AS run_id, play_id AS seq, period AS quarter, CAST(719 - (play_id * 7) % 720 AS INT) AS seconds, away_score AS away, home_score AS home, CAST(play_id % 4 AS INT) AS points, description FROM plays)"


@query("t03_validator", automaton.query_sql(AS_RUNS, validator.Limits(), False, FLAT), "plays")
def validator_verdicts(plays: DataFrame) -> DataFrame:
    """Verdicts of the ordered checks, folded per run."""
    return _flat(validator.validate(_as_runs(plays)))


@query("t03_whole_checks", automaton.query_sql("steps", validator.Limits(), True, FLAT), "steps")
def whole_checks(steps: DataFrame) -> DataFrame:
    """T3 to T14 over runs that know who shot, who plays and who is on the court."""
    return _flat(validator.validate(steps))


@query("t10_impossible", "SELECT play_id, coalesce(greatest(away_score - pa, home_score - ph) > 6, FALSE) AS jump, coalesce(period - pp > 3, FALSE) AS quarter_jump, greatest(away_score, home_score) > 300 AS too_high FROM (SELECT *, lag(away_score) OVER w AS pa, lag(home_score) OVER w AS ph, lag(period) OVER w AS pp FROM plays WINDOW w AS (PARTITION BY game_id ORDER BY play_id))", "plays")
def impossible(plays: DataFrame) -> DataFrame:
    """Impossibilities against the play before."""
    w = Window.partitionBy("game_id").orderBy("play_id")
    rise = F.greatest(F.col("away_score") - F.lag("away_score").over(w), F.col("home_score") - F.lag("home_score").over(w))
    return plays.select("play_id", F.coalesce(rise > 6, F.lit(False)).alias("jump"), F.coalesce(F.col("period") - F.lag("period").over(w) > 3, F.lit(False)).alias("quarter_jump"), (F.greatest("away_score", "home_score") > 300).alias("too_high"))


@query("t16_score_tracker", "SELECT play_id, greatest(away_score - home_score, home_score - away_score) AS margin, max(abs(away_score - home_score)) OVER (PARTITION BY game_id ORDER BY play_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS largest FROM plays", "plays")
def tracker(plays: DataFrame) -> DataFrame:
    """The running score state."""
    margin = F.abs(F.col("away_score") - F.col("home_score"))
    w = Window.partitionBy("game_id").orderBy("play_id").rowsBetween(Window.unboundedPreceding, 0)
    return plays.select("play_id", margin.alias("margin"), F.max(margin).over(w).alias("largest"))


@query("t19_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2", "t:events")
def tumbling(events: DataFrame) -> DataFrame:
    """Hourly windows."""
    out = windows.windowed(events, "ts", "1 hour", None, ["event_type"], [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")])
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


@query("t19_sliding", "SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY s", "t:events")
def sliding(events: DataFrame) -> DataFrame:
    """Two-hour windows every hour."""
    return windows.windowed(events, "ts", "2 hours", "1 hour", [], [F.count(F.lit(1)).alias("n")]).select(F.col("window.start").alias("start"), "n")


@query("t19_sessions", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS nw FROM events), s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k", "t:events")
def sessions(events: DataFrame) -> DataFrame:
    """Sessions with a gap of two hours."""
    return windows.sessions(events, "ts", "2 hours", ["user_id"], [F.count(F.lit(1)).alias("n"), F.min("ts").alias("start")]).select("user_id", "start", "n")


W = "WINDOW w AS (PARTITION BY run_id ORDER BY seq)"
RUN, SEQ = ["run_id"], "seq"


RECORDS = """SELECT j.run_id, j.seq, CASE verdict WHEN 'END_GAME' THEN 'game_ended' WHEN 'ROLLBACK_TIME' THEN 'rollback_time' ELSE 'quarter_transition' END AS type, reason, trigger, consecutive, attempts, s.quarter, s.seconds, s.away, s.home, substring(s.description, 1, 100) AS description,
coalesce(len(restored), -1) AS restored FROM judged j JOIN steps s ON s.run_id = j.run_id AND s.seq = j.seq WHERE verdict IN ('END_GAME', 'ROLLBACK_TIME', 'QUARTER_TRANSITION') AND trigger IS NOT NULL"""


@query("t15_records", automaton.query_sql("steps", validator.Limits(), True, RECORDS), "steps")
def records(steps: DataFrame) -> DataFrame:
    """Records of terminal verdicts for storage, with the state of the game."""
    return validator.with_records(validator.validate(steps), steps).withColumn("restored", F.coalesce("restored", F.lit(-1)))


@query("t02_fast_fold", automaton.query_sql("steps", validator.Limits(fast=True), True, FLAT), "steps")
def fast_fold(steps: DataFrame) -> DataFrame:
    """The fast mode of the fold, which forgets the clock at a transition."""
    return _flat(validator.validate(steps, validator.Limits(fast=True)))


@query("t02_fast_mode", f"""WITH a AS (SELECT *, lower(coalesce(description, '')) AS d, seconds = 0 AS z, lag(seconds) OVER w AS ps FROM steps {W}),
b AS (SELECT *, sum(CASE WHEN ps = seconds THEN 0 ELSE 1 END) OVER w AS part, list(CASE WHEN z THEN CASE WHEN contains(d, 'period') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(d, 'sub|timeout|jump|technical|unknown') THEN 1 ELSE 0 END ELSE -1 END) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS held FROM a {W}),
c AS (SELECT *, list_filter(coalesce(held, []), lambda x: x >= 0) AS ago, row_number() OVER (PARTITION BY run_id, part ORDER BY seq) - 1 AS same FROM b),
e AS (SELECT *, contains(d, 'period') OR len(list_filter(ago, lambda x: x >= 2)) > 0 OR (len(list_filter(ago[greatest(len(ago) - 7, 1):], lambda x: x % 2 = 1)) >= 2 AND (len(ago) >= 4 OR same >= 4)) AS ends FROM c)
SELECT seq, CASE WHEN z AND quarter = 4 THEN 'END_GAME' WHEN z AND quarter < 4 AND ends THEN 'QUARTER_TRANSITION' WHEN same >= 5 THEN 'ROLLBACK_TIME' ELSE 'VALID' END AS verdict FROM e""", "steps")
def fast_mode(steps: DataFrame) -> DataFrame:
    """The fast mode by windows; the clock is not forgotten at a transition."""
    return rules.fast_verdicts(steps, RUN, SEQ, "quarter", "seconds", "description").select("seq", "verdict")


@query("t04_patterns", """WITH a AS (SELECT *, concat_ws('|', CASE WHEN points > 0 THEN 'SHOT:' || points || 'PT' END, CASE WHEN contains(upper(description), 'MISS') THEN 'DESC:MISS' WHEN contains(upper(description), 'SUB') THEN 'DESC:SUB' WHEN contains(upper(description), 'TIMEOUT') THEN 'DESC:TIMEOUT' END) AS p FROM steps)
SELECT seq, CASE WHEN p = '' THEN 'GENERIC_PLAY' ELSE p END AS pattern, row_number() OVER (PARTITION BY run_id, p ORDER BY seq) % 12 = 0 AS fired FROM a""", "steps")
def patterns(steps: DataFrame) -> DataFrame:
    """T4, F-S12: play signatures and their twelfth repetition."""
    return rules.pattern_strikes(steps, RUN, SEQ, rules.play_pattern(F.lit(None).cast("string"), F.col("points"), F.col("description"))).select("seq", "pattern", "fired")


@query("fs12_pattern", "SELECT play_id, 'PLAYER:' || player || CASE WHEN play_id % 4 > 0 THEN '|SHOT:' || play_id % 4 || 'PT' ELSE '' END || CASE WHEN description IS NULL OR event_type = 'purchase' OR event_type = 'signup' THEN '' WHEN event_type = 'click' THEN '|DESC:MISS' WHEN event_type = 'view' THEN '|DESC:SUB' ELSE '|DESC:FOUL-TURNOVER' END AS pattern FROM plays", "plays")
def pattern(plays: DataFrame) -> DataFrame:
    """F-S12: signatures of players, points and key words."""
    return plays.select("play_id", rules.play_pattern(F.col("player"), F.col("play_id") % 4, F.col("description")).alias("pattern"))


@query("t05_stuck_clock", f"""WITH a AS (SELECT *, lag(seconds) OVER w AS ps, row_number() OVER w AS rn FROM steps {W}), b AS (SELECT *, sum(CASE WHEN ps = seconds THEN 0 ELSE 1 END) OVER w AS part FROM a {W}),
c AS (SELECT *, row_number() OVER (PARTITION BY run_id, part ORDER BY seq) - 1 AS same, min(rn) OVER (PARTITION BY run_id, part) AS begun FROM b), d AS (SELECT *, same > 0 AND same % 8 = 0 AS fired FROM c)
SELECT d.seq, d.same, d.fired, CASE WHEN d.fired THEN coalesce(string_agg(CAST(p.seq AS STRING), ',' ORDER BY p.seq), '') END AS restored FROM d LEFT JOIN a p ON d.fired AND p.run_id = d.run_id AND p.rn < d.begun AND p.rn >= d.begun - 19 GROUP BY d.seq, d.same, d.fired""", "steps")
def stuck(steps: DataFrame) -> DataFrame:
    """Plays at one clock, and the plays a rollback restores."""
    got = rules.stuck_clock(steps, RUN, SEQ, ["seconds"])
    return got.select("seq", F.col("same").cast("long").alias("same"), "fired", F.array_join(F.transform("restored", lambda s: s.cast("string")), ",").alias("restored"))


@query("t07_clock_strikes", f"WITH a AS (SELECT *, lag(quarter) OVER w AS pq, lag(seconds) OVER w AS ps FROM steps {W}), b AS (SELECT *, sum(CASE WHEN pq = quarter THEN 0 ELSE 1 END) OVER w AS part, coalesce(pq = quarter AND seconds - ps > 10, FALSE) AS f FROM a {W}) SELECT seq, f AND sum(CAST(f AS INT)) OVER (PARTITION BY run_id, part ORDER BY seq) % 5 = 0 AS fired FROM b", "steps")
def clock_strikes(steps: DataFrame) -> DataFrame:
    """The fifth time in a quarter that the clock runs forward."""
    return rules.clock_strikes(steps, RUN, SEQ, "quarter", "seconds").select("seq", "fired")


@query("t08_score_strikes", f"WITH a AS (SELECT *, coalesce(greatest(lag(away) OVER w - away, lag(home) OVER w - home), 0) AS f FROM steps {W}), b AS (SELECT *, coalesce(sum(CASE WHEN f > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM a) SELECT seq, f > 3 OR (f > 0 AND sum(CASE WHEN f BETWEEN 1 AND 3 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, part ORDER BY seq) % 5 = 0) AS fired FROM b", "steps")
def score_strikes(steps: DataFrame) -> DataFrame:
    """A large fall of the score, or the fifth small one."""
    return rules.score_strikes(steps, RUN, SEQ, "away", "home").select("seq", "fired")


@query("t11_quarter_resets", f"WITH a AS (SELECT *, quarter - lag(quarter) OVER w AS up FROM steps {W}), b AS (SELECT *, coalesce(up = 1 AND CASE WHEN quarter <= 4 THEN abs(seconds - 720) > 300 ELSE abs(seconds - 300) > 180 END, FALSE) AS f FROM a) SELECT seq, coalesce(up > 2, FALSE) OR (f AND sum(CAST(f AS INT)) OVER w % 5 = 0) AS fired FROM b {W}", "steps")
def quarter_resets(steps: DataFrame) -> DataFrame:
    """Skipped quarters, and the fifth quarter that begins far from its full clock."""
    return rules.quarter_resets(steps, RUN, SEQ, "quarter", "seconds").select("seq", "fired")


@query("t12_situations", f"WITH a AS (SELECT *, abs(away - home) AS g, upper(coalesce(description, '')) AS d FROM steps), b AS (SELECT *, (contains(d, 'TIMEOUT') AND g > 20 AND seconds >= 120) OR (points = 1 AND NOT contains(d, 'FREE')) OR (contains(d, 'SUB') AND seconds < 30 AND g <= 3) AS f FROM a) SELECT seq, f AS odd, f AND sum(CAST(f AS INT)) OVER w % 8 = 0 AS fired FROM b {W}", "steps")
def situations(steps: DataFrame) -> DataFrame:
    """Plays that make no sense at the score and clock, and every eighth of a run."""
    odd = rules.odd_situation(*[F.col(c) for c in ("description", "quarter", "seconds", "away", "home", "points")])
    return steps.withColumn("odd", odd).select("seq", "odd", rules.strikes(F.col("odd"), 8, RUN, SEQ).alias("fired"))


@query("t13_text_strikes", f"""WITH a AS (SELECT *, upper(coalesce(description, '')) AS u, lag(away) OVER w AS pa, lag(home) OVER w AS ph FROM steps {W}),
b AS (SELECT *, regexp_matches(u, 'SCORE|MAKE|BASKET|SHOT|POINT') AS says, coalesce(away > pa OR home > ph, FALSE) AS rose FROM a),
c AS (SELECT *, u <> '' AND ((points = 3 AND NOT regexp_matches(u, '3|THREE|POINTER') AND regexp_matches(u, 'SHOT|MAKE|SCORE')) OR (points = 2 AND contains(u, '3') AND regexp_matches(u, 'THREE|POINTER'))
  OR (points = 1 AND NOT regexp_matches(u, 'FOUL|FREE|TECHNICAL')) OR (len(court) > 0 AND NOT list_contains(court, player) AND NOT contains(u, upper(player))) OR (contains(u, 'SUB') AND NOT regexp_matches(replace(u, 'SUB', ''), '[A-Z]'))
  OR (quarter = 4 AND NOT regexp_matches(u, 'FOURTH|4TH') AND regexp_matches(u, 'FIRST|1ST'))
  OR (pa IS NOT NULL AND CASE WHEN rose THEN NOT says AND NOT regexp_matches(u, 'SUB|TIMEOUT|FOUL') ELSE says AND NOT regexp_matches(u, 'MISS|BLOCK|REBOUND') END)) AS f FROM b)
SELECT seq, f AS wrong, f AND sum(CAST(f AS INT)) OVER w % 6 = 0 AS fired FROM c {W}""", "steps")
def text_strikes(steps: DataFrame) -> DataFrame:
    """Plays whose words contradict their points, player, score or quarter, and every sixth of a run."""
    w = Window.partitionBy(*RUN).orderBy(SEQ)
    up = F.upper(F.coalesce("description", F.lit("")))
    before = F.lag("away").over(w).isNotNull()
    rose = F.coalesce((F.col("away") > F.lag("away").over(w)) | (F.col("home") > F.lag("home").over(w)), F.lit(False))
    said = rules.scoring_words(up)
    wrong = rules.contradiction(up, F.col("points"), F.col("quarter"), F.col("player"), F.col("court")) | (before & F.when(rose, said["mute"]).otherwise(said["claims"]))
    return steps.withColumn("wrong", wrong).select("seq", "wrong", rules.strikes(F.col("wrong"), 6, RUN, SEQ).alias("fired"))


@query("t15_first_end", f"WITH a AS (SELECT *, lag(seconds) OVER w AS ps FROM steps {W}), b AS (SELECT *, sum(CASE WHEN ps = seconds THEN 0 ELSE 1 END) OVER w AS part FROM a {W}), c AS (SELECT *, row_number() OVER (PARTITION BY run_id, part ORDER BY seq) - 1 AS same FROM b), d AS (SELECT *, CASE WHEN quarter = 4 AND seconds = 0 THEN 'game_ended' WHEN same = 8 THEN 'rollback_time' END AS type FROM c) SELECT run_id, min(seq) AS at, arg_min(type, seq) AS type, arg_min(quarter, seq) AS quarter, arg_min(seconds, seq) AS seconds, arg_min(away, seq) AS away, arg_min(home, seq) AS home, count(*) AS terminations FROM d WHERE type IS NOT NULL GROUP BY run_id", "steps")
def first_end(steps: DataFrame) -> DataFrame:
    """The first terminal verdict of each run, with its state."""
    stood = rules.stuck_clock(steps, RUN, SEQ, ["seconds"])
    verdict = F.when((F.col("quarter") == 4) & (F.col("seconds") == 0), "END_GAME").when(F.col("same") == 8, "ROLLBACK_TIME")
    return rules.termination_record(stood.withColumn("verdict", verdict), RUN, SEQ).drop("description")


#: Deliveries of events: every 40th comes two deliveries later, every 25th once more with the next one.
BATCHES, LATE = 4, "2 days"
MARKS = """marks AS (SELECT b.batch, (SELECT least(max(ts) FILTER ({0}), max(ts) FILTER ({1})) FROM deliveries d WHERE d.batch < b.batch) AS latest FROM (SELECT DISTINCT batch FROM deliveries) b),
marked AS (SELECT d.*, date_trunc('milliseconds', latest) - INTERVAL 2 DAY AS mark FROM deliveries d JOIN marks m ON m.batch = d.batch)"""
MARKED = MARKS.format("TRUE", "TRUE")


@query("t19_stream_windows", f"""WITH {MARKED} SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM marked WHERE mark IS NULL OR time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR > mark
GROUP BY 1, 2 HAVING start + INTERVAL 6 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 DAY FROM deliveries)""", "deliveries")
def stream_windows(deliveries: DataFrame) -> DataFrame:
    """Six-hour windows of a stream that is restarted three times; what is too late is dropped, what is closed is written once."""

    def build(stream: DataFrame) -> DataFrame:
        rows = stream.withColumn("ts", F.col("ts").cast("timestamp"))
        out = windows.windowed(rows, "ts", "6 hours", None, ["event_type"], [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")], LATE)
        return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")

    return replay.replayed(deliveries, "batch", BATCHES, build)[0]


@query("t19_stream_first_deliveries", f"WITH {MARKED} SELECT DISTINCT event_id, event_type FROM marked WHERE mark IS NULL OR ts > mark", "deliveries")
def stream_first(deliveries: DataFrame) -> DataFrame:
    """Each event of a stream once, whether it comes again in the same delivery or the next."""
    return replay.replayed(deliveries, "batch", BATCHES, lambda s: replay.first_deliveries(s, ["event_id"], "ts", LATE).select("event_id", "event_type"))[0]


@query("t19_stream_interval_join", "WITH " + MARKS.format("event_type = 'click'", "event_type = 'purchase'") + """, kept AS (SELECT * FROM marked WHERE mark IS NULL OR ts > mark)
SELECT c.event_id AS click, p.event_id AS purchase FROM kept c JOIN kept p ON p.user_id = c.user_id AND c.event_type = 'click' AND p.event_type = 'purchase' AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 1 DAY""", "deliveries")
def stream_join(deliveries: DataFrame) -> DataFrame:
    """Purchases up to a day after a click of the same user, both sides streams."""

    def build(stream: DataFrame) -> DataFrame:
        clicks = stream.where("event_type = 'click'").select(F.col("event_id").alias("click"), F.col("user_id").alias("who"), F.col("ts").alias("clicked"))
        bought = stream.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), "user_id", F.col("ts").alias("bought"))
        return replay.interval_join(clicks, bought, F.col("who") == F.col("user_id"), ("clicked", "bought"), "1 DAY", LATE).select("click", "purchase")

    return replay.replayed(deliveries, "batch", BATCHES, build)[0]


def _in_thirds(steps: DataFrame) -> DataFrame:
    """Plays with the delivery they come with: the first five of each run, the next seven, the rest."""
    place = F.row_number().over(Window.partitionBy(*RUN).orderBy(SEQ))
    return steps.withColumn("batch", F.when(place <= 5, 0).when(place <= 12, 1).otherwise(2))


@query("t03_stream", automaton.query_sql("steps", validator.Limits(), True, FLAT), "steps")
def stream_verdicts(steps: DataFrame) -> DataFrame:
    """The validator over a stream that is stopped and restarted in mid-game, twice."""
    return _flat(replay.replayed(_in_thirds(steps), "batch", 3, stateful.validate_stream)[0])


@query("t14_stream_state", automaton.query_sql("steps", validator.Limits(), True, """, ends AS (SELECT run_id, max(rn) AS rn FROM folded GROUP BY run_id)
SELECT run_id, plays, quarter, seconds, away, home, score AS score_strikes, wording AS text_strikes, ended, CAST(len(context) AS BIGINT) AS held, context[-1].seq AS latest FROM folded JOIN ends USING (run_id, rn)"""), "steps")
def stream_state(steps: DataFrame) -> DataFrame:
    """The state that the stream leaves, read back from its checkpoint; no run holds more than its context."""
    spark = steps.sparkSession
    _, checkpoint = replay.replayed(_in_thirds(steps), "batch", 3, stateful.validate_stream)
    kept = replay.state_of(spark, checkpoint, "context")
    counters = [f"value.{c}" for c in ("plays", "quarter", "seconds", "away", "home", "score_strikes", "text_strikes", "ended")]
    return kept.select("key.run_id", *counters, F.size("value.held.seq").cast("long").alias("held"), F.array_max("value.held.seq").alias("latest"))
