"""The validator's automaton in the JVM: one ``aggregate`` over a run's plays, whose accumulator is the whole state.

``prepared`` turns what a play says by itself into columns (words, patterns, flags of rules) before plays are gathered, so the
fold compares numbers, flags and short lists only.  The accumulator holds all counters, the last plays as context, the
snapshot of a rollback and the patterns seen; the first check that fires decides and starts its own counter again.  Plays
are folded in chunks, so verdicts are appended to short lists.  A run is sequential by nature: its plays come into one
row, whose size is that of the run, and runs spread over tasks.

The stream keeps the same state between its batches (``playmill.streaming.validator``); both give the same verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playmill.functions.nested import let
from playmill.streaming.rules import ADMIN_WORDS, contradiction, odd_situation, play_pattern, scoring_words

#: Words of administrative plays at the end of a quarter.
END_WORDS = ("substitution", "timeout", "unknown", "end of", "technical")
ENTRY = "struct<seq:bigint,quarter:int,seconds:int,text:string,words:array<string>,period:boolean,admin:boolean,closing:boolean,sub:boolean>"
VERDICT = "struct<verdict:string,reason:string,trigger:string,consecutive:int,restored:array<bigint>,next_quarter:int>"
COUNTERS = ("same_text", "same_clock", "low_clock", "substitutions", "similar_strikes", "clock_strikes", "score_strikes", "quarter_strikes", "situation_strikes", "text_strikes")
CHUNK = 256


def _number(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)).cast("int")


def _some(text: Column, words: tuple[str, ...]) -> Column:
    return F.reduce(F.array(*[F.contains(text, F.lit(w)) for w in words]), F.lit(False), lambda a, b: a | b)


def plain_words(text: Column) -> Column:
    """Distinct words in capitals, with clocks, scores and numbers replaced by what they are."""
    out = F.upper(text)
    for pattern, name in ((r"(?U)\d+:\d+", "TIME"), (r"(?U)\d+ - \d+", "SCORE"), (r"(?U)\d+", "NUM")):
        out = F.regexp_replace(out, pattern, name)
    return F.array_distinct(F.filter(F.split(out, r"(?U)\s+"), lambda w: w != ""))


def optional(df: DataFrame, name: str, kind: str) -> Column:
    """A column, or nulls where the table has none of that name."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def prepared(plays: DataFrame) -> DataFrame:
    """(run_id, p): each play with all that its own fields say."""
    text, points, player = F.coalesce("description", F.lit("")), F.col("points"), optional(plays, "player", "string")
    court = F.coalesce(optional(plays, "court", "array<string>"), F.array().cast("array<string>"))
    base = plays.select(
        "run_id", "seq", "quarter", "seconds", "away", "home", "points", text.alias("text"), F.lower(text).alias("low"), F.upper(text).alias("up"),
        optional(plays, "shooter", "string").alias("shooter"), player.alias("player"), court.alias("court"),
    )
    said = scoring_words(F.col("up"))
    play = F.struct(
        "seq", "quarter", "seconds", "away", "home", "points", "shooter", "text",
        plain_words(F.col("text")).alias("words"),
        F.contains("low", F.lit("period")).alias("period"),
        _some(F.col("low"), ADMIN_WORDS).alias("admin"),
        _some(F.col("low"), END_WORDS).alias("closing"),
        F.contains("low", F.lit("sub")).alias("sub"),
        play_pattern(F.lit(None).cast("string"), points, F.col("text")).alias("pattern"),
        F.coalesce(odd_situation(F.col("text"), F.col("quarter"), F.col("seconds"), F.col("away"), F.col("home"), points), F.lit(False)).alias("odd"),
        F.coalesce(contradiction(F.col("up"), points, F.col("quarter"), F.col("player"), F.col("court")), F.lit(False)).alias("wrong"),
        said["claims"].alias("claims"),
        said["mute"].alias("mute"),
        (F.size("court") > F.size(F.array_distinct("court"))).alias("twice"),
    )
    return base.select("run_id", play.alias("p"))


def first_state() -> Column:
    """The state before a run's first play."""
    counters = ", ".join(f"0 AS {c}" for c in COUNTERS)
    none = f"cast(array() AS array<{ENTRY}>)"
    return F.expr(f"named_struct('quarter', 0, 'seconds', -1, 'away', 0, 'home', 0, 'plays', 0, 'last_seq', cast(NULL AS bigint), 'c', struct({counters}), 'patterns', cast(map() AS map<string,int>), 'context', {none}, 'snapshot', cast(NULL AS array<{ENTRY}>), 'ended', false)")


def _verdict(kind: str, reason: str | Column = "", trigger: str | None = None, consecutive: Column | None = None, restored: Column | None = None, next_quarter: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("verdict"),
        (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"),
        F.lit(trigger).cast("string").alias("trigger"),
        (F.lit(None) if consecutive is None else consecutive).cast("int").alias("consecutive"),
        (F.lit(None) if restored is None else restored).cast("array<bigint>").alias("restored"),
        (F.lit(None) if next_quarter is None else next_quarter).cast("int").alias("next_quarter"),
    )


def _counted(s: Column, p: Column, lim) -> Column:
    """All counters after play ``p``, and how it differs from the play before."""
    c, later = s["c"], s["plays"] > 0
    same_quarter = later & (p["quarter"] == s["quarter"])
    same_clock = F.when(same_quarter & (p["seconds"] == s["seconds"]), c["same_clock"] + 1).otherwise(0)
    recent = F.slice(s["context"], F.greatest(F.size(s["context"]) - lim.look_back + 1, F.lit(1)), lim.look_back)
    last = F.try_element_at(s["context"], F.lit(-1))
    share = lambda r: F.size(F.array_intersect(r["words"], p["words"])) / F.greatest(F.size(F.array_union(r["words"], p["words"])), F.lit(1))
    alike = F.size(F.filter(recent, lambda r: (r["text"] != p["text"]) & (share(r) > lim.similar)))
    fall = lambda t: F.when(later, s[t] - p[t]).otherwise(0)
    full, tolerance = F.when(p["quarter"] <= 4, 720).otherwise(300), F.when(p["quarter"] <= 4, 300).otherwise(180)
    ahead = F.when(later, p["quarter"] - s["quarter"]).otherwise(0)
    rose = (fall("away") < 0) | (fall("home") < 0)
    wrong = p["wrong"] | (later & ((p["claims"] & ~rose) | (p["mute"] & rose)))
    seen = F.coalesce(F.try_element_at(s["patterns"], p["pattern"]), F.lit(0)) + 1
    patterns = F.map_concat(F.map_filter(s["patterns"], lambda k, v: k != p["pattern"]), F.create_map(p["pattern"], seen))
    clock_before = same_quarter & (s["seconds"] >= 0)
    return F.struct(
        same_clock.cast("int").alias("same_clock"),
        F.when((p["quarter"] == 4) & (p["seconds"] < lim.low_clock), c["low_clock"] + 1).otherwise(0).alias("low_clock"),
        F.when(last["text"] == p["text"], c["same_text"] + 1).otherwise(0).alias("same_text"),
        (c["similar_strikes"] + _number(alike >= lim.similar_plays)).alias("similar_strikes"),
        F.when(p["sub"], c["substitutions"] + 1).otherwise(0).alias("substitutions"),
        let(patterns, lambda m: F.when(F.size(m) > lim.patterns_held, F.map_filter(m, lambda k, v: v > 1)).otherwise(m)).alias("patterns"),
        (F.when(same_quarter, c["clock_strikes"]).otherwise(0) + _number(same_quarter & (p["seconds"] - s["seconds"] > lim.clock_forward))).alias("clock_strikes"),
        (c["score_strikes"] + _number(fall("away") > 0) + _number(fall("home") > 0)).alias("score_strikes"),
        (c["quarter_strikes"] + _number((ahead == 1) & (F.abs(p["seconds"] - full) > tolerance))).alias("quarter_strikes"),
        (c["situation_strikes"] + _number(p["odd"])).alias("situation_strikes"),
        (c["text_strikes"] + _number(wrong)).alias("text_strikes"),
        F.greatest(fall("away"), fall("home")).alias("drop"),
        F.greatest(-fall("away"), -fall("home")).alias("jump"),
        ahead.alias("ahead"),
        F.coalesce(later & (p["points"] > 0) & (F.abs(-F.when(p["shooter"] == "A", fall("away")).when(p["shooter"] == "H", fall("home")) - p["points"]) > lim.shot_gap), F.lit(False)).alias("off_shot"),
        (clock_before & (p["seconds"] - s["seconds"] > lim.max_clock_jump)).alias("clock_jump"),
        F.when(same_clock == 1, F.filter(s["context"], lambda r: (r["quarter"] != p["quarter"]) | (r["seconds"] != p["seconds"]))).otherwise(s["snapshot"]).alias("snapshot"),
    )


def _quarter_end(s: Column, p: Column, n: Column, lim) -> Column:
    """Why a quarter before the fourth ends with this play, or null."""
    at_zero = F.filter(s["context"], lambda r: r["seconds"] == 0)
    period = p["period"] | F.exists(at_zero, lambda r: r["period"])
    count = lambda rows, flag: F.size(F.filter(rows, lambda r: r[flag]))
    tail = lambda rows, k: F.slice(rows, F.greatest(F.size(rows) - k + 1, F.lit(1)), k)
    if lim.fast:
        held = (count(tail(at_zero, 8), "admin") >= 2) & ((n["same_clock"] >= 4) | (F.size(at_zero) >= 4))
        why = F.when(period, "end of period").when(held, "administrative plays")
    else:
        recent = F.filter(tail(s["context"], 6), lambda r: r["seconds"] == 0)
        why = (
            F.when(period, "end of period")
            .when((n["same_clock"] >= lim.admin_at) & p["closing"] & (count(tail(recent, 5), "closing") + 1 >= 3), "administrative plays")
            .when((n["same_clock"] >= lim.substitutions_at) & (count(recent, "sub") + _number(p["sub"]) >= 3), "substitutions")
            .when(n["same_clock"] >= lim.stall_at, "clock stands at the end")
        )
    return F.when((p["seconds"] == 0) & (p["quarter"] > 0) & (p["quarter"] < 4), why)


def _decided(s: Column, p: Column, n: Column, lim) -> Column:
    """The verdict: the first check that fires."""
    over = (p["quarter"] >= 4) & (p["seconds"] == 0) & (p["away"] != p["home"])
    if lim.fast:
        over = over | ((p["quarter"] == 4) & (p["seconds"] == 0))
    out = F.when(over, _verdict("END_GAME", "time expired", "quarter_4_time_expired"))
    if not lim.fast:
        out = out.when(n["low_clock"] >= lim.low_clock_plays, _verdict("END_GAME", "clock runs out", "low_clock", n["low_clock"]))
    ending = _quarter_end(s, p, n, lim)
    held = F.coalesce(n["snapshot"], F.array().cast(f"array<{ENTRY}>"))
    back = F.coalesce(F.try_element_at(held, F.lit(-1))["seq"], F.lit(-1).cast("bigint"))
    out = out.when(ending.isNotNull(), _verdict("QUARTER_TRANSITION", ending, "end_of_quarter", n["same_clock"], next_quarter=p["quarter"] + 1))
    out = out.when(n["same_clock"] >= (lim.fast_same_clock if lim.fast else lim.same_clock), _verdict("ROLLBACK_TIME", F.concat(F.lit("clock stuck, back to "), back.cast("string")), "same_clock", n["same_clock"], F.transform(held, lambda r: r["seq"])))
    if lim.fast:
        return out.otherwise(_verdict("VALID"))
    again = lambda counter, limit, reason, trigger: (n[counter] >= limit, _verdict("RETRY", reason, trigger, n[counter]))
    seen = F.coalesce(F.try_element_at(n["patterns"], p["pattern"]), F.lit(0))
    impossible = (p["points"] > lim.max_points) | (n["jump"] > lim.max_jump) | (F.greatest(p["away"], p["home"]) > lim.max_score) | (n["ahead"] > lim.max_quarter_jump) | n["clock_jump"] | p["twice"]
    checks = [
        again("same_text", lim.same_text, "repeated response", "same_text"),
        again("similar_strikes", lim.similar_strikes, "near-duplicate responses", "similar"),
        (seen >= lim.pattern, _verdict("RETRY", F.concat(F.lit("pattern repeated: "), p["pattern"]), "pattern", F.lit(lim.pattern))),
        again("substitutions", lim.substitutions, "too many substitutions", "substitutions"),
        again("clock_strikes", lim.clock_strikes, "clock runs forward", "clock"),
        ((n["drop"] > lim.score_drop) | (n["score_strikes"] >= lim.score_strikes), _verdict("RETRY", "score falls", "score", n["score_strikes"])),
        (n["off_shot"], _verdict("RETRY", "score and shot disagree", "shot")),
        (impossible, _verdict("RETRY", "impossible figures", "impossible")),
        (n["ahead"] > lim.quarter_skip, _verdict("RETRY", "quarters skipped", "quarter_skip")),
        again("quarter_strikes", lim.quarter_strikes, "quarters begin far from their full clock", "quarter"),
        again("situation_strikes", lim.situation_strikes, "plays do not fit the situation", "situation"),
        again("text_strikes", lim.text_strikes, "text contradicts the play", "text"),
    ]
    for fires, verdict in checks:
        out = out.when(fires, verdict)
    return out.otherwise(_verdict("VALID"))


#: Which counter starts again where a check fires.
RESTARTS = {"same_text": "same_text", "similar": "similar_strikes", "substitutions": "substitutions", "clock": "clock_strikes", "score": "score_strikes", "quarter": "quarter_strikes", "situation": "situation_strikes", "text": "text_strikes"}


def _moved(s: Column, p: Column, n: Column, v: Column, lim) -> Column:
    """The state after a verdict."""
    fired = F.coalesce(v["trigger"], F.lit(""))
    retry, rolled = v["verdict"] == "RETRY", v["verdict"] == "ROLLBACK_TIME"
    again = {counter: trigger for trigger, counter in RESTARTS.items()}
    forget = rolled | (v["verdict"] == "QUARTER_TRANSITION")
    counters = [F.when(forget, 0).otherwise(n["same_clock"]).alias(c) if c == "same_clock" else F.when(retry & (fired == again[c]), 0).otherwise(n[c]).alias(c) if c in again else n[c].alias(c) for c in COUNTERS]
    own = F.array(F.struct(*[p[f].alias(f) for f in ("seq", "quarter", "seconds", "text", "words", "period", "admin", "closing", "sub")]))
    context = F.concat(s["context"], own)
    kept = F.slice(context, F.greatest(F.size(context) - lim.context + 1, F.lit(1)), lim.context)
    held = retry & (fired == "score")  # a fall that fires is not believed: the scores before it stay
    return F.struct(
        p["quarter"].alias("quarter"),
        F.when(forget, -1).otherwise(p["seconds"]).alias("seconds"),
        F.when(held, s["away"]).otherwise(p["away"]).alias("away"),
        F.when(held, s["home"]).otherwise(p["home"]).alias("home"),
        (s["plays"] + 1).alias("plays"),
        p["seq"].alias("last_seq"),
        F.struct(*counters).alias("c"),
        F.when(retry & (fired == "pattern"), F.transform_values(n["patterns"], lambda k, c: F.when(k == p["pattern"], 0).otherwise(c))).otherwise(n["patterns"]).alias("patterns"),
        F.when(rolled, F.coalesce(n["snapshot"], F.slice(kept, 1, 0))).otherwise(kept).alias("context"),
        F.when(~rolled, n["snapshot"]).alias("snapshot"),
        (v["verdict"] == "END_GAME").alias("ended"),
    )


def advance(s: Column, p: Column, lim) -> Column:
    """(s, v): the state after play ``p`` and its verdict."""
    both = lambda state, verdict: F.struct(state.alias("s"), verdict.alias("v"))
    late = F.coalesce(p["seq"] <= s["last_seq"], F.lit(False))
    passed = F.struct(*[(p["seq"] if f == "last_seq" else s[f]).alias(f) for f in ("quarter", "seconds", "away", "home", "plays", "last_seq", "c", "patterns", "context", "snapshot", "ended")])
    judged = let(_counted(s, p, lim), lambda n: let(_decided(s, p, n, lim), lambda v: both(_moved(s, p, n, v, lim), v)))
    return F.when(late, both(s, _verdict("LATE", "behind a play that was judged already"))).when(s["ended"], both(passed, _verdict("END_GAME", "after the end"))).otherwise(judged)


def folded(plays: Column, state: Column, lim) -> Column:
    """(s, out): the state after an array of prepared plays, and (seq, attempts, v) of each."""
    kind = f"array<struct<seq:bigint,attempts:int,v:{VERDICT}>>"
    none = F.array().cast(kind)
    one = lambda acc, p: let(advance(acc["s"], p, lim), lambda r: F.struct(r["s"].alias("s"), F.concat(acc["out"], F.array(F.struct(p["seq"].alias("seq"), r["s"]["plays"].alias("attempts"), r["v"].alias("v")))).alias("out")))
    start = lambda s, out: F.struct(s.alias("s"), out.alias("out"))
    chunk = lambda acc, part: let(F.aggregate(part, start(acc["s"], none), one), lambda r: F.struct(r["s"].alias("s"), F.concat(acc["out"], F.array(r["out"])).alias("out")))
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(plays), F.lit(1)), F.lit(CHUNK)), lambda i: F.slice(plays, i, CHUNK))
    return F.aggregate(parts, start(state, F.array().cast(f"array<{kind}>")), chunk, lambda acc: F.struct(acc["s"].alias("s"), F.flatten(acc["out"]).alias("out")))


def verdicts(plays: DataFrame, lim) -> DataFrame:
    """Verdicts on all plays of all runs, each run folded in the order of its ``seq``.

    A play takes far more time than its bytes suggest, so runs are dealt to as many partitions as the session shuffles to,
    which adaptive execution does not merge; no second exchange follows.
    """
    parts = int(plays.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = prepared(plays).repartition(parts, "run_id").groupBy("run_id").agg(F.sort_array(F.collect_list("p")).alias("plays"))
    each = runs.select("run_id", F.explode(folded(F.col("plays"), first_state(), lim)["out"]).alias("r"))
    return each.select("run_id", "r.seq", "r.v.verdict", "r.v.reason", "r.v.trigger", "r.v.consecutive", "r.attempts", "r.v.restored", "r.v.next_quarter")
