"""The validator's rules one by one, its state, and the window rules beside it."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from playmill.operators import asof, betting, runs as ops, sequence
from playmill.functions import nested, text
from playmill.streaming import rules, validator
from playmill.streaming.validator import Limits, State, step


def fold(plays, lim=None):
    """Verdicts on (quarter, seconds, away, home, points, text) in order."""
    s, lim = State(), lim or Limits()
    return [step(s, i, *p, lim) for i, p in enumerate(plays)], s


def words(i):
    return " ".join(f"{a}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i % 10]}" for a in "klmnopq")


def test_twelfth_repetition_of_a_pattern():
    got, _ = fold([(1, 700 - 20 * i, 0, 0, 0, f"MAKE {words(i)}") for i in range(13)], Limits(text_strikes=99))
    assert [v.trigger for v in got] == [None] * 11 + ["pattern", None]


@pytest.mark.parametrize("kind, at", [("technical", 3), ("SUB", 4), ("shot", 5)])
def test_ends_of_quarters_without_a_signal(kind, at):
    got, s = fold([(1, 40, 0, 0, 0, words(50))] + [(1, 0, 0, 0, 0, f"{kind} {words(i)}") for i in range(7)])
    first = next(i for i, v in enumerate(got) if v.verdict != "VALID")
    assert (first, got[first].verdict, got[first].next_quarter) == (1 + at, "QUARTER_TRANSITION", 2)


def test_period_in_the_context_ends_a_quarter():
    got, _ = fold([(2, 0, 0, 0, 0, "End of period"), (2, 0, 0, 0, 0, "nothing said")])
    assert [v.verdict for v in got] == ["QUARTER_TRANSITION"] * 2


def test_quarters():
    starts = [(q, t, 0, 0, 0, words(2 * q + k)) for q in range(1, 8) for k, t in enumerate((300, 200))]
    assert [v.trigger for v in fold(starts)[0]].count("quarter") == 0  # quarters 2 to 4 begin far from 720, overtime does not
    far = [(q, 100, 0, 0, 0, words(q)) for q in range(1, 8)]
    assert [v.trigger for v in fold(far)[0]] == [None] * 5 + ["quarter", None]
    assert fold([(1, 700, 0, 0, 0, "a"), (4, 700, 0, 0, 0, "b")])[0][1].trigger == "quarter_skip"
    assert fold([(1, 700, 0, 0, 0, "a"), (5, 290, 0, 0, 0, "b")])[0][1].trigger == "impossible"


def test_situations():
    got, _ = fold([(1, 700 - 20 * i, i, 0, 1, words(i)) for i in range(9)], Limits(text_strikes=99))
    assert [v.trigger for v in got] == [None] * 7 + ["situation", None]
    odd = validator._odd_situation
    assert odd(2, 400, 25, 0, "Timeout") and not odd(2, 100, 25, 0, "Timeout") and odd(2, 400, 16, 0, "intentional foul") and not odd(4, 400, 16, 0, "intentional foul")
    assert odd(4, 20, 2, 0, "slow play") and not odd(4, 20, 1, 0, "slow play") and odd(4, 20, 3, 0, "SUB in") and not odd(1, 400, 0, 1, "free throw")


def test_falls_of_the_score():
    got, s = fold([(1, 700, 20, 10, 0, "a"), (1, 680, 14, 10, 0, "b"), (1, 660, 20, 10, 0, "c"), (1, 640, 16, 10, 0, "d")])
    assert [v.trigger for v in got] == [None, "score", None, "score"] and (s.away, s.home) == (20, 10)  # what fired is not believed
    both, _ = fold([(1, 700 - 20 * i, 20 - i, 20 - i, 0, words(i)) for i in range(4)])
    assert [v.trigger for v in both] == [None, None, None, "score"]  # two teams, two strikes


def test_shots_against_scores():
    lim = Limits()
    for shooter, points, away, fires in (("A", 2, 12, False), ("A", 2, 18, True), ("H", 3, 18, False), (None, 2, 18, False), ("A", 0, 18, False)):
        s = State()
        step(s, 0, 1, 700, 10, 10, 0, "a", lim)
        v = step(s, 1, 1, 690, away, 10, points, "FREE 3 POINTER SHOT", Limits(max_jump=99), shooter)
        assert (v.trigger == "shot") == fires, (shooter, points, away)


def test_impossible_figures():
    s, lim = State(), Limits(clock_strikes=99)
    step(s, 0, 1, 0, 0, 0, 0, "a", lim)
    assert step(s, 1, 1, 721, 0, 0, 0, "b", lim).trigger == "impossible"  # a whole quarter forward
    assert step(s, 2, 1, 700, 0, 0, 0, "c", lim, None, None, ["x", "y", "x"]).trigger == "impossible"
    assert step(s, 3, 1, 690, 0, 0, 5, "d", lim).trigger == "impossible"


@pytest.mark.parametrize("quarter, points, text, player, court, wrong", [
    (1, 3, "MAKE a long SHOT", "", [], True), (1, 3, "MAKE 3PT SHOT", "", [], False), (1, 2, "3 POINTER", "", [], True), (1, 1, "one", "", [], True), (1, 1, "technical", "", [], False),
    (1, 0, "walks", "Ann", ["Bob"], True), (1, 0, "ann walks", "Ann", ["Bob"], False), (1, 0, "walks", "Ann", ["Ann"], False), (1, 0, "walks", "Ann", [], False),
    (1, 0, "SUB 12", "", [], True), (1, 0, "SUB: Ann", "", [], False), (4, 0, "1st quarter", "", [], True), (4, 0, "from 1st to 4th", "", [], False), (3, 0, "1st quarter", "", [], False), (4, 1, "", "Ann", ["Bob"], False),
])
def test_words_that_contradict(spark, quarter, points, text, player, court, wrong):
    assert validator._contradicts(quarter, points, text, player, court) == wrong
    df = spark.createDataFrame([(quarter, points, text, player, court)], "q int, n int, d string, p string, c array<string>")
    assert df.select(rules.contradiction(F.upper("d"), F.col("n"), F.col("q"), F.col("p"), F.col("c"))).first()[0] == wrong


def test_words_of_scoring():
    for text, rose, wrong in (("makes it", False, True), ("misses the SHOT", False, False), ("walks", True, True), ("FOUL", True, False), ("makes it", True, False), ("walks", False, False), ("", True, False)):
        assert validator._misreports(text, rose) == wrong
    got, _ = fold([(1, 700 - 20 * i, 0, 0, 0, f"BASKET {words(i)}") for i in range(8)])
    assert [v.trigger for v in got] == [None] * 6 + ["text", None]


@pytest.mark.parametrize("lim", [Limits(), Limits(fast=True), Limits(text_strikes=99, situation_strikes=3, context=7, patterns_held=3, pattern=4, score_strikes=2, quarter_strikes=2)])
def test_fold_in_the_jvm_equals_step(spark, lim):
    """Random runs, one longer than a chunk, with repeated order keys, null texts and all kinds of odd plays."""
    rng = np.random.default_rng(4)
    texts = ["MAKE layup", "MISS jumper", "SUB: A FOR B", "Timeout", "End of period", "P3 makes 3pt shot", "FREE throw 1", "Foul technical", "unknown", "", None, "slow deliberate sub", "SUB 12", "1st quarter shot"]
    rows = []
    for run in range(30):
        away = home = 0
        quarter, seconds = 1, 720
        for i in range(600 if run == 0 else int(rng.integers(1, 90))):
            points = int(rng.choice([0, 0, 0, 1, 2, 3, 5]))
            away, home = (away + (points if rng.random() < 0.8 else 7), home) if rng.random() < 0.5 else (away, home + points)
            away -= int(rng.choice([1, 2, 5])) if rng.random() < 0.05 else 0
            kind = rng.random()
            if 0.25 < kind < 0.7:
                seconds = max(0, seconds - int(rng.integers(0, 40)))
            elif kind < 0.75:
                seconds += int(rng.choice([0, 5, 20, 800])) if kind > 0.7 else 0
            elif kind < 0.8:
                seconds = 0
            elif kind < 0.84:
                quarter, seconds = (quarter + int(rng.choice([1, 1, 3, 4]))) % 8, int(rng.choice([720, 300, 100]))
            court = [None, [], ["P1", "P2", "P3"], ["P1", "P1"]][int(rng.integers(4))]
            rows.append((run, i, quarter, seconds, away, home, points, texts[int(rng.integers(len(texts)))], [None, "A", "H"][int(rng.integers(3))], [None, "P1", "P9"][int(rng.integers(3))], court))
    rows += [(99, 3, 1, 700, 0, 0, 0, "twice", None, None, None)] * 2
    df = spark.createDataFrame(rows, validator.IN + ", shooter string, player string, court array<string>")
    plain = lambda v: None if v is None or v != v else tuple(v) if not np.isscalar(v) else v
    got = sorted((tuple(map(plain, r)) for r in validator.validate(df, lim).collect()), key=repr)
    own = [validator._fold(pd.DataFrame([r for r in rows if r[0] == run], columns=df.columns), State(), lim) for run in {r[0] for r in rows}]
    want = sorted((tuple(None if x is pd.NA else plain(x) for x in r) for o in own for r in o.astype(object).itertuples(index=False)), key=repr)
    assert got == want
    assert "Python" not in validator.validate(df, lim)._jdf.queryExecution().toString()


def test_rollback_restores_the_context():
    got, s = fold([(1, 700 - 20 * i, 0, 0, 0, words(i)) for i in range(25)] + [(1, 100, 0, 0, 0, words(30 + i)) for i in range(9)])
    last = got[-1]
    assert last.verdict == "ROLLBACK_TIME" and last.restored == list(range(6, 25)) and last.consecutive == 8
    assert [c[0] for c in s.context] == last.restored and s.same_clock == 0 and s.snapshot is None


def test_context_is_bounded():
    _, s = fold([(1, 719 - i % 700, 0, 0, 0, f"MAKE {words(i)}") for i in range(300)])
    assert len(s.context) == 20 and len(s.patterns) <= 50


def test_fast_mode():
    lim = Limits(fast=True)
    assert fold([(4, 0, 5, 5, 9, "x")], lim)[0][0].verdict == "END_GAME"
    got, _ = fold([(1, 300, 0, 0, 50, "same")] * 7, lim)
    assert [v.verdict for v in got] == ["VALID"] * 5 + ["ROLLBACK_TIME", "VALID"]
    admin, _ = fold([(1, 0, 0, 0, 0, "technical"), (1, 0, 0, 0, 0, "timeout"), (1, 0, 0, 0, 0, "shot"), (1, 0, 0, 0, 0, "shot"), (1, 0, 0, 0, 0, "shot")], lim)
    assert [v.verdict for v in admin] == ["VALID"] * 4 + ["QUARTER_TRANSITION"]


def test_low_clock_and_overtime():
    got, _ = fold([(4, 4 - i % 2, 3, 3, 0, words(i)) for i in range(6)])
    assert [v.verdict for v in got] == ["VALID"] * 4 + ["END_GAME"] * 2
    assert fold([(5, 0, 3, 3, 0, "tied")])[0][0].verdict != "END_GAME"


def test_late_plays_change_nothing():
    s, lim = State(), Limits()
    assert step(s, 5, 1, 700, 0, 0, 0, "a", lim).verdict == "VALID"
    assert step(s, 4, 1, 720, 0, 0, 0, "b", lim).verdict == "LATE" and s.seconds == 700


def test_records(spark):
    rows = [(1, i, 1, 500, 0, 0, 0, words(i)) for i in range(10)] + [(2, 0, 4, 0, 9, 8, 0, "end"), (2, 1, 4, 0, 9, 8, 0, "more")]
    plays = spark.createDataFrame(rows, validator.IN)
    got = sorted(map(tuple, validator.with_records(validator.validate(plays), plays).select("run_id", "seq", "type", "trigger", "quarter", "seconds", "away").collect()))
    assert got == [(1, 8, "rollback_time", "same_clock", 1, 500, 0), (2, 0, "game_ended", "quarter_4_time_expired", 4, 0, 9)]


def test_state_expires(spark, tmp_path):
    plays = spark.createDataFrame([(1, i, 1, 700 - i, 0, 0, 0, words(i)) for i in range(5)], validator.IN)
    plays.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(validator.IN).parquet(str(tmp_path / "in"))
    q = validator.validate_stream(stream, idle="1 hour").writeStream.format("memory").queryName("expiring").option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()  # timers always ask for another batch
    q.awaitTermination(120)
    assert spark.table("expiring").count() == 5


def test_window_strikes_equal_a_loop(spark):
    rng = np.random.default_rng(0)
    rows = [(k, i, bool(rng.random() < 0.4)) for k in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, i int, f boolean")
    got = {(r.k, r.i): r.s for r in df.select("k", "i", rules.strikes(F.col("f"), 4, ["k"], "i").alias("s")).collect()}
    count = {}
    for k, i, f in rows:
        count[k] = count.get(k, 0) + f
        fired = f and count[k] == 4
        count[k] = 0 if fired else count[k]
        assert got[k, i] == fired


def test_play_pattern(spark):
    df = spark.createDataFrame([("A long player name", 3, "makes it, assist, foul, sub"), (None, 0, None), ("", 0, "walks")], "p string, n int, d string")
    assert [r[0] for r in df.select(rules.play_pattern(F.col("p"), F.col("n"), F.col("d"))).collect()] == ["PLAYER:A long pla|SHOT:3PT|DESC:MAKE-FOUL-SUB", "GENERIC_PLAY", "GENERIC_PLAY"]


def test_medians_against_plain_ones(spark):
    rng = np.random.default_rng(1)
    days = pd.date_range("2024-01-01", periods=40)
    facts = [(int(rng.integers(3)), days[int(rng.integers(40))].date(), float(rng.integers(9)) if rng.random() < 0.9 else None) for _ in range(200)]
    asked = [(k, days[i].date()) for k in range(4) for i in (0, 7, 8, 39)]
    got = {(r.k, r.as_of_d): r for r in asof.medians_before(spark.createDataFrame(facts, "k int, d date, x double"), spark.createDataFrame(asked, "k int, d date"), "k", "d", ["x"]).collect()}
    for k, d in asked:
        before = [f for f in facts if f[0] == k and f[1] < d]
        if not before:
            assert (k, d) not in got
            continue
        known = [f[2] for f in before if f[2] is not None]
        last = max(f[1] for f in before)
        assert (got[k, d].games, got[k, d].last_day, got[k, d].rest_days) == (len(before), last, (d - last).days)
        assert got[k, d].x == (pytest.approx(np.median(known), abs=0.051) if known else None)


def test_profiles_against_plain_ones(spark):
    rng = np.random.default_rng(2)
    rows = [(g, i, *map(float, rng.standard_normal(3) @ np.array([[1, 0.6, 0.2], [0, 1, 0.5], [0, 0, 1]])), 4.0) for g, n in ((1, 40), (2, 9), (None, 6), (3, 4)) for i in range(n)] + [(1, 99, None, 1.0, 1.0, 1.0)]
    names = ["a", "b", "c", "d"]
    got = {(r.g, r.i): r.score for r in asof.profile_scores(spark.createDataFrame(rows, "g int, i int, a double, b double, c double, d double"), ["g"], "i", names).collect()}
    assert len(got) == 59
    for g in (1, 2, None):
        own = [r for r in rows if r[0] == g and r[2] is not None]
        x = np.array([r[2:] for r in own])
        spread = x.std(axis=0)
        z = (x - x.mean(axis=0)) / np.where(spread > 0, spread, 1)
        v = np.linalg.eigh(z.T @ z)[1][:, -1]
        v *= np.sign(v[np.abs(v).argmax()])
        assert np.allclose([got[g, r[1]] for r in own], z @ v)
    assert all(got[3, i] == 0.0 for i in range(4))


def test_repaired_json(spark):
    cases = {'{"a": 1}': '{"a": 1}', "{'a': (1, None)}": '{"a":[1,null]}', '[{"content":"{"x":"y\\z"}"}]': '[{"content":"{\\"x\\":\\"y\\\\z\\"}"}]', "{broken": None, "": None, " [1,2] ": "[1,2]", "__import__('os')": None, "(" * 5000: None}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    assert {r.t: r.j for r in df.select("t", nested.repaired_json(F.col("t")).alias("j")).collect()} == {**cases, None: None}


def test_quarter_start_without_plays(spark):
    kind = "array<struct<q:int,t:int,a:int,h:int,side:string,idx:int,ev:string,pts:int,lineup:int>>"
    df = spark.createDataFrame([([],), ([(1, 0, 5, 6, "H", 1, "period", 0, 2)],), ([(1, 9, 5, 6, "H", 1, "sub", 0, 2)],)], f"p {kind}")
    got = [[(p.q, p.t, p.a, p.h, p.ev) for p in r[0]] for r in df.select(nested.quarter_start(F.col("p"), F.lit(2))).collect()]
    assert got == [[(2, 720, 0, 0, "quarter_start")], [(2, 720, 5, 6, "quarter_start")], [(1, 9, 5, 6, "sub"), (2, 720, 5, 6, "quarter_start")]]


def test_team_scores(spark):
    df = spark.createDataFrame([(x,) for x in ("LAL 108 - BOS 102", "lal 1, bos 2", "LAL: 3 BOS: 4", "LAL 5 BOS 6", "LAL7-BOS8", " LAL  9 ,BOS 10 ", "L 1 - B 2", "LAL 1 - BOS", None)], "s string")
    got = [r[0] and tuple(r[0]) for r in df.select(text.team_scores(F.col("s"))).collect()]
    assert got == [("LAL", 108, "BOS", 102)] + [("LAL", 2 * i + 1, "BOS", 2 * i + 2) for i in range(5)] + [None] * 3


def test_global_place_and_flat_names(spark):
    df = spark.createDataFrame([(i * 7 % 50, str(i)) for i in range(50)], "n int, s string")
    assert sorted((r.place, r.n) for r in sequence.global_place(df, ["n"], parts=4).collect()) == [(i + 1, i) for i in range(50)]
    assert ops.flat_aggregates(df, ["s"], {"n": ["min", "max"]}, {"^n_": "number_"}).columns == ["s", "number_min", "number_max"]


def test_margins_are_bounded_by_scores(spark):
    runs = spark.createDataFrame([("a", 100 + i % 3, 100) for i in range(30)] + [("b", 90, 95)], "game_id string, away int, home int")
    got = {r.game_id: (r.runs, sorted(map(tuple, r.margins))) for r in betting.margins(runs, "game_id").collect()}
    assert got == {"a": (30, [(0, 10), (1, 10), (2, 10)]), "b": (1, [(-5, 1)])}
