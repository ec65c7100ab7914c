"""Streams: late rows, restarts in mid-run, forgotten runs and bounded state."""

import time

from pyspark.sql import functions as F

from playmill.streaming import replay, stateful, validator, windows


def plays_of(spark, rows):
    return spark.createDataFrame(rows, validator.IN + ", batch int")


def words(i):
    return " ".join(f"{a}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i % 10]}" for a in "klmnopq")


def test_restart_in_mid_run_gives_the_verdicts_of_a_batch(spark):
    rows = [(r, i, 1, 700 - 20 * i if i < 9 else 500, 0, 0, 0, words(i), (i + r) // 9) for r in range(3) for i in range(26)]
    df = plays_of(spark, rows)
    got, checkpoint = replay.replayed(df, "batch", 4, stateful.validate_stream)
    want = validator.validate(df.drop("batch"))
    key = lambda d: sorted(map(str, d.collect()))
    assert key(got) == key(want) and "ROLLBACK_TIME" in {r.verdict for r in got.collect()}  # the clock stands over a restart
    held = replay.state_of(spark, checkpoint, "context").groupBy("key").count()
    assert held.count() == 3 and held.agg(F.max("count")).first()[0] <= validator.Limits().context
    assert replay.state_of(spark, checkpoint, "patterns").count() <= 3 * validator.Limits().patterns_held


def test_late_plays_of_a_stream_change_nothing(spark):
    df = plays_of(spark, [(1, 5, 1, 700, 0, 0, 0, "a", 0), (1, 4, 1, 720, 9, 9, 0, "b", 1), (1, 6, 1, 690, 0, 0, 0, "c", 1)])
    got = {r.seq: r.verdict for r in replay.replayed(df, "batch", 2, stateful.validate_stream)[0].collect()}
    assert got == {5: "VALID", 4: "LATE", 6: "VALID"}


def test_silent_runs_are_forgotten(spark):
    df = plays_of(spark, [(1, i, 1, 700 - i, 0, 0, 0, words(i), 0) for i in range(4)] + [(2, 0, 1, 700, 0, 0, 0, "x", 1)])

    def build(stream):
        out = stateful.validate_stream(stream, idle="2 seconds")
        time.sleep(4 if build.calls else 0)
        build.calls += 1
        return out

    build.calls = 0
    got, checkpoint = replay.replayed(df, "batch", 2, build, patience=60, once=True)
    assert got.count() == 5
    assert [r[0].run_id for r in replay.state_of(spark, checkpoint, "patterns").select("key").distinct().collect()] == [2]


def test_late_rows_are_dropped_and_repetitions_written_once(spark):
    rows = [(1, "2024-01-01 00:10:00", 0), (2, "2024-01-01 05:00:00", 0), (1, "2024-01-01 00:10:00", 1), (2, "2024-01-01 05:00:00", 1), (3, "2024-01-01 00:20:00", 1), (4, "2024-01-01 04:30:00", 1), (5, "2024-01-02 00:00:00", 1)]
    df = spark.createDataFrame(rows, "id int, at string, batch int").withColumn("at", F.col("at").cast("timestamp"))
    once = replay.replayed(df, "batch", 2, lambda s: replay.first_deliveries(s, ["id"], "at", "1 hour").select("id"))[0]
    assert sorted(r.id for r in once.collect()) == [1, 2, 4, 5]  # 3 comes behind the mark of 4:00
    hours = lambda s: windows.windowed(s, "at", "1 hour", None, [], [F.count(F.lit(1)).alias("n")], "1 hour").select(F.hour("window.start").alias("hour"), "n")
    counted = replay.replayed(df, "batch", 2, hours)[0]
    assert sorted(map(tuple, counted.collect())) == [(0, 1), (4, 1), (5, 2)]


def test_deliveries_are_worked_out_once(spark):
    """However many deliveries there are, the table behind them is computed a single time."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(60).selectExpr("id", "CAST(id % 3 AS INT) AS batch").mapInArrow(counted, "id long, batch int")
    out, _ = replay.replayed(rows, "batch", 3, lambda s: s.selectExpr("id * 2 AS twice"))
    assert sorted(r.twice for r in out.collect()) == [2 * i for i in range(60)]
    assert seen.value == 60


def test_a_delivery_may_take_longer_than_any_fixed_time(spark, monkeypatch):
    """A delivery of a large table was stopped after ten minutes, which failed the query."""
    from pyspark.sql.streaming import StreamingQuery

    waits, wait = [], StreamingQuery.awaitTermination
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda self, *timeout: waits.append(timeout) or wait(self, *timeout))
    rows = spark.range(20).selectExpr("id", "CAST(id % 2 AS INT) AS batch")
    assert replay.replayed(rows, "batch", 2, lambda s: s)[0].count() == 20
    assert waits == [(), ()]


def test_state_is_called_a_fixed_number_of_times_a_run():
    """A call on state costs as much as many plays; one a pattern and a list of plays ruled the time of large tables."""
    import json

    class Held:
        value, calls = None, 0

        def get(self):
            Held.calls += 1
            return self.value

        def update(self, value):
            Held.calls += 1
            self.value = value

    class Handle:
        def __getattr__(self, kind):
            return lambda *_: Held()

    processor = stateful.ValidatorProcessor(validator.Limits(), None)
    processor.init(Handle())
    texts = ["P1 MISS 3PT", "SUB: P1 FOR P2", "Timeout", "foul", "rebound", "turnover", None]
    plays = [dict(seq=i, quarter=1 + i // 20, seconds=700 if i % 9 < 4 else 700 - i, away=i, home=0, points=i % 4, description=texts[i % 7]) for i in range(60)]
    shown = lambda part: [json.loads(r.said) for r in processor.handleInputRows((1,), iter([(1, json.dumps(p)) for p in reversed(part)]), None)][0]
    got = shown(plays[:25]) + shown(plays[25:])
    assert Held.calls <= 8
    whole = validator.judged([[p.get(c) for c in validator.PLAYED] for p in plays], validator.State(), validator.Limits())
    assert [tuple(v.values()) for v in got] == whole
