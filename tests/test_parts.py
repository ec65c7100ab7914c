"""Edge cases of scalar rules, sources, sinks and the validator."""

import json

import pytest
from pyspark.sql import functions as F

from playmill import facade
from playmill.functions import clock, maths, nested, text
from playmill.operators import asof, checks, sequence
from playmill.sources import readers, writers
from playmill.streaming import validator


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_scores(spark):
    got = values(spark, text.score_pair(F.col("s")), [("ATL 18 - DET 11",), ("ATL 18.0 - DET 11",), ("n/a",), (None,), ("A 1 - B 2 - C 3",)], "s string")
    assert [tuple(g) if g else None for g in got] == [(18, 11), None, None, None, None]


def test_clocks(spark):
    got = values(spark, clock.clock_seconds(F.col("s")), [("0:11:43",), ("02:05",), ("abc",), ("",), ("12",), (None,)], "s string")
    assert got == [703, 125, 0, 0, 0, 0]
    assert values(spark, clock.prior_season(F.col("s")), [("2023-2024",), ("2023",), (None,)], "s string") == ["2022-2023", None, None]


def test_events(spark):
    c = text.structured_event(F.col("k"), F.col("r"), F.col("e"), F.col("p"), F.col("d"), F.col("s"))
    rows = [("3pt jump shot", "made", "shot", 3, 26.0, None), ("driving layup", "missed", "shot", 0, 2.0, None), ("free throw 1/2", "made", "", 1, None, None), ("offensive foul", "", "foul", 0, None, None), ("", "", "", 0, None, "X"), (None, None, None, None, None, None)]
    got = values(spark, c, rows, "k string, r string, e string, p int, d double, s string")
    assert [tuple(g) for g in got] == [("3pm26", 3), ("layupa2", None), ("ftm", 1), ("o_foul", None), ("stl", None), ("unknown", None)]
    d = text.described_event(F.col("t"), F.lit(None).cast("int"), F.col("n"))
    got = values(spark, d, [("MISS Smith 26' 3PT", 0), ("Tip Dunk", 2), ("Putback", 2), ("Free Throw 1 of 2", 0), (None, 0)], "t string, n int")
    assert [tuple(g) for g in got] == [("3pa26", None), ("tipdunk_m", 2), ("putback2", 2), ("ftx", None), ("unknown", None)]


def test_odds(spark):
    rows = [("+120",), ("-200",), ("150",), ("even",), (None,), ("0",)]
    got = values(spark, maths.implied_probability(F.col("m")), rows, "m string")
    assert [g and round(g, 4) for g in got] == [0.4545, 0.6667, 0.4, None, None, None]
    assert values(spark, maths.kelly_fraction(F.lit(0.9), F.col("m")), rows, "m string") == [0.25, 0.25, 0.25, 0.0, 0.0, 0.0]


def test_tuples(spark):
    assert values(spark, nested.tuple_fields(F.col("t")), [("[1,2,3]",), ("nope",)], "t string") == [None, None]
    got = values(spark, nested.tuple_fields(F.col("t")), [('[4,75,[99,98],["A",-1],"3pm26",3,0]',), ('[1,720,[0,0],["H",2],"sub",1]',)], "t string")
    assert [(g.q, g.a, g.side, g.ev, g.pts, g.lineup) for g in got] == [(4, 99, "A", "3pm26", 3, 0), (1, 0, "H", "sub", None, 1)]


def test_profiles(spark):
    rows = [(1, i, float(i), 2.0 * i, 5.0) for i in range(8)]
    got = {r.name: r.score for r in asof.profile_scores(spark.createDataFrame(rows, "g int, name int, x double, y double, z double"), ["g"], "name", ["x", "y", "z"]).collect()}
    assert got[7] > got[0] and abs(sum(got.values())) < 1e-9


def test_islands(spark):
    rows = [(1, 1, "s", "12:00", "A"), (1, 2, "s", "12:00", "B"), (1, 3, "s", "11:00", "C"), (1, 4, "x", "11:00", "D")]
    out = sequence.collapse_runs(spark.createDataFrame(rows, "g int, i int, t string, c string, a string"), ["g"], "i", "t", "c", "a", F.col("t") == "s", "SUBS")
    assert [(r.i, r.t, r.a) for r in out.orderBy("i").collect()] == [(1, "SUBS: s, s", None), (3, "s", "C"), (4, "x", "D")]


def test_json_rules(spark):
    assert values(spark, checks.is_json(F.col("t")), [('{"a":1}',), ('"k": 1}',), ("",), ("x",)], "t string") == [True, False, False, False]


def test_json_validity_reads_the_whole_line(spark):
    from playmill.plans.quality import json_validity

    df = spark.createDataFrame([(4, ' {"a": "' + "x" * 1100 + '"}')], "event_id long, props string")
    assert [r.valid for r in json_validity(df).collect()] == [True]


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    writers.write_jsonl(df, str(tmp_path / "j"))
    (tmp_path / "j" / "bad.txt").write_text("{oops\n")
    good, bad = readers.read_jsonl(spark, str(tmp_path / "j"), "id int, name string")
    assert sorted(r.id for r in good.collect()) == [1, 2] and bad.count() == 1
    assert json.loads(readers.nth_record(spark, str(tmp_path / "j" / "bad.txt").replace("bad", "part*"), 1))["id"] in (1, 2)
    assert writers.write_by_suffix(df, str(tmp_path / "x.parquet")) == "parquet" and readers.line_count(spark, str(tmp_path / "j")) == 3
    writers.write_csv(df, str(tmp_path / "c[1]"))
    assert readers.read_csv_or_empty(spark, [str(tmp_path / "none"), str(tmp_path / "c*")], "id int, name string").count() == 2
    assert readers.read_csv_or_empty(spark, [str(tmp_path / "none")], "id int, name string").count() == 0
    assert readers.latest_file(spark, str(tmp_path / "*")) is not None
    merged = writers.upsert(df, spark.createDataFrame([(2, "b"), (3, "c")], "id int, name string"), ["id"])
    assert sorted((r.id, r.name) for r in merged.collect()) == [(1, "a"), (2, "b"), (3, "c")]
    writers.split_sequential(spark.range(10), ["id"], 3, str(tmp_path / "s"))
    assert sorted(r["count"] for r in spark.read.json(str(tmp_path / "s")).groupBy("chunk").count().collect()) == [2, 4, 4]
    writers.replace_table(df, "kept_runs", ["id"], [F.desc("name")])
    assert ("kept_runs", "id") in {(r["table"], r["column"]) for r in readers.describe_tables(spark).collect()}
    assert readers.clean_names(spark.createDataFrame([(1,)], ["PLAYER \nFULL NAME"])).columns == ["player_full_name"]
    with pytest.raises(ValueError):
        readers.require_columns(df, ["nope"])


def test_facade(spark):
    plays = spark.createDataFrame([(1, i, f"p{i}") for i in range(5)], "game_id int, play_id int, description string")
    lines = [json.loads(r.line) for r in facade.generate(plays, "messages", n=2).collect()]
    assert len(lines) == 4 and all(json.loads(x["messages"][1]["content"])["next"] for x in lines)
    assert facade.compare(plays) == {"messages": 4, "contents": 4}


PLAYS = [(1, i, 1, 700 - 5 * min(i, 9), i, 0, 1, f"play {i} text {i * 7} more {i * 3}") for i in range(25)] + [(2, i, 4, max(0, 20 - i), 3, i % 4, 0, f"word{i} a{i} b{i}") for i in range(25)]


def test_validator_kinds(spark):
    got = {(r.run_id, r.seq): r.verdict for r in validator.validate(spark.createDataFrame(PLAYS, validator.IN)).collect()}
    assert got[1, 17] == "ROLLBACK_TIME" and got[1, 3] == "VALID"
    assert got[2, 20] == "END_GAME" and got[2, 24] == "END_GAME"


def test_validator_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(PLAYS, validator.IN)
    for k, (low, high) in enumerate([(0, 9), (9, 17), (17, 25)]):
        df.where(f"seq >= {low} and seq < {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(validator.IN).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in" / "*"))
    q = validator.validate_stream(stream).writeStream.format("memory").queryName("verdicts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda rows: sorted((r.run_id, r.seq, r.verdict, r.reason) for r in rows)
    assert key(spark.table("verdicts").collect()) == key(validator.validate(df).collect())
