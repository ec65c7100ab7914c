"""Medians at every asked day against plain lists; fallback to the season before; rosters."""

import random
import statistics
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from playmill.operators import asof, checks, running
from playmill.operators.running import running_medians

FACTS = "player string, day date, pts double, mins double"


def plain(facts, asked):
    out = set()
    for player, day in {(p, d) for p, d in asked if d is not None}:
        before = [f for f in facts if f[0] == player and f[1] is not None and f[1] < day]
        if before:
            mids = [statistics.median(known) if (known := [f[i] for f in before if f[i] is not None]) else None for i in (2, 3)]
            last = max(f[1] for f in before)
            out.add((player, day, *mids, len(before), last, (day - last).days))
    return out


@pytest.mark.parametrize("bits", [1, 4])
def test_medians_every_day(spark, bits):
    rng = random.Random(5)
    start = date(2020, 1, 1)
    names = ["hot"] * 6 + ["a", "b", None]  # one key holds most rows
    facts = [(rng.choice(names), start + timedelta(rng.randrange(40)), float(rng.choice([3, 3, 3, rng.randrange(200), -2.5])), None if rng.random() < 0.3 else rng.random() * 9) for _ in range(700)]
    facts += [("late", start + timedelta(50), 1.0, None), ("late", start + timedelta(51), 2.0, 4.0), ("hot", None, 5.0, 5.0), facts[0], facts[0]]
    asked = [(f[0], f[1]) for f in facts] + [("late", start + timedelta(60)), ("nobody", start), ("hot", start + timedelta(400)), ("hot", None)]
    found = running_medians(spark.createDataFrame(facts, FACTS), spark.createDataFrame(asked, "player string, day date"), ["player"], "day", ["pts", "mins"], bits)
    assert {tuple(r) for r in found.collect()} == plain(facts, asked)


@pytest.mark.parametrize("limit", [0, 100, 500_000])
def test_groups_above_and_below_the_limit_have_the_same_medians(spark, limit):
    rng = random.Random(7)
    start, odd = date(2020, 1, 1), [float("nan"), float("-inf"), float("inf"), -0.0, 0.0, None]
    facts = [(rng.choice(["hot"] * 6 + ["a", "b", None]), start + timedelta(rng.randrange(40)), float(rng.randrange(30)), rng.choice([*odd, rng.random(), -1.0])) for _ in range(500)]
    facts += [("nans", start + timedelta(d), float("nan"), -0.0) for d in range(5)] + [("a", None, 1.0, 1.0)]
    asked = [(f[0], start + timedelta(rng.randrange(60))) for f in facts[:80]]
    ranked = lambda v: (v != v, v)

    def median(values):
        values = sorted((v for v in values if v is not None), key=ranked)
        return values[len(values) // 2] if len(values) % 2 else (values[len(values) // 2 - 1] + values[len(values) // 2]) / 2 if values else None

    def expected(asked):
        for player, day in {(p, d) for p, d in asked if d}:
            if before := [f for f in facts if f[0] == player and f[1] and f[1] < day]:
                yield str((player, day, *[None if (m := median([f[i] for f in before])) is None else m + 0.0 for i in (2, 3)], len(before)))

    df, days = spark.createDataFrame(facts, FACTS), spark.createDataFrame(asked, "player string, day date")
    shown = lambda found: sorted(str(tuple(r)[:5]) for r in found.collect())
    assert shown(running_medians(df, days, ["player"], "day", ["pts", "mins"], limit=limit)) == sorted(expected(asked))
    assert shown(running_medians(df, None, ["player"], "day", ["pts", "mins"], limit=limit)) == sorted(expected([f[:2] for f in facts]))


def test_ordinary_groups_move_once_and_keep_no_files(spark, monkeypatch):
    """Numbers kept a level and a measure took some thirty times the room of the table."""
    monkeypatch.setattr(running, "_kept", lambda df, label: pytest.fail(f"{label} kept"))
    facts = spark.range(400).selectExpr("id % 7 AS player", "date_add(DATE '2020-01-01', CAST(id % 40 AS INT)) AS day", "CAST(id % 300 AS DOUBLE) AS pts", "CAST(id % 9 AS DOUBLE) AS mins")
    plan = running_medians(facts, None, ["player"], "day", ["pts", "mins"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 1 and "Join" not in plan


def test_no_large_group_passes_the_driver(spark, monkeypatch):
    plans, kept = [], running._kept
    monkeypatch.setattr(running, "_kept", lambda df, label: plans.append(df) or kept(df, label))
    facts = spark.range(400).selectExpr("id % 7 AS player", "date_add(DATE '2020-01-01', CAST(id % 40 AS INT)) AS day", "CAST(id % 300 AS DOUBLE) AS pts")
    plans.append(running_medians(facts, facts, ["player"], "day", ["pts"], limit=50))
    joins = [line for df in plans for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    assert joins and [j for j in joins if "[__part" not in j and "LeftSemi" not in j and "LeftAnti" not in j] == []  # besides a row a range, the names of large groups


def test_no_side_of_a_join_passes_the_driver(spark, monkeypatch):
    """Kept numbers are small as files whatever their rows, so the planner would broadcast them."""
    plans, kept = [], running._kept
    monkeypatch.setattr(running, "_kept", lambda df, label: plans.append(df) or kept(df, label))
    facts = spark.range(400).selectExpr("id % 7 AS player", "date_add(DATE '2020-01-01', CAST(id % 40 AS INT)) AS day", "CAST(id % 300 AS DOUBLE) AS pts")
    plans.append(running_medians(facts, facts, ["player"], "day", ["pts"]))
    joins = [line for df in plans for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    assert [j for j in joins if "[__part" not in j] == []  # a row a range of the whole table is all that may be sent


def test_medians_of_nothing(spark):
    facts, asked = spark.createDataFrame([], FACTS), spark.createDataFrame([("a", date(2020, 1, 1))], "player string, day date")
    assert running_medians(facts, asked, ["player"], "day", ["pts", "mins"]).collect() == []
    some = spark.createDataFrame([("a", date(2020, 1, 1), None, None)], FACTS)
    later = spark.createDataFrame([("a", date(2020, 1, 3))], "player string, day date")
    assert [tuple(r) for r in running_medians(some, later, ["player"], "day", ["pts", "mins"]).collect()] == [("a", date(2020, 1, 3), None, None, 1, date(2020, 1, 1), 2)]


def test_clashing_columns_and_several_keys(spark):
    facts = spark.createDataFrame([(1, "x", date(2020, 1, d), float(d), d) for d in range(1, 8)] + [(1, "y", date(2020, 1, 1), 50.0, 0)], "k int, l string, day date, pts double, __n int")
    got = running_medians(facts, facts, ["k", "l"], "day", ["pts"]).select("l", "as_of_day", "pts", "games").collect()
    assert {tuple(r) for r in got} == {("x", date(2020, 1, d), (1 + d - 1) / 2, d - 1) for d in range(2, 8)}


def test_season_fallback(spark):
    current = spark.createDataFrame([("a", 2001, 3, 9.0), ("a", 2002, 3, 9.0), ("b", 2001, 2, 4.0), ("c", 2001, 5, 7.0), ("d", 2001, 0, 0.0)], "player string, season int, games long, pts double")
    whole = spark.createDataFrame([("a", 2000, 40, 80.0), ("b", 2000, 4, 8.0), ("c", 2000, 60, 70.0), ("d", 2000, 5, 6.0), ("a", 2001, 4, 1.0)], "player string, season int, games long, pts double")
    got = asof.season_fallback(current, whole, "player", "season", ["games", "pts"], least_games=5)
    assert {tuple(r) for r in got.collect()} == {
        ("a", 2001, 3, 2001, 40, 80.0),
        ("a", 2002, 3, None, 3, 9.0),  # four games of the season before are too few
        ("b", 2001, 2, None, 2, 4.0),
        ("c", 2001, 5, None, 5, 7.0),
        ("d", 2001, 0, 2001, 5, 6.0),
    }


def test_rosters(spark):
    sizes = {"none": 0, "few": 4, "five": 5, "many": 15, "crowd": 16}
    rows = spark.createDataFrame([("g", [(t, [f"P{i}" for i in range(n)]) for t, n in sizes.items()]), ("h", []), ("i", None), ("j", [("few", None)])], "game string, teams array<struct<team:string,players:array<string>>>")
    got = {r["game"]: r["r"] for r in rows.select("game", checks.roster(F.col("teams")).alias("r")).collect()}
    assert got["g"]["warnings"] == ["No players found for team: none", "Team few has only 4 players (expected 5+)", "Team crowd has 16 players (unusually high)"]
    assert (got["g"]["is_valid"], got["g"]["team_count"], got["g"]["total_players"], got["g"]["errors"]) == (True, 5, 40, [])
    for game in "hi":
        assert (got[game]["is_valid"], got[game]["team_count"], got[game]["total_players"], got[game]["errors"]) == (False, 0, 0, ["No lineup data provided"])
    assert got["j"]["warnings"] == ["No players found for team: few"] and got["j"]["total_players"] == 0


def test_score_sides(spark):
    from playmill.functions.text import score_pair

    def side(text):
        tokens = text.strip(" ").replace("\t", " ").replace("\n", " ").split(" ")
        token = tokens[-1] if tokens else ""
        body = token[1:] if token[:1] in "+-" and token else token
        return int(token) if body.isdigit() and abs(int(token)) < 2**31 else None

    texts = ["AWY 18 - HOM 11", "18 - 11", " 18  -  11 ", "A 1 - B 2 - C 3", "A 1 - - 5", "A 1 - -5", "A -1 - B +2", "A 1.5 - B 2", "A1 - B 2", "A 1-B 2", "", " - ", "A 1 - ", "A 1\t - B\t2", "A 1 - B 2\n", "A 99999999999 - B 1", "x " * 20000 + "7 - y 8"]
    expected = {}
    for t in texts:
        parts = t.split(" - ")
        both = [side(p) for p in parts] if len(parts) == 2 else [None]
        expected[t] = tuple(both) if None not in both else None
    expected["A 1 - B 2\n"] = None  # a line break behind the number is not trimmed
    got = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", score_pair(F.col("t")).alias("p")).collect()
    assert {r["t"]: None if r["p"] is None else tuple(r["p"]) for r in got} == {**expected, None: None}
