"""Verbose and compact contexts: a worked example, both ways, and what is missing."""

import json

from pyspark.sql import functions as F

from playmill.functions import contexts


def team(name, players, **stats):
    profile = {"offense": 1.125, "defense": -0.5, "shot_selection": 0.0, "efficiency": 2.0, "MPG": 30, "usage": 21}
    return {"name": name, "stats": stats, "players": [{"name": n, "profile": profile} for n in players]}


def play(quarter, clock, score, player, description, away, home, side=None, points=None):
    court = [{"team": "CLE", "players": away}, {"team": "IND", "players": home}]
    return {"quarter": quarter, "time_remaining": clock, "score": score, "players_on_court": court, "player": player, "description": description, "shot_details": {"team": side, "points": points}}


AWAY, HOME = ["a", "b", "c", "d", "e", "f"], ["u", "v", "w", "x", "y", 'z"q']
EXAMPLE = {
    "away_team": team("CLE", AWAY, OEFF=117.9, DEFF=109.0, PACE=95.625, REST_DAYS=2),
    "home_team": team("IND", HOME, OEFF=115.7, DEFF=116.8, PACE=101.1, REST_DAYS=1),
    "recent_plays": [
        play(1, "11:43", "CLE 3 - IND 0", "b", "b 26' 3PT jump shot", AWAY[:5], HOME[:5], "CLE", 3),
        play(1, "11:20", "CLE 3 - IND 0", "v", "offensive foul", AWAY[:5], HOME[:5], "IND"),
        play(1, "10:05", "CLE 3 - IND 0", None, "SUB", AWAY[1:], HOME[:5], "CLE"),
        play(1, "09:00", "CLE 3 - IND 2", 'z"q', "driving layup", AWAY[:5], HOME[1:], "IND"),
    ],
}


def compact(spark, record):
    df = spark.createDataFrame([(json.dumps(record),)], "t string").withColumn("v", F.from_json("t", contexts.VERBOSE))
    return json.loads(df.select(contexts.compact_text(F.col("v"))).first()[0])


def test_compact_record(spark):
    got = compact(spark, EXAMPLE)
    assert list(got) == ["A", "H", "as", "hs", "ap", "hp", "L", "p"]
    assert (got["A"], got["as"], got["hs"]) == ("CLE", [117.9, 109.0, 95.62, 2], [115.7, 116.8, 101.1, 1])
    assert got["ap"][0] == ["a", 1.12, -0.5, 0.0, 2.0, 30, 21] and got["hp"][5][0] == 'z"q'
    assert got["L"] == [{"A": [0, 1, 2, 3, 4], "H": [0, 1, 2, 3, 4]}, {"A": [1, 2, 3, 4, 5], "H": [0, 1, 2, 3, 4]}, {"A": [0, 1, 2, 3, 4], "H": [1, 2, 3, 4, 5]}]
    assert [len(p) for p in got["p"]] == [7, 6, 6, 6, 7]
    assert got["p"][0] == [1, 703, [3, 0], ["A", 1], "3pm26", 3, 0]
    assert got["p"][1] == [1, 680, [3, 0], ["H", 1], "o_foul", 0] and got["p"][2] == [1, 680, [3, 0], ["H", 1], "tov", 0]
    assert got["p"][3][3] == ["A", -1] and got["p"][3][-1] == 1 and got["p"][4][-1] == 2


def test_there_and_back(spark):
    record = compact(spark, EXAMPLE)
    df = spark.createDataFrame([(json.dumps(record),)], "t string").select(F.to_json(contexts.verbose_struct(F.col("t")), {"ignoreNullFields": "false"}))
    back = json.loads(df.first()[0])
    assert back["away_team"]["stats"] == {"OEFF": 117.9, "DEFF": 109.0, "PACE": 95.62, "REST_DAYS": 2} and [p["name"] for p in back["home_team"]["players"]] == HOME
    told = [EXAMPLE["recent_plays"][i] for i in (0, 1, 1, 2, 3)]
    for ours, theirs in zip(back["recent_plays"], told, strict=True):
        assert {k: ours[k] for k in ("quarter", "time_remaining", "score", "player", "players_on_court")} == {k: theirs[k] for k in ("quarter", "time_remaining", "score", "player", "players_on_court")}
    assert back["recent_plays"][0]["shot_details"] == {"team": "CLE", "points": 3} and back["recent_plays"][1]["description"] == "Converted from o_foul"


def test_what_is_missing(spark):
    empty = compact(spark, {})
    assert (empty["A"], empty["H"], empty["as"], empty["L"], empty["p"]) == ("AWAY", "HOME", [110.0, 110.0, 100.0, 2], [], [])
    bare = compact(spark, {"away_team": {"name": "X", "players": [{"profile": None}]}, "recent_plays": [{"score": "odd"}]})
    assert bare["ap"] == [["Player0", 0.0, 0.0, 0.0, 0.0, 20, 15]] and bare["p"] == [[1, 720, [0, 0], ["A", -1], "unknown", 0]]
    df = spark.createDataFrame([('{"A":"X","p":[[1,2]]}',), (None,)], "t string").select(contexts.verbose_struct(F.col("t")).alias("v"))
    first, second = [r.v for r in df.collect()]
    assert first.away_team.name == "X" and first.recent_plays == [] and second.home_team.name == "HOME" and second.recent_plays == []


def test_windows_equal_whole_contexts(spark):
    """Records of sliding windows are those of the whole verbose contexts, with each play's texts read below the window only."""
    from playmill.operators.contexts import compact_windows, verbose_windows

    odd = [play(1, "08:00", "odd", "nobody", None, AWAY[2:], [], "IND"), play(None, None, None, "a", "PUTBACK offensive foul", [], HOME, "CLE"), play(2, "08:00", "CLE 5 - IND 2", "a", "PUTBACK offensive foul", AWAY, HOME, None)]
    told = [json.dumps(p) for p in EXAMPLE["recent_plays"] + odd]
    plays = spark.createDataFrame([(g, i, t) for g in ("x", "y") for i, t in enumerate(told)], "g string, i int, t string").select("g", "i", F.from_json("t", contexts.PLAY).alias("play"))
    teams = tuple(F.from_json(F.lit(json.dumps(EXAMPLE[side])), contexts.TEAM) for side in ("away_team", "home_team"))
    rosters = (F.lit("CLE"), F.lit("IND"), F.array(*map(F.lit, AWAY)), F.array(*map(F.lit, HOME)))
    got = compact_windows(plays, teams, rosters, ["g"], ["i"], 3)
    assert "regexp_extract" not in got._jdf.queryExecution().optimizedPlan().toString().split("collect_list")[0]
    both = verbose_windows(got, ["g"], ["i"]).select(F.to_json("back").alias("ours"), F.to_json(contexts.verbose_struct(F.col("record"))).alias("theirs")).collect()
    assert len(both) == 2 * len(told) and all(r.ours == r.theirs for r in both)
    whole = F.struct("away_team", "home_team", F.col("recent").alias("recent_plays")).cast(contexts.VERBOSE)
    rows = got.select("record", contexts.compact_text(whole).alias("theirs")).collect()
    assert len(rows) == 2 * len(told) and all(r.record == r.theirs for r in rows)
    assert any('"o_foul"' in r.record for r in rows) and any('"putback2"' in r.record for r in rows)


def test_reading_builds_no_variants(spark):
    """A compact record is read in one walk; numbers with a fraction of nothing are whole numbers."""
    df = spark.createDataFrame([('{"ap":[["a",1,2,3,4,30.0,21]],"L":[{"A":[0.0],"H":[]}],"p":[[1.0,65,[3,0],["A",0],"2pm",2,0],[1,60,[3,0],["H",-1],"tov",7]]}',)], "t string").select(contexts.verbose_struct(F.col("t")).alias("v"))
    assert "variant" not in df._jdf.queryExecution().optimizedPlan().toString()
    v = df.first().v
    first, second = v.recent_plays
    assert (first.quarter, first.time_remaining, first.score, first.player, first.players_on_court[0].players, first.shot_details.points) == (1, "01:05", "AWAY 3 - HOME 0", "a", ["a"], 2)
    assert second.players_on_court == [] and second.player is None and v.away_team.players[0].profile.MPG == 30
