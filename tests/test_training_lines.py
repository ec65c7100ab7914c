"""Each rule for training lines on a line of its own."""

import copy
import json

from pyspark.sql import functions as F

from playmill.operators import training_lines as rules

PLAY = {"quarter": 1, "time_remaining": "7:05", "description": "Smith 3PT", "score": "A 3 - B 0", "scoring_team": "A", "points_scored": 3}
STATS = {"OEFF": 101.5, "DEFF": 99, "PACE": 98.25, "REST_DAYS": 2}
USER = {"away_team": {"name": "A", "stats": STATS}, "home_team": {"name": "B"}, "players": [], "recent_plays": [{**PLAY, "time_remaining": "7:30"}]}


def line(change=None, user=None, play=None, messages=None):
    u, answer = copy.deepcopy(USER if user is None else user), {"next_play": copy.deepcopy(PLAY if play is None else play)}
    if change:
        change(u, answer)
    return json.dumps({"messages": messages if messages is not None else [{"role": "user", "content": json.dumps(u)}, {"role": "assistant", "content": json.dumps(answer)}]})


def without(d, name):
    return {k: v for k, v in d.items() if k != name}


def test_each_rule(spark):
    turn = lambda role, content="{}": {"role": role, "content": content}
    cases = [
        (line(), ""),
        (None, "error json_format line"),
        ("", "error json_format line"),
        (line()[1:], "error json_format line"),
        (line() + "x", "error json_format line"),
        ("[1]", "error chat_format messages"),
        ('{"messages": "no"}', "error chat_format messages"),
        (line(messages=[turn("user")] * 3), "error chat_format messages"),
        (line(messages=[turn("system"), turn("assistant")]), "error chat_format messages[0].role"),
        (line(messages=[turn("user"), turn("user")]), "error chat_format messages[1].role"),
        (line(messages=[turn("user", "x y"), turn("assistant")]), "error chat_format messages[0].content"),
        (line(messages=[turn("user"), turn("assistant", "")]), "error chat_format messages[1].content"),
        (line(messages=[turn("user"), {"role": "assistant", "content": {"a": 1}}]), "error chat_format messages[1].content"),
        (line(lambda u, a: a.clear()), "error next_play answer.next_play"),
        (line(lambda u, a: u.update(away_team="A")), "error user_context user.away_team"),
        (line(lambda u, a: u["home_team"].update(name="Z")), "warning team_validation user.home_team.name"),
        (line(lambda u, a: u["away_team"]["stats"].update(PACE="fast", REST_DAYS=-1)), "warning team_stats user.away_team.stats.PACE;warning team_stats user.away_team.stats.REST_DAYS"),
        (line(lambda u, a: u["away_team"]["stats"].update(REST_DAYS=1.5)), "warning team_stats user.away_team.stats.REST_DAYS"),
        (line(lambda u, a: u.update(recent_plays={})), "error user_context user.recent_plays"),
        (line(lambda u, a: u.update(recent_plays=[])), ""),
        (line(user=without(USER, "players")), "error user_context user.players"),
        *[(line(lambda u, a, f=f: u["recent_plays"].insert(0, without(PLAY, f))), f"error play_structure user.recent_plays[0].{f}") for f in PLAY],
        (line(play={**PLAY, "quarter": 11}), "warning play_validation next_play.quarter"),
        (line(play={**PLAY, "quarter": "1"}), "warning play_validation next_play.quarter"),
        (line(play={**PLAY, "points_scored": 5}), "warning play_validation next_play.points_scored"),
        (line(play={**PLAY, "points_scored": None}), "warning play_validation next_play.points_scored"),
        *[(line(play={**PLAY, "time_remaining": t}), "error play_validation next_play.time_remaining") for t in ("7:5", "13:00", "7:60", "soon", 7, None)],
        (line(play={**PLAY, "time_remaining": "7:31"}), "error time_consistency next_play.time_remaining"),
        (line(play={**PLAY, "time_remaining": "07:30"}), "warning time_consistency next_play.time_remaining"),
        (line(play={**PLAY, "time_remaining": "12:00", "quarter": 2}), ""),
        *[(line(play={**PLAY, "description": f"a {w} b"}), "error scoring_consistency next_play.points_scored") for w in ("rebound", "SUB", "miss", "Turnover", "foul", "timeout", "violation", "ejection", "technical", "flagrant", "jump ball")],
        (line(play={**PLAY, "description": "a miss", "points_scored": 0}), ""),
        (line(play={**PLAY, "description": "steal"}), ""),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, line string")
    got = {r.i: r.f for r in df.select("i", rules.said(rules.line_findings(F.col("line"), ["A", "B"])).alias("f")).collect()}
    assert got == {i: c[1] for i, c in enumerate(cases)}


def test_elements_that_are_no_objects(spark):
    missing = lambda path: ";".join(sorted(f"error play_structure {path}.{f}" for f in PLAY))
    cases = [
        (line(lambda u, a: u["recent_plays"].insert(0, "words")), missing("user.recent_plays[0]")),
        (line(lambda u, a: u["recent_plays"].insert(0, None)), missing("user.recent_plays[0]")),
        (line(lambda u, a: u["recent_plays"].append(7)), missing("user.recent_plays[1]")),
        (line(lambda u, a: u.update(home_team=None, recent_plays=None)), "error user_context user.home_team;error user_context user.recent_plays"),
        (line(messages=["a", {"role": "assistant"}]), "error chat_format messages[0].role"),
        (line(messages=[None, None]), "error chat_format messages[0].role"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, line string")
    got = {r.i: r.f for r in df.select("i", rules.said(rules.line_findings(F.col("line"), ["A", "B"])).alias("f")).collect()}
    assert got == {i: c[1] for i, c in enumerate(cases)}


def test_each_part_is_read_once(spark):
    """A column named twice is computed twice, so a plan that repeats its parts grows far faster than the rules."""
    plan = spark.createDataFrame([("",)], "line string").where("line > ''").select(rules.line_findings(F.col("line"), ["A", "B"]).alias("f"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("parse_json") == 3  # the line and both contents


def test_play_lists(spark):
    cases = [({"plays": [PLAY] * 50}, ""), ({"plays": []}, "error play_count plays"), ({"plays": [PLAY] * 51}, "error play_count plays"), ({"plays": PLAY}, "error plays plays"), ({}, "error plays plays"), ({"plays": [PLAY, {**PLAY, "quarter": 0}]}, "warning play_validation plays[1].quarter")]
    df = spark.createDataFrame([(i, json.dumps(c[0])) for i, c in enumerate(cases)], "i int, line string")
    got = {r.i: r.f for r in df.select("i", rules.said(rules.play_list_findings(F.col("line"))).alias("f")).collect()}
    assert got == {i: c[1] for i, c in enumerate(cases)}


def test_bound_values_are_not_copied(spark):
    """A bound value is handed on as it is; an element of a transformed array would be copied at every level of a line."""
    from playmill.functions import nested

    df = spark.range(3).select(nested.let(F.struct("id", F.concat(F.lit("n"), F.col("id")).alias("t")), lambda x: F.struct(x["t"].alias("t"), (x["id"] + x["id"]).alias("n"))).alias("v"), nested.let(F.nullif("id", F.lit(1)), lambda x: F.coalesce(x, F.lit(-1))).alias("w"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and plan.count("concat(") == 1
    assert [(r.v.t, r.v.n, r.w) for r in df.collect()] == [("n0", 0, 0), ("n1", 2, -1), ("n2", 4, 2)]


def test_plain_texts_are_read_by_their_schema(spark):
    """Values of a plain text are not taken out of a VARIANT one by one; a text with a null anywhere is, and both ways find the same."""
    fields = rules.context_fields(["A", "B"])
    plain, other = json.dumps(USER), json.dumps({**USER, "more": None})
    found = spark.createDataFrame([(plain,), (other,)], "t string").select(rules._typed(F.col("t"), fields).isNotNull().alias("f")).collect()
    assert [r.f for r in found] == [True, False]
    changes = [
        lambda u, a: None,
        lambda u, a: u["away_team"].update(name=7),
        lambda u, a: u["away_team"].update(name=True, stats=[]),
        lambda u, a: u["away_team"]["stats"].update(OEFF="high", DEFF="NaN", PACE=10**40, REST_DAYS=10**20),
        lambda u, a: u["recent_plays"].append({**PLAY, "quarter": 1.5, "time_remaining": {"x": 1}}),
        lambda u, a: u["recent_plays"].append([PLAY]),
        lambda u, a: a["next_play"].update(description={"a": "miss"}),
        lambda u, a: a["next_play"].update(description="[miss]", quarter="1"),
        lambda u, a: a.update(next_play=[PLAY]),
    ]
    with_null = lambda f: lambda u, a: (f(u, a), u.update(more=None), a.update(more=None))
    df = spark.createDataFrame([(i, line(f), line(with_null(f))) for i, f in enumerate(changes)], "i int, x string, y string")
    got = df.select("i", *[rules.said(rules.line_findings(F.col(c), ["A", "B"])).alias(c) for c in ("x", "y")]).orderBy("i").collect()
    assert [r.x for r in got] == [r.y for r in got]
    assert got[0].x == "" and got[6].x == "" and "scoring_consistency" in got[7].x and "DEFF" in got[3].x and "PACE" not in got[3].x
