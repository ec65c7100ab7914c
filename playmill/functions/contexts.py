"""Whole contexts as columns: verbose records, the compact layout with its mixed arrays, and both ways between them.

The compact record names teams once, lists players as arrays, on-court states once each in order of first appearance, and
plays as arrays of six elements, or seven where points were scored.  Such arrays mix kinds, so they are VARIANTs.  What a
play's words became is an event code; read back, its description says only that.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from playmill.functions import clock, nested, text

PROFILE = ("offense", "defense", "shot_selection", "efficiency")
STATS = ("OEFF", "DEFF", "PACE")
TEAM = f"struct<name:string,stats:struct<{','.join(f'{s}:double' for s in STATS)},REST_DAYS:int>,players:array<struct<name:string,profile:struct<{','.join(f'{p}:double' for p in PROFILE)},MPG:int,usage:int>>>>"
PLAY = "struct<quarter:int,time_remaining:string,score:string,players_on_court:array<struct<team:string,players:array<string>>>,player:string,description:string,shot_details:struct<team:string,points:int>>"
VERBOSE = f"struct<away_team:{TEAM},home_team:{TEAM},recent_plays:array<{PLAY}>>"
#: A compact record as it is read, with arrays of mixed kinds as texts; and the same with its teams as whole texts.
RECORD = "struct<A:string,H:string,as:array<string>,hs:array<string>,ap:array<array<string>>,hp:array<array<string>>,L:array<struct<A:array<double>,H:array<double>>>,p:array<array<string>>>"
TEAM_TEXTS = ("A", "H", "as", "hs", "ap", "hp")
TEXTS = f"struct<{','.join(f'{k}:string' for k in TEAM_TEXTS)},{RECORD[RECORD.index('L:') :]}"
STRICT = {"mode": "FAILFAST"}
#: What stands for a missing rating, rest, profile, minutes, usage, clock and quarter.
DEFAULTS = {"OEFF": 110.0, "DEFF": 110.0, "PACE": 100.0, "REST_DAYS": 2, "profile": 0.0, "MPG": 20, "usage": 15, "clock": "12:00", "quarter": 1}


def _mixed(*values: Column) -> Column:
    """An array of elements of different kinds."""
    return F.array(*[v.cast("variant") for v in values])


def _default(value: Column, name: str) -> Column:
    return F.coalesce(value, F.lit(DEFAULTS[name]))


def _array(value: Column, kind: str) -> Column:
    return F.coalesce(value, F.array().cast(f"array<{kind}>"))


def _ratings(team: Column) -> Column:
    return _mixed(*[F.bround(_default(team["stats"][s], s), 2) for s in STATS], _default(team["stats"]["REST_DAYS"], "REST_DAYS"))


def _roster(team: Column) -> Column:
    profile = lambda p: [F.bround(_default(p["profile"][k], "profile"), 2) for k in PROFILE]
    return F.transform(team["players"], lambda p, i: _mixed(F.coalesce(p["name"], F.concat(F.lit("Player"), i.cast("string"))), *profile(p), _default(p["profile"]["MPG"], "MPG"), _default(p["profile"]["usage"], "usage")))


def facts(play: Column, away: Column, home: Column, away_names: Column, home_names: Column) -> Column:
    """What a play says on its own, given both team codes and rosters; the score before and the line-ups around it come later."""
    on_court = lambda code: F.flatten(F.transform(F.filter(_array(play["players_on_court"], "struct<team:string,players:array<string>>"), lambda t: t["team"] == code), lambda t: t["players"]))
    told = F.struct(text.score_pair(play["score"]).alias("score"), nested.actor(play["player"], play["shot_details"]["team"], away_names, home_names, away, home).alias("who"))
    return nested.let(
        told,
        lambda x: F.struct(
            _default(play["quarter"], "quarter").alias("q"), clock.clock_seconds(_default(play["time_remaining"], "clock")).alias("t"),
            F.coalesce(x["score"]["away"], F.lit(0)).alias("a"), F.coalesce(x["score"]["home"], F.lit(0)).alias("h"), x["who"]["side"].alias("side"), x["who"]["index"].alias("index"),
            F.upper(play["description"]).alias("d"), F.coalesce(text.distance(play["description"]), F.lit("")).alias("feet"), play["shot_details"]["points"].alias("given"),
            F.struct(nested.lineup_key(on_court(away), away_names).alias("A"), nested.lineup_key(on_court(home), home_names).alias("H")).alias("key"),
        ),
    )


def scored(fact: Column, before: Column) -> Column:
    """The points of a play: those given, else what either score grew by since the play before, which may be null."""
    grown = F.greatest(fact["a"] - F.coalesce(before["a"], F.lit(0)), fact["h"] - F.coalesce(before["h"], F.lit(0)), F.lit(0))
    return F.coalesce(fact["given"], grown)


def event(fact: Column, points: Column) -> Column:
    """struct(code, points) of a play whose points are known."""
    return text.worded_event(fact["d"], fact["feet"], points)


def rosters(team: Column) -> Column:
    """The names of a team's players."""
    return F.transform(_array(team["players"], TEAM.partition("players:array<")[2][:-2]), lambda p: p["name"])


def codes(away: Column, home: Column) -> tuple[Column, Column]:
    """The codes of both teams."""
    return F.coalesce(away["name"], F.lit("AWAY")), F.coalesce(home["name"], F.lit("HOME"))


def _head(away: Column, home: Column) -> list[Column]:
    ac, hc = codes(away, home)
    return [ac.alias("A"), hc.alias("H"), _ratings(away).alias("as"), _ratings(home).alias("hs"), _roster(away).alias("ap"), _roster(home).alias("hp")]


def head_text(away: Column, home: Column) -> Column:
    """What a compact record says of its teams, as JSON."""
    return F.to_json(F.struct(*_head(away, home)))


def compact_struct(context: Column) -> Column:
    """The compact record of a verbose context, as a struct whose JSON is the record.

    Contexts that slide over the plays of a table share most plays: ``operators.contexts`` reads each of those once.
    """
    away, home = context["away_team"], context["home_team"]
    away_code, home_code = codes(away, home)
    known = F.struct(away_code.alias("ac"), home_code.alias("hc"), rosters(away).alias("an"), rosters(home).alias("hn"), _array(context["recent_plays"], PLAY).alias("plays"))

    def told(fs: Column, lineups: Column) -> Column:
        """The tuples of plays by their facts and the line-ups of all."""

        def written(f: Column, i: Column) -> Column:
            lineup = F.array_position(lineups, f["key"]).cast("int") - 1
            said = lambda code, points: F.concat(
                _mixed(f["q"], f["t"], F.array(f["a"], f["h"]), _mixed(f["side"], f["index"]), code),
                F.when(points.isNotNull(), _mixed(points)).otherwise(F.array().cast("array<variant>")),
                _mixed(lineup),
            )
            nothing = F.lit(None).cast("int")
            # an offensive foul is a turnover as well
            both = lambda e: F.when(e["code"] == "o_foul", F.array(said(F.lit("o_foul"), nothing), said(F.lit("tov"), nothing))).otherwise(F.array(said(e["code"], e["points"])))
            return nested.let(scored(f, F.get(fs, i - 1)), lambda n: nested.let(event(f, n), both))

        return F.flatten(F.transform(fs, written))

    record = lambda fs, lineups: F.struct(*_head(away, home), lineups.alias("L"), told(fs, lineups).alias("p"))
    read = lambda k: F.transform(k["plays"], lambda p: facts(p, k["ac"], k["hc"], k["an"], k["hn"]))
    return nested.let(known, lambda k: nested.let(read(k), lambda fs: nested.let(F.array_distinct(F.transform(fs, lambda f: f["key"])), lambda lineups: record(fs, lineups))))


def compact_text(context: Column) -> Column:
    """The compact record of a verbose context, as JSON."""
    return F.to_json(compact_struct(context))


def _number(value: Column, kind: str = "int") -> Column:
    return value.cast("double").cast(kind)


def _item(values: Column, i: int, kind: str) -> Column:
    return F.get(values, F.lit(i)) if kind == "string" else _number(F.get(values, F.lit(i)), kind)


def parsed(record: Column, layout: str) -> Column:
    """A record's JSON in a layout; what does not fit it ends the job."""
    return F.from_json(record, layout, STRICT)


def read_teams(v: Column) -> Column:
    """struct(ac, hc, as, hs, ap, hp, an, hn): codes, ratings, rosters and names of both teams of a record in the layout ``RECORD``."""
    profile = lambda p: F.struct(*[_item(p, i + 1, "double").alias(k) for i, k in enumerate(PROFILE)], _item(p, 5, "int").alias("MPG"), _item(p, 6, "int").alias("usage"))
    roster = lambda key: F.transform(_array(v[key], "array<string>"), lambda p: F.struct(_item(p, 0, "string").alias("name"), profile(p).alias("profile")))
    names = lambda key: F.transform(_array(v[key], "array<string>"), lambda p: _item(p, 0, "string"))
    ratings = lambda key: F.struct(*[_default(_item(v[key], i, "double"), s).alias(s) for i, s in enumerate(STATS)], _default(_item(v[key], 3, "int"), "REST_DAYS").alias("REST_DAYS"))
    return F.struct(
        F.coalesce(v["A"], F.lit("AWAY")).alias("ac"), F.coalesce(v["H"], F.lit("HOME")).alias("hc"), ratings("as").alias("as"), ratings("hs").alias("hs"), roster("ap").alias("ap"), roster("hp").alias("hp"),
        names("ap").alias("an"), names("hp").alias("hn"),
    )


def read_plays(r: Column, lineups: Column, tuples: Column) -> Column:
    """The verbose plays of a record's line-ups and tuples, with the teams of ``read_teams``."""

    def fields(held: Column, p: Column, pair: Column) -> Column:
        scored = F.size(p) >= 7
        score, who = F.get(pair, F.lit(0)), F.get(pair, F.lit(1))
        return F.struct(
            _item(p, 0, "int").alias("quarter"), _item(p, 1, "int").alias("seconds"), _number(F.get(score, F.lit(0))).alias("away"), _number(F.get(score, F.lit(1))).alias("home"), _item(who, 0, "string").alias("side"), _item(who, 1, "int").alias("index"),
            _item(p, 4, "string").alias("code"), F.when(scored, _item(p, 5, "int")).alias("points"), F.get(held["L"], F.when(scored, _item(p, 6, "int")).otherwise(_item(p, 5, "int"))).alias("lineup"),
        )

    def play(f: Column) -> Column:
        called = lambda places, names: F.array_compact(F.transform(places, lambda i: F.get(names, i.cast("int"))))
        court = F.array(F.struct(r["ac"].alias("team"), called(f["lineup"]["A"], r["an"]).alias("players")), F.struct(r["hc"].alias("team"), called(f["lineup"]["H"], r["hn"]).alias("players")))
        digits = lambda n: F.lpad(n.cast("string"), 2, "0")
        shown = lambda n: F.coalesce(n.cast("string"), F.lit("null"))
        return F.struct(
            f["quarter"].alias("quarter"),
            F.concat(digits(F.floor(f["seconds"] / 60)), F.lit(":"), digits(f["seconds"] % 60)).alias("time_remaining"),
            F.concat(r["ac"], F.lit(" "), shown(f["away"]), F.lit(" - "), r["hc"], F.lit(" "), shown(f["home"])).alias("score"),
            F.when(f["lineup"].isNotNull(), court).otherwise(F.array().cast("array<struct<team:string,players:array<string>>>")).alias("players_on_court"),
            F.when(f["index"] >= 0, F.when(f["side"] == "A", F.get(r["an"], f["index"])).when(f["side"] == "H", F.get(r["hn"], f["index"]))).alias("player"),
            F.concat(F.lit("Converted from "), f["code"]).alias("description"),
            F.struct(F.when(f["points"].isNotNull(), F.when(f["side"] == "A", r["ac"]).otherwise(r["hc"])).alias("team"), f["points"].alias("points")).alias("shot_details"),
        )

    # scores and actors are arrays within the tuples: all of a record are read at once
    inner = lambda p: F.concat(F.lit("["), F.coalesce(F.get(p, F.lit(2)), F.lit("null")), F.lit(","), F.coalesce(F.get(p, F.lit(3)), F.lit("null")), F.lit("]"))
    pairs = lambda ps: parsed(F.concat(F.lit("["), F.array_join(F.transform(ps, inner), ","), F.lit("]")), "array<array<array<string>>>")
    held = F.struct(_array(lineups, "struct<A:array<double>,H:array<double>>").alias("L"), F.filter(_array(tuples, "array<string>"), lambda p: F.size(p) >= 6).alias("p"))
    each = lambda h, q: F.transform(h["p"], lambda p, i: nested.let(fields(h, p, F.get(q, i)), play))
    return nested.let(held, lambda h: nested.let(pairs(h["p"]), lambda q: each(h, q)))


def verbose(r: Column, plays: Column) -> Column:
    """The verbose context of teams and plays that were read."""
    team = lambda code, stats, players: F.struct(r[code].alias("name"), r[stats].alias("stats"), r[players].alias("players"))
    return F.struct(team("ac", "as", "ap").alias("away_team"), team("hc", "hs", "hp").alias("home_team"), plays.alias("recent_plays"))


def verbose_struct(record: Column) -> Column:
    """The verbose context of a compact record's JSON; plays of fewer than six elements are left out.

    One walk over the text reads it: what is of several kinds comes as text, without a VARIANT for each element.
    """
    return nested.let(parsed(record, RECORD), lambda v: nested.let(read_teams(v), lambda r: verbose(r, read_plays(r, v["L"], v["p"]))))
