"""Compact and verbose play records, tuples and JSON as column expressions."""

from __future__ import annotations

import ast
import json
import re

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from playmill.operators.checks import is_json


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it names it.

    The finish of an aggregate over no elements, as an element of a transformed array would be copied whole at each level.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, use)


def roster_index(names: Column, name: Column) -> Column:
    """Place of a name in a roster from 0, else -1."""
    return F.coalesce(F.array_position(names, name).cast("int") - 1, F.lit(-1))


def actor(name: Column, team: Column, away: Column, home: Column, away_team: Column, home_team: Column) -> Column:
    """struct(side, index): by away roster, home roster, then team; default A, -1."""
    pick = lambda side, i: F.struct(F.lit(side).alias("side"), i.cast("int").alias("index"))
    return F.when(F.array_contains(away, name), pick("A", roster_index(away, name))).when(F.array_contains(home, name), pick("H", roster_index(home, name))).when(team == away_team, pick("A", F.lit(-1))).when(team == home_team, pick("H", F.lit(-1))).otherwise(pick("A", F.lit(-1)))


def lineup_key(on_court: Column, roster: Column, size: int = 5) -> Column:
    """Roster places of the first five on court; unknown names and missing players count as 0."""
    places = F.transform(F.slice(F.coalesce(on_court, F.array().cast("array<string>")), 1, size), lambda n: F.greatest(roster_index(roster, n), F.lit(0)))
    return F.slice(F.concat(places, F.array_repeat(F.lit(0), size)), 1, size)


def doubled_turnovers(plays: Column) -> Column:
    """An offensive foul is followed by a turnover of the same play."""
    return F.flatten(F.transform(plays, lambda p: F.when(p["ev"] == "o_foul", F.array(p, p.withField("ev", F.lit("tov")))).otherwise(F.array(p))))


def tuple_text(play: Column) -> Column:
    """[q,t,[a,h],["side",i],"ev"(,points),lineup]: six elements, seven where points were scored."""
    num = lambda c: c.cast("string")
    head = F.concat(F.lit("["), num(play["q"]), F.lit(","), num(play["t"]), F.lit(",["), num(play["a"]), F.lit(","), num(play["h"]), F.lit('],["'), play["side"], F.lit('",'), num(play["idx"]), F.lit('],"'), play["ev"], F.lit('",'))
    points = F.when(F.coalesce(play["pts"], F.lit(0)) > 0, F.concat(num(play["pts"]), F.lit(","))).otherwise("")
    return F.concat(head, points, num(play["lineup"]), F.lit("]"))


def tuple_fields(text: Column) -> Column:
    """struct(q, t, a, h, side, idx, ev, pts, lineup) of a tuple text; null with fewer than six elements or no JSON array."""
    parts = F.from_json(text, "array<string>")
    n = F.size(parts)
    score, who = F.from_json(F.get(parts, F.lit(2)), "array<int>"), F.from_json(F.get(parts, F.lit(3)), "array<string>")
    integer = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    made = F.struct(
        integer(0).alias("q"), integer(1).alias("t"), F.get(score, F.lit(0)).alias("a"), F.get(score, F.lit(1)).alias("h"), F.get(who, F.lit(0)).alias("side"), F.get(who, F.lit(1)).try_cast("int").alias("idx"),
        F.get(parts, F.lit(4)).alias("ev"), F.when(n >= 7, integer(5)).alias("pts"), F.when(n >= 7, integer(6)).otherwise(integer(5)).alias("lineup"),
    )
    return F.when(n >= 6, made)


def is_compact(text: Column) -> Column:
    """Any compact key and no verbose one."""
    keys = F.json_object_keys(text)
    has = lambda *names: F.arrays_overlap(keys, F.array(*[F.lit(n) for n in names]))
    return F.coalesce(has("A", "H", "as", "hs", "ap", "hp", "L", "p") & ~has("away_team", "home_team", "recent_plays"), F.lit(False))


def chat_pair(question: Column, answer: Column) -> Column:
    """{"messages": [user, assistant]} as JSON text."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.to_json(F.struct(F.array(message("user", question), message("assistant", answer)).alias("messages")), {"ignoreNullFields": "false"})


def parts_pair(question: Column, answer: Column) -> Column:
    """{"contents": [user, model]} with text parts, as JSON text."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.array(F.struct(c.alias("text"))).alias("parts"))
    return F.to_json(F.struct(F.array(message("user", question), message("model", answer)).alias("contents")), {"ignoreNullFields": "false"})


def capped_append(items: Column, item: Column, cap: int = 20) -> Column:
    """The item behind the list, the oldest gone beyond ``cap``."""
    grown = F.concat(items, F.array(item))
    return F.slice(grown, F.greatest(F.size(grown) - cap + 1, F.lit(1)), cap)


def quarter_start(plays: Column, quarter: Column) -> Column:
    """The plays without those at 0 seconds, and a fresh play that starts the quarter at the last known score."""
    last = F.when(F.size(plays) > 0, F.element_at(plays, -1))
    score = lambda side: F.coalesce(last[side], F.lit(0))
    fields = {"q": quarter, "t": F.lit(720), "a": score("a"), "h": score("h"), "side": F.lit("A"), "idx": F.lit(-1), "ev": F.lit("quarter_start"), "pts": F.lit(0), "lineup": F.lit(0)}
    kinds = {"side": "string", "ev": "string"}
    start = F.struct(*[v.cast(kinds.get(k, "int")).alias(k) for k, v in fields.items()])
    return F.concat(F.filter(plays, lambda p: p["t"] != 0), F.array(start))


def player_object(name: Column, profile: dict[str, Column], minutes: Column, usage: Column) -> Column:
    """struct(name, profile): scores to two decimals, minutes and usage as whole numbers, halves to even; unknown ones null."""
    scores = [F.bround(c, 2).alias(k) for k, c in profile.items()]
    whole = lambda c: F.when(~F.isnan(c), F.bround(c, 0).cast("int"))
    return F.struct(name.alias("name"), F.struct(*scores, whole(minutes).alias("MPG"), whole(usage).alias("usage")).alias("profile"))


def first_items(items: Column, n: int = 10) -> Column:
    """The first n elements as JSON text."""
    return F.to_json(F.slice(items, 1, n))


CONTENT = re.compile(r'"content":"(?=\{)')
BRACE = re.compile(r"[{}]")


def _with_quoted_contents(line: str) -> str:
    """``line`` with every object that stands bare inside a content string escaped."""
    out, at = [], 0
    while found := CONTENT.search(line, at):
        depth, end = 0, len(line)
        for brace in BRACE.finditer(line, found.end()):
            depth += 1 if brace.group() == "{" else -1
            if not depth:
                end = brace.end()
                break
        out += [line[at : found.end()], line[found.end() : end].replace("\\", "\\\\").replace('"', '\\"')]
        at = end
    return "".join([*out, line[at:]])


def _repaired(line: str | None) -> str | None:
    """JSON of a line that is none: a Python literal, or JSON whose contents lack their escapes."""
    for read in (ast.literal_eval, lambda t: json.loads(_with_quoted_contents(t))):
        try:
            return json.dumps(read(line.strip()), separators=(",", ":")) if line else None
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            continue
    return None


def repaired_json(line: Column) -> Column:
    """The line where it is JSON, what can be read of it as JSON where it is not, else null.

    Only lines that are no JSON go to Python.
    """

    @F.pandas_udf("string")
    def repair(lines: pd.Series) -> pd.Series:
        return lines.map(_repaired, na_action="ignore")

    good = is_json(line)
    return F.when(good, F.trim(line)).otherwise(repair(F.when(~good, line)))
