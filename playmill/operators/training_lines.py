"""Rules for training lines, compiled into columns: every finding says how bad it is, of what kind and where.

A rule set is data: fields with whether they must be there and what their values must be.  It is compiled once into two
expressions, one over a text read by the schema that the rules name, and one over VARIANTs for texts that do not keep to it,
so a column of JSON lines is checked in one pass, and a wrong line never fails the job.  Severities are ``error`` and ``warning``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from playmill.functions import nested
from playmill.operators.checks import scoring_rule

FINDING = "array<struct<severity:string,category:string,path:string>>"
INTEGER, NUMBER = ("BIGINT",), ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL")


@dataclass(frozen=True)
class Field:
    """One member of an object: what is found where it is missing, of which kind its value is, and rules for it (severity, category, holds).

    A rule sees the value as its kind, null where it is of another. ``fields`` are the members of the object that the value is,
    or of each object of an array where ``many``; ``wrong`` is found where it is neither, ``at`` is its path if not that of its name.
    """

    name: str
    missing: tuple[str, str] | None = None
    kind: str = ""
    rules: tuple[tuple[str, str, Callable[[Column], Column]], ...] = ()
    fields: tuple[Field, ...] = ()
    many: bool = False
    wrong: tuple[str, str] | None = None
    at: str = ""


def kind(node: Column) -> Column:
    """BIGINT, DOUBLE, DECIMAL(4,1), STRING, BOOLEAN, VOID, or how an array or object is built; null where there is no node.

    This walks all below the node, so it is for values that are mostly plain.
    """
    return F.schema_of_variant(node)


def member(node: Column, name: str) -> Column:
    """A member of an object, null where it has none."""
    return F.try_variant_get(node, f"$.{name}", "variant")


def _shape(names: list[str]) -> str:
    return "struct<" + ",".join(f"`{n}`:variant" for n in names) + ">"


def members(node: Column, names: list[str], path: str = "$") -> Column:
    """Members of the object at a path as a struct, read in one walk; null where there is no object."""
    return F.try_variant_get(node, path, _shape(names))


def all_members(node: Column, names: list[str], path: str = "$") -> Column:
    """Members of each element of the array at a path; null where there is no array, and for elements that are no objects.

    A VARIANT taken out of another is built anew, so elements are only taken out where not all are objects.
    """
    return F.coalesce(F.try_variant_get(node, path, f"array<{_shape(names)}>"), F.transform(F.try_variant_get(node, path, "array<variant>"), lambda e: members(e, names)))


def whole(node: Column, holds: Callable[[Column], Column]) -> Column:
    """Whether a node is a whole number that holds."""
    return F.when(kind(node).isin(*INTEGER), holds(F.try_variant_get(node, "$", "bigint")))


def integer(node: Column) -> Column:
    """The value of a whole number, null for all else."""
    return whole(node, lambda n: n)


def is_number(node: Column) -> Column:
    """Whether a node is a number."""
    return kind(node).rlike("^(" + "|".join(NUMBER) + ")\\b")


def words(node: Column) -> Column:
    """The value of a string, null for all else."""
    return F.when(kind(node) == "STRING", F.try_variant_get(node, "$", "string"))


#: Kinds of values: the type they are read as, and how a VARIANT is read as one. A number may be of many types, so it stays one.
KINDS = {
    "whole": ("bigint", integer),
    "number": ("variant", lambda node: F.when(is_number(node), node)),
    "words": ("string", words),
    "clock": ("string", words),  # no other JSON value looks like one
    "": ("string", lambda node: node),
}


def _ddl(fields: tuple[Field, ...]) -> str:
    inner = lambda f: f"struct<{_ddl(f.fields)}>" if f.fields else KINDS[f.kind][0]
    return ",".join(f"`{f.name}`:" + (f"array<{inner(f)}>" if f.many else inner(f)) for f in fields)


def _uncertain(fields: tuple[Field, ...], held: Column) -> list[Column]:
    """Whether a value that was read as a string may be another JSON value in the text."""
    other = lambda v: F.coalesce(v.rlike(r"^(?:[{\[]|(?:true|false|-?\d[\d.eE+-]*)$)"), F.lit(False))
    found = [other(held[f.name]) for f in fields if f.kind == "words"]
    for f in fields:
        if f.fields and not f.many:
            found += _uncertain(f.fields, held[f.name])
        elif f.many and (inner := _uncertain(f.fields, F.col("x"))):
            found += [F.coalesce(F.exists(held[f.name], lambda x, f=f: reduce(Column.__or__, _uncertain(f.fields, x))), F.lit(False))] * bool(inner)
    return found


def _typed(text: Column, fields: tuple[Field, ...]) -> Column:
    """An object whose values all are of the kinds of ``fields``, read straight from JSON; null where any is not, or cannot be told to be.

    A null is no missing member, so no text with one is read so.
    """
    corrupt = "_corrupt_record"
    read = F.from_json(text, f"struct<`{corrupt}`:string,{_ddl(fields)}>", {"columnNameOfCorruptRecord": corrupt, "allowNonNumericNumbers": "false", "mode": "PERMISSIVE"})
    good = lambda r: reduce(Column.__and__, [~u for u in _uncertain(fields, r)], r[corrupt].isNull())
    return F.when((F.substring(text, 1, 1) == "{") & ~text.contains("null"), nested.let(read, lambda r: F.when(good(r), r)))


def _root(text: Column) -> Column:
    """An array of the value of a text that is one JSON value and nothing behind it, else null.

    It is counted as an array of objects with no member of interest, and element by element only where it is none: asking
    for an element that is not there would cost as much as the parsing.
    """
    count = lambda v, of: F.array_size(F.try_variant_get(v, "$", f"array<{of}>"))
    return nested.let(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), lambda v: F.when(F.coalesce(count(v, "struct<` `:variant>"), count(v, "variant")) == 1, v))


def _read(text: Column, fields: tuple[Field, ...]) -> Column:
    """struct(root, typed) of a text: an array of its one JSON value, null where it is no such text; and its typed form, if it has one.

    Nearly all texts have one, and reading it costs a small part of taking kinds and values out of a VARIANT.
    """
    return nested.let(_root(text), lambda v: F.struct(v.alias("root"), F.when(v.isNotNull(), _typed(text, fields)).alias("typed")))


def _either(read: Column, typed: Callable[[Column], Column], loose: Callable[[Column], Column]) -> Column:
    """``typed`` of the typed form of what was read, ``loose`` of its VARIANT where it has none."""
    return F.when(read["typed"].isNotNull(), typed(read["typed"])).otherwise(nested.let(F.try_variant_get(read["root"], "$[0]", "variant"), loose))


def none() -> Column:
    """No findings."""
    return F.array().cast(FINDING)


def _one(severity: str, category: str, path: Column) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), path.alias("path"))


def finding(severity: str, category: str, path: Column) -> Column:
    """One finding as an array."""
    return F.array(_one(severity, category, path))


def noted(*checks: tuple[Column, str, str, Column]) -> Column:
    """A finding for each check (condition, severity, category, path), null where it does not hold or is unknown."""
    return F.array(*[F.when(condition, _one(severity, category, path)) for condition, severity, category, path in checks])


def _checked(fields: tuple[Field, ...], held: Column, path: Column, typed: bool = False) -> Column:
    parts, checks = [], []
    for f in fields:
        at = F.lit(f.at) if f.at else F.concat(path, F.lit("." + f.name))
        there = held[f.name].isNotNull()
        value = held[f.name] if typed and f.kind != "number" else KINDS[f.kind][1](held[f.name])
        checks += [(~there, *f.missing, F.concat(path, F.lit("." + f.name)))] if f.missing else []
        checks += [(there & ~F.coalesce(holds(value), F.lit(False)), severity, category, at) for severity, category, holds in f.rules]
        if f.fields:
            parts += [noted(*checks)] * bool(checks) + [F.when(there, _within(f, value, at, typed)).otherwise(none())]
            checks = []
    parts += [noted(*checks)] * bool(checks)
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _within(f: Field, value: Column, at: Column, typed: bool) -> Column:
    if not typed:
        return each(f.fields, value, at, f.wrong) if f.many else compiled(f.fields, value, at, f.wrong)
    return _of_all(f.fields, value, at, True) if f.many else _checked(f.fields, value, at, True)


def _of_all(fields: tuple[Field, ...], held: Column, path: Column, typed: bool) -> Column:
    place = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
    return F.flatten(F.transform(held, lambda h, i: _checked(fields, h, place(i), typed)))


def compiled(fields: tuple[Field, ...], node: Column, path: Column, wrong: tuple[str, str] | None = None) -> Column:
    """Findings of all fields on one node, in the order of the fields, with nulls for what holds; ``wrong`` where it is no object."""
    told = lambda held: _checked(fields, held, path)
    return nested.let(members(node, [f.name for f in fields]), lambda held: F.when(held.isNull(), finding(*wrong, path)).otherwise(told(held)) if wrong else told(held))


def each(fields: tuple[Field, ...], node: Column, path: Column, wrong: tuple[str, str]) -> Column:
    """The same on each element of an array; ``wrong`` where it is none."""
    return nested.let(all_members(node, [f.name for f in fields]), lambda held: F.when(held.isNull(), finding(*wrong, path)).otherwise(_of_all(fields, held, path, False)))


def _findings(read: Column, fields: tuple[Field, ...], path: str) -> Column:
    """Findings of all fields on what was read of a text."""
    return _either(read, lambda held: _checked(fields, held, F.lit(path), True), lambda v: compiled(fields, v, F.lit(path)))


def is_clock(text: Column) -> Column:
    """Minutes up to 12 and seconds up to 59, as 7:05 or 07:05."""
    return text.rlike(r"^(0?\d|1[0-2]):[0-5]\d$")


def seconds(text: Column) -> Column:
    """Seconds of a clock text, null where it is none."""
    return F.when(is_clock(text), F.split_part(text, F.lit(":"), F.lit(1)).try_cast("int") * 60 + F.split_part(text, F.lit(":"), F.lit(2)).try_cast("int"))


_NEEDED = ("error", "play_structure")
PLAY = (
    Field("quarter", _NEEDED, "whole", (("warning", "play_validation", lambda n: n.between(1, 10)),)),
    Field("time_remaining", _NEEDED, "clock", (("error", "play_validation", is_clock),)),
    Field("description", _NEEDED),
    Field("score", _NEEDED),
    Field("scoring_team", _NEEDED),
    Field("points_scored", _NEEDED, "whole", (("warning", "play_validation", lambda n: n.between(0, 4)),)),
)
STATS = tuple(Field(s, None, "number", (("warning", "team_stats", lambda n: n.isNotNull()),)) for s in ("OEFF", "DEFF", "PACE")) + (Field("REST_DAYS", None, "whole", (("warning", "team_stats", lambda n: n >= 0),)),)
#: The words of the next play are looked into, so they must be a string for certain.
ANSWER = (Field("next_play", ("error", "next_play"), fields=tuple(replace(f, kind="words") if f.name == "description" else f for f in PLAY), at="next_play"),)
PLAYS = (Field("plays", fields=PLAY, many=True),)


def context_fields(teams: list[str]) -> tuple[Field, ...]:
    """The rules of a user context whose team codes should be among ``teams``."""
    team = (Field("name", None, "words", (("warning", "team_validation", lambda v: v.isin(*teams)),)), Field("stats", fields=STATS))
    need = ("error", "user_context")
    side = lambda name: Field(name, need, fields=team, wrong=need)
    return (side("away_team"), side("home_team"), Field("players", need), Field("recent_plays", need, fields=PLAY, many=True, wrong=need))


def _consistency(user: Column, answer: Column) -> Column:
    """The next play against the last recent one, and its points against its words."""
    kinds = {"quarter": integer, "time_remaining": words, "description": words, "points_scored": integer}
    names = list(kinds)
    facts = lambda p, of: F.struct(*[p[n].alias(n) for n in of])
    loose = lambda p, of: F.struct(*[kinds[n](p[n]).alias(n) for n in of])
    last = lambda plays: F.try_element_at(plays, F.lit(-1))
    before = _either(user, lambda u: nested.let(last(u["recent_plays"]), lambda p: facts(p, names[:2])), lambda v: nested.let(last(all_members(v, names[:2], "$.recent_plays")), lambda p: loose(p, names[:2])))
    after = _either(answer, lambda a: facts(a["next_play"], names), lambda v: nested.let(members(v, names, "$.next_play"), lambda p: loose(p, names)))
    at = F.lit("next_play.time_remaining")

    def told(x: Column) -> Column:
        return noted(
            (x["same"] & (x["now"] > x["before"]), "error", "time_consistency", at),
            (x["same"] & (x["now"] == x["before"]), "warning", "time_consistency", at),
            (scoring_rule(x["b"]["description"], x["b"]["points_scored"]), "error", "scoring_consistency", F.lit("next_play.points_scored")),
        )

    def compared(x: Column) -> Column:
        a, b = x["a"], x["b"]
        return nested.let(F.struct(b.alias("b"), (a["quarter"] == b["quarter"]).alias("same"), seconds(a["time_remaining"]).alias("before"), seconds(b["time_remaining"]).alias("now")), told)

    return nested.let(F.struct(before.alias("a"), after.alias("b")), compared)


def _messages(root: Column) -> Column:
    """Messages of a chat line as array of struct(role, content), both null where they are no strings; null where there are none.

    The kinds of a plain line are told at once.
    """
    told = lambda m: F.struct(words(m["role"]).alias("role"), words(m["content"]).alias("content"))
    plain = kind(root) == "ARRAY<OBJECT<messages: ARRAY<OBJECT<content: STRING, role: STRING>>>>"
    typed = F.try_variant_get(root, "$[0].messages", "array<struct<role:string,content:string>>")
    return F.when(plain, typed).otherwise(F.transform(all_members(root, ["role", "content"], "$[0].messages"), told))


def line_findings(line: Column, teams: list[str]) -> Column:
    """All findings of a chat-format training line.

    A line that is no JSON, or whose messages are not a user's and an assistant's with JSON contents, has one finding
    and is looked at no further; null counts as no JSON.  All other rules are independent of each other.

    Every part is read once and bound to a name, as a column that is named twice is computed twice.
    """
    bad = lambda path: finding("error", "chat_format", F.lit(path))
    context = context_fields(teams)

    def checked(x: Column) -> Column:
        return (
            F.when(x["user"]["root"].isNull(), bad("messages[0].content"))
            .when(x["answer"]["root"].isNull(), bad("messages[1].content"))
            .otherwise(F.array_compact(F.concat(_findings(x["user"], context, "user"), _findings(x["answer"], ANSWER, "answer"), _consistency(x["user"], x["answer"]))))
        )

    def said_by(m: Column) -> Column:
        return (
            F.when(F.coalesce(m["first"]["role"], F.lit("")) != "user", bad("messages[0].role"))
            .when(F.coalesce(m["second"]["role"], F.lit("")) != "assistant", bad("messages[1].role"))
            .otherwise(nested.let(F.struct(_read(m["first"]["content"], context).alias("user"), _read(m["second"]["content"], ANSWER).alias("answer")), checked))
        )

    def chat(root: Column) -> Column:
        pair = lambda messages: F.struct(F.get(messages, F.lit(0)).alias("first"), F.get(messages, F.lit(1)).alias("second"))
        both = nested.let(_messages(root), lambda m: F.when(F.size(m) == 2, nested.let(pair(m), said_by)).otherwise(bad("messages")))
        return F.when(root.isNull(), finding("error", "json_format", F.lit("line"))).otherwise(both)

    return nested.let(line, lambda text: nested.let(_root(text), chat))


def play_list_findings(response: Column, least: int = 1, most: int = 50) -> Column:
    """Findings of a response that holds a list of ``least`` to ``most`` plays."""

    def checked(read: Column) -> Column:
        size = _either(read, lambda r: F.size(r["plays"]), lambda v: F.size(F.try_variant_get(v, "$.plays", "array<variant>")))
        count = noted((~size.between(least, most), "error", "play_count", F.lit("plays")))
        wrong = ("error", "plays")
        typed = lambda r: F.when(r["plays"].isNull(), finding(*wrong, F.lit("plays"))).otherwise(_of_all(PLAY, r["plays"], F.lit("plays"), True))
        plays = _either(read, typed, lambda v: nested.let(member(v, "plays"), lambda p: each(PLAY, p, F.lit("plays"), wrong)))
        return F.when(read["root"].isNull(), finding("error", "json_format", F.lit("line"))).otherwise(F.array_compact(F.concat(count, plays)))

    return nested.let(response, lambda text: nested.let(_read(text, PLAYS), checked))


def said(findings: Column) -> Column:
    """Findings as sorted text."""
    return F.array_join(F.array_sort(F.transform(findings, lambda f: F.concat_ws(" ", f["severity"], f["category"], f["path"]))), ";")
