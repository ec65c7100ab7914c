"""Compact contexts that slide over ordered plays: what a play says on its own is read once, not once for each context it is in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from playmill.functions import contexts, nested
from playmill.operators.sequence import ordered, sliding

#: Stands for the number of a line-up until the context is known; JSON never holds it.
PLACE = "\x00"


def _latest(column: str, w: WindowSpec) -> Column:
    """The last known value up to each row."""
    return F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _tuples(fact: Column, event: Column) -> Column:
    """A play's tuples as JSON but for the line-up; an offensive foul is a turnover as well."""
    num = lambda c: c.cast("string")
    f, rest = fact, F.lit(PLACE + "]")
    start = F.concat(F.lit("["), num(f["q"]), F.lit(","), num(f["t"]), F.lit(",["), num(f["a"]), F.lit(","), num(f["h"]), F.lit('],["'), f["side"], F.lit('",'), num(f["index"]), F.lit('],"'))
    foul = F.concat(start, F.lit('o_foul",'), rest, F.lit(","), start, F.lit('tov",'), rest)
    return F.when(event["code"] == "o_foul", foul).otherwise(F.concat(start, event["code"], F.lit('",'), F.coalesce(F.concat(num(event["points"]), F.lit(",")), F.lit("")), rest))


def compact_windows(plays: DataFrame, teams: tuple[Column, Column], rosters: tuple[Column, Column, Column, Column], keys: list[str], order: list[str], span: int) -> DataFrame:
    """(keys, order, recent, away_team, home_team, record): the last ``span`` plays up to every play and their compact record.

    ``plays`` has the keys, the order and ``play``, a play of the verbose layout; ``teams`` are both teams as columns of
    the keys, ``rosters`` the codes and the players' names of both as columns of ``plays``.  The record equals
    ``contexts.compact_text`` of the whole verbose context.  Rows stay in the order of their keys.
    """
    w = ordered(keys, order)
    read = plays.select(*keys, *order, "play", contexts.facts(F.col("play"), *rosters).alias("f"))
    f, key = F.col("f"), F.to_json("f.key")
    nobody = F.struct(F.lit(0).alias("a"), F.lit(0).alias("h"))
    known = read.withColumn("n", contexts.scored(f, F.lag(F.struct("f.a", "f.h")).over(w))).withColumn("place", F.row_number().over(w)).withColumn("n1", contexts.scored(f, nobody))
    # the first play of a context is held against no score at all
    events = known.select(*keys, *order, "place", "play", "f", key.alias("key"), contexts.event(f, F.col("n1")).alias("e1"), contexts.event(f, F.col("n")).alias("e"))
    # teams are told once for each key, at its first play
    pair = F.struct(teams[0].alias("away_team"), teams[1].alias("home_team"))
    sides = F.when(F.col("place") == 1, nested.let(pair, lambda t: F.struct(t["away_team"].alias("away_team"), t["home_team"].alias("home_team"), contexts.head_text(t["away_team"], t["home_team"]).alias("head"))))
    told = events.select(*keys, *order, sides.alias("sides"), F.struct("play", "key", _tuples(f, F.col("e1")).alias("first"), _tuples(f, F.col("e")).alias("later")).alias("said"))
    rows = told.select(*keys, *order, _latest("sides", w).alias("sides"), sliding(F.col("said"), keys, order, span).alias("said"))
    rows = rows.select(*keys, *order, "sides", F.col("said.play").alias("recent"), "said", F.array_distinct("said.key").alias("lineups"))
    lineup = lambda p: (F.array_position("lineups", p["key"]) - 1).cast("string")
    tuples = F.transform("said", lambda p, i: F.replace(F.when(i == 0, p["first"]).otherwise(p["later"]), F.lit(PLACE), lineup(p)))
    head = F.expr("left(sides.head, length(sides.head) - 1)")
    record = F.concat(head, F.lit(',"L":['), F.array_join("lineups", ","), F.lit('],"p":['), F.array_join(tuples, ","), F.lit("]}"))
    return rows.select(*keys, *order, "recent", "sides.away_team", "sides.home_team", record.alias("record"))


def verbose_windows(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``back``: the verbose context of each ``record``, as ``contexts.verbose_struct`` gives it.

    Records of a key share their teams: those are taken apart where their text is not that of the record before.
    """
    w, had = ordered(keys, order), records.columns
    texts = records.withColumn("v", contexts.parsed(F.col("record"), contexts.TEXTS))
    head = F.struct(*[F.col(f"v.{k}") for k in contexts.TEAM_TEXTS])
    marked = texts.withColumn("new", ~F.lag(head).over(w).eqNullSafe(head))
    read = marked.withColumn("r", F.when(F.col("new"), nested.let(contexts.parsed(F.col("record"), contexts.RECORD), contexts.read_teams)))
    held = read.select(*had, "v", _latest("r", w).alias("r"))
    return held.select(*had, contexts.verbose(F.col("r"), contexts.read_plays(F.col("r"), F.col("v.L"), F.col("v.p"))).alias("back"))
