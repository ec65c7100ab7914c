"""Data-quality rules as columns: each rule gives a message or null, a row keeps those that fired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of plays that cannot score.
NON_SCORING = ("REBOUND", "SUB", "MISS", "TURNOVER", "FOUL", "TIMEOUT", "VIOLATION", "EJECTION", "TECHNICAL", "FLAGRANT", "JUMP BALL")


def failed(rules: dict[str, Column]) -> Column:
    """Names of the rules whose condition holds; an unknown condition counts as not holding."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))


def report(df: DataFrame, errors: str = "errors") -> DataFrame:
    """(category, n) over all rows, with the number of valid rows as 'valid'."""
    bad = df.select(F.explode(errors).alias("category"))
    good = df.where(F.size(errors) == 0).select(F.lit("valid").alias("category"))
    return bad.unionByName(good).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def time_rule(quarter: Column, seconds: Column, next_quarter: Column, next_seconds: Column) -> Column:
    """error where time goes up inside a quarter, warning where it stands."""
    same = quarter == next_quarter
    return F.when(same & (next_seconds > seconds), "error").when(same & (next_seconds == seconds), "warning")


def scoring_rule(description: Column, points: Column) -> Column:
    """Points on a play whose words say it cannot score."""
    return (points > 0) & description.rlike("(?i)" + "|".join(NON_SCORING))


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing behind it."""
    wrapped = F.concat(F.lit("["), text, F.lit("]"))
    return F.coalesce(F.try_parse_json(wrapped).isNotNull() & (F.json_array_length(wrapped) == 1), F.lit(False))


def chat_errors(line: Column) -> Column:
    """What is wrong with one chat-format line."""
    schema = "messages array<struct<role:string,content:string>>"
    m = F.from_json(line, schema)["messages"]
    role = lambda i: F.get(m, F.lit(i))["role"]
    return failed({
        "json": ~F.coalesce(is_json(line), F.lit(False)),
        "messages": F.coalesce(is_json(line), F.lit(False)) & m.isNull(),
        "count": F.size(m) != 2,
        "role": (F.size(m) == 2) & ((F.coalesce(role(0), F.lit("")) != "user") | (F.coalesce(role(1), F.lit("")) != "assistant")),
        "content": (F.size(m) == 2) & F.exists(m, lambda x: ~F.coalesce(is_json(x["content"]), F.lit(False))),
    })


def response_errors(line: Column) -> Column:
    """What is wrong with one model response of the verbose layout."""
    r = F.from_json(line, "next_play struct<description:string,quarter:int,time_remaining:string,shot_details:struct<points:int>,players_on_court:array<struct<players:array<string>>>>")["next_play"]
    courts = r["players_on_court"]
    return failed({
        "json": ~F.coalesce(is_json(line), F.lit(False)),
        "next_play": F.coalesce(is_json(line), F.lit(False)) & r.isNull(),
        "description": r.isNotNull() & (F.trim(F.coalesce(r["description"], F.lit(""))) == ""),
        "quarter": r.isNotNull() & ~F.coalesce(r["quarter"].between(1, 10), F.lit(False)),
        "time": r.isNotNull() & ~F.coalesce(r["time_remaining"].rlike(r"^\d{1,2}:\d{2}$"), F.lit(False)),
        "points": ~r["shot_details"]["points"].between(0, 3),
        "players": courts.isNotNull() & ((F.size(courts) != 2) | F.exists(courts, lambda t: F.size(t["players"]) != 5)),
    })


def roster(teams: Column, least: int = 5, most: int = 15) -> Column:
    """What is odd about the rosters of a game, an array of (team, players): whether there are any, and each team's size.

    Fixed values: the messages.  A null array counts as an empty one, a null list of players as no players.
    """
    known = F.coalesce(teams, F.expr("array()").cast("array<struct<team:string,players:array<string>>>"))
    size = lambda t: F.coalesce(F.array_size(t["players"]), F.lit(0))
    warning = lambda t: (
        F.when(size(t) == 0, F.concat(F.lit("No players found for team: "), t["team"]))
        .when(size(t) < least, F.format_string(f"Team %s has only %d players (expected {least}+)", t["team"], size(t)))
        .when(size(t) > most, F.format_string("Team %s has %d players (unusually high)", t["team"], size(t)))
    )
    empty = F.size(known) == 0
    return F.struct(
        (~empty).alias("is_valid"),
        F.array_compact(F.array(F.when(empty, F.lit("No lineup data provided")))).alias("errors"),
        F.array_compact(F.transform(known, warning)).alias("warnings"),
        F.size(known).alias("team_count"),
        F.aggregate(known, F.lit(0), lambda n, t: n + size(t)).alias("total_players"),
    )


def completeness(expected: Column, found: Column) -> Column:
    """complete, nearly complete, partial or missing, by the share found."""
    share = F.try_divide(found, expected)
    return F.when(share >= 0.99, "complete").when(share >= 0.95, "nearly complete").when(share > 0, "partial").otherwise("missing")
