"""Registry of formatters and the facade that turns plays into training pairs."""

from __future__ import annotations

import argparse
import json
import re
import sys
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playmill.functions import nested

FORMATTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def formatter(name: str):
    """Register a transform of (question, answer) rows into a ``line`` column."""

    def wrap(f):
        FORMATTERS[name] = f
        return f

    return wrap


@formatter("messages")
def messages(pairs: DataFrame) -> DataFrame:
    """The messages layout."""
    return pairs.select(nested.chat_pair(F.col("question"), F.col("answer")).alias("line"))


@formatter("contents")
def contents(pairs: DataFrame) -> DataFrame:
    """The contents layout."""
    return pairs.select(nested.parts_pair(F.col("question"), F.col("answer")).alias("line"))


def training_pairs(plays: DataFrame, n: int, keys: list[str], order: str, value: str) -> DataFrame:
    """(question, answer): the last n values as a JSON array, and the value that follows."""
    w = Window.partitionBy(*keys).orderBy(order)
    context = F.to_json(F.collect_list(value).over(w.rowsBetween(-(n - 1), 0)))
    rows = plays.select(context.alias("question"), F.to_json(F.struct(F.lead(value).over(w).alias("next"))).alias("answer"), F.lead(value).over(w).alias("__next"))
    return rows.where("__next is not null").drop("__next")


def generate(plays: DataFrame, layout: str, n: int = 20, keys: tuple[str, ...] = ("game_id",), order: str = "play_id", value: str = "description") -> DataFrame:
    """Training lines of one layout."""
    return FORMATTERS[layout](training_pairs(plays, n, list(keys), order, value))


def all_layouts(plays: DataFrame, **options) -> DataFrame:
    """(layout, line): the training lines of every registered layout."""
    out = [generate(plays, name, **options).select(F.lit(name).alias("layout"), "line") for name in FORMATTERS]
    return reduce(DataFrame.unionByName, out)


#: Predictors by name: a function of question, context and attempt (from 0) that gives an answer.
PREDICTORS: dict[str, Callable[[str, str, int], str]] = {
    "echo": lambda question, context, attempt: question,
    "countdown": lambda question, context, attempt: f"answer {context}" if attempt >= int(question) else "not yet",
}


def predict(questions: DataFrame, predictor: str, valid: Callable[[str], bool], max_retries: int = 3) -> DataFrame:
    """Adds ``answer`` (the first valid one, else null) and ``attempts``, at most ``max_retries`` + 1.

    ``questions`` has question and context; the predictor runs on the executors, batch by batch.
    """
    ask = PREDICTORS[predictor]

    def one(question: str, context: str) -> tuple[str | None, int]:
        for attempt in range(max_retries + 1):
            if valid(answer := ask(question, context, attempt)):
                return answer, attempt + 1
        return None, max_retries + 1

    def run(batches):
        for rows in batches:
            got = [one(q, c) for q, c in zip(rows["question"], rows["context"])]
            yield rows.assign(answer=[g[0] for g in got], attempts=[g[1] for g in got])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in questions.schema)
    return questions.mapInPandas(run, f"{fields}, answer string, attempts int")


def compare(plays: DataFrame, **options) -> dict[str, int]:
    """Number of lines each layout gives."""
    return {r["layout"]: r["count"] for r in all_layouts(plays, **options).groupBy("layout").count().collect()}


def chosen(plays: DataFrame, games: list[str] | None = None) -> DataFrame:
    """Plays of the named games; None or an empty list stands for all."""
    return plays.where(F.col("game_id").cast("string").isin(games)) if games else plays


def sampled(lines: DataFrame, size: int | None, seed: int = 42) -> DataFrame:
    """All lines, or ``size`` of them that are the same on every run."""
    return lines.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "line")), "line").limit(size) if size else lines


def datasets(spark: SparkSession, folder: str) -> DataFrame:
    """(format, name, files, bytes, modified) of what lies in ``folder``: files by their suffix, and folders of part files."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    root = re.sub(r"^[a-z0-9]+:/*|/+$", "", folder).lstrip("/")
    inside = F.substring_index(F.col("path"), f"/{root}/", -1)
    name = F.substring_index(inside, "/", 1)
    suffix = F.lower(F.regexp_extract(inside, r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(suffix == "", "other").when(suffix == "txt", "jsonl").otherwise(suffix)
    return listed.groupBy(kind.alias("format"), name.alias("name")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("modified"))


def preview(spark: SparkSession, path: str, samples: int = 3, width: int = 200) -> DataFrame:
    """The first lines of a dataset: columns of a CSV file, else role and content of each turn, cut at ``width`` characters."""
    if path.endswith(".csv"):
        return spark.read.option("header", "true").csv(path).limit(samples)
    if not path.endswith((".jsonl", ".txt")) and re.search(r"\.[A-Za-z0-9]+$", path):
        raise ValueError(f"no preview of {path}")
    schema = "messages array<struct<role:string,content:string>>, contents array<struct<role:string,parts:array<struct<text:string>>>>"
    read = spark.read.text(path).limit(samples).select(F.monotonically_increasing_id().alias("line"), F.from_json("value", schema).alias("r"))
    parts = F.transform("r.contents", lambda c: F.struct(c["role"].alias("role"), F.array_join(c["parts"]["text"], "").alias("content")))
    turns = read.select("line", F.posexplode(F.coalesce("r.messages", parts)).alias("turn", "t"))
    cut = F.when(F.length("t.content") > width, F.concat(F.substring("t.content", 1, width), F.lit("..."))).otherwise(F.col("t.content"))
    return turns.select("line", "turn", "t.role", cut.alias("content"))


def settings(path: str, season: str | None = None) -> dict:
    """The settings kept in a JSON file, with a new season if one is given; a season is two years that follow one another."""
    held = json.loads(Path(path).read_text()) if Path(path).exists() else {}
    if season is not None:
        years = re.fullmatch(r"(\d{4})-(\d{4})", season)
        if not years or int(years[2]) != int(years[1]) + 1:
            raise ValueError(f"not a season: {season}")
        held["season"] = season
        Path(path).write_text(json.dumps(held))
    return held


def _parser(names: list[str]) -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="playmill")
    parser.add_argument("--settings", default="playmill.json", help="file of settings")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the queries")
    run = sub.add_parser("run", help="run a query")
    run.add_argument("name", choices=names)
    run.add_argument("data")
    make = sub.add_parser("generate", help="write training lines")
    make.add_argument("data")
    make.add_argument("out")
    make.add_argument("--layout", choices=sorted(FORMATTERS), default="messages")
    make.add_argument("--games", type=lambda t: [g.strip() for g in t.split(",") if g.strip()], help="ids with commas between")
    make.add_argument("--n-total", type=int, default=20, help="plays of context")
    make.add_argument("--sample-size", type=int)
    sub.add_parser("list-datasets", help="what a folder holds").add_argument("folder")
    look = sub.add_parser("preview", help="first lines of a dataset")
    look.add_argument("path")
    look.add_argument("--samples", type=int, default=3)
    config = sub.add_parser("config", help="show or set the season")
    config.add_argument("--set-season")
    config.add_argument("--show", action="store_true")
    return parser


def main(argv: list[str] | None = None) -> int:
    """Command line: list or run queries, write training lines, list and preview datasets, keep settings."""
    from playmill.plans import registry
    from playmill.plans.bindings import relation
    from playmill.session import local_session

    args = _parser(sorted(registry.QUERIES)).parse_args(argv)
    try:
        if args.command == "list":
            print("\n".join(sorted(registry.QUERIES)))
        elif args.command == "run":
            registry.QUERIES[args.name](local_session(), args.data).show(50, truncate=False)
        elif args.command == "generate":
            plays = chosen(relation(local_session(), args.data, "plays"), args.games)
            sampled(generate(plays, args.layout, args.n_total), args.sample_size).write.text(args.out)
        elif args.command == "list-datasets":
            datasets(local_session(), args.folder).orderBy("format", "name").show(1000, truncate=False)
        elif args.command == "preview":
            preview(local_session(), args.path, args.samples).show(1000, truncate=False)
        else:
            print(json.dumps(settings(args.settings, args.set_season)))
    except ValueError as wrong:
        print(wrong, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
