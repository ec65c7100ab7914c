"""Sinks: upserts, JSON lines, CSV, partitioned folders and splits of line files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playmill.operators.runs import latest_per_key
from playmill.operators.sequence import chunk_of


def upsert(held: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``held`` with rows of equal key replaced by ``new``; write the result to another path."""
    both = held.withColumn("__turn", F.lit(0)).unionByName(new.withColumn("__turn", F.lit(1)), allowMissingColumns=True)
    return latest_per_key(both, key, [F.desc("__turn")]).drop("__turn")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a line, nulls written out."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with header."""
    df.write.mode(mode).csv(path, header=True)


def write_by_suffix(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """The format by the suffix of the path, CSV where it says nothing."""
    kind = next((k for k in ("parquet", "json", "orc") if path.endswith("." + k)), "csv")
    writer = df.write.mode(mode)
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)
    return kind


def write_features(df: DataFrame, path: str, partitions: list[str]) -> None:
    """Feature rows by season and day; only the partitions at hand are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def write_per_key(df: DataFrame, path: str, key: str) -> None:
    """JSON files in one folder for each key."""
    df.write.mode("overwrite").partitionBy(key).json(path)


def append_batch(df: DataFrame, path: str) -> None:
    """One batch more."""
    df.write.mode("append").parquet(path)


def replace_table(df: DataFrame, name: str, key: list[str], order: list[Column]) -> None:
    """A managed table with one row for each key."""
    latest_per_key(df, key, order).write.mode("overwrite").saveAsTable(name)


def split_sequential(lines: DataFrame, order: list[str], parts: int, path: str) -> None:
    """Contiguous pieces of equal size, one folder each."""
    chunk_of(lines, order, parts).write.mode("overwrite").partitionBy("chunk").text(path) if lines.columns == ["value"] else chunk_of(lines, order, parts).write.mode("overwrite").partitionBy("chunk").json(path)


def random_part(line: Column, parts: int) -> Column:
    """A repeatable, even assignment of lines to parts."""
    return (F.conv(F.substring(F.md5(line.cast("string")), 1, 8), 16, 10).cast("long") % parts).cast("int")


def concatenate(frames: list[DataFrame], path: str) -> None:
    """Line files one behind the other: part files whose names sort in the order of the frames and of their lines."""
    reduce(DataFrame.union, [df.select("value") for df in frames]).write.mode("overwrite").text(path)


def text_report(title: str, sections: dict[str, DataFrame], rows: int = 50) -> str:
    """A plain report of small result tables."""
    lines = [title, "=" * len(title)]
    for name, df in sections.items():
        shown = df.limit(rows + 1).collect()
        lines += ["", name, "-" * len(name), *("  ".join(f"{c}={r[c]}" for c in df.columns) for r in shown[:rows])]
        lines += ["(more rows are not shown)"] if len(shown) > rows else []
    return "\n".join(lines)
