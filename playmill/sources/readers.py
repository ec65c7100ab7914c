"""Sources: seasons, delimited and JSON-lines files, tables, provenance and lookups by key."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def clean_names(df: DataFrame) -> DataFrame:
    """Header texts with white space squeezed, trimmed and lower-cased, other marks as underscores."""
    return df.toDF(*[re.sub(r"[^a-z0-9]+", "_", c.strip().lower()).strip("_") for c in df.columns])


def season_scan(df: DataFrame, season_col: str, season, date_col: str | None = None, max_date=None) -> DataFrame:
    """One season up to a day: both filters reach the scan (partition pruning and pushdown)."""
    out = df.where(F.col(season_col) == F.lit(season))
    return out if max_date is None else out.where(F.col(date_col) <= F.lit(max_date))


def read_season(spark: SparkSession, root: str, season: str, max_date=None, date_col: str = "date", skip_unreadable: bool = False) -> DataFrame:
    """A Parquet folder partitioned by season; a file that cannot be read stops the scan unless it may be skipped."""
    df = spark.read.option("ignoreCorruptFiles", str(skip_unreadable).lower()).option("mergeSchema", "true").parquet(root)
    return season_scan(df, "season", season, date_col, max_date)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV with header; glob marks in the path are taken literally."""
    return spark.read.csv(re.sub(r"([\[\]{}*?])", r"\\\1", path), header=True, schema=schema)


def read_csv_or_empty(spark: SparkSession, paths: list[str], schema: StructType | str) -> DataFrame:
    """The first path that exists, else an empty table of the schema."""
    found = first_existing(spark, paths)
    return read_csv(spark, found, schema) if found else spark.createDataFrame([], schema)


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first path or glob with a match."""
    for path in paths:
        fs, p = _file_system(spark, path)
        if found := fs.globStatus(p):
            return found[0].getPath().toString()
    return None


def latest_file(spark: SparkSession, pattern: str) -> str | None:
    """The match that was modified last, ties by name."""
    fs, p = _file_system(spark, pattern)
    found = sorted((s.getModificationTime(), s.getPath().toString()) for s in (fs.globStatus(p) or []))
    return found[-1][1] if found else None


def files_by_time(spark: SparkSession, pattern: str) -> list[str]:
    """Matches, the last modified first, ties by name."""
    fs, p = _file_system(spark, pattern)
    found = [(-s.getModificationTime(), s.getPath().toString()) for s in (fs.globStatus(p) or [])]
    return [path for _, path in sorted(found)]


def read_jsonl(spark: SparkSession, path: str, schema: str, bad: str = "_bad") -> tuple[DataFrame, DataFrame]:
    """(records, lines that are none): the second keeps the text of what could not be read."""
    record = F.from_json("value", f"{schema}, {bad} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    rows = spark.read.text(path).withColumn("__r", record)
    wrong = F.col("__r").isNull() | F.col(f"__r.{bad}").isNotNull()
    return rows.where(~wrong).select("__r.*").drop(bad), rows.where(wrong).select(F.col("value").alias(bad))


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The table itself, or an error that names what is missing."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def resolve_column(df: DataFrame, candidates: list[str]) -> str:
    """The first candidate the table has."""
    found = next((c for c in candidates if c in df.columns), None)
    if found is None:
        raise ValueError(f"none of {candidates} in {df.columns}")
    return found


def with_provenance(sources: dict[str, DataFrame], column: str = "source_database") -> DataFrame:
    """All rows of all sources with the name of their own; columns may differ."""
    out = None
    for name, df in sources.items():
        tagged = df.withColumn(column, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def cache_key(*parts: Column) -> Column:
    """md5 of the parts joined by underscores: the key of one entity, day and season."""
    return F.md5(F.concat_ws("_", *parts))


def nth_record(spark: SparkSession, path: str, n: int) -> str | None:
    """The n-th line (from 1) of a text file: parts are counted first, then only that line is fetched."""
    rows = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("id"))
    at = n - 1
    for r in rows.groupBy(F.shiftright("id", 33).alias("part")).count().orderBy("part").collect():  # a row for each part
        if at < r["count"]:
            found = rows.where(F.col("id") == (r["part"] << 33) + at).first()
            return found["value"] if at >= 0 else None
        at -= r["count"]
    return None


def line_count(spark: SparkSession, path: str) -> int:
    """Lines of a text file or folder."""
    return spark.read.text(path).count()


def describe_tables(spark: SparkSession) -> DataFrame:
    """(table, column, type) of every table of the current catalog."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table string, column string, type string")


def load_config(path: str) -> dict:
    """A JSON configuration on the driver."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON configuration at any path that Spark can open."""
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


class SeasonCache:
    """Tables kept in memory by season until told otherwise."""

    def __init__(self, load):
        self._load, self._held = load, {}

    def get(self, season: str) -> DataFrame:
        """The season's table, read once."""
        if season not in self._held:
            self._held[season] = self._load(season).cache()
        return self._held[season]

    def info(self) -> list[str]:
        """Seasons held."""
        return sorted(self._held)

    def clear(self) -> None:
        """Forget all."""
        for df in self._held.values():
            df.unpersist()
        self._held.clear()
