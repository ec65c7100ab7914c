"""Folders of SQLite databases as a Spark data source: scans with pushed filters, saves with commit and abort.

A saved folder holds one database for each bucket of the key and manifests that say which file is a bucket's newest.  A
save writes the files of the buckets it touches beside the old ones and then links its manifest into place; until then
readers see the old state, and an aborted save removes what it wrote.  Files of buckets a save does not touch stay as
they are.  Paths are local or mounted ones that driver and executors share, as SQLite opens no others.
"""

from __future__ import annotations

import json
import os
import sqlite3
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from datetime import date, datetime

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema

FORMAT = "database_folder"
BUCKET = "__bucket"
COMPARISONS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def quoted(name: str) -> str:
    """An identifier as SQLite reads it."""
    return '"' + name.replace('"', '""') + '"'


def newest_manifest(folder: str) -> tuple[int, dict[str, str]]:
    """(version, file of each bucket) of the last save; version 0 and nothing where there was none."""
    if not os.path.isdir(folder):
        return 0, {}
    found = max((n for n in os.listdir(folder) if n.startswith("manifest-")), default=None)
    if found is None:
        return 0, {}
    with open(os.path.join(folder, found), encoding="utf-8") as f:
        return int(found[9:-5]), json.load(f)


def _has_table(path: str, table: str) -> bool:
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
        return db.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", (table,)).fetchone() is not None


def _declared(kind: T.DataType) -> str:
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return "BIGINT"  # not INTEGER, which as a key would stand for the row id itself and leave wide gaps in it
    return "REAL" if isinstance(kind, (T.FloatType, T.DoubleType)) else "TEXT"


def _held(column: pa.Array) -> list:
    """Values as a database holds them: times as ISO text of UTC, decimals as text."""
    if pa.types.is_timestamp(column.type):
        column = column.cast(pa.timestamp("us")).cast(pa.string())
    elif pa.types.is_date(column.type) or pa.types.is_decimal(column.type):
        column = column.cast(pa.string())
    return column.to_pylist()


def _read(values: list, kind: pa.DataType) -> pa.Array:
    if pa.types.is_timestamp(kind):
        naive = pa.array(values, pa.string()).cast(pa.timestamp("us"))
        return pc.assume_timezone(naive, "UTC").cast(kind) if kind.tz else naive
    if pa.types.is_date(kind) or pa.types.is_decimal(kind):
        return pa.array(values, pa.string()).cast(kind)
    if pa.types.is_boolean(kind):
        return pa.array([None if v is None else bool(v) for v in values], kind)
    return pa.array(values, kind)


@dataclass
class Piece(InputPartition):
    """Row ids from ``low`` below ``high`` of one database."""

    path: str
    name: str
    low: int
    high: int

    def __post_init__(self):
        super().__init__((self.path, self.low))


class DatabaseReader(DataSourceReader):
    """One partition for each database and range of row ids; comparisons with constants run inside the database."""

    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.table = schema, options["table"]
        self.provenance = options.get("provenance")
        self.rows = int(options.get("rowsPerPartition", 1_000_000))
        if "databases" in options:
            listed = json.loads(options["databases"])
        else:
            listed = {b: os.path.join(options["path"], f) for b, f in newest_manifest(options["path"])[1].items()}
        # what is missing or lacks the table is left out, as one of several sources may not be there yet
        self.found = {name: path for name, path in sorted(listed.items()) if os.path.isfile(path) and _has_table(path, self.table)}
        self.where, self.values = [], []

    def pushFilters(self, filters: list[Filter]):
        types = {f.name: f.dataType for f in self.schema.fields}
        for f in filters:
            name = f.attribute[0]
            plain = len(f.attribute) == 1 and name in types and name != self.provenance
            if plain and isinstance(f, (IsNull, IsNotNull)):
                self.where.append(f"{quoted(name)} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL")
            elif plain and type(f) in COMPARISONS and self._same_order(types[name], f.value):
                self.where.append(f"{quoted(name)} {COMPARISONS[type(f)]} ?")
                self.values.append(f.value.isoformat() if isinstance(f.value, date) else f.value)
            elif plain and isinstance(f, In) and all(self._same_order(types[name], v) for v in f.value):
                self.where.append(f"{quoted(name)} IN ({', '.join('?' * len(f.value))})")
                self.values += [v.isoformat() if isinstance(v, date) else v for v in f.value]
            else:
                yield f

    @staticmethod
    def _same_order(kind: T.DataType, value) -> bool:
        """Whether the database compares such values as Spark does: NaN and times are left to Spark."""
        if isinstance(value, datetime) or value is None or value != value:
            return False
        return isinstance(kind, (T.IntegralType, T.DoubleType, T.BooleanType)) or (isinstance(kind, T.StringType) and isinstance(value, str)) or (isinstance(kind, T.DateType) and isinstance(value, date))

    def partitions(self) -> list[Piece]:
        out = []
        for name, path in self.found.items():
            with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
                cuts = self._cuts(db)
            out += [Piece(path, name, low, high) for low, high in zip(cuts, cuts[1:])]
        return out

    def _cuts(self, db: sqlite3.Connection) -> list[int]:
        """Where ranges of row ids begin, and the end of the last: even ones, or counted ones where ids have wide gaps."""
        low, high, n = db.execute(f"SELECT min(rowid), max(rowid), count(*) FROM {quoted(self.table)}").fetchone()
        if not n:
            return []
        if high - low < 4 * n:
            return [*range(low, high + 1, self.rows), high + 1]
        cuts = [low]
        after = f"SELECT rowid FROM {quoted(self.table)} WHERE rowid >= ? ORDER BY rowid LIMIT 1 OFFSET ?"
        while found := db.execute(after, (cuts[-1], self.rows)).fetchone():
            cuts.append(found[0])
        return [*cuts, high + 1]

    def read(self, piece: Piece | None) -> Iterator[pa.RecordBatch]:
        if piece is None:
            return
        arrow = to_arrow_schema(self.schema)
        stored = [n for n in arrow.names if n != self.provenance]
        with closing(sqlite3.connect(f"file:{piece.path}?mode=ro", uri=True)) as db:
            held = {r[1] for r in db.execute(f"PRAGMA table_info({quoted(self.table)})")}
            asked = ", ".join(quoted(n) if n in held else f"NULL AS {quoted(n)}" for n in stored) or "NULL"
            where = " AND ".join(["rowid >= ? AND rowid < ?", *self.where])
            source = f"(SELECT rowid, {asked} FROM {quoted(self.table)})"
            rows = db.execute(f"SELECT {', '.join(map(quoted, stored)) or 'NULL'} FROM {source} WHERE {where}", (piece.low, piece.high, *self.values))
            while block := rows.fetchmany(10_000):
                columns = dict(zip(stored, zip(*block))) if stored else {}
                made = [pa.array([piece.name] * len(block), pa.string()) if f.name == self.provenance else _read(list(columns[f.name]), f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(made, schema=arrow)


@dataclass
class Written(WriterCommitMessage):
    """Files a task wrote, by bucket."""

    files: dict


class DatabaseWriter(DataSourceArrowWriter):
    """INSERT OR REPLACE into the database of each row's bucket, seen by readers only after commit."""

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.folder, self.table, self.key = options["path"], options["table"], json.loads(options["key"])
        self.schema, self.token = schema, uuid.uuid4().hex
        os.makedirs(self.folder, exist_ok=True)
        self.version, held = newest_manifest(self.folder)
        self.held = {} if overwrite else held

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fields = [f for f in self.schema.fields if f.name != BUCKET]
        names = ", ".join(quoted(f.name) for f in fields)
        made = ", ".join(f"{quoted(f.name)} {_declared(f.dataType)}" for f in fields)
        insert = f"INSERT OR REPLACE INTO {quoted(self.table)} ({names}) VALUES ({', '.join('?' * len(fields))})"
        files, at, db = {}, None, None
        try:
            for batch in iterator:
                buckets = batch.column(BUCKET)
                ends = [*(i for i in range(1, len(buckets)) if buckets[i] != buckets[i - 1]), len(buckets)]
                start = 0
                for end in ends:  # rows come sorted by bucket, so one database is open at a time
                    if end == start:
                        continue
                    bucket = str(buckets[start].as_py())
                    if bucket != at:
                        if db is not None:
                            db.commit()
                            db.close()
                        files[bucket] = f"{self.token}-{bucket}-{uuid.uuid4().hex[:8]}.db"
                        db, at = self._opened(bucket, files[bucket], made), bucket
                    part = batch.slice(start, end - start)
                    db.executemany(insert, zip(*[_held(part.column(f.name)) for f in fields]))
                    start = end
            if db is not None:
                db.commit()
        finally:
            if db is not None:
                db.close()
        return Written(files)

    def _opened(self, bucket: str, file: str, made: str) -> sqlite3.Connection:
        db = sqlite3.connect(os.path.join(self.folder, file), isolation_level="DEFERRED")
        db.execute("PRAGMA journal_mode = OFF")
        db.execute("PRAGMA synchronous = OFF")
        if bucket in self.held:
            with closing(sqlite3.connect(f"file:{os.path.join(self.folder, self.held[bucket])}?mode=ro", uri=True)) as old:
                old.backup(db)
        db.execute(f"CREATE TABLE IF NOT EXISTS {quoted(self.table)} ({made}, PRIMARY KEY ({', '.join(map(quoted, self.key))}))")
        return db

    def commit(self, messages: list[Written | None]) -> None:
        files = {b: f for m in messages if m is not None for b, f in m.files.items()}
        draft = os.path.join(self.folder, f"draft-{self.token}.json")
        with open(draft, "w", encoding="utf-8") as f:
            json.dump({**self.held, **files}, f)
        try:
            os.link(draft, os.path.join(self.folder, f"manifest-{self.version + 1:010d}.json"))  # fails if another save was first
        except FileExistsError:
            self._remove(set())
            raise
        finally:
            os.remove(draft)
        self._remove(set(files.values()))

    def abort(self, messages: list[Written | None]) -> None:
        self._remove(set())

    def _remove(self, kept: set[str]) -> None:
        """Files of this save but those kept: whole aborted saves, or attempts of tasks that did not count."""
        for name in os.listdir(self.folder):
            if name.startswith(self.token) and name not in kept:
                os.remove(os.path.join(self.folder, name))


class DatabaseSource(DataSource):
    """``spark.read.format("database_folder")`` with a schema, ``table`` and a folder or named databases."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def reader(self, schema: T.StructType) -> DatabaseReader:
        # option names come lower-cased
        return DatabaseReader(schema, {{"rowsperpartition": "rowsPerPartition"}.get(k.lower(), k.lower()): v for k, v in self.options.items()})

    def writer(self, schema: T.StructType, overwrite: bool) -> DatabaseWriter:
        return DatabaseWriter(schema, {k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known to the session and let Spark hand it filters."""
    spark.dataSource.register(DatabaseSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def scan(spark: SparkSession, table: str, schema: str, folder: str | None = None, databases: dict[str, str] | None = None, provenance: str | None = None, rows: int = 1_000_000) -> DataFrame:
    """Rows of a table in a saved folder or in named database files; only the columns of ``schema`` are read.

    Databases that are missing or lack the table are left out; a column one of them lacks is null there.  ``provenance``
    names a column that says which database a row is from.  A range of ``rows`` row ids is one partition.
    """
    register(spark)
    reader = spark.read.format(FORMAT).option("table", table).option("rowsPerPartition", rows)
    reader = reader.option("databases", json.dumps(databases)) if databases is not None else reader.option("path", folder)
    if provenance:
        reader, schema = reader.option("provenance", provenance), f"{schema}, {provenance} string"
    return reader.schema(schema).load()


def save(df: DataFrame, folder: str, table: str, key: list[str], order: list[Column], buckets: int = 16) -> None:
    """Insert or replace by primary key: of a batch's rows of one key the last in ``order`` counts.

    Rows of a key are first reduced to one by an aggregate with partial results, so a hot key stays small; a bucket is
    written by one task.  ``buckets`` must stay the same for a folder.  Rows without a key raise an error.
    """
    register(df.sparkSession)
    last = df.groupBy(*key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("__row")).select("__row.*")
    checked = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is null"))).otherwise(F.col(c)).alias(c) if c in key else F.col(c) for c in df.columns]
    placed = last.select(*checked, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias(BUCKET))
    tidy = placed.repartition(buckets, BUCKET).sortWithinPartitions(BUCKET)
    tidy.write.format(FORMAT).mode("append").option("path", folder).option("table", table).option("key", json.dumps(key)).save()
