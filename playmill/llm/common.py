"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folders written by ``materialize``, one list for each ``scratch_scope`` that is open.
_scopes: list[list[str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where it is unset, a temporary one of a local session."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        held = tempfile.mkdtemp(prefix="playmill-")
        spark.sparkContext.setCheckpointDir(held)
    return held.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """Collects the folders that ``materialize`` writes meanwhile."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield paths
    finally:
        _scopes.pop()


def drop_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of ``materialize`` that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in paths:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def columns_of(df: DataFrame, *but: str) -> list[Column]:
    """All columns but ``but``, whatever marks their names hold."""
    return [F.col(quoted(c)).alias(c) for c in df.columns if c not in but]


def quoted(name: str) -> str:
    """A column name as one identifier."""
    return "`" + name.replace("`", "``") + "`"


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def restrict(docs: DataFrame, ids: DataFrame, how: str = "left_semi", limit: int = 2_000_000) -> DataFrame:
    """Rows of ``docs`` whose doc_id is (left_semi) or is not (left_anti) in ``ids`` (distinct doc_id).

    Up to ``limit`` ids, counted here, are broadcast (16 MB), so texts stay where they are; more meet in a shuffle.
    """
    ids = ids.select("doc_id").where("doc_id is not null")
    return docs.join(F.broadcast(ids) if ids.count() <= limit else ids, "doc_id", how).select(*columns_of(docs))


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: str, filler: Column, hot_share: int = 10_000) -> DataFrame:
    """Left join of ``left`` with ``right``, which has one row for each key and in ``rows`` how many of ``left`` have it.

    Keys of more than 1 / ``hot_share`` of these rows are at most ``hot_share`` many; they are broadcast, and what they
    fit gets ``filler`` (a value of the key's type that spreads the rows) for a key in the shuffle of all others.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    values = [c for c in right.columns if c not in (key, rows)]
    kept = left.columns
    hot = right.where(F.col(rows) * hot_share > total).select(key, F.struct(*values).alias("__hot"))
    cold = right.where(F.col(rows) * hot_share <= total).select(F.col(key).alias("__key"), F.struct(*values).alias("__cold"))
    met = left.join(F.broadcast(hot), key, "left").withColumn("__key", F.when(F.col("__hot").isNull(), F.col(key)).otherwise(filler))
    both = met.join(cold, "__key", "left")
    return both.select(*kept, *[F.when(F.col("__hot").isNotNull(), F.col(f"__hot.{v}")).otherwise(F.col(f"__cold.{v}")).alias(v) for v in values])


def parts_for(rows: int, a_part: int = 200_000, least: int = 64, most: int = 65_536) -> int:
    """Into how many parts ``global_rank`` should deal a group of ``rows`` rows."""
    return int(min(most, max(least, -(-rows // a_part))))


def global_rank(df: DataFrame, group: str, order: list[str], spread_on: list[str], buckets: int) -> DataFrame:
    """Add ``rank`` (long, gapless from 0 inside each ``group``) without bringing a group into one task.

    Rows of a group are dealt to ``buckets`` parts by a hash of ``spread_on``; each part is numbered on its own
    and shifted by the sizes of the parts before it.  The table of part sizes has at most groups x buckets rows.
    """
    dealt = df.withColumn("__part", F.pmod(F.xxhash64(*spread_on), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        dealt.groupBy(group, "__part")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(group, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    within = Window.partitionBy(group, "__part").orderBy(*order)
    return (
        dealt.withColumn("__rn", F.row_number().over(within))
        .join(sizes, [group, "__part"])
        .withColumn("rank", F.col("__before") + F.col("__rn") - 1)
        .drop("__part", "__rn", "__before")
    )


def range_rank(df: DataFrame, group: str, order: list[str], parts: int, limit: int = 200_000) -> DataFrame:
    """Add ``rank`` (long, gapless from 0 inside each ``group`` by ``order``) and ``members`` (rows of the group); group is not null.

    Rows are dealt to ``parts`` ranges of group, order and a random number, so neither a group nor rows equal in all of
    these come into one task; each range is numbered where it lies.  The table of (group, range) sizes has at most as
    many rows as there are groups and ranges; up to ``limit`` of them, counted here, are broadcast.  ``df`` must give the same rows in
    the same order whenever it is read, as a table that was written does.
    """
    keys = [group, *order, "__salt"]
    salted = df.withColumn("__salt", F.rand(11))
    placed = materialize(salted.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("__salt").withColumn("__at", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    own = Window.partitionBy(group)
    sizes = placed.groupBy(group, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    sizes = sizes.select(
        group,
        "__part",
        (F.coalesce(F.sum("__n").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("__first")).alias("__shift"),
        F.sum("__n").over(own).alias("members"),
    )
    sizes = materialize(sizes, "range-sizes")
    met = placed.join(F.broadcast(sizes) if sizes.count() <= limit else sizes, [group, "__part"])
    return met.withColumn("rank", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")


def slices(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of at most ``rows`` rows and, but for a single longer row, ``size`` bytes of text."""
    held = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            held += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(held), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, stop - at)
        at = stop


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | StructType, rows: int = 1024, size: int = 2_000_000) -> DataFrame:
    """mapInArrow with one worker object a task, fed with slices of at most ``rows`` rows and ``size`` bytes of text.

    Slices become many small lists and no cycles, so the collector of cycles rests while one is handled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for part in slices(batch, rows, size):
                gc.disable()
                try:
                    done = apply(part)
                finally:
                    gc.enable()
                yield done

    return df.mapInArrow(run, schema)


def per_worker(key, make: Callable[[], object]):
    """An object that lives as long as the Python worker, so tasks that follow one another share it."""
    store = sys.modules.setdefault("_playmill_worker", types.ModuleType("_playmill_worker")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


class Remembered:
    """A bounded two-generation cache of values by text; what was used lately survives.

    A generation holds at most ``limit`` texts and ``chars`` characters of them (and what one call adds); texts of more
    than ``longest`` characters are forgotten with the next call.
    """

    def __init__(self, limit: int = 150_000, chars: int = 2_000_000, longest: int = 64):
        self.limit, self.chars, self.longest = limit, chars, longest
        self.young, self.old, self.passing, self.held = {}, {}, [], 0

    def fill(self, keys, compute: Callable[[list], list]) -> dict:
        """A dict with every key of ``keys``, good until the next call; ``compute`` gives the values of those not yet known."""
        for k in self.passing:
            del self.young[k]
        self.passing = []
        if len(self.young) > self.limit or self.held > self.chars:
            self.old, self.young, self.held = self.young, {}, 0
        young, old = self.young, self.old
        missing = []
        for k in keys - young.keys():
            v = old.get(k)
            if v is None:
                missing.append(k)
            else:
                young[k] = v
                self.held += len(k)
        if missing:
            young.update(zip(missing, compute(missing)))
            self.passing = [k for k in missing if len(k) > self.longest]
            self.held += sum(map(len, missing)) - sum(map(len, self.passing))
        return young
