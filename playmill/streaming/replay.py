"""Replays of tables as streams: deliveries that arrive one after another, with a stop and a restart in between.

Each delivery is appended to a folder; the stream over it starts, takes what is new and ends, and the next one goes on
from the checkpoint.  So the watermark of a delivery is what all earlier ones have left, whatever their files, and state
has to survive as many restarts as there are deliveries.  Sinks are Parquet with the checkpoint's exactly-once commits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playmill.session import scratch_path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """State stores of streams started meanwhile keep their state in RocksDB, outside the heap."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def replayed(deliveries: DataFrame, batch: str, batches: int, build: Callable[[DataFrame], DataFrame], patience: int | None = None, once: bool = False) -> tuple[DataFrame, str]:
    """What ``build`` of the stream has written after all ``batches`` deliveries, and its checkpoint.

    ``deliveries`` has in the column ``batch`` the number of the delivery, from 0, with which a row arrives.  ``once`` takes
    each in a single batch, as timers of processing time need: with these a stream always asks for another batch.
    A delivery takes as long as its rows need; ``patience`` sets a number of seconds for streams that may not end.
    """
    spark = deliveries.sparkSession
    root = scratch_path(spark, "replay")
    rows = deliveries.drop(batch)
    # rows are worked out once, not once a delivery; a delivery then reads its own folder only
    deliveries.write.partitionBy(batch).parquet(f"{root}/all")
    kept = spark.read.schema(deliveries.schema).parquet(f"{root}/all")
    schema, trigger = None, {"once": True} if once else {"availableNow": True}
    for k in range(batches):
        kept.where(F.col(batch) == k).select(*rows.columns).write.mode("append").parquet(f"{root}/in")
        with state_in_rocksdb(spark):
            out = build(spark.readStream.schema(rows.schema).parquet(f"{root}/in"))
            schema = out.schema
            running = out.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(**trigger).start()
            if patience is None:
                running.awaitTermination()
            elif not running.awaitTermination(patience):
                running.stop()
                raise TimeoutError(f"delivery {k} took more than {patience} seconds")
    return spark.read.schema(schema).parquet(f"{root}/out"), f"{root}/checkpoint"


def state_of(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """A state variable of the last committed batch, read back from a checkpoint."""
    with state_in_rocksdb(spark):
        return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


def event_time(df: DataFrame, time: str, late: str) -> DataFrame:
    """``df`` with ``time`` as event time, and rows behind the watermark dropped by what follows."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def first_deliveries(df: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each key once; a repetition is recognised as long as it is not too late itself."""
    return event_time(df, time, late).dropDuplicatesWithinWatermark(keys)


def interval_join(left: DataFrame, right: DataFrame, on: Column, time: tuple[str, str], within: str, late: str) -> DataFrame:
    """Rows of two streams that fit, the right one up to ``within`` after the left one; state is bounded by both watermarks."""
    a, b = event_time(left, time[0], late), event_time(right, time[1], late)
    near = (F.col(time[1]) >= F.col(time[0])) & (F.col(time[1]) <= F.col(time[0]) + F.expr(f"INTERVAL {within}"))
    return a.join(b, on & near)
