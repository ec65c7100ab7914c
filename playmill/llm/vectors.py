"""Shared by operators 2 and 4: classes of equal vectors, and block-wise pairing of queries with data."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable_vectors(df: DataFrame, id_col: str, vec_col: str, convert, zero: bool) -> DataFrame:
    """(vec_id, vec): rows with an id and a vector without null or non-finite components, of the commonest length.

    ``convert`` maps one double component; zero vectors stay only if ``zero``.
    """
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vec")).where("vec_id is not null and vec is not null and size(vec) > 0")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(~F.coalesce(F.exists("vec", bad), F.lit(True)))
    if not zero:
        rows = rows.where(F.exists("vec", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vec") == (lengths["d"] if lengths else 0)).withColumn("vec", F.transform("vec", convert))


def classes_of(vectors: DataFrame, keep: int) -> DataFrame:
    """(vec, ids, class_id): distinct vectors, each with its ``keep`` smallest ids; class_id is the smallest.

    The ranks are cut at ``keep`` inside each task before the shuffle, so copies never gather.
    """
    ranked = vectors.withColumn("r", F.dense_rank().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("r") <= keep)
    return ranked.groupBy("vec").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).withColumn("class_id", F.element_at("ids", 1))


def matrix(column: pa.Array | pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    """Rows of a list column as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind, copy=False) if len(column) else np.zeros((0, 0))


def blocked(queries: DataFrame, data: DataFrame, query_rows: int, data_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with keys (cell, block, chunk), so that every query of a cell meets every row of it exactly once.

    A cell's queries go to blocks of about ``query_rows``, its data to chunks of about ``data_rows``; each query is
    sent to all chunks and each row to all blocks of its cell.  The table of cell sizes has a row for each cell.
    """
    count = lambda df, rows: {r["cell"]: max(1, -(-r["count"] // rows)) for r in df.groupBy("cell").count().collect()}
    blocks, chunks = count(queries, query_rows), count(data, data_rows)
    of = lambda sizes: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("cell")), F.lit(0)) if sizes else F.lit(0)
    every = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))
    deal = lambda n: F.pmod(F.xxhash64("class_id"), n).cast("int")
    left = queries.where(of(chunks) > 0).select("*", deal(of(blocks)).alias("block"), every(of(chunks)).alias("chunk"))
    right = data.where(of(blocks) > 0).select("*", deal(of(chunks)).alias("chunk"), every(of(blocks)).alias("block"))
    return left, right


def best(found: DataFrame, query_ids: DataFrame, k: int, descending: bool) -> DataFrame:
    """(query_id, rank, vec_id, score) from (query_class, vec_id, score) rows: a query's own row is left out.

    ``query_ids`` has (query_id, query_class); ``found`` must hold each class's k + 1 best.
    """
    order: Column = F.desc("score") if descending else F.asc("score")
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("query_class").orderBy(order, "vec_id"))).where(F.col("r") <= k + 1)
    lists = top.groupBy("query_class").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("hits"))
    own = query_ids.join(lists, "query_class").select("query_id", F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k).alias("hits"))
    rows = own.select("query_id", F.posexplode("hits").alias("p", "h"))
    return rows.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("h.vec_id").alias("vec_id"), F.col("h.score").alias("score"))


def choose(scores: np.ndarray, ids: list[list[int]], keep: int, descending: bool) -> tuple[list[int], list[float]]:
    """Ids and scores of the ``keep`` best members of classes with the given scores; ties to smaller ids."""
    if len(scores) > keep:
        sign = -scores if descending else scores
        pool = np.flatnonzero(sign <= np.partition(sign, keep - 1)[keep - 1])
    else:
        pool = np.arange(len(scores))
    rows = sorted(((-scores[i] if descending else scores[i]), v) for i in pool for v in ids[i])[:keep]
    return [v for _, v in rows], [(-s if descending else s) for s, _ in rows]
