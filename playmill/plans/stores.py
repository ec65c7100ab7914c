"""Databases and keyed tables that grow batch by batch, with oracles."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playmill.plans.bindings import relation
from playmill.plans.registry import job
from playmill.session import scratch_path
from playmill.sources import databases
from playmill.sources.keyed import KeyedTable

RUN_SCHEMA = "run_id string, game_id string, status string, duration_seconds double, start_time timestamp"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "runs").select("run_id", "game_id", "status", F.col("duration_seconds"), F.col("start_time").cast("timestamp").alias("start_time"))


@job("s10_database_scan", "SELECT game_id, run_id, status, duration_seconds FROM runs WHERE status IN ('completed', 'error') AND duration_seconds >= 100 ORDER BY game_id, run_id")
def database_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few columns of a saved table, filtered inside the databases, in order."""
    folder = scratch_path(spark, "database")
    databases.save(_runs(spark, sf_dir), folder, "runs", ["run_id"], [F.col("start_time")], 8)
    rows = databases.scan(spark, "runs", "run_id string, game_id string, status string, duration_seconds double", folder, rows=5_000)
    return rows.where("status in ('completed', 'error') and duration_seconds >= 100").orderBy("game_id", "run_id")


@job("s11_databases", "SELECT 'east' AS source_database, run_id, duration_seconds FROM runs WHERE CAST(run_id AS INT) % 2 = 0 UNION ALL SELECT 'west', run_id, NULL FROM runs WHERE CAST(run_id AS INT) % 2 = 1")
def several_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several databases under their names; one lacks a column, one lacks the table's file."""
    found, runs = {"north": scratch_path(spark, "missing") + "/none.db"}, _runs(spark, sf_dir)
    for k, (name, columns) in enumerate({"east": ["run_id", "duration_seconds"], "west": ["run_id"]}.items()):
        folder = scratch_path(spark, name)
        databases.save(runs.where(F.col("run_id").cast("int") % 2 == k).select(*columns), folder, "runs", ["run_id"], [F.col("run_id")], 1)
        found[name] = os.path.join(folder, databases.newest_manifest(folder)[1]["0"])
    return databases.scan(spark, "runs", "run_id string, duration_seconds double", databases=found, provenance="source_database")


BATCHES_SQL = """SELECT run_id, CASE WHEN CAST(run_id AS INT) % 50 = 0 THEN 'third' WHEN CAST(run_id AS INT) % 10 = 0 THEN 'second' ELSE status END AS status,
 CASE WHEN CAST(run_id AS INT) % 50 = 0 THEN 3 WHEN CAST(run_id AS INT) % 10 = 0 THEN 2 ELSE 1 END AS batch FROM runs
UNION ALL SELECT '-' || run_id, 'third', 3 FROM runs WHERE CAST(run_id AS INT) % 50 = 0"""


def _batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """All runs, then replaced ones that come several times, then replaced and new ones."""
    runs = relation(spark, sf_dir, "runs").select("run_id", "status")
    number = F.col("run_id").cast("int")
    again = runs.where(number % 10 == 0).withColumn("try", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("status", F.when(F.col("try") == 2, "second").otherwise("early"))
    tens = runs.where(number % 50 == 0).withColumn("status", F.lit("third"))
    third = tens.unionByName(tens.withColumn("run_id", F.concat(F.lit("-"), "run_id")))
    out = [runs.withColumn("try", F.lit(0)), again, third.withColumn("try", F.lit(0))]
    return [b.select("run_id", "status", F.lit(i).alias("batch"), F.col("try").alias("attempt")) for i, b in enumerate(out, 1)]


@job("k01_database_saves", BATCHES_SQL)
def database_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: three saves of runs by primary key, each seen whole or not at all."""
    folder = scratch_path(spark, "saves")
    for batch in _batches(spark, sf_dir):
        databases.save(batch, folder, "runs", ["run_id"], [F.col("attempt")], 8)
    return databases.scan(spark, "runs", "run_id string, status string, batch int", folder)


@job("k01_keyed_batches", BATCHES_SQL)
def keyed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K9, U8: three batches into a keyed Parquet table, of which each rewrites only what it touches."""
    table = KeyedTable(spark, scratch_path(spark, "keyed"), ["run_id"], 16)
    for batch in _batches(spark, sf_dir):
        table.upsert(batch, [F.col("attempt")])
    return table.read().select("run_id", "status", "batch")
