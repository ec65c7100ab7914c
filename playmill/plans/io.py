"""Scans and sinks over the tables, with oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playmill.plans.registry import query
from playmill.sources import readers, writers


@query("s04_season_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderdate <= TIMESTAMP '1998-06-30'", "t:orders")
def season_scan(orders: DataFrame) -> DataFrame:
    """One partition up to a day."""
    return readers.season_scan(orders, "o_orderstatus", "F", "o_orderdate", "1998-06-30").select("o_orderkey", "o_totalprice")


@query("s08_json_records", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props)", "t:events")
def json_records(events: DataFrame) -> DataFrame:
    """Records of JSON lines, what is none left out."""
    return events.withColumn("r", F.from_json("props", "k bigint")).where("r is not null").select("event_id", "r.k")


@query("s11_provenance", "SELECT 'a' AS source_database, o_orderkey AS id, o_totalprice AS amount FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'b', o_orderkey, NULL FROM orders WHERE o_orderkey % 2 = 1", "t:orders")
def provenance(orders: DataFrame) -> DataFrame:
    """Sources of different columns under one name each."""
    rows = orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    return readers.with_provenance({"a": rows.where("id % 2 = 0"), "b": rows.where("id % 2 = 1").drop("amount")})


@query("s12_keyed_scan", "SELECT run_id, start_time FROM runs WHERE game_id = '7' ORDER BY start_time, run_id", "runs")
def keyed_scan(runs: DataFrame) -> DataFrame:
    """The runs of one game in order."""
    return runs.where("game_id = '7'").select("run_id", "start_time").orderBy("start_time", "run_id")


@query("s13_narrow_scan", "SELECT game_id, run_id, status, successful_predictions FROM runs ORDER BY game_id, start_time", "runs")
def narrow_scan(runs: DataFrame) -> DataFrame:
    """Few columns, ordered."""
    return runs.orderBy("game_id", "start_time").select("game_id", "run_id", "status", "successful_predictions")


@query("s14_results_source", "SELECT game_id, day, away_score, home_score FROM results WHERE final_spread IS NOT NULL", "results")
def results_source(results: DataFrame) -> DataFrame:
    """Actual results with a known spread."""
    return readers.require_columns(results, ["game_id", "final_spread"]).where("final_spread is not null").select("game_id", "day", "away_score", "home_score")


@query("s18_cache_keys", "SELECT DISTINCT player, season, md5(CAST(player AS STRING) || '_' || CAST(season AS STRING)) AS key FROM box", "box")
def cache_keys(box: DataFrame) -> DataFrame:
    """md5 keys of entity and season."""
    rows = box.select("player", "season").distinct()
    return rows.withColumn("key", readers.cache_key(F.col("player").cast("string"), F.col("season").cast("string")))


@query("s20_counts", "SELECT count(*) AS lines, count(DISTINCT user_id) AS users, min(ts) AS first, max(ts) AS last FROM events", "t:events")
def counts(events: DataFrame) -> DataFrame:
    """Lines, keys and the span of time."""
    return events.agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("user_id").alias("users"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("k01_merged", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders", "t:orders")
def merged(orders: DataFrame) -> DataFrame:
    """K1, U8: an upsert of every tenth row."""
    held = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return writers.upsert(held, held.where("id % 10 = 0").withColumn("status", F.lit("new")), ["id"])


@query("k04_json_lines", """SELECT '{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '","note":' || CASE WHEN o_orderkey % 2 = 0 THEN 'null' ELSE '"odd"' END || '}' AS line FROM orders""", "t:orders")
def json_lines(orders: DataFrame) -> DataFrame:
    """K4, K8, F-A7: rows as JSON lines with nulls written out."""
    row = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 2 == 1, "odd").alias("note"))
    return orders.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("line"))


@query("k11_random_parts", "SELECT o_orderkey, CAST('0x' || substring(md5(CAST(o_orderkey AS STRING)), 1, 8) AS BIGINT) % 5 AS part FROM orders", "t:orders")
def random_parts(orders: DataFrame) -> DataFrame:
    """An even, repeatable split."""
    return orders.select("o_orderkey", writers.random_part(F.col("o_orderkey"), 5).alias("part"))


@query("p16_sample", "SELECT o_orderkey FROM orders ORDER BY md5('42:' || CAST(o_orderkey AS STRING)), o_orderkey LIMIT 100", "t:orders")
def sample(orders: DataFrame) -> DataFrame:
    """A fixed-size sample that is the same on every run."""
    return orders.select("o_orderkey").orderBy(F.md5(F.concat(F.lit("42:"), F.col("o_orderkey").cast("string"))), "o_orderkey").limit(100)
