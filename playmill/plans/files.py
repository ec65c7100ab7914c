"""Sources and sinks by round trips through files in the shared folder, with oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playmill.plans.bindings import relation
from playmill.plans.registry import job
from playmill.session import scratch_path, table
from playmill.sources import readers, writers

ORDER_SQL = "SELECT o_orderkey AS id, o_orderstatus AS status, CAST(o_totalprice * 100 AS BIGINT) AS cents FROM orders"
ORDER_SCHEMA = "id long, status string, cents long"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.bround(F.col("o_totalprice") * 100).cast("long").alias("cents"))


@job("s06_season_files", "SELECT player, CAST(sum(pts) AS DOUBLE) AS pts FROM box WHERE season = 2000 AND day <= DATE '2000-06-30' GROUP BY player")
def season_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows partitioned by season, of which one season up to a day is read back."""
    root = scratch_path(spark, "seasons")
    writers.write_features(relation(spark, sf_dir, "box").select("season", "player", "day", "pts"), root, ["season"])
    return readers.read_season(spark, root, 2000, "2000-06-30", "day").groupBy("player").agg(F.sum("pts").alias("pts"))


@job("s07_first_existing", ORDER_SQL)
def first_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV sink read back through the first of several paths that exists."""
    path = scratch_path(spark, "csv")
    writers.write_csv(_orders(spark, sf_dir), path)
    return readers.read_csv_or_empty(spark, [path + "-none", path], ORDER_SCHEMA)


@job("s09_latest_file", f"SELECT * FROM ({ORDER_SQL}) WHERE id % 2 = 1")
def latest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file that was written last, by the order of modification times."""
    root = scratch_path(spark, "latest")
    for k in (0, 1):
        _orders(spark, sf_dir).where(f"id % 2 = {k}").write.parquet(f"{root}/{k}")
    newest = readers.files_by_time(spark, f"{root}/*")[0]
    if newest != readers.latest_file(spark, f"{root}/*"):  # both were written in one tick of the clock
        newest = f"{root}/1"
    return spark.read.parquet(newest)


@job("s16_catalog", "SELECT * FROM (VALUES ('playmill_regions', 'r_comment', 'string'), ('playmill_regions', 'r_name', 'string'), ('playmill_regions', 'r_regionkey', 'int')) t(\"table\", \"column\", type) WHERE \"column\" <> 'r_comment'")
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and columns of the catalog."""
    table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name").createOrReplaceTempView("playmill_regions")
    return readers.describe_tables(spark).where("table = 'playmill_regions'")


@job("s17_config", "SELECT 'games' AS key, CAST(count(DISTINCT o_custkey) AS INT) AS value FROM orders UNION ALL SELECT 'runs', CAST(count(*) AS INT) FROM orders UNION ALL SELECT 'iterations', CAST(max(o_orderkey % 550) AS INT) FROM orders")
def config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration of figures of the runs, written as JSON text and read back."""
    path = scratch_path(spark, "config")
    figures = table(spark, sf_dir, "orders").agg(F.count_distinct("o_custkey").alias("games"), F.count(F.lit(1)).alias("runs"), F.max(F.expr("o_orderkey % 550")).alias("iterations"))
    figures.select(F.to_json(F.struct("*"))).write.text(path)
    return spark.createDataFrame(sorted(readers.read_config(spark, path).items()), "key string, value int")


@job("s22_season_cache", "SELECT season, count(*) AS games FROM box WHERE season IN (1999, 2000) GROUP BY season")
def season_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasons read once and kept."""
    box = relation(spark, sf_dir, "box")
    held = readers.SeasonCache(lambda season: box.where(F.col("season") == season).select("season", "player"))
    frames = [held.get(s) for s in (1999, 2000, 1999)][:2]
    return reduce(DataFrame.unionByName, frames).groupBy("season").agg(F.count(F.lit(1)).alias("games"))


@job("k03_per_key", "SELECT status, count(*) AS n, sum(cents) AS cents FROM (" + ORDER_SQL + ") GROUP BY status")
def per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: JSON files in one folder for each key, read back with the key from the path."""
    path = scratch_path(spark, "keys")
    writers.write_per_key(_orders(spark, sf_dir), path, "status")
    return spark.read.schema("id long, cents long, status string").json(path).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@job("k06_by_suffix", f"SELECT f.format, o.* FROM ({ORDER_SQL}) o, (VALUES ('csv'), ('json'), ('parquet'), ('orc')) f(format)")
def by_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5, K6: the format of a sink by its suffix, CSV where it says nothing."""
    rows, out = _orders(spark, sf_dir), []
    for suffix in (".txt", ".json", ".parquet", ".orc"):
        path = scratch_path(spark, "suffix") + suffix
        kind = writers.write_by_suffix(rows, path)
        out.append(spark.read.schema(ORDER_SCHEMA).option("header", "true").format(kind).load(path).select(F.lit(kind).alias("format"), "*"))
    return reduce(DataFrame.unionByName, out)


@job("k07_appended", ORDER_SQL)
def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: a table that grows batch by batch."""
    path = scratch_path(spark, "batches")
    for k in range(3):
        writers.append_batch(_orders(spark, sf_dir).where(f"id % 3 = {k}"), path)
    return spark.read.parquet(path)


@job("k09_replaced_table", "SELECT id, CASE WHEN id % 2 = 0 THEN 'new' ELSE status END AS status FROM (" + ORDER_SQL + ")")
def replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: a table replaced from a CSV, one row for each key, the highest turn wins."""
    path = scratch_path(spark, "replace")
    rows = _orders(spark, sf_dir).select("id", "status", F.lit(0).alias("turn"))
    writers.write_csv(rows.unionByName(rows.where("id % 2 = 0").select("id", F.lit("new").alias("status"), F.lit(1).alias("turn"))), path)
    name = "playmill_" + path.rsplit("-", 1)[1]
    writers.replace_table(readers.read_csv(spark, path, "id long, status string, turn int"), name, ["id"], [F.desc("turn")])
    return spark.table(name).select("id", "status")


@job("k12_concatenated", "SELECT 'a' || o_orderkey AS value FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'b' || o_orderkey FROM orders WHERE o_orderkey % 2 = 1")
def concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line files one behind the other, in part files that keep the order."""
    rows, path = _orders(spark, sf_dir), scratch_path(spark, "lines")
    parts = [rows.where(f"id % 2 = {k}").select(F.concat(F.lit(name), F.col("id").cast("string")).alias("value")) for k, name in enumerate("ab")]
    writers.concatenate(parts, path)
    return spark.read.text(path)


@job("k13_report", "SELECT 'status=' || status || '  n=' || count(*) AS line FROM (" + ORDER_SQL + ") GROUP BY status")
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a text report."""
    counts = _orders(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n")).orderBy("status")
    lines = writers.text_report("Orders", {"By status": counts}).splitlines()
    return spark.createDataFrame([(x,) for x in lines if x.startswith("status=")], "line string")


@job("p15_column_aliases", ORDER_SQL.replace("AS id", "AS key").replace("AS cents", "AS amount"))
def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns found under the first of several names."""
    rows = _orders(spark, sf_dir)
    found = {out: readers.resolve_column(rows, names) for out, names in {"key": ["order_id", "id"], "status": ["state", "status"], "amount": ["cents", "price"]}.items()}
    return rows.select(*[F.col(c).alias(out) for out, c in found.items()])
