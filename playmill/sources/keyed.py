"""A Parquet table with one row for each key, of which a batch rewrites only the buckets it touches."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "__bucket"


class KeyedTable:
    """Rows by primary key in ``buckets`` folders by the hash of the key.

    A batch writes its buckets into a new folder and then renames a manifest into place that names the newest folder of
    each bucket; readers see the old state until then, a batch that dies leaves nothing they can see, and of two writers
    at once the second fails.  Buckets should be many enough for one to fit a task.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._root = self._hadoop.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self) -> dict:
        folder = self._hadoop.Path(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        newest = max((n for n in names if n.startswith("v")), default=None)
        if newest is None:
            return {"version": 0, "buckets": {}, "schema": None, "count": self.buckets, "key": self.key}
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{newest}", wholetext=True).first()["value"])

    def upsert(self, batch: DataFrame, order: list[Column]) -> int:
        """Insert rows of new keys and replace those of held ones; of a batch's rows of a key the last in ``order`` counts.

        Returns the number of buckets rewritten.  An aggregate with partial results reduces a key's rows first, so a hot
        key stays small; the held rows of the touched buckets are shuffled once.  A null key is a key like any other.
        Columns new to the table are null in rows held before.
        """
        held = self._manifest()
        if (held["count"], held["key"]) != (self.buckets, self.key):
            raise ValueError(f"the table has {held['count']} buckets by {held['key']}")
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        last = batch.groupBy(*self.key).agg(F.max_by(F.struct(*batch.columns), F.struct(*order)).alias("__row")).select("__row.*")
        new = last.select("*", bucket.alias(BUCKET), F.lit(1).alias("__turn"))
        touched = sorted(r[0] for r in batch.select(bucket.alias("b")).distinct().collect())  # no more than buckets
        old = [held["buckets"][str(b)] for b in touched if str(b) in held["buckets"]]
        if old:
            rows = self._rows(old, held["schema"])
            new = rows.select("*", bucket.alias(BUCKET), F.lit(0).alias("__turn")).unionByName(new, allowMissingColumns=True)
        spread = new.repartition(max(1, len(touched)), BUCKET)
        columns = [c for c in new.columns if c not in (BUCKET, "__turn", *self.key)]
        newest = spread.groupBy(BUCKET, *self.key).agg(F.max_by(F.struct(*columns, "__turn"), F.col("__turn")).alias("__row"))
        whole = newest.select(*self.key, *[F.col(f"__row.{c}") for c in columns], BUCKET)
        folder = f"data/{held['version'] + 1:010d}-{uuid.uuid4().hex}"
        whole.write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        written = {str(b): f"{folder}/{BUCKET}={b}" for b in touched}
        schema = whole.drop(BUCKET).schema
        self._commit({**held, "version": held["version"] + 1, "buckets": {**held["buckets"], **written}, "schema": schema.jsonValue()})
        return len(touched)

    def read(self) -> DataFrame:
        """The table as of the last batch."""
        held = self._manifest()
        if held["schema"] is None:
            raise ValueError("nothing was written yet")
        return self._rows(list(held["buckets"].values()), held["schema"])

    def _rows(self, folders: list[str], schema: dict) -> DataFrame:
        kinds = StructType.fromJson(schema)
        if not folders:
            return self.spark.createDataFrame([], kinds)
        return self.spark.read.schema(kinds).parquet(*[f"{self.path}/{f}" for f in folders])

    def lookup(self, *key) -> DataFrame:
        """The row of one key: only its bucket is opened."""
        held = self._manifest()
        values = [F.lit(v).cast(f.dataType) for v, f in zip(key, (f for k in self.key for f in StructType.fromJson(held["schema"]) if f.name == k))]
        at = self.spark.range(1).select(F.pmod(F.xxhash64(*values), F.lit(self.buckets)).cast("string")).first()[0]
        rows = self._rows([held["buckets"][at]] if at in held["buckets"] else [], held["schema"])
        return rows.where(reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(v) for k, v in zip(self.key, values)]))

    def vacuum(self) -> int:
        """Remove batch folders that the newest manifest does not name, older states among them; returns how many."""
        used = {f.split("/")[1] for f in self._manifest()["buckets"].values()}
        data = self._hadoop.Path(f"{self.path}/data")
        stale = [s.getPath() for s in self._fs.listStatus(data) if s.getPath().getName() not in used] if self._fs.exists(data) else []
        for path in stale:
            self._fs.delete(path, True)
        return len(stale)

    def _commit(self, manifest: dict) -> None:
        draft = self._hadoop.Path(f"{self.path}/manifests/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        kinds = getattr(self._hadoop, "Options$Rename")
        none = self.spark.sparkContext._gateway.new_array(kinds, 1)
        none[0] = kinds.NONE  # refuses a version that another writer has taken
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._hadoop.Path(f"{self.path}/manifests/v{manifest['version']:010d}")), none)
