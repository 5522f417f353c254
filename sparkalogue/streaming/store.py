"""A keyed store of records that grows by batches: rows by a hash of their key, changes as deltas, buckets merged one by one.

Below the store's path, delta/batch=N/bucket=K holds what batch N changed, base/generation=G/bucket=K
the merged rows of a bucket, and manifest/generation=G up to which batch each bucket is merged and
in which generation it lies. A table counts from the moment its writer's mark (_SUCCESS) stands,
so a batch or a merge that is broken off leaves nothing behind that is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import catalog, upsert

#: Buckets of a store; a batch reads and a merge writes those that it touches.
BUCKETS = 64


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers N of complete tables path/name=N."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath().getName() for f in files.listStatus(top)] if files.exists(top) else []
    return sorted(n for n in (int(f.split("=")[1]) for f in found if f.startswith(f"{name}=")) if _there(spark, f"{path}/{name}={n}"))


class Store:
    """Records of a schema with a unique key; `private` is set when a record first comes and stays as it is."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str]):
        self.spark, self.path, self.keys = spark, path, keys
        self.columns = schema.fieldNames()
        self.schema = T.StructType([*schema.fields, T.StructField("private", T.BooleanType())])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(BUCKETS)).cast("int")

    def _merged(self) -> dict[int, tuple[int, int]]:
        """Generation and last batch of each merged bucket."""
        known = _numbers(self.spark, f"{self.path}/manifest", "generation")
        if not known:
            return {}
        return {r["bucket"]: (r["generation"], r["upto"]) for r in self.spark.read.parquet(f"{self.path}/manifest/generation={known[-1]}").collect()}  # at most BUCKETS rows

    def _table(self, kind: str, name: str, number: int) -> DataFrame:
        table = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.path}/{kind}/{name}={number}")
        return table.withColumn("_batch", F.lit(number if kind == "delta" else -1))

    def read(self, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
        """Current rows, or those before a batch; of some buckets only the folders of these are read."""
        merged, wanted = self._merged(), set(range(BUCKETS)) if buckets is None else set(buckets)
        parts = []
        for generation in sorted({g for b, (g, _) in merged.items() if b in wanted}):
            parts.append(self._table("base", "generation", generation).where(F.col("bucket").isin([b for b in wanted if b in merged and merged[b][0] == generation])))
        for n in _numbers(self.spark, f"{self.path}/delta", "batch"):
            late = [b for b in wanted if n > merged.get(b, (0, -1))[1]]
            if late and (before is None or n < before):
                parts.append(self._table("delta", "batch", n).where(F.col("bucket").isin(late)))
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return catalog.first_per(every, self.keys, F.desc("_batch")).select(*self.schema.fieldNames())

    def apply(self, batch: DataFrame, number: int, order: list[Column] = (), force: bool = False, private: bool = False) -> int:
        """Write what a batch changes; returns the rows written. A batch that is known already writes nothing.

        Of several rows of a key the first by `order` counts. Rows equal to the stored ones are left
        out unless `force` is given. New keys get `private`, known ones keep theirs.
        """
        path = f"{self.path}/delta/batch={number}"
        if _there(self.spark, path):
            return 0
        latest = catalog.first_per(batch.select(*self.columns), self.keys, *order, F.xxhash64("*")).withColumn("bucket", self.bucket())
        touched = [r["bucket"] for r in latest.select("bucket").distinct().collect()]  # at most BUCKETS
        stored = self.read(touched, before=number)
        new = latest if force else upsert.changed_only(stored.select(*self.columns), latest.drop("bucket"), self.keys).withColumn("bucket", self.bucket())
        kept = stored.select(*self.keys, F.col("private").alias("_private"))
        rows = new.join(kept, self.keys, "left").withColumn("private", F.coalesce("_private", F.lit(private))).select(*self.schema.fieldNames(), "bucket")
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        return self._table("delta", "batch", number).count()

    def merge(self, least: int = 8) -> list[int]:
        """Merge the buckets that at least so many batches have changed since their last merge; returns them."""
        merged, batches = self._merged(), _numbers(self.spark, f"{self.path}/delta", "batch")
        waiting: dict[int, int] = {}
        for n in batches:
            for r in self._table("delta", "batch", n).select("bucket").distinct().collect():  # at most BUCKETS
                if n > merged.get(r["bucket"], (0, -1))[1]:
                    waiting[r["bucket"]] = waiting.get(r["bucket"], 0) + 1
        due = sorted(b for b, n in waiting.items() if n >= least)
        if due:
            generation = max(_numbers(self.spark, f"{self.path}/manifest", "generation"), default=-1) + 1
            self.read(due).withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/base/generation={generation}")
            now = merged | dict.fromkeys(due, (generation, batches[-1]))
            rows = [(b, g, n) for b, (g, n) in sorted(now.items())]
            self.spark.createDataFrame(rows, "bucket int, generation int, upto int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/generation={generation}")
        return due


def ingest(store: Store, stream: DataFrame, checkpoint: str, order: list[Column] = (), force: bool = False, private: bool = False, merge_after: int = 8) -> StreamingQuery:
    """Apply a stream's batches to a store by their numbers; a batch that is run again after a failure changes nothing."""

    def take(batch: DataFrame, number: int) -> None:
        store.apply(batch, number, order, force, private)
        store.merge(merge_after)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take).start()
