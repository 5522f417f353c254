"""Tables that an operator writes for itself, such as indexes, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A path that isn't used yet, below spark.checkpoint.dir; below a local folder where that is unset and the master is local (tests)."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="sparkalogue-")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table and read back: its lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_sorted(df: DataFrame, order: list[str], path: str) -> None:
    """Write a table whose files are sorted, so that numbers take few bytes and readers can skip; its shuffle files go when it is written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark = df.sparkSession
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.sortWithinPartitions(*order).write.option("compression", "zstd").option("parquet.writer.version", "v2").parquet(path)
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
