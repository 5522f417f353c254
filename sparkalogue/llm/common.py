"""Shared helpers: table access, the shared folder, word splitting, connected components."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the five ASCII control spaces.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Rows that Spark hands to Python at a time; texts can be long, so fewer than Spark's default.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small enough for a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset and the master is local (tests)."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = getattr(spark.sparkContext, "_sparkalogue_dir", None)
    if made is None:
        made = tempfile.mkdtemp(prefix="sparkalogue-")
        spark.sparkContext._sparkalogue_dir = made
    return f"file://{made}"


@contextlib.contextmanager
def session_conf(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for a while, put back at the end; in names, __ stands for a dot."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back, so that a lost executor costs no recomputation.

    The shuffle files of the write are dropped when it ends: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with session_conf(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._sparkalogue_path = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete tables of write_table that nothing reads again."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._sparkalogue_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Python strings of a column; null is the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def crc32_of_id(column: Column) -> Column:
    """Unsigned crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def hash_words(words: Iterable[str], cache: dict[str, int]) -> np.ndarray:
    """64-bit hash of each word; cache is the worker's own memory of words seen."""
    if len(cache) > 1_000_000:
        cache.clear()
    get = cache.get
    out = []
    for w in words:
        h = get(w)
        if h is None:
            b = w.encode()
            h = cache[w] = zlib.crc32(b) | zlib.crc32(b[::-1], 0x9E3779B9) << 32
        out.append(h)
    return np.array(out, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix constants), for arrays of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of word windows; a text shorter than the width is one shingle, no word is none."""
    n = len(word_hashes)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    width = min(width, n)
    out = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + word_hashes[k : n - width + 1 + k])
    return np.unique(out)


def slices(batches: Iterator[pa.RecordBatch], byte_column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `most` bytes of the column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.array([len(x) if x else 0 for x in batch.column(byte_column).to_pylist()])
        part = np.cumsum(size) // most
        edges = np.flatnonzero(np.diff(part, prepend=part[0] - 1))
        for a, b in zip(edges, [*edges[1:], batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(id, component) for every id of edges (a, b); component is the smallest id reachable.

    Large-star / small-star rounds: each round keeps at most as many edges as before and
    pre-aggregates minima before its shuffle; ids with a huge number of neighbours cost
    one aggregated row per task. Rounds end when nothing changes, in a logarithmic number.
    """
    e = write_table(
        edges.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        # large star: neighbours above u point at the smallest neighbour of u
        large = both.where("v > u").join(low, "u").where("m <= u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # small star: u and its smaller neighbours point at the smallest of them
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.u", "p.v").where("u != v").distinct()
        e = write_table(small, "edges")
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    centres = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return stars.union(centres)
