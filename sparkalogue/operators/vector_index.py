"""An inverted-file index over vectors: lists of neighbours around centroids, probed by a join.

Centroids are fitted on a bounded sample, every row is assigned to the nearest one, and a list is
stored as blocks of bounded size under its number as a partition key. A search sends each query
to the lists whose centroids are nearest; queries of one list travel in chunks and meet its blocks
by matrix products. With exact=True the lists that could still hold a better row, by the angle
between query and centroid less the list's widest angle, are read in a second pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .history import checkpointed
from .stored import new_path

#: Bounds: rows that centroids are fitted on, lists of an index, rows of a block, queries of a chunk and queries that choose lists at once.
FIT_ROWS, MOST_LISTS, BLOCK_ROWS, CHUNK_QUERIES, PROBE_ROWS = 50_000, 4096, 1024, 128, 64
#: Cosines are rounded to six decimals, so ranks are settled up to this.
_SLACK = 1e-6


@dataclass
class VectorIndex:
    """path holds `list=N` folders; centroids are unit rows, radius the widest angle within a list, rows its vectors."""

    path: str
    centroids: np.ndarray
    radius: np.ndarray
    rows: np.ndarray

    def blocks(self, spark: SparkSession, lists: list[int] | None = None) -> DataFrame:
        """(list, ids, vecs) of some lists: only their folders are read."""
        table = spark.read.schema("ids array<bigint>, vecs binary, list int").parquet(self.path)
        return table if lists is None else table.where(F.col("list").isin(lists))


def units(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(which, rows): vectors of the given width and a length above 0, divided by it; null entries count as no vector."""
    vectors = column.to_pylist()
    which = np.array([i for i, v in enumerate(vectors) if v is not None and len(v) == width and None not in v], dtype=np.int64)
    rows = np.array([vectors[i] for i in which], dtype=np.float64).reshape(len(which), width)
    norm = np.sqrt((rows * rows).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return which[good], rows[good] / norm[good, None]


def spherical_means(rows: np.ndarray, lists: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit rows: each round assigns rows by cosine and averages; an empty list takes the row worst served."""
    rng = np.random.default_rng(seed)
    centres = rows[np.sort(rng.choice(len(rows), size=min(lists, len(rows)), replace=False))]
    for _ in range(rounds):
        cosines = np.concatenate([(part @ centres.T).argmax(axis=1) for part in np.array_split(rows, max(1, len(rows) // 4096))])
        served = (rows * centres[cosines]).sum(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, cosines, rows)
        for empty in np.flatnonzero(np.bincount(cosines, minlength=len(centres)) == 0):
            worst = int(served.argmin())
            total[empty], served[worst] = rows[worst], 2.0
        norm = np.sqrt((total * total).sum(axis=1))
        centres = np.where(norm[:, None] > 0, total / np.maximum(norm, 1e-300)[:, None], centres)
    return centres


def build(corpus: DataFrame, lists: int | None = None, fit_rows: int = FIT_ROWS, path: str | None = None) -> VectorIndex | None:
    """Index of (id, vec): every row with a vector of the commonest width is in one list; None if there are none.

    Without `lists` their number grows with the square root of the rows, to MOST_LISTS at most.
    """
    spark = corpus.sparkSession
    rows = corpus.select(F.col("id").cast("long").alias("id"), "vec").where("id is not null and size(vec) > 0")
    widths = rows.groupBy(F.size("vec").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if widths is None:
        return None
    width, total = widths["w"], widths["count"]
    share = min(1.0, 1.5 * fit_rows / total)
    # a bounded sample, the same for the same rows: those of the smallest hashes
    sample = rows.where(F.size("vec") == width).withColumn("h", F.xxhash64("id", F.lit(11))).where(F.col("h") < F.lit(int((share - 0.5) * 2**64) if share < 1 else 2**63 - 1)).orderBy("h", "id").limit(fit_rows)
    _, fitted = units(pa.array([r["vec"] for r in sample.select("vec").collect()], pa.list_(pa.float64())), width)
    if not len(fitted):
        return None
    centres = spherical_means(np.unique(fitted, axis=0), lists or min(MOST_LISTS, max(1, math.isqrt(total))))
    sent = spark.sparkContext.broadcast(centres)  # at most MOST_LISTS rows of the vectors' width

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, unit = units(batch.column("vec"), width)
            for at in range(0, len(which), 2048):
                cosines = unit[at : at + 2048] @ sent.value.T
                best = cosines.argmax(axis=1)
                angles = np.arccos(np.clip(cosines[np.arange(len(best)), best], -1, 1))
                vecs = [v.tobytes() for v in unit[at : at + 2048]]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(which[at : at + 2048])), pa.array(vecs, pa.binary()), pa.array(best, pa.int32()), pa.array(angles)], names=["id", "vec", "list", "angle"])

    assigned = checkpointed(rows.mapInArrow(assign, "id long, vec binary, list int, angle double"))
    sizes = assigned.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    known = sizes.collect()  # at most MOST_LISTS rows
    radius, counts = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in known:
        radius[r["list"]], counts[r["list"]] = r["radius"], r["n"]
    # a list, however large, is cut into blocks of about BLOCK_ROWS rows by a hash
    parts = F.ceil(F.col("n") / BLOCK_ROWS)
    cut = assigned.join(F.broadcast(sizes.select("list", "n")), "list").withColumn("block", F.pmod(F.xxhash64("id", "vec", F.monotonically_increasing_id()), parts))
    packed = cut.groupBy("list", "block").agg(F.collect_list(F.struct("id", "vec")).alias("rows"))
    path = path or new_path(spark, "vector-index")
    packed.select("list", F.col("rows.id").alias("ids"), F.unhex(F.array_join(F.transform("rows.vec", F.hex), "")).alias("vecs")).write.partitionBy("list").parquet(path)
    return VectorIndex(path, centres, radius, counts)


def _probe(queries: DataFrame, index: VectorIndex, choose) -> DataFrame:
    """(query_id, vec, list): the lists that choose(angles, row numbers) names for each query."""
    spark, width = queries.sparkSession, index.centroids.shape[1]
    sent = spark.sparkContext.broadcast((index.centroids, index.radius, index.rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radius, rows = sent.value
        for batch in batches:
            which, unit = units(batch.column("vec"), width)
            for at in range(0, len(which), PROBE_ROWS):
                some, part = which[at : at + PROBE_ROWS], unit[at : at + PROBE_ROWS]
                angles = np.arccos(np.clip(part @ centres.T, -1, 1))
                row, lists = choose(batch, some, np.where(rows > 0, angles, np.inf), radius)
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(some[row])), pa.array([v.tobytes() for v in part[row]], pa.binary()), pa.array(lists, pa.int32())], names=["query_id", "vec", "list"])

    return queries.mapInArrow(run, "query_id long, vec binary, list int")


def _scored(probed: DataFrame, index: VectorIndex, k: int) -> DataFrame:
    """(query_id, id, cosine): for each query and block its k best rows."""
    spark, width = probed.sparkSession, index.centroids.shape[1]
    probed = checkpointed(probed)
    lists = [r["list"] for r in probed.select("list").distinct().collect()]  # at most MOST_LISTS
    # queries of a list travel in chunks; the list's share of queries says in how many
    counted = probed.groupBy("list").agg(F.count("*").alias("n"))
    chunked = probed.join(F.broadcast(counted), "list").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.ceil(F.col("n") / CHUNK_QUERIES)))
    chunks = chunked.groupBy("list", "chunk").agg(F.collect_list(F.struct("query_id", "vec")).alias("q"))
    chunks = chunks.select("list", F.col("q.query_id").alias("query_ids"), F.unhex(F.array_join(F.transform("q.vec", F.hex), "")).alias("query_vecs"))
    met = chunks.join(index.blocks(spark, lists), "list").select("query_ids", "query_vecs", "ids", "vecs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[np.ndarray]] = [[], [], []]
            for q_ids, q_vecs, ids, vecs in zip(*(batch.column(c) for c in ("query_ids", "query_vecs", "ids", "vecs")), strict=True):
                q, own = np.array(q_ids.as_py()), np.array(ids.as_py())
                cosines = np.round(np.frombuffer(q_vecs.as_py()).reshape(-1, width) @ np.frombuffer(vecs.as_py()).reshape(-1, width).T, 6) + 0.0
                cosines[q[:, None] == own[None, :]] = -np.inf
                kth = np.partition(cosines, -k, axis=1)[:, -k] if cosines.shape[1] > k else np.full(len(q), -np.inf)
                row, col = np.nonzero((cosines >= kth[:, None]) & np.isfinite(cosines))
                for to, values in zip(found, (q[row], own[col], cosines[row, col]), strict=True):
                    to.append(values)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f)) for f in found], names=["query_id", "id", "cosine"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "64")  # a row holds a block and a chunk
    try:
        return checkpointed(best_k(met.mapInArrow(run, "query_id long, id long, cosine double"), k))
    finally:
        spark.conf.set(key, before)


def best_k(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), F.asc("id")))
    return scored.withColumn("rn", rank).where(F.col("rn") <= k).drop("rn")


def search(index: VectorIndex | None, queries: DataFrame, k: int, probes: int = 16, exact: bool = False) -> DataFrame:
    """(query_id, id, cosine): near rows of each query (id, vec), ties to the smaller id; never the row of the query's own id.

    Without `exact` the `probes` nearest lists decide. With it, lists that may hold a row as good as
    the k-th found are read too, and the answer is that of a full scan. Queries without a vector of
    the index's width, or of length 0, have no neighbours; equal ids and repeated rows count as rows.
    """
    spark = queries.sparkSession
    if index is None:
        return spark.createDataFrame([], "query_id long, id long, cosine double")
    asked = queries.select(F.col("id").cast("long").alias("query_id"), "vec").where("query_id is not null")
    probes = min(probes, len(index.centroids))

    def nearest(_, __, angles: np.ndarray, ___) -> tuple[np.ndarray, np.ndarray]:
        best = np.argsort(angles, axis=1, kind="stable")[:, :probes]
        row, col = np.nonzero(np.isfinite(np.take_along_axis(angles, best, axis=1)))
        return row, best[row, col]

    first = _scored(_probe(asked, index, nearest), index, k)
    if not exact:
        return first
    floor = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("cosine")).otherwise(-2.0).alias("floor"))
    again = asked.join(floor, "query_id", "left").select("query_id", "vec", F.coalesce("floor", F.lit(-2.0)).alias("floor"))

    def open_lists(batch: pa.RecordBatch, which: np.ndarray, angles: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        floors = batch.column("floor").to_numpy()[which]
        reach = np.where(floors > -1, np.arccos(np.clip(floors - _SLACK, -1, 1)), np.inf)
        wanted = (angles - radius[None, :] <= reach[:, None] + 1e-9) & np.isfinite(angles)
        done, lists = nearest(None, None, angles, None)
        wanted[done, lists] = False
        return np.nonzero(wanted)

    second = _scored(_probe(again, index, open_lists), index, k)
    return best_k(first.union(second), k)


def probes_for(index: VectorIndex, queries: DataFrame, k: int, recall: float, most_queries: int = 200) -> int:
    """Probes that find the given share of the true k nearest rows, as measured on a bounded sample of queries.

    The sample (those of the smallest hashes, at most most_queries) is answered exactly; a true
    neighbour needs as many probes as its list's place among the query's centroids.
    """
    spark = queries.sparkSession
    sample = checkpointed(queries.where("id is not null").orderBy(F.xxhash64("id", F.lit(5)), "id").limit(most_queries).select("id", "vec"))
    true = checkpointed(search(index, sample, k, exact=True).select("query_id", "id"))  # at most most_queries * k rows
    held = index.blocks(spark).select("list", F.explode("ids").alias("id")).join(F.broadcast(true), "id").select("query_id", "list").collect()
    rows = sample.collect()
    _, unit = units(pa.array([r["vec"] for r in rows], pa.list_(pa.float64())), index.centroids.shape[1])
    if not held or len(unit) < len(rows):
        return len(index.centroids)
    angles = np.where(index.rows > 0, np.arccos(np.clip(unit @ index.centroids.T, -1, 1)), np.inf)
    place = np.argsort(np.argsort(angles, axis=1, kind="stable"), axis=1, kind="stable")
    at = {r["id"]: n for n, r in enumerate(rows)}
    needed = np.sort([place[at[r["query_id"]], r["list"]] + 1 for r in held])
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)])
