"""Near-duplicate documents: n-gram Jaccard join by MinHash banding, verified on full shingle sets.

Bands and rows are chosen for a target recall at the threshold (choose_bands). Documents
with the same shingle set are one representative from the start, so exact copies cost a
row each. Representatives are dealt by band hash; each bucket links its members to its
smallest one (a pre-aggregated minimum, so a bucket of any size costs one row a member).
The linked members form candidate groups, and inside each group all pairs are verified on
full shingle sets: the sets are laid out as a sparse matrix whose product counts common
shingles, so pairs are never rows. Groups over BLOCK_DOCS members are split into blocks,
and each pair of blocks is a task of its own.

A text is split into words (runs of other than ASCII white space), shingles are windows of
`width` words; a shorter text is one shingle. Texts without a word (null, empty) belong to
no group: class_id is their own doc_id and n_links 0. A link is another document (row) at
a similarity of `threshold` or more, copies included; class_id is the smallest doc_id that
links reach. Rows with one doc_id are one document each and count as copies or links of
each other; sets are told apart by name, so a doc_id may have several texts. Columns other than
the id and the text are ignored. Null ids are dropped. An empty table gives no rows. Long texts
are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, connected_components, discard, hash_words, mix64, shingle_hashes, small_batches, texts_of, write_table

BLOCK_DOCS = 400


def choose_bands(threshold: float, recall: float, rows: range = range(4, 9), most: int = 64) -> tuple[int, int]:
    """(bands, rows): the most selective banding whose chance to meet at the threshold is the recall or more."""
    best = None
    for r in rows:
        for b in range(1, most + 1):
            if 1 - (1 - threshold**r) ** b >= recall:
                best = (b, r)
                break
    if best is None:
        raise ValueError("no banding of this size reaches the recall")
    return best


def band_hashes(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash a band from the MinHash values of a shingle set."""
    seeds = mix64(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    low = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    step = max(1, 400_000 // len(seeds))
    for k in range(0, len(shingles), step):
        part = (shingles[k : k + step, None] ^ seeds[None, :]) * np.uint64(0xD6E8FEB86659FD93)
        np.minimum(low, (part ^ (part >> np.uint64(32))).min(axis=0), out=low)
    out = np.arange(bands, dtype=np.uint64)
    for column in low.reshape(bands, rows).T:
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out


def set_name(shingles: np.ndarray) -> tuple[int | None, int | None]:
    """Two 64-bit hashes of a set of shingle hashes; none of the empty set."""
    if not len(shingles):
        return None, None
    return int(shingles.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix64(shingles)).view(np.int64))


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (128-bit name of the shingle set), bands; texts without a word have none."""
    small_batches(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in filter(len, batches):
            sizes, names_a, names_b, signed = [], [], [], []
            for t in texts_of(batch):
                s = shingle_hashes(hash_words(WORD.findall(t), cache), width)
                sizes.append(len(s))
                a, b = set_name(s)
                names_a.append(a)
                names_b.append(b)
                signed.append(band_hashes(s, bands, rows).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(names_a, pa.int64()), pa.array(names_b, pa.int64()), pa.array(signed, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(sign, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def _links(sets: list[np.ndarray], others: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) at the threshold or more; i < j where others is None."""
    right = sets if others is None else others
    flat = np.concatenate(right)
    owner = np.repeat(np.arange(len(right)), [len(s) for s in right])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    sizes = np.array([len(s) for s in right])
    got_i, got_j = [], []
    for i, s in enumerate(sets):
        a, b = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
        n = b - a
        at = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(right))
        # exact: common / union >= threshold, the threshold as thousandths
        hit = 1000 * common >= round(1000 * threshold) * (len(s) + sizes - common)
        j = np.flatnonzero(hit & (common > 0))
        j = j[j > i] if others is None else j
        got_i.append(np.full(len(j), i))
        got_j.append(j)
    return np.concatenate(got_i), np.concatenate(got_j)


def _verifier(threshold: float):
    def verify(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, p, q = key
        rows = rows.drop_duplicates("set_id")  # equal rows
        left = rows[rows["blk"] == p].sort_values("set_id").reset_index(drop=True)
        right = left if p == q else rows[rows["blk"] == q].sort_values("set_id").reset_index(drop=True)
        if not len(left) or not len(right):
            return pd.DataFrame({"set_id": [], "partner": [], "links": []})
        sets = lambda d: [np.frombuffer(b, np.uint64) for b in d["shingles"]]
        i, j = _links(sets(left), None if p == q else sets(right), threshold)
        a, b = left["set_id"].to_numpy()[i], right["set_id"].to_numpy()[j]
        weight = pd.concat([left, right]).drop_duplicates("set_id").set_index("set_id")["copies"]
        both = pd.DataFrame({"set_id": np.concatenate([a, b]), "partner": np.concatenate([b, a])})
        both["links"] = weight.reindex(both["partner"]).to_numpy()
        # chains of links end at the smallest member that this task can see
        root = {d: d for d in weight.index}

        def find(d: int) -> int:
            while root[d] != d:
                root[d] = root[root[d]]
                d = root[d]
            return d

        for x, y in zip(a, b, strict=True):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
        out = both.groupby("set_id", as_index=False)["links"].sum()
        out["partner"] = [find(d) for d in out["set_id"]]
        return out[["set_id", "partner", "links"]]

    return verify


def join(docs: DataFrame, width: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """doc_id, class_id, n_links: one row a document."""
    bands, rows = choose_bands(threshold, recall)
    signed = write_table(signatures(docs, width, bands, rows), "signatures")
    # a set of shingles is told by its number from here on: one doc_id may have several texts
    names = ["set_a", "set_b", "n_shingles"]
    reps = signed.where("set_a is not null").groupBy(*names).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    reps = write_table(reps.select(F.monotonically_increasing_id().alias("set_id"), "*"), "sets")
    # band rows of representatives only
    first = signed.withColumnRenamed("doc_id", "rep").join(reps, [*names, "rep"]).select("set_id", "bands").dropDuplicates(["set_id"])
    banded = write_table(first.select("set_id", F.explode("bands").alias("band")), "bands")
    lowest = banded.groupBy("band").agg(F.min("set_id").alias("low"), F.count("*").alias("n")).where("n > 1").select("band", "low")
    candidates = banded.join(lowest, "band").where("set_id != low").select(F.col("set_id").alias("a"), F.col("low").alias("b"))
    groups = write_table(connected_components(candidates), "groups")
    discard(banded)

    # whole texts of the members, once for each block pair they take part in
    sized = groups.groupBy("component").agg(F.count("*").alias("members"))
    members = groups.withColumnRenamed("id", "set_id").join(sized, "component").join(reps.select("set_id", "rep", "copies", "set_a", "set_b"), "set_id")
    blocks = F.ceil(F.col("members") / BLOCK_DOCS).cast("int")
    members = members.withColumn("blocks", blocks).withColumn("blk", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in filter(len, batches):
            made = [shingle_hashes(hash_words(WORD.findall(t), cache), width) for t in texts_of(batch)]
            own = [set_name(s) for s in made]
            keep = ["set_id", "component", "blocks", "blk", "copies"]
            # a row of the same doc_id with another text isn't the one wanted
            wanted = pa.array([n == (a, b) for n, a, b in zip(own, batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)], pa.bool_())
            out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array([s.tobytes() for s in made], pa.binary())], names=[*keep, "shingles"])
            yield out.filter(wanted)

    wanted = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(members, "rep")
    held = wanted.select("text", "set_id", "component", "blocks", "blk", "copies", "set_a", "set_b").mapInArrow(shingle, "set_id long, component long, blocks int, blk int, copies long, shingles binary")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("blk")).alias("p"), F.greatest(k, F.col("blk")).alias("q")))
    dealt = held.select("set_id", "component", "blk", "copies", "shingles", F.explode(pairs).alias("pq")).select("*", "pq.p", "pq.q").drop("pq")
    links = write_table(dealt.groupBy("component", "p", "q").applyInPandas(_verifier(threshold), "set_id long, partner long, links long"), "links")

    linked = connected_components(links.select(F.col("set_id").alias("a"), F.col("partner").alias("b"))).withColumnRenamed("id", "set_id")
    lowest_id = linked.join(reps.select("set_id", "rep"), "set_id").groupBy("component").agg(F.min("rep").alias("class_id"))
    classes = linked.join(lowest_id, "component").select("set_id", "class_id")
    counted = links.groupBy("set_id").agg(F.sum("links").alias("links"))
    named = reps.join(classes, "set_id", "left").join(counted, "set_id", "left").select(*names, F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return signed.select("doc_id", *names).join(named, names, "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
