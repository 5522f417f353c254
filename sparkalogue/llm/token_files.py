"""Token ids in binary blocks: one zstandard frame a document, over one shared dictionary.

Format. The files are Parquet, so that any store that Spark can write holds them; each row
is a block of consecutive documents of one shard, shards and blocks ascending in doc_id:

    shard int, block int         place of the block
    dict_hash string             sha256 of the dictionary (empty: none was needed)
    id_bytes int                 bytes of a stored id: 2, or 4 for vocabularies over 65536
    doc_ids array<long>          documents of the block, ascending
    n_tokens array<long>         ids of each
    ends array<long>             end of each document's frame in `frames`
    frames binary                the frames, one after another

To read one short document, find its block by shard and doc_ids, slice `frames` by `ends`
and decompress that frame alone. The dictionary is a file of one row beside the blocks.

The dictionary is trained on serialized ids of a bounded sample of documents (SAMPLE_DOCS
rows by hash of the id, SAMPLE_BYTES of each); every document is encoded whole.

Null or empty text: the end id alone. A null doc_id sorts first. Equal ids keep all rows. An
empty table makes files without a block, and no rows. Long texts are one frame each. Columns
other than the id and the text are ignored, so their names don't matter.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import discard, session_conf, shared_dir, small_batches, texts_of, write_table

SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 1500, 16_384, 65_536
BLOCK_DOCS, BLOCK_BYTES = 512, 4 << 20
BLOCKS = "shard int, block int, dict_hash string, id_bytes int, doc_ids array<long>, n_tokens array<long>, ends array<long>, frames binary"


def _serialize(ids: bytes, id_bytes: int) -> bytes:
    return ids if id_bytes == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, id_bytes: int) -> bytes:
    """Dictionary bytes; empty where the sample is too small to train on."""
    n = docs.count()
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // SAMPLE_DOCS))) == 0).select("text")

    def serialize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            ids = tokens.encoder(tokenizer).encode(texts_of(batch))
            yield pa.RecordBatch.from_pydict({"ids": [_serialize(x, id_bytes)[:SAMPLE_BYTES] for x in ids]})

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # in an order that doesn't depend on which task came first
        samples = sorted(x for f in frames for x in f["ids"] if len(x) >= 8)
        try:
            made = zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
        except zstandard.ZstdError:
            made = b""
        yield pd.DataFrame({"dict": [made]})

    # written first: else the one task that trains would read all documents
    held = write_table(sample.mapInArrow(serialize, "ids binary"), "sample")
    rows = held.coalesce(1).mapInPandas(train, "dict binary").collect()
    discard(held)
    return bytes(rows[0]["dict"]) if rows else b""


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, level: int = 3) -> None:
    """Encode all documents into blocks under path/blocks, the dictionary under path/dictionary."""
    spark = docs.sparkSession
    small_batches(spark)
    id_bytes = 2 if tokens.encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    dictionary = train_dictionary(docs, tokenizer, id_bytes)
    digest = hashlib.sha256(dictionary).hexdigest() if dictionary else ""
    spark.createDataFrame([(digest, bytearray(dictionary))], "dict_hash string, dict binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, end = TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if shared:
            shared.precompute_compress(level=level)  # else every frame would digest the dictionary anew
        press = zstandard.ZstdCompressor(dict_data=shared) if shared else zstandard.ZstdCompressor(level=level)
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("dict_hash", pa.string()), ("id_bytes", pa.int32()), *[(c, pa.list_(pa.int64())) for c in ("doc_ids", "n_tokens", "ends")], ("frames", pa.binary())])

        def row(held: list) -> pa.RecordBatch:
            frames = [f for _, _, f in held]
            made = {"shard": [shard], "block": [block], "dict_hash": [digest], "id_bytes": [id_bytes], "doc_ids": [[d for d, _, _ in held]], "n_tokens": [[n for _, n, _ in held]], "ends": [np.cumsum([len(f) for f in frames]).tolist()], "frames": [b"".join(frames)]}
            return pa.RecordBatch.from_pydict(made, schema=schema)

        held, size = [], 0
        for batch in filter(len, batches):
            for d, ids in zip(batch.column("doc_id").to_pylist(), tokens.encoder(tokenizer).encode(texts_of(batch)), strict=True):
                frame = press.compress(_serialize(ids + end, id_bytes))
                held.append((d, len(ids) // 4 + 1, frame))
                size += len(frame)
                if len(held) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield row(held)
                    held, size, block = [], 0, block + 1
        if held:
            yield row(held)

    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ranged.mapInArrow(encode, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """Ids of the documents of this id (one array each): only blocks that hold the id are read, and only its own frames decompressed."""
    held = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = zstandard.ZstdCompressionDict(bytes(held["dict"])) if held["dict_hash"] else None
    unpress, out = zstandard.ZstdDecompressor(dict_data=dictionary), []
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where(F.array_contains("doc_ids", F.lit(doc_id).cast("long")))
    # the frame by its place: position, end of the one before, and its bytes
    spot = F.posexplode("doc_ids").alias("at", "id")
    places = blocks.select("shard", "block", "dict_hash", "id_bytes", "ends", "frames", spot).where(F.col("id") == doc_id)
    begin = F.when(F.col("at") > 0, F.get("ends", F.col("at") - 1)).otherwise(F.lit(0))
    frame = F.substring("frames", (begin + 1).cast("int"), (F.get("ends", "at") - begin).cast("int"))
    for r in places.select("shard", "block", "at", "dict_hash", "id_bytes", frame.alias("frame")).orderBy("shard", "block", "at").toLocalIterator():
        if r["dict_hash"] != held["dict_hash"]:
            raise ValueError("a block was written with another dictionary")
        out.append(np.frombuffer(unpress.decompress(bytes(r["frame"])), f"<u{r['id_bytes']}").astype("<u4"))
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["dict"])
    digest = hashlib.sha256(dictionary).hexdigest() if dictionary else ""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        unpress = zstandard.ZstdDecompressor(dict_data=shared)
        for batch in filter(len, batches):
            for b in batch.to_pylist():
                if b["dict_hash"] != digest:
                    raise ValueError("a block was written with another dictionary")
                begin, crcs, view = 0, [], memoryview(b["frames"])
                for end, n in zip(b["ends"], b["n_tokens"], strict=True):
                    ids = np.frombuffer(unpress.decompress(view[begin:end]), f"<u{b['id_bytes']}")
                    if len(ids) != n:
                        raise ValueError("a frame doesn't hold the ids that the index says")
                    crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    begin = end
                n = np.array(b["n_tokens"], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b["shard"]] * len(n), pa.int32()), pa.array([b["block"]] * len(n), pa.int32()), pa.array(b["doc_ids"], pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n), pa.array(crcs, pa.int64())],
                    names=["shard", "block", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    with session_conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch="16"):  # a row is a whole block
        found = write_table(blocks.mapInArrow(decode, "shard int, block int, doc_id long, within long, n_tokens long, ids_crc32 long"), "decoded")
    # a shard is a write task, so one window over shards is as small as the list of tasks
    sums = blocks.select("shard", "block", F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = sums.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(before, F.lit(0)).alias("s0"))
    earlier = F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("shard", "block", F.coalesce(earlier, F.lit(0)).alias("b0")).join(shards, "shard").select("shard", "block", (F.col("b0") + F.col("s0")).alias("base"))
    return found.join(starts, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
