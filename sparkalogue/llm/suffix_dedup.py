"""Exact substring de-duplication by enhanced suffix arrays over a whole corpus.

A byte goes if a string of `least` bytes covers it that starts anywhere else in the corpus,
in the same document or another; strings never cross documents and are judged on the input.

How equal strings meet. Every string of `least` bytes has an anchor: its smallest hash of
GRAM bytes. Equal strings have equal anchors, and all strings with one anchor in a document
form a segment, so a document of n bytes has about 2 n / least segments. Segments that
occur whole more than once are settled by counting. The others are grouped by anchor: each
different segment (told apart by two 64-bit hashes, of the anchor and of the whole) goes once into the bucket of its anchor. In a bucket an enhanced suffix
array (ranks of ever longer prefixes; longest common prefixes by those ranks) is scanned with a
stack for the intervals of common prefixes of `least` bytes or more whose members differ on
their left (or start a segment): these are the maximal repeats, with all occurrences.
An anchor with more than SPLIT different segments is split by the core that a few
neighbouring strings share, so that equal strings still meet. Parts that occur more than once
under a core are settled by counting, and one of each different part goes on; a core with more
than SPLIT different parts is cut down to its single strings, which meet by counting alone. So
no key sends more than SPLIT parts to one task, however often a passage is repeated.

Null or empty text: no bytes, nothing removed. Texts shorter than `least` stay whole. Equal
rows are copies of each other. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mix64, small_batches, write_table

GRAM = 24
SPLIT, CORE_STEP = 1000, 16
BUCKET_BYTES = 1_500_000
#: Bytes of a text scanned at a time.
STRETCH = 16 << 20
_POSITION = np.uint64((1 << 26) - 1)


def segments(data: bytes, least: int) -> list[tuple[int, int, int, int]]:
    """(anchor hash, anchor position, first start, last start) of all strings of `least` bytes, by anchor."""
    out = []
    for base in range(0, len(data) - least + 1, STRETCH):
        part = data[base : base + STRETCH + least - 1]
        n = len(part) - GRAM + 1
        words = np.ndarray((len(part) - 7,), dtype="<u8", buffer=part, strides=(1,)).copy()
        h = mix64(words[:n] * np.uint64(0x9E3779B97F4A7C15) + words[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F) + words[16 : 16 + n] * np.uint64(0x165667B19E3779F9))
        # smallest hash in each run of `wide` grams, the leftmost of equals: minima from the left and right of blocks
        wide = least - GRAM + 1
        v = (h & ~_POSITION) | np.arange(n, dtype=np.uint64)
        padded = np.full(-(-n // wide) * wide, np.iinfo(np.uint64).max, dtype=np.uint64)
        padded[:n] = v
        grid = padded.reshape(-1, wide)
        left = np.minimum.accumulate(grid, axis=1).ravel()
        right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = n - wide + 1
        low = np.minimum(right[:starts], left[wide - 1 : wide - 1 + starts])
        first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        last = np.concatenate((first[1:] - 1, [starts - 1]))
        at = (low[first] & _POSITION).astype(np.int64)
        out += zip(h[at].view(np.int64).tolist(), (at + base).tolist(), (first + base).tolist(), (last + base).tolist(), strict=True)
    return out


def _sides(data: bytes, at: int, lo: int, end: int, half: int) -> int:
    """Hashes of the anchor with `half` bytes to its left (upper 32 bits) and to its right (lower 32); 0 where the segment has fewer."""
    left = xxhash.xxh32_intdigest(data[at - half : at + GRAM]) | 1 if at - half >= lo else 0
    right = xxhash.xxh32_intdigest(data[at : at + GRAM + half]) | 1 if at + GRAM + half <= end else 0
    both = left << 32 | right
    return both - (1 << 64) if both >> 63 else both


def suffix_array(data: np.ndarray, remain: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes with `least` bytes or more left of their segment, in order, and each one's common prefix with the one before.

    remain: bytes from each position to its segment's end. Bytes past a segment's end count as 0,
    other bytes as 1 more than their value, and common prefixes end with the shorter segment.
    """
    n, longest = len(data), int(remain.max(initial=0))
    width = 7
    symbol = np.concatenate([data.astype(np.int64) + 1, np.zeros(width, np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for k in range(width):
        key = key << 9 | np.where(remain > k, symbol[k : n + k], 0)
    levels = []
    while True:
        rank = np.unique(key, return_inverse=True)[1] + 1
        levels.append((width, rank))
        if width >= longest:
            break
        # ranks of up to 21 bits: three stretches make a key, else two
        times, bits = (3, 21) if n < (1 << 21) - 1 else (2, 31)
        key = rank
        for k in range(1, times):
            after = np.zeros(n, dtype=np.int64)
            if k * width < n:
                after[: n - k * width] = rank[k * width :]
            key = key << bits | np.where(remain > k * width, after, 0)
        width *= times
    wanted = np.flatnonzero(remain >= least)
    order = wanted[np.argsort(levels[-1][1][wanted], kind="stable")]
    lcp = np.zeros(len(order), dtype=np.int64)
    if len(order) > 1:
        a, b, got = order[:-1], order[1:], np.zeros(len(order) - 1, dtype=np.int64)
        most = np.minimum(remain[a], remain[b])
        for width, rank in levels[::-1]:
            for _ in range(2):  # a level up to three times as wide was tried before
                x, y = np.minimum(a + got, n - 1), np.minimum(b + got, n - 1)
                got += np.where((got < most) & (rank[x] == rank[y]), width, 0)
        for _ in range(6):
            x, y = np.minimum(a + got, n - 1), np.minimum(b + got, n - 1)
            got += (got < most) & (data[x] == data[y])
        lcp[1:] = np.minimum(got, most)
    return order, lcp


def maximal_repeats(lcp: np.ndarray, left: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the common-prefix intervals of `least` or more whose members differ on the left.

    lcp[i]: common prefix of suffixes i - 1 and i; left[i]: the byte before suffix i, below 0 where there is none.
    """
    n = len(lcp)
    joined = lcp >= least
    first = np.flatnonzero(joined & ~np.concatenate(([False], joined[:-1])))  # second member of each run
    if not len(first):
        return
    last = np.flatnonzero(joined & ~np.concatenate((joined[1:], [False])))
    # runs in which all members have one left byte extend to the left as a whole
    edges = np.stack([first - 1, last + 1], axis=1).ravel()
    padded = np.concatenate([left, [0]])
    low, high = np.minimum.reduceat(padded, edges)[::2], np.maximum.reduceat(padded, edges)[::2]
    for r in np.flatnonzero((low < 0) | (low != high)):
        a, b = int(first[r]) - 1, int(last[r])
        lengths, lefts = lcp[a + 1 : b + 1].tolist(), left[a : b + 1].tolist()
        stack: list[list] = []  # [length, first member, the left byte of all or None]
        for k in range(b - a + 1):
            here = lengths[k] if k < b - a else -1  # with the next suffix
            begin, same = k, lefts[k] if lefts[k] >= 0 else None
            while stack and stack[-1][0] > here:
                length, begin, own = stack.pop()
                same = own if own == same else None
                if same is None:
                    yield length, a + begin, a + k
            if here < 0:
                continue
            if stack and stack[-1][0] == here:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == same else None
            else:
                stack.append([here, begin, same])
    assert n == len(left)


def covered(parts: list[bytes], least: int) -> list[tuple[int, int, int]]:
    """(part, start, end) stretches of the parts that lie in maximal repeats of `least` bytes or more."""
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    remain = np.repeat(ends, sizes) - np.arange(len(data))
    order, lcp = suffix_array(data, remain, least)
    begins = ends - sizes
    part = np.repeat(np.arange(len(parts)), sizes)[order]
    left = np.where(order == begins[part], -1, data[np.maximum(order - 1, 0)].astype(np.int64))
    reach = np.zeros(len(order), dtype=np.int64)
    for length, a, b in maximal_repeats(lcp, left, least):
        np.maximum(reach[a : b + 1], length, out=reach[a : b + 1])
    hit = np.flatnonzero(reach)
    start = order[hit] - begins[part[hit]]
    return list(zip(part[hit].tolist(), start.tolist(), (start + reach[hit]).tolist(), strict=True))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _bytes(text: str | None) -> bytes:
    return (text or "").encode()


def _cutter(least: int, split: bool):
    """Bytes of the wanted segments of a text, by the key under which equal strings meet."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "row", "start", "once", "part"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        for batch in filter(len, batches):
            rows = []
            for row, text, wanted in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                data = _bytes(text)
                for s in wanted:
                    lo, hi, at = s["first"], s["last"], s["at"]
                    if not split:
                        rows.append((s["anchor"], row, lo, s["once"], data[lo : hi + least]))
                        continue
                    for c in range((at - hi) // CORE_STEP, (at - lo) // CORE_STEP + 1):
                        p1, p0 = at - c * CORE_STEP, at - c * CORE_STEP - CORE_STEP + 1
                        core = data[p1 : p0 + least]
                        a, b = max(lo, p0), min(hi, p1)
                        key = xxhash.xxh3_64_intdigest(core + c.to_bytes(4, "little")) - (1 << 63)
                        rows.append((key, row, a, s["once"], data[a : b + least]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return cut


def _strings(least: int):
    """The single strings of parts, by the part's key and a hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, row, start, once, part in zip(*[batch.column(c).to_pylist() for c in ("key", "row", "start", "once", "part")], strict=True):
                rows += [(key, row, start + k, once, xxhash.xxh3_64_intdigest(part[k : k + least]) - (1 << 63)) for k in range(len(part) - least + 1)]
            if rows:
                kinds = (*[pa.int64()] * 3, pa.bool_(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "row", "start", "once", "string"])

    return cut


def settle_parts(parts: DataFrame, least: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(spans found by counting, parts left for the suffix arrays, at most `most` a key)."""
    named = write_table(parts.withColumn("name", F.xxhash64("part")), "parts")
    kinds = named.groupBy("key", "name").agg(F.count("*").alias("n"), F.min(F.struct("row", "start", "once", "part")).alias("rep"))
    kinds = write_table(kinds.select("key", "name", "n", "rep.row", "rep.start", (F.col("rep.once") & (F.col("n") == 1)).alias("once"), "rep.part"), "kinds")
    again = kinds.where("n > 1").select("key", "name")
    spans = named.where("once").join(again, ["key", "name"]).select("row", "start", (F.col("start") + F.length("part")).alias("end"))
    of_key = kinds.groupBy("key").agg(F.count("*").alias("of_key")).where("of_key > 1")
    open_ones = kinds.join(of_key, "key")
    strings = open_ones.where(F.col("of_key") > most).select("key", "row", "start", "once", "part").mapInArrow(_strings(least), "key long, row long, start long, once boolean, string long")
    strings = write_table(strings, "strings")
    met = strings.groupBy("key", "string").agg(F.count("*").alias("n")).where("n > 1").select("key", "string")
    spans = spans.union(strings.where("once").join(met, ["key", "string"]).select("row", "start", (F.col("start") + least).alias("end")))
    return spans, open_ones.where(F.col("of_key") <= most).select("key", "row", "start", "once", "part")


def remove_repeats(docs: DataFrame, least: int = 400) -> DataFrame:
    """doc_id, n_bytes long, spans array<struct<start, end>> (removed runs of bytes), kept binary."""
    if least < GRAM + 1:
        raise ValueError(f"strings must have over {GRAM} bytes")
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("doc_id", "text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            cols: list[list] = [[] for _ in range(7)]
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = _bytes(text)
                if len(data) < least:
                    continue
                for anchor, at, lo, hi in segments(data, least):
                    name = xxhash.xxh3_64_intdigest(data[lo : hi + least]) - (1 << 63)
                    for c, x in zip(cols, (anchor, name, row, at, lo, hi, _sides(data, at, lo, hi + least, half)), strict=True):
                        c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["anchor", "name", "row", "at", "first", "last", "sides"])

    half = (least - GRAM + 1) // 2
    schema = "anchor long, name long, row long, at long, first long, last long, sides long"
    found = write_table(docs.select("row", "text").mapInArrow(scan, schema), "segments")
    distinct = found.groupBy("anchor", "name").agg(F.count("*").alias("n"), F.min(F.struct("row", "at", "first", "last", "sides")).alias("rep"))
    distinct = write_table(distinct, "distinct")
    whole = found.join(distinct.where("n > 1").select("anchor", "name"), ["anchor", "name"]).select("row", F.col("first").alias("start"), (F.col("last") + least).alias("end"))

    shared = distinct.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    met = write_table(distinct.join(shared.select("anchor"), "anchor").select("rep.*", "anchor", (F.col("n") == 1).alias("once")), "met")
    # equal strings lie alike around their anchor, and share what is left or right of it up to half their length
    low = F.lit((1 << 32) - 1)
    sides = {"left": F.shiftrightunsigned("sides", 32), "right": F.col("sides").bitwiseAND(low)}
    for side, value in sides.items():
        again = met.where(value != 0).groupBy("anchor", value.alias(side)).agg(F.count("*").alias(f"n_{side}")).where(f"n_{side} > 1")
        met = met.withColumn(side, value).join(again, ["anchor", side], "left")
    met = write_table(met.where("n_left > 1 or n_right > 1").drop("sides", "left", "right", "n_left", "n_right"), "kin")
    kinds = met.groupBy("anchor").agg(F.count("*").alias("kinds"))
    open_ones = write_table(met.join(kinds, "anchor").withColumn("split", F.col("kinds") > SPLIT), "open")
    size = open_ones.agg(F.sum(F.col("last") - F.col("first") + least)).first()[0] or 0
    buckets = max(1, size // BUCKET_BYTES)
    def parts(segs: DataFrame, split: bool) -> DataFrame:
        wanted = segs.groupBy("row").agg(F.collect_list(F.struct("at", "first", "last", "anchor", "once")).alias("wanted"))
        return docs.select("row", "text").join(wanted, "row").mapInArrow(_cutter(least, split), "key long, row long, start long, once boolean, part binary")

    cut = parts(open_ones.where("not split"), False)
    if not open_ones.where("split").isEmpty():
        counted, left = settle_parts(parts(open_ones.where("split"), True), least, SPLIT)
        whole, cut = whole.union(counted), cut.union(left)

    def repeats(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["row", "start", "key"])
        if not len(rows):
            return pd.DataFrame({"row": [], "start": [], "end": []})
        row, start, once = rows["row"].to_numpy(), rows["start"].to_numpy(), rows["once"].to_numpy()
        got = [(row[p], start[p] + a, start[p] + b) for p, a, b in covered(rows["part"].tolist(), least) if once[p]]
        return pd.DataFrame(got, columns=["row", "start", "end"]).astype("int64")

    edges = cut.withColumn("bucket", F.pmod("key", F.lit(buckets))).groupBy("bucket").applyInPandas(lambda rows: repeats(rows), "row long, start long, end long")
    spans = write_table(whole.union(edges), "spans")
    by_row = spans.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("found"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in filter(len, batches):
            sizes, removed, kept = [], [], []
            for text, found_here in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
                data = _bytes(text)
                gone = merge([(s["start"], s["end"]) for s in found_here or []])
                edge = [0, *[x for s in gone for x in s], len(data)]
                sizes.append(len(data))
                removed.append([{"start": a, "end": b} for a, b in gone])
                kept.append(b"".join(data[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return docs.join(by_row, "row", "left").select("doc_id", "text", "found").mapInArrow(remove, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
