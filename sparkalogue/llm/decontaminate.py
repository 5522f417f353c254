"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, rare shingles, exact check.

Items are sorted into size classes (a geometric ladder). In each class a window of W words,
four fifths of the class's smallest item, slides over documents by W's share of slack, so
that a document which holds an item verbatim has a window that lies wholly inside it and
equals one of the item's own windows of W words. Fingerprints are 64-bit SimHashes with words
weighted by length. They are cut into radius + 1 blocks: two fingerprints within the
radius agree on one block at least, so looking up each block finds all of them.

One changed word can flip more bits than any radius that blocks can serve, so fingerprints
alone lose near copies. Candidates are therefore completed by rare shingles: an item's
shingles (`width` words) are taken by falling weight until what is left weighs less than the
threshold's share of the whole. A stretch that holds none of those taken can't reach the
threshold, so looking up every shingle of a document among them finds every match.

Candidates are verified: the item is laid at each word of the document where it may match, and
the weighted Jaccard similarity of its shingles (weight 1 / number of items that hold the
shingle) with those of the item-sized stretch of the document must reach the threshold; the
best place counts, the first of equals. Words are lower-cased runs of other than ASCII white space; an item shorter than
the shingle width is one shingle. Items and texts without a word (null, empty) match
nothing. Repeated items or rows match each on its own.

The items are a stated query set: they are taken in blocks of about ITEM_BLOCK items or
ITEM_BYTES bytes, dealt by hash (sent to every task), and each block reads all documents. Holders are
counted once over all items, and every block gets the counts of the shingles that several items
hold, by 64-bit hash (16 bytes each), so that no result depends on the blocks.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, small_batches, texts_of, write_table

ITEM_BLOCK, ITEM_BYTES = 20_000, 1_000_000
#: Words whose window sums are held at a time, few enough for a processor's cache.
STRETCH = 12_000


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words; bytes split at ASCII white space only."""
    return (text or "").lower().encode().split()


def size_class(n: int) -> tuple[int, int]:
    """(window, stride) for items of n words: floor of n on a ladder of ratio 5/4."""
    c = 1
    while (up := max(c + 1, c * 5 // 4)) <= n:
        c = up
    window = max(1, math.ceil(0.8 * c))
    return window, c - window + 1


def bit_table(words: list[bytes], hashes: np.ndarray | None = None) -> np.ndarray:
    """A row of 64 signed weights for each word: bits of its hash, weighted by its length in bytes up to 12."""
    bits = np.unpackbits((word_hashes(words) if hashes is None else hashes).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8)
    weight = np.array([min(len(w), 12) for w in words], dtype=np.int8)
    return (2 * bits - 1) * weight[:, None]


def fingerprints(sums: np.ndarray, window: int, starts: np.ndarray) -> np.ndarray:
    """SimHash of the windows that begin at `starts`; sums are running sums with a zero row first."""
    return np.packbits(sums[starts + window] - sums[starts] > 0, axis=1).view(np.uint64).ravel()


def running_sums(rows: np.ndarray, window: int | None = None) -> np.ndarray:
    """Sums of the rows before each; of 16 bits if `window` words, of 12 at most each, can't exceed these: differences hold though sums wrap round."""
    dtype = np.int16 if window is not None and 12 * window < 1 << 15 else np.int32
    out = np.zeros((len(rows) + 1, 64), dtype=dtype)
    np.cumsum(rows, axis=0, dtype=dtype, out=out[1:])
    return out


def shingle_list(words: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    k = min(width, len(words))
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] if words else []


def shingles(words: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    return set(shingle_list(words, width))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return mix64(np.array([zlib.crc32(w) | zlib.crc32(w[::-1], 1) << 32 for w in words], dtype=np.uint64))


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 words begin none."""
    n = max(len(hashes) - k + 1, 0)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = (out ^ hashes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def rare_shingles(own: set[tuple[bytes, ...]], weights: Holders, threshold: float) -> list[tuple[bytes, ...]]:
    """The heaviest shingles, until the others weigh less than the threshold's share of all."""
    ordered = sorted(own, key=lambda s: (weights[s], s))
    left = total = sum(1 / weights[s] for s in ordered)
    for n, s in enumerate(ordered):
        if left < threshold * total * (1 - 1e-9):
            return ordered[:n]
        left -= 1 / weights[s]
    return ordered


@dataclass
class RareIndex:
    """Rare shingles of one length: sorted hashes, their items, a bitmap."""

    length: int
    keys: np.ndarray
    item: np.ndarray
    bitmap: np.ndarray


def build_rare(own: list[set[tuple[bytes, ...]]], weights: Holders, threshold: float) -> list[RareIndex]:
    by_length = defaultdict(list)
    for k, held in enumerate(own):
        for s in rare_shingles(held, weights, threshold):
            by_length[len(s)].append((k, s))
    out = []
    for length, listed in sorted(by_length.items()):
        keys = run_hashes(word_hashes([w for _, s in listed for w in s]), length)[::length]
        order = np.argsort(keys, kind="stable")
        bitmap = np.zeros(1 << 20, dtype=bool)
        bitmap[keys >> np.uint64(44)] = True
        out.append(RareIndex(length, keys[order], np.array([k for k, _ in listed])[order], bitmap))
    return out


def holders(index: RareIndex, hashes: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, item) where a rare shingle begins; room: words from each one to its document's end."""
    keys = run_hashes(hashes, index.length)
    maybe = np.flatnonzero(index.bitmap[keys >> np.uint64(44)])
    maybe = maybe[room[maybe] >= index.length]
    a, b = np.searchsorted(index.keys, keys[maybe], "left"), np.searchsorted(index.keys, keys[maybe], "right")
    n = b - a
    at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
    return np.repeat(maybe, n), index.item[at]


def best_place(item: list[bytes], own: set[tuple[bytes, ...]], document: list[bytes], weights: Holders, width: int, threshold: float, there: list[tuple[bytes, ...]] | None = None, places: dict | None = None) -> tuple[float, int] | None:
    """(similarity, first word) of the stretch most like the item, if it reaches the threshold; the first of equals.

    there, places: the document's shingles, and where each begins, if the caller holds them.
    """
    k = min(width, len(item))
    if len(document) < k:
        return None
    if there is None or places is None:
        there = shingle_list(document, k)
        places = places_of(there)
    shared = [s for s in own if s in places]
    total = sum(1 / weights[s] for s in own)
    slack = threshold * (1 - 1e-9)
    if sum(1 / weights[s] for s in shared) < slack * total:
        return None
    hits = sorted(p for s in shared for p in places[s])
    size = len(item) - k + 1  # shingles of a stretch
    best = None
    at = 0
    while at < len(hits):
        # a run of hits that one stretch after another holds; its stretches are slid over word by word
        end = at
        while end + 1 < len(hits) and hits[end + 1] - hits[end] < size:
            end += 1
        first, last = max(0, hits[at] - size + 1), hits[end]
        inside: Counter = Counter()
        common = extra = 0.0
        upto = first
        for start in range(first, last + 1):
            while upto < min(start + size, len(there)):
                s = there[upto]
                inside[s] += 1
                if inside[s] == 1:
                    if s in own:
                        common += 1 / weights[s]
                    else:
                        extra += 1 / weights[s]
                upto += 1
            if common >= slack * (total + extra) * (1 - 1e-9):
                window = set(there[start : start + size])
                both = sum(1 / weights[s] for s in sorted(window & own))
                similarity = both / sum(1 / weights[s] for s in sorted(window | own))
                if similarity >= threshold and (best is None or similarity > best[0]):
                    best = similarity, start
            s = there[start]
            inside[s] -= 1
            if not inside[s]:
                if s in own:
                    common -= 1 / weights[s]
                else:
                    extra -= 1 / weights[s]
        at = end + 1
    return best


def places_of(there: list[tuple[bytes, ...]]) -> dict[tuple[bytes, ...], list[int]]:
    places = defaultdict(list)
    for p, s in enumerate(there):
        places[s].append(p)
    return places


@dataclass
class Index:
    """Fingerprints of one size class: block tables, and where each fingerprint comes from."""

    window: int
    stride: int
    prints: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    by_block: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # sorted block values, their fingerprints, a bitmap


def blocks_of(prints: np.ndarray, radius: int) -> list[np.ndarray]:
    """radius + 1 slices of the 64 bits."""
    edges = np.linspace(0, 64, radius + 2).astype(int)
    return [((prints >> np.uint64(a)) & np.uint64((1 << int(b - a)) - 1)).astype(np.int64) for a, b in zip(edges, edges[1:])]


def build(items: list[tuple[int, list[bytes]]], radius: int) -> list[Index]:
    classes = defaultdict(list)
    for k, (_, w) in enumerate(items):
        if w:
            classes[size_class(len(w))].append(k)
    out = []
    for (window, stride), members in sorted(classes.items()):
        prints, item, offset = [], [], []
        for k in members:
            w = items[k][1]
            sums = running_sums(bit_table(w))
            starts = np.arange(len(w) - window + 1)
            prints.append(fingerprints(sums, window, starts))
            item.append(np.full(len(starts), k))
            offset.append(starts)
        p = np.concatenate(prints)
        tables = []
        for values in blocks_of(p, radius):
            order = np.argsort(values, kind="stable")
            bitmap = np.zeros(1 << 16, dtype=bool)
            bitmap[values & 0xFFFF] = True
            tables.append((values[order], order, bitmap))
        out.append(Index(window, stride, p, np.concatenate(item), np.concatenate(offset), tables))
    return out


def candidates(index: Index, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(document window, item window) pairs within the radius."""
    got_w, got_i = [], []
    for (values, order, bitmap), own in zip(index.by_block, blocks_of(prints, radius), strict=True):
        maybe = np.flatnonzero(bitmap[own & 0xFFFF])
        a, b = np.searchsorted(values, own[maybe], "left"), np.searchsorted(values, own[maybe], "right")
        n = b - a
        which = np.repeat(maybe, n)
        at = order[np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())] if len(n) else np.zeros(0, int)
        near = np.bitwise_count(prints[which] ^ index.prints[at]) <= radius
        got_w.append(which[near])
        got_i.append(at[near])
    return np.concatenate(got_w), np.concatenate(got_i)


class Holders:
    """Number of items that hold a shingle: 1 unless it is among the shared ones."""

    def __init__(self, shared: tuple[np.ndarray, np.ndarray]):
        self.keys, self.counts = shared
        self.known: dict[tuple[bytes, ...], int] = {}

    def __getitem__(self, s: tuple[bytes, ...]) -> int:
        n = self.known.get(s)
        if n is None:
            if len(self.known) > 200_000:
                self.known.clear()
            n = 1
            if len(self.keys):
                key = shingle_key(s)
                at = min(int(np.searchsorted(self.keys, key)), len(self.keys) - 1)
                n = int(self.counts[at]) if self.keys[at] == key else 1
            self.known[s] = n
        return n


def shingle_key(s: tuple[bytes, ...]) -> int:
    """A hash as a signed 64-bit number."""
    return xxhash.xxh3_64_intdigest(b" ".join(s)) - (1 << 63)


def shared_shingles(items: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, number of items) of the shingles that several of all items hold; repeated items count each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            for t in texts_of(batch):
                keys = [shingle_key(s) for s in shingles(words_of(t), width)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], names=["key"])

    found = items.select("text").mapInArrow(cut, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").toArrow()
    keys, counts = found.column("key").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def matches(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, radius: int = 3) -> DataFrame:
    """doc_id, item_id, similarity, start_word: one row for each document and item that it holds."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = "doc_id long, item_id long, similarity double, start_word long"
    listed = write_table(items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null"), "items")
    shared = shared_shingles(listed, width)
    size = listed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_blocks = max(1, math.ceil(size[0] / ITEM_BLOCK), math.ceil(size[1] / ITEM_BYTES))
    # the row number deals out repeated items too; written, so that it is the same for every block
    dealt = write_table(listed.withColumn("block", F.pmod(F.xxhash64("item_id", F.monotonically_increasing_id()), F.lit(n_blocks))), "blocks")
    out = spark.createDataFrame([], schema)
    for k in range(n_blocks):
        part = dealt.where(F.col("block") == k).collect()
        block = [(r["item_id"], words_of(r["text"])) for r in part]
        out = out.union(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_searcher(block, shared, width, threshold, radius), schema))
    return out


def coded_words(texts: list[str | None]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """words_of() of some texts in one row, each different word once, and the number of words of each text."""
    lowered = pa.array([(t or "").lower() for t in texts], pa.large_string())
    split = pc.ascii_split_whitespace(lowered)
    flat = split.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    owner = pc.list_parent_indices(split).filter(full).to_numpy()
    return flat.filter(full).dictionary_encode(), np.bincount(owner, minlength=len(texts)).astype(np.int64)


class KnownWords:
    """Hashes and signed bits of words, kept by the worker for words seen before; it starts over from MOST on."""

    MOST = 400_000

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.table = np.zeros((1 << 14, 64), dtype=np.int8)
        self.hash_of = np.zeros(1 << 14, dtype=np.uint64)

    def numbered(self, different: pa.Array) -> np.ndarray:
        """Rows of different words in the tables, which are filled for new ones."""
        words = different.cast(pa.large_binary()).to_pylist()
        if len(self.numbers) > self.MOST:
            self.numbers.clear()
        held = list(map(self.numbers.get, words))
        if None in held:
            new = [w for w, k in zip(words, held, strict=True) if k is None]
            base = len(self.numbers)
            self.numbers.update(zip(new, range(base, base + len(new)), strict=True))
            while len(self.table) < len(self.numbers):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.hash_of = np.concatenate([self.hash_of, np.zeros_like(self.hash_of)])
            hashes = word_hashes(new)
            self.hash_of[base : base + len(new)] = hashes
            self.table[base : base + len(new)] = bit_table(new, hashes)
            held = map(self.numbers.__getitem__, words)
        return np.array(list(held), dtype=np.int64)


#: What a worker keeps: words, and the block of items that it has prepared.
_words = KnownWords()
_prepared: dict[str, tuple] = {}


def _searcher(items: list, shared: tuple[np.ndarray, np.ndarray], width: int, threshold: float, radius: int):
    prepared = uuid.uuid4().hex

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a worker prepares a block of items once, for all of its tasks
        if prepared not in _prepared:
            _prepared.clear()
            weights = Holders(shared)
            own = [shingles(w, width) for _, w in items]
            _prepared[prepared] = build(items, radius), weights, own, build_rare(own, weights, threshold)
        indexes, weights, own, rare = _prepared[prepared]
        longest = max([len(w) for _, w in items], default=0)
        for batch in filter(len, batches):
            # the batch's words in one row; windows stay on each document's own grid and within it
            texts = texts_of(batch)
            every, sizes = coded_words(texts)
            known = _words.numbered(every.dictionary)
            table, hash_of = _words.table, _words.hash_of
            ends = np.cumsum(sizes)
            begins = ends - sizes
            ids = known[every.indices.to_numpy(zero_copy_only=False)]
            local = np.arange(len(every)) - np.repeat(begins, sizes)
            room = np.repeat(ends, sizes) - np.arange(len(every))
            near: set[tuple[int, int]] = set()
            for at in range(0, len(every), STRETCH):
                sums = running_sums(table[ids[at : at + STRETCH + longest]], longest)
                for x in indexes:
                    starts = np.flatnonzero((local[at : at + STRETCH] % x.stride == 0) & (room[at : at + STRETCH] >= x.window))
                    if not len(starts):
                        continue
                    places, items_at = candidates(x, fingerprints(sums, x.window, starts), radius)
                    near.update(zip(np.searchsorted(ends, starts[places] + at, "right").tolist(), x.item[items_at].tolist(), strict=True))
            hashes = hash_of[ids]
            for r in rare:
                words_at, items_at = holders(r, hashes, room)
                near.update(zip(np.searchsorted(ends, words_at, "right").tolist(), items_at.tolist(), strict=True))
            best: dict[tuple[int, int], tuple[float, int]] = {}
            held: tuple = (None, None)
            docs = {d: words_of(texts[d]) for d, _ in near}
            for doc, item in sorted(near, key=lambda p: (p[0], min(width, len(items[p[1]][1])), p[1])):
                k = min(width, len(items[item][1]))
                if held[0] != (doc, k):
                    there = shingle_list(docs[doc], k) if len(docs[doc]) >= k else []
                    held = (doc, k), there, places_of(there)
                found_at = best_place(items[item][1], own[item], docs[doc], weights, width, threshold, *held[1:])
                if found_at:
                    best[doc, item] = found_at
            if best:
                doc_ids = batch.column("doc_id").to_pylist()
                found = [(doc_ids[d], items[i][0], s, p) for (d, i), (s, p) in best.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "similarity", "start_word"])

    return search
