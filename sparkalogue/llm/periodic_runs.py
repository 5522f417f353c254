"""Maximal periodic runs of words, found by block convolution.

At each scale b = 2, 4, 8, ... the words are cut into blocks of b. A run with period q whose
length is at least max(12, 2q) repeats itself q words on over at least max(12 - q, q) words, so
for the scale with 2b - 1 <= q <= 4b - 2 (1 <= q <= 6 at b = 2) it holds a whole block that is
found again exactly q words later. For each block the sums of squared differences to all
places of its following window come from one integer number-theoretic transform; a sum of zero
is a seed (place, distance). Seeds of one distance that touch are one stretch, which is then
extended word by word, and stretches of the same words keep their smallest period.

Blocks that hold a pair of words which isn't found again within reach have no zero, and those
deep inside a run of a smaller period have zeros at its multiples only; neither is transformed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, slices, texts_of

#: A prime with roots of unity for transforms up to 2**27 long, and a generator of its units.
PRIME, ROOT, LONGEST = 15 * 2**27 + 1, 31, 2**27
#: Shortest run.
LEAST = 12
#: Values transformed at a time, and bytes of text that Python takes at a time.
CHUNK, SLICE_BYTES = 1 << 20, 6_000_000
_P = np.uint64(PRIME)


class _Transform:
    """Exact number-theoretic transforms of one length, along the last axis."""

    def __init__(self, size: int):
        self.size = size
        root = pow(ROOT, (PRIME - 1) // size, PRIME)
        self.forth, self.back = self._factors(root), self._factors(pow(root, -1, PRIME))
        self.scale = np.uint64(pow(size, -1, PRIME))

    def _factors(self, root: int) -> list[np.ndarray]:
        powers = np.ones(max(self.size // 2, 1), np.uint64)
        known = 1
        while known < len(powers):
            step = np.uint64(pow(root, known, PRIME))
            powers[known : 2 * known] = powers[:known] * step % _P
            known *= 2
        return [powers[:: self.size // (2 * half)][:half] for half in (1 << k for k in reversed(range(self.size.bit_length() - 1)))]

    def ahead(self, x: np.ndarray) -> np.ndarray:
        """Spectrum in bit-reversed order."""
        rows = len(x)
        for w in self.forth:
            half = len(w)
            x = x.reshape(rows, -1, 2, half)
            low, high = x[:, :, 0], x[:, :, 1]
            total, apart = low + high, low + _P - high
            x = np.stack([np.minimum(total, total - _P), apart * w % _P], axis=2)
        return x.reshape(rows, self.size)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        """Values of a spectrum in bit-reversed order."""
        rows = len(x)
        for w in reversed(self.back):
            half = len(w)
            x = x.reshape(rows, -1, 2, half)
            low, high = x[:, :, 0], x[:, :, 1] * w % _P
            total, apart = low + high, low + _P - high
            x = np.stack([np.minimum(total, total - _P), np.minimum(apart, apart - _P)], axis=2)
        return x.reshape(rows, self.size) * self.scale % _P


_transforms: dict[int, _Transform] = {}


def _zeros(words: np.ndarray, starts: np.ndarray, b: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) wherever a block of b words is found again low to high words later.

    words must go on for high + b words after the last start. The words' numbers are cut down so
    that the sum of b squared differences stays below the prime: it is then that sum itself.
    Words whose cut-down numbers agree may differ; the caller compares the words.
    """
    limit = int((PRIME // b) ** 0.5)
    small = (words % limit).astype(np.uint64)
    size = 1 << (high - low + b - 1).bit_length()
    if size > LONGEST:
        raise ValueError("a text of so many words is beyond the transform")
    if size not in _transforms:
        _transforms[size] = _Transform(size)
    made = _transforms[size]
    squares = np.concatenate([[0], np.cumsum(small * small)]).astype(np.uint64)
    places, distances = [], []
    step = max(1, CHUNK // size)
    for at in range(0, len(starts), step):
        s = starts[at : at + step]
        block, window = np.zeros((len(s), size), np.uint64), np.zeros((len(s), size), np.uint64)
        block[:, :b] = small[s[:, None] + np.arange(b)]
        window[:, : high - low + b] = small[s[:, None] + np.arange(low, high + b)]
        turned = np.concatenate([block[:, :1], block[:, :0:-1]], axis=1)  # the block backwards, so that products correlate
        products = made.inverse(made.ahead(turned) * made.ahead(window) % _P)[:, : high - low + 1]
        here, there = s[:, None], s[:, None] + np.arange(low, high + 1)
        sums = squares[here + b] - squares[here] + squares[there + b] - squares[there]
        row, lag = np.nonzero(sums == 2 * products)
        places.append(s[row])
        distances.append(lag + low)
    return np.concatenate([*places, np.zeros(0, np.int64)]), np.concatenate([*distances, np.zeros(0, np.int64)])


def _agreement(words: np.ndarray, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
    """How many words from places a and b on agree, forward (1) or backward (-1); some pair always ends them."""
    length = np.zeros(len(a), np.int64)
    active = np.arange(len(a))
    for _ in range(32):
        active = active[words[a[active] + way * length[active]] == words[b[active] + way * length[active]]]
        if not len(active):
            return length
        length[active] += 1
    for k in active:
        step, done = 64, False
        while not done:
            x, y = a[k] + way * length[k], b[k] + way * length[k]
            room = min(step, len(words) - max(x, y)) if way > 0 else min(step, min(x, y) + 1)
            part = np.arange(room) * way
            unlike = words[x + part] != words[y + part]
            done = bool(unlike.any())
            length[k] += int(np.argmax(unlike)) if done else room
            step *= 2
    return length


def runs(words: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of an array of word numbers, by start, then period.

    A number that stands only once divides texts: no run crosses it.
    """
    if least < LEAST:
        raise ValueError(f"runs shorter than {LEAST} words may hold no whole block")
    n = len(words)
    found = [np.zeros((3, 0), np.int64)]
    if n < least:
        return tuple(found[0])
    top = int(words.max()) + 1
    pairs = words[:-1].astype(np.int64) * top + words[1:]
    order = np.argsort(pairs, kind="stable")
    again = np.full(n, n, np.int64)  # words from a pair to where it stands next
    same = pairs[order[1:]] == pairs[order[:-1]]
    again[order[:-1][same]] = np.diff(order)[same]
    del pairs, order
    reach, inside = np.arange(n), np.zeros(n, np.int64)  # end and period of the run of the smallest period around each place
    b = 2
    while 3 * b - 1 <= n:
        low, high = (1, 6) if b == 2 else (2 * b - 1, 4 * b - 2)
        # all but the block's last pair lie within it
        count = n // b
        nearest = np.maximum.reduceat(np.where(np.arange(count * b) % b == b - 1, 0, again[: count * b]), np.arange(0, count * b, b))
        starts = np.flatnonzero(nearest <= high) * b
        covered = (inside[starts] > 0) & (inside[starts] <= b) & (reach[starts] >= starts + high + b)
        starts = starts[~covered]
        if len(starts):
            ended = np.concatenate([words, top + np.arange(high + b)])  # numbers that no word has
            place, distance = _zeros(ended, starts, b, low, high)
            # a zero within a run whose period divides the distance says nothing new
            known = (inside[place] > 0) & (reach[place] >= place + b + distance) & (distance % np.maximum(inside[place], 1) == 0)
            place, distance = place[~known], distance[~known]
            ok = np.ones(len(place), bool)
            for k in range(b) if b <= 64 else ():
                ok[ok] = ended[place[ok] + k] == ended[place[ok] + distance[ok] + k]
            if b > 64:
                ok = np.array([np.array_equal(ended[p : p + b], ended[p + d : p + d + b]) for p, d in zip(place, distance, strict=True)], bool)
            place, distance = place[ok], distance[ok]
            order = np.lexsort((place, distance))
            place, distance = place[order], distance[order]
            first = np.ones(len(place), bool)
            first[1:] = (np.diff(distance) != 0) | (np.diff(place) != b)
            last = np.append(first[1:], True)[: len(place)]
            left, right, distance = place[first], place[last] + b, distance[first]  # agree with what stands the distance on, right excluded
            right = right + _agreement(ended, right, right + distance, 1)
            framed = np.concatenate([[top + high + b], ended])
            left = left - _agreement(framed, left, left + distance, -1)
            new = np.unique(np.stack([left, right + distance, distance])[:, (right - left >= distance) & (right + distance - left >= least)], axis=1)
            # of the same words, only the smallest period is one
            new = new[:, np.lexsort((new[2], new[1], new[0]))]
            keep = np.ones(new.shape[1], bool)
            keep[1:] = (np.diff(new[0]) != 0) | (np.diff(new[1]) != 0)
            found.append(new[:, keep])
            for s, e, q in found[-1].T[np.argsort(-found[-1][2], kind="stable")]:
                span = slice(int(s), int(e))
                better = (inside[span] == 0) | (inside[span] > q)
                reach[span][better], inside[span][better] = e, q
        b *= 2
    every = np.concatenate(found, axis=1)
    every = every[:, np.lexsort((every[2], every[1], every[0]))]
    keep = np.ones(every.shape[1], bool)
    keep[1:] = (np.diff(every[0]) != 0) | (np.diff(every[1]) != 0)
    every = every[:, keep]
    return tuple(every[:, np.lexsort((every[2], every[0]))])


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """Which word each of n words becomes in a text chosen by the crc32 of its id (one in ten), else None."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def _analysed(ids: list[int | None], texts: list[str], least: int, change) -> Iterator[tuple[list[bytes], np.ndarray, bytes]]:
    """Per text: words, runs as rows (start, length, period), and the kept words joined by a space."""
    numbers: dict[bytes, int] = {}
    number = numbers.setdefault
    split, parts, sizes = [], [], []
    for i, t in zip(ids, texts, strict=True):
        words = t.encode().split()  # bytes are split at exactly the six ASCII white-space characters
        moved = change(len(words), i) if change else None
        if moved is not None:
            words = [words[k] for k in moved.tolist()]
        split.append(words)
        parts.append(np.array([number(w, len(numbers)) for w in words], np.int64))
        sizes.append(len(words))
    # one word that stands nowhere else between texts
    edges = np.cumsum([0, *[s + 1 for s in sizes]])
    joined = np.empty(edges[-1], np.int64)
    for k, p in enumerate(parts):
        joined[edges[k] : edges[k] + len(p)] = p
        joined[edges[k] + len(p)] = len(numbers) + k
    start, end, period = runs(joined, least)
    gone = np.zeros(edges[-1] + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, end, -1)
    gone = np.cumsum(gone) > 0
    of = np.searchsorted(start, edges)
    for k, words in enumerate(split):
        a, b = of[k], of[k + 1]
        rows = np.stack([start[a:b] - edges[k], end[a:b] - start[a:b], period[a:b]], axis=1)
        if a == b:
            yield words, rows, b" ".join(words)
        else:
            dropped = gone[edges[k] : edges[k] + len(words)]
            yield words, rows, b" ".join([words[j] for j in np.flatnonzero(~dropped).tolist()])


def find(docs: DataFrame, least: int = LEAST, change=None) -> DataFrame:
    """docs with `runs` (array of start, length, period in words, by start, then period) and `collapsed`.

    A run is a stretch of at least `least` words, and two periods, with smallest period `period`,
    that no neighbouring word extends; `collapsed` is the text without the words that follow a
    run's first period, joined by single spaces. change(n, doc_id) may name the word that each
    of the n words is to be replaced by first. Null and empty texts have no runs and an empty
    `collapsed`; whole texts are taken, rows are judged one by one, so repeated rows and null ids
    stay as they are. Other columns are kept but for `text`, `runs` and `collapsed`; an empty
    table stays empty.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("text", "runs", "collapsed")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept)
    row = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            found, texts = [], []
            for _, rows, text in _analysed(batch.column("doc_id").to_pylist(), texts_of(batch), least, change):
                found.append(rows)
                texts.append(text.decode())
            flat = np.concatenate(found)
            offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            values = pa.StructArray.from_arrays([pa.array(flat[:, k], pa.int64()) for k in range(3)], fields=list(row.value_type))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.ListArray.from_arrays(offsets, values), pa.array(texts, pa.string())], names=[*kept, "runs", "collapsed"])

    return docs.mapInArrow(run, f"{fields}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def longest(found: Column) -> Column:
    """The run of the greatest length of a column `runs`; ties: smallest start, then period; null if there is none."""
    key = F.transform(found, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter")))
    best = F.array_max(key)
    return F.when(best.isNotNull(), F.struct((-best["before"]).alias("start"), best["length"].alias("length"), (-best["shorter"]).alias("period")))
