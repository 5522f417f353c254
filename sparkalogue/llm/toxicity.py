"""Toxicity by compression distance over two zstandard dictionaries.

Training takes at most FIT_ROWS labelled texts of each class, of at most FIT_CHARS
characters, lowest id hash first (a bounded, documented sample; it holds rows of the
training fold only). Half of them make two dictionaries of raw content: both hold the same
base, the words most often used in all training texts, and each adds the fragments (words and
beginnings of words) that its own class uses most beyond the other. Dictionaries trained by
the library on windows of each class were tried instead and can't tell the classes apart
(README), since toxic texts are ordinary ones but for a few words. The other half calibrate:
every window of WINDOW_WORDS words is compressed with both dictionaries, the saving is the
ordinary length less the toxic length, and a logistic fit maps a text's savings to a
probability.

Scoring compresses every window of the whole text. Empty and null texts have no window
and get the calibrated probability of no saving. Without labels of both classes every
score is 0. Ties and repeated rows score alike. Extra columns stay, but for score and predicted.
An empty table gives no rows. Whole texts of any length are scored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, crc32_of_id, small_batches, texts_of

FIT_ROWS, FIT_CHARS = 4000, 20_000
#: Characters of the beginnings of words that are fragments.
STEM = (5, 7, 9)
#: A fragment is a word, or a beginning, that stands between so many different neighbours in its class at least.
FRAGMENT_SETTINGS = 6
BASE_BYTES, CLASS_BYTES = 24_000, 8_000
_SLOTS = 1 << 20
WINDOW_WORDS = 16


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]


def _presses(model: Model) -> list[zstandard.ZstdCompressor]:
    """Compressors with the ordinary and the toxic dictionary, whose settings find short matches."""
    how = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=4, min_match=3, target_length=16, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    out = []
    for d in (model.ordinary, model.toxic):
        held = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=how)
        out.append(zstandard.ZstdCompressor(dict_data=held, compression_params=how))
    return out


def savings(text: str, presses: list) -> np.ndarray:
    """Bytes that the toxic dictionary saves over the ordinary one, by window."""
    words = WORD.findall(text.lower())
    ordinary, toxic = (p.compress for p in presses)
    out = []
    for k in range(0, len(words), WINDOW_WORDS):
        w = (" " + " ".join(words[k : k + WINDOW_WORDS]) + " ").encode("utf-8", "surrogatepass")
        out.append(len(ordinary(w)) - len(toxic(w)))
    return np.array(out, dtype=float)


def features(s: np.ndarray) -> tuple[float, ...]:
    strong = [math.log1p(float((s >= t).sum())) for t in (1, 2, 4, 7)]
    return (1.0, max(float(s.max(initial=0)), 0.0) / 8, *strong, math.log1p(len(s)))


def _in_settings(texts: list[str]) -> Iterator[list[str]]:
    """Fragments of each different neighbourhood of a word, so that copies of a text count once."""
    places: set[int] = set()
    for t in texts:
        w = ["", *WORD.findall(t.lower()), ""]
        for before, word, after in zip(w, w[1:], w[2:]):
            place = hash((before, word, after))
            if place not in places:
                places.add(place)
                yield [word, *[word[:k] for k in STEM if k < len(word)]]


def _settings(sides: list[list[str]]) -> list[Counter]:
    """For each class the fragments with the number of neighbourhoods they stand in, of those that either class has in FRAGMENT_SETTINGS.

    A first pass counts hash slots, so that the many rare fragments never take memory.
    """
    slots = np.zeros((len(sides), _SLOTS), dtype=np.int32)
    for row, texts in zip(slots, sides, strict=True):
        for found in _in_settings(texts):
            for f in found:
                row[hash(f) % _SLOTS] += 1
    often = (slots >= FRAGMENT_SETTINGS).any(axis=0)
    return [Counter(f for found in _in_settings(texts) for f in found if often[hash(f) % _SLOTS]) for texts in sides]


def _fragments(own: Counter, other: Counter, scale: float, most: int) -> list[bytes]:
    """Fragments that stand in many settings of this class and few of the other, most telling last (nearest to the window)."""
    seen = lambda w: max(other[w], 1) * scale
    gain = {w: n * math.log((n + 0.5) / (seen(w) + 0.5)) for w, n in own.items() if n >= FRAGMENT_SETTINGS and n >= 8 * seen(w)}
    out, size = [], 0
    for w in sorted(gain, key=lambda w: (-gain[w], w)):
        b = w.encode("utf-8", "surrogatepass")
        if len(b) > 64:
            continue
        size += len(b) + 1
        if size > most:
            break
        out.append(b)
    return out[::-1]


def fit(rows: list[tuple[str, int]]) -> Model | None:
    """rows: (text, toxic 0/1), at most FIT_ROWS of each class."""
    sides = [[t for t, y in rows if y == c] for c in (0, 1)]
    if min(map(len, sides)) < 4:
        return None
    build = [s[::2] for s in sides]
    settings = _settings(build)
    sizes = [sum(len(WORD.findall(t)) for t in s) + 1 for s in build]
    fragments = [_fragments(settings[c], settings[1 - c], sizes[c] / sizes[1 - c], CLASS_BYTES) for c in (0, 1)]
    telling = {f for side in fragments for f in side}
    common = Counter(w for s in build for t in s for w in WORD.findall(t.lower()))
    base, size = [], 0
    for w in sorted(common, key=lambda w: (-common[w], w)):
        b = w.encode("utf-8", "surrogatepass")
        if b in telling:
            continue
        size += len(b) + 1
        if size > BASE_BYTES:
            break
        base.append(b)
    most = max(len(b" ".join(f)) for f in fragments)
    tail = b" " + b" ".join(base[::-1]) + b" "
    ordinary, toxic = (b" " + b" ".join(f).rjust(most) + tail for f in fragments)
    model = Model(toxic, ordinary, ())
    presses = _presses(model)
    x = np.array([features(savings(t, presses)) for s in sides for t in s[1::2]])
    y = np.array([c for c, s in enumerate(sides) for _ in s[1::2]], dtype=float)
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps on the penalised log-likelihood
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.01 * np.eye(len(w)), x.T @ (y - p) - 0.01 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return Model(toxic, ordinary, tuple(w))


def training_rows(docs: DataFrame, labels: DataFrame, folds: int, held: int) -> list[tuple[str, int]]:
    ids = labels.where("toxic in (0, 1) and doc_id is not null").where(crc32_of_id(F.col("doc_id")) % folds != held)
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    picked = None
    for c in (0, 1):
        part = ids.where(F.col("_toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
        picked = part if picked is None else picked.union(part)
    short = docs.select("doc_id", "text").where(F.length("text") <= FIT_CHARS)
    got = short.join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "text").limit(2 * FIT_ROWS)
    return [(r["text"], r["_toxic"]) for r in got.collect()]


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """docs with its columns, and score double, predicted int; clashing columns of docs are replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    model = fit(training_rows(docs, labels, folds, held))
    kept = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presses = _presses(model) if model else None
        for batch in filter(len, batches):
            if model:
                x = np.array([features(savings(t, presses)) for t in texts_of(batch)]).reshape(batch.num_rows, -1)
                p = 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30)))
            else:
                p = np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    schema = type(docs.schema)(kept).add("score", "double").add("predicted", "integer")
    return docs.select(*names).mapInArrow(run, schema)
