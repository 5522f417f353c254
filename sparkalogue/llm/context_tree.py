"""Language-model scores of whole texts by context-tree weighting over bytes.

The model predicts a text byte by byte, each byte as eight binary decisions. A decision's
context is the bits already seen of its byte and the 0 .. DEPTH bytes before it; each such
node has a Krichevsky-Trofimov estimate, and context-tree weighting mixes the estimates of
all depths: a node's weighted probability is the mean of its own estimate and the product
of its children's, which gives each node the share of its own estimate against deeper ones.

Training counts all byte strings of DEPTH + 1 bytes of all training texts (START bytes
before a text, an END symbol after it; neither byte occurs in UTF-8). The subtrees below
two context bytes are weighted in parallel, the two upper levels from their roots. All nodes
are written as a table, with no bound on their number. Scoring takes each different string of
all texts to the nodes below its last two context bytes and gets its log probability there.
Logs of the most frequent strings (COMMON_STRINGS at most, whole levels of log2 occurrences)
go to every task, those of all others are joined, so a text's score never depends on that bound.

Texts have A-Z lower-cased. score is the log10 probability of all bytes and the end symbol;
base_score that of add-one word counts. Null or empty text: the end symbol alone. Repeated
rows are scored each. Without training texts every decision has probability 1/2.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, small_batches, write_table

DEPTH = 5
START, END = 0xFE, 0xFF
#: Strings whose log probabilities go to every task; those of all others are joined.
COMMON_STRINGS = 2_000_000
#: Strings to a group in which nodes are made and looked up, on average.
GROUP_STRINGS = 400_000
#: Words whose counts go to every task; the counts of all others are joined.
COMMON_WORDS = 50_000
#: Texts are taken together up to so many bytes.
STRETCH = 4 << 20


def prepare(text: str | None) -> bytes:
    return (text or "").encode().lower()


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of DEPTH context bytes and a symbol, for every symbol of the texts; and each text's number of symbols."""
    data = b"".join(bytes([START]) * DEPTH + t + bytes([END]) for t in texts)
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    n = len(b) - DEPTH
    code = np.zeros(max(n, 0), dtype=np.int64)
    for k in range(DEPTH + 1):
        code = code << 8 | b[k : k + n]
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    begin = np.cumsum(sizes + DEPTH) - sizes - DEPTH  # index of each text's first symbol among the codes
    keep = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return code[keep], sizes


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, moved up by 8."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability that Krichevsky-Trofimov estimation gives any string of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1) - math.log(math.pi)


def bit_nodes(context: np.ndarray, symbol: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, zeros, ones) sorted by node; a node is a context and the bits before the decision, led by a 1."""
    node = np.concatenate([context << 8 | (1 << j) | symbol >> (8 - j) for j in range(8)])
    one = np.concatenate([symbol >> (7 - j) & 1 for j in range(8)])
    nodes, at = np.unique(node, return_inverse=True)
    weight = np.tile(count, 8)
    return nodes, np.bincount(at, weight * (1 - one)), np.bincount(at, weight * one)


def weigh(nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, depth: int, below: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """(log weighted probability, share of the node's own estimate); below: nodes one byte deeper and their log probabilities."""
    own = log_kt(zeros, ones)
    if below is None:
        return own, np.ones(len(own))
    deeper, logs = below
    mask = (1 << 8 * depth) - 1
    parent = (deeper >> 8 & mask) << 8 | deeper & 0xFF
    children = np.bincount(np.searchsorted(nodes, parent), logs, minlength=len(nodes))
    return np.logaddexp(own, children) - math.log(2), 1 / (1 + np.exp(np.clip(children - own, -60, 60)))


def _key(depth: int, nodes: np.ndarray) -> np.ndarray:
    return nodes | depth << 52


NODES = "key long, p1 double, share double, seen double, log_p double"


def subtree(codes: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """All nodes with 2 .. DEPTH context bytes under the strings given, which hold their two-byte contexts whole."""
    out, below = [], None
    for depth in range(DEPTH, 1, -1):
        short = codes & ((1 << 8 * (depth + 1)) - 1)
        kinds, at = np.unique(short, return_inverse=True)
        total = np.bincount(at, counts)
        nodes, zeros, ones = bit_nodes(kinds >> 8, kinds & 0xFF, total)
        logs, share = weigh(nodes, zeros, ones, depth, below)
        below = (nodes, logs)
        seen = zeros + ones
        # log_p only where the levels above need it
        out.append(pd.DataFrame({"key": _key(depth, nodes), "p1": (ones + 0.5) / (seen + 1), "share": share, "seen": seen, "log_p": logs if depth == 2 else np.nan}))
    return pd.concat(out)


def upper_levels(two: pd.DataFrame) -> pd.DataFrame:
    """Nodes with one and no context byte from those with two (at most 65536 contexts of 255 nodes)."""
    nodes = two["key"].to_numpy() & ((1 << 52) - 1)
    order = np.argsort(nodes)
    nodes, seen = nodes[order], two["seen"].to_numpy()[order]
    ones = np.rint(two["p1"].to_numpy()[order] * (seen + 1) - 0.5)
    zeros, logs, out = seen - ones, two["log_p"].to_numpy()[order], []
    for depth in (1, 0):
        parent = (nodes >> 8 & ((1 << 8 * depth) - 1)) << 8 | nodes & 0xFF
        up, at = np.unique(parent, return_inverse=True)
        z, o = np.bincount(at, zeros), np.bincount(at, ones)
        up_logs, share = weigh(up, z, o, depth, (nodes, logs))
        out.append(pd.DataFrame({"key": _key(depth, up), "p1": (o + 0.5) / (z + o + 1), "share": share}))
        nodes, zeros, ones, logs = up, z, o, up_logs
    return pd.concat(out)


class Model:
    """Nodes held as sorted arrays, and a memory of strings already scored."""

    def __init__(self, key: np.ndarray, p1: np.ndarray, share: np.ndarray):
        self.key, self.p1, self.share = key, p1, share
        self.codes, self.logs = np.zeros(0, np.int64), np.zeros(0)

    def compute(self, codes: np.ndarray) -> np.ndarray:
        symbol, out = codes & 0xFF, np.zeros(len(codes))
        for j in range(8):
            bits, one = (1 << j) | symbol >> (8 - j), symbol >> (7 - j) & 1
            p = np.full(len(codes), 0.5)
            held = np.zeros(len(codes), dtype=bool)
            for depth in range(DEPTH, -1, -1):
                node = (codes >> 8 & ((1 << 8 * depth) - 1)) << 8 | bits | depth << 52
                at = np.minimum(np.searchsorted(self.key, node), max(len(self.key) - 1, 0))
                hit = self.key[at] == node if len(self.key) else held
                if not hit.any():
                    continue
                own, share = self.p1[at], np.where(held, self.share[at], 1.0)
                p = np.where(hit, share * own + (1 - share) * p, p)
                held |= hit
            out += np.log10(np.where(one == 1, p, 1 - p))
        return out

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each code's symbol after its context."""
        kinds, at = np.unique(codes, return_inverse=True)
        spot = np.minimum(np.searchsorted(self.codes, kinds), max(len(self.codes) - 1, 0))
        known = self.codes[spot] == kinds if len(self.codes) else np.zeros(len(kinds), bool)
        logs = np.zeros(len(kinds))
        logs[known] = self.logs[spot[known]]
        if not known.all():
            new = kinds[~known]
            made = logs[~known] = self.compute(new)
            if len(self.codes) > 3_000_000:
                self.codes, self.logs = np.zeros(0, np.int64), np.zeros(0)
            where = np.searchsorted(self.codes, new)
            self.codes, self.logs = np.insert(self.codes, where, new), np.insert(self.logs, where, made)
        return logs[at]


def _stretches(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[list[tuple], list[bytes]]]:
    """(other columns, prepared texts) of about STRETCH bytes."""
    rows, texts, size = [], [], 0
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in columns], batch.column("text").to_pylist(), strict=True):
            rows.append(row[:-1])
            texts.append(prepare(row[-1]))
            size += len(texts[-1]) + 1
            if size >= STRETCH:
                yield rows, texts
                rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings with their counts (word null) and words with theirs (code null), summed over a run of a task's texts."""
    codes, counts, words = np.zeros(0, np.int64), np.zeros(0), Counter()

    def out() -> Iterator[pa.RecordBatch]:
        for k in range(0, len(codes), 100_000):
            c = codes[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.nulls(len(c), pa.binary()), pa.array(counts[k : k + 100_000].astype(np.int64))], names=["code", "word", "n"])
        listed = list(words.items())
        for k in range(0, len(listed), 100_000):
            part = listed[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.int64()), pa.array([w for w, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64())], names=["code", "word", "n"])

    for _, texts in _stretches(batches, []):
        made, _ = grams(texts)
        own, n = np.unique(made, return_counts=True)
        both, at = np.unique(np.concatenate([codes, own]), return_inverse=True)
        codes, counts = both, np.bincount(at, np.concatenate([counts, n]))
        for t in texts:
            words.update(t.split())
        words[b" "] += len(texts)  # the end of a text; no word holds a space
        if len(codes) > 2_000_000 or len(words) > 800_000:
            yield from out()
            codes, counts, words = np.zeros(0, np.int64), np.zeros(0), Counter()
    yield from out()


def _counts(docs: DataFrame, name: str) -> DataFrame:
    return write_table(docs.select("text").mapInArrow(_count, "code long, word binary, n long"), name)


def train(trained: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log10 probability and count of every string of all texts, words with counts c of those trained on), from both counts."""
    words = write_table(trained.where("word is not null").groupBy("word").agg(F.sum("n").alias("c")), "words")
    both = trained.where("code is not null").select("code", "n", F.col("n").alias("learnt")).union(held.where("code is not null").select("code", "n", F.lit(0).cast("long").alias("learnt")))
    strings = write_table(both.groupBy("code").agg(F.sum("n").alias("n"), F.sum("learnt").alias("learnt")), "strings")
    buckets = max(64, strings.count() // GROUP_STRINGS)
    bucket = lambda c: F.pmod(F.xxhash64(F.shiftright(c, 8).bitwiseAND(0xFFFF)), F.lit(buckets))
    grown = strings.where("learnt > 0").groupBy(bucket("code").alias("bucket")).applyInPandas(lambda rows: subtree(rows["code"].to_numpy(), rows["learnt"].to_numpy()), NODES)
    nodes = write_table(grown, "nodes")
    roots = nodes.where("log_p is not null and not isnan(log_p)").toArrow().to_pandas()
    top = upper_levels(roots) if len(roots) else roots[["key", "p1", "share"]]
    sent = trained.sparkSession.sparkContext.broadcast(top.sort_values("key"))

    def look_up(below: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(wanted):
            return pd.DataFrame({"code": [], "n": [], "log": []}).astype({"code": "int64", "n": "int64", "log": "float64"})
        every = pd.concat([sent.value, below[["key", "p1", "share"]]]).sort_values("key") if len(below) else sent.value
        model = Model(every["key"].to_numpy(np.int64), every["p1"].to_numpy(np.float64), every["share"].to_numpy(np.float64))
        codes = wanted["code"].to_numpy()
        logs = np.concatenate([model.compute(codes[k : k + 200_000]) for k in range(0, len(codes), 200_000)])
        return pd.DataFrame({"code": codes, "n": wanted["n"].to_numpy(), "log": logs})

    # a node's last two context bytes stand where a string's do
    of_nodes = nodes.select("key", "p1", "share").groupBy(bucket("key").alias("bucket"))
    of_strings = strings.select("code", "n").groupBy(bucket("code").alias("bucket"))
    return write_table(of_nodes.cogroup(of_strings).applyInPandas(look_up, "code long, n long, log double"), "logs"), words


def common_strings(logs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted codes, logs) of the most frequent strings, whole levels of log2 occurrences."""
    level = F.floor(F.log2("n"))
    sizes = logs.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()
    least, taken = 0, 0
    for r in sizes:
        taken += r["n"]
        if taken > COMMON_STRINGS:
            least = r["level"] + 1
            break
    got = logs.where(level >= least).select("code", "log").toArrow()
    codes, values = got.column("code").to_numpy(), got.column("log").to_numpy()
    order = np.argsort(codes)
    return codes[order], values[order]


def score(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", crc32_of_id(F.col("doc_id")) % folds == held)
    logs, words = train(_counts(docs.where("not held_out"), "counts"), _counts(docs.where("held_out"), "held"))
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    scale = math.log10(total[0] + total[1] + 1)
    common = {bytes(r["word"]): r["c"] for r in words.orderBy(F.desc("c"), "word").limit(COMMON_WORDS).collect()}
    sent = spark.sparkContext.broadcast((*common_strings(logs), common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_logs, common = sent.value
        logs_of = {w: math.log10(c + 1) for w, c in common.items()}
        for rows, texts in _stretches(batches, ["doc_id", "held_out"]):
            codes, sizes = grams(texts)
            ends = np.cumsum(sizes)
            kinds, at = np.unique(codes, return_inverse=True)
            spot = np.minimum(np.searchsorted(known, kinds), max(len(known) - 1, 0))
            hit = known[spot] == kinds if len(known) else np.zeros(len(kinds), bool)
            logs_here = np.zeros(len(kinds))
            logs_here[hit] = known_logs[spot[hit]]
            totals = np.add.reduceat(logs_here[at], ends - sizes)
            # each text's strings that are not among the common ones
            other_at = np.flatnonzero(~hit[at])
            offsets = np.concatenate(([0], np.searchsorted(other_at, ends)))
            strings = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(codes[other_at]))
            n_tokens, n_known, base, rare = [], [], [], []
            for t in texts:
                tokens = t.split()
                tokens.append(b" ")
                other = [w for w in tokens if w not in common]
                n_tokens.append(len(tokens))
                n_known.append(len(tokens) - len(other))
                base.append(math.fsum([logs_of[w] for w in tokens if w in common]))
                rare.append(other)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()), pa.array(totals), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(rare, pa.list_(pa.binary())), strings],
                names=["doc_id", "held_out", "score", "n_tokens", "n_common", "common_logs", "rare", "strings"],
            )

    schema = "doc_id long, held_out boolean, score double, n_tokens long, n_common long, common_logs double, rare array<binary>, strings array<long>"
    scored = write_table(docs.mapInArrow(run, schema), "scored").withColumn("row", F.monotonically_increasing_id())
    rare = scored.select("row", F.explode("rare").alias("word")).join(words, "word")
    found = rare.groupBy("row").agg(F.count("*").alias("n"), F.sum(F.log10(F.col("c") + 1)).alias("logs"))
    others = scored.select("row", F.explode("strings").alias("code")).join(logs.select("code", "log"), "code").groupBy("row").agg(F.sum("log").alias("other_logs"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.join(found, "row", "left").join(others, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_common") + zero(F.col("n"))).alias("n_known"), F.lit(total[0]).cast("long").alias("train_tokens"),
        (F.col("common_logs") + zero(F.col("logs")) - F.col("n_tokens") * F.lit(scale)).alias("base_score"), (F.col("score") + zero(F.col("other_logs"))).alias("score"),
    )
