"""Periodic runs, whitening and piece ids against brute force, numpy's solver and the library."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkalogue.llm import periodic_runs, piece_codec, queries, whitening
from sparkalogue.llm.common import WORD

MODEL = piece_codec.default_path()


def brute_runs(words):
    """All stretches by looking at every period: the smallest of those that cover the same words."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_change(words, doc_id):
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute_op11(doc_id, text):
    words = brute_change(WORD.findall(text or ""), doc_id)
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(told), sha(kept))


def periodic_texts():
    rng = random.Random(8)
    texts = []
    for size in (0, 1, 11, 12, 13, 40, 150, 400, 900):
        for kinds in (1, 2, 3, 40):
            words = [f"w{rng.randrange(kinds)}" for _ in range(size)]
            for _ in range(rng.randrange(3)):
                a, p, m = rng.randrange(size or 1), rng.randint(1, size // 3 + 1), rng.randint(0, size)
                for i in range(a, min(size, a + m)):
                    words[i] = words[a + (i - a) % p]
            texts.append(rng.choice([" ", "\n", "\t ", "\x0b"]).join(words))
    a, b = "x", "x y"
    for _ in range(11):
        a, b = b, b + " " + a  # many runs that overlap
    return [*texts, b, "a\x1cb\x85c\xa0d " * 20, "é " * 13, " " + "loop " * 5000]


@pytest.fixture(scope="module")
def run_table(spark, tmp_path_factory):
    """documents with null, empty, repeated and very long rows, and ids of which one in ten is made periodic."""
    rows = [(i, t) for i, t in enumerate(periodic_texts())]
    rows += [(1000 + i, " ".join(f"v{k % 97}" if k % 5 else f"u{k}" for k in range(300))) for i in range(40)]
    rows += [(3, rows[3][1]), (3, "another text of one id"), (None, "a b c d e f g h i j k l m n"), (None, None), (77, None), (78, ""), (79, " \n ")]
    rows.append((80, " ".join(f"w{k % 4001}" for k in range(30_000))))
    folder = str(tmp_path_factory.mktemp("runs"))
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("x")).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def test_runs_query(spark, run_table):
    folder, rows = run_table
    got = queries.op11_periodic_runs(spark, folder)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    long = [r for r in rows if r[0] == 80]
    assert Counter(tuple(r) for r in got.where("doc_id is null or doc_id != 80").collect()) == Counter(brute_op11(*r) for r in rows if r not in long)
    (found,) = got.where("doc_id = 80").collect()
    assert (found["n_runs"], found["start"], found["length"], found["period"]) == (1, 0, 30_000, 4001)


def test_runs_keep_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b " * 9, "p", 2), (None, None, None, None)], "doc_id long, text string, collapsed string, `odd name` int")
    got = {r["doc_id"]: r for r in periodic_runs.find(docs).collect()}
    assert got[1]["odd name"] == 2 and got[1]["collapsed"] == "a b" and [tuple(r) for r in got[1]["runs"]] == [(0, 18, 2)]
    assert got[None]["runs"] == [] and got[None]["collapsed"] == ""
    assert periodic_runs.find(docs.where("doc_id = 9")).collect() == []


def test_transform_sums_are_exact():
    rng = np.random.default_rng(2)
    for b in (2, 8, 64, 512):
        low, high = (1, 6) if b == 2 else (2 * b - 1, 4 * b - 2)
        words = rng.integers(0, 3, 6 * b + 40)
        words[b : 2 * b] = words[b + low + 1 : 2 * b + low + 1] = 5
        place, distance = periodic_runs._zeros(words, np.array([0, b]), b, low, high)
        plain = [(s, d) for s in (0, b) for d in range(low, high + 1) if (words[s : s + b] == words[s + d : s + d + b]).all()]
        assert sorted(zip(place.tolist(), distance.tolist(), strict=True)) == plain


@pytest.mark.parametrize("dims", [1, 2, 7, 40])
@pytest.mark.parametrize("kind", ["apart", "equal", "wide", "flat"])
def test_spectral_division(dims, kind):
    rng = np.random.default_rng(dims)
    q, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
    e = {"apart": rng.uniform(0, 9, dims), "equal": np.repeat(rng.uniform(1, 5, dims), 3)[:dims], "wide": 10.0 ** rng.uniform(-7, 6, dims), "flat": np.r_[np.zeros(dims // 2), np.ones(dims - dims // 2)]}[kind]
    a = (q * e) @ q.T
    values, vectors = whitening.eigen(a)
    assert np.allclose(values, np.linalg.eigvalsh((a + a.T) / 2)[::-1], atol=1e-13 * e.max())
    assert np.abs(vectors.T @ vectors - np.eye(dims)).max() < 1e-13 and np.abs(a @ vectors - vectors * values).max() < 1e-13 * e.max() * dims


def test_polar_factor():
    a = np.diag([3.0, -2.0, 1e-9, -1e5])
    assert np.abs(whitening.polar(a) - np.diag([1, -1, 1, -1])).max() < 1e-12


VECTORS = "vec_id long, embedding array<float>, n int, x string"


@pytest.fixture(scope="module")
def vector_rows():
    rng = np.random.default_rng(4)
    made = (rng.standard_normal((300, 6)) @ rng.standard_normal((6, 6)) + 3).astype(np.float32).tolist()
    rows = [(i, v, 1, "y") for i, v in enumerate(made)] + [(1000 + i, made[7], 1, None) for i in range(150)] + [(5, made[5], 1, "y"), (None, made[9], None, None)]
    odd = [(2000, None), (2001, []), (2002, [1.0, None, 0, 0, 0, 0]), (2003, [math.nan] * 6), (2004, [math.inf, 0, 0, 0, 0, 0]), (2005, [1.0, 2.0]), (2006, [1e30] * 6)]
    return rows, [(i, v if v is None else [None if c is None else float(c) for c in v], 1, "y") for i, v in odd]


def test_whitening(spark, vector_rows):
    rows, odd = vector_rows
    got = whitening.whiten(spark.createDataFrame(rows + odd, VECTORS).repartition(4), most=4).collect()
    x = {i: np.floor(64 * np.array(v)).astype(int) + 1_000_000 for i, v, *_ in rows}
    fit = np.array(sorted({tuple(v.tolist()) for v in x.values()}))
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 4 * len(rows) and Counter(r["vec_id"] for r in got) == Counter({i: 4 * k for i, k in Counter(r[0] for r in rows).items()})
    signs = {}
    for r in got:
        k, v = r["component"] - 1, x[r["vec_id"]]
        assert r["n"] == n and r["deviation"] == sum((n * int(c) - int(s)) ** 2 for c, s in zip(v, total, strict=True))
        want = float((v - total / n) @ vectors[:, k] / values[k] ** 0.5)
        assert abs(abs(r["whitened"]) - abs(want)) < 1e-8 and abs(r["explained"] - values[k] / values.sum()) < 1e-9
        if abs(want) > 1e-3:
            assert signs.setdefault(k, r["whitened"] * want > 0) == (r["whitened"] * want > 0)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_whitening_of_little(spark, vector_rows):
    frame = spark.createDataFrame(vector_rows[0], VECTORS)
    assert whitening.whiten(frame.where("vec_id < 0")).collect() == []
    assert whitening.whiten(frame.where("vec_id >= 1000")).collect() == []
    assert whitening.whiten(spark.createDataFrame(vector_rows[1][:5], VECTORS)).collect() == []
    two = whitening.whiten(frame.where("vec_id < 2")).collect()
    assert {r["component"] for r in two} == {1} and sorted(round(abs(r["whitened"]), 9) for r in two) == [1, 1]


def test_whitening_of_large_entries(spark):
    rows = [(1, [1e13, 0.0]), (2, [-1e13, 5.0]), (3, [0.0, 1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["deviation"] for r in got} == {None} or all(r["deviation"] is None or r["vec_id"] == 3 for r in got)
    assert got[0]["identity_error"] < 1e-6


def odd_texts():
    rng = random.Random(1)
    made = ["", " ", "  ", "a▁b", "▁", "▁▁ x", "\n", "\n\n x \n", " a", "a ", "<s>", "</s>", "<0x41>", "\x00", "中文字符" * 40, "🙂🙃" * 5, "a" * 300, "\r\n", "word " * 3000 + "end"]
    return made + ["".join(rng.choice(["a", "th", "e", "B", " ", "  ", "\n", "\t", "1", "é", " ", ".", "\x85", "中", ",", "▁", "🙂", "ﬁ", "\r\n", "<unk>"]) for _ in range(40)) for _ in range(400)]


def test_pieces_query(spark, tmp_path, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(i, t) for i, t in enumerate(odd_texts() + texts)] + [(None, "no id"), (5000, None), (3, "an id again"), (3, "an id again")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("x")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_eos=True)
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))] += 1
    assert Counter(tuple(r) for r in queries.op13_piece_codec(spark, str(tmp_path)).collect()) == want


def test_pieces_keep_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "old", 2), (None, None, None, None)], "doc_id long, text string, ids string, decoded int")
    got = {r["doc_id"]: r for r in piece_codec.decode(piece_codec.encode(docs, end=False)).collect()}
    assert got[1]["text"] == got[1]["decoded"] == "a b" and got[None]["ids"] == [] and got[None]["decoded"] == ""
    assert piece_codec.encode(docs.where("doc_id = 9")).collect() == []


def test_both_queues_agree():
    own, rng = piece_codec.Codec(MODEL), random.Random(3)
    for _ in range(500):
        letters = [rng.choice("aeinrst▁.") for _ in range(rng.randint(1, 40))]
        assert own._merged_short(list(letters)) == own._merged(list(letters))
    own.fresh.append(("▁never", b"\0\0\0\0"))
    with pytest.raises(RuntimeError):
        own.verify()
