"""Stored indexes and bounded top-k searches against brute force."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkalogue.functions.stemmer import STOP, stem
from sparkalogue.operators import sets, text_index, tiers, vector_index


@pytest.fixture(scope="module")
def vectors(spark):
    """Vectors around a few centres, a third of all rows one vector, with null, empty, odd-sized and zero ones."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 8))
    made = [(i, (centres[i % 12] + rng.standard_normal(8) * 0.3).tolist()) for i in range(600)]
    made += [(600 + i, made[3][1]) for i in range(300)]
    made += [(2000, None), (2001, []), (2002, [1.0, 2.0]), (2003, [0.0] * 8), (None, [1.0] * 8), (2004, [None] + [1.0] * 7)]
    return spark.createDataFrame(made, "id long, vec array<double>").repartition(3)


def as_rows(df):
    return sorted((r["query_id"], r["id"], r["cosine"]) for r in df.collect())


@pytest.mark.parametrize("lists", [None, 1, 40])
def test_index_gives_the_scan(spark, vectors, lists):
    asked = vectors.where("id % 50 = 0 or id in (3, 2003)")
    index = vector_index.build(vectors, lists=lists, fit_rows=200)
    assert index.rows.sum() == 900
    want = as_rows(tiers.cosine_topk(asked.where("id < 2000"), vectors.where("id < 2000"), 7))
    for probes in (1, 5):
        assert as_rows(vector_index.search(index, asked, 7, probes=probes, exact=True)) == want


def test_index_recall_and_pruning(spark, vectors):
    asked = vectors.where("id % 7 = 0 and id < 600")
    index = vector_index.build(vectors, lists=30)
    probes = vector_index.probes_for(index, vectors.where("id < 2000"), 5, recall=0.95)
    true, got = (set(as_rows(vector_index.search(index, asked, 5, probes=probes, exact=e))) for e in (True, False))
    assert probes < 30 and len(got & true) >= 0.9 * len(true)
    plan = index.blocks(spark, [2, 3])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*list#\d+ IN \(2,3\)", plan)
    assert {r["list"] for r in index.blocks(spark, [2, 3]).collect()} == {2, 3}
    assert index.blocks(spark).agg(F.max(F.size("ids"))).first()[0] <= 2 * vector_index.BLOCK_ROWS


def test_index_of_nothing(spark, vectors):
    assert vector_index.build(vectors.where("id = 2000")) is None
    assert vector_index.search(None, vectors, 3).collect() == []
    assert vector_index.search(vector_index.build(vectors), vectors.where("id in (2000, 2001, 2002)"), 3, exact=True).collect() == []


def test_queries_choose_lists_in_stretches(spark, vectors):
    """However many queries come at once, a few at a time choose their lists, so a worker never holds a vector for each query and list."""
    index = vector_index.build(vectors)

    def choose(_, which, angles, __):
        assert len(which) == len(angles) <= 64
        return np.nonzero(np.isfinite(angles))

    many = vectors.where("id = 1").crossJoin(spark.range(300).withColumnRenamed("id", "query_id")).select("query_id", "vec").coalesce(1)
    assert vector_index._probe(many, index, choose).select("query_id").distinct().count() == 300


def brute_topk(all_sets, asked, k):
    out = []
    for q in asked:
        a = set(all_sets[q])
        scored = [(-round(len(a & set(b)) / len(a | set(b)), 6), i, len(a & set(b))) for i, b in all_sets.items() if i != q and a & set(b)]
        out += [(q, i, n, -s) for s, i, n in sorted(scored)[:k]]
    return sorted(out)


@pytest.mark.parametrize(("k", "common"), [(1, 512), (4, 512), (4, 2)])
def test_topk_sets(spark, monkeypatch, k, common):
    """Frequent and rare tokens, copies, ties, tiny and empty sets; pairs settled by common tokens and compared whole."""
    monkeypatch.setattr(sets, "COMMON", common)
    rng = random.Random(5)
    all_sets = {i: [t for t in range(60) if rng.random() < 0.8 / (1 + t)] + [f for f in (rng.randrange(100, 400) for _ in range(rng.randrange(12)))] for i in range(250)}
    all_sets = {i: list(dict.fromkeys(map(str, s))) for i, s in all_sets.items()}
    all_sets |= {300 + i: all_sets[7] for i in range(5)} | {400: ["0"], 401: [], 402: ["nowhere else"]}
    frame = spark.createDataFrame([*all_sets.items(), (403, None), (None, ["0"])], "id long, toks array<string>")
    asked = [i for i in all_sets if i % 10 == 0 and all_sets[i]]
    got = sets.jaccard_topk(frame.where("id % 10 = 0"), frame, k)
    assert sorted((r["query_id"], r["id"], r["shared"], r["jaccard"]) for r in got.collect()) == brute_topk(all_sets, asked, k)


def test_sets_meet_without_a_shuffle(spark):
    """All pairs of tiny, copied and large sets with further columns of both sides, in stretches and slices; no pair is shuffled."""
    rng = random.Random(8)
    all_sets = {i: [t for t in range(40) if rng.random() < 0.5] + [rng.randrange(100, 300) for _ in range(5)] for i in range(60)}
    all_sets = {i: list(dict.fromkeys(map(str, s))) for i, s in all_sets.items()} | {60: ["0"], 62: [], 70: ["alone"]}
    frame = spark.createDataFrame([(i, s, f"n{i}") for i, s in all_sets.items()] + [(None, ["0"], "x"), (80, None, "y")], "id long, toks array<string>, name string")
    for least in (None, 0.3):
        found = sets.jaccard_above(frame.where("id % 10 = 0"), frame, least)
        want = [(q, i, n, s, f"n{q}", f"n{i}") for q, i, n, s in brute_topk(all_sets, [i for i in all_sets if i % 10 == 0], 1000) if least is None or s > least]
        assert sorted((r["query_id"], r["id"], r["shared"], r["jaccard"], r["query_name"], r["name"]) for r in found.collect()) == want
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_topk_sets_from_floors(spark, monkeypatch):
    """Floors from a part of the sets, several blocks, stretches and slices, and pairs dropped on the way: the same answer."""
    for name, value in {"FLOOR_SETS": 50, "BLOCK_TOKENS": 100, "QUERY_ROWS": 3, "SET_ROWS": 40, "HELD_PAIRS": 10}.items():
        monkeypatch.setattr(sets, name, value)
    rng = random.Random(9)
    all_sets = {i: list({f"{int(rng.expovariate(0.05))}" for _ in range(rng.randrange(1, 30))}) for i in range(400)} | {500 + i: ["0", "1"] for i in range(60)}
    frame = spark.createDataFrame([*all_sets.items()], "id long, toks array<string>").repartition(5)
    got = sets.jaccard_topk(frame.where("id % 10 = 0"), frame, 4)
    assert sorted((r["query_id"], r["id"], r["shared"], r["jaccard"]) for r in got.collect()) == brute_topk(all_sets, [i for i in all_sets if i % 10 == 0], 4)


def test_topk_sets_join_less(spark):
    rng = random.Random(6)
    frame = spark.createDataFrame([(i, ["a", "b", "c"] + [f"t{i // 4}_{j}" for j in range(20)] + [f"r{rng.random()}" for _ in range(3)]) for i in range(400)], "id long, toks array<string>")
    told = sets.jaccard_topk(frame.where("id % 10 = 0"), frame, 3, report=True).collect()
    assert len(told) == 40 and all(r["joined"] < 0.2 * r["all_rows"] and r["taken"] < r["n"] for r in told)


def test_stems():
    """Examples of the published description."""
    pairs = """consistency consist consolatory consolatori consolidating consolid consolingly consol conspiracies conspiraci conspirators conspir knackeries knackeri knavish knavish kneaded knead knightly knight
    generously generous communism communism skies sky dies die ties tie cries cri gas gas kiwis kiwi hopping hop hoping hope luxuriated luxuri relational relat rationally ration vietnamization vietnam analogously analog
    formality formal replacement replac probate probat controlling control dying die only onli news news inning inning exceed exceed boyish boyish toy toy by by is is""".split()
    for word, want in itertools.batched(pairs, 2):
        assert stem(word) == want, word


TEXTS = {
    1: "The builders were building nations; a nation builds.", 2: "nothing here", 3: None, 4: "", 5: "Build! " + "pad " * 150 + "nation",
    6: "a b x a y y b a", 7: "Große STRASSE, große Häuser: b a", 8: "of the of the of", 9: "builder " * 3,
}


@pytest.fixture(scope="module")
def indexed(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "key long, body string")
    return docs, text_index.build(docs, "key", "body")


def split(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def places(query, english=False):
    """{document: [(place, term)]} of the documents that hold all terms."""
    wanted = text_index.terms(query, english)
    named = lambda w: stem(w) if english else w
    found = {i: [(p, wanted.index(named(w))) for p, w in enumerate(split(t)) if named(w) in wanted] for i, t in TEXTS.items()}
    return {i: h for i, h in found.items() if wanted and {t for _, t in h} == set(range(len(wanted)))}


@pytest.mark.parametrize(("query", "english"), [("a b", False), ("B große a", False), ("nation build", True), ("the nations", True), ("the of", False), ("nowhere", False), ("a", False), ("the", True), ("", False)])
def test_text_ranks(spark, indexed, query, english):
    docs, index = indexed
    want, n = places(query, english), len(text_index.terms(query, english))
    found = text_index.hits(spark, index, query, english)
    assert sorted((r["id"], r["pos"], r["term"]) for r in found.collect()) == sorted((i, p, t) for i, h in want.items() for p, t in h)
    if not n:
        return
    pairs, density = {}, {}
    for i, h in want.items():
        if n == 1:
            pairs[i] = sum(0.1 / (k + 1) ** 2 for k in range(len(h))) / 1.64493406685
        else:
            rest = 1.0
            for (p, s), (q, t) in itertools.combinations(h, 2):
                if s != t and abs(p - q) <= 100:
                    rest *= 1 - 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(abs(p - q) / 1.5 - 2)))
            pairs[i] = 1 - rest
        spans = [(a, b) for a, _ in h for b, _ in h if {t for p, t in h if a <= p <= b} == set(range(n))]
        least = {(a, b) for a, b in spans if not any((c, d) != (a, b) and a <= c and d <= b for c, d in spans)}
        density[i] = sum(0.1 / (1 + max(0, b - a - (sum(a <= p <= b for p, _ in h) - 1))) for a, b in least)
    assert {r["id"]: round(r["rank"], 9) for r in text_index.rank_pairs(found, n).collect()} == {i: round(v, 9) for i, v in pairs.items()}
    assert {r["id"]: round(r["rank"], 9) for r in text_index.rank_covers(found, n).collect()} == {i: round(v, 9) for i, v in density.items()}


def test_text_answers(spark, indexed):
    docs, index = indexed
    got = {r["id"]: r for r in text_index.search(docs, "key", "body", "building the nation", index).collect()}
    assert set(got) == {1, 5} and got[1]["rank"] > got[5]["rank"]
    assert got[1]["snippet"] == "[[The]] builders were [[building]] nations a [[nation]] builds"
    assert got[5]["snippet"].startswith("[[Build]] pad")
    cut = {r["id"]: r["snippet"] for r in text_index.snippets(docs, "key", "body", text_index.hits(spark, index, "x"), 1, most=3).collect()}
    assert cut == {6: "b [[x]] a"}
    exact = text_index.search(docs, "key", "body", '"HERE"', index).collect()
    assert [(r["id"], r["rank"], r["snippet"]) for r in exact] == [(2, 1.0, "nothing here")]
    assert len(text_index.search(docs, "key", "body", "a", index, limit=1).collect()) == 1
    assert "the" in STOP and text_index.search(docs, "key", "body", "", index).collect() == []


def test_text_index_reads_only_its_words(spark, indexed):
    _, index = indexed
    plan = index.postings(spark, ["große", "of"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(word, [große,of])]" in plan and "Exchange" not in plan
    assert sorted({r["word"] for r in index.postings(spark, ["große", "of"]).collect()}) == ["große", "of"]


def test_text_index_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "key long, body string")
    index = text_index.build(docs, "key", "body")
    assert text_index.hits(spark, index, "word").collect() == [] and text_index.hits(spark, index, "word", english=True).collect() == []


def test_search_stores_hits_once_and_needs_no_stems_for_stop_words(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the end of the road"), (2, "of it"), (3, None), (4, "The top of")], "key long, body string")
    names, write = [], text_index.stored
    monkeypatch.setattr(text_index, "stored", lambda df, name: names.append(name) or write(df, name))
    index = text_index.build(docs, "key", "body", stems=False)
    got = {r["id"]: r["snippet"] for r in text_index.search(docs, "key", "body", "the of", index).collect()}
    assert got == {1: "[[the]] end [[of]] [[the]] road", 4: "[[The]] top [[of]]"} and names == ["text-hits"]
