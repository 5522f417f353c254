"""Alignments, merges, trees, histories, moves and digests against plain versions."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkalogue.functions import alignment
from sparkalogue.operators import diffs, history, kernels, tiers, upsert


def longest_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_alignment_and_merge():
    rng = random.Random(1)
    for _ in range(1500):
        kinds = rng.choice([1, 2, 3, 9])
        a, b, c = ([rng.randrange(kinds) for _ in range(rng.randrange(13))] for _ in range(3))
        found = alignment.align(a, b)
        assert sum(n for *_, n in found) == longest_common(a, b) and all(a[i : i + n] == b[j : j + n] for i, j, n in found)
        assert all(x[0] + x[2] <= y[0] and x[1] + x[2] <= y[1] for x, y in zip(found, found[1:]))  # noqa: B905
        regions = alignment.merge(a, b, c)
        for side, text in ((1, a), (2, b), (3, c)):
            assert [x for r in regions for x in r[side]] == text
        for kind, x, y, z in regions:
            assert {"same": x == y == z, "ours": x == z != y, "theirs": x == y != z, "both": y == z != x, "conflict": y != z}[kind]
        if a == b:
            assert [x for r in regions for x in r[3 if r[0] == "theirs" else 2]] == c


def test_side_by_side():
    rows = lambda a, b: [r[1:] for r in diffs.diff_rows(a, b)]
    assert rows("p\nq\n", "p\nq\n") == [(1, "p", 1, "p", False), (2, "q", 2, "q", False)]
    assert rows("p\nwas\n", "p\nis\nmore\n") == [(1, "p", 1, "p", False), (2, "was", 2, "is", True), (None, None, 3, "more", True)]
    assert rows("", "p\n") == [(None, None, 1, "p", True)] and rows("p\n", None) == [(1, "p", None, None, True)] and rows(None, "") == []
    assert rows("p\nq\nr\n", "q\nr\ns\n") == [(1, "p", None, None, True), (2, "q", 1, "q", False), (3, "r", 2, "r", False), (None, None, 3, "s", True)]


def test_spans(spark):
    text = [f"l{k}" for k in range(20)]
    other = [*text]
    other[0], other[8], other[19] = "x", "y", "z"
    pairs = spark.createDataFrame([(1, "\n".join(text), "\n".join(other), "o"), (2, "same", "same", "o"), (3, None, None, "o")], "id int, a string, b string, rows string")
    made = diffs.aligned(pairs, "a", "b").select("id", F.explode("rows").alias("r")).select("id", "r.row", "r.changed")
    spans = lambda context: sorted(tuple(r) for r in diffs.visible_spans(made, ["id"], context).collect())
    assert spans(3) == [(1, 0, 4), (1, 5, 12), (1, 16, 20)] and spans(4) == [(1, 0, 13), (1, 15, 20)]


def test_merged(spark):
    base = "one\n\ntwo\n\nthree\n"
    rows = [(1, base, base.replace("one", "one edited"), base.replace("three", "three changed")), (2, base, base.replace("two", "2"), base.replace("two", "II")), (3, base, base.replace("two", "2"), base.replace("two", "2")), (4, None, "a", None), (None, None, None, None)]
    made = diffs.merged(spark.createDataFrame(rows, "id int, base string, a string, b string"), "base", "a", "b")
    got = {r["id"]: (r["merged"], r["n_conflicts"]) for r in made.collect()}
    assert got == {1: ("one edited\n\ntwo\n\nthree changed\n", 0), 2: (None, 1), 3: ("one\n\n2\n\nthree\n", 0), 4: ("a", 0), None: ("", 0)}
    assert [tuple(r) for r in diffs.conflicts(made, ["id"]).collect()] == [(2, 1, ["two"], ["2"], ["II"])]


FILE = "id int, path string, is_dir boolean, date string, size long, md5 string, sha1 string, sha256 string"


def test_fold_tree(spark):
    rows = [
        (1, "/A/B/leaf.bin", False, None, 3, None, "aa", None), (1, "top.bin", None, None, 4, None, "bb", None), (1, "/A/SET.LZH", False, "1999", 10, "m", "cc", "s"), (1, "/A/SET.LZH/src/one.c", False, None, 5, None, "dd", None),
        (1, "/A/SET.LZH/shot.png", False, None, 6, None, "ee", None), (1, "/A/", True, "2001", None, None, None, None), (1, "/Z", True, None, None, None, None, None), (1, "//", False, None, 1, None, None, None),
        (2, None, False, None, 1, None, None, None), (3, "x", False, None, 1, None, None, None), (3, "x", False, None, 2, None, None, None), (3, 'q"u', False, "é", 2, None, None, None),
    ]
    flat = spark.createDataFrame(rows, FILE)
    trees = {r["id"]: json.loads(r["tree"]) for r in history.fold_tree(flat, "id").collect()}
    leaf = lambda name, size, sha1, **more: {"name": name, "type": "file", "size": size, "sha1": sha1, **more}
    archive = {"name": "SET.LZH", "type": "dir", "date": "1999", "size": 10, "md5": "m", "sha1": "cc", "sha256": "s", "children": [{"name": "src", "type": "dir", "children": [leaf("one.c", 5, "dd")]}, leaf("shot.png", 6, "ee")]}
    assert trees == {
        1: [{"name": "A", "type": "dir", "date": "2001", "children": [{"name": "B", "type": "dir", "children": [leaf("leaf.bin", 3, "aa")]}, archive]}, {"name": "Z", "type": "dir", "children": []}, leaf("top.bin", 4, "bb")],
        3: [{"name": 'q"u', "type": "file", "date": "é", "size": 2}, {"name": "x", "type": "file", "size": 2}],
    }
    back = history.tree_files(history.flatten_tree(history.fold_tree(flat, "id"), "id", "tree")).where("id = 1")
    assert sorted((r["path"], r["size"]) for r in back.collect()) == [("/A/B/leaf.bin", 3), ("/A/SET.LZH", 10), ("/A/SET.LZH/shot.png", 6), ("/A/SET.LZH/src/one.c", 5), ("/top.bin", 4)]
    assert history.fold_tree(flat.where("id = 2"), "id").collect() == []


def test_ancestors_of_long_and_wide_histories(spark):
    chain = spark.range(1, 10_000).selectExpr("id as child", "id - 1 as parent")
    found = history.ancestors(chain, spark.createDataFrame([(9999,), (5,), (77_777,)], "id long"), max_rounds=15)
    assert {r["start"]: r["n"] for r in found.groupBy("start").agg(F.count("*").alias("n")).collect()} == {9999: 10_000, 5: 6, 77_777: 1}
    rng = random.Random(4)
    edges = [(i, j) for i in range(1, 60) for j in rng.sample(range(i), min(i, rng.randint(1, 3)))] + [(3, None), (None, 3)]
    want = {}
    for i in range(60):
        want[i] = {i}.union(*(want[b] for a, b in edges if a == i and b is not None))
    got = history.ancestors(spark.createDataFrame(edges, "child long, parent long"), spark.range(60).where("id % 7 = 3"))
    assert {(r["start"], r["id"]) for r in got.collect()} == {(i, j) for i in range(3, 60, 7) for j in want[i]}
    with pytest.raises(RuntimeError):
        history.ancestors(spark.createDataFrame([(1, 2), (2, 1)], "child long, parent long"), spark.createDataFrame([(1,)], "id long"), max_rounds=4)


def test_moves_that_clash(spark):
    pages = spark.createDataFrame([("a", None, False, 1), ("b", None, False, 2), ("c", None, False, 3), ("d", None, True, 4), ("e", None, False, 5)], "slug string, redirect_to string, deleted boolean, id int")
    moves = spark.createDataFrame([("d", "x"), ("a", "x"), ("b", "x"), ("c", "a"), ("none", "y"), ("e", "d"), ("e", "z"), ("b", None)], "slug string, new_slug string")
    got = {tuple(r) for r in upsert.move_pages(pages, moves).collect()}
    assert got == {("x", None, False, 1), ("a", "x", False, None), ("b", None, False, 2), ("c", None, False, 3), ("d", None, True, 4), ("d", None, False, 5), ("e", "d", False, None)}


def test_saves_and_deletions(spark):
    pages = spark.createDataFrame([(1, False), (2, None), (3, True)], "page int, deleted boolean")
    links, objects = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "page int, link string"), spark.createDataFrame([(1, "o"), (2, "p")], "page int, data string")
    gone = spark.createDataFrame([(2,), (3,), (9,)], "page int")
    marked, tables = upsert.delete_pages(pages, {"links": links, "objects": objects}, gone, "page")
    assert {tuple(r) for r in marked.collect()} == {(1, False), (2, True), (3, True)}
    assert {tuple(r) for r in tables["links"].collect()} == {(1, "x"), (3, "z")} and {tuple(r) for r in tables["objects"].collect()} == {(1, "o")}
    after = upsert.save_pages({"links": links, "objects": objects}, gone.where("page = 2"), {"links": spark.createDataFrame([(2, "new")], "page int, link string")}, "page")
    assert {tuple(r) for r in after["links"].collect()} == {(1, "x"), (2, "new"), (3, "z")} and {tuple(r) for r in after["objects"].collect()} == {(1, "o")}


def test_reverts_applied(spark):
    revisions = spark.createDataFrame([(1, 1, "ann", "good"), (1, 2, "bob", "bad"), (2, 3, "bob", "only"), (3, 4, "ann", "kept"), (3, 5, "bob", "of a deleted page")], "page int, rev int, author string, text string")
    plan = history.revert_plan(revisions, "bob", F.lit(True), live=spark.createDataFrame([(1,), (2,)], "page int"))
    assert {tuple(r) for r in plan.collect()} == {(1, 2, 1, "revert"), (2, 3, None, "delete")}
    new = history.apply_reverts(revisions, plan, "mod").exceptAll(revisions)
    assert [tuple(r) for r in new.collect()] == [(1, 3, "mod", "good")]


def test_digests_within_reach(spark):
    rng = random.Random(9)
    base = [rng.randrange(16) for _ in range(70)]
    made = []
    for i in range(160):
        digest = list(base)
        for _ in range(rng.choice([0, 3, 8, 20, 45, 70])):
            digest[rng.randrange(70)] = rng.randrange(16)
        made.append((i, ("T1" if i % 2 else "t1" if i % 3 else "") + "".join("0123456789aBcDeF"[d] for d in digest)))
    made += [(900, None), (901, "nope"), (902, "T1" + "0" * 69), (903, made[0][1]), (None, made[1][1])]
    frame = spark.createDataFrame(made, "id int, digest string")
    distance = {(i, j): kernels.tlsh_distance(a, b) for i, a in made for j, b in made if i is not None and i % 10 == 0 and i != j and j is not None}
    got = {(r["query_id"], r["id"]): r["sim"] for r in tiers.tlsh(frame.where("id % 10 = 0"), frame).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(1 - d / 120, 9) for k, d in distance.items() if d is not None and d <= 120} and len(got) > 50
    both = frame.alias("a").join(frame.alias("b"), F.col("a.id") % 10 == 0).select("a.id", F.col("b.id").alias("other"), tiers.digest_distance(tiers.digest_fields(F.col("a.digest")), tiers.digest_fields(F.col("b.digest"))).alias("d"))
    assert all(r["d"] == distance[r["id"], r["other"]] for r in both.collect() if (r["id"], r["other"]) in distance)


def test_digests_meet_without_a_shuffle(spark):
    frame = spark.createDataFrame([(i, "0" * 68 + f"{i:02x}") for i in range(40)], "id long, digest string")
    near = tiers.tlsh(frame.where("id % 10 = 0"), frame, most_query_rows=2)
    assert near.count() == 4 * 39
    assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()


def test_sound_pairs_against_a_plain_loop():
    rate = 44_100
    t = np.arange(rate * 4) / rate
    x = sum(np.sin(2 * np.pi * f * t) * (np.sin(2 * np.pi * (k + 1) * t) > 0) for k, f in enumerate((220, 331, 907, 1500))) + 0.01 * np.random.default_rng(0).standard_normal(len(t))
    found = kernels.constellation(x, rate)
    y = x[::4]
    frames = np.array([y[s : s + 1024] * np.hanning(1024) for s in range(0, len(y) - 1023, 512)])
    power = np.abs(np.fft.rfft(frames, axis=1))
    edges = np.unique((np.geomspace(55.0, 4000.0, 7) / (rate / 4 / 1024)).astype(int))
    best = [[max(range(a, b), key=lambda k: row[k]) for a, b in zip(edges, edges[1:])] for row in power]  # noqa: B905, B023
    loud = np.array([[row[k] for k in ks] for row, ks in zip(power, best, strict=True)])
    peaks = [(n, k) for n, (ks, ls) in enumerate(zip(best, loud, strict=True)) for k, v in zip(ks, ls, strict=True) if v >= ls.mean() and v > 0.1 * loud.mean()]
    want = set()
    for n, k in peaks:
        later = [(m, j) for m, j in peaks if m > n][:3]
        want |= {(k >> 2) << 16 | (j >> 2) << 6 | (m - n) for m, j in later if m - n <= 63}
    assert found.tolist() == sorted(want) and len(found) > 20
    assert len(kernels.constellation(np.zeros(100), rate)) == 0 and len(kernels.constellation(np.zeros(50_000), rate)) == 0
