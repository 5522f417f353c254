"""Titles, sizes, ids, attributes, features and parent revisions on odd rows."""

import hashlib
import json

from pyspark.sql import functions as F

from sparkalogue.functions import markup, scalars
from sparkalogue.operators import catalog, history, upsert
from sparkalogue.plans.objects import Attribute, attribute_errors


def test_title_parts(spark):
    cases = {
        None: (None, None, None, None, "empty"), "": (None, None, None, None, "empty"), " _ ": (None, None, None, None, "empty"), "#only": (None, None, None, None, "empty"),
        "plain": ("main", "Plain", "Plain", None, None), "two__words x": ("main", "Two_words_x", "Two words x", None, None), "::Image: a b# part ": ("file", "A_b", "A b", "part", None),
        "user_TALK:ann": ("user_talk", "Ann", "Ann", None, None), "other: x": ("main", "Other:_x", "Other: x", None, None), "file:": (None, None, None, None, "empty"), "ßtraße": ("main", "ßtraße", "ßtraße", None, None),
        "élan": ("main", "Élan", "Élan", None, None), "a|b": (None, None, None, None, "illegal-char"), "a\x07b": (None, None, None, None, "illegal-char"), "..": (None, None, None, None, "relative"), "a/../b": (None, None, None, None, "relative"),
        "a/.": (None, None, None, None, "relative"), "x" * 255: ("main", "X" + "x" * 254, "X" + "x" * 254, None, None), "é" * 128: (None, None, None, None, "too-long"), "a#": ("main", "A", "A", None, None),
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", markup.title_parts(F.col("t")).alias("p")).collect()
    assert {r["t"]: tuple(r["p"]) for r in got} == cases


def test_size_texts(spark):
    sizes = [None, 0, 1023, 1024, 1536, 1024**2, 1024**3, 5 * 1024**4]
    got = spark.createDataFrame([(s,) for s in sizes], "n long").select(scalars.listing_size(F.col("n")).alias("a"), scalars.field_size(F.col("n")).alias("b")).collect()
    assert [r["a"] for r in got] == ["—", "0 B", "1023 B", "1.0 KB", "1.5 KB", "1.0 MB", "1.0 GB", "5.0 TB"]
    assert [r["b"] for r in got] == [None, "0 B", "1023 B", "1.0 KiB", "1.5 KiB", "1.0 MiB", "1.00 GiB", "5120.00 GiB"]


def test_get_or_create(spark):
    stored = spark.createDataFrame([(1, "Red Ball", "X1", "red-ball--x1"), (2, "red ball", "x1", None), (3, "Kite", "", None), (4, "kite!", "", None)], "id long, name string, system string, slug string")
    wanted = spark.createDataFrame([("Kite", ""), ("Kite", None), ("New", "S"), ("new", "s"), ("New", "S"), (None, "S")], "name string, system string")
    got = {(r["name"], r["system"]): (r["id"], r["slug"]) for r in upsert.get_or_create(stored, wanted).collect()}
    assert got[("Red Ball", "X1")] == (1, "red-ball--x1") and got[("red ball", "x1")] == (2, "red-ball--x1-2") and got[("Kite", "")] == (3, "kite") and got[("kite!", "")] == (4, "kite-4")
    ids = [i for i, _ in got.values()]
    first, second = sorted((got[("New", "S")], got[("new", "s")]))
    assert len(got) == 6 and len(set(ids)) == 6 and first[1] == "new--s" and second[1] == f"new--s-{second[0]}" and first[0] > 4
    assert upsert.get_or_create(stored.where("id < 0"), wanted.where("name is null")).collect() == []


def test_attribute_errors(spark):
    fields = {"size": Attribute("number"), "made": Attribute("date"), "by": Attribute("string", multi=True)}
    rows = [({"size": "1", "made": "1999-05", "by": "a,b"},), ({"size": "x", "colour": "red"},), ({"made": " ", "zz": None},), (None,), ({},)]
    got = spark.createDataFrame(rows, "raw map<string,string>").select(attribute_errors(fields, F.col("raw"), frozenset({"made"})).alias("e")).collect()
    assert [r["e"] for r in got] == [[], ["bad value: size", "missing: made", "unknown: colour"], ["missing: made", "unknown: zz"], ["missing: made"], ["missing: made"]]
    assert spark.createDataFrame([({"a": "b"},)], "raw map<string,string>").select(attribute_errors({}, F.col("raw")).alias("e")).first()["e"] == ["unknown: a"]


def test_query_features(spark):
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    id63 = lambda t: int(sha(t)[:16], 16) & (2**63 - 1)
    deep = {"name": "d", "type": "dir", "children": [{"name": "e", "type": "dir", "children": [{"name": "f", "type": "file", "sha1": sha("f")}, {"name": "again", "type": "file", "sha1": sha("f")}]}, {"name": "none", "type": "file"}]}
    record = {"image": {"sha256": "s", "name": "n"}, "exe_fp": {"tlsh": "T1"}, "media": [{"kind": "audio", "path": "p", "audio_fp": [7]}, {"kind": "audio", "path": "q"}], "contents": [deep, {"name": "g", "type": "file", "sha1": sha("g")}]}
    got = {r["k"]: r for r in catalog.query_features(spark.createDataFrame([(1, json.dumps(record)), (2, "{}"), (3, None), (4, "broken")], "k int, r string"), "k", "r").collect()}
    assert got[1]["fileset"] == sorted([id63("f"), id63("g")]) and got[1]["sha256"] == "s" and got[1]["tlsh"] == "T1" and got[1]["imphash"] is None
    assert [(t["track"], t["subfp"]) for t in got[1]["tracks"]] == [("p", [7])]
    assert all(got[k]["fileset"] == [] and got[k]["name"] is None for k in (2, 3, 4)) and len(got) == 4


def test_parent_deltas_and_extensions(spark):
    made = spark.createDataFrame([(1, None, "abc"), (2, 1, "abcd"), (3, 1, "a"), (4, 99, "xy"), (5, 2, None)], "rev int, parent int, text string")
    assert {r["rev"]: (r["size"], r["delta"]) for r in history.parent_deltas(made, "rev", "parent", F.length("text")).collect()} == {1: (3, 3), 2: (4, 1), 3: (1, -2), 4: (2, 2), 5: (None, None)}
    files = spark.createDataFrame([("k", "/A/x.BIN"), ("k", "y.bin"), ("k", ".hidden"), ("k", "none"), ("l", None)], "k string, p string")
    assert {tuple(r) for r in catalog.extension_histogram(files, "k", "p").collect()} == {("k", "bin", 2)}
