import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkalogue.operators import catalog, history, search, tiers, upsert
from sparkalogue.plans.objects import Attribute, ObjectQuery, QueryError, Registry, compile_query, from_tag, parse_sort, snake_case
from sparkalogue.sources import records
from sparkalogue.streaming import jobs
from sparkalogue.streaming.store import Store, ingest


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_fusion(spark):
    t = spark.createDataFrame([(1, 2, "files", 1.0), (1, 2, "files", 0.4), (1, 3, "text", 0.6), (1, 4, "text", 0.8), (1, 5, "text", 0.6), (1, 5, "files", 0.3), (1, 6, "files", 0.0)], "query_id int, id int, tier string, sim double")
    got = {r["id"]: r["scores"] for r in tiers.fuse(t).collect()}
    assert got == {2: {"files": 1.0}, 4: {"text": 0.8}, 5: {"text": 0.6, "files": 0.3}}
    caps = F.array(*map(F.lit, ("content", "files", "chunks", "resemblance", "audio", "text", "imphash", "tlsh")))
    s = spark.range(1).select(tiers.weighted_score(F.create_map(F.lit("files"), F.lit(1.0), F.lit("resemblance"), F.lit(1.0)), caps, caps).alias("s"), tiers.weighted_score(F.create_map(F.lit("files"), F.lit(0.5)), F.array(F.lit("files")), caps).alias("t"), tiers.weighted_score(F.create_map(F.lit("files"), F.lit(0.5)), F.array(F.lit("audio")), F.array(F.lit("files"))).alias("u")).first()
    assert abs(s["s"] - 0.35) < 1e-9 and s["t"] == 0.5 and s["u"] == 0.0


def test_merge_and_hash_terms(spark):
    names = spark.createDataFrame([("b1", 0.9), ("b2", 0.5), ("b3", 0.4)], "id string, sim double")
    files = spark.createDataFrame([("b2", 0.8), ("b1", 0.9)], "id string, sim double")
    assert rows(catalog.merge_ranked(names, files, "id", "sim"), F.desc("sim")) == [("b1", 0.9), ("b2", 0.8), ("b3", 0.4)]
    assert catalog.is_hash("deadBEEF") and not catalog.is_hash("dead")


def test_composite_ignores_order(spark):
    a, b = "a" * 40, "b" * 40
    df = spark.createDataFrame([(1, a), (1, b), (2, b), (2, a), (3, a), (3, a), (4, "zz"), (4, None)], "k int, d string")
    got = dict(rows(catalog.composite_digest(df, "k", "d")))
    assert got[1] == got[2] != got[3] and got[4] is None


def test_history(spark):
    edges = spark.createDataFrame([("c2", "c1"), ("c3", "c2"), ("c4", "c1"), ("c5", "c3"), ("c5", "c4")], "child string, parent string")
    got = history.ancestors(edges, spark.createDataFrame([("c5",), ("c3",)], "id string"))
    assert rows(got, "start", "id") == [("c3", "c1"), ("c3", "c2"), ("c3", "c3"), *[("c5", f"c{i}") for i in range(1, 6)]]
    assert history.blame_lines(["a\nb", "a\nx\nb"]) == [0, 1, 0]
    assert history.hunks([0, 0, 2, 2, 2, 0]) == [(0, 0, 2), (2, 2, 3), (0, 5, 1)]
    d = spark.createDataFrame([(1, i, n) for i, n in enumerate([1, 1, 2, 2, 3, 3, 5, 5, 0])], "k int, day int, n int")
    levels = rows(history.quartile_levels(d, "k", "n").select("n", "level"), "n", "level")
    assert levels == [(0, 0), (1, 1), (1, 1), (2, 2), (2, 2), (3, 3), (3, 3), (5, 4), (5, 4)]
    commits = spark.createDataFrame([("abcd1",), ("abcd2",), ("beef9",)], "oid string")
    assert history.resolve_revision(commits, {"HEAD": "x"}, "HEAD") == "x"
    assert history.resolve_revision(commits, {}, "abcd") is None and history.resolve_revision(commits, {}, "beef") == "beef9"
    old = spark.createDataFrame([("a", "blob", "1"), ("b", "blob", "1"), ("c", "blob", "1")], "path string, type string, oid string")
    new = spark.createDataFrame([("a", "blob", "2"), ("c", "tree", "1"), ("d", "blob", "1")], "path string, type string, oid string")
    assert rows(history.tree_diff(old, new), "path", "change") == [("a", "blob", "modify"), ("b", "blob", "delete"), ("c", "tree", "add"), ("c", "blob", "delete"), ("d", "blob", "add")]
    pairs = history.line_changes(spark.createDataFrame([("a\nb", "a\nc\nd")], "x string, y string"), "x", "y")
    assert rows(pairs.select("added", "removed")) == [(2, 1)]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    new = spark.createDataFrame([(2, "b"), (3, "c"), (1, "a")], "k int, v string")
    assert rows(upsert.changed_only(old, new, ["k"]), "k") == [(2, "b"), (3, "c")]
    assert rows(upsert.insert_missing(old, new, ["k"]), "k") == [(1, "a"), (2, None), (3, "c")]
    stored = spark.createDataFrame([(1, "auto", "x"), (1, "amended", "y"), (2, "auto", "z")], "p int, status string, v string")
    got = upsert.replace_status(stored, spark.createDataFrame([(1, "auto", "n")], "p int, status string, v string"), ["p"])
    assert rows(got, "p", "v") == [(1, "auto", "n"), (1, "amended", "y"), (2, "auto", "z")]
    slugs = upsert.unique_slugs(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, n string"), F.col("n"), "id")
    assert rows(slugs.select("id", "slug"), "id") == [(1, "a"), (2, "a-2"), (3, "b")]
    diff = spark.range(1).select(upsert.field_changes(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("3"))).alias("d"))
    assert diff.first()["d"] == {"b": ["2", "3"]}


REG = Registry({"board": {"made_on": Attribute("date"), "scanned_by": Attribute("string", multi=True), "size": Attribute("number"), "name": Attribute()}})


def objects(spark):
    data = [{"name": "A", "size": "10", "scanned_by": ["x", "y"], "made_on": "1999-05"}, {"name": "B", "size": "9", "made_on": None}, {"name": "C", "scanned_by": ["y"]}]
    o = spark.createDataFrame([(i, "board", 0, json.dumps(d)) for i, d in enumerate(data)], "page_id int, component string, ordinal int, data string")
    p = spark.createDataFrame([(i, "main", f"s{i}", "t", None, None, None, i == 9, "public") for i in range(3)], "page_id int, ns string, slug string, title string, created timestamp, modified timestamp, deleted_at timestamp, is_redirect boolean, visibility string")
    return o, p


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ({"name": "A"}, [0]), ({"name": {"ne": "A"}}, [1, 2]), ({"scanned_by": "y"}, [0, 2]), ({"scanned_by": {"ne": "x"}}, [2]), ({"scanned_by": {"in": ["x", "z"]}}, [0]),
        ({"size": {"gt": 9}}, [0]), ({"size": {"ne": 10}}, [1, 2]), ({"made_on": {"exists": True}}, [0, 1]), ({"made_on": {"gte": "1999"}}, [0]), ({"name": {"like": "*b"}}, [1]),
        ({"or": [{"name": "A"}, {"not": {"size": {"lt": 100}}}]}, [0]),
    ],
)
def test_object_conditions(spark, where, want):
    got = compile_query(REG, ObjectQuery(["board"], where=where), *objects(spark))
    assert sorted(r["page_id"] for r in got.collect()) == want


def test_object_errors_and_shapes(spark):
    o, p = objects(spark)
    deep = {"name": "A"}
    for _ in range(70):
        deep = {"not": deep}
    for bad in ({"nope": 1}, {}, {"and": []}, {"size": {"like": "1*"}}, {"name": {"huh": 1}}, deep):
        with pytest.raises(QueryError):
            compile_query(REG, ObjectQuery(["board"], where=bad), o, p)
    with pytest.raises(QueryError):
        compile_query(REG, ObjectQuery(["none"]), o, p)
    with pytest.raises(QueryError):
        from_tag({"from": "board", "format": "latest"})
    got = compile_query(REG, ObjectQuery(["board"], select=["name", "size"], sort=[("size", "desc")], limit=2), o, p).orderBy(F.lit(1)).collect()
    assert [json.loads(r["data"]) for r in got] == [{"name": "A", "size": "10"}, {"name": "B", "size": "9"}] and got[0]["truncated"]
    grouped = compile_query(REG, ObjectQuery(["board"], aggs=[{"fn": "count", "as": "n"}], group_by="size"), o, p)
    assert rows(grouped) == [("10", 1), ("9", 1), (None, 1)]
    assert snake_case("madeOn") == "made_on" and parse_sort("a,-b") == [("a", "asc"), ("b", "desc")]


def test_search(spark):
    df = spark.createDataFrame([(1, "The builders were building nations"), (2, "nothing here"), (3, None)], "id int, text string")
    assert [r["id"] for r in df.where(search.has_all(F.col("text"), "were The")).collect()] == [1]
    assert df.select(search.snippet(F.col("text"), "WERE", 4).alias("s")).collect()[0]["s"] == "…ers were bui…"
    assert df.select(search.highlight(F.col("text"), "were", 4).alias("s")).collect()[0]["s"] == "…ers [[were]] bui…"


SCHEMA = T.StructType([T.StructField("sha256", T.StringType()), T.StructField("n", T.LongType())])


def test_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"sha256": "x", "n": 1}\nnot json\n{"sha256": "y", "n": 2}\n')
    good, bad = records.read_records(spark, str(tmp_path / "a.jsonl"), SCHEMA)
    assert rows(good, "n") == [("x", 1), ("y", 2)] and rows(bad) == [("not json",)]
    assert records.sidecar(["a"], [[(1, 2)]]).startswith(b"CCK1")
    kinds = spark.createDataFrame([(b"PK\x03\x04zz",), (b"hello\n",), (bytes(range(32)),)], "c binary").select(records.sniff(F.col("c")).alias("k"))
    assert [r["k"] for r in kinds.collect()] == ["zip", "text", None]
    units = records.import_units(spark.createDataFrame([("d/x.cue",), ("d/x.bin",), ("e/g (Track 1).bin",), ("e/g (Track 2).bin",), ("f/a.iso",)], "path string"))
    assert rows(units.select("folder", "as_one"), "folder") == [("d", True), ("e", True), ("f", False)]


def files_below(path):
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("part-*")}


def test_store_takes_each_batch_once(spark, tmp_path):
    kept = Store(spark, str(tmp_path / "store"), T._parse_datatype_string("k int, v string, ts int"), ["k"])
    frame = lambda *r: spark.createDataFrame(list(r), "k int, v string, ts int")
    now = lambda: sorted((r["k"], r["v"], r["private"]) for r in kept.read().collect())
    newest = [F.desc("ts")]
    assert now() == [] and kept.apply(frame((1, "a", 1), (1, "b", 2), (2, "c", 1)), 0, newest) == 2
    assert kept.apply(frame((2, "c", 1), (3, "d", 1)), 1, newest, private=True) == 1
    before = files_below(tmp_path)
    assert kept.apply(frame((2, "c", 1), (3, "d", 1)), 1, newest, private=True) == 0 and files_below(tmp_path) == before
    assert kept.apply(frame((3, "d2", 2), (2, "c", 1)), 2, newest) == 1 and kept.apply(frame((2, "c", 1)), 3, newest, force=True, private=True) == 1
    want = [(1, "b", False), (2, "c", False), (3, "d2", True)]
    assert now() == want
    # only buckets changed often enough are written anew, and reading is as before
    due = kept.merge(least=2)
    assert len(due) == 2 and now() == want and kept.merge(least=2) == []
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in files_below(tmp_path / "store" / "base")} == set(due)
    assert kept.apply(frame((1, None, 5), (4, "e", 1)), 4, newest) == 2 and now() == [(1, None, False), *want[1:], (4, "e", False)]
    assert sorted(r["k"] for r in kept.read(before=1).collect() if r["k"] not in (2, 3)) == [1]
    assert kept.apply(frame(), 5) == 0 and kept.merge(least=1) and len(now()) == 4


def test_stream_into_a_store(spark, tmp_path):
    src, schema = tmp_path / "in", "k int, v string, ts int"
    kept = Store(spark, str(tmp_path / "store"), T._parse_datatype_string(schema), ["k"])
    run = lambda: ingest(kept, spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "cp"), [F.desc("ts")], merge_after=1).awaitTermination()
    for batch in ([(1, "a", 1), (1, "b", 2), (2, "c", 1)], [(2, "d", 5), (3, "e", 5)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(src))
        run()
    run()
    assert rows(kept.read().select("k", "v"), "k") == [(1, "b"), (2, "d"), (3, "e")]


def test_stream_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")).withColumn("ts", F.col("ts").cast("timestamp"))
    q = jobs.window_counts(stream, "ts", "event_type", "1 day", late="1 hour").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == events.count()


def test_moderation_gathers_no_log(spark, capsys):
    log = [("a", 1, "view"), ("a", 2, "amend"), ("b", 1, "reject"), ("b", 2, "amend"), ("c", 1, None), (None, 1, "amend"), ("d", 3, "view"), ("e", 1, "amend"), ("e", 2, "reject")]
    got = jobs.moderate(spark.createDataFrame(log, "id string, seq long, action string"))
    assert dict(got.collect()) == {"a": "amended", "b": "rejected", "c": "auto", None: "amended", "d": "auto", "e": "rejected"}
    got.explain()
    assert "collect_list" not in capsys.readouterr().out


def test_best_tracks_against_a_plain_loop(spark):
    """Tracks of rare and common tokens, equal ones and ones without known tokens; only pairs from the least score on are made."""
    held = {(b, t): {f"t{(b * 7 + t * 3 + n * n) % 23}" for n in range(1 + (b + t) % 6)} for b in range(30) for t in range(3)} | {(40, 1): {"unknown"}, (41, 1): {"t1"}, (50, 1): {"t1"}}
    idf = {f"t{n}": 0.1 + n / 10 for n in range(23)}
    frame = spark.createDataFrame([(b, t, tok) for (b, t), toks in held.items() for tok in sorted(toks)] + [(None, 1, "t1"), (60, None, "t1")], "build long, track int, tok string")
    weight = lambda toks: sum(idf.get(tok, 0) for tok in toks)
    for least in (0.05, 0.55):
        want = {}
        for (qb, qt), q in held.items():
            for (b, t), toks in held.items():
                if qb % 10 == 0 and b != qb and (w := weight(q & toks)) and (sim := round(w / (weight(q) + weight(toks) - w), 6)) >= least:
                    want[qb, qt, b] = min(want.get((qb, qt, b), (0, 0)), (-sim, t))
        got = tiers.weighted_tracks(frame.where("build % 10 = 0"), frame, spark.createDataFrame([*idf.items()], "tok string, idf double"), least)
        assert sorted(rows(got)) == sorted((*k, t, -s) for k, (s, t) in want.items())
