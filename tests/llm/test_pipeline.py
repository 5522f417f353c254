import corpus_pipeline
from pyspark.sql import functions as F


def test_stages_keep_their_contract(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == corpus_pipeline.COLUMNS
        n = out.count()
        assert n == docs.count() if name == "line_dedup" else n <= docs.count()
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.agg(F.countDistinct("doc_id")).first()[0] == docs.count()


def test_stages_on_odd_rows(spark, tmp_path):
    """Each stage against what it must keep of nulls, empty texts, repeated rows, copies and leaks."""
    sf = str(tmp_path)
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    a = "alpha beta gamma delta epsilon zeta eta theta iota kappa\nlamda mu nu xi omicron"
    leak = "so it says: one two three four five six seven eight nine ten eleven twelve and on it goes"
    rows = [(1, a), (1, a), (2, None), (3, ""), (4, a + " pi"), (5, leak), (6, "clean words of its own that nobody else has written down")]
    own = "one more text without an id, and it is like no other text"
    odd = [(None, own), (None, None), (None, leak + " again"), (6, a + " rho"), (6, leak + " once more")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, sf)
    assert kept.columns == corpus_pipeline.COLUMNS and kept.count() == 7
    lines = stages["line_dedup"](spark, kept, sf).collect()
    assert sorted((r["doc_id"], r["text"] is None, r["n_chars"]) for r in lines if r["doc_id"] in (1, 2, 3)) == [(1, False, 0), (1, False, len(a)), (2, True, 0), (3, False, 0)]
    assert next(r["text"] for r in lines if r["doc_id"] == 4) == ""
    near = [(r["doc_id"], r["text"]) for r in stages["ngram_join"](spark, kept, sf).collect()]
    assert sorted(near, key=str) == sorted([(1, a), (2, None), (3, ""), (5, leak), (6, rows[-1][1])], key=str)
    assert sorted(r["doc_id"] for r in stages["decontamination"](spark, kept, sf).collect()) == [1, 1, 2, 3, 4, 6]
    packed = stages["packing"](spark, kept, sf).collect()
    assert sorted({r["doc_id"] for r in packed}) == [1, 2, 3, 4, 5, 6] and len(packed) == 7
    # rows without an id, and two texts of one id, are judged a row each
    more = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows + odd], ", ".join(f"{c} {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in corpus_pipeline.COLUMNS)).repartition(3)
    by_class = [(r["doc_id"], r["text"]) for r in stages["ngram_join"](spark, more, sf).collect()]
    shingles = lambda t: {tuple((w := (t or "").split())[i : i + 5]) for i in range(max(len((t or "").split()) - 4, 0))}
    alike = lambda x, y: bool(shingles(x)) and 5 * len(shingles(x) & shingles(y)) >= 4 * len(shingles(x) | shingles(y))
    assert all(not alike(x[1], y[1]) for n, x in enumerate(by_class) for y in by_class[:n]) and all(any(t == u or alike(t, u) for _, u in by_class) for _, t in rows + odd)
    assert sorted(t for i, t in by_class if i is None or i == 6 if t not in (None, a + " rho", leak + " again", leak + " once more")) == sorted([own, rows[-1][1]])
    clean = [(r["doc_id"], r["text"]) for r in stages["decontamination"](spark, more, sf).collect()]
    assert sorted(clean, key=str) == sorted([r for r in rows + odd if not (r[1] or "").startswith(leak)], key=str)
    empty = docs.where("doc_id = 99")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name
