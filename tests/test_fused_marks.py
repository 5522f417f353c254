"""fused_similarity: which documents have labels is sent as bits, so texts are not shuffled."""

from sparkalogue.queries import similarity


def test_marks_are_those_of_the_labels(spark):
    ids = [-130, -65, -64, -63, -1, 0, 1, 62, 63, 64, 65, 127, 128, 4096, 2**62, -(2**63), 2**63 - 1, None]
    docs = spark.createDataFrame([(i, f"t{n}", 7) for n, i in enumerate(ids)], "doc_id long, text string, row int")
    listed = [i for n, i in enumerate(ids) if n % 2 == 0] + [None, 0, 1000]
    labels = spark.createDataFrame([(i, 1) for i in listed], "doc_id long, toxic int")
    found = {r["doc_id"]: r["l"] for r in similarity._marked(docs.select("doc_id", "text"), labels).collect()}
    assert found == {i: i is not None and i in listed for i in ids}


def test_texts_are_not_shuffled_for_a_list_of_ids(spark, tmp_path):
    texts = {i: f"some words of {i % 7} and {i}" for i in range(400)} | {500: "...", 600: "...", 700: None}
    labelled = {*range(0, 400, 3), 500}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i,) for i in labelled], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        made = similarity.fused_similarity(spark, str(tmp_path))
        found = {(r["query_id"], r["id"]): r["score"] for r in made.collect()}
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    words = {i: set((t or "").replace("...", "").split()) for i, t in texts.items()}
    want = {}
    for q in range(0, 400, 100):
        for i in range(400):
            j = len(words[q] & words[i]) / len(words[q] | words[i])
            if q != i:
                want[q, i] = 0.2 * j / 0.45 if {q, i} <= labelled else j
    assert found.keys() == want.keys() and all(abs(found[k] - v) < 1e-5 for k, v in want.items())
    assert "MapInArrow" in plan and "hashpartitioning(doc_id" not in plan
