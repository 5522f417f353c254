from pyspark.sql import functions as F

from sparkalogue.llm import line_dedup
from sparkalogue.llm.common import session_conf


def test_texts_are_read_once_for_all_candidates(spark, monkeypatch):
    """Common tokens add no reading of the texts, no table of all lines is written, and rows in any order give the same lines."""
    texts = [" ".join(f"w{(i * 7 + k) % 30}" for k in range(10 + i % 3)) + "\t\nx\x0by\r\n \n" + f"own{i} w1 w2" for i in range(40)]
    want, seen = {}, []
    for i, t in enumerate(texts):
        want[i] = 0
        for line in t.split("\n"):
            k = set(line.split())
            want[i] += bool(k) and any(1000 * len(k & s) >= 800 * len(k | s) for s in seen)
            seen += [k] * bool(k)
    names, write = [], line_dedup.write_table
    monkeypatch.setattr(line_dedup, "HOT", 1)
    monkeypatch.setattr(line_dedup, "write_table", lambda df, name: names.append(name) or write(df, name))
    made = spark.createDataFrame(list(enumerate(texts))[::-1], "doc_id long, text string").repartition(5)
    assert {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup(made).collect()} == want
    assert "hot-prefixes" in names and names.count("line-keys") == 1
    assert not {"lines", "line-ids"} & {*names}


def test_a_self_join_under_tokens_shuffles_once(spark, monkeypatch):
    """Both sides of the join of prefix tokens read the same shuffle."""
    plans, write = [], line_dedup.write_table

    def spy(df, name):
        if name == "line-pairs" and not plans:
            assert df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(line_dedup, "write_table", spy)
    made = spark.createDataFrame([(i, " ".join(f"w{k + i % 3}" for k in range(20))) for i in range(30)], "doc_id long, text string")
    with session_conf(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        line_dedup.kept_lines(made).collect()
    assert "SortMergeJoin" in plans[0] and "ReusedExchange" in plans[0]


def test_sets_within_the_threshold_share_a_band(spark):
    sizes = spark.range(1, 300).select(F.col("id").cast("int").alias("n"))
    for t in (501, 800, 1000):
        found = {r["n"]: r["b"] for r in sizes.select("n", line_dedup.bands(t).alias("b")).collect()}
        assert all(set(found[m]) & set(found[n]) for n in found for m in found if m <= n and 1000 * m >= t * n)
        assert max(map(len, found.values())) <= 2 and len({b for bs in found.values() for b in bs}) == 9
