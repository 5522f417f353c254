"""Trees are folded behind one shuffle, and a null key is a key."""

from sparkalogue.operators import history

SCHEMA = "k long, path string, is_dir boolean, date string, size long, md5 string, sha1 string, sha256 string"


def test_fold_shuffles_once_and_keeps_null_keys(spark):
    rows = [(k, path, False, None, size, md5, None, None) for k in (1, None) for path, size, md5 in (("a/z.zip/m", 1, None), ("a/z.zip", 5, "h"), ("b", 2, None), ("c/d/e", 3, None), ("c/d/e", 4, None))]
    rows += [(1, "a", True, "2000", None, None, None, None), (1, "empty", True, None, None, None, None, None), (2, "", False, None, 1, None, None, None)]
    trees = history.fold_tree(spark.createDataFrame(rows, SCHEMA), "k")
    zipped = '{"name":"z.zip","type":"dir","size":5,"md5":"h","children":[{"name":"m","type":"file","size":1}]}'
    rest = '{"name":"c","type":"dir","children":[{"name":"d","type":"dir","children":[{"name":"e","type":"file","size":4}]}]},%s{"name":"b","type":"file","size":2}'
    want = {
        1: '[{"name":"a","type":"dir","date":"2000","children":[' + zipped + "]}," + rest % '{"name":"empty","type":"dir","children":[]},' + "]",
        None: '[{"name":"a","type":"dir","children":[' + zipped + "]}," + rest % "" + "]",
    }
    assert {r["k"]: r["tree"] for r in trees.collect()} == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = history.fold_tree(spark.createDataFrame(rows, SCHEMA), "k")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Exchange") == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
