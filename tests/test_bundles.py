"""Zips read by member, and exports written and read back."""

import hashlib
import json
import zipfile

import pytest
from pyspark.sql import types as T

from sparkalogue.sources import bundles

SCHEMA = T.StructType([T.StructField("sha256", T.StringType()), T.StructField("n", T.LongType())])
BODY = '{"sha256": "x", "n": 1}\nbroken\n\n{"sha256": "y", "n": 2}'


def zipped(path, profile="v1", digest=None, n_assets=3):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("manifest.json", json.dumps({"schema": 1, "profile": profile} | ({"body_sha256": digest} if digest else {})))
        z.writestr("builds.jsonl", BODY)
        z.writestr("assets/", b"")
        for k in range(n_assets):
            z.writestr(f"assets/{k:064d}", b"data%d" % k)


def test_zips(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    zipped(tmp_path / "in" / "a.zip", digest=hashlib.sha256(BODY.encode()).hexdigest())
    zipped(tmp_path / "in" / "b.zip", n_assets=5)
    good, bad, assets = bundles.read_zips(spark, str(tmp_path / "in"), SCHEMA)
    assert sorted((r["sha256"], r["n"]) for r in good.collect()) == [("x", 1), ("x", 1), ("y", 2), ("y", 2)] and [r["line"] for r in bad.collect()] == ["broken", "broken"]
    assert {r["sha256"]: bytes(r["content"]) for r in assets.collect()} == {f"{k:064d}": b"data%d" % k for k in range(5)}
    one, _, _ = bundles.read_zips(spark, f"file://{tmp_path}/in/a.zip", SCHEMA)
    assert one.count() == 2
    monkeypatch.setattr(bundles, "RUN_BYTES", 10)
    parts = bundles._Reader(str(tmp_path / "in" / "b.zip")).partitions()
    assert [p.kind for p in parts] == ["record", "asset", "asset", "asset"] and [len(p.names) for p in parts[1:]] == [2, 2, 1]


def test_zips_that_are_refused(spark, tmp_path):
    zipped(tmp_path / "old.zip", profile="v9")
    with pytest.raises(Exception, match="can't be read"):
        bundles.read_zips(spark, str(tmp_path / "old.zip"), SCHEMA)[0].collect()
    zipped(tmp_path / "cut.zip", digest="0" * 64)
    with pytest.raises(Exception, match="isn't the one"):
        bundles.read_zips(spark, str(tmp_path / "cut.zip"), SCHEMA)[0].collect()
    (tmp_path / "none").mkdir()
    assert bundles.read_zips(spark, str(tmp_path / "none"), SCHEMA)[2].collect() == []


def test_exports(spark, tmp_path):
    records = spark.createDataFrame([(f"s{k:03d}", k) for k in range(50)] + [(None, None)], SCHEMA).repartition(5)
    assets = spark.createDataFrame([("aa", b"1"), ("aa", b"1"), ("bb", b"2"), (None, b"3")], "sha256 string, content binary")
    path = str(tmp_path / "export")
    manifest = bundles.write_export(records, assets, path, ["sha256"], part_rows=7)
    assert (manifest["n_records"], manifest["n_assets"]) == (51, 2) and json.loads((tmp_path / "export" / "manifest.json").read_text()) == manifest
    good, bad, held = bundles.read_export(spark, path, SCHEMA)
    assert sorted(map(tuple, good.collect()), key=str) == sorted(map(tuple, records.collect()), key=str) and bad.count() == 0
    assert {r["sha256"]: bytes(r["content"]) for r in held.collect()} == {"aa": b"1", "bb": b"2"}
    parts = sorted((tmp_path / "export" / "builds.jsonl").glob("part-*"))
    lines = [json.loads(line).get("sha256") or "" for p in parts for line in p.read_text().splitlines()]
    assert lines == sorted(lines) and max(len(p.read_text().splitlines()) for p in parts) == 7
    # the same records in another order of files give the same body
    again = bundles.write_export(records.repartition(2), assets, str(tmp_path / "again"), ["sha256"], part_rows=7)
    assert again["n_records"] == 51
    parts[0].write_text(parts[0].read_text() + "{}\n")
    with pytest.raises(Exception, match="isn't the one|ChecksumException"):
        bundles.read_export(spark, path, SCHEMA)


def test_export_of_nothing(spark, tmp_path):
    path = str(tmp_path / "export")
    manifest = bundles.write_export(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "sha256 string, content binary"), path, ["sha256"])
    assert manifest["n_records"] == 0 and bundles.read_export(spark, path, SCHEMA)[0].collect() == []
