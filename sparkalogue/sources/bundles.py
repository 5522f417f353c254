"""Bundles of records and their assets: zips read member by member, and exports whose manifest comes last.

A zip bundle holds manifest.json, builds.jsonl and assets/<sha256>. Its central directory is read
once and tells the partitions: the body, streamed line by line, and runs of assets of bounded size.
An export is a folder: body parts of JSON lines in order, an assets table, and manifest.json with
counts and the sha256 of each part, written when all else stands; a folder without one isn't read.
"""

from __future__ import annotations

import hashlib
import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .records import BUNDLE_PROFILE, BUNDLE_SCHEMA, check_manifest, parse_lines

#: Bytes of assets that one partition reads.
RUN_BYTES = 64_000_000
BODY, ASSETS = "builds.jsonl", "assets/"


def _files(path: str):
    """(file system, path) of a path with or without a scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _zips(path: str) -> list[str]:
    from pyarrow import fs

    system, at = _files(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.Directory:
        found = [f.path for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.path.endswith(".zip")]
    else:
        found = [at]
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    return sorted(head + f for f in found)


def _opened(path: str) -> zipfile.ZipFile:
    """The zip's directory; members are read from their place when they are asked for."""
    system, at = _files(path)
    return zipfile.ZipFile(system.open_input_file(at))


@dataclass
class Part(InputPartition):
    bundle: str
    kind: str  # "record" or "asset"
    names: list[str]
    digest: str | None = None


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        parts: list[Part] = []
        for bundle in _zips(self.path):
            with _opened(bundle) as z:
                manifest = json.loads(z.read("manifest.json"))
                check_manifest(manifest)
                parts.append(Part(bundle, "record", [BODY], manifest.get("body_sha256")))
                run, size = [], 0
                for member in z.infolist():
                    if not member.filename.startswith(ASSETS) or member.is_dir():
                        continue
                    if run and size + member.file_size > RUN_BYTES:
                        parts.append(Part(bundle, "asset", run))
                        run, size = [], 0
                    run.append(member.filename)
                    size += member.file_size
                if run:
                    parts.append(Part(bundle, "asset", run))
        return parts or [Part("", "asset", [])]

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition.names:
            return
        with _opened(partition.bundle) as z:
            if partition.kind == "asset":
                for name in partition.names:
                    yield partition.bundle, "asset", name[len(ASSETS) :], None, z.read(name)
                return
            digest = hashlib.sha256()
            with z.open(BODY) as body:
                for line in body:
                    digest.update(line)
                    if line.strip():
                        yield partition.bundle, "record", None, line.decode().rstrip("\r\n"), None
            if partition.digest and partition.digest != digest.hexdigest():
                raise ValueError(f"the body of {partition.bundle} isn't the one that its manifest tells of")


class BundleSource(DataSource):
    """spark.read.format("bundle").load(path): (bundle, kind, name, line, content) of a zip or of all zips below a folder."""

    @classmethod
    def name(cls) -> str:
        return "bundle"

    def schema(self) -> str:
        return "bundle string, kind string, name string, line string, content binary"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"])


def read_zips(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, bad lines, assets (sha256, content)) of zip bundles; a manifest of another version fails the read."""
    spark.dataSource.register(BundleSource)
    found = spark.read.format("bundle").load(path)
    good, bad = parse_lines(found.where("kind = 'record'").select("line"), schema)
    return good, bad, found.where("kind = 'asset'").select(F.col("name").alias("sha256"), "content").dropDuplicates(["sha256"])


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256) of an export's body parts; a part is read whole, so parts are bounded in rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/{BODY}")
    return files.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"))


def _body_digest(parts: DataFrame) -> str:
    """sha256 over the parts' sha256 in order of their names."""
    names = sorted((r["name"], r["sha256"]) for r in parts.collect())  # a row a part
    return hashlib.sha256("".join(d for _, d in names).encode()).hexdigest()


def write_export(records: DataFrame, assets: DataFrame, path: str, order: list[str], part_rows: int = 200_000) -> dict:
    """Write records in order, assets (sha256, content) once each, then the manifest, which is returned."""
    spark = records.sparkSession
    lines = records.repartitionByRange(*order).sortWithinPartitions(*order).select(F.to_json(F.struct("*")).alias("value"))
    lines.write.mode("overwrite").option("maxRecordsPerFile", part_rows).text(f"{path}/{BODY}")
    assets.select("sha256", "content").where("sha256 is not null").dropDuplicates(["sha256"]).write.mode("overwrite").parquet(f"{path}/assets")
    manifest = {
        "schema": BUNDLE_SCHEMA, "profile": BUNDLE_PROFILE, "n_records": spark.read.text(f"{path}/{BODY}").count(), "n_assets": spark.read.parquet(f"{path}/assets").count(),
        "body_sha256": _body_digest(_parts(spark, path)),
    }
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest.json")
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    return manifest


def read_export(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, bad lines, assets) of an export; it must have a manifest, and the body that this tells of."""
    manifest = json.loads(spark.read.option("wholetext", "true").text(f"{path}/manifest.json").first()["value"])
    check_manifest(manifest)
    if _body_digest(_parts(spark, path)) != manifest["body_sha256"]:
        raise ValueError("the body isn't the one that the manifest tells of")
    good, bad = parse_lines(spark.read.text(f"{path}/{BODY}").select(F.col("value").alias("line")), schema)
    return good, bad, spark.read.parquet(f"{path}/assets")
