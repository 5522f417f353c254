"""Record files in and out: JSON lines with isolated bad lines, blobs, binary sidecars."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bundle versions that can be read, and the sidecar's mark.
BUNDLE_SCHEMA, BUNDLE_PROFILE, SIDECAR_MARK = 1, "v1", b"CCK1"
CORRUPT = "_corrupt_record"


def parse_lines(lines: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines) of a DataFrame of JSON lines (line)."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = lines.select("line", F.from_json("line", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    good = parsed.where(F.col(f"r.{CORRUPT}").isNull()).select("r.*").drop(CORRUPT)
    return good, parsed.where(F.col(f"r.{CORRUPT}").isNotNull()).select("line")


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines): a line that isn't a record is set aside and the rest go on."""
    return parse_lines(spark.read.text(path).where("trim(value) <> ''").select(F.col("value").alias("line")), schema)


def write_records(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One compact JSON record a line; in order over all files where one is given."""
    (df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df).write.json(path)


def check_manifest(manifest: dict) -> None:
    """Refuse bundles of other versions."""
    if manifest.get("schema") != BUNDLE_SCHEMA or manifest.get("profile") != BUNDLE_PROFILE:
        raise ValueError(f"bundle of schema {manifest.get('schema')!r}, profile {manifest.get('profile')!r} can't be read")


def missing_blobs(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Wanted hashes that the store doesn't hold."""
    return wanted.select("sha256").distinct().join(stored.select("sha256"), "sha256", "left_anti")


def shard(sha: Column) -> Column:
    """Folder of a content-addressed blob."""
    return F.substring(sha, 1, 2)


def files_under(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of importable files below a folder, contents unread."""
    from ..operators.catalog import is_crawl_image

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", "length", F.col("modificationTime").alias("modified")).where(is_crawl_image(F.col("path")))


def import_units(files: DataFrame) -> DataFrame:
    """(folder, n_files, as_one): folders to import whole, with one descriptor or several tracks of one name."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    name = F.lower(F.regexp_extract("path", "([^/]*)$", 1))
    prefix = F.regexp_extract(name, "^(.*?)\\s*\\(?track\\s*\\d+\\)?.*$", 1)
    marked = files.select(folder.alias("folder"), name.rlike("\\.(cue|gdi|ccd|mds)$").alias("descriptor"), F.when(name.rlike("track\\s*\\d+"), prefix).alias("prefix"))
    units = marked.groupBy("folder").agg(F.count("*").alias("n_files"), F.count_if("descriptor").alias("d"), F.count("prefix").alias("t"), F.countDistinct("prefix").alias("p"))
    return units.select("folder", "n_files", ((F.col("d") == 1) | ((F.col("t") >= 2) & (F.col("p") == 1))).alias("as_one"))


#: First bytes of formats that are told apart without an extension.
MAGIC = {"zip": "504B0304", "7z": "377ABCAF271C", "rar": "526172211A07", "gz": "1F8B", "bz2": "425A68", "xz": "FD377A585A00", "png": "89504E470D0A1A0A", "jpg": "FFD8FF", "gif": "47494638", "pdf": "25504446", "cab": "4D534346"}


def sniff(content: Column) -> Column:
    """Format by first bytes; text if at most one in twenty of the first 1024 bytes is a control byte; else null."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.lit(None).cast("string")
    for kind, mark in MAGIC.items():
        out = F.when(head.startswith(mark), kind).otherwise(out)
    sample = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    controls = F.length(sample) - F.length(F.regexp_replace(sample, "[\\x00-\\x08\\x0e-\\x1f\\x7f]", ""))
    return F.when(out.isNotNull(), out).when(controls * 20 <= F.length(sample), "text")


def best_volume(volumes: DataFrame, key: str) -> DataFrame:
    """The volume of each image with the highest (type priority, file count up to 256)."""
    best = F.max_by(F.struct("*"), F.struct("priority", F.least("n_files", F.lit(256)), F.col("volume")))
    return volumes.groupBy(key).agg(best.alias("v")).select("v.*")


def sidecar(paths: list[str], chunks: list[list[tuple[int, int]]]) -> bytes:
    """Binary chunk list: mark, files, then per file its path and (id, size) pairs, little-endian."""
    out = [SIDECAR_MARK, struct.pack("<I", len(paths))]
    for p, cs in zip(paths, chunks, strict=True):
        b = p.encode()
        out += [struct.pack("<H", len(b)), b, struct.pack("<I", len(cs)), *[struct.pack("<QI", i, n) for i, n in cs]]
    return b"".join(out)


def xml_of(record: Column, root: str = "record") -> Column:
    """XML text of a struct column."""
    return F.to_xml(record, {"rowTag": root})
