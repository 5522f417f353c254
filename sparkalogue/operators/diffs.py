"""Line diffs and three-way merges of texts, a pair or a triple of texts a row."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import alignment

#: Texts that Python takes at a time.
BATCH_ROWS = 500
_ROW = pa.struct([("row", pa.int32()), ("old_line", pa.int32()), ("old_text", pa.string()), ("new_line", pa.int32()), ("new_text", pa.string()), ("changed", pa.bool_())])
_REGION = pa.struct([("region", pa.int32()), ("kind", pa.string()), ("base_lines", pa.list_(pa.string())), ("our_lines", pa.list_(pa.string())), ("their_lines", pa.list_(pa.string()))])


def split_lines(text: str | None) -> list[str]:
    """Lines of a text; an end of line at its very end begins no other."""
    lines = (text or "").split("\n")
    return lines[:-1] if lines[-1] == "" else lines


def diff_rows(old: str | None, new: str | None) -> list[tuple]:
    """(row, old line, its text, new line, its text, changed) side by side; lines count from 1.

    The i-th line that goes stands beside the i-th that comes in its place, with nulls where one
    side has fewer.
    """
    a, b, rows, i, j = split_lines(old), split_lines(new), [], 0, 0
    for start, begin, n in [*alignment.align(a, b), (len(a), len(b), 0)]:
        for k in range(max(start - i, begin - j)):
            left, right = (i + k if i + k < start else None), (j + k if j + k < begin else None)
            rows.append((len(rows), None if left is None else left + 1, None if left is None else a[left], None if right is None else right + 1, None if right is None else b[right], True))
        for k in range(n):
            rows.append((len(rows), start + k + 1, a[start + k], begin + k + 1, b[begin + k], False))
        i, j = start + n, begin + n
    return rows


def _listed(rows: list[list[tuple]], kind: pa.StructType) -> pa.Array:
    return pa.array([[dict(zip(kind.names, r, strict=True)) for r in each] for each in rows], pa.list_(kind))


def _with_rows(df: DataFrame, texts: list[str], name: str, kind: pa.StructType, schema: str, make) -> DataFrame:
    """df with an array column that make(*texts) gives for each row; other columns pass by."""
    kept = [c for c in df.columns if c != name]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                made = [make(*t) for t in zip(*(batch.column(c).to_pylist() for c in texts), strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], _listed(made, kind)], names=[*kept, name])

    return df.mapInArrow(run, f"{fields}, `{name}` array<struct<{schema}>>")


def aligned(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """pairs with `rows`: both texts side by side by diff_rows; null texts are empty, equal rows stay."""
    return _with_rows(pairs, [old, new], "rows", _ROW, "row: int, old_line: int, old_text: string, new_line: int, new_text: string, changed: boolean", diff_rows)


def visible_spans(rows: DataFrame, key: list[str], context: int = 3) -> DataFrame:
    """(key, first, end): rows to show, the changed ones and `context` rows around; spans that meet are one.

    Input (key, row, changed), rows numbered from 0 within a key.
    """
    last = rows.groupBy(*key).agg(F.max("row").alias("last"))
    near = rows.where("changed").select(*key, F.greatest(F.col("row") - context, F.lit(0)).alias("a"), (F.col("row") + context + 1).alias("b"))
    w = Window.partitionBy(*key).orderBy("a")
    begins = near.withColumn("new", F.coalesce((F.col("a") > F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1)))
    spans = begins.withColumn("span", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*key, "span").agg(F.min("a").alias("first"), F.max("b").alias("end"))
    return spans.join(last, key).select(*key, "first", F.least("end", F.col("last") + 1).alias("end"))


def merged(edits: DataFrame, base: str, ours: str, theirs: str) -> DataFrame:
    """edits with `regions`, `n_conflicts` and `merged`: the three-way merge of two edits of one base, line by line.

    merged is null where both sides changed the same or touching lines in unlike ways; a null text is empty.
    """

    def regions(a: str | None, b: str | None, c: str | None) -> list[tuple]:
        return [(n, *r) for n, r in enumerate(alignment.merge(*((t or "").split("\n") for t in (a, b, c))))]

    made = _with_rows(edits, [base, ours, theirs], "regions", _REGION, "region: int, kind: string, base_lines: array<string>, our_lines: array<string>, their_lines: array<string>", regions)
    conflicts = F.size(F.filter("regions", lambda r: r["kind"] == "conflict"))
    taken = F.flatten(F.transform("regions", lambda r: F.when(r["kind"] == "theirs", r["their_lines"]).otherwise(r["our_lines"])))
    return made.withColumn("n_conflicts", conflicts).withColumn("merged", F.when(F.col("n_conflicts") == 0, F.array_join(taken, "\n")))


def conflicts(made: DataFrame, key: list[str]) -> DataFrame:
    """(key, region, base_lines, our_lines, their_lines): a row for each conflict of merged()."""
    each = made.select(*key, F.explode("regions").alias("r")).where("r.kind = 'conflict'")
    return each.select(*key, "r.region", "r.base_lines", "r.our_lines", "r.their_lines")
