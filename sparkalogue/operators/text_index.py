"""Full-text search over a stored positional inverted index.

build() writes a row for each word and place; every task sorts its own documents' rows by word, so
nothing is shuffled, and a search reads of each file only the pages of its words. Beside it stands
the vocabulary with the stem of each different word; no text is read again by a search
but for snippets. A query is a list of terms; under the plain configuration a term stands for
itself, under the English one for all words of its stem, and stop words are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stemmer import STOP, stem
from .stored import new_path, stored, write_sorted

#: A word of a text and of a query.
WORD = "[\\p{L}\\p{N}]+"
#: Columns of the postings.
POSTING = "word string, id long, pos int"
#: Weight of a place, places beyond which nearness counts for nothing, and the sum of 1 / n**2.
PLACE_WEIGHT, FAR, BASEL = 0.1, 100, 1.64493406685
#: Words of a snippet.
SNIPPET_WORDS = 25


@dataclass
class TextIndex:
    """postings: (word, id, pos), each file sorted by word; vocabulary: (word, stem), by stem."""

    path: str

    def postings(self, spark: SparkSession, words: list[str]) -> DataFrame:
        """Rows of some words; the scan is told which, and passes over all other pages."""
        return spark.read.schema(POSTING).parquet(f"{self.path}/postings").where(F.col("word").isin(words))

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("word string, stem string").parquet(f"{self.path}/vocabulary")


def words(text: Column) -> Column:
    """Runs of letters and digits as they stand in the text; null for null."""
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)


def build(docs: DataFrame, key: str, text: str, path: str | None = None, stems: bool = True) -> TextIndex:
    """Index of the words of a text column, lower-cased; places count from 0. Null and empty texts have no rows.

    Without `stems` the vocabulary is left out, and searches by stem with it.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "text-index")
    each = docs.select(F.col(key).cast("long").alias("id"), F.posexplode(words(F.lower(text))).alias("pos", "word"))
    write_sorted(each.select("word", "id", "pos"), ["word", "id", "pos"], f"{path}/postings")
    if stems:

        def stemmed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(stem=batch["word"].map(stem))

        different = spark.read.schema(POSTING).parquet(f"{path}/postings").select("word").distinct()
        write_sorted(different.mapInPandas(stemmed, "word string, stem string").repartitionByRange("stem"), ["stem"], f"{path}/vocabulary")
    return TextIndex(path)


def terms(query: str, english: bool = False) -> list[str]:
    """Different words of a query in order; stems without stop words under the English configuration."""
    found = [w for w in re.findall(r"[^\W_]+", query.lower())]
    return list(dict.fromkeys(stem(w) for w in found if w not in STOP)) if english else list(dict.fromkeys(found))


def hits(spark: SparkSession, index: TextIndex, query: str, english: bool = False) -> DataFrame:
    """(id, term, pos): places of the query's terms in documents that hold all of them; term is a number from 0."""
    wanted = terms(query, english)
    schema = "id long, term int, pos int"
    if not wanted:
        return spark.createDataFrame([], schema)
    if english:
        of = [(r["word"], wanted.index(r["stem"])) for r in index.vocabulary(spark).where(F.col("stem").isin(wanted)).collect()]  # the words of a few stems
    else:
        of = [(w, n) for n, w in enumerate(wanted)]
    if not of:
        return spark.createDataFrame([], schema)
    named = F.create_map(*[F.lit(x) for pair in of for x in pair])
    found = index.postings(spark, [w for w, _ in of]).select("id", F.element_at(named, F.col("word")).alias("term"), "pos")
    if len(wanted) == 1:
        return found
    whole = found.groupBy("id").agg(F.countDistinct("term").alias("n")).where(F.col("n") == len(wanted)).select("id")
    return found.join(whole, "id", "left_semi")


def rank_pairs(found: DataFrame, n_terms: int) -> DataFrame:
    """(id, rank) of hits(): how near the terms stand to each other; for one term how often it stands there.

    With several terms, each pair of places of different terms up to FAR words apart counts
    c = weight / sqrt(1.005 + 0.05 exp(distance / 1.5 - 2)), and rank is 1 less the product of 1 - c.
    With one, the n-th place counts weight / n**2, over the sum of 1 / n**2.
    """
    if n_terms < 2:
        numbered = found.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("pos")).cast("double"))
        return numbered.groupBy("id").agg((F.sum(PLACE_WEIGHT / (F.col("n") * F.col("n"))) / BASEL).alias("rank"))
    # places meet within stretches of FAR words and the stretch after: an equality, so no document is one group
    stretch = F.floor(F.col("pos") / FAR)
    left = found.select("id", F.col("term").alias("term_a"), F.col("pos").alias("a"), F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch"))
    right = found.select("id", F.col("term").alias("term_b"), F.col("pos").alias("b"), stretch.alias("stretch"))
    near = left.join(right, ["id", "stretch"]).where("term_a < term_b").withColumn("d", F.abs(F.col("a") - F.col("b"))).where(f"d <= {FAR}")
    c = PLACE_WEIGHT * F.sqrt(1 / (1.005 + 0.05 * F.exp(F.col("d") / 1.5 - 2)))
    ranked = near.groupBy("id").agg((1 - F.exp(F.sum(F.log1p(-c)))).alias("near"))
    return found.select("id").distinct().join(ranked, "id", "left").select("id", F.coalesce("near", F.lit(1e-20)).alias("rank"))


def covers(found: DataFrame, n_terms: int) -> DataFrame:
    """(id, first, last, inside): the smallest stretches that hold all terms, none within another; inside counts the hits in them."""
    by_place = Window.partitionBy("id").orderBy("pos", "term").rowsBetween(Window.unboundedPreceding, 0)
    names = [f"latest{t}" for t in range(n_terms)]
    latest = [F.last(F.when(F.col("term") == t, F.col("pos")), ignorenulls=True).over(by_place).alias(name) for t, name in enumerate(names)]
    ends = found.select("id", "pos", F.count("*").over(by_place).alias("at"), *latest).where(" and ".join(f"{name} is not null" for name in names))
    ends = ends.withColumn("first", F.least(*names) if n_terms > 1 else F.col(names[0]))
    # of the stretches with one start the one that ends first counts; a later start never ends earlier
    least = ends.groupBy("id", "first").agg(F.min("pos").alias("last"), F.min("at").alias("upto"))
    starts = found.withColumn("at", F.count("*").over(by_place)).groupBy("id", F.col("pos").alias("first")).agg(F.min("at").alias("since"))
    return least.join(starts, ["id", "first"]).select("id", "first", "last", (F.col("upto") - F.col("since") + 1).alias("inside"))


def rank_covers(found: DataFrame, n_terms: int) -> DataFrame:
    """(id, rank) of hits(): cover density, each smallest stretch with all terms counting weight / (1 + other words in it)."""
    noise = F.col("last") - F.col("first") - (F.col("inside") - 1)
    return covers(found, n_terms).groupBy("id").agg(F.sum(PLACE_WEIGHT / (1 + F.greatest(noise, F.lit(0)))).alias("rank"))


def snippets(docs: DataFrame, key: str, text: str, found: DataFrame, n_terms: int, most: int = SNIPPET_WORDS) -> DataFrame:
    """(id, snippet): the words around each document's first shortest cover, hits between [[ and ]].

    The stretch is widened on both sides to `most` words; a longer cover is cut there.
    """
    best = covers(found, n_terms).groupBy("id").agg(F.min(F.struct((F.col("last") - F.col("first")).alias("width"), "first", "last")).alias("c")).select("id", "c.first", "c.last")
    begin = F.greatest(F.col("first") - F.floor(F.greatest(F.lit(0), most - (F.col("last") - F.col("first") + 1)) / 2), F.lit(0)).cast("int")
    placed = best.withColumn("begin", begin)
    marked = placed.join(found, "id").where(f"pos >= begin and pos < begin + {most}").groupBy("id", "begin").agg(F.collect_set("pos").alias("marked"))
    body = docs.select(F.col(key).cast("long").alias("id"), words(F.col(text)).alias("w")).join(marked, "id")
    part = F.slice("w", F.col("begin") + 1, F.lit(most))
    shown = F.transform(part, lambda w, i: F.when(F.array_contains("marked", F.col("begin") + i), F.concat(F.lit("[["), w, F.lit("]]"))).otherwise(w))
    return body.select("id", F.array_join(shown, " ").alias("snippet"))


def search(docs: DataFrame, key: str, text: str, query: str, index: TextIndex, limit: int | None = None) -> DataFrame:
    """(id, rank, snippet): documents with all words of the query, plainly or by their stems, by the sum of both ranks.

    The snippet is the plain one where the words stand plainly. A quoted query is an exact substring, case aside, of rank 1 with 60 characters around it.
    """
    from ..functions.scalars import contains_literal
    from .search import snippet

    spark, asked = docs.sparkSession, query.strip()
    if not terms(asked):
        return spark.createDataFrame([], "id long, rank double, snippet string")
    if len(asked) > 2 and asked[0] == asked[-1] == '"':
        needle = asked[1:-1]
        rows = docs.where(contains_literal(F.col(text), needle)).select(F.col(key).cast("long").alias("id"), F.lit(1.0).alias("rank"), snippet(F.col(text), needle).alias("snippet"))
    else:
        n = [len(terms(asked, e)) for e in (False, True)]
        # ranks, covers and snippets read the hits some six times
        plain, by_stem = (stored(hits(spark, index, asked, e), "text-hits") if n[e] else None for e in (False, True))
        ranks = rank_pairs(plain, n[0]).union(rank_pairs(by_stem, n[1])) if n[1] else rank_pairs(plain, n[0])
        cut = snippets(docs, key, text, plain, n[0]).withColumn("side", F.lit(0))
        if n[1]:
            cut = cut.union(snippets(docs, key, text, by_stem, n[1]).withColumn("side", F.lit(1)))
        shown = cut.groupBy("id").agg(F.min_by("snippet", "side").alias("snippet"))
        rows = ranks.groupBy("id").agg(F.sum("rank").alias("rank")).join(shown, "id", "left")
    ordered = rows.select("id", F.round("rank", 6).alias("rank"), "snippet")
    return ordered.orderBy(F.desc("rank"), "id").limit(limit) if limit else ordered
