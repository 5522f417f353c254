"""Text search without an index: fuzzy names, token search, phrases with snippets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import contains_literal, trigram_similarity


def fuzzy_names(df: DataFrame, name: str, term: str, threshold: float = 0.3) -> DataFrame:
    """Rows whose name is similar to the term or holds it, with `similarity`."""
    sim = F.round(trigram_similarity(F.col(name), F.lit(term)), 6)
    return df.withColumn("similarity", sim).where((F.col("similarity") >= threshold) | contains_literal(F.col(name), term))


def wildcard_like(c: Column, term: str) -> Column:
    """Case-insensitive match anywhere in which % and _ of the term are live wildcards."""
    return F.ilike(c, F.lit(f"%{term}%"))


def media_names(df: DataFrame, name: str, term: str, limit: int = 20, threshold: float = 0.3) -> DataFrame:
    """Rows whose name is similar to the term or matches it as a live pattern, the most similar first, then by name."""
    sim = F.round(trigram_similarity(F.col(name), F.lit(term)), 6)
    found = df.withColumn("similarity", sim).where((F.col("similarity") >= threshold) | wildcard_like(F.col(name), term))
    return found.orderBy(F.desc("similarity"), F.asc(name)).limit(min(limit, 100))


def name_or_text(df: DataFrame, name: str, text: str, term: str, limit: int, tie: str, threshold: float = 0.3) -> DataFrame:
    """Rows similar by name or with all tokens of the term in their text, in one list by similarity of the name."""
    sim = F.round(trigram_similarity(F.col(name), F.lit(term)), 6)
    found = df.withColumn("similarity", sim).where((F.col("similarity") >= threshold) | has_all(F.col(text), term))
    return found.orderBy(F.desc_nulls_last("similarity"), F.asc(tie)).limit(limit)


def suggestions(df: DataFrame, name: str, term: str, limit: int, *ties: Column) -> DataFrame:
    """Rows whose name holds the term, the most similar first; without a term all by name, case aside."""
    term = term.strip()
    order = [F.lower(name).asc_nulls_last(), *ties]
    if not term:
        return df.orderBy(*order).limit(limit)
    return df.where(contains_literal(F.col(name), term)).orderBy(F.round(trigram_similarity(F.col(name), F.lit(term)), 6).desc_nulls_last(), *order).limit(limit)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""))


def has_all(text: Column, query: str) -> Column:
    """All tokens of the query are tokens of the text; a query without tokens matches nothing."""
    wanted = sorted(set(re.findall("[a-z0-9]+", query.lower())))
    if not wanted:
        return F.lit(False)
    return F.size(F.array_intersect(tokens(text), F.array(*map(F.lit, wanted)))) == len(wanted)


def snippet(text: Column, phrase: str, around: int = 60) -> Column:
    """The first occurrence of a phrase, case aside, with so many characters around it and ellipses where cut; null if none."""
    at = F.locate(phrase.lower(), F.lower(text))
    start = F.greatest(at - around, F.lit(1))
    end = F.least(at + len(phrase) + around, F.length(text) + 1)
    cut = F.concat(F.when(start > 1, "…").otherwise(""), F.substr(text, start, end - start), F.when(end <= F.length(text), "…").otherwise(""))
    return F.when(at > 0, cut)


def highlight(text: Column, query: str, around: int = 60) -> Column:
    """A snippet around the first token of the query that occurs, each token between [[ and ]]."""
    wanted = sorted(set(re.findall("[a-z0-9]+", query.lower())))
    first = F.coalesce(*[snippet(text, w, around) for w in wanted])
    return F.regexp_replace(first, f"(?i)\\b({'|'.join(wanted)})\\b", "[[$1]]")
