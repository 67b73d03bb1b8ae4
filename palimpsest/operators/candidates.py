"""Candidates: what detectors and a model found, one row for each different value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.constants import CATEGORIES


def union(rules: DataFrame, found: DataFrame) -> DataFrame:
    """Rule hits and a model's findings as one list; within a document rules come first."""
    own = rules.withColumn("source", F.lit("rule")).withColumn("source_ord", F.lit(0))
    other = found.withColumn("source", F.lit("llm")).withColumn("source_ord", F.lit(1))
    return own.unionByName(other, allowMissingColumns=True)


def dedup_hits(hits: DataFrame, *scope: str) -> DataFrame:
    """The first hit of each (category, key) in a scope; needs columns key and seq."""
    first = F.min_by(F.struct("value", "seq"), "seq").alias("first")
    return hits.groupBy(*scope, "category", "key").agg(first).select(*scope, "category", "key", "first.value", "first.seq")


def dedup_candidates(rows: DataFrame, *scope: str) -> DataFrame:
    """The first row of each key in a scope, by seq: its category, value and source stand.

    Aggregated before the shuffle, so a value that stands in every document
    sends one row from each task.  ``spellings`` are all its different spellings.
    """
    first = F.min_by(F.struct("category", "value", "source", "seq"), "seq").alias("first")
    out = rows.groupBy(*scope, "key").agg(first, F.sort_array(F.collect_set("value")).alias("spellings"))
    return out.select(*scope, "key", "first.category", "first.value", "first.source", "first.seq", "spellings")


def without_generic(rows: DataFrame, value: str = "value") -> DataFrame:
    return rows.where(~T.is_generic(F.col(value)))


def coerced(rows: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """A model's categories that aren't allowed become OTHER; rules keep theirs."""
    kind = T.coerced_category(F.col("category"), allowed or CATEGORIES)
    return rows.withColumn("category", F.when(F.col("source") == "rule", F.col("category")).otherwise(kind))


def with_aliases(rows: DataFrame, aliases: DataFrame, *scope: str) -> DataFrame:
    """Candidates with the aliases (scope, key, alias) that go by their key; an empty list without any."""
    own = aliases.groupBy(*scope, "key").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
    out = rows.join(own, [*scope, "key"], "left")
    return out.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``seq`` by the given order, within a document; combined with the document's place it's the order of all."""
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))
