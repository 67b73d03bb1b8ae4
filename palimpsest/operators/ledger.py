"""The ledger of entities that a reviewer sees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filtered(entities: DataFrame, query: str = "", document: str | None = None) -> DataFrame:
    """Entities whose value, category or a variant contains the query, in a document if one is named."""
    needle = query.strip().lower()
    found = F.lower("value").contains(needle) | F.lower("category").contains(needle) | F.exists("variants", lambda v: F.lower(v).contains(needle))
    rows = entities.where(found) if needle else entities
    return rows.where(F.coalesce(F.try_element_at("occurrences", F.lit(document)), F.lit(0)) > 0) if document else rows


def groups(entities: DataFrame) -> DataFrame:
    """(category, size, selected, place): a row for each category, the largest first; ``page`` lists its entities."""
    rows = entities.groupBy("category").agg(F.count("*").alias("size"), F.count_if("selected").alias("selected"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("size"), "category")))


def page(entities: DataFrame, category: str, size: int = 50, number: int = 0) -> DataFrame:
    """One page of a category's entities, in review order."""
    return entities.where(F.col("category") == category).orderBy(F.desc("total"), "value").offset(size * number).limit(size)


def totals(entities: DataFrame) -> DataFrame:
    """One row: entities, how many are selected, their hits, and all hits."""
    return entities.agg(F.count("*").alias("entities"), F.count_if("selected").alias("selected"), F.sum(F.when(F.col("selected"), F.col("total"))).alias("selected_hits"), F.sum("total").alias("hits"))


def rollup(occurrences: DataFrame) -> DataFrame:
    """Hits by category and document, by category, and in all."""
    return occurrences.rollup("category", "doc_id").agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
