"""Paragraphs packed into pieces of text for a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_paragraphs(paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first of each different trimmed paragraph of a document, those of one character left out."""
    rows = paragraphs.withColumn("text", F.regexp_replace("text", r"(?U)\A\s+|\s+\z", "")).where("length(text) >= 2")
    return rows.groupBy(key, "text").agg(F.min("para_no").alias("para_no"))


def packed(texts: Column, most: int) -> Column:
    """Texts in order to pieces of at most ``most`` characters, newline-joined; a longer text is cut to that."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), none.alias("open"), F.lit(0).alias("size"))

    def add(s: Column, text: Column) -> Column:
        piece = F.left(text, F.lit(most))
        full = (s["size"] + F.length(piece) > most) & (F.size(s["open"]) > 0)
        done = F.when(full, F.concat(s["done"], F.array(F.array_join(s["open"], "\n")))).otherwise(s["done"])
        open_ = F.when(full, F.array(piece)).otherwise(F.concat(s["open"], F.array(piece)))
        size = F.when(full, F.lit(0)).otherwise(s["size"]) + F.length(piece) + 1
        return F.struct(done.alias("done"), open_.alias("open"), size.alias("size"))

    end = lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(F.array_join(s["open"], "\n")))).otherwise(s["done"])
    return F.aggregate(texts, start, add, end)


def chunks(paragraphs: DataFrame, most: int = 9000, key: str = "doc_id") -> DataFrame:
    """(key, chunk_no, text): a document's unique paragraphs in order, packed greedily."""
    rows = unique_paragraphs(paragraphs, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("para_no", "text"))).alias("p"))
    return rows.select(key, F.posexplode(packed(F.col("p.text"), most)).alias("chunk_no", "text"))


def of_texts(docs: DataFrame, most: int = 9000, key: str = "doc_id", text: str = "text", split_long: bool = False) -> DataFrame:
    """``chunks`` of whole texts, without shuffling their paragraphs.

    A paragraph longer than ``most`` is cut to that, or with ``split_long`` goes on in further pieces, so that nothing is left out.
    """
    trimmed = F.transform(F.split(F.col(text), "\n"), lambda x: F.regexp_replace(x, r"(?U)\A\s+|\s+\z", ""))
    pieces = F.array_distinct(F.filter(trimmed, lambda x: F.length(x) >= 2))
    if split_long:
        pieces = F.flatten(F.transform(pieces, lambda x: F.regexp_extract_all(x, F.lit(f"(?s).{{1,{most}}}"), F.lit(0))))
    return docs.select(key, F.posexplode(packed(pieces, most)).alias("chunk_no", "text"))
