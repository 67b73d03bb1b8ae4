"""Matches over text that is split into leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def offsets(leaves: DataFrame, *keys: str) -> DataFrame:
    """Leaves (keys, leaf_no, text) with ``start`` and ``end`` of each in the joined text."""
    order = Window.partitionBy(*keys).orderBy("leaf_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text")).over(order), F.lit(0))
    return leaves.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))


def located(matches: DataFrame, placed: DataFrame, *keys: str) -> DataFrame:
    """Matches (keys, at) with the leaf they start in and the offset there; an equi-join on the paragraph."""
    both = matches.join(placed.where("end > start"), list(keys)).where("start <= at and at < end")
    return both.select(*keys, "at", "leaf_no", (F.col("at") - F.col("start")).alias("offset"))


def write_back(texts: list[str], spans: list[tuple[int, int, str]]) -> list[str]:
    """The leaves after replacing spans (start, end, new) of their joined text, in order and apart.

    What is new lands in the leaf where its span starts; covered text goes; the
    rest stays in the leaf that has it.
    """
    out, at, begin = [], 0, 0
    for text in texts:
        end, piece, here = begin + len(text), [], begin
        while at < len(spans) and spans[at][0] < end:
            start, stop, new = spans[at]
            if start >= begin:
                piece += [text[here - begin : start - begin], new]
            here = min(stop, end)
            if stop > end:
                break
            at += 1
        piece.append(text[here - begin :])
        out.append("".join(piece))
        begin = end
    return out
