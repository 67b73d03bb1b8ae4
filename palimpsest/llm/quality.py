"""Quality by importance resampling.

Two generative models over hashed words and pairs of words, one of the target
text and one of all text, give each document a log ratio: the sum over all its words and pairs.  Adding seeded Gumbel
noise to it and keeping the top k samples documents without replacement in
proportion to the ratio.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, least

BUCKETS = 10_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def buckets(text: str | None, size: int = BUCKETS) -> np.ndarray:
    """The bucket of each word and of each pair of neighbours of a lower-cased text."""
    tokens = _TOKEN.findall((text or "").lower())
    if not tokens:
        return np.zeros(0, np.int64)
    one = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ one[1:]
    two ^= two >> np.uint64(29)
    return (np.concatenate([one, two]) % np.uint64(size)).astype(np.int64)


def fit(docs: DataFrame, target: str, text: str = "text", size: int = BUCKETS) -> np.ndarray:
    """Log ratios of the buckets: target rows (the boolean column ``target``) against all rows, both smoothed.

    Counts cover every row and whole texts; what is collected is two numbers a bucket.
    """

    def run(batches):
        counts = np.zeros((2, size), np.int64)
        for batch in batches:
            for body, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.bincount(buckets(body, size), minlength=size)
                counts[0] += own
                if good:
                    counts[1] += own
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(counts[0]), pa.array(counts[1])], names=["bucket", "n", "good"])

    rows = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{target}`").alias("good")).mapInArrow(run, "bucket long, n long, good long")
    counts = np.zeros((2, size))
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).collect():  # one row for each bucket
        counts[:, r["bucket"]] = r["n"], r["good"]
    share = (counts + 1) / (counts + 1).sum(axis=1, keepdims=True)
    return np.log(share[1]) - np.log(share[0])


def resample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", good: str = "quality", share: float = 0.5, seed: int = 23, size: int = BUCKETS, targets: int = 20_000) -> DataFrame:
    """(key, log_weight, draw, selected) for each row of ``docs``.

    The target model is of rows whose label ``good`` is 1, at most ``targets``
    keys of them, those with the least hash, so that the keys can be broadcast and no text is
    shuffled to find them.  The raw model counts every row.
    log_weight is the sum of the log ratios of a text's buckets, so the log
    ratio of what the two models give the whole text; 0 for null and empty
    texts and without any target.  draw adds Gumbel noise from a hash of seed,
    key and text.  selected marks the ``share`` of rows with the greatest draws,
    exactly ceil(share x rows) of them but for rows of equal draw (repeated
    rows), which are all in or all out.  The threshold is found by counting
    ranges of the draw, then sorting only the range that holds it.
    """
    ident = F.col(f"`{key}`")
    chosen = labels.where(F.col(f"`{good}`") == 1).select(ident.alias("k")).where("k is not null").distinct()
    chosen = cut(least(chosen, F.xxhash64(F.lit(seed), "k"), targets, "k"))
    rows = docs.select(ident.alias("key"), F.col(f"`{text}`").alias("text"))
    marked = rows.join(F.broadcast(chosen), F.col("key") == F.col("k"), "left").select("key", "text", F.col("k").isNotNull().alias("good"))
    ratios = fit(marked, "good", "text", size)
    held = docs.sparkSession.sparkContext.broadcast(ratios)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        own = held.value
        for batch in batches:
            weights = []
            for body in batch.column(1).to_pylist():
                b = buckets(body, size)
                weights.append(float(own[b].sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(weights, pa.float64())], names=["key", "u", "log_weight"])

    drawn = F.xxhash64(F.lit(seed), F.coalesce(F.col("key").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit("")))
    out = rows.select("key", "text", (F.shiftrightunsigned(drawn, 11).cast("double") + 0.5).alias("u"))
    out = out.withColumn("u", F.col("u") / float(1 << 53)).mapInArrow(run, f"key {kind}, u double, log_weight double")
    out = cut(out.withColumn("draw", F.col("log_weight") - F.log(-F.log("u"))).drop("u"))
    edge = threshold(out, "draw", share)
    return out.select(F.col("key").alias(key), "log_weight", "draw", (F.col("draw") >= F.lit(edge)).alias("selected"))


def threshold(rows: DataFrame, column: str, share: float, width: int = 4096) -> float:
    """The k-th greatest value, k = ceil(share x rows), by counting ``width`` ranges until one is small enough to sort."""
    total, low, high = rows.agg(F.count(column), F.min(column), F.max(column)).first()
    k = math.ceil(share * (total or 0))
    if not k:
        return math.inf
    value, inside = F.col(column), F.lit(True)
    while True:
        step = (high - low) / width
        place = F.least(F.floor((value - low) / step), F.lit(width - 1)) if step > 0 else F.lit(0)
        ranges = sorted(((r["p"], r["n"], r["a"], r["b"]) for r in rows.where(inside).groupBy(place.alias("p")).agg(F.count("*").alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).collect()), reverse=True)
        for _, n, a, b in ranges:  # noqa: B007
            if k <= n:
                break
            k -= n
        if a == b:
            return a
        inside, low, high = (value >= a) & (value <= b), a, b
        if n <= 10_000:
            return sorted((r[0] for r in rows.where(inside).select(column).collect()), reverse=True)[k - 1]
