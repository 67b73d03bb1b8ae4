"""Toxicity by non-negative positive-unlabelled learning.

Known toxic texts are the positives; everything else that isn't held out is
unlabelled, toxic or not.  A linear model of which words a text has is
fitted to minimise the class-prior-corrected risk, whose negative part is kept
from falling below zero.  The words are those that positives have markedly more
often than unlabelled text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cleared, cut, least

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    """The distinct words of letters, lower-cased; null has none."""
    return set(_WORD.findall((text or "").lower()))


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 5 == 0


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        get = self.weights.get
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(get(w, 0.0) for w in words(text)), -30, 30))))


def nn_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model by the non-negative risk estimate (Adam, full batches).

    When the negative part of the risk falls below zero its gradient is turned
    round, as it's then fitted too closely.
    """
    w, b = np.zeros(positive.shape[1]), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        narrow = w.astype(positive.dtype)  # as the matrices are, which would be widened in every step otherwise
        zp, zu = positive @ narrow + b, unlabelled @ narrow + b
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up, gp = -sigmoid(-zp) * prior / len(zp), sigmoid(zp) * prior / len(zp)
        gu = sigmoid(zu) / len(zu)
        if negative >= 0:
            gp, gu = up - gp, gu
        else:
            gu = -gu
        slope = gp.astype(positive.dtype) @ positive + gu.astype(positive.dtype) @ unlabelled
        grad = np.r_[slope + decay * w, gp.sum() + gu.sum()]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def cut_off(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """Where to cut the sums of a model: at the greatest F1 that can be told from positives and unlabelled text.

    Recall is read off the positives; precision is prior x recall over the share
    of unlabelled text above the cut.  Cuts that put more than twice the prior
    of it above are out of the question; if all do, nothing is above.  The cut is halfway down to the
    next sum.
    """
    every = np.unique(np.concatenate([positive, unlabelled]))
    recall = 1 - np.searchsorted(np.sort(positive), every) / len(positive)
    above = 1 - np.searchsorted(np.sort(unlabelled), every) / len(unlabelled)
    f1 = np.where(above <= 2 * prior, 2 * prior * recall / (prior + above), -1.0)
    best = int(np.argmax(f1))
    if f1[best] < 0:
        return float(every[-1] + 1)
    return float((every[best] + every[best - 1]) / 2) if best else float(every[0] - 1)


def _picked(rows: DataFrame, most: int) -> DataFrame:
    """(key, h) of at most ``most`` different texts, those with the least hash."""
    return least(rows.groupBy("h").agg(F.min("key").alias("key")), F.col("h"), most)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", positives: int = 4000, unlabelled: int = 16000, features: int = 512, lift: float = 2.5, rarest: int = 3) -> Model:
    """A model from at most ``positives`` toxic and ``unlabelled`` other different texts that aren't held out.

    The sample is bounded, so that the driver and one task can hold what the fit
    needs: which of at most ``features`` words each sampled text has.  The class
    prior is the share of toxic among the labels that aren't held out, taken as at least 0.001 and at most 0.5 (0.1
    without any).  Without positives every score is the prior.  The bias is set so that
    0.5 is where F1 is best, as far as positives and unlabelled text can tell.
    Rows with a null key take no part; of the rows of a repeated key the least text does,
    and a key that any label calls toxic is toxic.
    """
    ident = F.col(f"`{key}`")
    # Two numbers a row are written, so that the texts aren't read again for each count and pick.
    rows = cut(docs.where(ident.isNotNull() & ~held_out(ident)).select(ident.alias("key"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("h")))
    known = labels.where(ident.isNotNull() & ~held_out(ident) & F.col(f"`{toxic}`").isNotNull()).groupBy(ident.alias("key")).agg(F.max(F.col(f"`{toxic}`").cast("int")).alias("y"))
    counts = known.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
    prior = min(max((counts["p"] or 0) / counts["n"], 1e-3), 0.5) if counts["n"] else 0.1
    flat = Model({}, float(np.log(prior / (1 - prior))))
    if not counts["p"]:
        return flat
    yes = _picked(rows.join(known.where("y = 1"), "key", "left_semi"), positives).withColumn("y", F.lit(1))
    other = _picked(rows, unlabelled).withColumn("y", F.lit(0))
    chosen = cut(yes.unionByName(other))  # at most positives + unlabelled rows
    body = docs.select(ident.alias("key"), F.col(f"`{text}`").alias("text"))
    # Of the rows of a repeated key the least text stands, so that reruns agree.
    body = body.join(F.broadcast(chosen.select("key").distinct()), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    kind = docs.schema[key].dataType.simpleString()

    def spread(batches):
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sorted(words(x))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(own), batch.column(0).type), pa.array(own, pa.string())], names=["key", "word"])

    pairs = body.select("key", "text").mapInArrow(spread, f"key {kind}, word string").join(F.broadcast(chosen.select("key", "y")), "key")
    pairs = cut(pairs.coalesce(16))  # the words of a bounded sample: few files, however many partitions the documents have
    sizes = {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    np_, nu = sizes.get(1, 0), sizes.get(0, 0)
    if not np_ or not nu:
        return flat
    found = pairs.groupBy("word").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("u")).where(F.col("p") >= rarest)
    found = found.withColumn("lift", F.col("p") / np_ / ((F.col("u") + 1) / nu)).where(F.col("lift") >= lift)
    found = found.withColumn("gain", F.col("p") * F.log("lift")).orderBy(F.desc("gain"), "word").limit(features)
    vocabulary = [r["word"] for r in found.collect()]
    if not vocabulary:
        return flat
    at = {w: i for i, w in enumerate(vocabulary)}
    has = pairs.where(F.col("word").isin(vocabulary)).groupBy("key", "y").agg(F.collect_list("word").alias("words"))
    xp, xu = np.zeros((np_, len(at)), np.float32), np.zeros((nu, len(at)), np.float32)
    rest = {1: iter(range(np_)), 0: iter(range(nu))}
    for r in has.collect():
        (xp if r["y"] else xu)[next(rest[r["y"]]), [at[w] for w in r["words"]]] = 1
    w, b = nn_pu(xp, xu, prior)
    b -= cut_off(xp @ w + b, xu @ w + b, prior)
    return Model(dict(zip(vocabulary, w.tolist(), strict=True)), b)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``, from 0 to 1, higher for toxic; null and empty texts score by the bias alone.

    Each text is read whole.  Rows stand for themselves.  A column of ``docs``
    named ``out`` is replaced.
    """
    docs = cleared(docs, [out], text)
    weights, bias = model.weights, model.bias
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        own = Model(weights, bias)
        for batch in batches:
            scores = [own.score(x) for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, f"{fields}, `{out}` double")
