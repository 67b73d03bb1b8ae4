"""Nearest neighbours by additive quantisation.

A vector's direction is approximated by a sum of one code word from each of several
codebooks, all of the vector's full dimension.  The books are trained stage by
stage on residuals of a bounded sample, then refined together by least squares.
A beam search picks each vector's code words; its length and what the
approximation lacks are stored with them.  A query's products with all code words are a lookup
table, so that a stored vector's score is a few lookups.  The best by lookup are scored
again on the original vectors, in double precision.

An exact check follows.  A product differs from its lookup by at most the query's length times
the stored error, so the k-th best product found so far rules most rows out, and all
others are scored again, however many they are: rows that the codes can't tell apart
(near copies, more dimensions than the codes have bits for) are all looked at.

The first code word is a vector's inverted list.  How many lists a query looks
into at first is measured on the sample: as many as hold nearly all true neighbours
there.  Vectors that lie in clusters need a few; where there is no structure, so that
this comes to over half of the lists, all are looked into.  Of the other lists those follow
whose middle and radius don't rule out that they hold a nearer vector.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, least


def valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): one row for each key, v an array of floats where it was one, else of doubles.

    Rows take no part whose key or vector is null, or whose vector is empty,
    zero, or holds null or non-finite components; of several rows of one key
    the least vector stands.
    """
    v = F.col("v")
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast(kind).alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("id is not null and v is not null").where(finite & F.exists(v, lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1, and the lengths; squares neither vanish nor overflow."""
    big = np.abs(x).max(1, keepdims=True)
    own = np.linalg.norm(x / big, axis=1)
    return x / big / own[:, None], big[:, 0] * own


class Books:
    """Codebooks (stages, words, dimension) and what a beam search over them needs."""

    def __init__(self, books: np.ndarray):
        self.books = books.astype(np.float32)
        self.norms = np.square(self.books).sum(2)

    def encode(self, x: np.ndarray, beam: int = 8) -> np.ndarray:
        """Code words (n, stages) of the smallest error that the beam finds; what is left of each vector goes along."""
        (m, k, d), n = self.books.shape, len(x)
        rest = x.astype(np.float32)[:, None, :]
        codes = np.zeros((n, 1, 0), np.int64)
        errors = np.square(rest).sum(2)
        for stage, (book, norms) in enumerate(zip(self.books, self.norms, strict=True)):
            flat = (errors[:, :, None] + norms - 2 * (rest.reshape(-1, d) @ book.T).reshape(n, -1, k)).reshape(n, -1)
            width = min(beam if stage < m - 1 else 1, flat.shape[1])
            best = np.argpartition(flat, width - 1, axis=1)[:, :width] if width < flat.shape[1] else np.tile(np.arange(width), (n, 1))
            before, word = best // k, best % k
            errors = np.take_along_axis(flat, best, 1)
            codes = np.concatenate([np.take_along_axis(codes, before[:, :, None], 1), word[:, :, None]], 2)
            rest = np.take_along_axis(rest, before[:, :, None], 1) - book[word]
        return codes[np.arange(n), errors.argmin(1)].astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[j][codes[:, j]] for j in range(len(self.books)))


def train(x: np.ndarray, stages: int = 32, words: int = 64, rounds: int = 6, refine: int = 1, seed: int = 7) -> Books:
    """Codebooks of a sample: k-means of residuals, stage by stage, then least squares over all stages."""
    rng = np.random.default_rng(seed)
    words = min(words, len(x))
    rest, books = x.astype(np.float32).copy(), []
    for _ in range(stages):
        centres = rest[rng.choice(len(rest), words, replace=False)]
        for _ in range(rounds):
            near = (np.square(centres).sum(1)[None] - 2 * rest @ centres.T).argmin(1)
            sums, counts = np.zeros_like(centres), np.bincount(near, minlength=words)
            np.add.at(sums, near, rest)
            filled = counts > 0
            centres[filled] = sums[filled] / counts[filled, None]
            if not filled.all():
                centres[~filled] = rest[rng.choice(len(rest), int((~filled).sum()))]
        near = (np.square(centres).sum(1)[None] - 2 * rest @ centres.T).argmin(1)
        rest -= centres[near]
        books.append(centres)
    found = Books(np.stack(books))
    for _ in range(refine):
        codes = found.encode(x).astype(np.int64) + np.arange(stages) * words
        both = np.zeros((stages * words, stages * words), np.float32)
        for a in range(stages):
            for b in range(stages):
                pairs = np.bincount((codes[:, a] - a * words) * words + codes[:, b] - b * words, minlength=words * words)
                both[a * words : (a + 1) * words, b * words : (b + 1) * words] = pairs.reshape(words, words)
        target = np.zeros((stages * words, x.shape[1]), np.float64)
        for a in range(stages):
            np.add.at(target, codes[:, a], x)
        start = found.books.reshape(stages * words, -1).astype(np.float64)
        ridge = 0.1
        solved = np.linalg.solve(both.astype(np.float64) + ridge * np.eye(len(both)), target + ridge * start)
        found = Books(solved.reshape(stages, words, -1))
    return found


@dataclass
class Index:
    """Codebooks, the middle of each first word's list, and how many lists a query looks into."""

    books: np.ndarray
    middles: np.ndarray
    probes: int


def lists_needed(x: np.ndarray, own: np.ndarray, middles: np.ndarray, k: int = 20, share: float = 0.98, queries: int = 256) -> int:
    """How many lists, by product with their middles, hold ``share`` of the ``k`` nearest of sampled queries; all if over half of them."""
    asked = x[:queries]
    near = asked @ x.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return len(middles)
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(asked @ middles.T), axis=1, kind="stable"), axis=1)
    needed = int(np.quantile(np.take_along_axis(place, own[best], 1), share)) + 1
    return needed if 2 * needed <= len(middles) else len(middles)


def fit(rows: DataFrame, sample: int = 8192, beam: int = 8, **how) -> Index | None:
    """An index from at most ``sample`` vectors, those with the least hash of their key."""
    picked = [r["v"] for r in least(rows, F.xxhash64("id"), sample, "id").select("v").collect()]
    if not picked:
        return None
    size = max(map(len, picked))
    x = np.array([v for v in picked if len(v) == size], dtype=np.float64)
    straight, _ = directions(x)
    books = train(straight, **how)
    own = books.encode(straight, beam)[:, 0].astype(np.int64)
    middles = np.zeros((books.books.shape[1], size))
    np.add.at(middles, own, x)
    middles /= np.maximum(np.bincount(own, minlength=len(middles)), 1)[:, None]
    return Index(books.books, middles, lists_needed(x, own, middles))


def encode(rows: DataFrame, index: Index, beam: int = 8) -> DataFrame:
    """(id, v) to (id, v, codes, list, scale, error, length, far).

    Code words, the first of them, what their sum is multiplied by, how far that is from the
    vector at most (with what lookups lose in single precision), the vector's length, and how far it is from the middle of its list.
    """
    held = rows.sparkSession.sparkContext.broadcast(index)

    def run(frames):
        own, middles = Books(held.value.books), held.value.middles
        (stages, _, d), longest = own.books.shape, np.sqrt(own.norms.astype(np.float64))
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256]
                x = np.stack(part["v"].to_numpy()).astype(np.float64)
                straight, length = directions(x)
                codes = own.encode(straight, beam)
                near = own.decode(codes).astype(np.float64)
                square = np.square(near).sum(1)
                scale = (straight * near).sum(1) / np.where(square > 0, square, 1)
                lost = np.finfo(np.float32).eps * (d + stages + 8) * sum(longest[j][codes[:, j]] for j in range(stages)) * np.abs(scale)
                error = np.linalg.norm(straight - scale[:, None] * near, axis=1) + lost
                far = np.linalg.norm(x - middles[codes[:, 0]], axis=1)
                yield pd.DataFrame({"id": part["id"], "v": part["v"], "codes": [c.tobytes() for c in codes], "list": codes[:, 0].astype(np.int32), "scale": scale * length, "error": error * length, "length": length, "far": far})

    return rows.mapInPandas(run, f"id long, v {rows.schema['v'].dataType.simpleString()}, codes binary, list int, scale double, error double, length double, far double")


def blocks_of(sizes: dict[int, int], block: int) -> dict[int, tuple[int, int]]:
    """(first block, blocks) of each list: a long list has several of its own, short ones share one, of about ``block`` rows each."""
    out, number, filled = {}, 0, 0
    for name, n in sorted(sizes.items()):
        if filled and filled + n > block:
            number, filled = number + 1, 0
        parts = max(1, math.ceil(n / block))
        out[name] = (number, parts)
        number, filled = (number + parts, 0) if parts > 1 else (number, filled + n)
    return out


def lookups(wanted: np.ndarray, books: np.ndarray) -> list[np.ndarray]:
    """Tables of the queries' products with all sums of two code words (of neighbouring books), or of one if their number is odd."""
    each = np.einsum("qd,mkd->mkq", wanted.astype(np.float32), books)
    pairs = [(each[j][:, None] + each[j + 1][None]).reshape(-1, len(wanted)) for j in range(0, len(each) - 1, 2)]
    return pairs + [each[-1]] * (len(each) % 2)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with a vector, each added up from the first component to the last, so that equal rows have equal ones wherever they stand."""
    return (x * q).cumsum(axis=1)[:, -1] + 0.0


def nearest(x: np.ndarray, ids: np.ndarray, near: np.ndarray, above: np.ndarray, q: np.ndarray, floors: np.ndarray, slack: np.ndarray, k: int, rerank: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, products) of the ``k`` rows of the largest products with each query, without those below its floor; ties to the smaller id.

    ``near`` (queries, rows) are the products by lookup, ``above`` what they are at
    most; rows of minus infinity take no part.  The ``rerank`` best by lookup set the floor that other rows must reach.
    ``slack`` is what a query's products may differ by if they are added up in another order.
    """
    n = len(x)
    floors = floors - slack
    for i, row in enumerate(near):
        best = np.argpartition(row, n - rerank)[n - rerank :] if n > rerank else np.arange(n)
        best = best[row[best] > -np.inf]
        if len(best) >= k:
            floors[i] = max(floors[i], np.partition(x[best] @ q[i], len(best) - k)[len(best) - k] - slack[i])
    left = ~(above < floors[:, None]) & (above != -np.inf)
    # A query that has much of the rows left is multiplied with all of them, along with others of its kind.
    many = left.sum(1) > n / 8
    whole = dict(zip(np.flatnonzero(many).tolist(), q[many] @ x.T, strict=True))
    out = []
    for i in range(len(q)):
        at = np.flatnonzero(left[i])
        rough = whole[i][at] if i in whole else x[at] @ q[i]
        if len(at) > k:
            at = at[rough >= np.partition(rough, len(at) - k)[len(at) - k] - 2 * slack[i]]
        score = products(x[at], q[i])
        order = np.lexsort((ids[at], -score))[:k]
        out.append((ids[at][order], score[order]))
    return out


def search(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, rerank: int = 400, block: int = 16384, queries: int = 8192, **how) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of each query.

    Queries are the rows whose key ``every`` divides, candidates are all rows but the
    query's own; nearness is the inner product in double precision on the
    original vectors, ties go to the smaller key.  A query has all candidates
    if there are fewer than ``k``.  See ``valid`` for rows that take no part; a
    vector of another length than most is left out too, as products with it
    aren't defined.  No valid rows give no rows.

    Every row is in the index (32 books of 64 words: 32 bytes of code); the codebooks alone are fitted on a sample
    (``fit``).  Codes and vectors are dealt into blocks by list, queries to the blocks of the
    lists that they look into; a task holds one block (fewer rows, if vectors are long) and at most about ``queries`` queries, and hands on a
    query's best ``k`` of the block in one row.  Such rows are merged 16 at a time.
    """
    rows = cut(valid(vectors, key, vector))
    out = "query_id long, rank int, vec_id long, score double"
    common = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if common is None:
        return rows.sparkSession.createDataFrame([], out)
    rows = rows.where(F.size("v") == common["size"])
    index = fit(rows, **how)
    coded = cut(encode(rows, index))
    # A row for each first word.
    lists = {r["list"]: r for r in coded.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("length").alias("longest")).collect()}
    dealt = blocks_of({name: r["n"] for name, r in lists.items()}, min(block, max(256, 2**22 // common["size"])))
    spark = rows.sparkSession
    where = F.broadcast(spark.createDataFrame([(name, *own) for name, own in dealt.items()], "list int, start int, parts int"))
    coded = coded.join(where, "list").select("id", "v", "codes", "scale", "error", (F.col("start") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("cb"))
    held = spark.sparkContext.broadcast(index)
    starts = np.array([dealt.get(i, (-1, 0)) for i in range(len(index.middles))])
    far, longest = (np.array([lists[i][c] if i in lists else -np.inf for i in range(len(index.middles))]) for c in ("far", "longest"))
    kind = rows.schema["v"].dataType.simpleString()

    def aim(frames):
        """The blocks of the lists that come first; with a floor, of all other lists that may hold what reaches it."""
        middles, probes = held.value.middles, held.value.probes
        for frame in frames:
            if len(frame):
                x = np.stack(frame["v"].to_numpy()).astype(np.float64)
                by_middle = x @ middles.T
                first = [{b for a, n in starts[own] for b in range(a, a + n)} for own in np.argsort(-by_middle, axis=1, kind="stable")[:, :probes]]
                if "floor" in frame:
                    length = directions(x)[1][:, None]
                    most = np.minimum(by_middle + length * far, length * longest) + 1e-9 * length * longest.max()
                    ruled_out = most < frame["floor"].to_numpy()[:, None]
                    first = [{b for a, n in starts[~own] for b in range(a, a + n)} - seen for own, seen in zip(ruled_out, first, strict=True)]
                yield pd.DataFrame({"id": frame["id"], "v": frame["v"], "floor": frame["floor"] if "floor" in frame else -np.inf, "blocks": [sorted(b) for b in first]})

    def scored(names: tuple, codes: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(codes) or not len(wanted):
            return pd.DataFrame({"query_id": [], "cb": [], "ids": [], "scores": []})
        codes = codes.sort_values("id")
        own = held.value.books
        stages, words, _ = own.shape
        at = np.frombuffer(b"".join(codes["codes"]), np.uint8).reshape(-1, stages).astype(np.int32)
        both = [at[:, j] * words + at[:, j + 1] for j in range(0, stages - 1, 2)] + [at[:, -1]] * (stages % 2)
        ids, scale, error = (codes[c].to_numpy() for c in ("id", "scale", "error"))
        x = np.stack(codes["v"].to_numpy()).astype(np.float64)
        slack = 4 * x.shape[1] * np.finfo(np.float64).eps * directions(x)[1].max()
        found = []
        for begin in range(0, len(wanted), 32):
            part = wanted.iloc[begin : begin + 32]
            q = np.stack(part["v"].to_numpy()).astype(np.float64)
            straight, length = directions(q)
            tables = lookups(straight, own)
            total, buffer = tables[0][both[0]], None
            for table, place in zip(tables[1:], both[1:], strict=True):
                buffer = np.take(table, place, axis=0, out=buffer, mode="clip")
                total += buffer
            near = np.ascontiguousarray(total.T) * scale
            above = (near + error) * length[:, None]
            near *= length[:, None]
            place = np.searchsorted(ids, part["id"].to_numpy())
            mine = np.flatnonzero(ids[np.minimum(place, len(ids) - 1)] == part["id"].to_numpy())
            near[mine, place[mine]] = above[mine, place[mine]] = -np.inf
            found += nearest(x, ids, near, above, q, part["floor"].to_numpy(dtype=np.float64), slack * length, k, rerank)
        return pd.DataFrame({"query_id": wanted["id"].tolist(), "cb": int(names[0]), "ids": [i for i, _ in found], "scores": [s for _, s in found]})

    def best_of(asked: DataFrame) -> DataFrame:
        """(query_id, best): a query's ``k`` best of the blocks that it looks into."""
        asked = cut(asked.mapInPandas(aim, f"id long, v {kind}, floor double, blocks array<int>").select("id", "v", "floor", F.explode("blocks").alias("cb")))
        # How many parts the queries of a block are dealt into, and a copy of its rows for each: as few as there is work for all.
        busy = math.ceil(2 * spark.sparkContext.defaultParallelism / max(a + n for a, n in dealt.values()))
        n = F.count("*")
        shares = asked.groupBy("cb").agg(F.greatest(F.ceil(n / queries), F.least(F.ceil(n / 128), F.lit(busy))).cast("int").alias("shares"))
        asked = asked.join(shares, "cb").select("id", "v", "floor", "cb", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("qb"))
        own = coded.join(shares, "cb").select("id", "v", "codes", "scale", "error", "cb", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("qb"))
        near = own.groupBy("cb", "qb").cogroup(asked.groupBy("cb", "qb")).applyInPandas(scored, "query_id long, cb int, ids array<long>, scores array<double>")
        best = near.select("query_id", "cb", F.zip_with("ids", "scores", lambda i, s: F.struct((F.lit(0.0) - s).alias("s"), i.alias("i"))).alias("best"))
        count = max(a + n for a, n in dealt.values())
        while count > 1:
            best, count = best.groupBy("query_id", F.floor(F.col("cb") / 16).cast("int").alias("cb")).agg(top.alias("best")), math.ceil(count / 16)
        return best.select("query_id", "best")

    top = F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k)
    asked = rows.where(F.pmod("id", F.lit(every)) == 0)
    best = best_of(asked)
    if index.probes < len(index.middles):
        best = cut(best)
        floor = F.when(F.size("best") >= k, -F.element_at("best", k)["s"]).otherwise(float("-inf"))
        again = asked.join(best, F.col("id") == F.col("query_id"), "left").select("id", "v", F.coalesce(floor, F.lit(float("-inf"))).alias("floor"))
        best = best.unionByName(best_of(again)).groupBy("query_id").agg(top.alias("best"))
    each = best.select("query_id", F.posexplode("best").alias("at", "own"))
    return each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("own.i").alias("vec_id"), (F.lit(0.0) - F.col("own.s")).alias("score"))
