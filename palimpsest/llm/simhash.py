"""SimHash near-duplicate detection by pigeonhole blocks.

Fingerprints of 64 bits are cut into ``radius + 3`` blocks.  Two that differ in
at most ``radius`` bits agree on three blocks at least, so every choice of three
blocks is a table whose key is the bits of those blocks, and each close pair
meets under some key.  Exact copies are one fingerprint before any block is
made, a key's fingerprints are searched in the task that has them, and a task
hands on a spanning star of what it links rather than pairs.

A key with more than ``crowd`` different fingerprints isn't gathered at all.
Its fingerprints meet at every value within 1 bit of the one and ``radius - 1``
bits of the other, so the links there are found exactly with rows in proportion
to the fingerprints.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, fresh
from palimpsest.llm.components import components

BITS = 64


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text, unsigned; see ``fingerprints``."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = (ends - [len(w) + 1 for w in words])[: len(words) - width + 1].tolist()
        stops = (ends - 1)[width - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)]
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    table = (np.arange(256)[:, None] >> np.arange(8)) & 1
    ones = [np.bincount(octets[:, k], minlength=256) @ table for k in range(8)]
    return sum(1 << i for i, n in enumerate(np.concatenate(ones).tolist()) if 2 * n > len(hashes))


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, out: str = "fp") -> DataFrame:
    """``docs`` without ``text``, with its fingerprint as a signed long in ``out``.

    A-Z are lower-cased, words are what white space separates, and every run of
    ``width`` words, repeats included, is hashed with XXH64 (seed 42); a bit is
    one if it's set in over half the hashes.  Shorter texts are one run; a null
    or empty text has fingerprint zero.
    """
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{out}` long"
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            prints = np.array([fingerprint(x, width) for x in texts], dtype=np.uint64).view(np.int64)
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(prints)], names=[*names, out])

    return docs.select(*[F.col(f"`{n}`") for n in [*names, text]]).mapInArrow(run, schema)


def _tables(radius: int, shared: int = 3) -> list[int]:
    """A mask for each choice of ``shared`` of ``radius + shared`` blocks."""
    edges = np.linspace(0, BITS, radius + shared + 1).round().astype(int).tolist()
    blocks = [sum(1 << b for b in range(a, z)) for a, z in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, shared)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _stars(ids: np.ndarray, fps: np.ndarray, radius: int):
    """Edges (id, root) that span the linked sets of one group: at most one for each member."""
    left = np.arange(len(fps))
    while len(left) > 1:
        root, front, left = left[:1], left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for at in range(0, len(front), 256):
                apart = np.bitwise_count(fps[front[at : at + 256], None] ^ fps[None, left])
                near |= (apart <= radius).any(axis=0)
            front, left = left[near], left[~near]
            if len(front):
                yield ids[front], np.repeat(ids[root], len(front))


def _links(radius: int):
    """Sorted (t, key, fp, id) batches to edges; a group may go on in the next batch."""

    def run(batches):
        rest = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            if not len(now[0]):
                continue
            same = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
            first = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            rest = [x[first:] for x in now]
            yield from found([x[:first] for x in now])
        if rest is not None:
            yield from found(rest)

    def found(cols):
        t, key, fp, ident = cols
        if len(t) < 2:
            return
        fp = fp.view(np.uint64) if fp.dtype == np.int64 else fp.astype(np.int64).view(np.uint64)
        begins = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1])])
        sizes = np.diff(np.r_[begins, len(t)])
        us, vs = [], []
        member = np.repeat(sizes, sizes)
        group = np.repeat(np.arange(len(sizes)), sizes)
        for step in range(1, 8):  # small groups together, one distance in the order at a time
            a = np.flatnonzero((member[:-step] <= 8) & (group[:-step] == group[step:])) if len(t) > step else []
            if len(a):
                a = a[np.bitwise_count(fp[a] ^ fp[a + step]) <= radius]
                us.append(ident[a])
                vs.append(ident[a + step])
        for k in np.flatnonzero(sizes > 8):
            part = slice(begins[k], begins[k] + sizes[k])
            for u, v in _stars(ident[part], fp[part], radius):
                us.append(u)
                vs.append(v)
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return run


def _balls(crowded: DataFrame, radius: int) -> DataFrame:
    """Edges among ``crowded`` (fp, id): those that meet within 1 and ``radius - 1`` bits."""

    def masks(most: int) -> list[int]:
        return [_signed(sum(1 << b for b in c)) for n in range(most + 1) for c in combinations(range(BITS), n)]

    def ball(most: int) -> DataFrame:
        near = F.explode(F.transform(F.lit(masks(most)), lambda m: F.col("fp").bitwiseXOR(m)))
        return crowded.select("id", near.alias("at"))

    small = min(1, radius)
    hubs = ball(small).groupBy("at").agg(F.min("id").alias("v"))
    return ball(radius - small).join(hubs, "at").select(F.col("id").alias("u"), "v").where("u <> v").distinct()


def links(prints: DataFrame, radius: int = 3, crowd: int = 4096) -> DataFrame:
    """(fp, id), one row for each fingerprint, to edges (u, v) of ids.

    The edges join exactly the fingerprints that chains of differences of at
    most ``radius`` bits join; not every close pair has an edge of its own.
    """
    masks = _tables(radius)
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    rows = prints.select(F.explode(keys).alias("k"), "fp", "id").select("k.t", "k.key", "fp", "id")
    crowds = cut(rows.groupBy("t", "key").count().where(F.col("count") > crowd).select("t", "key"))
    edges = None
    if not crowds.isEmpty():
        crowded = cut(rows.join(crowds, ["t", "key"], "left_semi").select("fp", "id").distinct())
        edges = _balls(crowded, radius)
        rows = rows.join(crowds, ["t", "key"], "left_anti")
    dealt = rows.repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    near = dealt.mapInArrow(_links(radius), "u long, v long")
    return near if edges is None else near.unionByName(edges)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 3, crowd: int = 4096) -> DataFrame:
    """(key, fp, component) for each row of ``docs``.

    component is the smallest key that chains of fingerprints differing in at
    most ``radius`` bits reach.  Rows whose key is null have a fingerprint, link
    nothing, and have a null component.  Rows of one key may differ; each has
    its own fingerprint, and both then link.  Other columns of ``docs`` don't
    matter.  No rows give no rows.
    """
    rows = cut(fingerprints(docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))))
    known = rows.where("id is not null")
    prints = cut(known.groupBy("fp").agg(F.min("id").alias("id")))
    again = known.groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("id")
    edges = links(prints, radius, crowd)
    # Rows of one key with different texts link their fingerprints.
    twice = known.join(again, "id", "left_semi").join(prints.withColumnRenamed("id", "v"), "fp").select(F.col("id").alias("u"), "v")
    found = components(edges.unionByName(twice))
    classes = prints.join(found.withColumnRenamed("node", "id"), "id", "left").select("fp", F.coalesce("component", "id").alias("component"))
    out = rows.join(classes, "fp", "left")
    return out.select(F.col("id").alias(key), "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """The row of the smallest key of each component, with all its columns.

    Rows whose key is null are kept, since nothing tells them apart.  Of several
    rows of the kept key one stays, the smallest by text.
    """
    found = near_duplicates(docs, key, text, radius)
    one, null = fresh(docs, "kept"), F.col(f"`{key}`").isNull()
    kept = found.where("component is not null").groupBy(F.col("component").alias(one)).agg(F.count(F.when(F.col(key) == F.col("component"), 1)).alias("n"))
    kept = cut(kept)
    same = F.col(f"`{key}`") == F.col(one)
    stay = docs.where(~null).join(kept.where("n = 1"), same, "left_semi")
    if not (more := kept.where("n > 1")).isEmpty():
        rows = docs.where(~null).join(more, same, "left_semi")
        order = Window.partitionBy(F.col(f"`{key}`")).orderBy(F.col(f"`{text}`").asc_nulls_first())
        rank = fresh(docs, "rank")
        stay = stay.unionByName(rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(rank))
    return stay.unionByName(docs.where(null))
