"""Exact substring deduplication by seed and extend.

Seeds are winnowed anchors: of the ``window - gram + 1`` grams in a window the one with
the least hash, leftmost first, so that equal windows have equal anchors at equal
places and each window belongs to one anchor.  A text is read once: an
occurrence of an anchor goes out with hashes of all windows that belong to it, which is as far as
the match can be extended both ways around it.  Occurrences of one anchor meet,
and adjoining windows that an earlier place has too are one repeat, as long as it goes.

An anchor with more than about ``crowd`` occurrences is dealt over several tasks by
document.  What is first of its kind within such a share meets the first ones
of the other shares in a second, far smaller round, which is dealt by window.
Which anchors these are is estimated beforehand on some documents; the estimate
decides where work is done, never what is found.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from palimpsest.llm.common import cut

GRAM = 5
#: Words that are hashed together, and anchors at most that are dealt over several tasks: any other has less than a ten-thousandth of all occurrences.
WORDS, HOT = 400_000, 10_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _runs(x: np.ndarray, n: int, by: np.uint64) -> np.ndarray:
    """A hash of each n consecutive values."""
    out = np.zeros(len(x) - n + 1, np.uint64)
    for k in range(n):
        out = out * by + x[k : k + len(out)]
    return _mixed(out)


def _packed(high: str, low: str) -> Column:
    """Two numbers below 2**31 as one long: a quarter of a struct's size in an array."""
    return F.shiftleft(F.col(high).cast("long"), 32) + F.col(low)


def _unpacked(longs) -> tuple[np.ndarray, np.ndarray]:
    both = np.array(longs, np.int64)
    return both >> 32, both & 0xFFFFFFFF


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def occurrences(texts: list[bytes | None], window: int, gram: int = GRAM):
    """(text, anchor, first window, number of windows) of each occurrence, in order, and the hashes of all windows in their order.

    Arrays; ``text`` and the first window's place count from 0.
    """
    words = list(map(_words, texts))
    sizes = np.array(list(map(len, words)), np.int64)
    x = np.fromiter((xxhash.xxh64_intdigest(w) for own in words for w in own), np.uint64, int(sizes.sum()))
    if len(x) < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    grams, n = _runs(x, gram, _A), len(x) - window + 1
    best, owner = grams[:n].copy(), np.arange(n)
    for k in range(1, window - gram + 1):
        less = np.flatnonzero(grams[k : k + n] < best)
        best[less] = grams[k + less]
        owner[less] = k + less
    text = np.repeat(np.arange(len(texts)), sizes)[:n]
    starts = np.cumsum(sizes) - sizes
    place = np.arange(n) - starts[text]
    inside = np.flatnonzero(place + window <= sizes[text])  # windows that don't run on into the next text
    text, place, owner = text[inside], place[inside], owner[inside]
    if not len(inside):
        return text, text, text, text, text
    begin = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])])
    return text[begin], grams[owner[begin]].view(np.int64), place[begin], np.diff(np.r_[begin, len(inside)]), _runs(x, window, _B)[inside].view(np.int64)


def _portions(batches):
    """(uids, texts) of about ``WORDS`` words each, sorted by uid."""

    def arranged(uids, texts):
        order = sorted(range(len(uids)), key=uids.__getitem__)
        return [uids[i] for i in order], [texts[i] for i in order]

    uids, texts, size = [], [], 0
    for batch in batches:
        for uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            uids.append(uid)
            texts.append(text)
            size += len(text or b"") // 5
            if size >= WORDS:
                yield arranged(uids, texts)
                uids, texts, size = [], [], 0
    if uids:
        yield arranged(uids, texts)


def crowded(rows: DataFrame, window: int, crowd: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of more than about ``crowd`` occurrences, at most ``HOT``, sorted, and how many shares each is dealt into.

    Counted in one document of 32, or more if ``crowd`` is small.
    """
    one_of = max(1, min(32, crowd // 16))

    def run(batches):
        for _, texts in _portions(batches):
            yield pa.RecordBatch.from_arrays([pa.array(occurrences(texts, window)[1])], names=["anchor"])

    some = rows.select("uid", "text").where(F.pmod(F.xxhash64(F.lit("crowd"), "uid"), F.lit(one_of)) == 0).mapInArrow(run, "anchor long")
    most = some.groupBy("anchor").count().where(F.col("count") * one_of > crowd).orderBy(F.desc("count"), "anchor").limit(HOT).collect()
    found = np.array(sorted((r["anchor"], -(-r["count"] * one_of // crowd)) for r in most), np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


#: The share of an occurrence that is a repeat of another in its portion: its one "window" is how many windows it has.
KNOWN = -2


def _known(anchor: np.ndarray, n: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Whether an earlier occurrence of the portion has the same anchor and the same windows; it needn't meet the others then."""
    if not len(anchor):
        return np.zeros(0, bool)
    place = np.arange(len(windows)) - np.repeat(np.cumsum(n) - n, n)
    own = np.add.reduceat(_mixed(windows.view(np.uint64) + place.astype(np.uint64)), np.cumsum(n) - n)
    order = np.lexsort((own, anchor))
    out = np.zeros(len(anchor), bool)
    out[order[1:]] = (anchor[order[1:]] == anchor[order[:-1]]) & (own[order[1:]] == own[order[:-1]])
    return out


def _met(window: int, hot: np.ndarray, shares: np.ndarray):
    def run(batches):
        for uids, texts in _portions(batches):
            text, anchor, low, n, windows = occurrences(texts, window)
            uid = np.array(uids, np.int64)[text]
            share = np.full(len(anchor), -1, np.int64)
            if len(hot) and len(anchor):
                at = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
                is_hot = hot[at] == anchor
                share[is_hot] = (_mixed(uid[is_hot].view(np.uint64)) % shares[at[is_hot]].astype(np.uint64)).astype(np.int64)
            known = _known(anchor, n, windows)
            share[known], anchor[known] = KNOWN, _mixed(uid[known].view(np.uint64)).view(np.int64)
            parts = np.where(known, 1, n)
            starts = (np.cumsum(n) - n)[known]
            windows[starts] = n[known]
            windows = windows[np.repeat(~known, n) | (np.bincount(starts, minlength=len(windows)) > 0)]
            offsets = np.r_[0, np.cumsum(parts)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(share.astype(np.int32)), pa.array(uid), pa.array(low.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(windows))], names=["anchor", "share", "uid", "low", "windows"])

    return run


def _repeats(batches):
    """Rows sorted by (anchor, share, uid, low) to repeats (uid, a, z) of window starts [a, z], with share -1 and without window.

    Of shares of a crowded anchor also what is first in the share: (uid, a, a) with share, anchor and window.
    What is ``KNOWN`` to be a repeat goes through.
    """
    last, seen = None, np.zeros(0, np.int64)
    for batch in batches:
        anchor, share, uid, low = (batch.column(i).to_numpy() for i in range(4))
        if not len(anchor):
            continue
        if (known := share == KNOWN).any():
            some = batch.filter(pa.array(known))
            begin, end = some.column(3).to_numpy(), some.column(4).flatten().to_numpy()
            none = pa.array(np.zeros(len(begin), np.int64))
            yield pa.RecordBatch.from_arrays([some.column(2), pa.array(begin.astype(np.int64)), pa.array(begin + end - 1), pa.array(np.full(len(begin), -1)), none, none], names=["uid", "a", "z", "share", "anchor", "w"])
            batch = batch.filter(pa.array(~known))
            anchor, share, uid, low = (batch.column(i).to_numpy() for i in range(4))
            if not len(anchor):
                continue
        begins, ends = batch.column(4).offsets.to_numpy()[:-1], batch.column(4).offsets.to_numpy()[1:]
        group = np.cumsum(np.r_[False, (anchor[1:] != anchor[:-1]) | (share[1:] != share[:-1])])
        goes_on = last == (anchor[0], share[0])
        sizes = np.bincount(group)
        # An anchor alone has nothing to tell, unless it goes on in another batch or share.
        tried = (sizes > 1) | (share[np.cumsum(sizes) - 1] >= 0)
        tried[0] |= goes_on
        tried[-1] = True
        rows = np.flatnonzero(tried[group])
        n = (ends - begins)[rows]
        at = np.repeat(begins[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        w, row = batch.column(4).values.to_numpy()[at], np.repeat(rows, n)
        place = low[row] + at - begins[row]
        order = np.lexsort((w, group[row]))  # stable, so that the earliest of equal windows comes first
        same = np.r_[False, (w[order][1:] == w[order][:-1]) & (group[row][order][1:] == group[row][order][:-1])]
        late = np.zeros(len(w), bool)
        late[order] = same
        if goes_on:
            first = group[row] == 0
            late[first] |= np.isin(w[first], seen)
        tail = np.unique(w[group[row] == group[-1]])
        seen = np.union1d(seen, tail) if goes_on and group[-1] == 0 else tail
        last = (anchor[-1], share[-1])
        starts = np.flatnonzero(late & ~np.r_[False, late[:-1] & (row[1:] == row[:-1])]) if len(late) else np.zeros(0, np.int64)
        stops = np.flatnonzero(late & ~np.r_[late[1:] & (row[1:] == row[:-1]), False]) if len(late) else starts
        firsts = np.flatnonzero(~late & (share[row] >= 0))
        none = np.zeros(len(starts), np.int64)
        columns = [(uid[row[starts]], uid[row[firsts]]), (place[starts], place[firsts]), (place[stops], place[firsts]), (none - 1, share[row[firsts]]), (none, anchor[row[firsts]]), (none, w[firsts])]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in columns], names=["uid", "a", "z", "share", "anchor", "w"])


def _ordered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with ``uid``, a long in the order of key, and text where keys repeat; null keys last."""
    ident = F.col(f"`{key}`")
    if isinstance(docs.schema[key].dataType, IntegralType):
        odd = docs.groupBy(ident.alias("k")).count().where("count > 1 or k is null")
        if odd.isEmpty():
            return docs.withColumn("uid", ident.cast("long"))
    rows = docs.orderBy(ident.asc_nulls_last(), F.col(f"`{text}`").asc_nulls_first())
    return cut(rows.withColumn("uid", F.monotonically_increasing_id()))


def repeats(rows: DataFrame, window: int = 20, crowd: int = 500) -> DataFrame:
    """(uid, text) to (uid, spans): the word ranges to remove, packed as a << 32 | z, of the rows that have any.

    A word goes if a window of ``window`` consecutive words covers it that also
    starts at an earlier place: in a row with a smaller uid, or earlier in the same.
    """
    hot, shares = crowded(rows, window, crowd)
    windows = rows.select("uid", "text").mapInArrow(_met(window, hot, shares), "anchor long, share int, uid long, low int, windows array<long>")
    met = windows.repartition("anchor", "share").sortWithinPartitions("anchor", "share", "uid", "low")
    found = cut(met.mapInArrow(_repeats, "uid long, a long, z long, share long, anchor long, w long"))
    late = found.where("share < 0").select("uid", "a", "z")
    if len(hot):
        order = Window.partitionBy("anchor", "w").orderBy("uid", "a")
        later = found.where("share >= 0").withColumn("n", F.row_number().over(order)).where("n > 1").select("uid", "a", "z")
        late = late.unionByName(later)
    return late.select("uid", "a", (F.col("z") + window).alias("z")).groupBy("uid").agg(F.collect_list(_packed("a", "z")).alias("spans"))


def _small(batches):
    """(key, uid, text) with the text compressed, and its size: shuffled it's half as large as Spark's own codec makes it."""
    codec = pa.Codec("zstd", compression_level=1)
    for batch in batches:
        texts = [x or b"" for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([codec.compress(x, asbytes=True) for x in texts], pa.binary()), pa.array(list(map(len, texts)), pa.int64())], names=["key", "uid", "text", "size"])


def _kept(words: list[bytes], spans) -> list[bytes]:
    keep = np.ones(len(words), bool)
    for a, z in zip(*_unpacked(spans), strict=True):
        keep[a:z] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 20, crowd: int = 500) -> DataFrame:
    """(key, n_words, n_removed, kept): ``kept`` is the words that stay, joined by one space.

    See ``repeats`` for what goes.  Keys may be of any type that can be ordered.  Rows of one
    key stand in the order of their texts, null keys last, so that of rows that are alike
    the first stays.  Words are what white space separates; null and empty texts have none, and
    a text shorter than the window loses none.  Windows are judged on the input.
    """

    def run(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            counts, removed, kept = [], [], []
            for body, size, spans in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                words = _words(codec.decompress(body, size, asbytes=True)) if size else []
                left = _kept(words, spans) if spans else words
                counts.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["key", "n_words", "n_removed", "kept"])

    kind = docs.schema[key].dataType.simpleString()
    rows = _ordered(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("text")), "key", "text")
    found = repeats(rows, window, crowd)
    small = rows.select("key", "uid", "text").mapInArrow(_small, f"key {kind}, uid long, text binary, size long")
    out = small.join(found, "uid", "left").select("key", "text", "size", "spans").mapInArrow(run, f"key {kind}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("key", key)


def digest(kept: str) -> str:
    return hashlib.sha256(kept.encode()).hexdigest()
