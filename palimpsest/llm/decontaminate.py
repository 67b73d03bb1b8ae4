"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

The windows of the benchmark are read once, and their hashes and items are broadcast:
their number is checked first, and a larger benchmark is cut into slices
that are each small enough, whose scans run one after the other and whose hits
are joined for each document.  A document is scanned whole, in one pass: words
that no item has break it into runs, and only in runs of the shortest window's
length are windows hashed.  A hash that hits is verified word by word.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import ALNUM, cleared, cut

_WORD = re.compile(ALNUM.encode())
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words of letters, digits and whatever is beyond ASCII; null has none."""
    return _WORD.findall((text or "").encode().translate(_LOWER))


class Windows:
    """The windows of some benchmark items: all runs of ``width`` words, or a shorter item whole.

    A window is kept as its hash and its place, 16 bytes; its words are read from the item.
    """

    def __init__(self, items: list[tuple], width: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items, self.ids = [], []
        number = self.vocabulary.setdefault
        found: dict[int, list] = {}
        for name, text in items:
            own = np.array([number(w, len(self.vocabulary)) for w in tokens(text)], np.int64)
            if len(own):
                size = min(width, len(own))
                hashes = self._hash(own, size)
                found.setdefault(size, []).append((hashes, np.full(len(hashes), len(self.items), np.int32), np.arange(len(hashes), dtype=np.int32)))
                self.items.append(name)
                self.ids.append(own)
        self.known = {}
        for size in sorted(found):
            columns = [np.concatenate(x) for x in zip(*found[size], strict=True)]
            order = np.argsort(columns[0], kind="stable")
            self.known[size] = [c[order] for c in columns]

    @staticmethod
    def _hash(ids: np.ndarray, n: int) -> np.ndarray:
        """A hash of each run of n."""
        x = (ids.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
        x ^= x >> np.uint64(29)
        out = np.zeros(max(len(ids) - n + 1, 0), np.uint64)
        for k in range(n):
            out = out * np.uint64(0x100000001B3) + x[k : k + len(out)]
        return out

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of words [start, end) that occurring windows cover, merged, and the items they are of."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        unknown = np.r_[0, np.cumsum(ids < 0)]
        spans, items = [], set()
        for n, (known, item, place) in self.known.items():
            if len(ids) < n:
                break
            starts = np.flatnonzero(unknown[n:] == unknown[:-n])
            if not len(starts):
                continue
            hashes = self._hash(ids, n)[starts]
            low, high = np.searchsorted(known, hashes, "left"), np.searchsorted(known, hashes, "right")
            for k in np.flatnonzero(high > low).tolist():
                at, hit = int(starts[k]), False
                for j in range(low[k], high[k]):
                    own = self.ids[item[j]][place[j] : place[j] + n]
                    if np.array_equal(own, ids[at : at + n]):
                        hit = True
                        items.add(int(item[j]))
                if hit:
                    spans.append((at, at + n))
        return merged(spans), items


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [tuple(x) for x in out]


def _slices(benchmark: DataFrame, item: str, text: str, most: int):
    """How many slices of about ``most`` words the items make (an item is never cut), and the slices, one on the driver at a time."""
    size = F.coalesce(F.length(F.col(f"`{text}`")), F.lit(0))
    rows = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{text}`").alias("text"), size.alias("n"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = int(total // (6 * most)) + 1
    rows = rows.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)))
    return parts, ([(r["item"], r["text"]) for r in rows.where(F.col("part") == i).orderBy("item", "text").collect()] for i in range(parts))


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 13, most_words: int = 1_000_000, cleaned: bool = False, share: int = 20) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_items (array of names), hit_spans and contaminated.

    A window is ``width`` consecutive words of an item, or all of a shorter
    one; a word of a document that lies in an occurrence of one is hit.  A row
    is contaminated when ``share * n_hit >= n_words`` and something is hit.
    Null and empty texts have no words; an item without words has no window;
    rows and items that repeat count each for themselves, items once by name.  An
    empty benchmark hits nothing.  ``hit_spans`` are [start, end) pairs of words.
    With ``cleaned``, the hit words are taken out of ``text`` with the
    characters between them.  A column of ``docs`` of an added name is replaced.
    """
    docs = cleared(docs, ["n_words", "n_hit", "hit_items", "hit_spans", "contaminated"], text)
    total, slices = _slices(benchmark, item, item_text, most_words)
    sc = docs.sparkSession.sparkContext
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    schema = fields + ", n_words long, n_hit long, hit_items array<string>, hit_spans array<struct<a:long,z:long>>, contaminated boolean"
    kind = pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))
    out = docs
    for number, part in enumerate(slices):
        held = sc.broadcast(Windows(part, width))  # built once, and read once by each worker
        last = number == total - 1

        def run(batches, held=held, number=number, last=last):
            windows = held.value
            for batch in batches:
                names = batch.schema.names
                texts = batch.column(names.index(text)).to_pylist()
                before = batch.column(names.index("hit_spans")).to_pylist() if number else [[]] * len(texts)
                known = batch.column(names.index("hit_items")).to_pylist() if number else [[]] * len(texts)
                counts, hits, items, spans, bodies = [], [], [], [], []
                for body, old, had in zip(texts, before, known, strict=True):
                    words = tokens(body)
                    found, own = windows.scan(words)
                    found = merged([*((x["a"], x["z"]) for x in old), *found]) if old else found
                    counts.append(len(words))
                    hits.append(sum(z - a for a, z in found))
                    items.append(sorted({*had, *(windows.items[i] for i in own if windows.items[i] is not None)}))
                    spans.append([{"a": a, "z": z} for a, z in found])
                    bodies.append(without(body, found) if cleaned and last and found else body)
                columns = dict(zip(names, batch.columns, strict=True))
                if cleaned and last:
                    columns[text] = pa.array(bodies, batch.column(names.index(text)).type)
                columns |= {"n_words": pa.array(counts, pa.int64()), "n_hit": pa.array(hits, pa.int64()), "hit_items": pa.array(items, pa.list_(pa.string())), "hit_spans": pa.array(spans, kind)}
                columns["contaminated"] = pa.array([h > 0 and share * h >= n for h, n in zip(hits, counts, strict=True)])
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        out = out.mapInArrow(run, schema)
        if not last:
            out = cut(out)
    return out


def without(body: str, spans: list[tuple[int, int]]) -> str:
    """``body`` without the words of ``spans`` and what stands between them."""
    raw = body.encode()
    places = [m.span() for m in _WORD.finditer(raw.translate(_LOWER))]
    out, at = [], 0
    for a, z in spans:
        out.append(raw[at : places[a][0]])
        at = places[z - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """``docs`` without the contaminated rows; its columns are unchanged.

    Rows that are hit below the threshold stay as they are.
    """
    found = scan(docs.select(*[F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(docs.columns)]), benchmark, f"d{docs.columns.index(text)}", **how)
    return found.where("not contaminated").select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(docs.columns)])


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
