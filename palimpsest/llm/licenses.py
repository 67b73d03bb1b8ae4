"""License scans by an exact set-similarity join of text blocks with notices.

A block is a run of words of one paragraph, over any number of its lines, as
notices are wrapped: at most as many words as the notice has, divided by
``share``.  The distinct words of the notices are ordered by how many paragraphs of
the whole corpus have them, rarest first.  A notice is contained in a block when
at least ``share`` of its words are in it; then one of its rarest words (its
prefix) is in the paragraph, the paragraph isn't shorter than that share, and after a
prefix word is found enough of the notice is left to reach it.  In the paragraphs that pass
these filters every block is counted out.

Licenses differ by single words, so a notice also has telling words, all of
which a block must have.  Where blocks of two notices share words, one gives way whose
telling words are all among the other's: CC BY gives way to CC BY-NC, the
general license to the lesser.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import ALNUM, cleared

#: Phrases that mark a license wherever their words stand together.
PHRASES = {
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
    "mit": "under the mit license",
}
_FREE = "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by the Free Software Foundation"
_LATER = ", either version {version} of the License, or (at your option) any later version."
_PARTS = {"nc": "NonCommercial", "sa": "ShareAlike", "nd": "NoDerivatives"}
#: Sentences of usual licenses and of notices that name them: label, text, telling words.  The list is fixed, so its size is bounded.
NOTICES = [
    ("mit", "released under the MIT License", "mit"),
    ("mit", "licensed under the MIT License", "mit"),
    ("mit", "SPDX-License-Identifier: MIT", "spdx mit"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "granted charge obtaining"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "permission substantial"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "fee appear"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution binary"),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "endorse contributors"),
    ("apache-2", "licensed under the Apache License, Version 2.0", "apache 2"),
    ("apache-2", "SPDX-License-Identifier: Apache-2.0", "spdx apache"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache compliance"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla"),
    ("unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "authors held"),
    ("cc0", "dedicated to the public domain under CC0 1.0 Universal", "cc0"),
    *((label, f"licensed under the GNU {name} Public License", f"gnu {name} public") for label, name in [("gpl", "General"), ("lgpl", "Lesser General"), ("agpl", "Affero General")]),
    *((f"{label}-{v}", f"licensed under the GNU {name} Public License, version {v}", f"gnu {name} public {v}") for label, name, v in [("gpl", "General", "2"), ("gpl", "General", "3"), ("lgpl", "Lesser General", "2.1"), ("lgpl", "Lesser General", "3"), ("agpl", "Affero General", "3")]),
    *((label, _FREE.format(what=what, name=name), f"gnu {name} public") for label, what, name in [("gpl", "program", "General"), ("lgpl", "library", "Lesser General"), ("agpl", "program", "Affero General")]),
    *((f"{label}-{v}", _FREE.format(what=what, name=name) + _LATER.format(version=v), f"gnu {name} public {v}") for label, what, name, v in [("gpl", "program", "General", "2"), ("gpl", "program", "General", "3"), ("lgpl", "library", "Lesser General", "2.1"), ("lgpl", "library", "Lesser General", "3"), ("agpl", "program", "Affero General", "3")]),
    *(("-".join(["cc-by", *own]), " ".join(["CC BY", *own, "4.0"]), " ".join(["cc by", *own])) for own in [[], ["nc"], ["sa"], ["nd"], ["nc", "sa"], ["nc", "nd"]]),
    *(("-".join(["cc-by", *own]), " ".join(["licensed under a Creative Commons Attribution", *(_PARTS[x] for x in own), "4.0 International License"]), " ".join(["creative commons attribution", *(_PARTS[x] for x in own)])) for own in [[], ["nc"], ["sa"], ["nd"], ["nc", "sa"], ["nc", "nd"]]),
]

_WORD = re.compile(ALNUM.encode())
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def tokens(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().translate(_LOWER))


def _lines(text: str | None) -> list[list[bytes]]:
    return [_WORD.findall(x) for x in (text or "").encode().translate(_LOWER).split(b"\n")]


def paragraphs(lines: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    """(first line, line after the last) of each run of lines that have words."""
    start = None
    for i, line in enumerate([*lines, []]):
        if line and start is None:
            start = i
        elif not line and start is not None:
            yield start, i
            start = None


def frequencies(docs: DataFrame, text: str, notices: list[tuple]) -> dict[bytes, int]:
    """In how many paragraphs of all texts each word of the notices is."""
    wanted = frozenset(w for _, x, *_ in notices for w in tokens(x))

    def run(batches):
        counts = dict.fromkeys(wanted, 0)
        for batch in batches:
            for body in batch.column(0).to_pylist():
                lines = _lines(body)
                for start, end in paragraphs(lines):
                    for w in wanted.intersection(w for line in lines[start:end] for w in line):
                        counts[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return dict.fromkeys(wanted, 0) | {r["word"].encode(): r["n"] for r in rows.collect()}  # as many rows as the notices have words


class Notices:
    """Notices (label, text, and telling words if there are any) with their words in the corpus's order and their prefixes."""

    def __init__(self, notices: list[tuple], counts: dict[bytes, int], share: float):
        self.rows, self.by_prefix = [], {}
        for number, (label, text, *telling) in enumerate(notices):
            words = sorted(set(tokens(text)), key=lambda w: (counts.get(w, 0), w))
            least = max(1, math.ceil(share * len(words) - 1e-9))
            width = math.ceil(len(tokens(text)) / share - 1e-9)
            self.rows.append((label, words, least, width, frozenset(tokens(" ".join(telling)))))
            for place, w in enumerate(words[: len(words) - least + 1]):
                self.by_prefix.setdefault(w, []).append((number, place))
        self.prefixes = frozenset(self.by_prefix)
        self.above = [[i for i, other in enumerate(self.rows) if row[4] and row[4] < other[4]] for row in self.rows]

    def near(self, words: list[bytes]) -> Iterator[int]:
        """The notices that a paragraph has enough words of to have a block that contains them."""
        hits = self.prefixes.intersection(words)
        if not hits:
            return
        own, first = set(words), {}
        for w in hits:
            for number, place in self.by_prefix[w]:
                first[number] = min(first.get(number, place), place)
        for number, place in sorted(first.items()):
            _, wanted, least, _, telling = self.rows[number]
            if len(own) >= least and len(wanted) - place >= least and telling <= own and sum(w in own for w in wanted[place:]) >= least:
                yield number

    def blocks(self, words: list[bytes], number: int) -> Iterator[tuple[int, int, int]]:
        """(first word, last word, how many of the notice's words) of the blocks that contain it: the best of each run of them, the first of equals."""
        _, wanted, least, width, telling = self.rows[number]
        wanted, window, counts, best = frozenset(wanted), deque(), {}, None
        for at, w in enumerate(words):
            if w not in wanted:
                continue
            window.append((at, w))
            counts[w] = counts.get(w, 0) + 1
            while window[0][0] <= at - width or counts[window[0][1]] > 1:
                old = window.popleft()[1]
                counts[old] -= 1
                if not counts[old]:
                    del counts[old]
            if len(counts) >= least and telling <= counts.keys():
                if best is None or len(counts) > best[2]:
                    best = (window[0][0], at, len(counts))
            elif best:
                yield best
                best = None
        if best:
            yield best

    def join(self, words: list[bytes]) -> Iterator[tuple[str, int, float]]:
        """(label, first word, share of the notice's words) of the blocks of a paragraph that contain a notice and don't give way."""
        found = {n: own for n in self.near(words) if (own := list(self.blocks(words, n)))}
        ends = {n: ([x[0] for x in own], [x[1] for x in own]) for n, own in found.items()}

        def gives_way(number: int, first: int, last: int) -> bool:
            for other in self.above[number]:
                if other in ends:
                    firsts, lasts = ends[other]
                    place = bisect_right(firsts, last) - 1
                    if place >= 0 and lasts[place] >= first:
                        return True
            return False

        for number, own in found.items():
            label, wanted, *_ = self.rows[number]
            for first, last, both in own:
                if not gives_way(number, first, last):
                    yield label, first, both / len(wanted)


def places(words: list[bytes], phrases: dict[str, list[bytes]]):
    """(label, start) of each place where a phrase's words stand consecutively."""
    joined = b" " + b" ".join(words) + b" "
    for label, phrase in phrases.items():
        wanted = b" " + b" ".join(phrase) + b" "
        at, counted, n = joined.find(wanted), 0, 0
        while at >= 0:
            n += joined.count(b" ", counted, at)
            counted = at
            yield label, n
            at = joined.find(wanted, at + 1)


def scan(docs: DataFrame, text: str = "text", notices: list[tuple] | None = None, phrases: dict[str, str] | None = None, share: float = 0.8) -> DataFrame:
    """``docs`` with its licenses; ``text`` stays.

    n_words, n_base, first_word, last_word and base_labels are of the phrases,
    over the whole text; found (label, line, share) are the blocks that contain
    a notice, by their first line, best of each run of blocks; labels are of both; score is the largest share, 1 where a phrase
    is found and 0 where nothing is.  Null and empty texts have no words and
    lines.  Rows stand for themselves: repeats and ties don't matter.  A column of
    ``docs`` of an added name is replaced.
    """
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "found", "score"]
    docs = cleared(docs, names, text)
    notices = NOTICES if notices is None else notices
    wanted = {k: tokens(v) for k, v in (PHRASES if phrases is None else phrases).items()}
    counts = frequencies(docs, text, notices)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    added = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, found array<struct<label:string,line:long,share:double>>, score double"
    kind = pa.list_(pa.struct([("label", pa.string()), ("line", pa.int64()), ("share", pa.float64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), kind, pa.float64()]

    def run(batches):
        joined = Notices(notices, counts, share)
        for batch in batches:
            columns = [[] for _ in names]
            for body in batch.column(batch.schema.get_field_index(text)).to_pylist():
                lines = _lines(body)
                words = [w for line in lines for w in line]
                base = list(places(words, wanted))
                found = []
                for start, end in paragraphs(lines):
                    ends = list(accumulate(map(len, lines[start:end])))
                    found += [{"label": k, "line": start + bisect_right(ends, at), "share": s} for k, at, s in joined.join([w for line in lines[start:end] for w in line])]
                starts = [i for _, i in base]
                own = sorted({k for k, _ in base})
                row = [len(words), len(base), min(starts, default=None), max(starts, default=None), own, sorted({*own, *(x["label"] for x in found)}), found, 1.0 if base else max((x["share"] for x in found), default=0.0)]
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, f"{fields}, {added}")
