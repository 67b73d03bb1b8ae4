"""Counting, packing, merging and exploding operators against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import chunks, entities, occurrences
from palimpsest.sources.tables import paragraphs

WORDS = ["Иванов", "Иванова", "Иваном", "Мария", "Марии", "Марина", "ООО", "«Ромашка»", '"Ромашка"', "—", "И.И.", "and", "x-y", "x–y", "№", "\n", "  "]
ENTITIES = [
    ("a", ["Иванов", "Иванов И.И."], True), ("b", ["Мария"], True), ("c", ['ООО "Ромашка"'], False), ("d", ["x-y"], False), ("e", ["—"], False), ("f", ["№"], False), ("g", ["absent"], False),
]


def texts(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(30))) for _ in range(n)] + ["", None]


@pytest.mark.parametrize("few", [500, 0])
def test_occurrences_are_what_each_pattern_finds(spark, few, monkeypatch):
    monkeypatch.setattr(occurrences, "FEW_ANCHORS", few)
    rows = texts(300, 1)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    forms = spark.createDataFrame([(i, T.entity_pattern(f, inf), f, inf) for i, f, inf in ENTITIES], "entity_id string, pattern string, forms array<string>, inflect boolean")
    got = {(r["entity_id"], r["doc_id"]): r["n"] for r in occurrences.count_occurrences(docs, forms).collect()}
    want = {}
    for i, f, inf in ENTITIES:
        pattern = re.compile(T.entity_pattern(f, inf))
        want |= {(i, k): n for k, t in enumerate(rows) if t and (n := len(pattern.findall(t)))}
    assert got == want and {i for i, _ in got} == set("abcdef")


def test_inflection():
    find = lambda v, x: re.findall(T.form_pattern(v, True), x)
    assert find("Иванов", "Иванов Иванова Иванову Ивановым Ивановский") == ["Иванов", "Иванова", "Иванову", "Ивановым"]
    assert find("Мария", "Мария Марии Марию Марией Мар") == ["Мария", "Марии", "Марию", "Марией"]
    assert T.form_pattern("  ") == "" and T.entity_pattern([" "]) == ""


def plain_pack(parts, most):
    done, open_, size = [], [], 0
    for p in parts:
        p = p[:most]
        if open_ and size + len(p) > most:
            done.append("\n".join(open_))
            open_, size = [], 0
        open_.append(p)
        size += len(p) + 1
    return done + (["\n".join(open_)] if open_ else [])


def test_packing(spark):
    assert plain_pack(["aaaa", "bbb", "cc", "dddddddd"], 8) == ["aaaa\nbbb", "cc", "dddddddd"]
    rng = random.Random(4)
    rows = ["\n".join("".join(rng.choice("ab ") for _ in range(rng.randrange(14))) for _ in range(rng.randrange(12))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    got = {}
    for r in chunks.chunks(paragraphs(docs), 10).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    for i, t in enumerate(rows):
        lines = dict.fromkeys(x.strip() for x in t.split("\n") if len(x.strip()) >= 2)
        assert got.get(i, []) == plain_pack(list(lines), 10)


def test_tags_run_past_three_digits(spark):
    rows = spark.range(1200).select(F.col("id"), F.lit("id number!").alias("category"), F.format_string("%05d", "id").alias("value"), F.lit(1).alias("total"))
    tags = {r["value"]: r["tag"] for r in entities.with_tags(rows).collect()}
    assert tags["00000"] == "[[ID_NUMBER_001]]" and tags["01199"] == "[[ID_NUMBER_1200]]"


def test_chunks_of_texts_are_those_of_paragraphs(spark):
    rng = random.Random(9)
    rows = ["\n".join(rng.choice(["a", "bb ", " ccc", "d" * 30, "ee\u00a0", "", "ff gg"]) for _ in range(rng.randrange(20))) for _ in range(60)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    shown = lambda df: sorted(map(tuple, df.collect()))
    assert shown(chunks.of_texts(docs, 12)) == shown(chunks.chunks(paragraphs(docs), 12))
    long = spark.createDataFrame([(1, "x" * 25 + "\nyy")], "doc_id bigint, text string")
    assert [r["text"] for r in chunks.of_texts(long, 10, split_long=True).orderBy("chunk_no").collect()] == ["x" * 10, "x" * 10, "xxxxx\nyy"]
