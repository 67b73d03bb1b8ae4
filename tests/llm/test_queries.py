"""The registered queries against plain versions, over whole small tables."""

import duckdb
import numpy as np
import pytest

from palimpsest.llm import pii, queries
from tests.llm import brute

DIRS = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]


def rows(sf, name, columns):
    return duckdb.connect().execute(f"SELECT {columns} FROM '{sf}/{name}.parquet'").fetchall()


@pytest.mark.parametrize("sf", DIRS)
def test_simhash(spark, sf):
    prints = {i: brute.simhash(t) for i, t in rows(sf, "documents", "doc_id, text")}
    classes = brute.components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op1_simhash(spark, sf).collect()}
    assert got == {i: (f"{prints[i]:016x}", classes[i]) for i in prints}


@pytest.mark.parametrize("sf", DIRS)
def test_ann(spark, sf):
    vectors = dict(rows(sf, "embeddings", "vec_id, embedding"))
    want = brute.nearest(vectors, 20, 20)
    got = {}
    for r in queries.op2_ann(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    found = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(found) >= 0.9
    exact = {q: dict(v) for q, v in brute.nearest(vectors, 20, len(vectors)).items()}
    assert all(abs(s - exact[q][i]) < 1e-12 for q in got for i, s in got[q])


@pytest.mark.parametrize("sf", DIRS)
def test_pii(spark, sf):
    got = {r["doc_id"]: r for r in queries.op3_pii(spark, sf).collect()}
    for i, text in rows(sf, "documents", "doc_id, text"):
        base = brute.private(text)
        digest = ",".join(f"{k}:{a}:{z}" for k in pii.KINDS for a, z in base[k])
        r = got.pop(i)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [len(base[k]) for k in pii.KINDS]
        assert r["base_sha256"] == brute.sha(digest)
        assert set(filter(None, digest.split(","))) <= set(r["spans"].split(","))
    assert not got


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    labels = dict(rows(sf, "labels", "doc_id, toxic"))
    out = queries.op4_toxicity(spark, sf).collect()
    held = [(r["predicted"], labels[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in labels]
    right = sum(p == y == 1 for p, y in held)
    assert right / max(1, sum(y for _, y in held)) > 0.75 and right / max(1, sum(p for p, _ in held)) > 0.9


@pytest.mark.parametrize("sf", DIRS)
def test_substring(spark, sf):
    docs = sorted(rows(sf, "documents", "doc_id, text"))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op7_substring(spark, sf).collect()}
    want = {}
    for (i, text), kept in zip(docs, brute.later(docs), strict=True):
        n = len(brute.SPACED.findall(text or ""))
        want[i] = (n, n - len(kept), brute.sha(" ".join(kept)))
    assert got == want


@pytest.mark.parametrize("sf", DIRS)
def test_quality(spark, sf):
    targets = {i for i, y in rows(sf, "labels", "doc_id, quality") if y == 1}
    want, chosen = brute.resampled(rows(sf, "documents", "doc_id, text"), targets, 0.5, 23, 10_000)
    got = {r["doc_id"]: r for r in queries.op8_quality(spark, sf).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i]["log_weight"] - w) < 1e-6 and abs(got[i]["draw"] - d) < 1e-6 for i, (w, d) in want.items())
    assert {i for i, r in got.items() if r["selected"]} == chosen


@pytest.mark.parametrize("sf", DIRS)
def test_licenses(spark, sf):
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    got = {r["doc_id"]: r for r in queries.op10_licenses(spark, sf).collect()}
    for i, text in rows(sf, "documents", "doc_id, text"):
        words = brute.ALNUM.findall((text or "").translate(brute.LOWER))
        found = [(k, a) for k, p in phrases.items() for a in range(len(words)) if words[a : a + len(p.split())] == p.split()]
        starts, r = [a for _, a in found], got.pop(i)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(found), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({k for k, _ in found})) and {k for k, _ in found} <= set(r["labels"].split(","))
    assert not got


@pytest.mark.parametrize("sf", DIRS)
def test_html(spark, sf):
    """The pages of these tables have their text in an article element."""
    want = {i: (url, brute.article(page)) for i, url, page in rows(sf, "pages", "page_id, url, html")}
    got = {r["page_id"]: r for r in queries.op9_html(spark, sf).collect()}
    assert {i: (r["url"], r["text"]) for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
