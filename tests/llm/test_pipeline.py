"""The stages of the pipeline against plain versions, each on what the one before kept."""

import duckdb

import corpus_pipeline
from palimpsest.llm import pii, toxicity
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = duckdb.connect().execute(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    rows = {r["doc_id"]: r for r in docs.collect()}

    model = toxicity.fit(docs, labels)
    rows = {i: r for i, r in rows.items() if model.score(r["text"]) < 0.5}

    classes = brute.components({i: brute.simhash(r["text"]) for i, r in rows.items()})
    rows = {i: r for i, r in rows.items() if classes[i] == i}

    def clean(text):
        n, hit, _ = brute.hits(text, bench)
        return not (hit and 20 * hit >= n)

    rows = {i: r for i, r in rows.items() if clean(r["text"])}

    kept = spark.createDataFrame(list(rows.values()), docs.schema)
    texts = {}
    for r in pii.find(kept).collect():
        out, at = [], 0
        for a, z, k in sorted((s["a"], s["z"], s["kind"]) for s in r["pii_spans"]):
            if a >= at:
                out += [r["text"][at:a], f"[{pii.KINDS[k].upper()}]"]
            at = max(at, z)
        texts[r["doc_id"]] = "".join(out) + r["text"][at:]
        base = brute.private(r["text"])
        assert {(pii.KINDS.index(k), a, z) for k in base for a, z in base[k]} <= {(s["kind"], s["a"], s["z"]) for s in r["pii_spans"]}

    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    sizes, taken = {}, {}
    for i, text in texts.items():
        n, source = len(brute.SPACED.findall(text)), rows[i]["source"]
        sizes[source] = sizes.get(source, 0) + n
        if i in got:
            assert got[i]["text"] == text and got[i]["n_chars"] == len(text) and got[i]["copies"] * n + got[i]["part"] <= 2 * n
            taken[source] = taken.get(source, 0) + got[i]["copies"] * n + got[i]["part"]
    assert set(got) <= set(texts)
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    want = brute.waterfill(sizes, weights, 1.5 * sum(sizes.values()), 2.0)
    assert all(abs(taken.get(s, 0) - want[s]) <= 1 for s in sizes)


def test_stages_with_null_keys_and_repeated_rows(spark):
    """Each stage and the whole over rows of which some have no key, no text or no source, and some repeat."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = docs.limit(20).selectExpr("cast(null as bigint) doc_id", "text", "lang", "cast(null as string) source", "n_chars")
    blank = docs.limit(5).selectExpr("doc_id + 1000000 doc_id", "cast(null as string) text", "lang", "source", "cast(null as bigint) n_chars")
    rows = docs.unionByName(docs.limit(30)).unionByName(odd).unionByName(odd).unionByName(blank)
    kept = rows
    for name, stage in corpus_pipeline.STAGES:
        before = kept.count()
        out = stage(spark, kept, "/root/testdata/sf0.001").collect()
        assert 0 < len(out) <= before, name
        assert any(r["doc_id"] is None for r in out), name
        if name == "near_duplicates":
            keys = [r["doc_id"] for r in out if r["doc_id"] is not None]
            assert len(keys) == len(set(keys))
        if name != "mixing":
            assert list(out[0].asDict()) == docs.columns
            kept = spark.createDataFrame(out, docs.schema)
