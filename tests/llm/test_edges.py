"""Nulls, empty and long texts, ties, repeated rows, empty tables, extra and clashing columns."""

import random
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import ann, components, decontaminate, html, licenses, mixing, pii, quality, queries, simhash, substring, toxicity
from tests.llm import brute

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", None if i % 5 == 4 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


ODD = [None, "", " ", "x", "one two", "Ünï cödé ß 漢字 🙂 end", "a" * 30_000, " ".join(words(20_000, 1)), "\t\n\x0b\x0c\r", "same text here now", "same text here now"]


# ---- SimHash


def test_simhash_odd_texts(spark):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, ODD)).collect()}
    prints = {i: brute.simhash(t) for i, t in enumerate(ODD)}
    classes = brute.components(prints)
    assert {i: (r["fp"] % (1 << 64), r["component"]) for i, r in got.items()} == {i: (prints[i], classes[i]) for i in prints}


@pytest.mark.parametrize("crowd", [4096, 16])
def test_links_of_close_fingerprints(spark, crowd):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = {}
    for i in range(700):
        x = base[i % 6] if i % 7 else rng.getrandbits(64)
        for _ in range(rng.randrange(5)):
            x ^= 1 << rng.randrange(64)
        prints.setdefault(x, i)
    rows = spark.createDataFrame([(simhash._signed(x), i) for x, i in prints.items()], "fp bigint, id bigint")
    found = {r["node"]: r["component"] for r in components.components(simhash.links(rows, crowd=crowd)).collect()}
    want = brute.components({i: x for x, i in prints.items()})
    assert {i: found.get(i, i) for i in want} == want


def test_components_of_a_chain_and_nulls(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(5, None), (7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_simhash_repeated_and_null_keys(spark):
    a, b = " ".join(words(80, 5)), " ".join(words(80, 6))
    rows = docs(spark, [a, b, a, None, a], [1, 1, 7, None, None])
    got = simhash.near_duplicates(rows.withColumn("fp", F.lit("clash"))).collect()
    assert sorted((r["doc_id"], r["component"]) for r in got if r["doc_id"] is not None) == [(1, 1), (1, 1), (7, 1)]
    assert [r["component"] for r in got if r["doc_id"] is None] == [None, None]
    kept = simhash.deduplicate(rows)
    assert kept.columns == rows.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 0, 1]
    assert simhash.near_duplicates(rows.limit(0)).count() == 0


# ---- neighbours


def test_ann_odd_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[100:200] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (None, x[1].tolist()), (420, [0.0] * 16), (440, [float("nan")] * 16), (460, [None] * 16), (480, [1.0]), (20, x[20].tolist())]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, score string")
    got = {}
    for r in ann.search(table, block=64, queries=4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute.nearest({i: v for i, v in enumerate(x)}, 20, 20)
    assert got.keys() == want.keys()
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    assert [i for i, _ in got[0]][:5] == [i for i, _ in want[0]][:5]
    assert ann.search(table.limit(0)).count() == 0
    few = ann.search(table.where("vec_id < 6")).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("clusters", [0, 40])
def test_ann_recall_where_few_are_scored_again(spark, clusters):
    """20,000 vectors, of which 400 (2 %) a query are scored again; without structure, and in clusters, where few lists are looked into."""
    rng = np.random.default_rng(clusters)
    x = rng.normal(size=(20_000, 32))
    if clusters:
        x = 0.25 * x + rng.normal(size=(clusters, 32))[rng.integers(clusters, size=len(x))]
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    table = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": list(map(np.ndarray.tolist, x))}), "vec_id long, embedding array<float>").repartition(4)
    index = ann.fit(ann.valid(table, "vec_id", "embedding"))
    assert (index.probes <= 16) if clusters else (index.probes == len(index.middles))
    got = ann.search(table, every=200, block=4096, queries=50).toPandas()
    want = np.argsort(-(x[::200].astype(float) @ x.T.astype(float) - 9.0 * (np.arange(len(x))[None] == np.arange(0, len(x), 200)[:, None])), axis=1)[:, :20]
    found = [len(set(got[got["query_id"] == 200 * i]["vec_id"]) & set(own)) / 20 for i, own in enumerate(want.tolist())]
    assert len(got) == 100 * 20 and np.mean(found) >= 0.9, np.mean(found)


@pytest.mark.parametrize("kind", ["near copies", "more dimensions than bits", "lengths", "clusters", "tiny and huge"])
def test_ann_finds_what_codes_cannot_tell_apart(spark, kind):
    """All nearest are found, in the order of brute force, where far more than 400 rows look alike to the codes, or lie in lists that aren't looked into at first."""
    rng = np.random.default_rng(5)
    n, d = 3000, 256 if kind == "more dimensions than bits" else 64
    x = rng.normal(size=(n, d))
    if kind == "near copies":
        x[:700] = x[0] + 0.0001 * x[:700]
        x = x[rng.permutation(n)]
    if kind == "lengths":
        x *= rng.lognormal(sigma=2, size=(n, 1))
    if kind == "clusters":
        x = 0.1 * x + rng.normal(size=(30, d))[rng.integers(30, size=n)]
    x = x.astype(np.float32).astype(float)
    if kind == "tiny and huge":
        x *= 10.0 ** rng.choice([-150, 0, 150], size=(n, 1))
    element = "double" if kind == "tiny and huge" else "float"
    table = spark.createDataFrame(pd.DataFrame({"vec_id": range(n), "embedding": list(map(np.ndarray.tolist, x))}), f"vec_id long, embedding array<{element}>").repartition(4)
    got = {}
    for r in ann.search(table, every=100, block=1024).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q in range(0, n, 100):
        score = (x * x[q]).cumsum(axis=1)[:, -1]
        score[q] = -np.inf
        best = np.lexsort((np.arange(n), -score))[:20]
        assert got[q] == list(zip(best.tolist(), score[best].tolist(), strict=True))


def test_ann_blocks():
    assert ann.blocks_of({0: 5, 1: 5, 2: 30, 3: 1, 4: 9}, 10) == {0: (0, 1), 1: (0, 1), 2: (1, 3), 3: (4, 1), 4: (4, 1)}


# ---- personal data

PRIVATE = [
    "a@b.co.uk and A.b+c%d@x-y.z1, a@b, @x.y a@b.c_d@e.f x@y.z.", "1.2.3.4 1.2.3.256 1.2.3.4.5.6.7.8 01.002.3.4 999.1.1.1", "4111 1111 1111 1111, 4111-1111-1111-1111 4111111111111112",
    "4465758382889437 4465758382889437", "+1 (743) 555-3824 +12 +1234567890123456 +49 30 1234567.", "ß漢🙂 +1 743 555 3824 🙂 a@b.cd", "1 " * 3000, "9" * 20_000, "a." * 10_000 + "@x.y", "(743) 555-3824 or bob (at) mail (dot) com",
]


def test_pii_base(spark):
    texts = [*PRIVATE, None, ""]
    rows = docs(spark, texts).withColumn("kind", F.lit("clash"))
    got = {r["doc_id"]: r for r in pii.find(rows).collect()}
    for i, t in enumerate(texts):
        want = brute.private(t)
        assert {k: [(s["a"], s["z"]) for s in got[i][f"base_{k}"]] for k in pii.KINDS} == want, t[:60]
    assert pii.find(rows.limit(0)).count() == 0


def test_pii_base_in_short_groups(spark):
    texts = ["+33 6 12 34 56 78", "call +49 30 12 34 56 78 now", "+1 2 3 4 5 6 7", "+44 (0) 20-79.46.09.58", "1+2 a@b.c 1.2.3.4 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1"]
    for r in pii.find(docs(spark, texts)).collect():
        assert {k: [(s["a"], s["z"]) for s in r[f"base_{k}"]] for k in pii.KINDS} == brute.private(texts[r["doc_id"]]), r["text"]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs(spark, texts)).collect()}
    assert clean[0] == "[PHONE]" and clean[1] == "call [PHONE] now" and clean[2] == texts[2]


def luhn(number):
    digits = [int(d) for d in number if d.isdigit()]
    return sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(reversed(digits))) % 10 == 0


def valid_card(rng):
    return next(x for x in (str(rng.randrange(4 * 10**15, 5 * 10**15)) for _ in range(1000)) if luhn(x))


def test_pii_replaces_adjoining_and_loose_forms(spark):
    rng = random.Random(2)
    plain = [" ".join([*words(5, i), f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}", *words(3, i + 1)]) for i in range(50)]
    two = f"{valid_card(rng)}, {valid_card(rng)}"
    rows = docs(spark, [*plain, f"see {two} and (743) 555-3824"])
    last = pii.find(rows).where(f"doc_id = {len(plain)}").first()
    assert {(s["kind"], s["a"], s["z"]) for s in last["pii_spans"]} == {(2, 4, 20), (2, 22, 38), (3, 43, 57)}
    clean = pii.redact(rows).where(f"doc_id = {len(plain)}").first()
    assert clean["text"] == "see [CARD], [CARD] and [PHONE]" and clean["n_chars"] == len(clean["text"])


#: Said otherwise than in the sentences that the trees learn from.
PLANTED = [
    ("phone", "please ring, my phone is 743-555-{:04d}, any time"), ("phone", "Our office: call (212) 555 {:04d} today"), ("phone", "telefon 030 123{:04d} werktags"), ("phone", "fax 06 12 34 {:02d} 78"),
    ("email", "you can mail jane{} (at) firm (dot) com"), ("email", "kontakt: max.m{} [at] firma [dot] de"), ("email", "for news write ops{}(at)corp.net"), ("email", "just mail sam{} at corp dot org"),
    ("ip", "the server 10[.]20[.]30[.]{} answered"), ("ip", "host 2001:db8:85a3::8a2e:{}:7334 is up"), ("ip", "login from 192.168.4[.]{} failed"),
    ("card", "my amex 3782 822463 1{:04d}"), ("card", "visa 4111.1111.1111.{:04d} it is"),
    (None, "the meeting of 2024-05-{:02d} was long"), (None, "order 555 123 {:04d} has left"), (None, "chapters {} to 12 and pages 1999-2004"), (None, "version 2.14.{}-beta"), (None, "we stayed at home {} dot dash dot"),
    (None, "invoice 2024-{:04d}-993"), (None, "mac 00:1a:2b:3c:4d:{}"), (None, "at 12:30:{} sharp"), (None, "isbn 978-3-16-1484{:02d}-0"), (None, "a sum of 1 234 {} 890 euros"), (None, "pi is 3.14159265{:04d}"),
]


def test_pii_learned_forms_on_planted_cases(spark):
    """Each kind adds spans that the base doesn't have, with a precision of at least 0.95 and a recall of at least 0.9 here."""
    rng = random.Random(8)

    def planted(k, t):
        return next(x for x in (t.format(rng.randrange(10, 99)) for _ in range(1000)) if k != "card" or luhn(x))

    rows = [(k, f"{' '.join(words(4, i))}. {planted(k, t)} {' '.join(words(3, i))}") for i in range(25) for k, t in PLANTED]
    got = {r["doc_id"]: [pii.KINDS[s["kind"]] for s in r["pii_spans"]] for r in pii.find(docs(spark, [t for _, t in rows])).collect()}
    assert not any(any(brute.private(t).values()) for _, t in rows)
    added, right = sum(len(x) for x in got.values()), {k: [got[i] == [k] for i, (own, _) in enumerate(rows) if own == k] for k in pii.KINDS}
    assert sum(map(sum, right.values())) >= 0.95 * added
    assert all(sum(x) >= 0.9 * len(x) for x in right.values()), {k: sum(x) / len(x) for k, x in right.items()}


def test_pii_many_matches_in_one_text(spark):
    """A text of a megabyte with 50,000 addresses, and one with as many numbers that aren't base spans."""
    texts = ["".join(f"ab{i:05d}@mail{i}.com " for i in range(50_000)), "".join(f"743-555-{i % 9999:04d} ({i}) " for i in range(50_000))]
    model = pii.fit(docs(spark, PRIVATE))
    started = time.time()
    got = pii.redact(docs(spark, texts), model=model).collect()
    assert time.time() - started < 60
    assert got[0]["text"] == "[EMAIL] " * 50_000 and got[0]["n_chars"] == 400_000


def test_pii_redacted_places(spark):
    rng, texts, spans = random.Random(4), [], []
    for i in range(60):
        text = "".join(rng.choice("ab ß漢🙂\n") for _ in range(rng.randrange(1, 5000)))
        own = [(rng.randrange(4), a, min(len(text), a + rng.randrange(1, 40))) for a in (rng.randrange(len(text)) for _ in range(rng.randrange(0, 30)))]
        texts.append(text)
        spans.append(sorted(own))
    table = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(zip(texts, spans, strict=True))], "i int, t string, s array<struct<kind:int,a:int,z:int>>")
    for r in table.select("i", pii.redacted(F.col("t"), F.col("s")).alias("out")).collect():
        out, at, text = [], 0, texts[r["i"]]
        for a, z, k in sorted((a, z, k) for k, a, z in spans[r["i"]]):
            if a >= at:
                out += [text[at:a], f"[{pii.KINDS[k].upper()}]"]
            at = max(at, z)
        assert r["out"] == "".join(out) + text[at:]


# ---- toxicity


def test_toxicity_learns_words_and_odd_rows(spark):
    bad = ["vile", "rotten", "foul"]
    texts, labels = [], []
    for i in range(900):
        toxic = i % 9 == 0
        own = words(40, i) + ([bad[i % 3]] if toxic else [])
        texts.append(" ".join(own))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    rows = docs(spark, [*texts, None, "", "Vile!"])
    marks = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(rows, marks)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(rows, model).collect()}
    assert all((got[i] >= 0.5) == (i % 9 == 0) for i in range(900))
    assert got[900] == got[901] < 0.5 <= got[902]
    empty = toxicity.fit(rows.limit(0), marks.limit(0))
    assert toxicity.score(rows, empty).select("score").distinct().count() == 1


def test_toxicity_of_repeated_null_and_text_keys(spark):
    texts, labels = [], []
    for i in range(300):
        texts.append(" ".join(words(30, i) + (["vile"] if i % 6 == 0 else [])))
        labels.append((i, int(i % 6 == 0)))
    rows, marks = docs(spark, texts), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    again = rows.unionByName(docs(spark, ["vile other text"] * 4, [1, 1, None, None])).unionByName(rows)
    first = toxicity.fit(again, marks.union(marks))
    assert first == toxicity.fit(again.repartition(7), marks)
    named = toxicity.fit(rows.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), marks.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")))
    assert named.score("vile") >= 0.5 > named.score("w1")


def test_nn_pu_doesnt_call_unlabelled_positives_negative():
    rng = np.random.default_rng(0)
    positive, negative = rng.normal(2, 1, (200, 2)), rng.normal(-2, 1, (700, 2))
    hidden = rng.normal(2, 1, (300, 2))
    w, b = toxicity.nn_pu(positive, np.r_[negative, hidden], 0.3)
    assert ((hidden @ w + b) > 0).mean() > 0.9 and ((negative @ w + b) > 0).mean() < 0.1


# ---- mixing


def test_mixing_targets(spark):
    sizes = {"a": 1000, "b": 10, "c": 400, "é": 7, None: 50}
    weights = dict(zip(["a", "b", "c", "é", None], [5, 2, 1, 5, 2], strict=True))
    want = brute.waterfill(sizes, weights, 1.5 * sum(sizes.values()), 2.0)
    rows = []
    for s, n in sizes.items():
        while n > 0:
            take = min(n, 1 + len(rows) % 9)
            rows.append((len(rows), " ".join(["w"] * take), "en", s, take))
            n -= take
    table = spark.createDataFrame([*rows, (None, None, None, "a", None), (3, "w", "en", "zero", 1)], DOCS)
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    taken = {}
    for r in got:
        s = rows[r["doc_id"]][3]
        assert abs(r["target"] - want[s]) < 1e-9 and r["source_size"] == sizes[s] and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    assert mixing.mix(table).count() == len(rows) + 2 and mixing.mix(table.limit(0)).count() == 0
    out = mixing.sample(spark.createDataFrame(rows, DOCS)).groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()
    assert {r["source"]: r["n"] for r in out} == {s: n for s, n in taken.items() if n}


def test_mixing_of_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "a b c d", "en", "s", 7)] * 10 + [(None, "a b", "en", "t", 3)] * 50, DOCS).withColumn("size", F.lit("clash"))
    got = mixing.mix(rows).collect()
    assert len(got) == 60 and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.counted(rows).columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "taken", "copies", "part"]


# ---- decontamination


@pytest.mark.parametrize("most", [1_000_000, 30])
def test_decontamination(spark, most):
    items = [(i, " ".join(words(30, 50 + i))) for i in range(4)] + [(4, "Short item-here"), (5, None), (6, "!!"), (7, "Short item-here")]
    texts = [None, "", "--", "a short ITEM here b", "short item", *(f"{' '.join(words(60, i))} {items[i % 4][1][4:]}" for i in range(8)), " ".join(words(13, 50)), "ß 漢 short item here"]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, n_words string")
    out = decontaminate.scan(docs(spark, texts), bench, most_words=most).collect()
    for r in out:
        n, hit, names = brute.hits(texts[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], set(r["hit_items"])) == (n, hit, {str(x) for x in names})
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
    assert decontaminate.scan(docs(spark, texts), bench.limit(0)).where("contaminated or n_hit > 0").count() == 0
    left = decontaminate.decontaminate(docs(spark, texts), bench, most_words=most)
    assert left.columns == docs(spark, texts).columns and left.count() == sum(not r["contaminated"] for r in out)


def test_hit_words_taken_out(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    out = decontaminate.scan(docs(spark, ["Zéro, One -- two; THREE! four"]), bench, cleaned=True).first()
    assert out["text"] == "Zéro, ! four" and out["hit_spans"] == [(1, 4)]


# ---- substrings


@pytest.mark.parametrize(("crowd", "batch"), [(500, 10_000), (3, 10_000), (500, 3), (3, 2)])
def test_substring_against_brute_force(spark, crowd, batch):
    """Also with anchors dealt over several shares, and groups that go on over several batches."""
    shared = " ".join(words(45, 9))
    texts = [None, "", " ".join(words(19, 2)), " ".join(words(30, 2)), "x " * 60]
    for i in range(40):
        body = words(30 + i, 100 + i)
        texts.append(" ".join(body[:10]) + f"  {shared[: 60 + 5 * i]}\n" + " ".join(body[10:]))
    texts += [texts[7]] * 5 + [" ".join(w if k % 31 else "edit" for k, w in enumerate(texts[20].split())) for _ in range(3)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r["doc_id"]: r for r in substring.deduplicate(docs(spark, texts), crowd=crowd).collect()}
        named = docs(spark, texts).withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 5, "0")))
        assert {int(r["doc_id"][1:]): r["kept"] for r in substring.deduplicate(named, crowd=crowd).collect()} == {i: r["kept"] for i, r in got.items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    for i, kept in enumerate(brute.later(list(enumerate(texts)))):
        assert got[i]["kept"] == " ".join(kept) and got[i]["n_removed"] == got[i]["n_words"] - len(kept)


def test_substring_repeated_and_null_keys(spark):
    a, b = " ".join(words(30, 1)), " ".join(words(30, 2))
    rows = docs(spark, [a, a, b, a, None], [3, 3, None, 5, 3])
    got = sorted((r["doc_id"] or 99, r["n_words"], r["n_removed"]) for r in substring.deduplicate(rows).collect())
    assert got == [(3, 0, 0), (3, 30, 0), (3, 30, 30), (5, 30, 30), (99, 30, 0)]
    assert substring.deduplicate(rows.limit(0)).count() == 0


# ---- quality


def test_quality(spark):
    texts = [" ".join(words(60, i, 50) if i % 2 else [f"q{w}" for w in words(60, i, 50)]) for i in range(400)] + [None, "", texts_long()]
    marks = spark.createDataFrame([(i, 1) for i in range(1, 400, 4)] + [(None, 1)], "doc_id bigint, quality int")
    rows = docs(spark, texts).withColumn("draw", F.lit("clash"))
    out = quality.resample(rows, marks).collect()
    weight = {r["doc_id"]: r["log_weight"] for r in out}
    assert min(weight[i] for i in range(1, 400, 2)) > max(weight[i] for i in range(0, 400, 2)) and weight[400] == weight[401] == 0
    assert sum(r["selected"] for r in out) == -(-len(out) // 2)
    assert quality.resample(rows.limit(0), marks).count() == 0 and quality.resample(rows, marks.limit(0)).count() == len(texts)


def texts_long():
    return " ".join(words(30_000, 4))


@pytest.mark.parametrize("share", [0.0, 0.01, 0.5, 1.0])
def test_threshold_with_ties(spark, share):
    values = [float(i % 97) for i in range(5000)] + [1e9, -1e9]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    k = -int(-share * len(values) // 1)
    assert quality.threshold(rows, "x", share) == (sorted(values, reverse=True)[k - 1] if k else float("inf"))


# ---- pages


PAGES = {
    "article": ("<html><body><nav><a href='/'>Home</a></nav><header>Site</header><article><h1>Title &amp; more</h1><p><b>One,\n two.<br><p>Three &lt;four&gt;&nbsp;five</p><ul><li>x<li>y</ul></article><footer>&copy; 2</footer></body></html>", "Title & more\nOne, two.\nThree <four> five\nx\ny"),
    "divs": ("<body><div id=menu><a>a</a><a>b</a></div><div class='content'><p>" + "Long text, with commas, " * 9 + "</p><div class='comments'><p>" + "I disagree, strongly, " * 30 + "</p></div><script>var a='<p>no</p>';</script><p>End.</p></div><div class='cookie-notice'>We use cookies</div>", ("Long text, with commas, " * 9).strip() + "\nEnd."),
    "plain": ("just text, no marks", "just text, no marks"),
    "open": ("<article><p>one<p>two <!-- gone", "one\ntwo"),
    "cut tag": ("<article><p>one</p><p>two<a hre", "one\ntwo"),
    "form": ("<main><form><p>Name, please</p></form><p>Kept here, yes.</p><aside><p>related, things</p></aside></main>", "Kept here, yes."),
    "empty": ("<html><head><title>t</title></head><body></body></html>", ""),
    "loose word": ("<article><p>One, two.</p><div class='widget'><p>A tool in the text, kept.</p></div><div class='related'><a href=x>Other</a> <a href=y>more</a></div></article>", "One, two.\nA tool in the text, kept."),
    "firm word around": ("<body><div class='layout sidebar'><article><p>All of it, here.</p></article></div><div class='sidebar'><p>Not this, no.</p></div>", "All of it, here."),
    "firm words only": ("<div class='notice'><p>Nothing but this, here.</p></div>", "Nothing but this, here."),
    "links in main": ("<main><ul>" + "<li><a href=x>A link to some place</a>" * 30 + "</ul></main><div><p>" + "Text, and more of it, " * 9 + "</p></div>", ("Text, and more of it, " * 9).strip()),
    "sections": ("<article><section><h2>A</h2><p>One, two.</p></section><section><div><p>Three, four, five.</p></div></section><footer>f</footer></article>", "A\nOne, two.\nThree, four, five."),
    "table": ("<article><table><tbody><tr><td>a<td>b<tr><td>c</td><td>d</td></table><p>End, yes.</article>", "a b\nc d\nEnd, yes."),
    "hidden": ('<p title="' + "x" * 5000 + ' > hidden">in</p>', "in"),
    "quoted": ('<article><p title="a > b">in</p><p>a < b</p></article>', "in\na < b"),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, want = PAGES[name]
    assert html.extract(page) == want


@pytest.mark.parametrize("mark", ['"', "'"])
def test_long_and_many_quoted_values(mark):
    long = f"<b>{'x' * 100_000}</b> class=menu > y"
    many = " ".join(f"a{i}={mark}{i}{mark}" for i in range(500))
    assert html.extract(f"<article><div data-props={mark}{long}{mark}>Article</div></article>") == "Article"
    assert html.extract(f"<article><div {many} title={mark}a > b{mark}>Article</div></article>") == "Article"
    assert html.extract(f"<article><div {many} class={mark}{'x ' * 5000}menu{mark}>Menu</div><p>Article</p></article>") == "Article"


def test_unended_quotes_are_read_in_linear_time():
    started = time.process_time()
    for piece in ("<a b='", "<a b='>'", '<a b="', "<a ", "<a b='>\" ", "<a b='\"", "<a b=\"'>'"):
        for n in (20_000, 20_001):
            html.extract("<p>x" + piece * n)
            html.extract("<p>x" + piece * n + ">")
    assert time.process_time() - started < 20


@pytest.mark.parametrize("piece", ["<div>x", "<div>x</i>", "<i>x", "<td><i></b>x", "<header>x", "<li>x<b>", "<p>x<i>", "<div class=widget>A b.", "<table><tr><td>x", "<article><div class=ad>x"])
def test_deep_and_broken_pages_are_read_in_linear_time(piece):
    started = time.process_time()
    html.extract(piece * 50_000)
    assert time.process_time() - started < 5


def test_pages_odd(spark):
    rows = spark.createDataFrame([(1, "u", None, 5), (2, None, "", 5), (None, "u", "<p>x" * 20_000, 5), (2, "u", "<" * 50_000, 5), (3, "u", "<div>" * 5_000 + "deep", 5)], "page_id bigint, url string, html string, text int")
    out = html.main_text(rows).collect()
    assert len(out) == 5 and [len(r["text"]) for r in out if r["page_id"] is None] == [39_999]
    assert html.main_text(rows.limit(0)).count() == 0


# ---- licenses


def test_licenses_join_is_exact(spark):
    """Against every run of words of every paragraph."""
    notices = [("a", "the quick brown fox jumps", "fox"), ("b", "quick red fox", ""), ("c", "x", ""), ("d", "the red fox jumps over", "fox over")]
    rng = random.Random(6)
    texts = [None, "", "the QUICK brown fox\nred fox quick", "fox brown the jumps", "x\n\nx y", "lazy dog", "the quick brown\n--\nfox jumps"]
    texts += [" ".join(rng.choice("the quick brown fox jumps red over x lazy dog and \n \n\n".split(" ")) for _ in range(rng.randrange(60))) for _ in range(80)]
    out = licenses.scan(docs(spark, texts), notices=notices).collect()
    for r in out:
        want = {}
        lines = [brute.ALNUM.findall(x.translate(brute.LOWER)) for x in (texts[r["doc_id"]] or "").split("\n")]
        for start, end in licenses.paragraphs(lines):
            own = [w for line in lines[start:end] for w in line]
            runs = {}
            for label, text, telling in notices:
                wanted, width = set(text.split()), -(-len(text.split()) // 0.8)
                blocks = [(i, j, len(wanted & set(own[i:j]))) for i in range(len(own)) for j in range(i + 1, min(len(own), i + int(width)) + 1)]
                runs[label] = [(i, j, n) for i, j, n in blocks if n >= 0.8 * len(wanted) and set(telling.split()) <= set(own[i:j])]
            for label, text, _ in notices:
                best = max((n for i, j, n in runs[label] if not (label == "a" and any(i < y and x < j for x, y, _ in runs["d"]))), default=0)
                if best:
                    want[label] = max(want.get(label, 0), best / len(set(text.split())))
        got = {}
        for f in r["found"]:
            got[f["label"]] = max(got.get(f["label"], 0), f["share"])
        assert {k: v for k, v in got.items() if k != "a"} == {k: v for k, v in want.items() if k != "a"}, texts[r["doc_id"]]
        assert set(want) - {"a"} <= set(got) <= {k for k, _, _ in notices}
        assert all(lines[f["line"]] for f in r["found"])
    assert licenses.scan(docs(spark, texts).limit(0)).count() == 0


def test_license_phrases(spark):
    last = licenses.scan(docs(spark, ["under the MIT license. Apache License, Version 2.0; CC-BY-NC under the mit license"])).first()
    assert (last["n_base"], last["first_word"], last["last_word"], last["base_labels"]) == (4, 0, 12, ["apache-2", "cc-by-nc", "mit"])


_GPL = "This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation"
LICENSED = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction": "mit",
    "The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.": "mit",
    "Released under the MIT License.": "mit",
    "released under the License": "",
    f" * {_GPL}, either version 3 of the License, or": "gpl-3",
    f" * {_GPL}; either version 2\n * of the License, or (at your option) any later version": "gpl-2",
    f"{_GPL}.": "gpl",
    "licensed under the GNU General Public License": "gpl",
    "licensed under the GNU Lesser General Public License": "lgpl",
    "licensed under the GNU Affero General Public License, version 3": "agpl-3",
    "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\r\n# are met:": "bsd",
    "This work is licensed under CC BY 4.0.": "cc-by",
    "This work is licensed under CC BY-SA 4.0.": "cc-by-sa",
    "licensed under CC-BY-NC-SA 4.0": "cc-by-nc,cc-by-nc-sa",
    "licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
    "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
    "\n\n".join(f"{w} a b c" for w in _GPL.split()): "",
    "Licensed under the Apache License,\nVersion 2.0 (the License); you may not use this file except in compliance with the License.": "apache-2",
    "the software " * 3000 + "is licensed under CC BY 4.0 " + "by the license of a 4.0 general public nc sa " * 300: "cc-by",
}


def test_labels_of_licenses_and_their_sql(spark):
    """Labels of usual notices, wrapped or not; and the SQL over the same texts."""
    texts = [f"Some code here\n\n{x}\n\nmore of it\n" for x in LICENSED] + [f"A head\n{_GPL}\nand\n" + "Released under the MIT License\n" * 3 + "end", None, ""]
    rows = docs(spark, texts)
    got = {r["doc_id"]: r for r in licenses.scan(rows).collect()}
    assert {x: ",".join(got[i]["labels"]) for i, x in enumerate(LICENSED)} == LICENSED
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    for i, *row in con.execute(queries.OP10_SQL).fetchall():
        r = got[i]
        assert row == [r["n_words"], r["n_base"], r["first_word"], r["last_word"], ",".join(r["base_labels"]), ",".join(r["labels"]), r["score"]], texts[i]


# ---- the pipeline


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    out, before = docs_, docs_.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, sf)
        assert out.columns == before, name
    rows = corpus_pipeline.run(spark, sf).collect()
    assert 0 < len(rows) < docs_.count() and all(r["copies"] > 0 or r["part"] > 0 for r in rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs_.limit(0), sf).count() == 0


def test_clashing_columns_are_replaced(spark):
    rows = docs(spark, ["under the mit license a@b.cd", None, ""])
    for name in ("n_words", "N_HIT", "contaminated", "score", "found", "labels", "pii_text", "base_email", "pii_spans", "Text_", "size", "draw", "fp"):
        rows = rows.withColumn(name, F.lit("clash"))
    bench = spark.createDataFrame([(1, "mit license a")], "item_id bigint, text string")
    assert decontaminate.scan(rows, bench).agg(F.sum("n_hit")).first()[0] == 3
    assert licenses.scan(rows).agg(F.sum("n_base")).first()[0] == 1
    assert pii.find(rows).agg(F.sum(F.size("base_email"))).first()[0] == 1
    assert toxicity.score(rows, toxicity.Model({}, 0.0)).select("score").distinct().collect()[0][0] == 0.5
    assert len(simhash.near_duplicates(rows).collect()) == len(substring.deduplicate(rows).collect()) == len(mixing.mix(rows).collect()) == 3
    assert simhash.deduplicate(rows).columns == rows.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, rows, "/root/testdata/sf0.001").columns == rows.columns, name


def test_cut_off():
    positive, unlabelled = np.array([3.0, 3, 2, 0]), np.r_[np.zeros(90), 2, 3, 3, -1, -1, -1, -1, -1, -1, -1]
    assert toxicity.cut_off(positive, unlabelled, 0.04) == 1.0
    assert toxicity.cut_off(np.zeros(5), np.zeros(50), 0.1) > 0  # nothing tells them apart: nothing is toxic
