"""Merging of entities against a plain version, over generated entities; numbering in ranges against one window."""

import random
import unicodedata

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions.constants import LEGAL_FORMS, PUNCTUATION
from palimpsest.operators import entities
from palimpsest.sources.tables import numbered

SCHEMA = "job_id string, id string, category string, value string, variants array<string>, source string, inflect boolean, seq int"


def key(value):
    folded = unicodedata.normalize("NFKC", value).casefold()
    return " ".join("".join(" " if c in PUNCTUATION else c for c in folded).split())


def legal(value):
    return any(w in LEGAL_FORMS for w in key(value).split())


def bare(value):
    return " ".join(w for w in key(value).split() if w not in LEGAL_FORMS)


def plain(rows):
    """One job's entities, step by step, by spelling: who stands for a name, who is a variant of one other, which company has one full name, what is contested."""
    order = sorted(rows, key=lambda r: (-legal(r["value"]), -len(" ".join(unicodedata.normalize("NFKC", r["value"]).split())), r["source"] != "rule", r["seq"]))
    left = [dict(r, variants=list(dict.fromkeys(r["variants"]))) for r in order]

    def into(owner, other):
        owner["variants"] += [f for f in dict.fromkeys([other["value"], *other["variants"]]) if f not in [owner["value"], *owner["variants"]]]
        owner["inflect"] |= other["inflect"]
        owner["source"] = "rule" if "rule" in (owner["source"], other["source"]) else owner["source"]
        owner["category"] = other["category"] if owner["category"].upper() == "OTHER" else owner["category"]

    def claimants(k):
        return [e for e in left if k and k != key(e["value"]) and k in map(key, e["variants"])]

    for e in list(left):
        same = next(o for o in left if key(o["value"]) == key(e["value"]))
        if same is not e:
            into(same, e)
            left.remove(e)
    known, gone = {e["id"]: [o["id"] for o in claimants(key(e["value"])) if o is not e] for e in left}, []
    for e in list(left):
        owners = known[e["id"]]
        if len(owners) == 1 and owners[0] not in gone:
            into(next(o for o in left if o["id"] == owners[0]), e)
            gone.append(e["id"])
    left = [e for e in left if e["id"] not in gone]
    companies = [e for e in left if e["category"].upper() == "ORG"]
    full = {e["id"]: [o for o in companies if legal(o["value"]) and bare(o["value"]) == key(e["value"])] for e in companies if not legal(e["value"])}
    for e in companies:
        if len(full.get(e["id"], [])) == 1:
            into(full[e["id"]][0], e)
            left.remove(e)
    contested = {k for e in left for k in map(key, e["variants"]) if len(claimants(k)) > 1}
    return [dict(e, variants=[f for f in e["variants"] if key(f) == key(e["value"]) or key(f) not in contested]) for e in left]


def generated(seed, n):
    rng, rows = random.Random(seed), []
    names = ["Ромашка", "Лукойл", "МегаФон", "Acme", "Иванов И.И.", "Иванов Иван"]

    def spelled():
        name = rng.choice(names)
        name = rng.choice([name, name, name.upper(), f"«{name}»", f'"{name}"'])
        return rng.choice([name, name, f"ООО {name}", f"ПАО {name}", f"{name} LLC", f"{name},  ЗАО"])

    for i in range(n):
        rows.append({"job_id": "j" if i % 2 else "k", "id": str(i), "category": rng.choice(["ORG", "ORG", "OTHER", "PERSON"]), "value": spelled(), "variants": [spelled() for _ in range(rng.randrange(3))], "source": rng.choice(["llm", "rule"]), "inflect": rng.random() < 0.2, "seq": i})
    return rows


def shown(rows):
    return sorted((r["job_id"], r["id"], r["category"], r["value"], tuple(sorted(r["variants"])), r["source"], r["inflect"]) for r in rows)


@pytest.mark.parametrize("whole", [True, False])
def test_merge_of_generated_entities(spark, whole):
    for seed in range(12):
        rows = generated(seed, 14)
        df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
        got = (entities.merge if whole else entities.merged)(df).collect()
        assert shown(r.asDict() for r in got) == shown(x for job in "jk" for x in plain([r for r in rows if r["job_id"] == job])), seed


def test_own_spellings_stay(spark):
    rows = [("j", "1", "ORG", "Ромашка", ["РОМАШКА"], "llm", False, 1), ("j", "2", "ORG", "ООО «Ромашка»", ["Ромашка"], "llm", False, 2), ("j", "3", "ORG", "ПАО «Ромашка»", ["Ромашка"], "llm", False, 3)]
    got = {r["id"]: r["variants"] for r in entities.merge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"1": ["РОМАШКА"], "2": [], "3": []}


def test_numbers_are_those_of_one_window(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None, "c"]), rng.randrange(50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, x int, id int").repartition(7)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("x"), "id")))
    for scope in ([F.col("k")], []):
        want = df.withColumn("n", F.row_number().over(Window.partitionBy(*scope, F.lit(0)).orderBy(F.desc("x"), "id")))
        assert sorted(r["n"] * 10_000 + r["id"] for r in numbered(df, "n", scope, [F.desc("x"), F.col("id")]).collect()) == sorted(r["n"] * 10_000 + r["id"] for r in want.collect())
