"""Column functions and patterns against Python's own."""

import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import display, sql
from palimpsest.functions import text as T
from palimpsest.functions.constants import DETECTORS
from palimpsest.operators import detect, redact
from palimpsest.operators.leaves import write_back

ALPHABET = "Иванов Мария ООО «Ромашка» a@b.ru +7(495) 123-45-67 https://x.y ИНН 7707083893 \"'-–—\n.,;ß"


def samples(n, seed):
    rng = random.Random(seed)
    parts = ALPHABET.split(" ") + list(ALPHABET)
    return ["".join(rng.choice(parts) + rng.choice(["", " ", "", "\n"]) for _ in range(rng.randrange(25))) for _ in range(n)]


def test_normal_forms(spark):
    rows = samples(300, 1) + ["№ 5", "ﬁ", "  ", "Ｆｕｌｌ", "STRASSE ß"]
    got = spark.createDataFrame([(x,) for x in rows], "x string").select("x", T.normalise(F.col("x")).alias("n"), T.dedup_key(F.col("x")).alias("k")).collect()
    for r in got:
        want = unicodedata.normalize("NFKC", r["x"])
        want = " ".join(re.sub("[«»“”‘’\"']", '"', re.sub("[-‐-―]", "-", want)).split())
        assert r["n"] == want and r["k"] == want.casefold()


@pytest.mark.parametrize("name", DETECTORS)
def test_detectors_read_as_python_does(spark, name):
    _, pattern, group = DETECTORS[name]
    rows = samples(400, 2)
    got = spark.createDataFrame(list(enumerate(rows)), "i int, text string").select("i", detect.values(F.col("text"), name).alias("v")).collect()
    for r in got:
        found = [m.group(group).strip(" .,;:") for m in re.finditer(pattern, rows[r["i"]])]
        assert r["v"] == [v for v in found if v]


def test_own_detector(spark):
    detect.register("ticket", "SYSTEM", r"TICKET-(\d+)", 1)
    rows = spark.createDataFrame([(1, "see TICKET-42, ticket-9"), (2, None)], "doc_id int, text string")
    assert [(r["category"], r["value"]) for r in detect.hits(rows, names=["Ticket", "nothing"]).collect()] == [("SYSTEM", "42")]


PEOPLE = [
    {"value": "Иванов", "variants": ["Иванов И.И."], "inflect": True, "tag": "[[PERSON_001]]"},
    {"value": "Иванов Иван Иванович", "variants": [], "inflect": True, "tag": "[[PERSON_002]]"},
    {"value": 'ООО "Ромашка"', "variants": ["Ромашка"], "inflect": False, "tag": "[[ORG_001]]"},
    {"value": "a@b.ru", "variants": [], "inflect": False, "tag": "[[EMAIL_001]]"},
]


def test_one_pass_is_what_a_compiled_pattern_does(spark):
    rules = redact.alternation(PEOPLE)
    whole = re.compile("|".join(f"(?P<e{i}>{p})" for i, (_, p) in enumerate(rules)))
    rows = [*samples(1500, 3), "Иванов Иван Иванович и Иванову", "ООО «Ромашка»", "", "Ивановский"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    native = {r["doc_id"]: r for r in redact.redact(df, PEOPLE).collect()}
    joined = {r["doc_id"]: r for r in redact.redact(df, PEOPLE, native_chars=0).collect()}
    for i, x in enumerate(rows):
        want, n = whole.subn(lambda m: rules[int(m.lastgroup[1:])][0], x)
        assert native[i]["text"] == joined[i]["text"] == want and native[i]["replacements"] == joined[i]["replacements"] == n


def test_short_and_long_lists_replace_alike(spark):
    """On both sides of the size at which texts are joined with what they may have; combining marks and null texts too."""
    own = [{"value": v, "variants": [v.upper()], "inflect": False, "tag": f"[[X_{i:03d}]]"} for i, v in enumerate(["Zoe", "Zoe Ann", "a-b", "№", "x y", "y"])]
    rows = ["Zoe\u0308 Zoe", "ZOE ANN and Zoe Ann", "a–b, a-b", "№ 5", "x  y y", None, "", "nothing", "Zoe"] * 3
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    long = own + [{"value": f"absent{i} word{i}", "variants": [], "inflect": False, "tag": f"[[Y_{i:03d}]]"} for i in range(600)]
    assert sum(len(p) for _, p in redact.alternation(long)) > redact.NATIVE_CHARS
    short = [tuple(r) for r in redact.redact(df, own).orderBy("doc_id").collect()]
    assert short == [tuple(r) for r in redact.redact(df, long).orderBy("doc_id").select("doc_id", "text", "replacements").collect()]
    assert short[0][1:] == ("Zoe\u0308 [[X_000]]", 1) and short[5][1:] == (None, 0)


def test_any_case(spark):
    df = spark.createDataFrame([(1, "ИВАНОВУ, иванов и Иванов; Ann@X.org ANN@x.ORG")], "doc_id int, text string")
    own = [{"value": "Иванов", "variants": [], "inflect": True, "tag": "[[P_001]]"}, {"value": "ann@x.org", "variants": [], "inflect": False, "tag": "[[E_001]]"}]
    want = "[[P_001]], [[P_001]] и [[P_001]]; [[E_001]] [[E_001]]"
    assert [redact.redact(df, own, any_case=True, native_chars=n).first()["text"] for n in (20_000, 0)] == [want] * 2
    assert redact.redact(df, own).first()["replacements"] == 1


def test_restore_after_redact(spark):
    plain = [{"value": v, "variants": [], "inflect": False, "tag": f"[[X_{i:03d}]]"} for i, v in enumerate(["a@b.ru", "Мария", "https://x.y"])]
    rows = samples(400, 4)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    mapping = spark.createDataFrame([(e["tag"], e["value"]) for e in plain], "tag string, value string")
    back = redact.restore(redact.redact(df, plain), mapping)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == dict(enumerate(rows))
    assert back.agg(F.sum("unmapped")).first()[0] == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab ", max_size=6), max_size=6), st.text("ab", min_size=1, max_size=3))
def test_write_back(texts, needle):
    joined = "".join(texts)
    spans = [(m.start(), m.end(), "[X]") for m in re.finditer(re.escape(needle), joined)]
    live = [t for t in texts if t]
    assert "".join(write_back(live, spans)) == joined.replace(needle, "[X]")


def test_functions_of_sql(spark):
    sql.register(spark)
    rows = samples(60, 7)
    spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT doc_id, d.rule, d.match_ord, d.value FROM texts, LATERAL detect(text) d").collect()
    want = detect.hits(spark.table("texts")).select("doc_id", "rule", "match_ord", "value").where("rule <> 'TICKET'").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert spark.sql("SELECT fold_case(normalise_nfkc('Straße ﬁ'))").first()[0] == "strasse fi"


def test_sizes_between_two_tenths_go_to_the_even_one(spark):
    """As the query's SQL prints them: 2.25 MB is 2.2, not 2.3."""
    quarters = [1536**2, 2560**2, 7680**2, 10752**2, 1048576 + 262144, 1048576 + 786432]
    rows = [0, 1023, 1024, 1536, 1048575, 1048576, *quarters, *(q + d for q in quarters for d in (-1, 1)), (1 << 50) + 262144]
    got = spark.createDataFrame([(x,) for x in rows], "n bigint").select("n", display.size_text(F.col("n")).alias("x")).collect()
    for n, x in got:
        assert x == (f"{n} B" if n < 1024 else f"{int(n / 1024 + 0.5)} KB" if n < 1048576 else f"{n / 1048576:.1f} MB")
    assert dict(got)[1536**2] == "2.2 MB"


def test_what_stands_beside_a_value_is_read_as_python_does(spark):
    """Two numbers with one character between are both found; marks and joiners end no word and hide nothing, numbers of any kind do."""
    phone, mail = "+1 (415) 555-0199", "ann@x.org"
    rows = [f"{v}{c}{w}" for v in (phone, mail) for w in (v, "") for c in (" ", "\n", ",", "\u0301", "\u200d", "\u200c", "\u203f", "\u00b2", "\u2461", "\u0967", "_", "a")]
    rows += [c + v for v in (phone, mail) for c in ("\u0301", "\u200d", "\u203f", "\u00b2", "\u2461", "_", " ")]
    for name in ("PHONE", "EMAIL"):
        _, pattern, group = DETECTORS[name]
        got = spark.createDataFrame(list(enumerate(rows)), "i int, text string").select("i", detect.values(F.col("text"), name).alias("v")).collect()
        assert {rows[r["i"]]: r["v"] for r in got} == {x: [v for m in re.finditer(pattern, x) if (v := m.group(group).strip(" .,;:"))] for x in rows}
    both = spark.createDataFrame([(1, f"{phone} {phone}\n{phone}")], "doc_id int, text string")
    assert [r["value"] for r in detect.hits(both, names=["PHONE"]).collect()] == [phone] * 3
