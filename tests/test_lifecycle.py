"""Analyse, redact and restore; streams; jobs."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.messages import message
from palimpsest.operators import jobs, manifest, redact
from palimpsest.plans import lifecycle
from palimpsest.sources import model, ooxml, prompts
from palimpsest.streaming import incremental, tags

TEXTS = ["Write to Ann@x.org or ann@x.org\nCall +7 (495) 123-45-67", "ann@x.org again, ANN@X.ORG.", None, ""]


def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")


def test_all_spellings_of_a_value_are_replaced(spark):
    docs = frame(spark)
    found = lifecycle.analyse(docs)
    rows = {r["category"]: r for r in found.collect()}
    assert rows["EMAIL"]["total"] == 4 and set(rows["EMAIL"]["variants"]) == {"ann@x.org", "ANN@X.ORG"}
    out = {r["doc_id"]: r for r in lifecycle.redact_documents(docs, found).collect()}
    assert "@" not in out[0]["text"] + out[1]["text"] and out[0]["replacements"] == 3
    assert out[0]["text"] == "Write to [[EMAIL_001]] or [[EMAIL_001]]\nCall [[PHONE_001]]"
    assert out[2]["text"] is None and out[3]["text"] == ""


def test_findings_join_in(spark):
    docs = spark.createDataFrame([(1, "Иванову и Петрову писал Иванов"), (2, "клиент")], "doc_id bigint, text string")
    found = spark.createDataFrame([(1, "person", "Иванов", 1), (1, "weird", "Петрову", 2), (2, "ORG", "клиент", 1)], "doc_id bigint, category string, value string, seq int")
    rows = {r["value"]: r for r in lifecycle.analyse(docs, findings=found).collect()}
    assert rows.keys() == {"Иванов", "Петрову"} and rows["Иванов"]["total"] == 2 and rows["Петрову"]["category"] == "OTHER"


def test_key_file_round_trip(spark):
    body = redact.key_file("j", "2024-01-01T00:00:00+00:00", [], [{"tag": "[[A_001]]", "value": "ю", "category": "A", "variants": [], "replacements": 1}])
    rows = redact.parsed_mapping(spark.createDataFrame([("j", "﻿" + body), ("k", "not json")], "job_id string, content string")).collect()
    assert [(r["job_id"], r["tag"], r["value"]) for r in rows] == [("j", "[[A_001]]", "ю")]


def test_stream_is_as_batch(spark, tmp_path):
    rules = [{"value": "ann@x.org", "variants": [], "inflect": False, "tag": "[[EMAIL_001]]"}]
    docs = frame(spark).withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    docs.unionByName(docs).write.parquet(str(tmp_path / "in"))
    stream = incremental.redacted_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), rules, key="doc_id", at="at")
    incremental.write(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r["doc_id"], r["text"], r["replacements"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r["doc_id"], r["text"], r["replacements"]) for r in redact.redact(docs, rules).collect()}


def test_sessions_expire(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 03:00:00"), ("b", "2024-01-01 00:00:00"), ("c", "2024-01-03 00:00:00")], "job_id string, t string").select("job_id", F.col("t").cast("timestamp").alias("at"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = incremental.last_activity(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    incremental.write(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r["job_id"], r["events"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 2), ("b", 1)}


def test_model_scan_and_review(spark):
    docs = spark.createDataFrame([(1, "Acme met Bolt.\nAcme left."), (2, "nothing"), (3, None)], "doc_id bigint, text string")
    found, warned = lifecycle.scan(docs, model.gazetteer({"org": ["Acme", "Bolt"]}))
    assert warned.count() == 0
    first = lifecycle.analyse(docs, findings=found)
    rows = {r["value"]: r for r in first.collect()}
    assert {k: r["total"] for k, r in rows.items()} == {"Acme": 2, "Bolt": 1}
    patches = spark.createDataFrame([(rows["Bolt"]["entity_id"], None, None, ["nothing"], "person", 1), (rows["Acme"]["entity_id"], False, None, None, None, 2)], "id string, selected boolean, inflect boolean, variants array<string>, category string, seq int")
    after = {r["value"]: r for r in lifecycle.review(first, patches, docs).collect()}
    assert after["Bolt"]["total"] == 2 and after["Bolt"]["category"] == "PERSON" and not after["Acme"]["selected"]
    out = lifecycle.redact_documents(docs, lifecycle.review(first, patches, docs))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "Acme met [[PERSON_001]].\nAcme left.", 2: "[[PERSON_001]]", 3: None}


COMPANIES = "Компания ООО «Ромашка» и ПАО «Ромашка» спорят. РОМАШКА молчит, Ромашка тоже. ПАО «МегаФон», он же МегаФон, платит. Иванов Иван Иванович пришёл, Иванова И.И. ждали. И.И. Иванов ушёл."


def companies(spark):
    docs = spark.createDataFrame([(1, COMPANIES), (2, "МегаФон. Мегафончик."), (3, None)], "doc_id bigint, text string")
    rows = [("ORG", "ООО «Ромашка»", []), ("ORG", "ПАО «Ромашка»", []), ("ORG", "Ромашка", ["РОМАШКА"]), ("ORG", "ПАО «МегаФон»", []), ("ORG", "МегаФон", []), ("PERSON", "Иванов Иван Иванович", []), ("PERSON", "нигде", ["Не Здесь"])]
    found = spark.createDataFrame([(1, *r, i) for i, r in enumerate(rows)], "doc_id bigint, category string, value string, aliases array<string>, seq int")
    return docs, found


def test_spellings_of_one_thing_are_one_entity(spark):
    docs, found = companies(spark)
    reviewed = lifecycle.analyse(docs, findings=found)
    rows = {r["value"]: r for r in reviewed.collect()}
    assert rows.keys() == {"ООО «Ромашка»", "ПАО «Ромашка»", "Ромашка", "ПАО «МегаФон»", "Иванов Иван Иванович"}
    # The bare name belongs to neither company; its own other spelling stays with it.
    assert rows["ООО «Ромашка»"]["variants"] == rows["ПАО «Ромашка»"]["variants"] == [] and rows["Ромашка"]["variants"] == ["РОМАШКА"]
    assert rows["ПАО «МегаФон»"]["variants"] == ["МегаФон"] and rows["ПАО «МегаФон»"]["total"] == 3 and rows["ПАО «МегаФон»"]["documents"] == 2
    assert set(rows["Иванов Иван Иванович"]["variants"]) >= {"Иванов И.И.", "И.И. Иванов"} and rows["Иванов Иван Иванович"]["total"] == 3
    out = {r["doc_id"]: r["text"] for r in lifecycle.redact_documents(docs, reviewed).collect()}
    assert not any(w in out[1] + out[2] for w in ("Иванов", "Ромашка", "РОМАШКА", "МегаФон.")) and "Мегафончик" in out[2]


def test_tag_shaped_text_is_not_taken_for_a_tag(spark):
    docs = spark.createDataFrame([(1, "see [[EMAIL_004]] and a@b.org"), (2, "[[EMAIL_x]] [[odd_9]]")], "doc_id bigint, text string")
    out = lifecycle.redact_documents(docs, lifecycle.analyse(docs)).orderBy("doc_id").first()
    assert out["text"] == "see [[EMAIL_004]] and [[EMAIL_005]]"


def test_packages_there_and_back(spark):
    texts = {"in/a.docx": "Write to ann@x.org\nor +7 (495) 123-45-67", "in/b/a.docx": "ann@x.org again", "in/bad.docx": None}
    files = spark.createDataFrame([(k, b"broken" if v is None else ooxml.as_package(v)) for k, v in texts.items()], "path string, content binary")
    own = lifecycle.Settings(prefix="<<", suffix=">>")
    outputs, found = lifecycle.redact_packages(files, lifecycle.analyse(lifecycle.package_texts(files), own), own)
    outputs = outputs.persist()
    assert {r["path"]: r["error"] for r in outputs.collect()} == {"in/a.docx": None, "in/b/a.docx": None, "in/bad.docx": "not_ooxml"}
    hidden = {r["doc_id"]: r["text"] for r in lifecycle.package_texts(outputs.where("error is null")).collect()}
    assert hidden == {"in/a.docx": "Write to <<EMAIL_001>>\nor <<PHONE_001>>", "in/b/a.docx": "<<EMAIL_001>> again"}
    key = lifecycle.package_key(outputs, found, "j", "2024-01-01T00:00:00+00:00", own)
    assert {e["tag"]: e["replacements"] for e in json.loads(key)["entities"]} == {"<<EMAIL_001>>": 2, "<<PHONE_001>>": 1}
    archive = zipfile.ZipFile(io.BytesIO(lifecycle.bundle(outputs, "j", key).first()["archive"]))
    assert len(archive.namelist()) == 3 and {"a__redacted.docx", "mapping.json"} < set(archive.namelist())
    mapping = redact.parsed_mapping(spark.createDataFrame([("j", key)], "job_id string, content string"))
    # The key's delimiters count, whatever the settings are.
    back = lifecycle.restore_packages(outputs.where("error is null"), mapping)
    assert {r["doc_id"]: r["text"] for r in lifecycle.package_texts(back).collect()} == {k: v for k, v in texts.items() if v}
    assert {r["name"] for r in back.collect()} == {"a__restored.docx"}
    some = spark.createDataFrame([(1, "<<EMAIL_001>> <<X_9>> [[X_9]]")], "doc_id bigint, text string")
    assert lifecycle.restore_documents(some, mapping).first()["text"] == "ann@x.org <<X_9>> [[X_9]]"
    assert [r["tag"] for r in lifecycle.unmapped_tags(some, mapping).collect()] == ["<<X_9>>"]


def test_purge(spark, tmp_path):
    for name in ("old", "new", "other"):
        (tmp_path / name / "source").mkdir(parents=True)
        (tmp_path / name / "source" / "f").write_text("x")
    rows = spark.createDataFrame([("old",), ("gone",), ("../x",), (None,)], "job_id string")
    assert jobs.purge(spark, str(tmp_path), rows) == ["old"] and sorted(p.name for p in tmp_path.iterdir()) == ["new", "other"]


def test_what_a_model_does_wrong(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["raise", "think", "prose", "shape", "fine"])], "doc_id bigint, text string")

    def client(messages):
        text = messages[-1]["content"]
        if "raise" in text:
            raise TimeoutError("late")
        said = {"think": "<think>{", "prose": "none", "fine": '```json\n{"entities": [{"text": "x y"}, 3]}\n```'}
        own = next((v for k, v in said.items() if k in text), None)
        return "{}" if own is None else json.dumps({"data": {"choices": [{"message": {"content": own}}]}})

    answers = model.replies(lifecycle.chunks.chunks(lifecycle.paragraphs(docs)), client)
    assert {r["doc_id"]: r["code"] for r in model.warnings(answers).collect()} == {0: "model_failed", 1: "model_unclosed", 2: "model_no_json", 3: "model_failed"}


def test_settings_of_the_environment():
    own = lifecycle.Settings.from_env({"PALIMPSEST_DETECTORS": "EMAIL, URL,", "PALIMPSEST_CHUNK_CHARS": "50", "PALIMPSEST_PREFIX": "<"})
    assert (own.detectors, own.chunk_chars, own.prefix, own.suffix) == (("EMAIL", "URL"), 50, "<", "]]")
    assert own.endpoint() is None and own.case_sensitive
    own = lifecycle.Settings.from_env({"PALIMPSEST_MODEL_URL": "http://h", "PALIMPSEST_MODEL_NAME": "m", "PALIMPSEST_MODEL_TIMEOUT": "2.5", "PALIMPSEST_CASE_SENSITIVE": "false", "PALIMPSEST_MODEL_EXTRA_HEADERS": '{"A": 1}', "PALIMPSEST_MODEL_EXTRA_BODY": "no"})
    assert own.endpoint() == model.Endpoint("http://h", "m", timeout=2.5, extra_headers=(("A", "1"),)) and not own.case_sensitive


def test_prompt_files(tmp_path):
    (tmp_path / "a.json").write_text('[{"task": "do {x}", "examples": " ", "other": 1}]')
    own = prompts.Template.read(str(tmp_path / "a.json"))
    assert own.layers == (("task", "do {x}"),) and own.needs() == {"x"}
    assert own.render({"x": "{y}"}) == [{"role": "user", "content": "[LAYER 1/1]\ndo {y}"}]
    with pytest.raises(KeyError):
        own.render({})
    for odd in ("[]", '{"other": "x"}', '{"task": "  "}', "3"):
        (tmp_path / "b.json").write_text(odd)
        with pytest.raises(ValueError):
            prompts.Template.read(str(tmp_path / "b.json"))
    both = prompts.Template.of([{"schema_contract": "a"}, {"task": "b"}]).render({})
    assert [m["role"] for m in both] == ["user", "assistant", "user"] and both[2]["content"] == "[LAYER 2/2]\nb"


def test_messages():
    assert message("file_too_large", "en", name="a", mb=50) == "a: larger than 50 MB."
    assert message("unmapped_tags", "xx", count=1) == "Меток без значения: 1 ({tags})." and message("odd") == "odd"


def test_archives(spark):
    rows = spark.createDataFrame([("j", "b.docx", b"2"), ("j", "a.docx", b"1"), ("k", "mapping.json", b"{}")], "job_id string, member string, content binary")
    got = {r["job_id"]: zipfile.ZipFile(io.BytesIO(r["archive"])) for r in manifest.archives(rows).collect()}
    assert got["j"].namelist() == ["a.docx", "b.docx"] and got["k"].read("mapping.json") == b"{}"


def test_tags_of_a_stream_never_change(spark, tmp_path):
    schema = "job_id string, category string, key string, value string"
    for name, rows in (("1", [("j", "ORG", "b", "B"), ("j", "ORG", "a", "A"), ("j", "id no", "x", "X")]), ("2", [("j", "ORG", "a", "A"), ("j", "ORG", "0", "O"), ("k", "ORG", "a", "A")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = tags.append_only_tags(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        incremental.write(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r["job_id"], r["key"]): r["tag"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("j", "a"): "[[ORG_001]]", ("j", "b"): "[[ORG_002]]", ("j", "x"): "[[ID_NO_001]]", ("j", "0"): "[[ORG_003]]", ("k", "a"): "[[ORG_001]]"}


@pytest.mark.parametrize("mark", ["\u0301", "\u200d", "\u203f"])
def test_a_value_beside_a_mark_is_counted_and_replaced(spark, mark):
    """What is found only beside a combining mark or a joiner was dropped as standing nowhere, and stayed in the text; a numeral still belongs to the value."""
    phone, mail = "+1 (415) 555-0199", "ann@x.org"
    docs = spark.createDataFrame([(1, f"a {phone}{mark} b"), (2, f"{mark}{mail}{mark}"), (3, f"{phone}\u00b2 Zoe")], "doc_id bigint, text string")
    found = lifecycle.analyse(docs, lifecycle.Settings(detectors=("EMAIL", "PHONE")))
    assert {(r["value"], r["total"], r["documents"]) for r in found.collect()} == {(phone, 1, 1), (mail, 1, 1)}
    want = {1: f"a [[PHONE_001]]{mark} b", 2: f"{mark}[[EMAIL_001]]{mark}", 3: f"{phone}\u00b2 Zoe"}
    assert {r["doc_id"]: r["text"] for r in lifecycle.redact_documents(docs, found).collect()} == want
    tags = [{"value": v, "variants": [], "inflect": False, "tag": t} for v, t in ((phone, "[[PHONE_001]]"), (mail, "[[EMAIL_001]]"))]
    assert {r["doc_id"]: r["text"] for r in redact.redact(docs, tags, native_chars=0).collect()} == want
