"""Office packages: text across runs, everything else untouched."""

import io
import re
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import redact
from palimpsest.plans import lifecycle
from palimpsest.sources import ooxml

W, A, X = (f'xmlns:{p}="{u}"' for p, u in (("w", ooxml.WORD), ("a", ooxml.DRAWING), ("x", ooxml.SHEET)))
STAMP = (2021, 5, 4, 3, 2, 0)


def package(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i, (name, data) in enumerate(members.items()):
            info = zipfile.ZipInfo(name, STAMP)
            info.compress_type, info.external_attr = (zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED)[i % 2], 0o644 << 16
            z.writestr(info, data)
    return out.getvalue()


DOCX = package({
    "[Content_Types].xml": "<Types/>",
    "word/document.xml": f"""<?xml version="1.0" encoding="UTF-8"?><w:document {W}><w:body><w:p><w:r><w:t>Ива</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">н Ив</w:t></w:r><w:r><w:t>анов &amp; Co</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>Иван Иванов</w:t></w:r><w:pict><w:txbxContent><w:p><w:r><w:t>Иван</w:t></w:r></w:p></w:txbxContent></w:pict><w:r><w:t> тут</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
<w:del w:author="Иван" w:id="1"><w:r><w:delText>Иван Иванов</w:delText></w:r></w:del></w:body></w:document>""",
    "word/theme/theme1.xml": f"<a:theme {A}><a:t>Иван Иванов</a:t></a:theme>",
    "word/media/image1.png": b"\x89PNG\x00\xff",
    "word/broken.xml": "<w:p>Иван Иванов",
    "docProps/core.xml": '<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:creator>Иван</dc:creator><dc:title>kept</dc:title><cp:lastModifiedBy/></cp:coreProperties>',
})
XLSX = package({
    "xl/sharedStrings.xml": f"<x:sst {X}><x:si><x:r><x:t>Иван Ив</x:t></x:r><x:r><x:t>анов</x:t></x:r></x:si><x:si><x:t>12</x:t></x:si></x:sst>",
    "xl/worksheets/sheet1.xml": f'<x:worksheet {X}><x:c t="n"><x:v>42</x:v><x:f>IF(A1="Иван Иванов",1)</x:f></x:c><x:c><x:is><x:t>Иван Иванов</x:t></x:is></x:c></x:worksheet>',
    "xl/calcChain.xml": "<calcChain/>",
})
RULES = redact.alternation([{"value": "Иван Иванов", "variants": ["Иван"], "inflect": False, "tag": "[[PERSON_001]]"}])


def changed(path, content, **how):
    pattern = re.compile("|".join(p for _, p in RULES))
    return ooxml.rewritten(path, content, pattern, lambda m: "[[PERSON_001]]", **how)


def members(content):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return {i.filename: (z.read(i), i.date_time, i.compress_type, i.external_attr) for i in z.infolist()}


def test_split_runs_and_nesting():
    found = ooxml.extract("a.docx", DOCX)
    assert ["".join(x[3]) for x in found] == ["Иван Иванов & Co", "Иван Иванов тут", "Иван"]


def test_docx():
    new, n = changed("a.docx", DOCX)
    before, after = members(DOCX), members(new)
    assert n == 3 and list(before) == list(after)
    assert all(before[k][1:] == after[k][1:] for k in before)
    for same in ("[Content_Types].xml", "word/theme/theme1.xml", "word/media/image1.png", "word/broken.xml"):
        assert before[same] == after[same]
    body = after["word/document.xml"][0].decode()
    assert '<w:t xml:space="preserve">[[PERSON_001]]</w:t>' in body and "<w:b/>" in body and " &amp; Co</w:t>" in body
    assert '<w:del w:author="REDACTED" w:id="1">' in body and "<w:delText>Иван Иванов</w:delText>" in body
    assert after["docProps/core.xml"][0].decode() == before["docProps/core.xml"][0].decode().replace("<dc:creator>Иван", "<dc:creator>")
    assert ["".join(x[3]) for x in ooxml.extract("a.docx", new)] == ["[[PERSON_001]] & Co", "[[PERSON_001]] тут", "[[PERSON_001]]"]


def test_without_scrubbing_only_text_changes():
    new, _ = changed("a.docx", DOCX, scrub=False)
    assert members(new)["docProps/core.xml"] == members(DOCX)["docProps/core.xml"]
    assert b'w:author="\xd0\x98' in members(new)["word/document.xml"][0]


def test_xlsx_numbers_and_formulas_stay():
    new, n = changed("b.xlsx", XLSX)
    sheet = members(new)["xl/worksheets/sheet1.xml"][0].decode()
    assert n == 2 and "<x:v>42</x:v>" in sheet and 'IF(A1="Иван Иванов",1)' in sheet and "[[PERSON_001]]</x:t>" in sheet


def test_round_trip():
    new, _ = changed("b.xlsx", XLSX)
    back, n = ooxml.rewritten("b.xlsx", new, re.compile(redact.tag_pattern()), lambda m: "Иван Иванов", scrub=False)
    text = lambda c: ["".join(x[3]) for x in ooxml.extract("b.xlsx", c)]
    assert n == 2 and text(back) == text(XLSX)


@pytest.mark.parametrize("path, content, code", [("a.docx", b"PK nothing", "not_ooxml"), ("a.odt", DOCX, "unsupported_format")])
def test_refused(path, content, code):
    with pytest.raises(ooxml.Refused, match=code):
        ooxml.extract(path, content)


def test_entities_are_refused():
    part = f'<!DOCTYPE d [<!ENTITY e "x">]><w:p {W}><w:t>&e;</w:t></w:p>'.encode()
    with pytest.raises(ooxml.Refused, match="document_type"):
        ooxml.paragraphs(part)


def test_files_by_spark(spark, tmp_path):
    for name, data in {"a.docx": DOCX, "b.xlsx": XLSX, "bad.docx": b"x", "c.txt": b"y"}.items():
        (tmp_path / name).write_bytes(data)
    files = ooxml.read_packages(spark, str(tmp_path))
    rows = ooxml.package_paragraphs(files).collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in rows if r["error"]) == ["bad.docx"]
    out = {r["path"].rsplit("/", 1)[1]: r for r in ooxml.redact_packages(files, RULES).collect()}
    assert out["a.docx"]["replacements"] == 3 and out["b.xlsx"]["replacements"] == 2 and out["bad.docx"]["error"] == "not_ooxml"


def test_texts_of_packages_take_no_shuffle(spark):
    """A package is one row, so nothing need be brought together; files that can't be read and blank ones have no text."""
    files = spark.createDataFrame([("a.docx", DOCX), ("b.xlsx", XLSX), ("bad.docx", b"x"), ("blank.docx", ooxml.as_package(" "))], "path string, content binary")
    out = lifecycle.package_texts(files)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {"a.docx": "Иван Иванов & Co\nИван Иванов тут\nИван", "b.xlsx": "Иван Иванов\n12\nИван Иванов"}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    kept = ooxml.package_texts(files.withColumn("n", F.length("path")), "n").collect()
    assert [(r["path"], r["n"], r["text"] is None) for r in kept] == [("a.docx", 6, False), ("b.xlsx", 6, False), ("bad.docx", 8, True), ("blank.docx", 10, True)]


def test_rows_are_handed_on_in_small_batches():
    files = pa.RecordBatch.from_pydict({"path": [f"{i}.docx" for i in range(400)]})
    out = list(ooxml._by_file([files, files], pa.schema([("x", pa.string())]), lambda f: [{"x": f["path"] + "y" * 20_000}], lambda r: len(r["x"])))
    assert sum(b.num_rows for b in out) == 800 and max(b.nbytes for b in out) < 2 * ooxml.HANDED_ON and len(out) > 10


@pytest.mark.parametrize("odd", ["", "<!-- c -->", "<w:r><w:t><![CDATA[a<b]]></w:t></w:r>", '<q:p xmlns:q="u"><w:t>x</w:t></q:p>', "<w:t>a<w:br/>b</w:t>", "<?p i?>"])
def test_plain_parts_are_read_as_any_part(odd):
    """By the tags that count and event by event: references, line ends, names in quotes, other prefixes, empty and nested paragraphs."""
    body = "<w:p/><w:p a='>' v:author=\"x\"><w:r k=\" author='n'\"><w:t>a&amp;&#x42;\r\nc</w:t></w:r><w:t/><v:p ><v:t xml:space='preserve'> d</v:t ></v:p><w:t>e author='x'</w:t></w:p><w:t>f</w:t><w:tt>g</w:tt><text author=''><t>h</t></text>"
    part = f'<?xml version="1.0" encoding="UTF-8"?>\r\n<w:document {W} {A} xmlns:v="{ooxml.WORD}" xmlns="{ooxml.SHEET}">{body}{odd}</w:document>'.encode()
    assert (ooxml._plain(part) is None) == bool(odd)
    assert ooxml.paragraphs(part) == ooxml._any_paragraphs(part)
    assert [["a&B\nc", "e author='x'"], [" d"], ["f"], ["h"]] == [[x.text for x in g] for g in ooxml.paragraphs(part)[0]][:4]
