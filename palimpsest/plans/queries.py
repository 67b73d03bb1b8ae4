"""Every operator as a query over the tables of a folder or over literal cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import display, messages, reply
from palimpsest.functions import text as T
from palimpsest.functions.constants import CATEGORIES, DASHES, GENERIC, LEGAL_FORMS, LEGAL_PREFIXES, MEDIA_TYPES, PUNCTUATION, QUOTES, SUPPORTED, VOWELS
from palimpsest.operators import candidates, chunks, detect, entities, jobs, leaves, ledger, manifest, occurrences, redact
from palimpsest.plans import lifecycle
from palimpsest.plans.registry import QUERIES, SQL, Rows, _written, query
from palimpsest.sources import model, ooxml
from palimpsest.sources.tables import grouped_leaves, paragraphs, spread, table

__all__ = ["QUERIES", "SQL"]

LINES = r"""
  SELECT doc_id, para_no, text FROM (
    SELECT doc_id, unnest(range(len(p)))::INT AS para_no, regexp_replace(unnest(p), '^\s+|\s+$', '', 'g') AS text
    FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)) WHERE text <> ''"""


def docs(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def listed(values) -> str:
    return ", ".join(_written(v) for v in values)


# ---- scans, sources, formats


@query("scan_paragraphs", LINES)
def _(spark, sf_dir):
    return paragraphs(docs(spark, sf_dir))


NAMES = Rows("doc_id bigint, name string", [(i, n) for i, n in enumerate(["a.docx", "B.DOCM", "x/y.xlsx", "c.XLSM", "d.pptx", "e.pptm", "f.doc", "g.rtf", "h.xls", "i.ppt", "j.pdf", "noext", ".docx", "k.tar.xlsx", "m__redacted.docx", "n.docx"])])
FILES = f"(SELECT * FROM {NAMES.sql} UNION ALL SELECT 1000 + page_id, url FROM pages)"
EXT = r"lower(regexp_extract(name, '[^/\\.](\.[^./\\]+)$', 1))"


def files(spark, sf_dir):
    return NAMES.df(spark).unionByName(table(spark, sf_dir, "pages").select((F.col("page_id") + 1000).alias("doc_id"), F.col("url").alias("name")))


@query("filter_supported", f"SELECT doc_id, name FROM {FILES} WHERE {EXT} IN ({listed(SUPPORTED)})")
def _(spark, sf_dir):
    return files(spark, sf_dir).where(display.is_supported(F.col("name")))


@query("classify_legacy", f"SELECT doc_id, {EXT} IN ('.doc', '.rtf', '.xls', '.ppt') AS legacy FROM {FILES}")
def _(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", display.is_legacy(F.col("name")).alias("legacy"))


@query("media_type", f"SELECT doc_id, CASE {EXT} {' '.join(f'WHEN {_written(k)} THEN {_written(v)}' for k, v in MEDIA_TYPES.items())} ELSE 'application/octet-stream' END AS media_type FROM {FILES}")
def _(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", display.media_type(F.col("name")).alias("media_type"))


@query("output_names", rf"""SELECT doc_id, stem || '__redacted' || ext AS redacted, regexp_replace(stem, '__redacted$', '') || '__restored' || ext AS restored
FROM (SELECT doc_id, regexp_extract(name, '[^/\\.](\.[^./\\]+)$', 1) AS ext, left(name, length(name) - length(regexp_extract(name, '[^/\\.](\.[^./\\]+)$', 1))) AS stem FROM {FILES})""")
def _(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", display.redacted_name(F.col("name")).alias("redacted"), display.restored_name(F.col("name")).alias("restored"))


PARTS = Rows("part string", [(p,) for p in ["word/document.xml", "word/_rels/document.xml.rels", "word/theme/theme1.xml", "xl/calcChain.xml", "xl/sharedStrings.xml", "ppt/slides/slide1.xml", "[Content_Types].xml", "docProps/core.xml", "word/media/a.png", "xl/worksheets/_rels/s.xml"]])


@query("filter_content_parts", rf"SELECT part FROM {PARTS.sql} WHERE part LIKE '%.xml' AND regexp_matches(part, '^(word|ppt|xl)/') AND NOT regexp_matches(part, '_rels/|/theme/|calcChain\.xml$')")
def _(spark, sf_dir):
    return PARTS.df(spark).where(display.is_content_part(F.col("part")))


def cut_up(spark, sf_dir):
    """Paragraphs in leaves of seven characters."""
    rows = paragraphs(docs(spark, sf_dir))
    return rows.select("doc_id", "para_no", F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,7}"), F.lit(0))).alias("leaf_no", "text"))


@query("group_leaves", f"SELECT doc_id, para_no, ((length(text) + 6) // 7)::INT AS n_leaves, text FROM ({LINES})")
def _(spark, sf_dir):
    return grouped_leaves(cut_up(spark, sf_dir), "doc_id").select("doc_id", "para_no", F.size("leaves").alias("n_leaves"), "text")


@query("leaf_offsets", f"""SELECT doc_id, para_no, leaf_no::INT AS leaf_no, (7 * leaf_no)::BIGINT AS start, least(7 * leaf_no + 7, length(text))::BIGINT AS "end"
FROM (SELECT *, unnest(range((length(text) + 6) // 7)) AS leaf_no FROM ({LINES}))""")
def _(spark, sf_dir):
    return leaves.offsets(cut_up(spark, sf_dir), "doc_id", "para_no").drop("text")


@query("locate_match_leaf", f"""SELECT doc_id, para_no, "at"::BIGINT AS "at", ("at" // 7)::INT AS leaf_no, ("at" % 7)::BIGINT AS "offset" FROM (
  SELECT doc_id, para_no, unnest(list_filter(range(length(text)), lambda i: substr(text, i::INT + 1, 1) = '@')) AS "at" FROM ({LINES}) WHERE contains(text, '@'))""")
def _(spark, sf_dir):
    rows = paragraphs(docs(spark, sf_dir)).where(F.contains("text", F.lit("@")))
    parts = F.transform(F.split("text", "@"), F.length)
    ends = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda k: F.aggregate(F.slice("parts", F.lit(1), k), k - 1, lambda a, x: a + x))
    found = rows.withColumn("parts", parts).select("doc_id", "para_no", F.explode(ends).alias("at")).withColumn("at", F.col("at").cast("bigint"))
    return leaves.located(found, leaves.offsets(cut_up(spark, sf_dir), "doc_id", "para_no"), "doc_id", "para_no")


def packages(spark, sf_dir):
    pack = F.udf(ooxml.as_package, "binary")
    return docs(spark, sf_dir).select(F.format_string("%d.docx", "doc_id").alias("path"), pack(F.coalesce("text", F.lit(""))).alias("content"))


WORDS = ["idiot", "moron", "trash", "clown", "scum", "loser", "stupid", "pathetic", "worthless", "disgusting"]
DICTIONARY = [{"id": f"e{i}", "value": w, "variants": [w.capitalize(), w.upper()], "inflect": False, "category": "WORD", "tag": f"[[WORD_{i + 1:03d}]]"} for i, w in enumerate(WORDS)]
#: Words stand alone where no letter, digit or underscore is beside them.
FORMS = {w: f"({w}|{w.capitalize()}|{w.upper()})" for w in WORDS}


def replaced_sql(column: str) -> str:
    for i, w in enumerate(WORDS):
        column = rf"regexp_replace({column}, '\b{FORMS[w]}\b', '[[WORD_{i + 1:03d}]]', 'g')"
    return column


def counted_sql(column: str, w: str) -> str:
    return rf"len(list_filter(regexp_extract_all({column}, '[\p{{L}}\p{{N}}_]+'), lambda x: x IN ('{w}', '{w.capitalize()}', '{w.upper()}')))"


ALL_COUNTS = " + ".join(counted_sql("text", w) for w in WORDS)


def read_again(sql: str) -> str:
    """What the paragraphs of a package hold, in SQL: the lines of a text after ``sql``."""
    return f"""coalesce(sha256(string_agg({sql}, chr(10) ORDER BY para_no)), sha256('')) AS text_sha256
FROM (SELECT doc_id, ({ALL_COUNTS})::INT AS replacements FROM documents) d LEFT JOIN ({LINES}) l USING (doc_id) GROUP BY doc_id, replacements"""


def with_text(out: DataFrame, *kept: str) -> DataFrame:
    return ooxml.package_texts(out, *kept).select("path", *kept, F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("redact_packages", f"SELECT doc_id::VARCHAR || '.docx' AS path, replacements, {read_again(replaced_sql('l.text'))}")
def _(spark, sf_dir):
    return with_text(ooxml.redact_packages(packages(spark, sf_dir), redact.alternation(DICTIONARY)), "replacements")


def lowered_sql(column: str) -> str:
    for w in WORDS:
        column = rf"regexp_replace({column}, '\b{FORMS[w]}\b', '{w}', 'g')"
    return column


@query("restore_packages", f"SELECT doc_id::VARCHAR || '.docx' AS path, doc_id::VARCHAR || '__restored.docx' AS name, replacements, {read_again(lowered_sql('l.text'))}")
def _(spark, sf_dir):
    hidden = ooxml.redact_packages(packages(spark, sf_dir), redact.alternation(DICTIONARY))
    mapping = spark.createDataFrame([(e["tag"], e["value"]) for e in DICTIONARY], "tag string, value string")
    return with_text(lifecycle.restore_packages(hidden, mapping), "name", "replacements")


@query("scan_errors", "SELECT * FROM (VALUES ('bad.docx', 'not_ooxml'), ('a.pdf', 'unsupported_format')) AS _(path, error)")
def _(spark, sf_dir):
    odd = spark.createDataFrame([("bad.docx", b"no package"), ("a.pdf", b"%PDF")], "path string, content binary")
    return ooxml.package_paragraphs(packages(spark, sf_dir).unionByName(odd)).where("error is not null").select("path", "error")


@query("scan_packages", f"SELECT doc_id::VARCHAR || '.docx' AS path, para_no, text FROM ({LINES})")
def _(spark, sf_dir):
    return ooxml.package_paragraphs(packages(spark, sf_dir)).where("error is null").select("path", "para_no", "text")


UPLOADS = Rows("job_id string, name string, size bigint", [("u", "dir/a.docx", 10), ("u", "b.pdf", 10), ("u", "c.xlsx", 0), ("u", "d.pptx", 60 * 1024 * 1024)])


@query("validate_uploads", rf"""SELECT job_id, name, size, CASE WHEN count(*) OVER (PARTITION BY job_id) > 25 THEN 'too_many_files'
  WHEN {EXT} NOT IN ({listed(SUPPORTED)}) THEN 'unsupported_format' WHEN size > 52428800 THEN 'file_too_large' WHEN size = 0 THEN 'file_empty' END AS error
FROM (SELECT * FROM {UPLOADS.sql} UNION ALL SELECT source, doc_id::VARCHAR || '.docx', n_chars FROM documents)""")
def _(spark, sf_dir):
    own = docs(spark, sf_dir).select(F.col("source").alias("job_id"), F.format_string("%d.docx", "doc_id").alias("name"), F.col("n_chars").alias("size"))
    return jobs.upload_errors(UPLOADS.df(spark).unionByName(own))


@query("register_upload", "SELECT doc_id, left(sha256(doc_id::VARCHAR || '.docx'), 12) AS id FROM documents")
def _(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.left(F.sha2(F.format_string("%d.docx", "doc_id"), 256), F.lit(12)).alias("id"))


@query("bundle_manifest", f"""SELECT 'job' AS job_id, CASE WHEN row_number() OVER (PARTITION BY out ORDER BY doc_id) = 1 THEN out ELSE doc_id::VARCHAR || '_' || out END AS member
FROM (SELECT doc_id, lang || '__redacted.docx' AS out FROM documents WHERE n_chars > 100) UNION ALL SELECT 'job', 'mapping.json' WHERE EXISTS (SELECT 1 FROM documents WHERE n_chars > 100)""")
def _(spark, sf_dir):
    own = docs(spark, sf_dir).select(F.lit("job").alias("job_id"), "doc_id", F.concat("lang", F.lit(".docx")).alias("name"), F.when(F.col("n_chars") <= 100, "not_ooxml").alias("error"))
    return manifest.bundle(own)


# ---- projections and filters


DOC_WORDS = "SELECT DISTINCT unnest(string_split(text, ' ')) AS value FROM documents"
GENERIC_ROWS = Rows("value string", [(v,) for v in ["клиент", "n/a", "—", "x", "Иванов", "Client", "№ 5"]])


@query("filter_generic", rf"""SELECT value FROM ({DOC_WORDS} UNION SELECT value FROM {GENERIC_ROWS.sql})
WHERE NOT (length(value) < 2 OR lower(value) IN ({listed(GENERIC)}) OR NOT regexp_matches(value, '[\p{{L}}\p{{N}}]'))""")
def _(spark, sf_dir):
    own = docs(spark, sf_dir).select(F.explode(F.split("text", " ")).alias("value"))
    return candidates.without_generic(own.unionByName(GENERIC_ROWS.df(spark)).distinct())


REPLIES = Rows("id int, reply string", [
    (1, '<think>{a}</think>\n```json\n{"entities":[{"text":" Ivan ","category":"person","aliases":["I.", " "]},{"text":"","category":"ORG"},{"text":"X"}]}\n```'),
    (2, "<think>never closed {"),
    (3, 'Sure: {"entities":[{"text":"ACME","category":"org","aliases":[]}]} done'),
    (4, "no json"),
    (5, "<REASONING>x</REASONING><thinking>y</thinking>{\"entities\":[]}"),
])
CLOSED = r"regexp_matches(reply, '(?is)</(?:think|thinking|reasoning)>')"
UNTHOUGHT = rf"CASE WHEN {CLOSED} THEN regexp_replace(reply, '(?is).*?</(?:think|thinking|reasoning)>', '', 'g') WHEN NOT regexp_matches(reply, '(?i)<(?:think|thinking|reasoning)\b') THEN reply END"
JSON_PART = rf"nullif(regexp_extract(regexp_replace(trim({UNTHOUGHT}), '(?m)^```(?:json)?|```$', '', 'g'), '(?s)\{{.*\}}', 0), '')"


@query("remove_thinking", f"SELECT id, {UNTHOUGHT} AS reply FROM {REPLIES.sql}")
def _(spark, sf_dir):
    return REPLIES.df(spark).select("id", reply.without_thinking(F.col("reply")).alias("reply"))


@query("extract_json", f"SELECT id, {JSON_PART} AS body FROM {REPLIES.sql}")
def _(spark, sf_dir):
    return REPLIES.df(spark).select("id", reply.json_part(F.col("reply")).alias("body"))


@query("parse_findings", f"""SELECT id, upper(trim(coalesce(nullif(e->>'$.category', ''), 'OTHER'))) AS category, trim(e->>'$.text') AS value,
  list_filter(list_transform(coalesce(from_json(e->'$.aliases', '["VARCHAR"]'), []), lambda a: trim(a)), lambda a: a <> '') AS aliases
FROM (SELECT id, unnest(json_extract({JSON_PART}, '$.entities[*]')) AS e FROM {REPLIES.sql}) WHERE trim(coalesce(e->>'$.text', '')) <> ''""")
def _(spark, sf_dir):
    return REPLIES.df(spark).select("id", F.explode(reply.findings(F.col("reply"))).alias("f")).select("id", "f.*")


BODIES = Rows("id int, body string", [(1, '{"choices":[{"message":{"content":"a"}}]}'), (2, '{"data":{"choices":[{"message":{"content":"b"}}]}}'), (3, '{"x":1}')])


@query("message_content", f"SELECT id, coalesce(body->>'$.choices[0].message.content', body->>'$.data.choices[0].message.content') AS content FROM {BODIES.sql}")
def _(spark, sf_dir):
    return BODIES.df(spark).select("id", reply.message_content(F.col("body")).alias("content"))


ALLOWED = f"({listed(CATEGORIES)})"


@query("coerce_category", f"""SELECT id, source, CASE WHEN source = 'rule' THEN category WHEN upper(category) IN {ALLOWED} THEN upper(category) ELSE 'OTHER' END AS category
FROM (SELECT c_custkey AS id, c_mktsegment AS category, CASE WHEN c_custkey % 2 = 0 THEN 'rule' ELSE 'llm' END AS source FROM customer UNION ALL SELECT -p_partkey, CASE WHEN p_size < 25 THEN 'person' ELSE 'Org' END, 'llm' FROM part)""")
def _(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("category"), F.when(F.col("c_custkey") % 2 == 0, "rule").otherwise("llm").alias("source"))
    other = table(spark, sf_dir, "part").select((-F.col("p_partkey")).alias("id"), F.when(F.col("p_size") < 25, "person").otherwise("Org").alias("category"), F.lit("llm").alias("source"))
    return candidates.coerced(own.unionByName(other))


# ---- entities over customers: a value each, with a category and a total

CUSTOMERS = "(SELECT c_custkey AS id, c_mktsegment AS category, c_name AS value, (c_custkey % 7)::BIGINT AS total, c_custkey % 3 <> 0 AS selected, c_nationkey::VARCHAR AS doc FROM customer)"


def customers(spark, sf_dir):
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key.alias("id"), F.col("c_mktsegment").alias("category"), F.col("c_name").alias("value"), (key % 7).cast("bigint").alias("total"), (key % 3 != 0).alias("selected"), F.col("c_nationkey").cast("string").alias("doc"))


@query("drop_zero_hit", f"SELECT id, value, total FROM {CUSTOMERS} WHERE total > 0")
def _(spark, sf_dir):
    return customers(spark, sf_dir).where("total > 0").select("id", "value", "total")


TAG = "'[[' || cat || '_' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END || ']]'"


@query("assign_tags", f"SELECT id, {TAG} AS tag FROM (SELECT id, upper(category) AS cat, row_number() OVER (PARTITION BY upper(category) ORDER BY category, total DESC, value) AS n FROM {CUSTOMERS})")
def _(spark, sf_dir):
    return entities.with_tags(customers(spark, sf_dir)).select("id", "tag")


SELECTED = f"(SELECT *, {TAG} AS tag FROM (SELECT *, upper(category) AS cat, row_number() OVER (PARTITION BY upper(category) ORDER BY category, total DESC, value) AS n FROM {CUSTOMERS} WHERE selected AND total > 0))"


@query("select_for_tagging", f"SELECT c.id, s.tag FROM {CUSTOMERS} c LEFT JOIN {SELECTED} s USING (id)")
def _(spark, sf_dir):
    rows = customers(spark, sf_dir)
    return rows.select("id").join(entities.with_tags(rows.where("selected and total > 0")).select("id", "tag"), "id", "left")


@query("build_mapping", f"SELECT tag, category, value, [lower(value)] AS variants, total AS replacements FROM {SELECTED}")
def _(spark, sf_dir):
    rows = entities.with_tags(customers(spark, sf_dir).where("selected and total > 0"))
    return rows.select("tag", "category", "value", F.array(F.lower("value")).alias("variants"), F.col("total").alias("replacements"))


@query("sort_entities", f"SELECT id, row_number() OVER (ORDER BY category, total DESC, value)::INT AS place FROM {CUSTOMERS}")
def _(spark, sf_dir):
    return entities.ordered(customers(spark, sf_dir)).select("id", "place")


LEDGER = f"(SELECT *, MAP {{doc: total}} AS occurrences FROM {CUSTOMERS})"


def ledger_rows(spark, sf_dir):
    rows = customers(spark, sf_dir)
    return rows.withColumn("variants", F.array("doc")).withColumn("occurrences", F.create_map("doc", "total"))


@query("ledger_filter", f"SELECT id, value FROM {CUSTOMERS} WHERE (contains(lower(value), 'build') OR contains(lower(category), 'build') OR contains(lower(doc), 'build')) AND doc = '5' AND total > 0")
def _(spark, sf_dir):
    return ledger.filtered(ledger_rows(spark, sf_dir), " Build ", "5").select("id", "value")


@query("ledger_groups", f"SELECT category, size, selected, row_number() OVER (ORDER BY size DESC, category)::INT AS place FROM (SELECT category, count(*) AS size, count(*) FILTER (selected) AS selected FROM {CUSTOMERS} GROUP BY category)")
def _(spark, sf_dir):
    return ledger.groups(customers(spark, sf_dir))


@query("ledger_totals", f"SELECT count(*) AS entities, count(*) FILTER (selected) AS selected, (sum(total) FILTER (selected))::BIGINT AS selected_hits, sum(total)::BIGINT AS hits FROM {CUSTOMERS}")
def _(spark, sf_dir):
    return ledger.totals(customers(spark, sf_dir))


@query("occurrence_rollup", f"SELECT category, doc AS doc_id, sum(total)::BIGINT AS n, grouping(category, doc)::BIGINT AS level FROM {CUSTOMERS} GROUP BY ROLLUP (category, doc)")
def _(spark, sf_dir):
    return ledger.rollup(customers(spark, sf_dir).select("category", F.col("doc").alias("doc_id"), F.col("total").alias("n")))


@query("job_scope", f"SELECT id, value FROM {CUSTOMERS} WHERE doc = '7'")
def _(spark, sf_dir):
    return jobs.visible(customers(spark, sf_dir).withColumnRenamed("doc", "client_id"), F.lit("7")).select("id", "value")


@query("entity_projection", f"SELECT id, '{{\"id\":' || id || ',\"category\":\"' || category || '\",\"value\":\"' || value || '\",\"total_occurrences\":' || total || '}}' AS body FROM {CUSTOMERS}")
def _(spark, sf_dir):
    return customers(spark, sf_dir).select("id", F.to_json(F.struct("id", "category", "value", F.col("total").alias("total_occurrences"))).alias("body"))


PATCHES = Rows("id bigint, selected boolean, inflect boolean, variants array<string>, category string, seq int", [(1, False, None, None, "org", 1), (2, None, True, ["a"], None, 2), (2, None, None, ["b", "c"], None, 3), (-9, True, None, None, None, 4)])


@query("apply_patches", f"""SELECT c.id, coalesce(p.selected, c.selected) AS selected, coalesce(p.inflect, false) AS inflect, coalesce(p.variants, [c.doc]) AS variants, coalesce(upper(p.category), c.category) AS category
FROM {CUSTOMERS} c LEFT JOIN (SELECT * FROM {PATCHES.sql} QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) p USING (id)""")
def _(spark, sf_dir):
    rows = customers(spark, sf_dir).select("id", "selected", F.lit(False).alias("inflect"), F.array("doc").alias("variants"), "category")
    return jobs.patched(rows, PATCHES.df(spark))


@query("orphan_dirs", "SELECT o_orderkey AS job_id FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)")
def _(spark, sf_dir):
    return jobs.orphans(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id")))


@query("attach_aliases", "SELECT c_custkey AS key, c_name AS value, coalesce(aliases, []) AS aliases FROM customer LEFT JOIN (SELECT o_custkey, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS aliases FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def _(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    return candidates.with_aliases(own, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("alias")))


# ---- candidates from the words of documents

TOKENS = r"(SELECT doc_id, lang AS category, unnest(range(len(w)))::INT AS pos, unnest(w) AS value FROM (SELECT doc_id, lang, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w FROM documents))"


def tokens(spark, sf_dir):
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    rows = docs(spark, sf_dir).select("doc_id", F.col("lang").alias("category"), F.posexplode(words).alias("pos", "value"))
    return rows.withColumn("key", F.lower("value")).withColumn("seq", F.struct("doc_id", "pos")).withColumn("source", F.lit("rule"))


@query("dedup_candidates", f"""SELECT lower(value) AS key, arg_min(category, (doc_id, pos)) AS category, arg_min(value, (doc_id, pos)) AS value, count(DISTINCT value)::INT AS n_spellings
FROM {TOKENS} GROUP BY lower(value)""")
def _(spark, sf_dir):
    return candidates.dedup_candidates(tokens(spark, sf_dir)).select("key", "category", "value", F.size("spellings").alias("n_spellings"))


@query("dedup_hits", f"SELECT doc_id, category, lower(value) AS key, arg_min(value, pos) AS value FROM {TOKENS} GROUP BY doc_id, category, lower(value)")
def _(spark, sf_dir):
    return candidates.dedup_hits(tokens(spark, sf_dir), "doc_id").select("doc_id", "category", "key", "value")


@query("union_candidates", "SELECT c_custkey AS id, c_name AS value, 'rule' AS source FROM customer UNION ALL SELECT s_suppkey, s_name, 'llm' FROM supplier")
def _(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("value"))
    return candidates.union(own, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("value"))).select("id", "value", "source")


# ---- merging

NAMED = Rows("job_id string, id string, category string, value string, key string, variants array<string>, source string, inflect boolean, seq int", [
    ("a", "1", "OTHER", 'ПАО "МегаФон"', "пао мегафон", ["МегаФон"], "llm", False, 1),
    ("a", "2", "ORG", "ПАО «МегаФон»", "пао мегафон", [], "llm", False, 2),
    ("a", "3", "ORG", "ПАО МегаФон", "пао мегафон", [], "rule", True, 3),
    ("a", "4", "ORG", "ООО «Ромашка»", "ооо ромашка", ["Ромашка"], "llm", False, 4),
    ("a", "5", "ORG", "ПАО «Ромашка»", "пао ромашка", ["Ромашка"], "llm", False, 5),
    ("a", "6", "PERSON", "Иванов Иван Иванович", "иванов иван иванович", ["Иванов И.И.", "Иванов И. И."], "llm", True, 6),
    ("a", "7", "PERSON", "Иванов И.И.", "иванов и и", [], "llm", True, 7),
    ("a", "8", "ORG", "Лукойл", "лукойл", [], "llm", False, 8),
    ("a", "9", "ORG", "ПАО «Лукойл»", "пао лукойл", [], "llm", False, 9),
    ("b", "10", "ORG", "Ромашка", "ромашка", [], "llm", False, 10),
])
CLAIMS = Rows("job_id string, id string, own_key string, key string", [("a", "1", "пао мегафон", "мегафон"), ("a", "4", "ооо ромашка", "ромашка"), ("a", "5", "пао ромашка", "ромашка"), ("a", "6", "иванов иван иванович", "иванов и и"), ("a", "6", "иванов иван иванович", "иванов и и")])
LEGAL = f"list_has_any(string_split(key, ' '), [{listed(LEGAL_FORMS)}])"
BARE = f"array_to_string(list_filter(string_split(key, ' '), lambda t: NOT list_contains([{listed(LEGAL_FORMS)}], t)), ' ')"
RANK = f"{LEGAL}::INT DESC, length(value) DESC, (source = 'rule')::INT DESC, seq"


@query("merge_same_name", f"""SELECT * REPLACE (list_sort(list_filter(variants, lambda x: x <> value)) AS variants) FROM (
  SELECT job_id, key, first(id ORDER BY {RANK}) AS id, first(value ORDER BY {RANK}) AS value, first(category ORDER BY (category = 'OTHER')::INT, {RANK}) AS category,
    list_distinct(flatten(list(list_prepend(value, variants)))) AS variants,
    CASE WHEN bool_or(source = 'rule') THEN 'rule' ELSE 'llm' END AS source, bool_or(inflect) AS inflect FROM {NAMED.sql} GROUP BY job_id, key)""")
def _(spark, sf_dir):
    return entities.same_name(NAMED.df(spark), "job_id")


OWNERS = f"(SELECT job_id, key, count(DISTINCT id) AS owners, min(id) AS owner FROM {CLAIMS.sql} WHERE key <> own_key AND key <> '' GROUP BY job_id, key)"


@query("merge_variant_owner", f"SELECT job_id, id, owner FROM {NAMED.sql} JOIN {OWNERS} USING (job_id, key) WHERE owners = 1 AND id <> owner")
def _(spark, sf_dir):
    return entities.variant_owner(NAMED.df(spark), CLAIMS.df(spark), "job_id")


@query("merge_bare_org", f"""SELECT e.job_id, e.id, f.owner FROM {NAMED.sql} e JOIN (SELECT job_id, {BARE} AS bare, min(id) AS owner FROM {NAMED.sql} WHERE category = 'ORG' AND {LEGAL} GROUP BY 1, 2 HAVING count(*) = 1) f
ON f.job_id = e.job_id AND f.bare = e.key WHERE e.category = 'ORG' AND NOT {LEGAL.replace('key', 'e.key')}""")
def _(spark, sf_dir):
    return entities.bare_company(NAMED.df(spark), "job_id")


@query("contested_variants", f"SELECT job_id, key, owners FROM {OWNERS} WHERE owners > 1")
def _(spark, sf_dir):
    return entities.contested(CLAIMS.df(spark), "job_id")


@query("absorb", f"""SELECT a.id || '<' || b.id AS pair, a.value, CASE WHEN a.category = 'OTHER' AND b.category <> 'OTHER' THEN b.category ELSE a.category END AS category,
  list_sort(list_filter(list_distinct(list_concat(list_prepend(a.value, a.variants), list_prepend(b.value, b.variants))), lambda x: x <> a.value)) AS variants,
  CASE WHEN b.source = 'rule' THEN 'rule' ELSE a.source END AS source, a.inflect OR b.inflect AS inflect FROM {NAMED.sql} a JOIN {NAMED.sql} b ON a.job_id = b.job_id AND a.id <> b.id""")
def _(spark, sf_dir):
    rows = NAMED.df(spark)
    pairs = rows.select("job_id", "id").join(rows.select("job_id", F.col("id").alias("other")), "job_id").where("id <> other").withColumn("pair", F.concat("id", F.lit("<"), "other"))
    keeper = rows.join(pairs.select("id", "pair"), "id")
    out = entities.absorbed(keeper, rows.join(pairs.select(F.col("other").alias("id"), "pair"), "id"))
    return out.select("pair", "value", "category", F.array_sort("variants").alias("variants"), "source", "inflect")


@query("merge_duplicates", """SELECT * FROM (VALUES ('a', '1', 'ORG', ['МегаФон', 'ПАО «МегаФон»', 'ПАО МегаФон'], 'rule', true), ('a', '4', 'ORG', [], 'llm', false), ('a', '5', 'ORG', [], 'llm', false),
  ('a', '6', 'PERSON', ['Иванов И. И.', 'Иванов И.И.'], 'llm', true), ('a', '9', 'ORG', ['Лукойл'], 'llm', false), ('b', '10', 'ORG', [], 'llm', false)) AS _(job_id, id, category, variants, source, inflect)""")
def _(spark, sf_dir):
    return entities.merge(NAMED.df(spark)).select("job_id", "id", "category", F.array_sort("variants").alias("variants"), "source", "inflect")


FORM_ROWS = Rows("id int, forms array<string>, more array<string>", [(1, ["Иванов", "ИВАНОВ", " ", "иванов и."], ["Иванов", "X"]), (2, [], ["a", "b"]), (3, ["a", "A", "b"], []), (4, ["long form", "z"], ["z"])])


@query("distinct_forms", f"SELECT id, list_filter(forms, lambda x, i: trim(x) <> '' AND list_position(list_transform(forms, lambda y: lower(y)), lower(x)) = i) AS forms FROM {FORM_ROWS.sql}")
def _(spark, sf_dir):
    return FORM_ROWS.df(spark).select("id", T.distinct_forms(F.col("forms")).alias("forms"))


@query("forms_union", f"SELECT id, list_sort(list_distinct(list_concat(forms, more))) AS forms FROM {FORM_ROWS.sql}")
def _(spark, sf_dir):
    return FORM_ROWS.df(spark).select("id", F.array_sort(F.array_union("forms", "more")).alias("forms"))


@query("form_rank", f"SELECT id, coalesce(list_max(list_transform(forms, lambda x: length(x))), 0)::INT AS longest FROM {FORM_ROWS.sql}")
def _(spark, sf_dir):
    return FORM_ROWS.df(spark).select("id", F.coalesce(F.array_max(F.transform("forms", F.length)), F.lit(0)).alias("longest"))


@query("alternation_order", f"SELECT id, row_number() OVER (ORDER BY coalesce(list_max(list_transform(forms, lambda x: length(x))), 0) DESC, id)::INT AS place FROM {FORM_ROWS.sql}")
def _(spark, sf_dir):
    longest = F.coalesce(F.array_max(F.transform("forms", F.length)), F.lit(0))
    return FORM_ROWS.df(spark).select("id", F.row_number().over(Window.orderBy(longest.desc(), "id")).alias("place"))


# ---- counting, replacing, restoring


def form_rows(spark):
    rows = [(e["id"], T.entity_pattern([e["value"], *e["variants"]]), [e["value"], *e["variants"]]) for e in DICTIONARY]
    return spark.createDataFrame(rows, "entity_id string, pattern string, forms array<string>")


COUNTS = " UNION ALL ".join(f"SELECT 'e{i}' AS entity_id, doc_id, {counted_sql('text', w)}::INT AS n FROM documents" for i, w in enumerate(WORDS))


@query("count_occurrences", f"SELECT * FROM ({COUNTS}) WHERE n > 0")
def _(spark, sf_dir):
    return occurrences.count_occurrences(docs(spark, sf_dir), form_rows(spark))


@query("total_occurrences", f"SELECT entity_id, sum(n)::BIGINT AS total FROM ({COUNTS}) WHERE n > 0 GROUP BY entity_id")
def _(spark, sf_dir):
    return occurrences.count_occurrences(docs(spark, sf_dir), form_rows(spark)).groupBy("entity_id").agg(F.sum("n").alias("total"))


@query("variants_grounded", f"SELECT DISTINCT form FROM (SELECT unnest([{listed(f for w in WORDS for f in (w, w.capitalize(), w.upper(), w + 'zz'))}]) AS form) WHERE form IN (SELECT value FROM {TOKENS})")
def _(spark, sf_dir):
    forms = [f for w in WORDS for f in (w, w.capitalize(), w.upper(), w + "zz")]
    rows = spark.createDataFrame([(f, T.form_pattern(f), [f]) for f in forms], "entity_id string, pattern string, forms array<string>")
    return occurrences.count_occurrences(docs(spark, sf_dir), rows).select(F.col("entity_id").alias("form")).distinct()


@query("redact_single_pass", f"SELECT doc_id, {replaced_sql('text')} AS text, ({ALL_COUNTS})::INT AS replacements FROM documents")
def _(spark, sf_dir):
    return redact.redact(docs(spark, sf_dir), DICTIONARY).select("doc_id", "text", "replacements")


@query("apply_tags", f"SELECT conv_id, turn, {replaced_sql('text')} AS text FROM conversations")
def _(spark, sf_dir):
    return redact.redact(spread(table(spark, sf_dir, "conversations")), DICTIONARY).select("conv_id", "turn", "text")


@query("replacement_counts", " UNION ALL ".join(f"SELECT * FROM (SELECT '[[WORD_{i + 1:03d}]]' AS tag, sum({counted_sql('text', w)})::BIGINT AS n FROM documents) WHERE n > 0" for i, w in enumerate(WORDS)))
def _(spark, sf_dir):
    return redact.hits(docs(spark, sf_dir), DICTIONARY)


MAPPED = Rows("tag string, value string", [("[[EN_001]]", "one"), ("[[EN_002]]", "two $1 \\"), ("[[FR_003]]", "trois")])
TAG_SQL = "'[[' || upper(lang) || '_' || lpad((doc_id % 5)::VARCHAR, 3, '0') || ']]'"
#: Whole texts with a tag before every third line and one at the end.
TAGGED_SQL = f"""(SELECT doc_id, tag, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l, i: CASE WHEN i % 3 = 1 THEN tag || ' ' ELSE '' END || l), chr(10)) || tag AS text,
  ((len(string_split(coalesce(text, ''), chr(10))) + 2) // 3 + 1)::INT AS n FROM (SELECT doc_id, text, {TAG_SQL} AS tag FROM documents))"""


def tagged(spark, sf_dir):
    tag = F.concat(F.lit("[["), F.upper("lang"), F.lit("_"), F.lpad((F.col("doc_id") % 5).cast("string"), 3, "0"), F.lit("]]"))
    rows = docs(spark, sf_dir).select("doc_id", tag.alias("tag"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    lines = F.transform("lines", lambda x, i: F.when(i % 3 == 0, F.concat("tag", F.lit(" "), x)).otherwise(x))
    return rows.select("doc_id", F.concat(F.array_join(lines, "\n"), "tag").alias("text"))


@query("restore_lookup", f"SELECT doc_id, replace(text, tag, coalesce(value, tag)) AS text, CASE WHEN value IS NULL THEN 0 ELSE n END AS mapped, CASE WHEN value IS NULL THEN n ELSE 0 END AS unmapped FROM {TAGGED_SQL} LEFT JOIN {MAPPED.sql} USING (tag)")
def _(spark, sf_dir):
    return redact.restore(tagged(spark, sf_dir), MAPPED.df(spark)).select("doc_id", "text", "mapped", "unmapped")


@query("scan_tags", f"SELECT doc_id, list_transform(range(n), lambda i: tag) AS tags FROM {TAGGED_SQL}")
def _(spark, sf_dir):
    return tagged(spark, sf_dir).select("doc_id", redact.tags_in(F.col("text")).alias("tags"))


@query("unmapped_tags", f"SELECT DISTINCT tag FROM {TAGGED_SQL} WHERE tag NOT IN (SELECT tag FROM {MAPPED.sql})")
def _(spark, sf_dir):
    return redact.unmapped(tagged(spark, sf_dir), MAPPED.df(spark))


@query("unmapped_top10", f"SELECT DISTINCT tag FROM {TAGGED_SQL} WHERE tag NOT IN (SELECT tag FROM {MAPPED.sql}) ORDER BY tag LIMIT 10")
def _(spark, sf_dir):
    return redact.unmapped(tagged(spark, sf_dir), MAPPED.df(spark)).orderBy("tag").limit(10)


KEYS = Rows("job_id string, content string", [
    ("a", '{"tag_prefix":"<","entities":[{"tag":"T1","value":"x"},{"tag":"T1","value":"y"},{"value":"z"},{"tag":"T2"}]}'),
    ("b", '{"entities":[{"tag":"T3","value":"ю","replacements":4}]}'),
    ("c", "{}"),
])


@query("parse_mapping", f"""SELECT job_id, e->>'$.tag' AS tag, tag_prefix, tag_suffix, arg_max(e->>'$.value', pos) AS value FROM (
  SELECT job_id, coalesce(content->>'$.tag_prefix', '[[') AS tag_prefix, coalesce(content->>'$.tag_suffix', ']]') AS tag_suffix,
    unnest(json_extract(content, '$.entities[*]')) AS e, generate_subscripts(json_extract(content, '$.entities[*]'), 1) AS pos FROM {KEYS.sql})
WHERE coalesce(e->>'$.tag', '') <> '' AND e->>'$.value' IS NOT NULL GROUP BY ALL""".replace(" GROUP BY ALL", " GROUP BY job_id, e->>'$.tag', tag_prefix, tag_suffix"))
def _(spark, sf_dir):
    return redact.parsed_mapping(KEYS.df(spark))


# ---- chunks


UNIQUE = f"(SELECT doc_id, text, min(para_no) AS para_no FROM ({LINES}) WHERE length(text) >= 2 GROUP BY doc_id, text)"


@query("unique_paragraphs", f"SELECT doc_id, para_no, text FROM {UNIQUE}")
def _(spark, sf_dir):
    return chunks.unique_paragraphs(paragraphs(docs(spark, sf_dir))).select("doc_id", "para_no", "text")


@query("pack_chunks", f"""WITH RECURSIVE p AS (SELECT doc_id, left(text, 500) AS text, row_number() OVER (PARTITION BY doc_id ORDER BY para_no) AS k FROM {UNIQUE}),
r AS (SELECT doc_id, k, text, 0 AS chunk_no, length(text) + 1 AS size FROM p WHERE k = 1 UNION ALL
  SELECT p.doc_id, p.k, p.text, CASE WHEN r.size + length(p.text) > 500 THEN r.chunk_no + 1 ELSE r.chunk_no END, CASE WHEN r.size + length(p.text) > 500 THEN 0 ELSE r.size END + length(p.text) + 1
  FROM r JOIN p ON p.doc_id = r.doc_id AND p.k = r.k + 1)
SELECT doc_id, chunk_no::INT AS chunk_no, string_agg(text, chr(10) ORDER BY k) AS text FROM r GROUP BY doc_id, chunk_no""")
def _(spark, sf_dir):
    return chunks.of_texts(docs(spark, sf_dir), 500)


# ---- scalar functions


QUOTED = f"translate(x, {_written(QUOTES + DASHES)}, {_written('\"' * len(QUOTES) + '-' * len(DASHES))})"
NORMAL = rf"trim(regexp_replace({QUOTED}, '\s+', ' ', 'g'))"
SPELLED = Rows("x string", [(v,) for v in ["ПАО «МегаФон»", "a  b", "x–y", "Straße", "ООО «Ромашка»", "ACME, Inc.", "мегафон", "Hello world", "Иванов-Петров", "123"]])
ALL_VALUES = rf"(SELECT x FROM {SPELLED.sql} UNION SELECT DISTINCT unnest(string_split(text, chr(10))) FROM documents)"


def spelled(spark, sf_dir):
    lines = docs(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("x"))
    return SPELLED.df(spark).unionByName(lines).distinct()


@query("normalise", f"SELECT md5(x) AS id, {NORMAL.replace('(x,', '(nfc_normalize(x),')} AS value FROM {ALL_VALUES}")
def _(spark, sf_dir):
    return spelled(spark, sf_dir).select(F.md5("x").alias("id"), T.normalise(F.col("x")).alias("value"))


KEY = rf"trim(regexp_replace(regexp_replace(replace(lower({NORMAL}), 'ß', 'ss'), '[«»“”‘’\"''.,;:()\[\]{{}}/\\|]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query("canonical_key", f"SELECT md5(x) AS id, {KEY} AS key FROM {ALL_VALUES}")
def _(spark, sf_dir):
    return spelled(spark, sf_dir).select(F.md5("x").alias("id"), T.canonical_key(T.dedup_key(F.col("x"))).alias("key"))


@query("legal_form", f"SELECT x, {LEGAL} AS legal, {BARE} AS bare FROM (SELECT x, {KEY} AS key FROM {SPELLED.sql})")
def _(spark, sf_dir):
    rows = SPELLED.df(spark).withColumn("key", T.canonical_key(T.dedup_key(F.col("x"))))
    return rows.select("x", T.has_legal_form(F.col("key")).alias("legal"), T.strip_legal_form(F.col("key")).alias("bare"))


@query("cyrillic_word", rf"SELECT x, regexp_matches(x, '[Ѐ-ӿ]') AND len(regexp_extract_all(x, '\p{{L}}')) = len(regexp_extract_all(x, '[Ѐ-ӿ]')) AS cyrillic FROM {SPELLED.sql}")
def _(spark, sf_dir):
    return SPELLED.df(spark).select("x", T.cyrillic_word(F.col("x")).alias("cyrillic"))


PATTERNS = Rows("form string, inflect boolean, x string", [(f, i, x) for f, i, x in [
    ("Иванов", True, "Иванова Иванову Ивановским Иванов"), ("Мария", True, "Марии Марию Мария мар"), ("Анна", False, "Анна Анне"),
    ('ПАО "МегаФон"', False, "ПАО  «МегаФон» и ПАО ”МегаФон’"), ("Smith-Jones", False, "Smith–Jones SmithJones Smith-Jones2"), ("a.b", False, "a.b axb"),
]])


def pattern_rows(spark):
    return spark.createDataFrame([(f, T.form_pattern(f, i), x) for f, i, x in PATTERNS.rows], "form string, pattern string, x string")


@query("form_pattern", """SELECT * FROM (VALUES ('Иванов', ['Иванова', 'Иванову', 'Иванов']), ('Мария', ['Марии', 'Марию', 'Мария']), ('Анна', ['Анна']),
  ('ПАО "МегаФон"', ['ПАО  «МегаФон»', 'ПАО ”МегаФон’']), ('Smith-Jones', ['Smith–Jones']), ('a.b', ['a.b'])) AS _(form, found)""")
def _(spark, sf_dir):
    return pattern_rows(spark).select("form", F.regexp_extract_all("x", F.concat(F.lit("(?U)"), "pattern"), F.lit(0)).alias("found"))


WORDS_OF_FORMS = Rows("token string, inflect boolean", sorted({(w, i) for f, i, _ in PATTERNS.rows for w in f.split()} | {("И.И.", True), ("Петров-Водкин", True), ("Ли", True), ("O'Neil", True), ("100%", False)}))
#: Characters that a pattern takes as they are; others have a backslash in front.
ESCAPED = """CASE WHEN regexp_matches(c, '[A-Za-z0-9_]') OR unicode(c) > 127 OR contains('%/",:;<=>@!`' || chr(39), c) THEN c ELSE chr(92) || c END"""


def of_class(characters: str) -> str:
    return _written(T._in_class(characters))


@query("token_pattern", rf"""SELECT token, inflect, array_to_string(list_transform(string_split(stem, ''), lambda c: CASE WHEN contains({_written(QUOTES)}, c) THEN {of_class(QUOTES)} WHEN contains({_written(DASHES)}, c) THEN {of_class(DASHES)} ELSE {ESCAPED} END), '')
  || CASE WHEN NOT declines THEN '' WHEN vowel THEN '[а-яёА-ЯЁ]{{1,3}}' ELSE '[а-яёА-ЯЁ]{{0,3}}' END AS pattern
FROM (SELECT *, CASE WHEN vowel THEN left(token, -1) ELSE token END AS stem FROM (SELECT *, declines AND contains({_written(VOWELS)}, lower(right(token, 1))) AS vowel FROM (
  SELECT token, inflect, inflect AND length(token) >= 4 AND regexp_matches(token, '[Ѐ-ӿ]') AND len(regexp_extract_all(token, '\p{{L}}')) = len(regexp_extract_all(token, '[Ѐ-ӿ]')) AS declines FROM {WORDS_OF_FORMS.sql})))""")
def _(spark, sf_dir):
    return spark.createDataFrame([(t, i, T.token_pattern(t, i)) for t, i in WORDS_OF_FORMS.rows], "token string, inflect boolean, pattern string")


PERSONS = Rows("value string, category string", [("Иванов Иван Иванович", "PERSON"), ("John Smith", "person"), ("ООО Ромашка", "ORG"), ("Ромашка", "ORG"), ("GmbH Ab", "ORG"), ("x", "OTHER"), ("One Two Three", "PERSON")])


@query("suggest_variants", rf"""SELECT value, list_filter(CASE
  WHEN upper(category) = 'PERSON' AND len(t) = 3 AND regexp_matches(value, '^[Ѐ-ӿ ]+$') THEN
    [t[1] || ' ' || left(t[2], 1) || '.' || left(t[3], 1) || '.', left(t[2], 1) || '.' || left(t[3], 1) || '. ' || t[1], t[1] || ' ' || left(t[2], 1) || '. ' || left(t[3], 1) || '.', t[1] || ' ' || t[2]]
  WHEN upper(category) = 'PERSON' AND len(t) = 2 THEN [t[2] || ' ' || t[1]]
  WHEN upper(category) = 'ORG' AND bare <> value AND length(bare) >= 3 THEN [bare] ELSE [] END, lambda x: lower(x) <> lower(value)) AS variants
FROM (SELECT value, category, string_split(value, ' ') AS t, regexp_replace(value, '^(?:{"|".join(LEGAL_PREFIXES)})\s+', '') AS bare FROM {PERSONS.sql})""")
def _(spark, sf_dir):
    return PERSONS.df(spark).select("value", T.suggested_variants(F.col("value"), F.col("category")).alias("variants"))


KINDS = Rows("category string", [("ID number!",), ("Контракт",), ("person",), ("__a-b__",), ("",)])


@query("sanitise_category", f"""SELECT category, coalesce(nullif(trim(regexp_replace(upper(category), '[^A-Z0-9]+', '_', 'g'), '_'), ''), 'OTHER') AS clean
FROM (SELECT category FROM {KINDS.sql} UNION SELECT DISTINCT p_type FROM part)""")
def _(spark, sf_dir):
    rows = KINDS.df(spark).unionByName(table(spark, sf_dir, "part").select(F.col("p_type").alias("category"))).distinct()
    return rows.select("category", T.sanitised_category(F.col("category")).alias("clean"))


@query("preview", r"SELECT doc_id, CASE WHEN length(x) <= 200 THEN x ELSE left(x, 200) || '…' END AS line FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents)")
def _(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.preview(F.col("text")).alias("line"))


TEMPLATES = Rows("id int, template string", [(1, 'Say {name} to {lang}: {"a": 1}'), (2, "Needs {other}"), (3, "plain")])


@query("substitute", f"SELECT id, CASE WHEN NOT contains(template, '{{other}}') THEN replace(replace(template, '{{name}}', 'hi $1'), '{{lang}}', 'en') END AS filled FROM {TEMPLATES.sql}")
def _(spark, sf_dir):
    return TEMPLATES.df(spark).select("id", reply.substituted(F.col("template"), {"name": F.lit("hi $1"), "lang": F.lit("en")}).alias("filled"))


@query("missing_inputs", rf"SELECT id, list_sort(list_filter(list_distinct(regexp_extract_all(template, '\{{(\w+)\}}', 1)), lambda x: x NOT IN ('name', 'lang'))) AS missing FROM {TEMPLATES.sql}")
def _(spark, sf_dir):
    return TEMPLATES.df(spark).select("id", reply.missing_inputs(F.col("template"), ["name", "lang"]).alias("missing"))


@query("layered_messages", """SELECT * FROM (VALUES (0, 'user', '[LAYER 1/2]' || chr(10) || 'the schema'), (1, 'assistant', 'Schema contract received. Awaiting business rules.'), (2, 'user', '[LAYER 2/2]' || chr(10) || 'do it')) AS _(i, role, content)""")
def _(spark, sf_dir):
    row = spark.createDataFrame([("the schema", "  ", "do it")], "a string, b string, c string")
    got = reply.layered_messages({"schema_contract": F.col("a"), "business_rules": F.col("b"), "task": F.col("c")})
    return row.select(F.posexplode(got).alias("i", "m")).select("i", "m.role", "m.content")


HEADERS = Rows("header string", [("fr,en;q=0.8",), ("de",), (None,), ("RU-ru, en",), (" en-US",), ("",)])


@query("normalise_lang", f"SELECT header, coalesce(list_filter(list_transform(string_split(header, ','), lambda p: left(lower(trim(string_split(p, ';')[1])), 2)), lambda c: c IN ('ru', 'en'))[1], 'ru') AS lang FROM {HEADERS.sql}")
def _(spark, sf_dir):
    return HEADERS.df(spark).select("header", T.preferred_language(F.col("header")).alias("lang"))


@query("ru_plural", """SELECT doc_id, CASE WHEN n_chars % 100 BETWEEN 11 AND 14 THEN 'файлов' WHEN n_chars % 10 = 1 THEN 'файл' WHEN n_chars % 10 BETWEEN 2 AND 4 THEN 'файла' ELSE 'файлов' END AS word FROM documents""")
def _(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", display.ru_plural(F.col("n_chars"), "файл", "файла", "файлов").alias("word"))


SIZES = "(SELECT doc_id, n_chars * n_chars AS n FROM documents)"


@query("format_size", f"SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN floor(n / 1024 + 0.5)::BIGINT || ' KB' ELSE printf('%.1f', n / 1048576) || ' MB' END AS size FROM {SIZES}")
def _(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", display.size_text(F.col("n_chars") * F.col("n_chars")).alias("size"))


@query("format_duration", """SELECT doc_id, CASE WHEN t < 60 THEN t || ' s' WHEN t % 60 > 0 THEN (t // 60) || ' min ' || (t % 60) || ' s' ELSE (t // 60) || ' min' END AS took
FROM (SELECT doc_id, floor(n_chars / 10.0 + 0.5)::BIGINT AS t FROM documents)""")
def _(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", display.duration_text(F.col("n_chars") / 10).alias("took"))


@query("progress_fraction", """SELECT event_id, CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE least((event_id % 4 + CASE WHEN user_id % 3 > 0 THEN (event_id % 2)::DOUBLE / (user_id % 3) ELSE 0 END) / 3, 0.99)::DOUBLE END AS fraction FROM events""")
def _(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    stage = F.when(F.col("event_type") == "purchase", "done").otherwise("scanning")
    return spread(table(spark, sf_dir, "events")).select("event_id", display.progress_fraction(stage, e % 4, F.lit(3), e % 2, u % 3).cast("double").alias("fraction"))


LISTS = Rows("x string", [("a, b,,c ",), ("",), (" x",)])


@query("csv_list", f"SELECT x, list_filter(list_transform(string_split(x, ','), lambda p: trim(p)), lambda p: p <> '') AS items FROM {LISTS.sql}")
def _(spark, sf_dir):
    return LISTS.df(spark).select("x", T.listed(F.col("x")).alias("items"))


STATUSES = Rows("status int", [(None,), (200,), (400,), (404,), (408,), (422,), (429,), (500,), (503,)])


@query("retry_class", f"SELECT status, CASE WHEN status IS NULL THEN 'final' WHEN status < 400 THEN 'done' WHEN status IN (400, 401, 403, 404, 422) THEN 'final' ELSE 'retry' END AS class FROM {STATUSES.sql}")
def _(spark, sf_dir):
    return STATUSES.df(spark).select("status", reply.retry_class(F.col("status")).alias("class"))


@query("dedup_key", f"SELECT md5(x) AS id, replace(lower({NORMAL.replace('(x,', '(nfc_normalize(x),')}), 'ß', 'ss') AS key FROM {ALL_VALUES}")
def _(spark, sf_dir):
    return spelled(spark, sf_dir).select(F.md5("x").alias("id"), T.dedup_key(F.col("x")).alias("key"))


@query("truncate_log", "SELECT doc_id, left(text, 300) AS line FROM documents")
def _(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.left("text", F.lit(300)).alias("line"))


@query("chunk_sizes", f"SELECT doc_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM {UNIQUE} GROUP BY doc_id")
def _(spark, sf_dir):
    return chunks.unique_paragraphs(paragraphs(docs(spark, sf_dir))).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("skip_errors", "SELECT doc_id FROM documents WHERE n_chars > 100")
def _(spark, sf_dir):
    marked = docs(spark, sf_dir).select("doc_id", F.when(F.col("n_chars") <= 100, "not_ooxml").alias("error"))
    return marked.where("error is null").select("doc_id")


@query("messages", " UNION ALL ".join(f"SELECT {_written(k)} AS key, {_written(lang)} AS lang, {_written(texts[i])} AS text" for k, texts in messages.MESSAGES.items() for i, lang in enumerate(("ru", "en"))))
def _(spark, sf_dir):
    rows = spark.createDataFrame([(k, lang) for k in messages.MESSAGES for lang in ("ru", "en")], "key string, lang string")
    return rows.select("key", "lang", messages.message_column(F.col("key"), F.col("lang")).alias("text"))


@query("headers", "SELECT * FROM (VALUES ('Content-Type', 'application/json'), ('X-Key', 'secret'), ('X-Tenant', 'b')) AS _(name, value)")
def _(spark, sf_dir):
    own = model.Endpoint("http://x", "m", "secret", "X-Key", "", extra_headers=(("X-Tenant", "b"),)).headers()
    return spark.createDataFrame(sorted(own.items()), "name string, value string")


@query("scan_findings", f"SELECT DISTINCT doc_id, 'ORG' AS category, w AS value FROM {UNIQUE}, (SELECT unnest([{listed(WORDS)}]) AS w) WHERE contains(left(text, 9000), w)")
def _(spark, sf_dir):
    asked = model.replies(chunks.of_texts(docs(spark, sf_dir)), model.gazetteer({"org": WORDS}), concurrency=8)
    return model.findings(asked).select("doc_id", "category", "value").distinct()


# ---- detectors: documents, pages and cases that the tables lack

CASES = Rows("id bigint, text string", [(-i - 1, t) for i, t in enumerate([
    "ИНН 7707083893", "INN: 770708389312", "ИНН 77070838931", "ОГРН 1027700132195", "ОГРНИП № 304500116000157", "СНИЛС 112-233-445 95", "счёт DE89370400440532013000 ок",
    "карта 4111 1111 1111 1111", "карта 4111-1111-1111-1111", "карта 4111111111111111", "пишите a@b.ru, позже", "(https://x.y/z", "см. https://x.y/z.", "тел. +7 (495) 123-45-67", "8 800 555 35 35",
])])
TEXTS = f"(SELECT id, text FROM {CASES.sql} UNION ALL SELECT doc_id, text FROM documents UNION ALL SELECT 1000000000 + page_id, html FROM pages)"
#: The same patterns without look-around, which the comparing engine lacks: the neighbours are matched and left out.
W = r"\p{L}\p{N}_"
RE2 = {
    "EMAIL": (rf"(?:^|[^{W}.])([{W}.+-]+@[{W}-]+\.[{W}.-]*[a-zA-Z])(?:$|[^{W}-])", r"regexp_replace(text, '\s', '  ', 'g')"),
    "PHONE": (rf"(?:^|[^{W}])((?:\+7|8|\+\d{{1,3}})[\s\-(]*\d{{2,4}}[\s\-)]*\d{{2,3}}[\s\-]?\d{{2}}[\s\-]?\d{{2,3}})(?:$|[^{W}])", "text"),
    "URL": (r"(?:^|\s)((?:https?://|www\.)[^\s<>""''»]+)", r"regexp_replace(text, '\s', '  ', 'g')"),
    "INN": (r"(?:ИНН|INN)[\s:№.]*(\d{10}|\d{12})(?:$|\D)", "text"),
    "OGRN": (r"(?:ОГРН(?:ИП)?|OGRN)[\s:№.]*(\d{13}|\d{15})(?:$|\D)", "text"),
    "SNILS": (r"(?:^|\D)(\d{3}-\d{3}-\d{3}\s\d{2})(?:$|\D)", "text"),
    "IBAN": (r"(?:^|[^A-Z0-9])([A-Z]{2}\d{2}[A-Z0-9]{11,30})(?:$|[^A-Z0-9])", "text"),
    "CARD": (r"(?:^|\D)((?:\d{4}[ -]){3}\d{4})(?:$|\D)", "text"),
}


def detector(name: str):
    pattern, column = RE2[name]
    pattern = pattern.replace("<>''»", "<>\"''»") if name == "URL" else pattern
    sql = f"""SELECT id, n::INT AS match_ord, v AS value FROM (SELECT id, unnest(range(len(f))) AS n, unnest(f) AS v FROM (
  SELECT id, list_filter(list_transform(regexp_extract_all({column}, '{pattern}', 1), lambda x: trim(x, ' .,;:')), lambda x: x <> '') AS f FROM {TEXTS}))"""

    @query(f"detect_{name.lower()}", sql)
    def _(spark, sf_dir):
        rows = CASES.df(spark).unionByName(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"))
        rows = rows.unionByName(spread(table(spark, sf_dir, "pages")).select((F.col("page_id") + 1_000_000_000).alias("id"), F.col("html").alias("text")))
        return detect.hits(rows, "id", "text", [name]).select("id", "match_ord", "value")


for _name in RE2:
    detector(_name)


@query("detect_all", " UNION ALL ".join(f"SELECT id, '{n}' AS rule, match_ord, value FROM ({SQL[f'detect_{n.lower()}']})" for n in RE2))
def _(spark, sf_dir):
    rows = CASES.df(spark).unionByName(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"))
    rows = rows.unionByName(spread(table(spark, sf_dir, "pages")).select((F.col("page_id") + 1_000_000_000).alias("id"), F.col("html").alias("text")))
    return detect.hits(rows, "id", "text", list(RE2)).select("id", "rule", "match_ord", "value")


# ---- jobs, over the log of events


LOG = "(SELECT user_id AS job_id, ts AS \"at\", event_id, event_type AS status FROM events)"


def log(spark, sf_dir):
    return spread(table(spark, sf_dir, "events")).select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"), "event_id", F.col("event_type").alias("status"), "value")


@query("job_status", f"SELECT job_id, arg_max(status, (\"at\", event_id)) AS status, max(\"at\") AS updated_at FROM {LOG} GROUP BY job_id")
def _(spark, sf_dir):
    return jobs.last_status(log(spark, sf_dir))


@query("expired_jobs", f"SELECT job_id FROM (SELECT job_id, max(\"at\") AS updated_at FROM {LOG} GROUP BY job_id) WHERE updated_at < (SELECT max(\"at\") FROM {LOG}) - INTERVAL 240 MINUTE")
def _(spark, sf_dir):
    rows = log(spark, sf_dir)
    last = rows.agg(F.max("at").alias("now"))
    return jobs.expired(jobs.last_status(rows).join(F.broadcast(last)), F.col("now")).select("job_id")


STEPS = "(SELECT user_id AS job_id, ts AS \"at\", event_id, event_type AS stage, (event_id % 2)::VARCHAR AS document, event_id % 5 AS done, 5 AS total FROM events)"


@query("progress_eta", f"""SELECT event_id, CASE WHEN done > 0 AND done < total THEN (epoch_us("at") - epoch_us(min("at") OVER (PARTITION BY job_id, session))) / 1e6 / done * (total - done) END AS eta
FROM (SELECT *, sum(new) OVER (PARTITION BY job_id ORDER BY "at", event_id) AS session FROM (SELECT *, CASE WHEN stage IS NOT DISTINCT FROM lag(stage) OVER w AND document IS NOT DISTINCT FROM lag(document) OVER w THEN 0 ELSE 1 END AS new
FROM {STEPS} WINDOW w AS (PARTITION BY job_id ORDER BY "at", event_id)))""")
def _(spark, sf_dir):
    rows = log(spark, sf_dir).select("job_id", "at", "event_id", F.col("status").alias("stage"), (F.col("event_id") % 2).cast("string").alias("document"), (F.col("event_id") % 5).alias("done"), F.lit(5).alias("total"))
    return jobs.eta(rows, "job_id").select("event_id", "eta")


@query("poll_sample", """SELECT event_id, nth::INT AS nth FROM (SELECT *, ms >= 2000 OR status >= 400 AS odd, row_number() OVER (PARTITION BY path, poll, ms >= 2000 OR status >= 400 ORDER BY event_id) AS nth FROM (
  SELECT event_id, event_type AS path, user_id % 2 = 0 AS poll, CASE WHEN event_id % 50 = 0 THEN 500 ELSE 200 END AS status, event_id % 2100 AS ms FROM events)) WHERE odd OR NOT poll OR nth % 20 = 0""")
def _(spark, sf_dir):
    e = F.col("event_id")
    rows = log(spark, sf_dir).select("event_id", F.col("status").alias("path"), (F.col("job_id") % 2 == 0).alias("is_poll"), F.when(e % 50 == 0, 500).otherwise(200).alias("status"), (e % 2100).alias("ms"))
    return jobs.logged_requests(rows).select("event_id", "nth")


@query("miss_streak", """SELECT job_id, max(n)::BIGINT AS longest FROM (SELECT job_id, island, count(*) AS n FROM (
  SELECT *, row_number() OVER w - sum(missed::INT) OVER w AS island FROM (SELECT user_id AS job_id, ts, event_id, event_id % 3 <> 0 AS missed FROM events) WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)) WHERE missed GROUP BY job_id, island) GROUP BY job_id""")
def _(spark, sf_dir):
    return jobs.miss_streaks(log(spark, sf_dir).withColumn("missed", F.col("event_id") % 3 != 0), "job_id")


# ---- the whole of analyse, over documents with a model's findings: words, with their other spellings as aliases

FOUND = f"(SELECT unnest([{listed(WORDS)}]) AS w)"
#: Mails and phones of lines, as in the detectors' SQL, with where each stands first.
HITS = " UNION ALL ".join(
    f"SELECT doc_id, para_no, {n} AS rule_ord, '{k}' AS category, unnest(list_filter(list_transform(regexp_extract_all({RE2[k][1]}, '{RE2[k][0]}', 1), lambda x: trim(x, ' .,;:')), lambda x: x <> '')) AS value FROM ({LINES})"
    for n, k in enumerate(("EMAIL", "PHONE"))
)
EITHER = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


@query("analyse_documents", rf"""WITH hits AS ({HITS}),
spelled AS (SELECT category, value, lower({NORMAL.replace('(x,', '(value,')}) AS key, min((doc_id, rule_ord, para_no)) AS seq FROM hits GROUP BY category, value),
firsts AS (SELECT key, arg_min(category, seq) AS category, arg_min(value, seq) AS value, list(DISTINCT value) AS forms FROM spelled GROUP BY key),
rules AS (SELECT key, category, value, list_filter(forms, lambda x: x <> value) AS variants, 'rule' AS source, doc_id, length(t) - length(replace(t, chr(1), '')) AS n
  FROM (SELECT f.*, doc_id, regexp_replace(d.text, '{EITHER[0]}(?:' || array_to_string(list_transform(list_sort(f.forms, 'DESC'), lambda x: regexp_escape(x)), '|') || '){EITHER[1]}', '\1' || chr(1) || '\2', 'g') AS t
    FROM firsts f JOIN documents d ON len(list_filter(f.forms, lambda x: contains(d.text, x))) > 0)),
words AS (SELECT w AS key, 'ORG' AS category, w AS value, [upper(w), upper(left(w, 1)) || substr(w, 2)] AS variants, 'llm' AS source, doc_id,
  len(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda x: x IN (w, upper(w), upper(left(w, 1)) || substr(w, 2)))) AS n FROM documents, {FOUND}),
totals AS (SELECT key, category, value, any_value(list_sort(variants)) AS variants, source, sum(n)::BIGINT AS total, count(*) AS documents FROM (SELECT * FROM rules UNION ALL SELECT * FROM words) WHERE n > 0 GROUP BY key, category, value, source)
SELECT category, value, variants, source, total, documents, row_number() OVER (ORDER BY category, total DESC, value)::INT AS place FROM totals""")
def _(spark, sf_dir):
    said = [(0, "org", w, [w.upper(), w.capitalize()], i) for i, w in enumerate(WORDS)]
    found = spark.createDataFrame(said, "doc_id bigint, category string, value string, aliases array<string>, seq int")
    out = lifecycle.analyse(docs(spark, sf_dir), lifecycle.Settings(detectors=("EMAIL", "PHONE")), found)
    return out.select("category", "value", F.array_sort("variants").alias("variants"), "source", "total", "documents", "place")
