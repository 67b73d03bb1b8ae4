"""The queries of this subpackage, over the tables of a folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import ann, decontaminate, html, licenses, mixing, pii, quality, simhash, substring, toxicity
from palimpsest.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in pii.KINDS]
    base = pii.written(F.concat(*[pii.base_of(k) for k in pii.KINDS]))
    return rows.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), pii.written(F.col("pii_spans")).alias("spans"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.deduplicate(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html.main_text(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", *joined, "score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.sort_array("hit_items"), ",")
    return rows.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated")


OP5_SQL = """
WITH rows AS (
  SELECT doc_id, source, md5('17:' || coalesce(doc_id::VARCHAR, '')) AS draw,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM rows GROUP BY source),
caps AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM sources),
sums AS (
  SELECT *, coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS from_here
  FROM caps WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)),
level AS (
  SELECT arg_min((total - before) / from_here, before) AS level FROM sums
  WHERE weight * ((total - before) / from_here) <= cap),
goals AS (
  SELECT source, source_size,
         CASE WHEN level IS NULL THEN cap ELSE least(cap, weight * level) END::DOUBLE AS target
  FROM sums, level),
reps AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM goals),
rests AS (SELECT *, round(target - whole * source_size)::BIGINT AS rest FROM reps),
groups AS (SELECT source, draw, sum(size)::BIGINT AS group_size FROM rows GROUP BY source, draw),
placed AS (
  SELECT *, coalesce(sum(group_size) OVER (PARTITION BY source ORDER BY draw
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM groups)
SELECT r.doc_id, r.size, g.source_size, g.target,
       (g.whole * r.size + CASE
          WHEN p.start + p.group_size <= g.rest THEN r.size
          WHEN p.start >= g.rest THEN 0
          ELSE floor(r.size * (g.rest - p.start) / p.group_size) END)::BIGINT AS taken
FROM rows r JOIN rests g ON r.source IS NOT DISTINCT FROM g.source
JOIN placed p ON r.source IS NOT DISTINCT FROM p.source AND r.draw = p.draw
"""

OP6_SQL = """
WITH doc_words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id::VARCHAR AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS key
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS key
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, sizes WHERE len(w) >= n)),
hits AS (SELECT p.r, p.i, p.n, x.item FROM places p JOIN windows x ON p.n = x.n AND p.key = x.key),
covered AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS word FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""


OP7_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT r, doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS key
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs WHERE len(w) >= 20)),
later AS (SELECT r, i FROM windows QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, r, i) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS place FROM later),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS place, unnest(w) AS word FROM docs),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS body FROM words ANTI JOIN gone USING (r, place) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""


def _listed(rows) -> str:
    return ", ".join("(" + ", ".join(repr(x) for x in row) + ")" for row in rows)


def _words(text: str) -> list[str]:
    return [w.decode() for w in licenses.tokens(text)]


_PHRASES = _listed((k, _words(v)) for k, v in licenses.PHRASES.items())
_NOTICES = _listed((i, label, sorted(set(_words(text))), len(_words(text)), _words(telling)) for i, (label, text, telling) in enumerate(licenses.NOTICES))

OP10_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT r, doc_id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM docs),
phrases(label, own) AS (VALUES {_PHRASES}),
texts(notice, label, own, size, telling) AS (VALUES {_NOTICES}),
notices AS (SELECT *, greatest(1, ceil(0.8 * len(own) - 1e-9))::INT AS least, ceil(size / 0.8 - 1e-9)::INT AS width FROM texts),
base AS (
  SELECT r, label, i - 1 AS at_word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM words), phrases
  WHERE w[i] = own[1] AND w[i : i + len(own) - 1] = own),
lines AS (
  SELECT r, i, regexp_extract_all(line, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM (SELECT r, generate_subscripts(string_split(t, chr(10)), 1) AS i, unnest(string_split(t, chr(10))) AS line FROM docs)),
parts AS (SELECT r, i, w, count(*) FILTER (len(w) = 0) OVER (PARTITION BY r ORDER BY i) AS p FROM lines),
placed AS (
  SELECT r, p, word, row_number() OVER (PARTITION BY r, p ORDER BY i, k) AS at_word
  FROM (SELECT r, p, i, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM parts WHERE len(w) > 0)),
own_words AS (SELECT notice, least, width, telling, unnest(own) AS word FROM notices),
hits AS (SELECT r, p, notice, at_word, word, least, width, telling FROM placed JOIN own_words USING (word)),
near AS (SELECT r, p, notice FROM hits GROUP BY r, p, notice HAVING count(DISTINCT word) >= any_value(least)),
tried AS (SELECT * FROM hits SEMI JOIN near USING (r, p, notice)),
latest AS (
  SELECT a.r, a.p, a.notice, a.at_word, b.word, max(b.at_word) AS last_at
  FROM tried a JOIN tried b ON a.r = b.r AND a.p = b.p AND a.notice = b.notice AND b.at_word <= a.at_word AND b.at_word > a.at_word - a.width
  GROUP BY a.r, a.p, a.notice, a.at_word, b.word),
ends AS (
  SELECT l.r, l.p, l.notice, l.at_word, count(*) AS n, min(last_at) AS first_at,
         count(*) >= any_value(x.least) AND list_has_all(list(l.word), any_value(x.telling)) AS good
  FROM latest l JOIN notices x ON x.notice = l.notice GROUP BY l.r, l.p, l.notice, l.at_word),
runs AS (
  SELECT *, count(*) FILTER (NOT good) OVER (PARTITION BY r, p, notice ORDER BY at_word) AS run FROM ends),
best AS (
  SELECT r, p, notice, max(n) AS n, arg_min(first_at, (-n, at_word)) AS first_at, arg_min(at_word, (-n, at_word)) AS last_at
  FROM runs WHERE good GROUP BY r, p, notice, run),
found AS (
  SELECT b.r, x.label, b.n / len(x.own) AS share FROM best b JOIN notices x USING (notice)
  WHERE NOT EXISTS (
    SELECT 1 FROM best o JOIN notices y ON y.notice = o.notice
    WHERE o.r = b.r AND o.p = b.p AND o.first_at <= b.last_at AND o.last_at >= b.first_at
      AND list_has_all(y.telling, x.telling) AND NOT list_has_all(x.telling, y.telling))),
of_base AS (
  SELECT r, count(*) AS n_base, min(at_word) AS first_word, max(at_word) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM base GROUP BY r),
of_all AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS share
  FROM (SELECT r, label, share FROM found UNION ALL SELECT r, label, 1.0 FROM base) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(share, 0)::DOUBLE AS score
FROM words LEFT JOIN of_base USING (r) LEFT JOIN of_all USING (r)
"""


def queries() -> dict:
    found = (op1_simhash, op2_ann, op3_pii, op4_toxicity, op5_mixing, op6_decontaminate, op7_substring, op8_quality, op9_html, op10_licenses)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": OP5_SQL, "op6_decontaminate": OP6_SQL, "op7_substring": OP7_SQL, "op10_licenses": OP10_SQL}
