"""Replacing values by tags in one pass, and tags by values again."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.constants import TAG_PREFIX, TAG_SUFFIX
from palimpsest.functions.text import entity_pattern, for_java
from palimpsest.operators import occurrences

#: Up to so many characters of patterns every text is read with one alternation of all; beyond it, with one of the entities that it may have.
NATIVE_CHARS = 2_000


def alternation(entities: list[dict], any_case: bool = False) -> list[tuple[str, str]]:
    """(tag, pattern) of entities (value, variants, inflect, tag): those with the longest form first, else as given."""
    forms = [[e["value"], *e.get("variants", [])] for e in entities]
    order = sorted(range(len(entities)), key=lambda i: -max(map(len, forms[i])))
    rows = [(entities[i]["tag"], entity_pattern(forms[i], entities[i].get("inflect", False), any_case)) for i in order]
    return [r for r in rows if r[1]]


def woven(text: Column, pattern: str | Column, replaced, found: Column | None = None) -> Column:
    """``text`` with ``replaced(match)`` for each match, leftmost first, nothing looked at twice; ``found`` are the matches, if known."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) if found is None else found
    gaps = F.split(text, pattern, -1)
    pieces = F.transform(gaps, lambda gap, i: F.concat(gap, F.coalesce(replaced(F.get(found, i)), F.lit(""))))
    return F.when(F.size(found) > 0, F.array_join(pieces, "")).otherwise(text)


def matches(text: Column, rules: list[tuple[str, str]]) -> Column:
    """What the rules' alternation matches, in order."""
    if not rules:
        return F.array().cast("array<string>")
    return F.regexp_extract_all(text, F.lit(for_java("|".join(p for _, p in rules))), F.lit(0))


def spelled(entities: list[dict], rules: list[tuple[str, str]]) -> dict[str, str]:
    """Each spelling as it's written, with the tag of the first rule that matches all of it."""
    compiled = [(tag, re.compile(pattern)) for tag, pattern in rules]
    forms = dict.fromkeys(f for e in entities for f in [e["value"], *e.get("variants", [])])
    found = {f: next((tag for tag, p in compiled if p.fullmatch(f)), None) for f in forms}
    return {f: tag for f, tag in found.items() if tag}


def tag_of(match: Column, rules: list[tuple[str, str]], known: dict[str, str] | None = None) -> Column:
    """The tag of the first rule that matches all of ``match``; this is the one that matched in context.

    What is written like one of the ``known`` spellings is looked up; endings and
    other quotes, dashes or spaces are tried rule by rule.
    """
    out = F.lit(None).cast("string")
    for tag, pattern in reversed(rules):
        out = F.when(match.rlike(rf"(?U)\A(?:{pattern})\z"), tag).otherwise(out)
    if known:
        table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
        out = F.coalesce(F.try_element_at(table, F.coalesce(match, F.lit(""))), out)
    return out


def redacted(text: Column, rules: list[tuple[str, str]], known: dict[str, str] | None = None, found: Column | None = None) -> Column:
    """``text`` with every value of the rules replaced by its tag."""
    if not rules:
        return text
    return woven(text, for_java("|".join(p for _, p in rules)), lambda m: F.when(m.isNotNull(), tag_of(m, rules, known)), found)


def _with_rules(docs: DataFrame, rules: list[tuple[str, str]], entities: list[dict], text: str) -> DataFrame:
    """``docs`` with ``__rules``: (rank, tag, pattern) of the entities that a text may have, in the alternation's order.

    Texts are joined by their hash, so rows need no key; two texts of one hash only share what is tried.
    """
    forms = {e["tag"]: ([e["value"], *e.get("variants", [])], bool(e.get("inflect", False))) for e in entities}
    own = [((i, tag), pattern, *forms[tag]) for i, (tag, pattern) in enumerate(rules)]
    table = docs.sparkSession.createDataFrame(own, "entity_id struct<rank:int,tag:string>, pattern string, forms array<string>, inflect boolean")
    marked = docs.withColumn("__text", F.xxhash64(F.col(text)))
    tried = occurrences.near(marked.select("__text", text).where(F.col(text).isNotNull()), table, "__text", text)
    some = F.transform("tried", lambda e: F.struct(e["entity_id"]["rank"].alias("rank"), e["entity_id"]["tag"].alias("tag"), e["pattern"].alias("pattern")))
    out = marked.join(tried.select("__text", F.sort_array(some).alias("__rules")), "__text", "left").drop("__text")
    return out.withColumn("__rules", F.coalesce("__rules", F.array().cast("array<struct<rank:int,tag:string,pattern:string>>")))


def redact(docs: DataFrame, entities: list[dict], text: str = "text", any_case: bool = False, native_chars: int = NATIVE_CHARS) -> DataFrame:
    """``docs`` with ``text`` redacted and ``replacements``, how many values were.

    ``entities`` is the reviewed list of one job (value, variants, inflect, tag); it goes
    along with the plan, and texts aren't shuffled.  A long list, of over ``native_chars`` characters of patterns, is
    joined with the texts by anchors, as for counting, and each text is read with an alternation
    of what it may have; what is replaced is the same.  Null texts stay null with 0 replacements.
    """
    rules = alternation(entities, any_case)
    count = F.coalesce(F.greatest(F.size("__matches"), F.lit(0)), F.lit(0))
    if sum(len(p) for _, p in rules) <= native_chars:
        rows = docs.withColumn("__matches", matches(F.col(text), rules))
        return rows.withColumn("replacements", count).withColumn(text, redacted(F.col(text), rules, spelled(entities, rules), F.col("__matches"))).drop("__matches")
    rows = _with_rules(docs, rules, entities, text)
    whole = for_java(F.array_join("__rules.pattern", "|"))
    any_ = F.size("__rules") > 0
    rows = rows.withColumn("__matches", F.when(any_, F.regexp_extract_all(F.col(text), whole, F.lit(0))).otherwise(F.array().cast("array<string>")))
    first = lambda m: F.get(F.filter("__rules", lambda r: F.rlike(m, F.concat(F.lit(r"(?U)\A(?:"), r["pattern"], F.lit(r")\z")))), F.lit(0))["tag"]
    done = F.when(any_, woven(F.col(text), whole, lambda m: F.when(m.isNotNull(), first(m)), F.col("__matches"))).otherwise(F.col(text))
    return rows.withColumn("replacements", F.when(F.col(text).isNotNull(), count).otherwise(0)).withColumn(text, done).drop("__matches", "__rules")


def hits(docs: DataFrame, entities: list[dict], text: str = "text") -> DataFrame:
    """(tag, n): how often each tag is put in, over all texts."""
    rules = alternation(entities)
    rows = docs.select(F.explode(matches(F.col(text), rules)).alias("m"))
    return rows.groupBy("m").count().groupBy(tag_of(F.col("m"), rules, spelled(entities, rules)).alias("tag")).agg(F.sum("count").alias("n"))


def tag_pattern(prefix: str = TAG_PREFIX, suffix: str = TAG_SUFFIX) -> str:
    return re.escape(prefix) + "[A-Z0-9_]{1,64}" + re.escape(suffix)


def tags_in(text: Column, prefix: str = TAG_PREFIX, suffix: str = TAG_SUFFIX) -> Column:
    return F.regexp_extract_all(text, F.lit(tag_pattern(prefix, suffix)), F.lit(0))


def restored(text: Column, mapping: Column, prefix: str = TAG_PREFIX, suffix: str = TAG_SUFFIX) -> Column:
    """``text`` with each tag that the map has replaced by its value; other tags stay."""
    return woven(text, tag_pattern(prefix, suffix), lambda m: F.coalesce(F.try_element_at(mapping, F.coalesce(m, F.lit(""))), m))


def restore(docs: DataFrame, mapping: DataFrame, key: str = "doc_id", text: str = "text", prefix: str = TAG_PREFIX, suffix: str = TAG_SUFFIX) -> DataFrame:
    """``docs`` with its tags replaced by a mapping (tag, value), with the numbers of mapped and unmapped ones.

    The tags of a text are joined with the mapping, and what they stand for
    comes back as one small map a text, so that the mapping may be of any size.
    """
    used = docs.select(key, F.explode(F.array_distinct(tags_in(F.col(text), prefix, suffix))).alias("tag"))
    found = used.join(mapping, "tag").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("tag", "value"))).alias("own"))
    out = docs.join(found, key, "left").withColumn("own", F.coalesce("own", F.create_map().cast("map<string,string>")))
    all_ = tags_in(F.col(text), prefix, suffix)
    known = F.size(F.filter(all_, lambda t: F.map_contains_key("own", t)))
    out = out.withColumn("mapped", known).withColumn("unmapped", F.size(all_) - known)
    return out.withColumn(text, restored(F.col(text), F.col("own"), prefix, suffix)).drop("own")


def unmapped(docs: DataFrame, mapping: DataFrame, text: str = "text", prefix: str = TAG_PREFIX, suffix: str = TAG_SUFFIX) -> DataFrame:
    """The different tags of all texts that the mapping doesn't have."""
    return docs.select(F.explode(tags_in(F.col(text), prefix, suffix)).alias("tag")).distinct().join(mapping.select("tag"), "tag", "left_anti")


def taken_numbers(docs: DataFrame, text: str = "text", prefix: str = TAG_PREFIX, suffix: str = TAG_SUFFIX) -> dict[str, int]:
    """The highest number of each category that tag-shaped text has already, before anything is replaced.

    A category has at most 64 characters; the thousand with the highest numbers are looked at.
    """
    inner = F.regexp_extract_all(F.col(text), F.lit(re.escape(prefix) + "([A-Z0-9_]{1,64})" + re.escape(suffix)), F.lit(1))
    tags = docs.select(F.explode(inner).alias("t")).select(F.regexp_extract("t", r"\A(.*)_([0-9]{1,9})\z", 1).alias("kind"), F.regexp_extract("t", r"\A(.*)_([0-9]{1,9})\z", 2).try_cast("int").alias("n"))
    rows = tags.where("kind <> ''").groupBy("kind").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "kind").limit(1000).collect()
    return {r["kind"]: r["n"] for r in rows}


def key_file(job_id: str, created_at: str, documents: list[dict], entities: list[dict], prefix: str = TAG_PREFIX, suffix: str = TAG_SUFFIX) -> str:
    """The key that restores a job, as JSON; it holds every secret, so don't put it beside the redacted files."""
    head = {"version": 1, "job_id": job_id, "created_at": created_at, "tag_prefix": prefix, "tag_suffix": suffix}
    return json.dumps(head | {"documents": documents, "entities": entities}, ensure_ascii=False, indent=2)


MAPPING = "struct<tag_prefix:string,tag_suffix:string,entities:array<struct<tag:string,category:string,value:string,variants:array<string>,replacements:bigint>>>"


def parsed_mapping(files: DataFrame, content: str = "content") -> DataFrame:
    """Key files (job_id, content) to (job_id, tag, value, tag_prefix, tag_suffix); entries without tag or value are
    left out, the last of a repeated tag stands."""
    body = F.from_json(F.regexp_replace(F.col(content), "\\A\ufeff", ""), MAPPING)
    rows = files.select("job_id", body.alias("b")).select("job_id", F.coalesce("b.tag_prefix", F.lit(TAG_PREFIX)).alias("tag_prefix"), F.coalesce("b.tag_suffix", F.lit(TAG_SUFFIX)).alias("tag_suffix"), F.posexplode("b.entities").alias("pos", "e"))
    rows = rows.where("e.tag <> '' and e.value is not null")
    return rows.groupBy("job_id", F.col("e.tag").alias("tag"), "tag_prefix", "tag_suffix").agg(F.max_by("e.value", "pos").alias("value"))
