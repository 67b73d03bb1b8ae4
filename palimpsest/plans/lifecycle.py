"""The ways through the engine: analyse, review, redact and restore, for tables of texts and for Office packages."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import display
from palimpsest.functions import text as T
from palimpsest.functions.constants import CATEGORIES, CHUNK_CHARS, JOB_TTL_MINUTES, LANGUAGES, MAX_FILES, MAX_UPLOAD_MB, TAG_PREFIX, TAG_SUFFIX
from palimpsest.functions.text import entity_pattern
from palimpsest.operators import candidates, chunks, detect, entities, jobs, manifest, occurrences, redact
from palimpsest.sources import model, ooxml, prompts
from palimpsest.sources.tables import cut, paragraphs


@dataclass(frozen=True)
class Settings:
    detectors: tuple[str, ...] | None = None
    categories: tuple[str, ...] = tuple(CATEGORIES)
    inflecting: tuple[str, ...] = ("PERSON",)
    case_sensitive: bool = True
    prefix: str = TAG_PREFIX
    suffix: str = TAG_SUFFIX
    chunk_chars: int = CHUNK_CHARS
    split_long: bool = True
    scrub_metadata: bool = True
    max_files: int = MAX_FILES
    max_upload_mb: int = MAX_UPLOAD_MB
    job_ttl_minutes: int = JOB_TTL_MINUTES
    language: str = LANGUAGES[0]
    template: str = ""
    model_url: str = ""
    model_name: str = ""
    model_key: str = ""
    model_header: str = "Authorization"
    model_scheme: str = "Bearer"
    model_timeout: float = 180.0
    model_temperature: float = 0.0
    model_max_tokens: int = 4096
    model_concurrency: int = 3
    model_retries: int = 2
    model_extra_headers: str = "{}"
    model_extra_body: str = "{}"

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, prefix: str = "PALIMPSEST_") -> Settings:
        """Settings of environment variables: lists comma-separated, those not set as they are by default."""
        env, given = os.environ if env is None else env, {}
        for f in fields(cls):
            if (text := env.get(prefix + f.name.upper())) is not None:
                kind = tuple if f.default is None else type(f.default)
                read = {tuple: lambda t: tuple(x.strip() for x in t.split(",") if x.strip()), bool: lambda t: t.strip().lower() in {"1", "true", "yes", "on"}}.get(kind, kind)
                given[f.name] = read(text)
        return cls(**given)

    def endpoint(self) -> model.Endpoint | None:
        """The model that is set, if one is; objects that can't be read add nothing."""
        if not (self.model_url and self.model_name):
            return None

        def pairs(text: str) -> tuple:
            try:
                found = json.loads(text or "{}")
            except ValueError:
                return ()
            return tuple(found.items()) if isinstance(found, dict) else ()

        headers = tuple((k, str(v)) for k, v in pairs(self.model_extra_headers))
        return model.Endpoint(
            self.model_url, self.model_name, self.model_key, self.model_header, self.model_scheme, self.model_timeout, self.model_retries, self.model_max_tokens, self.model_temperature, headers, pairs(self.model_extra_body)
        )


NONE = "array<string>"


def found_values(docs: DataFrame, settings: Settings, findings: DataFrame | None) -> DataFrame:
    """(category, value, source, seq, normal, key): detectors' and a model's finds, each spelling once, without what says nothing."""
    found = detect.hits(paragraphs(docs).withColumn("doc_id", F.struct("doc_id", "para_no")), names=settings.detectors)
    rows = found.select("category", "value", F.lit("rule").alias("source"), F.struct("doc_id.doc_id", "rule_ord", "doc_id.para_no", "match_ord").alias("seq"))
    if findings is not None:
        own = candidates.coerced(findings.withColumn("source", F.lit("llm")), list(settings.categories))
        rows = rows.unionByName(own.select("category", "value", "source", F.struct("doc_id", F.lit(1000).alias("rule_ord"), F.lit(0).alias("para_no"), F.col("seq").cast("int").alias("match_ord")).alias("seq")))
    # Normal forms of different values only: the one step in Python sees each value once.
    keyed = rows.groupBy("category", "value", "source").agg(F.min("seq").alias("seq"))
    keyed = keyed.withColumn("normal", T.normalise(F.col("value"))).withColumn("key", T.casefold(F.col("normal")))
    return candidates.without_generic(keyed, "normal")


def named_otherwise(findings: DataFrame | None) -> DataFrame | None:
    """(key, alias) of a model's findings, if it says any."""
    if findings is None or "aliases" not in findings.columns:
        return None
    rows = findings.select("value", F.explode("aliases").alias("alias")).distinct()
    rows = rows.select(T.dedup_key(F.col("value")).alias("key"), T.normalise(F.col("alias")).alias("alias"))
    return candidates.without_generic(rows, "alias")


def grounded(docs: DataFrame, suggested: DataFrame, settings: Settings) -> DataFrame:
    """Those of (entity_id, form, inflect) whose form stands in some text."""
    forms = suggested.select("form", "inflect").distinct().withColumn("forms", F.array("form")).withColumn("pattern", _pattern("forms", "inflect", settings))
    there = occurrences.count_occurrences(docs, forms.withColumn("entity_id", F.struct("form", "inflect"))).select("entity_id.*").distinct()
    return suggested.join(there, ["form", "inflect"], "left_semi")


def counted(docs: DataFrame, forms: DataFrame, settings: Settings) -> DataFrame:
    """(entity_id, total, documents) of the entities (entity_id, value, variants, inflect) that stand in some text."""
    patterned = forms.withColumn("forms", F.concat(F.array("value"), "variants")).withColumn("pattern", _pattern("forms", "inflect", settings))
    return occurrences.count_occurrences(docs, patterned).groupBy("entity_id").agg(F.sum("n").alias("total"), F.count("*").alias("documents"))


def analyse(docs: DataFrame, settings: Settings = Settings(), findings: DataFrame | None = None) -> DataFrame:
    """(doc_id, text) to entities for review: entity_id, category, value, key, variants, source, inflect, selected, total, documents, place.

    ``findings`` (doc_id, category, value, seq, and aliases if there are any) are a model's, if there is one.
    Values that share a key are one candidate.  Its variants are its other
    spellings, the model's aliases, and what a person's or company's name suggests as far as it stands in the
    texts.  Candidates that stand nowhere go; those that are spellings of one
    thing become one, and are counted anew.  Between the passes over the texts
    only values are shuffled, pre-aggregated by key.
    """
    texts = docs.select("doc_id", "text")
    firsts = candidates.dedup_candidates(found_values(docs, settings, findings), *()).withColumn("entity_id", F.sha2("key", 256)).withColumn("normal", T.normalise(F.col("value")))
    firsts = cut(firsts.withColumn("inflect", F.upper("category").isin([c.upper() for c in settings.inflecting])))
    suggested = firsts.where(F.upper("category").isin("PERSON", "ORG")).select("entity_id", "inflect", F.explode(T.suggested_variants(F.col("normal"), F.col("category"))).alias("form"))
    more = grounded(texts, cut(suggested), settings).groupBy("entity_id").agg(F.sort_array(F.collect_set("form")).alias("more"))
    aliases = named_otherwise(findings)
    rows = candidates.with_aliases(firsts, aliases) if aliases is not None else firsts.withColumn("aliases", F.array().cast(NONE))
    rows = rows.join(more, "entity_id", "left")
    forms = F.array_distinct(F.concat("spellings", F.coalesce("more", F.array().cast(NONE)), "aliases"))
    rows = rows.withColumn("variants", F.array_except(forms, F.array("value"))).select("entity_id", "key", "category", "value", "variants", "source", "inflect", "seq")
    rows = cut(rows)
    built = cut(rows.join(counted(texts, rows, settings), "entity_id"))
    one = cut(entities.merged(built.withColumn("job_id", F.lit("")).withColumnRenamed("entity_id", "id")).withColumnRenamed("id", "entity_id").drop("job_id"))
    before = built.select("entity_id", "key", "total", "documents", F.col("variants").alias("__variants"))
    both = one.join(before, "entity_id")
    same = F.sort_array("variants") == F.sort_array("__variants")
    anew = both.where(~same).drop("total", "documents", "__variants")
    rows = both.where(same).drop("__variants").unionByName(anew.join(counted(texts, anew, settings), "entity_id"))
    return entities.ordered(rows.withColumn("selected", F.lit(True)))


def _pattern(forms: str, inflect: str, settings: Settings = Settings()) -> Column:
    """The pattern of each entity, for columns of spellings and of whether they inflect."""
    any_case = not settings.case_sensitive

    @F.pandas_udf("string")
    def run(spellings: pd.Series, inflects: pd.Series) -> pd.Series:
        return pd.Series([entity_pattern(list(s), bool(i), any_case) for s, i in zip(spellings, inflects, strict=True)])

    return run(F.col(forms), F.col(inflect))


def tagged(reviewed: DataFrame, settings: Settings = Settings(), docs: DataFrame | None = None) -> DataFrame:
    """The selected entities that occur, with their tags; numbers go on from those that ``docs`` have in tag-shaped text."""
    rows = reviewed.where("total > 0")
    rows = rows.where("selected") if "selected" in rows.columns else rows
    taken = redact.taken_numbers(docs, "text", settings.prefix, settings.suffix) if docs is not None else None
    return entities.with_tags(rows, prefix=settings.prefix, suffix=settings.suffix, taken=taken)


def dictionary(tagged_entities: DataFrame, most: int = 50_000) -> list[dict]:
    """The reviewed list on the driver; a person has gone over it, and more than ``most`` rows are refused."""
    rows = tagged_entities.select("tag", "category", "value", "variants", "inflect", "place").orderBy("place").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} entities are selected")
    return [r.asDict() for r in rows]


def redact_documents(docs: DataFrame, reviewed: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return redact.redact(docs, dictionary(tagged(reviewed, settings, docs)), any_case=not settings.case_sensitive)


def delimiters(mapping: DataFrame, settings: Settings = Settings()) -> tuple[str, str]:
    """The delimiters that a key names, else those of the settings; a mapping of keys that name different ones is an error."""
    if not {"tag_prefix", "tag_suffix"} <= set(mapping.columns):
        return settings.prefix, settings.suffix
    named = mapping.select("tag_prefix", "tag_suffix").distinct().limit(2).collect()
    if len(named) > 1:
        raise ValueError("the keys have different delimiters: restore with one at a time")
    return (named[0][0], named[0][1]) if named else (settings.prefix, settings.suffix)


def restore_documents(docs: DataFrame, mapping: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Tags replaced by a mapping (tag, value, and the key's tag_prefix and tag_suffix, which then count)."""
    prefix, suffix = delimiters(mapping, settings)
    return redact.restore(docs, mapping.select("tag", "value"), prefix=prefix, suffix=suffix)


def unmapped_tags(docs: DataFrame, mapping: DataFrame, settings: Settings = Settings()) -> DataFrame:
    prefix, suffix = delimiters(mapping, settings)
    return redact.unmapped(docs, mapping, prefix=prefix, suffix=suffix)


def scan(docs: DataFrame, client: model.Client, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """A model's findings for ``analyse``, and the warnings of chunks it didn't answer for; each chunk is asked about once."""
    pieces = chunks.of_texts(docs, settings.chunk_chars, split_long=settings.split_long)
    template = prompts.Template.read(settings.template) if settings.template else None
    answers = model.replies(pieces, client, template, settings.model_concurrency).persist(StorageLevel.MEMORY_AND_DISK)
    return model.findings(answers), model.warnings(answers)


def review(reviewed: DataFrame, patches: DataFrame, docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Entities after a reviewer's changes; totals are counted again, as spellings may be others now."""
    rows = jobs.patched(reviewed.withColumnRenamed("entity_id", "id"), patches).withColumnRenamed("id", "entity_id").drop("total", "documents", "place")
    rows = rows.join(counted(docs.select("doc_id", "text"), rows, settings), "entity_id", "left").fillna(0, ["total", "documents"])
    return entities.ordered(rows)


# ---- packages


def package_texts(files: DataFrame) -> DataFrame:
    """Files (path, content) to (doc_id, text), a path and its paragraphs in lines; files that can't be read have none."""
    return ooxml.package_texts(files).where("text is not null").select(F.col("path").alias("doc_id"), "text")


def redact_packages(files: DataFrame, reviewed: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, list[dict]]:
    """Files (path, content) to (path, name, content, replacements, error), and the tagged entities that the key needs."""
    found = dictionary(tagged(reviewed, settings, package_texts(files)))
    out = ooxml.redact_packages(files, redact.alternation(found, not settings.case_sensitive), settings.scrub_metadata)
    return out.withColumn("name", display.redacted_name(display.base_name(F.col("path")))), found


def package_key(outputs: DataFrame, found: list[dict], job_id: str, created_at: str, settings: Settings = Settings(), most: int = 10_000) -> str:
    """The key of a job's packages, with how often each tag was put in; more than ``most`` files are refused."""
    files = outputs.where("error is null").select("path", "name", "replacements").orderBy("path").limit(most + 1).collect()
    if len(files) > most:
        raise ValueError(f"more than {most} files in one key")
    texts = package_texts(outputs.where("error is null").select("path", "content"))
    put = texts.select(F.explode(redact.tags_in(F.col("text"), settings.prefix, settings.suffix)).alias("tag")).groupBy("tag").count()
    counts = {r["tag"]: r["count"] for r in put.join(F.broadcast(outputs.sparkSession.createDataFrame([(e["tag"],) for e in found], "tag string")), "tag").collect()}
    documents = [{"original": display_name(r["path"]), "redacted": r["name"], "replacements": r["replacements"]} for r in files]
    own = [{"tag": e["tag"], "category": e["category"], "value": e["value"], "variants": list(e["variants"]), "replacements": counts.get(e["tag"], 0)} for e in found]
    return redact.key_file(job_id, created_at, documents, own, settings.prefix, settings.suffix)


def display_name(path: str) -> str:
    return path.replace("\\", "/").rsplit("/", 1)[-1]


def bundle(outputs: DataFrame, job_id: str, key: str | None = None) -> DataFrame:
    """(job_id, archive): a zip of a job's outputs (path, name, content, error) under their names, and of its key."""
    named = manifest.named(outputs.where("error is null").select(F.lit(job_id).alias("job_id"), F.col("path").alias("doc_id"), F.col("name").alias("out"), "content"))
    if key is not None:
        named = named.unionByName(outputs.sparkSession.createDataFrame([(job_id, "mapping.json", key.encode())], "job_id string, member string, content binary"))
    return manifest.archives(named)


def restore_packages(files: DataFrame, mapping: DataFrame, settings: Settings = Settings(), most: int = 50_000) -> DataFrame:
    """Files (path, content) to (path, name, content, replacements, error), with the tags of a key replaced; more than ``most`` tags are refused."""
    rows = mapping.select("tag", "value").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} tags in one key")
    out = ooxml.restore_packages(files, {r["tag"]: r["value"] for r in rows}, redact.tag_pattern(*delimiters(mapping, settings)))
    return out.withColumn("name", display.restored_name(display.base_name(F.col("path"))))
