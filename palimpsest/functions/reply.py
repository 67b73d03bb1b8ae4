"""Reading a language model's replies and writing its prompts, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.constants import ACKNOWLEDGED, FINAL_STATUS, LAYERS, THINKING

_TAGS = "|".join(THINKING)
#: A place of a template that an input is put in.
PLACE = re.compile(r"\{(\w+)\}")


def heading(number: int, total: int) -> str:
    """What stands above a layer of a prompt."""
    return f"[LAYER {number}/{total}]\n"


def without_thinking(reply: Column) -> Column:
    """The reply after its scratchpad; null if one is opened and never closed."""
    closed = reply.rlike(rf"(?is)</(?:{_TAGS})>")
    return F.when(closed, F.regexp_replace(reply, rf"(?is).*?</(?:{_TAGS})>", "")).when(~reply.rlike(rf"(?i)<(?:{_TAGS})\b"), reply)


def json_part(reply: Column) -> Column:
    """From the first opening to the last closing brace, without code fences; null if there is none."""
    bare = F.regexp_replace(F.trim(without_thinking(reply)), r"(?m)^```(?:json)?|```$", "")
    found = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def message_content(body: Column) -> Column:
    """The text of the first choice, in the body itself or one envelope down."""
    own = F.get_json_object(body, "$.choices[0].message.content")
    return F.coalesce(own, F.get_json_object(body, "$.data.choices[0].message.content"))


FINDINGS = "struct<entities:array<struct<text:string,category:string,aliases:array<string>>>>"


def findings(reply: Column) -> Column:
    """(category, value, aliases) of each usable item of a reply; empty where nothing can be read."""
    items = F.from_json(json_part(reply), FINDINGS)["entities"]

    def one(x: Column) -> Column:
        kind = F.upper(F.trim(F.coalesce(F.when(x["category"] != "", x["category"]), F.lit("OTHER"))))
        names = F.filter(F.transform(F.coalesce(x["aliases"], F.array().cast("array<string>")), lambda a: F.trim(a)), lambda a: a != "")
        return F.struct(kind.alias("category"), F.trim(x["text"]).alias("value"), names.alias("aliases"))

    found = F.filter(F.transform(items, one), lambda x: F.coalesce(x["value"], F.lit("")) != "")
    return F.coalesce(found, F.array().cast("array<struct<category:string,value:string,aliases:array<string>>>"))


def substituted(template: Column, inputs: dict[str, Column]) -> Column:
    """The template with each {name} of ``inputs`` filled in; null if it names another input."""
    names = F.regexp_extract_all(template, F.lit(PLACE.pattern), F.lit(1))
    missing = F.array_except(names, F.array(*[F.lit(n) for n in inputs]))
    out = template
    for name, value in inputs.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return F.when(F.size(missing) == 0, out)


def missing_inputs(template: Column, given: list[str]) -> Column:
    names = F.regexp_extract_all(template, F.lit(PLACE.pattern), F.lit(1))
    return F.sort_array(F.array_except(names, F.array(*[F.lit(n) for n in given]).cast("array<string>")))


def layered_messages(layers: dict[str, Column]) -> Column:
    """(role, content) messages of the layers that aren't blank, in their order, acknowledged in between."""
    acks = F.create_map(*[F.lit(x) for pair in ACKNOWLEDGED.items() for x in pair])
    full = F.array(*[F.struct(F.lit(n).alias("name"), layers[n].alias("content")) for n in LAYERS if n in layers])
    full = F.filter(full, lambda x: F.trim(F.coalesce(x["content"], F.lit(""))) != "")
    total = F.size(full)

    def one(x: Column, i: Column) -> Column:
        head = F.concat(F.lit("[LAYER "), (i + 1).cast("string"), F.lit("/"), total.cast("string"), F.lit("]\n"), x["content"])
        said = F.struct(F.lit("user").alias("role"), head.alias("content"))
        answer = F.struct(F.lit("assistant").alias("role"), F.element_at(acks, x["name"]).alias("content"))
        return F.when((i + 1 < total) & F.element_at(acks, x["name"]).isNotNull(), F.array(said, answer)).otherwise(F.array(said))

    return F.flatten(F.transform(full, one))


def retry_class(status: Column) -> Column:
    """What to do after a call: done, final (as it can only fail again) or retry; null stands for no connection."""
    return F.when(status.isNull(), "final").when(status < 400, "done").when(status.isin(FINAL_STATUS), "final").otherwise("retry")
