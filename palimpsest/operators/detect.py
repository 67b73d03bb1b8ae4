"""Deterministic detectors: patterns run over whole texts, inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.constants import DETECTORS

_OWN: dict[str, tuple[str, str, int]] = {}
#: Texts without any of these have no match of the detector; looking for them costs far less than its pattern.
NEEDED = {"EMAIL": ["@"], "URL": ["http://", "https://", "www."], "PHONE": ["+", "8"], "INN": ["ИНН", "INN"], "OGRN": ["ОГРН", "OGRN"], "SNILS": ["-"]}

#: What belongs to a word, within a class; Java's own also has combining marks and joiners, which hide a value that they stand beside, and lacks numbers like ②.
_WORD = r"\p{L}\p{N}_"


def register(name: str, category: str, pattern: str, group: int = 0) -> None:
    """Add a detector, or replace one of that name; the pattern is Java's, with (?U) set."""
    _OWN[name.upper()] = (category, pattern, group)


def detectors(names: Iterable[str] | None = None) -> dict[str, tuple[str, str, int]]:
    """The detectors of these names in the order given; unknown names are left out."""
    known = DETECTORS | _OWN
    wanted = [n.upper() for n in names] if names is not None else list(known)
    return {n: known[n] for n in wanted if n in known}


def values(text: Column, name: str) -> Column:
    """The values that one detector finds, in order, without punctuation at the ends; empty ones left out."""
    _, pattern, group = detectors([name])[name.upper()]
    if name.upper() not in _OWN:
        pattern = pattern.replace(r"\w", _WORD)
    found = F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(group))
    if name.upper() in NEEDED and name.upper() not in _OWN:
        some = reduce(or_, [F.contains(text, F.lit(x)) for x in NEEDED[name.upper()]])
        found = F.when(some, found).otherwise(F.when(text.isNotNull(), F.array().cast("array<string>")))
    return F.filter(F.transform(found, lambda v: F.regexp_replace(v, r"\A[ .,;:]+|[ .,;:]+\z", "")), lambda v: v != "")


def hits(docs: DataFrame, key: str = "doc_id", text: str = "text", names: Iterable[str] | None = None) -> DataFrame:
    """(key, rule_ord, rule, match_ord, category, value): all finds of the detectors.

    One scan reads each text once for all detectors; nothing is shuffled.
    """
    body = F.col(text)
    found = [
        F.struct(F.lit(k).alias("rule_ord"), F.lit(n).alias("rule"), F.lit(category).alias("category"), values(body, n).alias("values"))
        for k, (n, (category, _, _)) in enumerate(detectors(names).items())
    ]
    rules = docs.select(key, F.explode(F.array(*found)).alias("r")).where(F.size("r.values") > 0)
    return rules.select(key, "r.rule_ord", "r.rule", "r.category", F.posexplode("r.values").alias("match_ord", "value"))
