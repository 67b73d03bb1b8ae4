"""Spellings of values: normal forms, keys and checks, as column expressions.

Only NFKC and case folding have no SQL function; they are Arrow functions, to be
used on distinct values.  Everything else takes a column that is normalised already.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from palimpsest.functions.constants import DASHES, ENDING, GENERIC, LANGUAGES, LEGAL_FORMS, LEGAL_PREFIXES, PUNCTUATION, QUOTES, VOWELS


def _in_class(characters: str) -> str:
    """A character class of these characters, for Java and Python alike."""
    return "[" + "".join(re.escape(c) for c in characters) + "]"


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(StringType())
def casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else v.casefold())


def squeezed(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def unified(text: Column) -> Column:
    """Quotes and dashes to one kind each, white space squeezed; the part of normalisation after NFKC."""
    return squeezed(F.translate(text, QUOTES + DASHES, '"' * len(QUOTES) + "-" * len(DASHES)))


def normalise(text: Column) -> Column:
    return unified(nfkc(text))


def dedup_key(text: Column) -> Column:
    return casefold(normalise(text))


def canonical_key(folded: Column) -> Column:
    """A normalised, case-folded value without punctuation."""
    return squeezed(F.regexp_replace(folded, _in_class(PUNCTUATION) + "+", " "))


def _legal() -> Column:
    return F.array(*[F.lit(x) for x in LEGAL_FORMS])


def has_legal_form(key: Column) -> Column:
    return F.arrays_overlap(F.split(key, " "), _legal())


def strip_legal_form(key: Column) -> Column:
    return F.array_join(F.filter(F.split(key, " "), lambda t: ~F.array_contains(_legal(), t)), " ")


def cyrillic_word(token: Column) -> Column:
    """All letters are Cyrillic, and there is one."""
    return token.rlike(r"[Ѐ-ӿ&&\p{L}]") & ~token.rlike(r"[\p{L}&&[^Ѐ-ӿ]]")


def is_generic(value: Column) -> Column:
    """A normalised value that says nothing: too short, a common word, or without letters and digits."""
    return (F.length(value) < 2) | F.lower(value).isin(GENERIC) | ~value.rlike(r"[\p{L}\p{N}]")


def sanitised_category(category: Column) -> Column:
    """Upper-case letters and digits joined by underscores; OTHER if nothing is left."""
    name = F.regexp_replace(F.regexp_replace(F.upper(category), "[^A-Z0-9]+", "_"), r"\A_+|_+\z", "")
    return F.when(name == "", "OTHER").otherwise(F.coalesce(name, F.lit("OTHER")))


def coerced_category(category: Column, allowed: list[str]) -> Column:
    name = F.upper(category)
    return F.when(name.isin(allowed), name).otherwise("OTHER")


def distinct_forms(forms: Column) -> Column:
    """The non-blank forms, the first of each lower-cased spelling."""
    none = F.array().cast("array<string>")

    def add(so_far: Column, form: Column) -> Column:
        known = F.exists(so_far, lambda x: F.lower(x) == F.lower(form))
        return F.when((F.trim(form) == "") | known, so_far).otherwise(F.concat(so_far, F.array(form)))

    return F.aggregate(forms, none, add)


def suggested_variants(value: Column, category: Column) -> Column:
    """Further spellings of a normalised value that may stand in a text; not yet looked up there."""
    t, kind, none = F.split(value, " "), F.upper(category), F.array().cast("array<string>")
    a, b, c = (F.get(t, F.lit(i)) for i in range(3))
    b1, c1 = F.substring(b, 1, 1), F.substring(c, 1, 1)
    initials = F.concat(b1, F.lit("."), c1, F.lit("."))
    full = F.array(F.concat_ws(" ", a, initials), F.concat_ws(" ", initials, a), F.concat(a, F.lit(" "), b1, F.lit(". "), c1, F.lit(".")), F.concat_ws(" ", a, b))
    bare = F.regexp_replace(value, r"\A(?:" + "|".join(LEGAL_PREFIXES) + r")\s+", "")
    edge = "[" + "".join(re.escape(x) for x in QUOTES) + " ]+"
    bare = F.regexp_replace(bare, rf"\A{edge}|{edge}\z", "")
    person = F.when((F.size(t) == 3) & F.forall(t, cyrillic_word), full).when(F.size(t) == 2, F.array(F.concat_ws(" ", b, a))).otherwise(none)
    company = F.when((bare != "") & (bare != value) & (F.length(bare) >= 3), F.array(bare)).otherwise(none)
    found = F.when(kind == "PERSON", person).when(kind == "ORG", company).otherwise(none)
    return F.filter(found, lambda x: F.lower(x) != F.lower(value))


def preferred_language(header: Column) -> Column:
    """The first supported two-letter code of an Accept-Language header; the default without any."""
    codes = F.transform(F.split(header, ","), lambda p: F.substring(F.lower(F.trim(F.split(p, ";")[0])), 1, 2))
    known = F.filter(codes, lambda c: c.isin(LANGUAGES))
    return F.coalesce(F.get(known, F.lit(0)), F.lit(LANGUAGES[0]))


def listed(text: Column) -> Column:
    """The non-empty, trimmed items of a comma-separated text."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def preview(text: Column, limit: int = 200) -> Column:
    flat = squeezed(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.left(flat, F.lit(limit)), F.lit("…")))


# ---- patterns of forms, built on the driver


#: Cyrillic letters between what aren't letters; the driver's form of ``cyrillic_word``.
_CYRILLIC = re.compile(r"(?:(?:[^\W\d_](?<=[Ѐ-ӿ])|[\W\d_]))*")


def declines(token: str, inflect: bool) -> bool:
    """Whether a word of a form takes endings: a Cyrillic one of four characters or more."""
    return inflect and len(token) >= 4 and _CYRILLIC.fullmatch(token) is not None and any(map(str.isalpha, token))


def token_pattern(token: str, inflect: bool) -> str:
    """One word of a form: any quote for a quote, any dash for a dash, and endings if it inflects."""
    ends = declines(token, inflect)
    vowel = ends and token[-1].lower() in VOWELS
    stem = token[:-1] if vowel else token
    classes = [(QUOTES, _in_class(QUOTES)), (DASHES, _in_class(DASHES))]
    body = "".join(next((p for own, p in classes if c in own), re.escape(c)) for c in stem)
    return body + (ENDING + ("{1,3}" if vowel else "{0,3}") if ends else "")


def _body(form: str, inflect: bool) -> str:
    return r"\s+".join(token_pattern(w, inflect) for w in form.split())


#: What belongs to a word beside a number or an address, as Python reads it, and the same for Java: a combining mark or a joiner hides no such value.
_BESIDE, _BESIDE_JAVA = r"[\w]", r"[\p{L}\p{N}_]"


def _border(forms: list[str]) -> str:
    return _BESIDE if all(re.search(r"[\d@/]", f) for f in forms) else r"\w"


def for_java(pattern: str | Column) -> str | Column:
    """A pattern of forms as Java reads it."""
    if isinstance(pattern, str):
        return "(?U)" + pattern.replace(_BESIDE, _BESIDE_JAVA)
    return F.concat(F.lit("(?U)"), F.replace(pattern, F.lit(_BESIDE), F.lit(_BESIDE_JAVA)))


def form_pattern(form: str, inflect: bool = False) -> str:
    """A form as a pattern that both Java (by ``for_java``) and Python read; empty for a blank form."""
    edge = _border([form])
    return rf"(?<!{edge}){_body(form, inflect)}(?!{edge})" if form.strip() else ""


def entity_pattern(forms: list[str], inflect: bool = False, any_case: bool = False) -> str:
    """All forms of one entity, the longest first; in any case if so asked.

    What a form can begin with is tested before anything else, as that settles nearly every place of a text.
    """
    found = [f for f in sorted(forms, key=len, reverse=True) if f.strip()]
    if not found:
        return ""
    first = {f.lstrip()[0] for f in found}
    if any_case:
        first = {c for f in first for c in (f, *f.lower(), *f.upper())}
    begins = "".join(sorted(set().union(*(next((own for own in (QUOTES, DASHES) if c in own), c) for c in first))))
    edge = _border(found)
    return rf"(?={_in_class(begins)})(?<!{edge})(?{'i' if any_case else ''}:{'|'.join(_body(f, inflect) for f in found)})(?!{edge})"
