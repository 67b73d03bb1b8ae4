"""What a person reads: plurals, sizes, durations, progress, names of files."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.constants import LEGACY, MEDIA_TYPES, REDACTED, RESTORED, SUPPORTED


def ru_plural(n: Column, one: str, few: str, many: str) -> Column:
    tens, units = F.abs(n) % 100, F.abs(n) % 10
    return F.when(tens.between(11, 14), many).when(units == 1, one).when(units.between(2, 4), few).otherwise(many)


def size_text(n: Column) -> Column:
    """Bytes, whole KB or tenths of MB; a tenth in the middle of two is the even one, as C prints it (Java's format takes the upper)."""
    whole, tenth = F.format_string("%d KB", F.floor(n / 1024 + 0.5)), F.format_string("%.1f MB", F.bround(n / 1048576, 1))
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1048576, whole).otherwise(tenth)


def duration_text(seconds: Column) -> Column:
    total = F.greatest(F.floor(seconds + 0.5), F.lit(0)).cast("long")
    minutes, rest = F.floor(total / 60), total % 60
    long_ = F.when(rest > 0, F.format_string("%d min %d s", minutes, rest)).otherwise(F.format_string("%d min", minutes))
    return F.when(total < 60, F.format_string("%d s", total)).otherwise(long_)


def progress_fraction(stage: Column, docs_done: Column, docs: Column, chunks_done: Column, chunks: Column) -> Column:
    inside = F.when(chunks > 0, chunks_done / chunks).otherwise(0.0)
    return F.when(stage == "done", 1.0).otherwise(F.least((docs_done + inside) / F.greatest(docs, F.lit(1)), F.lit(0.99)))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)\z", 1)


def suffix(name: Column) -> Column:
    """The last extension with its dot, as it stands; none for names that only begin with a dot."""
    return F.regexp_extract(name, r"[^/\\.](\.[^./\\]+)\z", 1)


def is_supported(name: Column) -> Column:
    return F.lower(suffix(name)).isin(SUPPORTED)


def is_legacy(name: Column) -> Column:
    return F.lower(suffix(name)).isin(LEGACY)


def media_type(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(suffix(name))), F.lit("application/octet-stream"))


def _stem(name: Column) -> Column:
    return F.left(name, F.length(name) - F.length(suffix(name)))


def redacted_name(name: Column) -> Column:
    return F.concat(_stem(name), F.lit(REDACTED), suffix(name))


def restored_name(name: Column) -> Column:
    bare = F.regexp_replace(_stem(name), re.escape(REDACTED) + r"\z", "")
    return F.concat(bare, F.lit(RESTORED), suffix(name))


def is_content_part(name: Column) -> Column:
    inside = name.startswith("word/") | name.startswith("ppt/") | name.startswith("xl/")
    return name.endswith(".xml") & inside & ~name.rlike(r"_rels/|/theme/|calcChain\.xml\z")
