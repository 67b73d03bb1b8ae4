"""How often each entity stands in each text, without comparing all with all.

Each form has an anchor: of its words the one that the fewest texts have, so that a
company isn't looked for wherever a legal form stands.  A text's words lead to
the forms whose anchor is one of them, by an equi-join, and only the pairs so found are
counted by pattern.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.text import entity_pattern

#: Letters of a word that an ending can't change: inflecting words have four or more.
PREFIX = 3
#: Up to so many entities their anchors are broadcast; beyond it both sides are shuffled.
BROADCAST_ENTITIES = 20_000
#: Up to so many anchors they are looked for as each text is read, and no text is shuffled.
FEW_ANCHORS = 500

_RUN = r"(?U)[\p{L}\p{N}_]+"


def _prefix(word: Column) -> Column:
    return F.concat(F.lit("~"), F.left(word, F.lit(PREFIX)))


def _whole(word: Column) -> Column:
    return F.concat(F.lit("="), word)


def patterns(entities: list[dict]) -> list[tuple[str, str, list[str]]]:
    """(id, pattern, forms) of entities given as id, value, variants and inflect."""
    rows = [(e["id"], entity_pattern([e["value"], *e.get("variants", [])], e.get("inflect", False)), [e["value"], *e.get("variants", [])]) for e in entities]
    return [r for r in rows if r[1]]


def _anchors(form: Column, inflects: Column) -> Column:
    """The words that each text with the form has, as they are or by their beginning; "=", which every text has, for a form without any."""

    def of_token(token: Column) -> Column:
        runs = F.regexp_extract_all(F.lower(token), F.lit(_RUN), F.lit(0))
        last = F.element_at(runs, -1)
        ends = inflects & (F.length(token) >= 4) & T.cyrillic_word(token)
        # Endings come after the last character of a token, in place of a final vowel.
        end = F.when(~F.lower(token).endswith(last), F.array(_whole(last))).when(F.length(last) > PREFIX, F.array(_prefix(last))).otherwise(F.array().cast("array<string>"))
        some = F.concat(F.transform(F.slice(runs, F.lit(1), F.size(runs) - 1), _whole), end)
        return F.when(F.size(runs) == 0, F.array().cast("array<string>")).when(ends, some).otherwise(F.transform(runs, _whole))

    found = F.array_distinct(F.flatten(F.transform(F.split(F.trim(form), r"(?U)\s+"), of_token)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("=")))


def _keys(text: Column, inflecting: bool) -> Column:
    """What a text can be found by: its words, and their beginnings where forms inflect."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_RUN), F.lit(0)))
    whole = F.concat(F.transform(words, _whole), F.array(F.lit("=")))
    return F.concat(whole, F.array_distinct(F.transform(words, _prefix))) if inflecting else whole


def _each(forms: DataFrame) -> DataFrame:
    """(entity_id, pattern, no, anchor): every anchor that each form could have."""
    inflects = F.coalesce(F.col("inflect"), F.lit(False)) if "inflect" in forms.columns else F.lit(False)
    each = forms.select("entity_id", "pattern", inflects.alias("inflects"), F.posexplode("forms").alias("no", "form")).where("trim(form) <> ''")
    return each.select("entity_id", "pattern", "no", F.explode(_anchors(F.col("form"), F.col("inflects"))).alias("anchor"))


def _few(docs: DataFrame, each: DataFrame, inflecting: bool, key: str, text: str) -> DataFrame | None:
    """(key, text, entity_id, pattern), where a text has an anchor; None if there are many anchors.  Map-only."""
    rows = each.limit(FEW_ANCHORS + 1).collect()
    if len(rows) > FEW_ANCHORS:
        return None
    own = F.array_intersect(_keys(F.col(text), inflecting), F.lit(sorted({r["anchor"] for r in rows}) or [""]))
    forms: dict[tuple, list] = {}
    for r in rows:
        forms.setdefault((repr(r["entity_id"]), r["pattern"], r["no"]), []).append(r)
    if any(len(x) > 1 for x in forms.values()):
        counts = {r["a"]: r["count"] for r in docs.select(F.explode(own).alias("a")).groupBy("a").count().collect()}  # at most as many as there are anchors
        rows = [min(x, key=lambda r: (counts.get(r["anchor"], 0), r["anchor"])) for x in forms.values()]
        rows = [r for r in rows if counts.get(r["anchor"], 0)]
    chosen = docs.sparkSession.createDataFrame([(r["entity_id"], r["pattern"], r["anchor"]) for r in rows], each.select("entity_id", "pattern", "anchor").schema).distinct()
    own = F.array_intersect(_keys(F.col(text), inflecting), F.lit(sorted({r["anchor"] for r in rows}) or [""]))
    return docs.select(key, text, F.explode(own).alias("anchor")).join(F.broadcast(chosen), "anchor").drop("anchor")


def near(docs: DataFrame, forms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tried): the (entity_id, pattern) whose forms a text may have, for texts with any.

    ``forms`` has entity_id, pattern and forms (its spellings), and may have
    inflect.  Only words of forms are kept of the texts; they are counted and joined from there.
    """
    inflecting = "inflect" in forms.columns
    tried = F.collect_set(F.struct("entity_id", "pattern")).alias("tried")
    each = _each(forms).persist(StorageLevel.MEMORY_AND_DISK)
    if (some := _few(docs, each, inflecting, key, text)) is not None:
        return some.groupBy(key).agg(tried)
    few = each.select("entity_id").distinct().limit(BROADCAST_ENTITIES + 1).count() <= BROADCAST_ENTITIES
    small = F.broadcast if few else lambda x: x
    found = docs.select(F.col(key).alias("__key"), F.explode(_keys(F.col(text), inflecting)).alias("anchor")).join(small(each.select("anchor").distinct()), "anchor").persist(StorageLevel.MEMORY_AND_DISK)
    counts = found.groupBy("anchor").agg(F.count("*").alias("n"))
    rarest = each.join(counts, "anchor", "left").groupBy("entity_id", "pattern", "no").agg(F.min_by(F.struct("anchor", "n"), F.struct(F.coalesce("n", F.lit(0)).alias("n"), "anchor")).alias("best"))
    chosen = rarest.where("best.n > 0").select("entity_id", "pattern", "best.anchor").distinct()  # a form with a word that no text has stands nowhere
    return found.join(small(chosen), "anchor").groupBy(F.col("__key").alias(key)).agg(tried)


def count_occurrences(docs: DataFrame, forms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(entity_id, key, n): the matches of each entity's pattern in each text, where there are any; see ``near`` for ``forms``.

    A key stands for one text.  For a few anchors only counts are shuffled.
    """
    each = _each(forms).persist(StorageLevel.MEMORY_AND_DISK)
    if (some := _few(docs, each, "inflect" in forms.columns, key, text)) is not None:
        rows = some.select("entity_id", key, F.regexp_count(F.col(text), T.for_java(F.col("pattern"))).alias("n"))
        return rows.where("n > 0").groupBy("entity_id", key).agg(F.max("n").alias("n"))
    both = docs.select(key, text).join(near(docs, forms, key, text), key)
    counted = F.transform("tried", lambda e: F.struct(e["entity_id"].alias("entity_id"), F.regexp_count(F.col(text), T.for_java(e["pattern"])).alias("n")))
    return both.select(key, F.explode(counted).alias("c")).where("c.n > 0").select("c.entity_id", key, "c.n")
