"""Entities: spellings of one thing brought together.

``merge`` takes the four passes together, for each job in one group, as the later ones depend on
order; the passes that don't are here as relational operators too.
An entity set is what one person reviews, so a job's group is small by nature.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.constants import LEGAL_FORMS, PUNCTUATION
from palimpsest.functions.text import _in_class
from palimpsest.sources.tables import numbered

MERGED = "job_id string, id string, category string, value string, variants array<string>, source string, inflect boolean"


def rank(value: Column, key: Column, source: Column) -> Column:
    """The order in which spellings stand for a group: with a legal form, longer once normalised, found by a rule."""
    return F.struct(T.has_legal_form(key).cast("int").alias("legal"), F.length(T.unified(value)).alias("length"), (source == "rule").cast("int").alias("rule"))


def same_name(entities: DataFrame, *scope: str) -> DataFrame:
    """First pass: entities whose canonical keys agree become one.

    The best ranked (then the first by seq) stands; the others' spellings join
    its variants, it inflects if one does, is a rule's if one is, and has a
    concrete category if one has.
    """
    best = F.struct(rank(F.col("value"), F.col("key"), F.col("source")).alias("rank"), (-F.col("seq")).alias("first"))
    kind = F.struct((F.col("category") == "OTHER").cast("int").alias("other"), (-best["rank"]["legal"]).alias("l"), (-best["rank"]["length"]).alias("n"), (-best["rank"]["rule"]).alias("r"), "seq")
    out = entities.groupBy(*scope, "key").agg(
        F.max_by(F.struct("id", "value"), best).alias("top"),
        F.min_by("category", kind).alias("category"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("value"), "variants"))))).alias("forms"),
        F.max("inflect").alias("inflect"),
        F.when(F.max(F.col("source") == "rule"), "rule").otherwise(F.first("source")).alias("source"),
    )
    variants = F.filter("forms", lambda x: x != F.col("top.value"))
    return out.select(*scope, "top.id", "category", "top.value", "key", variants.alias("variants"), "source", "inflect")


def claims(variants: DataFrame, *scope: str) -> DataFrame:
    """(scope, key, owners): how many different entities have a spelling as variant, their own names aside."""
    rows = variants.where("key <> own_key and key <> ''")
    return rows.groupBy(*scope, "key").agg(F.count_distinct("id").alias("owners"), F.min("id").alias("owner"))


def variant_owner(entities: DataFrame, variants: DataFrame, *scope: str) -> DataFrame:
    """Second pass: (id, owner) of entities that are a variant of exactly one other."""
    single = claims(variants, *scope).where("owners = 1").select(*scope, "key", "owner")
    return entities.join(single, [*scope, "key"]).where("id <> owner").select(*scope, "id", "owner")


def bare_company(entities: DataFrame, *scope: str) -> DataFrame:
    """Third pass: (id, owner) of companies without legal form that exactly one with a legal form is named like."""
    companies = entities.where("upper(category) = 'ORG'")
    legal = T.has_legal_form(F.col("key"))
    full = companies.where(legal).groupBy(*scope, T.strip_legal_form(F.col("key")).alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("owner"))
    return companies.where(~legal).join(full.where("n = 1"), [*scope, "key"]).select(*scope, "id", "owner")


def contested(variants: DataFrame, *scope: str) -> DataFrame:
    """Fourth pass: the spellings that several entities claim."""
    return claims(variants, *scope).where("owners > 1").select(*scope, "key", "owners")


def absorbed(keeper: DataFrame, other: DataFrame) -> DataFrame:
    """Pairs (keeper and other of one ``pair``) to what the keeper becomes."""
    a, b = keeper.alias("a"), other.alias("b")
    forms = F.array_union(F.concat(F.array("a.value"), "a.variants"), F.concat(F.array("b.value"), "b.variants"))
    kind = F.when((F.upper("a.category") == "OTHER") & (F.upper("b.category") != "OTHER"), F.col("b.category")).otherwise(F.col("a.category"))
    source = F.when(F.col("b.source") == "rule", "rule").otherwise(F.col("a.source"))
    return a.join(b, F.col("a.pair") == F.col("b.pair")).select("a.pair", "a.value", kind.alias("category"), F.slice(forms, F.lit(2), F.greatest(F.size(forms) - 1, F.lit(0))).alias("variants"), source.alias("source"), (F.col("a.inflect") | F.col("b.inflect")).alias("inflect"))


def ordered(entities: DataFrame, *scope: str) -> DataFrame:
    """``place`` by category, then most occurrences, then value."""
    return numbered(entities, "place", [F.col(c) for c in scope], [F.col("category"), F.desc("total"), F.col("value")])


def with_tags(entities: DataFrame, *scope: str, prefix: str = "[[", suffix: str = "]]", taken: dict[str, int] | None = None) -> DataFrame:
    """``tag``: prefix, category, a running number of at least three digits, suffix; numbered in review order.

    ``taken`` is the highest number of each category that tag-shaped text of the
    documents has already; numbers go on from there, so that restoring can't take one for the other.
    """
    kind = T.sanitised_category(F.col("category"))
    rows = numbered(entities, "__n", [*[F.col(c) for c in scope], kind], [F.col("category"), F.desc("total"), F.col("value")])
    start = F.lit(0)
    for name, n in (taken or {}).items():
        start = F.when(kind == name, n).otherwise(start)
    return rows.withColumn("tag", F.concat(F.lit(prefix), F.format_string("%s_%03d", kind, F.col("__n") + start), F.lit(suffix))).drop("__n")


def spelling_keys(entities: DataFrame) -> DataFrame:
    """(job_id, id, key): the canonical keys of an entity's value and variants, and of a company's name without legal form."""
    forms = entities.select("job_id", "id", "category", F.col("value").alias("own"), F.explode(F.array_distinct(F.concat(F.array("value"), "variants"))).alias("form"))
    keys = forms.select("job_id", "id", "category", (F.col("own") == F.col("form")).alias("is_own"), T.canonical_key(T.dedup_key(F.col("form"))).alias("key"))
    bare = keys.where((F.upper("category") == "ORG") & F.col("is_own")).select("job_id", "id", T.strip_legal_form(F.col("key")).alias("key"))
    return keys.select("job_id", "id", "key").unionByName(bare).where("key <> ''").distinct()


def merged(entities: DataFrame) -> DataFrame:
    """``merge``, in which only entities take part that share a key with another; all others are as they were."""
    keys = spelling_keys(entities)
    shared = keys.groupBy("job_id", "key").agg(F.count("*").alias("n")).where("n > 1")
    near = keys.join(shared, ["job_id", "key"], "left_semi").select("job_id", "id").distinct()
    fields = MERGED.replace(",", "").split()[::2]
    order = F.row_number().over(Window.partitionBy("job_id").orderBy("seq"))
    own = entities.join(near, ["job_id", "id"], "left_semi").withColumn("seq", order).select(*fields, "seq")
    return merge(own).unionByName(entities.join(near, ["job_id", "id"], "left_anti").select(*fields))


def merge(entities: DataFrame) -> DataFrame:
    """All four passes, for each job: columns of ``MERGED`` and seq in, ``MERGED`` out.

    Spellings are compared without case, punctuation and spacing.  A spelling
    counts once for each entity that claims it, and one claimed by
    several goes from all of them; what is spelled as an entity's own value is
    never a claim and stays.
    """
    drop, legal = _in_class(PUNCTUATION), frozenset(LEGAL_FORMS)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import re
        import unicodedata

        def key(value: str) -> str:
            return " ".join(re.sub(drop, " ", unicodedata.normalize("NFKC", value).casefold()).split())

        class Group:
            def __init__(self, row):
                self.row, self.key, self.forms = row, key(row.value), dict.fromkeys(row.variants)
                self.words = self.key.split()
                self.length = len(" ".join(unicodedata.normalize("NFKC", row.value).split()))

            def take(self, other):
                mine, theirs = self.row, other.row
                for form in (theirs.value, *other.forms):
                    if form != mine.value:
                        self.forms.setdefault(form)
                kind = theirs.category if mine.category.upper() == "OTHER" else mine.category
                self.row = mine._replace(category=kind, source="rule" if "rule" in (mine.source, theirs.source) else mine.source, inflect=mine.inflect or theirs.inflect)

            def claimed(self):
                return {k for k in map(key, self.forms) if k and k != self.key}

        def owners(groups):
            found = {}
            for g in groups:
                for k in g.claimed():
                    found.setdefault(k, []).append(g)
            return found

        def fold(groups, owner_of):
            gone = set()
            for g in groups:
                owner = owner_of(g)
                if owner is not None and owner is not g and id(owner) not in gone:
                    owner.take(g)
                    gone.add(id(g))
            return [g for g in groups if id(g) not in gone]

        official = lambda g: bool(legal.intersection(g.words))
        started = [Group(r) for r in rows.sort_values("seq").itertuples(index=False)]
        started.sort(key=lambda g: (official(g), g.length, g.row.source == "rule"), reverse=True)
        by_key, groups = {}, []
        for g in started:
            if g.key in by_key:
                by_key[g.key].take(g)
            else:
                groups.append(by_key.setdefault(g.key, g))
        known = owners(groups)

        def variant_owner_of(g):
            others = [o for o in known.get(g.key, ()) if o is not g]
            return others[0] if len(others) == 1 else None

        groups = fold(groups, variant_owner_of)
        named = {}
        for g in groups:
            if g.row.category.upper() == "ORG" and official(g):
                named.setdefault(" ".join(w for w in g.words if w not in legal), []).append(g)

        def company_of(g):
            same = named.get(g.key, ()) if g.row.category.upper() == "ORG" and not official(g) else ()
            return same[0] if len(same) == 1 else None

        groups = fold(groups, company_of)
        shared = {k for k, own in owners(groups).items() if len(own) > 1}
        fields = MERGED.replace(",", "").split()[::2]
        out = [g.row._replace(variants=[f for f in g.forms if key(f) == g.key or key(f) not in shared]) for g in groups]
        return pd.DataFrame(out, columns=rows.columns)[fields]

    return entities.groupBy("job_id").applyInPandas(run, MERGED)
