"""Mixing sources to target weights by capped water-filling, in SQL functions only.

Each source has a weight and a size in words.  The level at which ``weight x
level``, clamped at ``epochs`` times the source's size, adds up to the wanted
total is found in one ordered pass over the sources; that is where resharing
the excess by weight, again and again, ends.  A source's target is then met
to the word: every document is repeated whole as often as the target allows,
and documents in the order of a seeded hash have one repetition more until the
rest is used up; only the last of them is taken in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import SPACED, cut, fresh


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """(source, weight, source_size) to the same with ``target``, a double.

    The targets add up to ``share`` times all sizes, or to what the caps allow
    if that's less.  One row for each source comes in, so the one window over
    all of them is as small as the list of sources.
    """
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    rows = sizes.withColumn("cap", epochs * F.col("source_size")).withColumn("total", share * F.sum("source_size").over(Window.partitionBy(F.lit(0))))
    rows = rows.withColumn("before", F.coalesce(F.sum("cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("from_here", F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing)))
    # Sources before the first that stays below its cap are full; the rest share what is left.
    rows = rows.withColumn("level", (F.col("total") - F.col("before")) / F.col("from_here"))
    open_ = F.when(F.col("weight") * F.col("level") <= F.col("cap"), F.struct("before", "level"))
    rows = rows.withColumn("at", F.min(open_).over(Window.partitionBy(F.lit(0))))
    below = F.col("weight") * F.col("at.level")
    target = F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", below))
    return rows.select("source", "weight", "source_size", target.cast("double").alias("target"))


def plan(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """(source, size, draw) to one row for each source.

    ``whole`` repetitions of every row, one more of the rows whose draw is below
    ``edge`` (of all, if that's null), and of those at ``edge`` the part
    ``edge_rest / edge_size``.
    """
    # Running sums of a source in two steps: over 4,096 ranges of the hash, then within one range.
    part = F.substring("draw", 1, 3)
    ranges = rows.groupBy("source", part.alias("part")).agg(F.sum("size").alias("part_size"))
    sizes = ranges.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.lit(list(weights)), (F.pmod(F.row_number().over(turn) - 1, F.lit(len(weights))) + 1).cast("int"))
    goals = targets(sizes.withColumn("weight", weight.cast("double")), share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.withColumn("whole", whole).withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("start", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
    goal = goals.select(F.col("source").alias("of"), "rest")
    cut_at = starts.join(F.broadcast(goal) if _few(goal) else goal, F.col("source").eqNullSafe(F.col("of")))
    cut_at = cut_at.where("start <= rest and rest < start + part_size").select("of", F.col("part").alias("in_part"), "start", "rest")
    one = rows.join(F.broadcast(cut_at) if _few(goal) else cut_at, F.col("source").eqNullSafe(F.col("of")) & (part == F.col("in_part")))
    one = one.groupBy("of", "start", "rest", "draw").agg(F.sum("size").alias("edge_size"))
    inside = Window.partitionBy("of").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("left", F.col("rest") - F.col("start") - F.coalesce(F.sum("edge_size").over(inside), F.lit(0)))
    edges = one.where("0 <= left and left < edge_size").select("of", F.col("draw").alias("edge"), F.col("left").alias("edge_rest"), "edge_size")
    return goals.join(edges, goals["source"].eqNullSafe(edges["of"]), "left").drop("of", "weight", "rest")


def _few(rows: DataFrame, most: int = 50_000) -> bool:
    """Whether a table of sources is small enough to broadcast."""
    return rows.limit(most + 1).count() <= most


def _draw(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))))


def _taken(size: Column, draw: Column, at: str = "") -> Column:
    p = lambda c: F.col(f"{at}{c}")
    part = F.floor(size * p("edge_rest") / p("edge_size"))
    extra = F.when(p("edge").isNull() | (draw < p("edge")), size).when(draw == p("edge"), part).otherwise(0)
    return (p("whole") * size + extra).cast("long")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """(key, size, source_size, target, taken) for each row of ``docs``.

    Sources by code point, null last, weigh ``weights`` in turn.  ``taken`` is
    the words that the mix takes of the row, repeats counted; a source's add up
    to its target, rounded.  A null or empty text has size 0 and none is taken.
    Rows of a null key or of one key stand at one place in the seeded order
    and share evenly what is left there.  No rows give no rows.  Reruns agree:
    the order depends on seed and key alone.
    """
    rows = cut(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), words(F.col(f"`{text}`")).alias("size"), _draw(F.col(f"`{key}`"), seed).alias("draw")))
    how = cut(plan(rows, weights, share, epochs).withColumnRenamed("source", "of"))
    out = rows.join(F.broadcast(how) if _few(how) else how, F.col("source").eqNullSafe(F.col("of")))
    return out.select(F.col("key").alias(key), "size", "source_size", "target", _taken(F.col("size"), F.col("draw")).alias("taken"))


def _decided(docs: DataFrame, key: str, text: str, source: str, weights: tuple[int, ...], share: float, epochs: float, seed: int) -> tuple[DataFrame, str, str]:
    """The rows of ``docs`` that the mix takes, with two more columns: size and words taken."""
    size, taken = fresh(docs, "mix_size"), fresh(docs, "mix_taken")
    rows = docs.select(F.col(f"`{source}`").alias("source"), words(F.col(f"`{text}`")).alias("size"), _draw(F.col(f"`{key}`"), seed).alias("draw"))
    how = plan(cut(rows), weights, share, epochs)
    how = cut(how.select(*[F.col(c).alias(f"__mix_{c}") for c in how.columns]))
    out = docs.withColumn(size, words(F.col(f"`{text}`")))
    out = out.join(F.broadcast(how) if _few(how) else how, F.col(f"`{source}`").eqNullSafe(F.col("__mix_source")))
    out = out.withColumn(taken, _taken(F.col(size), _draw(F.col(f"`{key}`"), seed), "__mix_")).where(F.col(taken) > 0)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], size, taken, "__mix_source_size", "__mix_target"), size, taken


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each once, with how often it takes them.

    ``copies`` is the number of whole repetitions and ``part`` the words of a
    partial one (0: none); size, source_size, target and taken are those of
    ``mix``.  A column of ``docs`` of one of these names is replaced.
    """
    out, size, taken = _decided(docs, key, text, source, weights, share, epochs, seed)
    new = {
        "size": F.col(size),
        "source_size": F.col("__mix_source_size"),
        "target": F.col("__mix_target"),
        "taken": F.col(taken),
        "copies": F.floor(F.col(taken) / F.col(size)),
        "part": F.pmod(F.col(taken), F.col(size)),
    }
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    return out.select(*kept, *[v.alias(k) for k, v in new.items()])


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes them.

    All columns are kept.  A partial repetition has the first words that
    the mix takes, joined by single spaces; whole ones have the text as it is.
    """
    out, size, taken = _decided(docs, key, text, source, weights, share, epochs, seed)
    part = fresh(out, "mix_part")
    # One entry for each repetition: null stands for the whole text, a number for its first words.
    whole = F.array_repeat(F.lit(None).cast("long"), F.floor(F.col(taken) / F.col(size)).cast("int"))
    rest = F.pmod(F.col(taken), F.col(size))
    out = out.withColumn(part, F.explode(F.concat(whole, F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<long>")))))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(SPACED), F.lit(0)), F.lit(1), F.col(part).cast("int")), " ")
    body = F.when(F.col(part).isNull(), F.col(f"`{text}`")).otherwise(first)
    return out.select(*[body.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
