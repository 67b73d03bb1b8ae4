"""Tables of a folder, and texts as paragraphs."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Over all cores, if Spark reads the input in fewer pieces than there are; a large input is left as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, para_no, text): the trimmed lines of each text that aren't empty, numbered from 0 as they stand.

    A null text has none.  Map-only.
    """
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("para_no", "raw"))
    return lines.select(key, "para_no", F.regexp_replace("raw", r"(?U)\A\s+|\s+\z", "").alias("text")).where("text <> ''")


def grouped_leaves(leaves: DataFrame, *keys: str) -> DataFrame:
    """Leaves (keys, para_no, leaf_no, text) to paragraphs: the leaves' texts joined in order."""
    ordered = F.sort_array(F.collect_list(F.struct("leaf_no", "text")))
    rows = leaves.groupBy(*keys, "para_no").agg(ordered.alias("leaves"))
    return rows.withColumn("text", F.array_join("leaves.text", ""))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that the session names, so that it's the same whoever reads it and whatever is lost.

    A single machine may go without a named folder; a cluster may not.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="palimpsest-"))
    return df.checkpoint(eager=True)


def numbered(rows: DataFrame, name: str, scope: list[Column], order: list[Column]) -> DataFrame:
    """``rows`` with ``name``, a running number from 1 within ``scope`` in ``order``, in as many tasks as there is data for.

    Rows are sorted by ranges; a row's number is its place in its range and
    scope plus what the ranges before have of the scope, of which there is a row for each range and scope.
    """
    keys = [f"__k{i}" for i in range(len(scope))]
    sorted_ = rows.select("*", *[c.alias(k) for c, k in zip(scope, keys, strict=True)]).orderBy(*keys, *order)
    placed = cut(sorted_.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__m")))
    counts = placed.groupBy("__p", *keys).agg(F.count("*").alias("__n"), F.min("__m").alias("__first"))
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__p", *[F.col(k).alias(f"{k}s") for k in keys], "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    same = F.col("__p") == F.col("__q")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}s"))
    out = placed.join(starts.withColumnRenamed("__p", "__q"), same)
    return out.select(*[F.col(f"`{c}`") for c in rows.columns if c != name], (F.col("__m") - F.col("__first") + F.col("__before") + 1).cast("int").alias(name))
