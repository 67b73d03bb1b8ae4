"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that white space separates, as Java and Python patterns read them.
SPACED = r"[^\x20\x09-\x0D]+"
#: Runs of ASCII letters and digits and of everything beyond ASCII.
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Over all cores, if Spark reads the input in fewer pieces than there are; a large input is left as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; nothing else changes (lower() would touch other letters)."""
    return F.translate(text, UPPER, LOWER)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's checkpoint folder and cut its lineage.

    The folder is the one that the cluster names in spark.checkpoint.dir.  Only on a
    single machine one of our own stands in for it; a cluster without one is an
    error, as its machines don't share local folders.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="palimpsest-checkpoint-"))
    return df.checkpoint(eager=True)


def least(rows: DataFrame, by: Column, n: int, *then: str) -> DataFrame:
    """The ``n`` rows of the least ``by``, a hash, ties in the order of ``then``.

    Of many rows only a range of the hash that holds about twice as many is
    sorted, so that tasks don't each hand on ``n`` rows.  Different rows must have
    different hashes; that the range holds fewer than ``n`` then has odds of exp(-n / 4), so only a small ``n`` is looked after.
    """
    count = rows.count()
    if count > 4 * n:
        near = rows.where(by < F.lit(int(2 * n / count * 2**64) - 2**63))
        rows = near if n >= 1000 or near.count() >= n else rows
    return rows.orderBy(by, *then).limit(n)


def cleared(df: DataFrame, added: list[str], *kept: str) -> DataFrame:
    """``df`` without columns of the names that an operator adds, whatever their case; ``kept`` stay."""
    names = {a.lower() for a in added}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in kept or c.lower() not in names])


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name
