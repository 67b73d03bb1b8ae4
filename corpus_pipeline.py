"""From raw documents to a training mixture, in five stages.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before kept,
and returns a DataFrame; all but the last return the columns of documents.  A
stage's model, if it has one, is fitted on that stage's own input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, mixing, pii, simhash, toxicity
from palimpsest.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose score is 0.5 or more."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    names = {c: f"d{i}" for i, c in enumerate(docs.columns)}
    rows = toxicity.score(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), model, names["text"])
    return rows.where("score < 0.5").select(*[F.col(n).alias(c) for c, n in names.items()])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one with the smallest doc_id."""
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of whose words a twentieth or more is in benchmark windows."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in square brackets; n_chars is the new length."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, each once, with how often: whole copies and the words of a partial one."""
    return mixing.counted(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_private),
    ("mixing", mix_sources),
]

#: No stage but the third and the last can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next.

    The tables go to the checkpoint folder, which all executors share; the last
    one stays there, as the result is read from it.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    cut(spark.range(1).where("id < 0"))  # sets a checkpoint folder where none is
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _remove(spark, before)
        before = f"{folder}/{name}"
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    """Delete what a stage wrote, once the next has written its own; in any store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
