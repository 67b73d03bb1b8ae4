"""Bundles of a job's files: their names, and the archives."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import display


def bundle(files: DataFrame, with_key: bool = True) -> DataFrame:
    """Files (job_id, doc_id, name, error) to (job_id, member): outputs under their names, the key file beside them.

    Of several files of one name all but the first have their id in front; files in error are left out.
    """
    fine = files.where("error is null").withColumn("out", display.redacted_name(F.col("name")))
    nth = F.row_number().over(Window.partitionBy("job_id", "out").orderBy("doc_id"))
    rows = fine.select("job_id", F.when(nth == 1, F.col("out")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit("_"), F.col("out"))).alias("member"))
    return rows.unionByName(fine.select("job_id", F.lit("mapping.json").alias("member")).distinct()) if with_key else rows


def named(files: DataFrame) -> DataFrame:
    """Files (job_id, doc_id, out, content) to (job_id, member, content); of one name all but the first have their id in front."""
    nth = F.row_number().over(Window.partitionBy("job_id", "out").orderBy("doc_id"))
    front = F.concat(F.left(F.sha2(F.col("doc_id").cast("string"), 256), F.lit(12)), F.lit("_"), F.col("out"))
    return files.select("job_id", F.when(nth == 1, F.col("out")).otherwise(front).alias("member"), "content")


def archives(members: DataFrame) -> DataFrame:
    """(job_id, member, content) to (job_id, archive): one zip for each job.

    A job has at most 25 files of 50 MB, so its group fits a task.
    """

    def run(table: pa.Table) -> pa.Table:
        out = io.BytesIO()
        rows = sorted(zip(table["member"].to_pylist(), table["content"].to_pylist(), strict=True))
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, content in rows:
                archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content)
        return pa.table({"job_id": table["job_id"][:1], "archive": pa.array([out.getvalue()], pa.binary())})

    return members.groupBy("job_id").applyInArrow(run, "job_id string, archive binary")
