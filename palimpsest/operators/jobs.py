"""Jobs: their state, expiry, progress and the requests that poll them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import display
from palimpsest.functions.constants import JOB_TTL_MINUTES, MAX_FILES, MAX_UPLOAD_MB, POLL_SAMPLE, SLOW_MS
from palimpsest.sources.tables import numbered


def upload_errors(uploads: DataFrame) -> DataFrame:
    """Uploads (job_id, name, size) with ``error``, the first reason to refuse one; null if fine."""
    count = F.count("*").over(Window.partitionBy("job_id"))
    name = display.base_name(F.col("name"))
    reason = F.when(count > MAX_FILES, "too_many_files").when(~display.is_supported(name), "unsupported_format").when(F.col("size") > MAX_UPLOAD_MB * 1024 * 1024, "file_too_large").when(F.col("size") == 0, "file_empty")
    return uploads.withColumn("error", reason)


def visible(jobs: DataFrame, client: Column) -> DataFrame:
    return jobs.where(F.col("client_id") == client)


def last_status(log: DataFrame, key: str = "job_id", at: str = "at") -> DataFrame:
    """The state that each job was last in; of one moment, the greatest event id decides."""
    last = F.struct(at, "event_id")
    return log.groupBy(key).agg(F.max_by("status", last).alias("status"), F.max(at).alias("updated_at"))


def expired(jobs: DataFrame, now: Column, minutes: int = JOB_TTL_MINUTES) -> DataFrame:
    return jobs.where(F.col("updated_at") < now - F.expr(f"interval {minutes} minutes"))


def purge(spark: SparkSession, root: str, expired_jobs: DataFrame, most: int = 100_000) -> list[str]:
    """Delete the folders below ``root`` that are named after expired jobs, in any store; their names.

    ``most`` bounds what is brought to the driver at once; call again while there are that many.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for row in expired_jobs.select(F.col("job_id").cast("string").alias("job_id")).distinct().limit(most).collect():
        name = row["job_id"]
        if name and "/" not in name and name not in {".", ".."} and store.exists(own := spark._jvm.org.apache.hadoop.fs.Path(path, name)):
            store.delete(own, True)
            gone.append(name)
    return sorted(gone)


def orphans(folders: DataFrame, jobs: DataFrame) -> DataFrame:
    """Folders that no job has."""
    return folders.join(jobs.select("job_id"), "job_id", "left_anti")


def patched(entities: DataFrame, patches: DataFrame) -> DataFrame:
    """Entities with a reviewer's changes; patches of unknown ids are passed over, the last one (by seq) of an id counts."""
    last = patches.groupBy("id").agg(F.max_by(F.struct("selected", "inflect", "variants", "category"), "seq").alias("p"))
    out = entities.join(last, "id", "left")
    new = {c: F.coalesce(f"p.{c}", c) for c in ("selected", "inflect", "variants")} | {"category": F.coalesce(F.upper("p.category"), "category")}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in entities.columns])


def eta(log: DataFrame, *keys: str) -> DataFrame:
    """Progress rows (keys, at, event_id, stage, document, done, total) with seconds left at the present pace.

    The clock starts anew when stage or document changes; null before the first
    and after the last step.
    """
    order = Window.partitionBy(*keys).orderBy("at", "event_id")
    same = F.col("stage").eqNullSafe(F.lag("stage").over(order)) & F.col("document").eqNullSafe(F.lag("document").over(order))
    rows = log.withColumn("session", F.sum(F.when(same, 0).otherwise(1)).over(order))
    began = F.min("at").over(Window.partitionBy(*keys, "session"))
    took = (F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(began.cast("timestamp"))) / 1e6
    left = took / F.col("done") * (F.col("total") - F.col("done"))
    return rows.withColumn("eta", F.when((F.col("done") > 0) & (F.col("done") < F.col("total")), left))


def logged_requests(requests: DataFrame, slow_ms: int = SLOW_MS, sample: int = POLL_SAMPLE) -> DataFrame:
    """Requests (event_id, path, is_poll, status, ms) worth a line: slow, failed, not a poll, or every 20th fine poll of a path."""
    odd = (F.col("ms") >= slow_ms) | (F.col("status") >= 400)
    rows = numbered(requests, "nth", [F.col("path"), F.col("is_poll"), odd], [F.col("event_id")])
    return rows.where(odd | ~F.col("is_poll") | (F.col("nth") % sample == 0))


def miss_streaks(polls: DataFrame, *keys: str) -> DataFrame:
    """(keys, longest): the longest run of failed polls."""
    order = Window.partitionBy(*keys).orderBy("at", "event_id")
    both = polls.withColumn("island", F.row_number().over(order) - F.sum(F.col("missed").cast("int")).over(order))
    runs = both.where("missed").groupBy(*keys, "island").agg(F.count("*").alias("n"))
    return runs.groupBy(*keys).agg(F.max("n").alias("longest"))
