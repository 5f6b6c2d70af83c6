"""Job histories: status by folding events, trees of jobs, approvals, log records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What an event of a kind makes of its job.
STATUS_OF_EVENT = {
    "scheduled": "pending",
    "started": "running",
    "completed": "completed",
    "failed": "failed",
    "canceled": "failed",
    "timed_out": "failed",
    "terminated": "failed",
}


def status_of(event: Column) -> Column:
    pairs = [F.lit(x) for kv in STATUS_OF_EVENT.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), event)


def fold_status(events: DataFrame) -> DataFrame:
    """workflow_id, ref, status, message, n_events: the last known event of each activity or child decides."""
    known = events.withColumn("status", status_of(F.col("event_type"))).where(F.col("status").isNotNull())
    last = F.max_by(F.struct("status", "message"), "event_id")
    return known.groupBy("workflow_id", "ref").agg(last.alias("l"), F.count("*").alias("n_events")).select(
        "workflow_id", "ref", F.col("l.status").alias("status"), F.col("l.message").alias("message"), "n_events"
    )


def child_overrides(parent_view: DataFrame, own_view: DataFrame) -> DataFrame:
    """A child's own status instead of what its parent saw."""
    own = own_view.select(F.col("workflow_id").alias("ref"), F.col("status").alias("own"))
    return parent_view.join(own, "ref", "left").withColumn("status", F.coalesce("own", "status")).drop("own")


def latest_by_status(jobs: DataFrame) -> DataFrame:
    """status, id of the job that closed (or, still open, started) last; the first id of equals."""
    when = F.coalesce("close_time", "start_time")
    return jobs.groupBy("status").agg(F.max_by("id", F.struct(when, -F.col("id"))).alias("id"), F.max(when).alias("at"))


def approvals(jobs: DataFrame, signals: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """State of each job: its first signal before the deadline, else rejected once that has passed, else pending."""
    inside = signals.join(jobs.select("workflow_id", "started"), "workflow_id").where(F.col("ts") <= F.col("started") + F.make_interval(days=F.lit(days)))
    first = inside.groupBy("workflow_id").agg(F.min_by("signal", F.struct("ts", "signal")).alias("signal"))
    late = F.col("started") + F.make_interval(days=F.lit(days)) < now
    state = F.when(F.col("signal") == "approve", "APPROVED").when(F.col("signal") == "reject", "REJECTED").when(late, "REJECTED").otherwise("PENDING")
    return jobs.join(first, "workflow_id", "left").select("workflow_id", state.alias("state"))


def log_record(columns: list[str]) -> Column:
    """A JSON object of the columns that are not null."""
    return F.to_json(F.struct(*columns))


def allowed_failures(n: Column, share: float = 0.15, least: int = 2) -> Column:
    """Documents that may fail; rounded half to even."""
    return F.greatest(F.bround(n * share), F.lit(float(least))).cast("int")


def allowed_visual_failures(n: Column, share: float = 0.2) -> Column:
    """Figures and tables that may fail: a share cut to a whole number, at least one."""
    return F.greatest(F.lit(1), F.floor(n * share).cast("int"))


def part_actions(parts: DataFrame, most_mb: float = 25) -> DataFrame:
    """``parts`` (document_id, part, page_offset, ok, timed_out, size_mb) with their order by offset, what becomes of each, and a document's error.

    A failed part is read again as images, unless it timed out or is too large; a document without any part that is kept
    or read again has failed.
    """
    action = F.when(F.col("ok"), "keep").when(F.col("timed_out") | (F.col("size_mb") > most_mb), "drop").otherwise("rasterize")
    whole = Window.partitionBy("document_id")
    rows = parts.withColumn("action", action).withColumn("pos", F.row_number().over(whole.orderBy("page_offset")) - 1)
    left = F.count_if(F.col("action") != "drop").over(whole)
    return rows.withColumn("error", F.when(left == 0, "no part could be read"))


def backoff_seconds(round_number: Column, base: int = 30, most: int = 300) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2), round_number - 1), F.lit(most)).cast("int")


def split_plan(files: DataFrame, *, threshold_mb: float = 40, part_mb: float = 25, most_pages: int = 50) -> DataFrame:
    """Page ranges of the parts a large file is cut into: file_id, part, first_page, last_page (1-based)."""
    per_part = F.least(F.lit(most_pages), F.greatest(F.lit(1), F.floor(F.lit(part_mb) / (F.col("size_mb") / F.col("pages"))).cast("int")))
    n = F.when(F.col("size_mb") < threshold_mb, F.col("pages")).otherwise(per_part).cast("int")
    starts = files.select("file_id", "pages", n.alias("n")).where("pages > 0").select("file_id", "pages", "n", F.posexplode(F.sequence(F.lit(1), F.col("pages").cast("int"), F.col("n"))).alias("part", "first_page"))
    return starts.select("file_id", "part", "first_page", F.least(F.col("first_page") + F.col("n") - 1, F.col("pages").cast("int")).alias("last_page"))
