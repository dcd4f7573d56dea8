"""Job life cycle from an append-only event log.

The state of a job follows from a few of its events, so it is computed from grouped minima and maxima
that are reduced before the shuffle, not by folding a job's events in one place. An enqueue starts the
job anew, a failure is queued again until the retries are used up, a reset only affects a running job,
and of two other events the later one counts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawmark.settings import JOB_STATUSES, MAX_RETRY


def _last(op: str | tuple[str, ...], value: Column) -> Column:
    ops = (op,) if isinstance(op, str) else op
    return F.max(F.when(F.col("op").isin(*ops), value))


def _requeues(events: DataFrame, max_retry: int) -> DataFrame:
    """Number of failures of each job and the event of the last one that was queued again."""
    fails = events.filter("op = 'fail'")
    counts = fails.groupBy("job_id").agg(F.count("*").alias("n_fails"), F.min("event_seq").alias("first_fail"))
    if max_retry == 0:
        return counts.select("job_id", "n_fails", F.lit(None).cast("bigint").alias("requeued_at"))
    if max_retry == 1:
        return counts.select("job_id", "n_fails", F.col("first_fail").alias("requeued_at"))
    order = Window.partitionBy("job_id").orderBy("event_seq")
    used = (fails.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= max_retry)
            .groupBy("job_id").agg(F.max("event_seq").alias("requeued_at")))
    return counts.join(used, "job_id").select("job_id", "n_fails", "requeued_at")


def current_jobs(events: DataFrame, max_retry: int = MAX_RETRY) -> DataFrame:
    """Present state of every job that was ever enqueued."""
    started = (events.filter("op = 'enqueue'").groupBy("job_id")
               .agg(F.max(F.struct("event_seq", "event_time")).alias("q"))
               .select("job_id", F.col("q.event_seq").alias("enqueued"), F.col("q.event_time").alias("created_at")))
    live = events.filter("op <> 'enqueue'").join(started.select("job_id", "enqueued"), "job_id").filter("event_seq > enqueued")
    marked = live.join(_requeues(live, max_retry), "job_id", "left")
    fresh = F.col("requeued_at").isNull() | (F.col("event_seq") > F.col("requeued_at"))
    event = F.struct("event_seq", "event_time", "op")
    state = marked.groupBy("job_id").agg(
        F.max("n_fails").alias("n_fails"),
        _last(("claim", "done", "fail"), event).alias("moved"),
        _last("reset", F.col("event_seq")).alias("reset_seq"),
        F.max(F.when(fresh & (F.col("op") == "claim"), event)).alias("claimed"),
        F.max(F.when(fresh & F.col("op").isin("done", "fail"), event)).alias("ended"),
        _last("done", F.col("event_seq")).alias("done_seq"))
    n_fails = F.coalesce("n_fails", F.lit(0))
    op = F.col("moved")["op"]
    status = (F.when((op == "claim") & (F.coalesce(F.col("reset_seq") > F.col("moved")["event_seq"], F.lit(False))), "pending")
              .when(op == "claim", "running").when(op == "done", "done")
              .when((op == "fail") & (n_fails > max_retry), "failed").otherwise("pending"))
    return started.join(state, "job_id", "left").select(
        "job_id", status.alias("status"), F.least(n_fails, F.lit(max_retry)).cast("int").alias("retry_count"), "created_at",
        F.col("claimed")["event_time"].alias("started_at"), F.col("ended")["event_time"].alias("finished_at"),
        F.when(F.col("ended")["op"] == "fail", "error").alias("error_msg"), F.col("done_seq").isNotNull().alias("has_result"))


def stale_reset(jobs: DataFrame) -> DataFrame:
    """Running jobs go back to pending; their start time stays."""
    was_running = F.col("status") == "running"
    return jobs.withColumn("was_reset", was_running).withColumn("status", F.when(was_running, "pending").otherwise(F.col("status")))


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n"))


def with_status(jobs: DataFrame, status: str, limit: int = 100) -> DataFrame:
    """Oldest jobs with a status."""
    if status not in JOB_STATUSES:
        raise ValueError(f"invalid status: {status!r}")
    return jobs.filter(F.col("status") == status).orderBy("created_at", "job_id").limit(limit)


def next_pending(jobs: DataFrame) -> DataFrame:
    return with_status(jobs, "pending", 1)


def terminal_rows(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Results of jobs that are over: done, or failed with no retry left."""
    over = jobs.filter(F.col("status").isin("done", "failed"))
    return over.join(files, "job_id").select(
        "job_id", "file_name", F.when(F.col("status") == "done", "success").otherwise("error").alias("status"),
        "method", F.col("finished_at").alias("process_date"))


def batch_progress(files: DataFrame, keys: list[str]) -> DataFrame:
    """Completed and total files and the truncated percentage. Failed files do not count as completed."""
    done = F.count(F.when(F.col("status") == "success", 1))
    return (files.groupBy(*keys).agg(done.alias("completed"), F.count("*").alias("total"), F.sum("seconds_whole").alias("elapsed"))
            .withColumn("progress", F.floor(F.col("completed") * 100 / F.col("total")).cast("int")))


def committed_boxes(edits: DataFrame) -> DataFrame:
    """State of each edited box and its last committed text.

    Unlock and reset lead to one state from any other, so only the events after the last of them matter:
    after an unlock the first confirm counts, and then the last commit with a text."""
    order = F.struct("event_seq", "action")
    sync = (edits.groupBy("box_id").agg(F.max(F.when(F.col("action").isin("unlock", "reset"), order)).alias("s"))
            .select("box_id", F.col("s.event_seq").alias("sync_seq"), F.col("s.action").alias("sync")))
    open_boxes = sync.filter("sync = 'unlock'").select("box_id", "sync_seq")
    after = edits.join(open_boxes, "box_id").filter("event_seq > sync_seq")
    confirmed = after.filter("action = 'confirm'").groupBy("box_id").agg(F.min("event_seq").alias("confirm_seq"))
    text = F.trim("text")
    commits = (edits.filter((F.col("action") == "commit") & (text != "")).join(confirmed, "box_id").filter("event_seq > confirm_seq")
               .groupBy("box_id").agg(F.max(F.struct(F.col("event_seq"), text.alias("text"), "x", "y", "w", "h")).alias("c")))
    state = (F.when(F.col("sync").isNull() | (F.col("sync") == "reset"), "locked").when(F.col("confirm_seq").isNull(), "unlocked")
             .when(F.col("c").isNull(), "box_confirmed").otherwise("text_committed"))
    return (sync.join(confirmed, "box_id", "left").join(commits, "box_id", "left")
            .select("box_id", state.alias("state"), F.col("c.text").alias("text"), "c.x", "c.y", "c.w", "c.h"))


def savable_boxes(boxes: DataFrame) -> DataFrame:
    """Committed boxes with rounded corners; boxes without area are left out."""
    sized = boxes.filter("state = 'text_committed'").select(
        "box_id", "text", *[F.bround(F.col(c), 0).cast("int").alias(c) for c in "xywh"])
    return sized.filter("w > 0 AND h > 0")
