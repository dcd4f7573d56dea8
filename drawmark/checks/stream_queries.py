"""Streams run over the benchmark tables, checked by the SQL of their batch forms."""
from __future__ import annotations

from pyspark.sql import functions as F

from drawmark.checks.catalog import query
from drawmark.checks.job_queries import _A3, _STABLE, _STATE, EV, OB
from drawmark.streaming import jobs, watch


def observations(spark, sf):
    return jobs.view_stream(spark, sf, "file_observations").withColumn("seen_at", F.col("seen_at").cast("timestamp"))


@query("S14", "SELECT path, count(*) AS n FROM file_observations GROUP BY path", OB)
def s14(spark, sf):
    counts = observations(spark, sf).groupBy("path").agg(F.count("*").alias("n"))
    return jobs.run_to_table(counts, "update").groupBy("path").agg(F.max("n").alias("n"))


@query("T1_stream", _STABLE + " SELECT path, CAST(epoch_us(run_start) AS BIGINT) AS run_start, CAST(epoch_us(stable_at) AS BIGINT) AS stable_at, size_bytes FROM stable", OB)
def t1_stream(spark, sf):
    out = watch.settled_runs(jobs.run_to_table(watch.stable_stream(observations(spark, sf)), "update"))
    return out.select("path", F.unix_micros("run_start").alias("run_start"), F.unix_micros("stable_at").alias("stable_at"), "size_bytes")


@query("T3_stream", _STATE + " SELECT job_id, status, retry_count, CAST(epoch_us(created_at) AS BIGINT) AS created_at, CAST(epoch_us(started_at) AS BIGINT) AS started_at, CAST(epoch_us(finished_at) AS BIGINT) AS finished_at, error_msg, has_result FROM jobs", EV)
def t3_stream(spark, sf):
    events = jobs.view_stream(spark, sf, "job_events").withColumn("event_time", F.col("event_time").cast("timestamp"))
    out = jobs.run_to_table(jobs.job_states(events), "update")
    fields = [c for c in out.columns if c not in ("job_id", "batch")]
    return out.groupBy("job_id").agg(F.max_by(F.struct(*fields), "batch").alias("s")).select("job_id", "s.*")


@query("T6", f"SELECT batch_id, CAST(to_json({{phase: 'processing', isRunning: completed < total, totalFiles: total, currentFile: completed, totalElapsed: elapsed, progress: progress}}) AS VARCHAR) AS status FROM ({_A3})", ("job_log",))
def t6(spark, sf):
    finished = jobs.view_stream(spark, sf, "job_log").withColumn("seconds_whole", F.floor("seconds").cast("bigint")).withColumn("finished_at", F.col("process_date").cast("timestamp"))
    out = jobs.run_to_table(jobs.status_feed(finished), "update")
    return out.groupBy("batch_id").agg(F.max_by("status", "batch").alias("status"))
