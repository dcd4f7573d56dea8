"""Job states, status feed and log sink as streams."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from drawmark.operators.reports import status_documents
from drawmark.session import checkpoint_dir
from drawmark.settings import MAX_RETRY
from drawmark.sources.views import VIEWS

FILES_PER_BATCH = 64  # so that a batch, and a key's share of it, is bounded
_STATE = "status string, retry_count int, created_at bigint, started_at bigint, finished_at bigint, error_msg string, has_result boolean"
_TIMED = ("enqueue", "claim", "done", "fail")
_FACTS = ", ".join(f"{op}_seq bigint, {op}_at bigint" for op in _TIMED) + ", reset_seq bigint, fail_seqs array<bigint>"


def step(state: tuple | None, op: str, at: int, max_retry: int) -> tuple | None:
    """State of a job after one more event; nothing happens to a job that was never enqueued."""
    if op == "enqueue":
        return ("pending", 0, at, None, None, None, False)
    if state is None:
        return None
    status, retries, created, started, finished, error, result = state
    if op == "claim":
        return ("running", retries, created, at, finished, error, result)
    if op == "done":
        return ("done", retries, created, started, at, None, True)
    if op == "reset":
        return ("pending" if status == "running" else status, retries, created, started, finished, error, result)
    if retries < max_retry:
        return ("pending", retries + 1, created, None, None, None, result)
    return ("failed", retries, created, started, at, "error", result)


def _millis(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


def merged(state: tuple, events: Iterable[tuple[int, str, int]]) -> tuple:
    """Facts of a job after more events (event_seq, op, time), in whatever order they come: the last enqueue, claim, done
    and fail as sequence number and time, the last reset, and the numbers of the failures after the enqueue."""
    last = {op: (state[2 * k], state[2 * k + 1]) for k, op in enumerate(_TIMED) if state[2 * k] is not None}
    reset, fails = state[-2], list(state[-1])
    for seq, op, at in events:
        if op in _TIMED:
            last[op] = max(last.get(op, (seq, at)), (seq, at))
        if op == "reset":
            reset = seq if reset is None else max(reset, seq)
        if op == "fail":
            fails.append(seq)
    if "enqueue" in last:
        fails = [f for f in fails if f > last["enqueue"][0]]
    return (*(x for op in _TIMED for x in last.get(op, (None, None))), reset, fails)


def job_of(state: tuple, max_retry: int) -> tuple | None:
    """A job's row from its facts, as in ``operators.jobs.current_jobs``; none if it was never enqueued."""
    enqueued, created = state[:2]
    if enqueued is None:
        return None
    last = {op: (state[2 * k], state[2 * k + 1], op) for k, op in enumerate(_TIMED) if state[2 * k] is not None and state[2 * k] > enqueued}
    reset, fails = state[-2], sorted(state[-1])
    used = fails[:max_retry]
    fresh = {op: e for op, e in last.items() if not used or e[0] > used[-1]}
    ended = max((fresh[op] for op in ("done", "fail") if op in fresh), default=None)
    moved = max(last.values(), default=None)
    status = "pending"
    if moved and moved[2] == "claim" and not (reset is not None and reset > moved[0]):
        status = "running"
    elif moved and moved[2] == "done":
        status = "done"
    elif moved and moved[2] == "fail" and len(fails) > max_retry:
        status = "failed"
    return (status, min(len(fails), max_retry), created, fresh["claim"][1] if "claim" in fresh else None, ended[1] if ended else None,
            "error" if ended and ended[2] == "fail" else None, "done" in last)


def job_states(events: DataFrame, max_retry: int = MAX_RETRY, forget_after: str = "30 days") -> DataFrame:
    """Stream of changed job states from a stream of job events (times in microseconds), which may come in any order. The
    state of a job is dropped when no event of it has come for ``forget_after`` by the clock, whatever the events' times."""
    forget_ms = _millis(forget_after)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        state = kept.get if kept.exists else (*[None] * 9, [])
        for b in batches:
            state = merged(state, zip(b["event_seq"].tolist(), b["op"], b["event_time"].astype("datetime64[us]").astype("int64").tolist()))
        kept.update(state)
        kept.setTimeoutDuration(forget_ms)
        job = job_of(state, max_retry)
        if job is not None:
            columns = ["job_id"] + [c.split()[0] for c in _STATE.split(", ")]
            yield pd.DataFrame([(key[0], *job)], columns=columns).astype({c: "Int64" for c in ("created_at", "started_at", "finished_at")})

    return events.groupBy("job_id").applyInPandasWithState(follow, f"job_id bigint, {_STATE}", _FACTS, "update", GroupStateTimeout.ProcessingTimeTimeout)


def status_feed(files: DataFrame, forget_after: str = "30 days") -> DataFrame:
    """Stream of status documents per batch, from a stream of finished files (batch_id, status, seconds_whole), in any
    order. Counts are kept per batch until no file of it has come for ``forget_after`` by the clock."""
    forget_ms = _millis(forget_after)

    def follow(key: tuple, parts: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        done, total, elapsed = kept.get if kept.exists else (0, 0, 0)
        for p in parts:
            done, total = done + int((p["status"] == "success").sum()), total + len(p)
            elapsed += int(p["seconds_whole"].sum())
        kept.update((done, total, elapsed))
        kept.setTimeoutDuration(forget_ms)
        yield pd.DataFrame([(key[0], done, total, elapsed)], columns=["batch_id", "completed", "total", "elapsed"])

    counts = files.select("batch_id", "status", "seconds_whole").groupBy("batch_id").applyInPandasWithState(
        follow, "batch_id bigint, completed bigint, total bigint, elapsed bigint", "completed bigint, total bigint, elapsed bigint",
        "update", GroupStateTimeout.ProcessingTimeTimeout)
    return status_documents(counts.withColumn("progress", F.floor(F.col("completed") * 100 / F.col("total")).cast("int")))


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str = "update", every: str | None = None) -> StreamingQuery:
    """Run a stream into ``write``; without ``every`` it stops when all that is there has been read.

    Batches come with their number, so a repeated batch can be recognised by the sink."""
    folder = f"{checkpoint_dir(stream.sparkSession)}/streams/{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", folder).foreachBatch(write)
    if every:
        return writer.trigger(processingTime=every).start()
    # a time limit by the clock asks for batches without input for ever; a stream takes the session's settings at its start
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        conf.set(name, before)


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and read its output back; every row carries its batch."""
    spark = stream.sparkSession
    out = f"{checkpoint_dir(spark)}/stream-output/{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = each_batch(stream, write, mode)
    query.awaitTermination()
    return spark.read.schema(f"{stream.schema.toDDL()}, batch int").parquet(out)


def view_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Input view as a stream of the files of its base table."""
    base, exprs = VIEWS[name]
    path = f"{sf_dir}/{base}.parquet"
    # a pattern, as a stream over a plain path wants a folder and a table may be a single file
    pattern = f"{sf_dir}/{base}.parque[t]"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(pattern).selectExpr(*exprs)
