"""Watched folders: which files have stopped changing.

A folder is listed again and again (``record_listing``, ``watch_folder``); every listing adds one observation for each
file that is there, and one without a size for each that was there and is gone. The batch form of the search works on a
table of observations, the streaming form on a stream of them. Both give the first observation of an unchanged run
(equal size and modification time) that is ``stable_seconds`` or more after the run's start. A file that vanished
starts anew when it comes back."""
from __future__ import annotations

import time
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from drawmark.functions import names
from drawmark.operators import ranks
from drawmark.session import checkpoint_dir
from drawmark.settings import STABLE_SECONDS
from drawmark.sources import files
from drawmark.streaming import run_map

OBSERVATION = "path string, seen_at timestamp, obs_seq bigint, size_bytes bigint, mtime_us bigint"


def stable_runs(observations: DataFrame, stable_seconds: float = STABLE_SECONDS, bucket_seconds: int = 3600) -> DataFrame:
    """Stable files of an observation table: path, size, start of the unchanged run, time it became stable.

    A path's observations are cut into time buckets, so that a path with very many of them is spread over
    tasks. Each bucket passes its last size and its last change on to the next ones through a small table
    with one row per path and bucket."""
    obs = observations.withColumn("bucket", F.floor(F.unix_seconds(F.col("seen_at").cast("timestamp")) / bucket_seconds))
    obs = obs.withColumn("facts", F.struct("size_bytes", "mtime_us"))
    order = [F.col("seen_at"), F.col("obs_seq")]
    inside = Window.partitionBy("path", "bucket").orderBy(*order)
    buckets = Window.partitionBy("path").orderBy("bucket")

    ends = obs.groupBy("path", "bucket").agg(F.max(F.struct("seen_at", "obs_seq", "facts")).alias("end"))
    carried = ends.select("path", "bucket", F.lag("end").over(buckets)["facts"].alias("facts_before"))
    flagged = (obs.withColumn("_prev", F.lag("facts").over(inside)).withColumn("_n", F.row_number().over(inside))
               .join(carried, ["path", "bucket"])
               .withColumn("_before", F.when(F.col("_n") > 1, F.col("_prev")).otherwise(F.col("facts_before")))
               .withColumn("changed_at", F.when(~F.col("_before").eqNullSafe(F.col("facts")), F.col("seen_at"))))
    last_change = flagged.groupBy("path", "bucket").agg(F.max("changed_at").alias("bucket_change"))
    earlier = last_change.select("path", "bucket", F.max("bucket_change").over(
        buckets.rowsBetween(Window.unboundedPreceding, -1)).alias("change_before"))
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    timed = (flagged.withColumn("_own", F.max("changed_at").over(running)).join(earlier, ["path", "bucket"])
             .withColumn("run_start", F.coalesce("_own", "change_before")))
    waited = F.unix_micros(F.col("seen_at").cast("timestamp")) - F.unix_micros(F.col("run_start").cast("timestamp"))
    stable = timed.filter(F.col("changed_at").isNull() & F.col("size_bytes").isNotNull() & (waited >= int(stable_seconds * 1_000_000)))
    return stable.groupBy("path", "run_start").agg(F.min("seen_at").alias("stable_at"), F.min("size_bytes").alias("size_bytes"))


def vanished(tracked: DataFrame, present: DataFrame) -> DataFrame:
    """Paths that are no longer seen."""
    return tracked.select("path").distinct().join(present.select("path").distinct(), "path", "left_anti")


def promoted(stable: DataFrame, taken: DataFrame | None = None, at: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Queue rows of stable files (with the columns ``keep``), moved to ``processing/`` under a free name: their own, or the
    first ``_NNN`` that is neither in ``taken`` (column name) nor given to an earlier one of the same name."""
    spark = stable.sparkSession
    taken = spark.createDataFrame([], "name string") if taken is None else taken.select("name")
    named = stable.withColumn("source_file", names.base_name(F.col("path"))).filter("source_file IS NOT NULL")
    given = ranks.numbered(named, ["source_file"], ["stable_at", "path"], "_k")
    name = F.col("name")
    clash = taken.distinct().select(name.alias("source_file"), F.lit(True).alias("_clash"))
    given = given.join(clash, "source_file", "left").select(
        *given.columns, names.stem(F.col("source_file")).alias("_stem"), names.suffix(F.col("source_file")).alias("_ext"),
        (F.col("_k") - F.when(F.col("_clash"), 0).otherwise(1)).alias("need"))  # which free number; none for the first of a free name
    # a number of more digits is beyond any number of files
    pattern = r"^(.+)_(\d{3}|[1-9]\d{3,17})(\.[^.]*)?$"
    used = taken.filter(name.rlike(pattern)).select(
        F.regexp_extract(name, pattern, 1).alias("_stem"), F.regexp_extract(name, pattern, 3).alias("_ext"),
        F.regexp_extract(name, pattern, 2).cast("bigint").alias("number")).filter("number > 0").distinct()
    more = ranks.nth_free(given.filter("need > 0"), used, ["_stem", "_ext"])
    moved = (given.filter("need < 1").withColumn("moved", F.col("source_file")).unionByName(
        more.withColumn("moved", F.concat("_stem", F.lit("_"), F.lpad(F.col("free").cast("string"), F.greatest(F.length(F.col("free").cast("string")), F.lit(3)), F.lit("0")), "_ext")).drop("free")))
    parts = names.parsed_name(F.col("path"))
    return moved.select(
        F.lit("watch_folder").alias("source"), "source_file", F.concat(F.lit("processing/"), "moved").alias("file_path"),
        parts["drawing_no"].alias("drawing_no"), parts["revision"].alias("revision"), F.lit("pending").alias("status"),
        F.lit(0).alias("retry_count"), (at if at is not None else F.col("stable_at")).alias("created_at"), *keep)


def record_listing(spark: SparkSession, folder: str, log: str, at_us: int, pattern: str = "*") -> None:
    """Add a listing of ``folder``, taken at ``at_us``, to the observations below ``log``: one folder per listing, whose
    name orders them. Files that the listing before had and this one has not are noted without a size."""
    found = files.list_folder(spark, folder, pattern).filter(names.is_supported(F.col("file_name")))
    now = found.select("path", F.col("size_bytes").cast("bigint").alias("size_bytes"), F.unix_micros("mtime").alias("mtime_us"))
    earlier = _listings(spark, log)
    if earlier:
        before = spark.read.schema(OBSERVATION).parquet(earlier[-1]).filter("size_bytes IS NOT NULL")
        gone = before.select("path").join(now.select("path"), "path", "left_anti")
        now = now.unionByName(gone, allowMissingColumns=True)
    at = F.lit(at_us).cast("bigint")
    now.select("path", F.timestamp_micros(at).alias("seen_at"), at.alias("obs_seq"), "size_bytes", "mtime_us").write.mode("overwrite").parquet(f"{log}/at={at_us:020d}")


def _listings(spark: SparkSession, log: str) -> list[str]:
    """Folders of the listings so far, in order."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(log)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    return sorted(s.getPath().toString() for s in system.listStatus(path) if s.getPath().getName().startswith("at="))


def watch_folder(spark: SparkSession, folder: str, log: str, every: str = "2 seconds", pattern: str = "*") -> StreamingQuery:
    """List ``folder`` at each trigger. A stream's own file source names a path once; a listing sees it change."""
    def note(batch: DataFrame, number: int) -> None:
        record_listing(spark, folder, log, time.time_ns() // 1000, pattern)
    beat = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (beat.writeStream.option("checkpointLocation", f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}")
            .foreachBatch(note).trigger(processingTime=every).start())


def observed(spark: SparkSession, log: str, listings_per_batch: int = 10) -> DataFrame:
    """Stream of the observations that listings have written; a batch takes a bounded number of listings' files."""
    return (spark.readStream.schema(OBSERVATION).option("maxFilesPerTrigger", listings_per_batch)
            .option("latestFirst", False).parquet(f"{log}/at=*"))


def _column(parts: list[pd.DataFrame], name: str) -> np.ndarray:
    whole = pd.concat([p[name] for p in parts], ignore_index=True)
    if name == "seen_at":
        return whole.to_numpy("datetime64[us]").astype("int64")
    return whole.astype("Int64").fillna(run_map.NONE).to_numpy("int64")


def stable_stream(observations: DataFrame, stable_seconds: float = STABLE_SECONDS, forget_after: str = "1 day", late: str | None = None) -> DataFrame:
    """Changes of the stable files of a stream of observations, which may come in any order (for ``update`` mode).

    A row gives the time at which an unchanged run (path, run_start) became stable; without a time it takes back an earlier
    row, as an observation that came later showed that the run began or ended otherwise. What holds is the last row of
    each run, and is what ``stable_runs`` gives for all observations so far. A path's state is dropped when nothing of it
    has come for ``forget_after`` by the clock. A path that is seen all the time needs ``late`` for a bounded state:
    observations that much earlier than its latest one, or more, are then too late to count."""
    wait = int(stable_seconds * 1_000_000)
    forget_ms = int(pd.Timedelta(forget_after).total_seconds() * 1000)
    late_us = None if late is None else int(pd.Timedelta(late).total_seconds() * 1_000_000)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        runs = run_map.unpacked(*state.get) if state.exists else []
        parts = list(batches)  # one path's observations of one batch
        seen = run_map.Observations(*(_column(parts, c) for c in ("seen_at", "obs_seq", "size_bytes", "mtime_us")))
        if late_us is not None and runs:
            seen = seen.taken(seen.times > runs[-1].times[-1] - late_us)
        went, came = [], []
        if len(seen.times):
            runs, went, came = run_map.merged(runs, seen)
        if late_us is not None:
            runs = run_map.compacted(runs, wait, late_us)
        state.update(run_map.packed(runs))
        state.setTimeoutDuration(forget_ms)
        before, now = ({int(r.times[0]): (r.stable_at(wait), r.size) for r in rs if r.stable_at(wait) is not None} for rs in (went, came))
        changes = [(start, *now.get(start, (None, None))) for start in sorted({*before, *now}) if before.get(start) != now.get(start)]
        if changes:
            start, at, size = zip(*changes)
            yield pd.DataFrame({"path": key[0], "run_start": pd.to_datetime(list(start), unit="us"), "stable_at": pd.to_datetime(pd.array(at, dtype="Int64"), unit="us"),
                                "size_bytes": pd.array(size, dtype="Int64")})

    return observations.groupBy("path").applyInPandasWithState(
        follow, "path string, run_start timestamp, stable_at timestamp, size_bytes bigint",
        "sizes array<bigint>, mtimes array<bigint>, counts array<bigint>, times binary, numbers binary", "update", GroupStateTimeout.ProcessingTimeTimeout)


def settled_runs(changes: DataFrame) -> DataFrame:
    """What holds after all batches of ``stable_stream`` (with the column ``batch``): path, run_start, stable_at, size_bytes."""
    last = changes.groupBy("path", "run_start").agg(F.max_by(F.struct("stable_at", "size_bytes"), "batch").alias("s"))
    return last.select("path", "run_start", "s.*").filter("stable_at IS NOT NULL")
