"""Streams over more small files than a batch takes, in shuffled order, against their batch forms."""
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from drawmark.operators import jobs
from drawmark.sources import tasks
from drawmark.streaming import jobs as streams
from drawmark.streaming import run_map, watch, write_back

T0 = datetime(2024, 1, 1)
N_FILES = 70


def shuffled_files(spark, tmp_path, rows, schema, per_batch=streams.FILES_PER_BATCH):
    """Stream of ``rows`` in time-ordered files that come in another order; the first batch has the latest times."""
    import os
    import pyarrow as pa
    import pyarrow.parquet as pq
    table = spark.createDataFrame(rows, schema).toArrow()
    table = table.cast(pa.schema([pa.field(f.name, pa.timestamp("us", "UTC")) if pa.types.is_timestamp(f.type) else f for f in table.schema]))
    order = list(range(N_FILES))
    random.shuffle(order)
    order.remove(N_FILES - 1)
    order.insert(0, N_FILES - 1)
    size = -(-len(rows) // N_FILES)
    for place, k in enumerate(order):
        path = tmp_path / f"part-{k:03d}.parquet"
        pq.write_table(table.slice(k * size, size), path)
        os.utime(path, (1_700_000_000 + place, 1_700_000_000 + place))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(str(tmp_path))


def last_rows(out, key):
    return out.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("batch")))).filter("_n = 1").drop("_n", "batch")


def test_job_states_in_any_order(spark, tmp_path):
    random.seed(4)
    ops = ["enqueue", "claim", "claim", "done", "fail", "fail", "reset"]
    rows = [(random.randint(0, 60), i, T0 + timedelta(hours=i), random.choice(ops)) for i in range(1400)]
    schema = "job_id bigint, event_seq bigint, event_time timestamp, op string"
    out = last_rows(streams.run_to_table(streams.job_states(shuffled_files(spark, tmp_path, rows, schema)), "update"), "job_id")
    assert {r["job_id"] for r in out.collect()} and out.count() > 50
    want = jobs.current_jobs(spark.createDataFrame(rows, schema))
    for c in ("created_at", "started_at", "finished_at"):
        want = want.withColumn(c, F.unix_micros(c))
    assert sorted(map(tuple, out.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_status_feed_in_any_order(spark, tmp_path):
    random.seed(5)
    rows = [(random.randint(0, 9), random.choice(["success", "error"]), random.randint(0, 9), T0 + timedelta(hours=i)) for i in range(1400)]
    schema = "batch_id bigint, status string, seconds_whole bigint, finished_at timestamp"
    seen = {}

    def note(batch, number):
        seen[number] = batch.collect()
    streams.each_batch(streams.status_feed(shuffled_files(spark, tmp_path, rows, schema)), note).awaitTermination()
    assert len(seen) > 1
    got = {}
    for number in sorted(seen):
        got |= {r["batch_id"]: tuple(r) for r in seen[number]}
    counts = jobs.batch_progress(spark.createDataFrame(rows, schema), ["batch_id"])
    from drawmark.operators.reports import status_documents
    want = status_documents(counts.select("batch_id", "completed", "total", "elapsed", "progress"))
    assert got == {r["batch_id"]: tuple(r) for r in want.collect()}


OBSERVED = "path string, seen_at timestamp, obs_seq bigint, size_bytes bigint, mtime_us bigint"


@pytest.mark.parametrize("per_batch", [9, 64])
def test_stable_files_in_any_order(spark, tmp_path, per_batch):
    random.seed(per_batch)
    rows, at = [], T0
    for i in range(1050):
        at += timedelta(milliseconds=random.choice([400, 900, 1500, 86_400_000]))
        size = random.choice([1, 1, 1, 1, 2, None])
        rows.append((random.choice("abcdefgh") + ".tif", at, i, size, None if size is None else random.choice([7, 7, 7, 8])))
    out = watch.settled_runs(streams.run_to_table(watch.stable_stream(shuffled_files(spark, tmp_path, rows, OBSERVED, per_batch)), "update"))
    want = watch.stable_runs(spark.createDataFrame(rows, OBSERVED)).select(*out.columns)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and want.count() > 50


def plain_runs(seen, wait):
    """Observation by observation."""
    found, facts, start = {}, None, 0
    for at, number, *now in sorted(set(seen)):
        if facts != now:
            facts, start = now, at
        elif now[0] != run_map.NONE and at - start >= wait:
            found.setdefault(start, (at, now[0]))
    return found


def stable(runs, wait):
    return {int(r.times[0]): (r.stable_at(wait), r.size) for r in runs if r.stable_at(wait) is not None}


def test_run_map():
    random.seed(7)
    kinds = [(1, 1), (1, 2), (2, 1), (run_map.NONE, run_map.NONE)]
    for _ in range(600):
        seen = [(at, at, *random.choice(kinds[:random.randint(1, 4)])) for at in random.sample(range(60), random.randint(1, 30))]
        seen += random.choices(seen, k=3)
        random.shuffle(seen)
        runs, have, done = [], {}, 0
        while done < len(seen):
            part = seen[done:done + random.randint(1, 8)]
            done += len(part)
            runs, went, came = run_map.merged(runs, run_map.Observations(*(np.array(c, dtype=np.int64) for c in zip(*part))))
            assert all((a.size, a.mtime) != (b.size, b.mtime) and a.times[-1] <= b.times[0] for a, b in zip(runs, runs[1:]))
            runs = run_map.unpacked(*run_map.packed(runs))
            have = {k: v for k, v in have.items() if k not in stable(went, 5)} | stable(came, 5)
            assert have == plain_runs(seen[:done], 5)


def test_run_map_of_a_path_seen_all_the_time():
    """With a limit to lateness the state of a file that is always there stays small, and in-order results are the same."""
    random.seed(8)
    seen, runs, have = [(2 * k, k, 1 if k % 997 else 2, 1) for k in range(5000)], [], {}
    for k in range(0, len(seen), 10):
        runs, went, came = run_map.merged(runs, run_map.Observations(*(np.array(c, dtype=np.int64) for c in zip(*seen[k:k + 10]))))
        have = {t: v for t, v in have.items() if t not in stable(went, 5)} | stable(came, 5)
        runs = run_map.compacted(runs, 5, 100)
        assert sum(len(r.times) for r in runs) < 65 and stable(runs[-1:], 5).items() <= have.items()
    assert have == plain_runs(seen, 5)


def test_write_back_counts_a_repeated_batch_once(spark, tmp_path):
    """Updates from shuffled files; a later batch wins, a batch that comes again changes nothing."""
    random.seed(8)
    rows = [(f"t{random.randrange(60)}", random.choice(["b", None]), "f.tif", str(k % 7), "1", "1", random.choice("NO")) for k in range(400)]
    (tmp_path / "in").mkdir()
    stream = shuffled_files(spark, tmp_path / "in", rows, write_back.UPDATE, per_batch=9)
    folder = str(tmp_path / "out")
    assert write_back.recorded(spark, folder).count() == 0
    write_back.write_back_stream(stream, folder).awaitTermination()
    parts = {r["batch"]: [] for r in spark.read.parquet(folder).select("batch").distinct().collect()}
    assert len(parts) == 8
    for r in spark.read.parquet(folder).collect():
        parts[r["batch"]].append(tuple(r)[:7])
    want = {}
    for number in sorted(parts):
        assert len({r[:5] for r in parts[number]}) == len(parts[number])
        want |= {r[:5]: r[5:] for r in parts[number]}
    assert set(want) == {r[:5] for r in rows}
    got = lambda: {tuple(r)[:5]: tuple(r)[5:] for r in write_back.recorded(spark, folder).collect()}
    assert got() == want
    write_back.record(spark.createDataFrame(parts[3] + parts[3][:5], write_back.UPDATE), 3, folder)
    assert got() == want

    keys = sorted({r[:5] for r in rows}, key=str) + [("other", None, "f.tif", "1", "1")]
    table = spark.createDataFrame([(*k, "0", i) for i, k in enumerate(keys + keys[:3])], "th string, bbh string, filename string, docnumber string, work_seq string, isprocess string, upd_timestamp int")
    once = write_back.applied(table, write_back.recorded(spark, folder))
    key = lambda r: (r["th"], r["bbh"], r["filename"], r["docnumber"], r["work_seq"])
    assert once.count() == len(keys) + 3
    assert all((r["isprocess"], r["ocr"]) == want.get(key(r), ("0", None)) for r in once.collect())
    twice = write_back.applied(once, write_back.recorded(spark, folder))
    assert sorted(map(str, twice.select(*once.columns).collect())) == sorted(map(str, once.collect()))
    assert {r["th"] for r in tasks.pending(once).collect()} == {"other"}
