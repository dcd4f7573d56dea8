"""Queue, watch and edit scenarios, and skewed inputs."""
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from drawmark.operators import jobs
from drawmark.sources import box_csv, files, logs
from drawmark.streaming import watch
from drawmark.streaming.jobs import run_to_table, step

T0 = datetime(2024, 1, 1)


def events(spark, rows):
    data = [(j, i, T0 + timedelta(seconds=i), op) for i, (j, op) in enumerate(rows)]
    return spark.createDataFrame(data, "job_id bigint, event_seq bigint, event_time timestamp, op string")


def test_queue_scenario(spark):
    log = [(1, "enqueue"), (2, "enqueue"), (3, "enqueue"), (1, "claim"), (1, "done"), (2, "claim"), (2, "fail"), (2, "claim"), (2, "done"), (3, "claim"), (3, "done")]
    got = {r["job_id"]: r for r in jobs.current_jobs(events(spark, log)).collect()}
    assert {r["status"] for r in got.values()} == {"done"}
    assert [got[j]["retry_count"] for j in (1, 2, 3)] == [0, 1, 0]
    assert all(r["error_msg"] is None for r in got.values())


def test_retry_keeps_its_place(spark):
    log = [(1, "enqueue"), (2, "enqueue"), (1, "claim"), (1, "fail")]
    state = jobs.current_jobs(events(spark, log))
    assert jobs.next_pending(state).collect()[0]["job_id"] == 1
    with pytest.raises(ValueError):
        jobs.with_status(state, "lost")


@pytest.mark.parametrize("max_retry", [0, 1, 3])
def test_states_follow_the_events(spark, max_retry):
    random.seed(max_retry)
    log = [(random.randint(0, 25), random.choice(["enqueue", "claim", "claim", "done", "fail", "fail", "reset"])) for _ in range(900)]
    want = {}
    for i, (job, op) in enumerate(log):
        state = step(want.get(job), op, i, max_retry)
        if state is not None:
            want[job] = state
    got = {}
    for r in jobs.current_jobs(events(spark, log), max_retry).collect():
        at = [None if r[c] is None else int((r[c] - T0).total_seconds()) for c in ("created_at", "started_at", "finished_at")]
        got[r["job_id"]] = (r["status"], r["retry_count"], *at, r["error_msg"], r["has_result"])
    assert got == want


def test_edits(spark):
    random.seed(5)
    log = [(random.randint(0, 15), i, random.choice(["unlock", "confirm", "commit", "reset"]), random.choice([" a ", "b", "  "])) for i in range(400)]
    want = {}
    for box, _, action, text in log:
        state, kept = want.get(box, ("locked", None))
        if action == "unlock":
            state = "unlocked"
        elif action == "confirm" and state == "unlocked":
            state = "box_confirmed"
        elif action == "commit" and text.strip() and state in ("box_confirmed", "text_committed"):
            state, kept = "text_committed", text.strip()
        elif action == "reset":
            state = "locked"
        want[box] = (state, kept)
    df = spark.createDataFrame([(*r, 1.5, 2.5, 3.0, 0.4) for r in log], "box_id bigint, event_seq bigint, action string, text string, x double, y double, w double, h double")
    got = {r["box_id"]: (r["state"], r["text"]) for r in jobs.committed_boxes(df).collect()}
    assert got == {b: (s, t if s == "text_committed" else None) for b, (s, t) in want.items()}


def observations(spark, rows):
    return spark.createDataFrame([(r[0], T0 + timedelta(milliseconds=r[1]), i, r[2], r[3] if len(r) > 3 else 5) for i, r in enumerate(rows)],
                                 "path string, seen_at timestamp, obs_seq bigint, size_bytes bigint, mtime_us bigint")


def test_stable_files(spark):
    rows = [("in/YA111111-1_eg.tif", ms, 10) for ms in (0, 2000, 2900, 3000, 5000)] + [("in/b.tif", ms, s) for ms, s in ((0, 1), (2000, 2), (4000, 2), (5000, 2))]
    got = watch.stable_runs(observations(spark, rows)).collect()
    assert [(r["path"], (r["stable_at"] - T0).total_seconds()) for r in sorted(got)] == [("in/YA111111-1_eg.tif", 3.0), ("in/b.tif", 5.0)]
    queued = watch.promoted(watch.stable_runs(observations(spark, rows[:5]))).collect()[0]
    assert (queued["drawing_no"], queued["source"], queued["source_file"]) == ("YA111111", "watch_folder", "YA111111-1_eg.tif")


def test_stable_files_do_not_depend_on_buckets(spark):
    random.seed(1)
    rows, ms = [], 0
    for _ in range(800):
        ms += random.randint(100, 4000)
        rows.append((random.choice(["a.tif", "a.tif", "b.tif"]), ms, random.choice([1, 1, 1, 2])))
    want = []
    last = {}
    for path, at, size in rows:
        if path not in last or last[path][0] != size:
            last[path] = [size, at, False]
        elif not last[path][2] and at - last[path][1] >= 3000:
            last[path][2] = True
            want.append((path, last[path][1], at))
    for bucket in (2, 60, 100000):
        got = watch.stable_runs(observations(spark, rows), bucket_seconds=bucket).collect()
        assert sorted((r["path"], round((r["run_start"] - T0).total_seconds() * 1000), round((r["stable_at"] - T0).total_seconds() * 1000)) for r in got) == sorted(want)


def test_box_files(spark, tmp_path):
    folder = tmp_path / "boxes"
    folder.mkdir()
    (folder / "a.csv").write_text("source_file,token,x1,y1,x2,y2\nXXX,YA001,10,20,110,70\nXXX,YA002,200,300,260,330\nYYY,B777,0,0,50,50\n"
                                  "YA057C857_0-脱敏.tif,YA057C800,10,20,60,70\nB507795_C-脱敏,B507795,100,200,300,400\nbad,T,x,1,2,3\n,T,1,2,3,4\n", encoding="utf-8")
    got = box_csv.read_boxes(spark, str(folder)).collect()
    assert sorted({r["stem"] for r in got}) == ["B507795_C-脱敏", "XXX", "YA057C857_0-脱敏", "YYY"]
    first = next(r for r in got if r["token"] == "YA001")
    assert (first["x2"] - first["x1"], first["y2"] - first["y1"]) == (100, 50)
    records = spark.createDataFrame([("f", "YA1", 1, 2, 3, 4)], "source_file string, token string, x int, y int, w int, h int")
    box_csv.write_boxes(box_csv.box_records(records), str(tmp_path))
    assert box_csv.read_boxes(spark, str(tmp_path)).collect()[0]["x2"] == 4
    box_csv.write_boxes(box_csv.box_records(records.limit(0)), str(tmp_path))
    assert "source_file" in "".join(p.read_text() for p in (tmp_path / "y_boxes.csv").glob("*.csv"))


def test_free_names(spark):
    taken = ["a.tif", "a_001.tif", "a_002.tif", "a_004.tif", "b.tif", "b_002.tif", "c_001.tif", "d.tif", "d_1.tif"]
    got = files.free_names(spark.createDataFrame([(n,) for n in ("a.tif", "b.tif", "c.tif", "d.tif")], "name string"), spark.createDataFrame([(n,) for n in taken], "name string"))
    assert {r["name"]: r["free_name"] for r in got.collect()} == {"a.tif": "a_003.tif", "b.tif": "b_001.tif", "c.tif": "c.tif", "d.tif": "d_001.tif"}


def test_log_sinks(spark, tmp_path):
    done = spark.createDataFrame([(1, "YA111111_R1.tif", "success", "ocr", T0), (2, "x.pdf", "error", "vector", T0)], "job_id bigint, file_name string, status string, method string, process_date timestamp")
    for _ in range(2):
        logs.append_log(logs.log_rows(done), str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 4 and {(r["ocr_flag"], r["status"]) for r in log.collect()} == {("O", "success"), ("N", "failed")}
    logs.append_csv(logs.log_rows(done), str(tmp_path / "csv"))
    assert "处理日期" in "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "csv").glob("*.csv"))


def test_changes_that_start_anew(spark):
    """A new modification time with equal size, and a file that was gone for a while."""
    rows = [("a.tif", 0, 9, 1), ("a.tif", 2000, 9, 2), ("a.tif", 4000, 9, 2), ("a.tif", 5000, 9, 2)]
    rows += [("b.tif", 0, 9, 1), ("b.tif", 2000, None, None), ("b.tif", 2500, 9, 1), ("b.tif", 5000, 9, 1), ("b.tif", 5500, 9, 1)]
    got = watch.stable_runs(observations(spark, rows)).collect()
    assert sorted((r["path"], (r["stable_at"] - T0).total_seconds()) for r in got) == [("a.tif", 5.0), ("b.tif", 5.5)]


def test_free_names_on_promotion(spark):
    rows = [(f"{d}/x.tif", ms, 1) for d in "abc" for ms in (0, 4000)] + [("a/y.tif", ms, 1) for ms in (0, 4000)]
    taken = spark.createDataFrame([("x.tif",), ("x_002.tif",)], "name string")
    got = watch.promoted(watch.stable_runs(observations(spark, rows)), taken).collect()
    assert sorted(r["file_path"] for r in got) == ["processing/x_001.tif", "processing/x_003.tif", "processing/x_004.tif", "processing/y.tif"]


def test_watched_folder(spark, tmp_path):
    """Files are written, grow, are rewritten with equal size, vanish and come back; listing after listing."""
    import os
    inbox, log = tmp_path / "inbox", str(tmp_path / "log")
    inbox.mkdir()
    start = int(T0.timestamp() * 1_000_000)

    def put(name, size, at):
        (inbox / name).write_bytes(b"x" * size)
        os.utime(inbox / name, (1_700_000_000 + at, 1_700_000_000 + at))

    def listing(second):
        watch.record_listing(spark, str(inbox), log, start + int(second * 1_000_000))

    put("grows.tif", 1, 0), put("same_size.tif", 5, 0), put("calm.tif", 3, 0), put("gone.tif", 2, 0), put("note.txt", 1, 0)
    listing(0)
    put("grows.tif", 4, 2)
    (inbox / "gone.tif").unlink()
    listing(2)
    put("same_size.tif", 5, 3)
    put("gone.tif", 2, 0)
    listing(3)
    listing(5)
    listing(6.5)
    want = [("calm.tif", 0, 3), ("gone.tif", 3, 6.5), ("grows.tif", 2, 5), ("same_size.tif", 3, 6.5)]

    def shown(rows):
        return sorted((r["path"].split("/")[-1], (r["run_start"] - T0).total_seconds(), (r["stable_at"] - T0).total_seconds()) for r in rows)

    table = spark.read.schema(watch.OBSERVATION).parquet(f"{log}/at=*")
    assert table.filter("size_bytes IS NULL").count() == 1
    assert shown(watch.stable_runs(table).collect()) == want
    for per_batch in (1, 10):
        stream = watch.stable_stream(watch.observed(spark, log, per_batch))
        assert shown(watch.settled_runs(run_to_table(stream, "update")).collect()) == want
    from drawmark.streaming import inbox as inboxes
    queue = str(tmp_path / "queue")
    (inbox / "processing").mkdir()
    for _ in range(2):  # a second run finds all of it queued
        inboxes.queue_stream(watch.observed(spark, log, 2), queue).awaitTermination()
        rows = inboxes.queue_rows(spark, queue).collect()
        assert sorted(r["file_path"] for r in rows) == [f"processing/{n}" for n, *_ in want]
    changes = watch.settled_runs(run_to_table(watch.stable_stream(watch.observed(spark, log, 9)), "update"))
    more = changes.withColumn("path", F.concat(F.lit("elsewhere/"), F.col("path")))
    last = max(r["batch"] for r in rows) + 1
    for _ in range(2):  # a repeated batch replaces its rows
        inboxes.queue_batch(more, last, queue)
        named = sorted(r["file_path"] for r in inboxes.queue_rows(spark, queue).filter(F.col("batch") == last).collect())
        assert named == [f"processing/{n[:-4]}_001.tif" for n, *_ in want]


def test_listings_as_a_source(spark, tmp_path):
    """Batches as the folder changes, a start from the checkpoint, and a log that does not grow."""
    import os

    from drawmark.streaming.listings import listing_stream, listing_times
    inbox, log, out, start = tmp_path / "inbox", str(tmp_path / "log"), str(tmp_path / "out"), int(T0.timestamp() * 1_000_000)
    inbox.mkdir()

    def put(name, size, at):
        (inbox / name).write_bytes(b"x" * size)
        os.utime(inbox / name, (1_700_000_000 + at, 1_700_000_000 + at))

    def processed():
        changes = watch.stable_stream(listing_stream(spark, log))
        query = (changes.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
                 .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")).start())
        query.awaitTermination()

    put("calm.tif", 3, 0), put("grows.tif", 1, 0), put("gone.tif", 2, 0), put("same_size.tif", 5, 0)
    for second in (0, 2, 3, 5, 6.5, 10):
        if second == 2:
            put("grows.tif", 4, 2), (inbox / "gone.tif").unlink()
        if second == 3:
            put("same_size.tif", 5, 3), put("gone.tif", 2, 0)
        watch.record_listing(spark, str(inbox), log, start + int(second * 1_000_000))
        if second in (2, 5, 10):
            processed()  # each time from the checkpoint
            assert len(listing_times(log)) <= 3
    watch.record_listing(spark, str(inbox), log, start + 12_000_000)
    processed()
    assert len(listing_times(log)) <= 2
    found = watch.settled_runs(spark.read.parquet(out)).collect()
    assert sorted((r["path"].split("/")[-1], (r["run_start"] - T0).total_seconds(), (r["stable_at"] - T0).total_seconds()) for r in found) == [
        ("calm.tif", 0, 3), ("gone.tif", 3, 6.5), ("grows.tif", 2, 5), ("same_size.tif", 3, 6.5)]


def test_listings_by_trigger(spark, tmp_path):
    import time
    (tmp_path / "inbox").mkdir()
    (tmp_path / "inbox" / "a.tif").write_bytes(b"x")
    query = watch.watch_folder(spark, str(tmp_path / "inbox"), str(tmp_path / "log"), "500 milliseconds")
    try:
        for _ in range(60):
            if len(watch._listings(spark, str(tmp_path / "log"))) > 1:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert len(watch._listings(spark, str(tmp_path / "log"))) > 1


def test_crowded_page(spark):
    """A page with a third of all items: the same cells as in plain Python, and no pair rows on the way."""
    from drawmark.operators import cells, lines
    random.seed(3)
    items = [(0 if i % 3 == 0 else i, i, "YA000001", x, y, x + 50, y + 20) for i in range(6000) for x, y in [(random.randint(0, 900), random.randint(0, 900))]]
    segs = [(p, random.choice("hv"), random.randint(0, 950), 0, 900) for p in range(0, 6000) for _ in range(3)] + [(0, "v", q, 0, 900) for q in range(0, 900, 7)]
    df = spark.createDataFrame(items, "page_id bigint, seq bigint, text string, x1 int, y1 int, x2 int, y2 int")
    facts = lines.page_lines(spark.createDataFrame(segs, "page_id bigint, axis string, pos int, start_px int, end_px int"))
    got = {r["seq"]: r["cell_x2"] for r in cells.enclosing_cells(df, facts).collect()}
    vs = {}
    for p, axis, pos, *_ in segs:
        if axis == "v":
            vs.setdefault(p, set()).add(pos)
    for p, seq, _, x1, _, x2, _ in items:
        right = [v for v in vs.get(p, ()) if v >= (x1 + x2) // 2]
        assert got[seq] == max(min(right), x2) if right else got[seq] == x2
    assert df.filter("page_id = 0").count() >= 2000 and F is not None
