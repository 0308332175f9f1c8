"""Streams over several micro-batches and restarts against one pass over all rows."""

import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from sparkreel.operators import ordered, state
from sparkreel.streaming import feeds
from sparkreel.streaming.keyed_state import KeyedState

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
JOBS = "job_id string, event_id bigint, ts timestamp, status string, progress int"
SUBMISSIONS = "video_id string, job_id string, ts timestamp, seq bigint, status string"


def job_rows(n, seed=3):
    rng, rows, at = random.Random(seed), [], 0.0
    for k in range(n):
        at += rng.choice([1, 30, 400, 3000])
        job = rng.choice(["a", "b", "c", "d", f"once{k}"])
        rows.append((job, k, START + dt.timedelta(seconds=at), rng.choice(["queued", "running", "running", "completed", "failed"]), rng.choice([0, 10, None])))
    return rows


def in_parts(spark, rows, schema, folder, parts):
    """Part files that a file stream takes one by one, in the order they were written."""
    size = -(-len(rows) // parts)
    for k in range(parts):
        target = f"{folder}/batch{k}"
        spark.createDataFrame(rows[k * size:(k + 1) * size], schema).coalesce(1).write.parquet(target)
        part, = glob.glob(f"{target}/part-*.parquet")
        os.makedirs(f"{folder}/in", exist_ok=True)
        os.rename(part, f"{folder}/in/{k}.parquet")
        os.utime(f"{folder}/in/{k}.parquet", (1_700_000_000 + 60 * k,) * 2)
    return lambda upto=None: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option(
        "pathGlobFilter", "*.parquet" if upto is None else f"[0-{upto}].parquet").parquet(f"{folder}/in")


def size_of(path):
    return sum(os.path.getsize(f) for f in glob.glob(f"{path}/part-*.parquet"))


@pytest.mark.parametrize("ttl", [None, 1800])
def test_status_changes_over_batches_with_a_restart(spark, tmp_path, ttl):
    rows = job_rows(300)
    stream = in_parts(spark, rows, JOBS, str(tmp_path), 5)
    work = f"{tmp_path}/work"
    feeds.status_change_stream(stream(upto=2), work, ttl=ttl)
    got = feeds.status_change_stream(stream(), work, ttl=ttl)
    want = ordered.status_changes(spark.createDataFrame(rows, JOBS), ttl=ttl)
    ids = lambda df: sorted(r.event_id for r in df.select("event_id").collect())
    assert ids(got) == ids(want)
    # The batch operator against a plain loop.
    plain, last, ended = [], {}, {}
    for job, k, ts, status, progress in rows:
        before = last.get(job)
        fresh = before is None or (ttl is not None and (ts - before[0]).total_seconds() > ttl)
        if fresh:
            ended[job] = False
        if not ended[job] and (fresh or before[1:] != (status, progress)):
            plain.append(k)
        ended[job] |= status in ("completed", "failed")
        last[job] = ts, status, progress
    assert ids(want) == plain and len(plain) > 50


def test_ended_jobs_leave_the_state_and_batches_write_their_own_keys(spark, tmp_path):
    rows = [(f"j{k}", k, START + dt.timedelta(minutes=10 * k), "completed", 1) for k in range(16)]
    stream = in_parts(spark, rows, JOBS, str(tmp_path), 8)
    work = f"{tmp_path}/work"
    feeds.status_change_stream(stream(), work, ttl=1800)
    held = KeyedState(spark, f"{work}/state", ["job_id"], f"{JOBS}, ended boolean")
    assert held.files(8) == [f"{work}/state/level=1/upto=7"]
    assert {r.job_id for r in held.before(8).collect()} == {"j12", "j13", "j14", "j15"}
    assert [spark.read.parquet(f"{work}/state/level=0/upto={n}").count() for n in range(8)] == [2] * 8


def plain_holding(rows, finished=3600, running=10800):
    held, out = {}, []
    for video, job, ts, seq, status in rows:
        holder = held.get(video)
        if holder and (ts - holder[1]).total_seconds() > (finished if holder[2] in ("completed", "failed") else running):
            holder = held.pop(video) and None
        if status == "queued" and (holder is None or (holder[2] == "failed" and holder[0] != job)):
            held[video] = [job, ts, status]
            out.append(seq)
        elif holder and holder[0] == job:
            holder[2] = status
    return out


def test_submissions_over_batches(spark, tmp_path):
    rng, rows, at = random.Random(9), [], 0.0
    for k in range(400):
        at += rng.choice([5, 60, 900])
        video = rng.choice(["v1", "v2", "v3", f"w{k % 20}"])
        rows.append((video, f"{video}-{rng.randint(0, 3)}", START + dt.timedelta(seconds=at), k, rng.choice(["queued", "queued", "running", "completed", "failed"])))
    want = plain_holding(rows)
    started, _ = state.hold_submissions(spark.createDataFrame(rows, SUBMISSIONS))
    assert sorted(r.seq for r in started.collect()) == want
    stream = in_parts(spark, rows, SUBMISSIONS, str(tmp_path), 5)
    feeds.submission_stream(stream(upto=1), f"{tmp_path}/work")
    got = feeds.submission_stream(stream(), f"{tmp_path}/work")
    assert sorted(r.seq for r in got.collect()) == want and 10 < len(want) < 200


def test_a_failed_job_frees_its_video_and_time_does(spark):
    at = lambda s: START + dt.timedelta(seconds=s)
    rows = [("v", "1", at(0), 0, "queued"), ("v", "2", at(10), 1, "queued"), ("v", "1", at(20), 2, "failed"), ("v", "3", at(30), 3, "queued"),
            ("v", "3", at(40), 4, "completed"), ("v", "4", at(3630), 5, "queued"), ("v", "5", at(3631), 6, "queued"), ("v", "6", at(3631 + 10801), 7, "queued"),
            (None, "x", at(0), 8, "queued")]
    started, held = state.hold_submissions(spark.createDataFrame(rows, SUBMISSIONS))
    assert sorted(r.seq for r in started.collect()) == [0, 3, 6, 7] and [(r.video_id, r.holder) for r in held.collect()] == [("v", "6")]
    empty, none = state.hold_submissions(spark.createDataFrame([], SUBMISSIONS))
    assert empty.count() == 0 == none.count()


def test_snapshot_batches_write_no_more_as_the_stream_ages(spark, tmp_path):
    rows = [(f"c{k}", START + dt.timedelta(minutes=k), k, float(k)) for k in range(160)] + [("c0", START + dt.timedelta(days=1), 500, 1.0)]
    schema = "clip_id string, ts timestamp, seq bigint, value double"
    stream = in_parts(spark, rows, schema, str(tmp_path), 7)
    work = f"{tmp_path}/work"
    got = {r.clip_id: r.seq for r in feeds.snapshot_stream(stream(), work).collect()}
    assert got == {f"c{k}": k for k in range(1, 160)} | {"c0": 500}
    sizes = [size_of(f"{work}/current/level=0/upto={n}") for n in range(7)]
    assert max(sizes) < 2 * min(sizes)


def test_state_files_merge_by_levels(spark, tmp_path):
    held = KeyedState(spark, str(tmp_path), ["k"], "k int, v int", fan=3)
    for n in range(20):
        held.put(n, spark.createDataFrame([(n % 7, n)], "k int, v int"))
        want = {k: max(m for m in range(n + 1) if m % 7 == k) for k in range(min(n + 1, 7))}
        assert {r.k: r.v for r in held.before(n + 1).collect()} == want
    assert held.files(20) == [f"{tmp_path}/level=0/upto=19", f"{tmp_path}/level=0/upto=18", f"{tmp_path}/level=2/upto=17", f"{tmp_path}/level=2/upto=8"]
    assert not os.path.exists(f"{tmp_path}/level=0/upto=0") and held.before(0).count() == 0
    assert held.before(20).where(F.col("k") == 6).first().v == 13
