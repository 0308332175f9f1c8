"""Streams over the event table, run until everything present is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkreel.functions import scoring, text as tx
from sparkreel.plans.registry import query
from sparkreel.plans.statistics_queries import JUDGED, RESULT
from sparkreel.plans.views import with_views
from sparkreel.streaming import feeds


@query("snapshot_stream", "SELECT 'c' || user_id AS clip_id, max(event_id) AS seq, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def snapshot_stream(spark, sf):
    events = feeds.read_stream(spark, sf).select(F.concat(F.lit("c"), "user_id").alias("clip_id"), "ts", F.col("event_id").alias("seq"), "value")
    return feeds.snapshot_stream(events, feeds.work_folder(spark, "snapshots")).select("clip_id", "seq", "value")


@query("daily_window_counts", """SELECT (epoch_us(date_trunc('day', ts)) // 1000000)::BIGINT AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def daily_window_counts(spark, sf):
    return feeds.windowed_counts(feeds.read_stream(spark, sf), feeds.work_folder(spark, "daily")).withColumn("total", F.round("total", 4))


@query("sliding_window_counts", """SELECT w AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total
    FROM (SELECT *, unnest([s // 43200 * 43200, s // 43200 * 43200 - 43200]) AS w FROM (SELECT *, epoch_us(ts) // 1000000 AS s FROM events)) GROUP BY ALL""")
def sliding_window_counts(spark, sf):
    return feeds.windowed_counts(feeds.read_stream(spark, sf), feeds.work_folder(spark, "sliding"), "1 day", "12 hours").withColumn("total", F.round("total", 4))


@query("status_change_stream", with_views("""SELECT job_id, event_id, status, progress FROM (SELECT *, lag(status) OVER w AS ps, lag(progress) OVER w AS pp, lag(event_id) OVER w AS pe,
      min(CASE WHEN status IN ('completed', 'failed') THEN event_id END) OVER (PARTITION BY job_id) AS stop FROM job_events WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id))
    WHERE (pe IS NULL OR status IS DISTINCT FROM ps OR progress IS DISTINCT FROM pp) AND (stop IS NULL OR event_id <= stop)""", "job_events"))
def status_change_stream(spark, sf):
    return feeds.status_change_stream(_job_rows(spark, sf), feeds.work_folder(spark, "status")).select("job_id", "event_id", "status", "progress")


def _job_rows(spark, sf):
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "completed").when(kind == "error", "failed").when(kind == "signup", "queued").otherwise("running")
    return feeds.read_stream(spark, sf).select(F.concat(F.lit("j"), "user_id").alias("job_id"), "event_id", "ts", status.alias("status"),
                                               F.floor(F.col("value") / 25).cast("int").alias("progress"))


@query("status_lives_stream", with_views("""SELECT job_id, event_id, status, progress FROM (
      SELECT *, lag(status) OVER w AS ps, lag(progress) OVER w AS pp, min(CASE WHEN status IN ('completed', 'failed') THEN event_id END) OVER (PARTITION BY job_id, life) AS stop
      FROM (SELECT *, sum(fresh) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS life FROM (
        SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 10800000000 THEN 1 ELSE 0 END AS fresh
        FROM job_events WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id))) WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id))
    WHERE (fresh = 1 OR status IS DISTINCT FROM ps OR progress IS DISTINCT FROM pp) AND (stop IS NULL OR event_id <= stop)""", "job_events"))
def status_lives_stream(spark, sf):
    """As ``status_change_stream``, with jobs forgotten after three hours of silence."""
    return feeds.status_change_stream(_job_rows(spark, sf), feeds.work_folder(spark, "lives"), ttl=10800).select("job_id", "event_id", "status", "progress")


HELD_ROWS = """SELECT job_id AS video_id, job_id || '-' || (epoch_us(ts) // 21600000000) AS job, ts, event_id AS seq, status,
        row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS n FROM job_events"""
MACHINE = """SELECT video_id, 0::BIGINT AS n, NULL::VARCHAR AS holder, NULL::TIMESTAMP AS created, NULL::VARCHAR AS state, NULL::BIGINT AS started, NULL::VARCHAR AS job
        FROM held_rows WHERE n = 1
      UNION ALL
      SELECT video_id, n, CASE WHEN takes THEN job ELSE held END, CASE WHEN takes THEN ts ELSE created END,
        CASE WHEN takes OR job = held THEN status ELSE state END, CASE WHEN takes THEN seq END, job
      FROM (SELECT *, status = 'queued' AND (held IS NULL OR (state = 'failed' AND job <> held)) AS takes FROM (
        SELECT r.video_id, r.n, r.job, r.ts, r.seq, r.status, m.created, m.state, CASE WHEN epoch_us(r.ts) - epoch_us(m.created)
            <= CASE WHEN m.state IN ('completed', 'failed') THEN 3600000000 ELSE 10800000000 END THEN m.holder END AS held
        FROM machine m JOIN held_rows r ON r.video_id = m.video_id AND r.n = m.n + 1))"""


@query("submission_stream", with_views("SELECT video_id, job AS job_id, started AS seq FROM machine WHERE started IS NOT NULL", "job_events",
                                       held_rows=HELD_ROWS, machine=MACHINE))
def submission_stream(spark, sf):
    """A user's events as the jobs of one video: a job lasts six hours of them."""
    rows = _job_rows(spark, sf).select(F.col("job_id").alias("video_id"), F.concat("job_id", F.lit("-"), F.floor(F.unix_micros("ts") / 21_600_000_000)).alias("job_id"),
                                       "ts", F.col("event_id").alias("seq"), "status")
    return feeds.submission_stream(rows, feeds.work_folder(spark, "submissions")).select("video_id", "job_id", "seq")


@query("dedup_stream", "SELECT DISTINCT substr(md5('j' || user_id), 1, 11) AS video_id FROM events")
def dedup_stream(spark, sf):
    url = F.concat(F.lit("https://youtu.be/"), F.substring(F.md5(F.concat(F.lit("j"), "user_id")), 1, 11))
    jobs = feeds.read_stream(spark, sf).select(tx.video_id(url).alias("video_id"), "ts")
    return feeds.dedup_stream(jobs, feeds.work_folder(spark, "dedup")).select("video_id")


@query("cache_metric_stream", """SELECT (epoch_us(date_trunc('day', ts)) // 1000000)::BIGINT AS window_start, count(*) FILTER (event_type = 'view') AS hits,
    count(*) FILTER (event_type <> 'view') AS misses FROM events GROUP BY ALL""")
def cache_metric_stream(spark, sf):
    events = feeds.read_stream(spark, sf).select("ts", (F.col("event_type") == "view").alias("hit"))
    return feeds.cache_metric_stream(events, feeds.work_folder(spark, "cache"))


@query("live_ab", with_views(RESULT, arms="""SELECT 'exp_' || event_type AS experiment_id, CASE WHEN substr(sha256('c' || user_id), 1, 1) < '8' THEN 'A' ELSE 'B' END AS arm, value AS c FROM events""",
                             judged=JUDGED))
def live_ab(spark, sf):
    seen = feeds.read_stream(spark, sf).select(F.concat(F.lit("exp_"), "event_type").alias("experiment_id"),
                                               scoring.arm_of(F.concat(F.lit("c"), "user_id")).alias("arm"), "value")
    return feeds.live_ab(seen, feeds.work_folder(spark, "ab"))
