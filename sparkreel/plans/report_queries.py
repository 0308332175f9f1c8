"""Reports, camera quality and order-dependent series."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkreel import lexicon as lx
from sparkreel.operators import dedup, ordered, refine, reports, selection
from sparkreel.plans import inputs
from sparkreel.plans.clip_queries import CHOSEN, GRADED, RAW, clamp_ctes, grade
from sparkreel.plans.registry import query
from sparkreel.session import cut_lineage
from sparkreel.plans.views import VIEWS, with_views

# Frame telemetry: an order is a clip, its line numbers are every third frame.
VIEWS["telemetry"] = ([], """
    SELECT l_orderkey AS clip_id, (l_linenumber - 1) * 3::BIGINT AS frame, bool_and(l_returnflag <> 'R') AS has_face, min(l_quantity) > 5 AS active,
           min(l_suppkey) * 10e0 AS face_cx, min(l_partkey) % 60 AS crop_x, 600::BIGINT AS crop_w,
           CASE WHEN min(l_linestatus) = 'F' THEN 'FREEZE_HOLD' ELSE 'TRACK' END AS state, max(l_discount) > 0.08 AS switched
    FROM lineitem GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY l_orderkey, l_linenumber"))
VIEWS["frames"] = (["telemetry"], """
    SELECT clip_id, f AS frame, floor(crop_x * (1 - t) + nx * t)::BIGINT AS crop_x FROM (
      SELECT clip_id, f, crop_x, coalesce(next_x, crop_x) AS nx, coalesce((f - frame) / (next_frame - frame)::DOUBLE, 0e0) AS t FROM (
        SELECT *, unnest(range(frame, coalesce(next_frame, frame + 1))) AS f FROM (
          SELECT *, lead(frame) OVER w AS next_frame, lead(crop_x) OVER w AS next_x FROM telemetry WINDOW w AS (PARTITION BY clip_id ORDER BY frame))))""")
RUNS = """SELECT clip_id, coalesce(max(n), 0) AS longest_run FROM (SELECT DISTINCT clip_id FROM telemetry) LEFT JOIN (
    SELECT clip_id, count(*) AS n FROM (SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY frame) - row_number() OVER (PARTITION BY clip_id, has_face ORDER BY frame) AS island, has_face
        FROM telemetry) WHERE NOT has_face GROUP BY clip_id, island) USING (clip_id) GROUP BY clip_id"""
MOVES = "SELECT clip_id, sum(abs(coalesce(crop_x - prev, 0))) / count(*)::DOUBLE AS avg_movement FROM (SELECT *, lag(crop_x) OVER (PARTITION BY clip_id ORDER BY frame) AS prev FROM frames) GROUP BY clip_id"
FREEZES = "SELECT clip_id, count(*) FILTER (state LIKE '%FREEZE%' AND coalesce(prev, '') NOT LIKE '%FREEZE%') AS freeze_events FROM (SELECT *, lag(state) OVER (PARTITION BY clip_id ORDER BY frame) AS prev FROM telemetry) GROUP BY clip_id"
QA = """SELECT clip_id, round(vis, 2) AS speaker_visibility_pct, track_switches, round(avg_movement, 2) AS avg_movement_per_frame, longest_run * 3 AS max_face_lost_frames, freeze_events,
        vis >= 90 AND track_switches <= 5 AND avg_movement <= 12 AND longest_run * 3 <= 240 AS qa_passed FROM (
    SELECT clip_id, CASE WHEN count(*) FILTER (active) > 0 THEN count(*) FILTER (active AND face_cx BETWEEN crop_x - 15 AND crop_x + crop_w + 15) / (count(*) FILTER (active))::DOUBLE * 100 ELSE 100e0 END AS vis,
           count(*) FILTER (switched) AS track_switches FROM telemetry GROUP BY clip_id) JOIN runs USING (clip_id) JOIN moves USING (clip_id) JOIN freezes USING (clip_id)"""
QA_CTES = {"runs": RUNS, "moves": MOVES, "freezes": FREEZES, "qa": QA}


def telemetry(spark, sf):
    return inputs.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("clip_id"), ((F.col("l_linenumber") - 1) * 3).cast("bigint").alias("frame")).agg(
        F.bool_and(F.col("l_returnflag") != "R").alias("has_face"), (F.min("l_quantity") > 5).alias("active"), (F.min("l_suppkey") * 10.0).alias("face_cx"),
        (F.min("l_partkey") % 60).alias("crop_x"), F.lit(600).cast("bigint").alias("crop_w"),
        F.when(F.min("l_linestatus") == "F", "FREEZE_HOLD").otherwise("TRACK").alias("state"), (F.max("l_discount") > 0.08).alias("switched"))


@query("interpolate", with_views("SELECT clip_id, frame, crop_x FROM frames", "frames"))
def interpolate(spark, sf):
    return reports.interpolate(telemetry(spark, sf))


@query("longest_run", with_views(RUNS, "telemetry"))
def longest_run(spark, sf):
    samples = telemetry(spark, sf).withColumn("frame", (F.col("frame") / 3).cast("bigint"))
    # Two samples per block, so that runs cross block borders.
    return ordered.longest_run(samples, ~F.col("has_face"), block=2)


@query("movement", with_views("SELECT clip_id, round(avg_movement, 6) AS avg_movement FROM moves", "frames", moves=MOVES))
def movement(spark, sf):
    return reports.movement(reports.interpolate(telemetry(spark, sf))).withColumn("avg_movement", F.round("avg_movement", 6))


@query("freeze_events", with_views(FREEZES, "telemetry"))
def freeze_events(spark, sf):
    return reports.freeze_events(telemetry(spark, sf), block=8)


@query("camera_qa", with_views("SELECT * FROM qa", "frames", **QA_CTES))
def camera_qa(spark, sf):
    return reports.camera_qa(telemetry(spark, sf))


@query("qa_failures", with_views("""SELECT * FROM (SELECT clip_id, concat_ws('; ',
      CASE WHEN speaker_visibility_pct < 90 THEN printf('Speaker Visibility: %.1f%% (failed threshold >= 90%% by %.1f%%)', speaker_visibility_pct, 90 - speaker_visibility_pct) END,
      CASE WHEN track_switches > 5 THEN printf('Track Switches: %d (failed threshold <= 5 by %d)', track_switches, track_switches - 5) END,
      CASE WHEN avg_movement_per_frame > 12 THEN printf('Average Crop Movement: %.2fpx/frame (failed threshold <= 12.0px/frame by %.2fpx/frame)', avg_movement_per_frame, avg_movement_per_frame - 12) END,
      CASE WHEN max_face_lost_frames > 240 THEN printf('Max Consecutive Face Loss: %d frames (failed threshold <= 240 frames by %d frames)', max_face_lost_frames, max_face_lost_frames - 240) END) AS failures FROM qa)
    WHERE failures <> ''""", "frames", **QA_CTES))
def qa_failures(spark, sf):
    return reports.qa_failures(reports.camera_qa(telemetry(spark, sf)))


@query("caption_placement", """SELECT l_suppkey AS clip_id, round(p90, 6) AS p90, CASE WHEN free < 375 THEN 300 WHEN free < 525 THEN 450 ELSE 600 END AS margin_v,
    CASE WHEN free < 375 THEN 'LOW' WHEN free < 525 THEN 'MID' ELSE 'HIGH' END AS face_position FROM (
      SELECT l_suppkey, p90, 1920 - greatest(1350, least(1650, p90 + 80)) AS free FROM (
        SELECT l_suppkey, quantile_cont((l_partkey % 1920)::DOUBLE, 0.9) AS p90 FROM lineitem GROUP BY 1))""")
def caption_placement(spark, sf):
    return reports.caption_placement(inputs.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("clip_id"), (F.col("l_partkey") % 1920).alias("face_bottom"))).withColumn("p90", F.round("p90", 6))


@query("boundary_quality_report", with_views(f"""SELECT video_id, count(*) AS clips, count(*) FILTER (start_clean) AS clean_starts, count(*) FILTER (end_clean) AS clean_ends,
    0::BIGINT AS refined_ends, round(avg({grade('false')}), 4) AS avg_completeness, grouping(video_id)::INTEGER AS is_total FROM graded GROUP BY ROLLUP (video_id)""",
    "candidates", "flags", raw=RAW, **clamp_ctes("raw"), graded=GRADED))
def boundary_quality_report(spark, sf):
    return reports.boundary_quality_report(refine.with_quality(inputs.candidates(spark, sf), inputs.lines(spark, sf), refine=False))


VIEWS["runs_table"] = ([], """SELECT event_id, CASE event_type WHEN 'view' THEN 'cache' WHEN 'click' THEN 'youtube_transcript_api' WHEN 'signup' THEN 'yt_dlp_manual'
    WHEN 'purchase' THEN 'yt_dlp_auto' ELSE 'faster_whisper' END AS source, CASE WHEN value >= 0.5 THEN value END AS duration, event_type IN ('signup', 'purchase', 'error') AS fallback_used, value FROM events""")


def transcript_runs(spark, sf):
    kind = F.col("event_type")
    source = (F.when(kind == "view", "cache").when(kind == "click", "youtube_transcript_api").when(kind == "signup", "yt_dlp_manual")
              .when(kind == "purchase", "yt_dlp_auto").otherwise("faster_whisper"))
    return inputs.table(spark, sf, "events").select("event_id", source.alias("source"), F.when(F.col("value") >= 0.5, F.col("value")).alias("duration"),
                                                    kind.isin("signup", "purchase", "error").alias("fallback_used"), "value")


@query("transcript_summary", with_views("""SELECT sum(n)::BIGINT AS total_runs, sum(f)::BIGINT AS fallback_used_count, round(sum(f) * 100e0 / sum(n), 2) AS fallback_usage_percent,
    round(sum(coalesce(d, 0) * n) / sum(n), 2) AS average_transcription_time, string_agg(source || '=' || n, ',' ORDER BY source) AS sources
    FROM (SELECT source, count(*) AS n, avg(duration) AS d, count(*) FILTER (fallback_used) AS f FROM runs_table GROUP BY source)""", "runs_table"))
def transcript_summary(spark, sf):
    pairs = F.transform(F.map_entries("source_breakdown"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return reports.transcript_summary(transcript_runs(spark, sf)).withColumn("sources", F.array_join(pairs, ",")).drop("source_breakdown")


@query("source_shares", with_views("""SELECT k AS source, coalesce(n, 0) AS runs, coalesce(round(n * 100 / (SELECT count(*) FROM runs_table), 0), 0) AS pct
    FROM unnest(['youtube_transcript_api', 'yt_dlp_manual', 'yt_dlp_auto', 'faster_whisper', 'cache']) t(k)
    LEFT JOIN (SELECT source, count(*) AS n FROM runs_table GROUP BY 1) ON k = source""", "runs_table"))
def source_shares(spark, sf):
    return reports.source_shares(transcript_runs(spark, sf))


@query("last_sync", "SELECT epoch_us(max(ts)) / 1e6 AS last_sync FROM events")
def last_sync(spark, sf):
    return reports.last_sync(inputs.snapshots(spark, sf), inputs.micros(F.col("snapshot_time")) / 1e6)


@query("dashboard_kpis", with_views("SELECT coalesce(sum(views), 0)::BIGINT AS total_views, count(*) AS published_count, coalesce(round(avg(retention), 4), 0) AS avg_retention FROM clips WHERE published", "clips"))
def dashboard_kpis(spark, sf):
    return reports.dashboard_kpis(inputs.clips(spark, sf))


TOP3 = "SELECT * FROM picked QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY virality_score DESC, ord) <= 3"


@query("stage_funnel", with_views("""SELECT stage, clips, round(m, 4) AS mean_score, coalesce(lag(clips) OVER (ORDER BY i) - clips, 0) AS skipped FROM (
    SELECT 0 AS i, 'scout' AS stage, count(*) AS clips, avg(virality_score) AS m FROM candidates UNION ALL SELECT 1, 'curated', count(*), avg(virality_score) FROM picked
    UNION ALL SELECT 2, 'exported', count(*), avg(virality_score) FROM top3)""", "candidates", **CHOSEN, top3=TOP3))
def stage_funnel(spark, sf):
    scout = inputs.candidates(spark, sf)
    # Written, as two stages count it.
    curated = cut_lineage(dedup.dedup_candidates(scout).select("video_id", "ord", "virality_score"))
    return reports.stage_funnel({"scout": scout, "curated": curated, "exported": selection.top_clips(curated, 3)})


AUDIT = """SELECT count(*) AS total_runs, round(100e0 * count(*) FILTER (s = 'Success') / count(*), 4) AS success_rate, round(100e0 * count(*) FILTER (s = 'Failure') / count(*), 4) AS failure_rate,
    round(100e0 * count(*) FILTER (s = 'unavailable') / count(*), 4) AS unavailable_rate, round(100e0 * count(*) FILTER (source NOT IN ('youtube_transcript_api', 'cache')) / count(*), 4) AS fallback_rate,
    round(100e0 * count(*) FILTER (source = 'cache') / count(*), 4) AS cache_rate, round(greatest(0, 100 - 150e0 * count(*) FILTER (s <> 'Success') / count(*)
    - 20e0 * count(*) FILTER (source NOT IN ('youtube_transcript_api', 'cache')) / count(*)), 4) AS readiness
    FROM (SELECT *, CASE WHEN value > 150 THEN 'Failure' WHEN value > 100 THEN 'unavailable' ELSE 'Success' END AS s FROM runs_table {where})"""


def _audit(rows):
    value = F.col("value")
    status = F.when(value > 150, "Failure").when(value > 100, "unavailable").otherwise("Success")
    return reports.audit_rates(rows.select(status.alias("status"), "source", (F.col("source") == "cache").alias("cache_hit")))


@query("audit_rates", with_views(AUDIT.format(where=""), "runs_table"))
def audit_rates(spark, sf):
    return _audit(transcript_runs(spark, sf))


@query("audit_delta", with_views("""SELECT metric, before, after, round(after - before, 4) AS change FROM (UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM b) ON COLUMNS(*) INTO NAME metric VALUE before)
    JOIN (UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM a) ON COLUMNS(*) INTO NAME metric VALUE after) USING (metric)""", "runs_table",
    b=AUDIT.format(where=""), a=AUDIT.format(where="WHERE NOT fallback_used")))
def audit_delta(spark, sf):
    rows = transcript_runs(spark, sf)
    return reports.audit_delta(_audit(rows), _audit(rows.where("NOT fallback_used")))


@query("stage_timings", "SELECT coalesce(event_type, 'total') AS stage, round(sum(value), 4) AS seconds, grouping(event_type)::INTEGER AS is_total FROM events GROUP BY ROLLUP (event_type)")
def stage_timings(spark, sf):
    return reports.stage_timings(inputs.table(spark, sf, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds")))


@query("cache_stats", "SELECT count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type <> 'view') AS misses FROM events")
def cache_stats(spark, sf):
    return reports.cache_stats(inputs.table(spark, sf, "events"), F.col("event_type") == "view")


@query("model_comparison", """SELECT event_type AS model, count(*) AS runs, count(*) FILTER (value > 100) AS failed, round(avg(value), 2) AS elapsed_seconds,
    round(avg(greatest(0, value - 10)), 2) AS memory_used_mb, round(avg(user_id), 2) AS segments FROM events GROUP BY 1""")
def model_comparison(spark, sf):
    return reports.model_comparison(inputs.table(spark, sf, "events").select(
        F.col("event_type").alias("model"), F.when(F.col("value") > 100, "timeout").alias("error"), F.col("value").alias("elapsed"),
        (F.col("value") - 10).alias("memory_mb"), F.col("user_id").alias("segments")))


@query("status_changes", with_views("""SELECT job_id, event_id, status, progress FROM (SELECT *, lag(status) OVER w AS ps, lag(progress) OVER w AS pp, lag(event_id) OVER w AS pe,
      min(CASE WHEN status IN ('completed', 'failed') THEN event_id END) OVER (PARTITION BY job_id) AS stop FROM job_events WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id))
    WHERE (pe IS NULL OR status IS DISTINCT FROM ps OR progress IS DISTINCT FROM pp) AND (stop IS NULL OR event_id <= stop)""", "job_events"))
def status_changes(spark, sf):
    return ordered.status_changes(inputs.job_events(spark, sf)).select("job_id", "event_id", "status", "progress")


@query("growth_curve", with_views("""SELECT clip_id, event_id, views, rank, round((rank - 1) / (n - 1)::DOUBLE, 6) AS x, round((views - low) / (CASE WHEN high = low THEN 1 ELSE high - low END)::DOUBLE, 6) AS y, growth
    FROM (SELECT *, row_number() OVER w AS rank, views - lag(views) OVER w AS growth, count(*) OVER p AS n, min(views) OVER p AS low, greatest(max(views) OVER p, 1) AS high
          FROM snapshots WINDOW w AS (PARTITION BY clip_id ORDER BY snapshot_time, event_id), p AS (PARTITION BY clip_id)) WHERE n >= 2""", "snapshots"))
def growth_curve(spark, sf):
    return ordered.growth_curve(inputs.snapshots(spark, sf)).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@query("evict_plan", """SELECT path, size, through FROM (SELECT *, sum(size) OVER (ORDER BY mtime, md5(path), path)::BIGINT AS through, sum(size) OVER ()::BIGINT AS total
      FROM (SELECT CASE event_type WHEN 'view' THEN event_id || '.json' ELSE event_id || '.mp4' END AS path, epoch_us(ts) / 1e6 AS mtime, floor(value * 1000)::BIGINT AS size FROM events) WHERE path NOT LIKE '%.json')
    WHERE total > 20000000 AND total - (through - size) > 12000000""")
def evict_plan(spark, sf):
    files = inputs.table(spark, sf, "events").select(
        F.concat(F.col("event_id").cast("string"), F.when(F.col("event_type") == "view", ".json").otherwise(".mp4")).alias("path"),
        (inputs.micros(F.col("ts")) / 1e6).alias("mtime"), F.floor(F.col("value") * 1000).alias("size"))
    return ordered.evict_plan(files, limit=20_000_000, target=12_000_000).select("path", "size", "through")
