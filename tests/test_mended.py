"""Faults found by review: lost rows, folders as stream inputs, texts that begin with a comma, unbounded reports."""

import random

from pyspark.sql import functions as F

from sparkreel import lexicon as lx
from sparkreel.functions import text as tx
from sparkreel.operators import dedup, joins, ordered, reports, statistics
from sparkreel.operators import subtitles as sb
from sparkreel.operators import scorer, similarity as sim
from sparkreel.sources import logs, markdown, responses
from sparkreel.streaming import feeds


def test_no_clip_is_lost_for_want_of_a_track(spark):
    clips = spark.createDataFrame([("j", 1, "a", "calm"), ("j", 2, "b", "none"), ("j", 3, "c", None)], "job_id string, seq int, clip_id string, category string")
    library = spark.createDataFrame([("calm/1", "calm"), ("d/1", "default"), ("d/2", "default")], "path string, category string")
    assert {r.clip_id: r.track for r in sb.fifo_track_choice(clips, library).collect()} == {"a": "calm/1", "b": "d/1", "c": "d/2"}
    calm = library.filter("category = 'calm'")
    assert {r.clip_id: r.track for r in sb.fifo_track_choice(clips, calm).collect()} == {"a": "calm/1", "b": "calm/1", "c": "calm/1"}
    assert {r.clip_id: r.track for r in sb.fifo_track_choice(clips, library.filter("false")).collect()} == {"a": None, "b": None, "c": None}


def test_tracks_of_the_root_come_before_any(spark):
    clips = spark.createDataFrame([("j", 1, "a", "calm"), ("j", 2, "b", ""), ("j", 3, "c", "loud")], "job_id string, seq int, clip_id string, category string")
    library = spark.createDataFrame([("a/1", "loud"), ("r1", None), ("r2", ""), ("r2", "")], "path string, category string")
    assert {r.clip_id: r.track for r in sb.fifo_track_choice(clips, library).collect()} == {"a": "r1", "b": "r2", "c": "a/1"}
    rest = library.filter("category = 'loud'")
    assert {r.track for r in sb.fifo_track_choice(clips, rest).collect()} == {"a/1"}


def test_a_job_of_very_many_clips_goes_round_its_tracks(spark):
    library = spark.createDataFrame([(f"calm/{k}", "calm") for k in range(9)], "path string, category string")
    clips = spark.range(100_000).selectExpr("'j' AS job_id", "id AS seq", "CAST(id AS STRING) AS clip_id", "'calm' AS category")
    got = sb.fifo_track_choice(clips, library)
    assert got.count() == 100_000
    assert got.selectExpr("CAST(substr(track, 6) AS INT) = CAST(clip_id AS INT) % 6 AS ok").where("NOT ok").count() == 0


def test_a_failed_scorer_leaves_the_title_and_no_text(spark):
    rows = [(1, "Why cats win", "So the secret battle. 5 percent"), (2, "Why cats win", "So the secret battle. 5 percent"), (3, None, "never")]
    df = spark.createDataFrame(rows, "clip_id int, title string, text string")
    own = lambda d: scorer.title_scorer(d).withColumn("detailed_scores", F.when(F.col("clip_id") == 1, F.col("detailed_scores")))
    got = {r.clip_id: r for r in scorer.score_candidates(df, own).collect()}
    assert [got[k].failed for k in (1, 2, 3)] == [False, True, True]
    assert got[1].detailed_scores == got[2].detailed_scores and got[1].virality_score != got[2].virality_score
    assert got[3].detailed_scores == scorer.title_scorer(spark.createDataFrame([("Fallback",)], "title string")).first().detailed_scores


def test_a_report_is_written_as_text(spark, tmp_path):
    df = spark.range(5).selectExpr("id", "id / 2D AS half").repartition(2)
    markdown.write_report(df, str(tmp_path))
    assert sorted(r.line for r in markdown.read_report(spark, str(tmp_path)).collect()) == [f"| {k} | {k / 2:.4f} |" for k in range(5)]
    assert [r.value for r in spark.read.text(f"{tmp_path}/head").collect()] == ["| id | half |", "| --- | --- |"]


def test_clip_of_unknown_arm_stays(spark):
    clips = spark.createDataFrame([(1, "A", {"hook": 2.0}), (2, "Z", {"hook": 2.0}), (3, None, {})], "clip_id int, variant_id string, detailed_scores map<string,double>")
    arms = spark.createDataFrame([("A", {"hook": 0.5})], "variant_id string, weights map<string,double>")
    assert {r.clip_id: r.arm_score for r in statistics.arm_weights(clips, arms).collect()} == {1: 1.0, 2: None, 3: None}


def test_stream_over_a_folder_in_several_batches(spark, sf, tmp_path):
    folder = str(tmp_path / "tables")
    spark.read.parquet(f"{sf}/events.parquet").repartitionByRange(3, "event_id").write.parquet(f"{folder}/events.parquet")

    def newest(where, work, files=None):
        events = feeds.read_stream(spark, where, files=files).select(F.concat(F.lit("c"), "user_id").alias("clip_id"), "ts", F.col("event_id").alias("seq"), "value")
        return {tuple(r) for r in feeds.snapshot_stream(events, str(tmp_path / work)).select("clip_id", "seq", "value").collect()}

    assert newest(folder, "many", files=1) == newest(sf, "one")
    assert len(list((tmp_path / "many" / "current" / "level=0").glob("upto=*"))) == 3


def test_dialogue_text_may_begin_with_a_comma(spark):
    line = "Dialogue: 0,0:00:01.00,0:00:02.50,Default,,0,0,0,,,well, now"
    r = logs.parse_ass_events(spark.createDataFrame([(line,)], "value string")).first()
    assert (r.start, r.end, r.text) == (1.0, 2.5, ",well, now")


def test_nearest_line_over_many_tiles(spark):
    lines = spark.range(20_000).selectExpr("'v' AS video_id", "int(id) AS line_idx", "id * 50.0D AS start", "1.0D AS duration", "'x' AS text")
    times = spark.createDataFrame([("v", k * 7919.0 + 12.0) for k in range(100)], "video_id string, t double")
    points = lines.select("video_id", F.col("start").alias("t"), F.col("line_idx").alias("idx"))
    got = joins._nearest(times, points, "t", "idx").collect()
    assert len(got) == 100 and all(abs(r.idx * 50.0 - r.t) == min(abs(k * 50.0 - r.t) for k in (int(r.t // 50), int(r.t // 50) + 1) if k < 20_000)
                                   for r in got if r.t <= 999_950)


def test_report_lines_have_no_limit(spark):
    report = spark.range(3000).selectExpr("id", "id / 3 AS share", "CAST(NULL AS string) AS note")
    assert markdown.markdown_lines(report).count() == 3000
    assert markdown.markdown_table(report, rows=2).splitlines() == ["| id | share | note |", "| --- | --- | --- |", "| 0 | 0.0000 |  |", "| 1 | 0.3333 |  |"]


def test_nearest_line_gathers_no_list_of_lines(spark):
    """Ties, equal times, NULL times, times at block ends and a crowded stretch, against brute force; no array of a tile's lines."""
    rng = random.Random(9)
    points = [("v", i, rng.choice([round(rng.uniform(0, 9), 1), 4096.0 * rng.randint(0, 3), rng.uniform(-9000, 20000)]), float(rng.randint(0, 3))) for i in range(300)]
    src = spark.createDataFrame(points, "video_id string, line_idx int, start double, duration double")
    asked = [("v", i, rng.choice([None, round(rng.uniform(0, 9), 2), 4096.0 * rng.randint(-2, 5), rng.uniform(-30000, 50000)]), rng.uniform(0, 9)) for i in range(200)]
    got = joins.nearest_line(spark.createDataFrame([*asked, ("w", 1, 0.0, 0.0)], "video_id string, ord int, start_time double, end_time double"), src)
    best = lambda at, times: None if at is None else min((abs(t - at), i) for i, t in times)[1]
    want = {i: (best(a, [(p[1], p[2]) for p in points]), best(b, [(p[1], p[2] + p[3]) for p in points])) for _, i, a, b in asked}
    assert {r.ord: (r.start_index, r.end_index) for r in got.collect()} == want
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_similar_sets_meet_through_two_words(spark):
    """Small, wide and nested sets of a small vocabulary against brute force, at several thresholds."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(90)]
    sets = [rng.sample(vocabulary, rng.choice([1, 2, 3, 5, 8, 40, 60, 64, 65, 80])) for _ in range(150)]
    sets += [s[:max(1, int(len(s) * rng.uniform(0.6, 1)))] for s in sets]
    rows = sim.classes_of(spark.createDataFrame([(s,) for s in sets], "words array<string>"), [], "words")
    known = {r.class_id: set(r.words) for r in rows.collect()}
    for threshold in (0.2, 0.6, 0.85):
        got = {(r.left_id, r.right_id) for r in sim.similar_classes(rows, rows, threshold).collect()}
        assert got == {(a, b) for a, x in known.items() for b, y in known.items() if len(x & y) / len(x | y) > threshold}


def test_chance_meetings_of_titles_grow_no_faster_than_titles(spark):
    """Ten words of a vocabulary of 200: nearly every two titles share one of their five rarest words, few share two of six."""
    rng = random.Random(8)
    rows = sim.classes_of(spark.createDataFrame([([f"w{i}" for i in rng.sample(range(200), 10)],) for _ in range(400)], "words array<string>"), [], "words")
    counts = rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    signs = sim._signatures(rows, counts, [], 0.6).select("class_id", "double", "sign")
    met = signs.join(signs.withColumnRenamed("class_id", "other"), ["double", "sign"]).where("class_id < other").select("class_id", "other").distinct()
    assert met.count() < 0.05 * 400 * 399 / 2


def test_funnel_counts_each_stage_once(spark):
    stages = {name: spark.range(n).selectExpr("id * 1.0D AS virality_score") for name, n in (("a", 9), ("b", 4), ("c", 1))}
    got = reports.stage_funnel(stages)
    assert [(r.stage, r.clips, r.skipped) for r in got.orderBy(F.desc("clips")).collect()] == [("a", 9, 0), ("b", 4, 5), ("c", 1, 3)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 3


def test_nearest_line_far_away_and_without_lines(spark):
    lines = spark.createDataFrame([("v", 0, 0.0), ("v", 1, 1e9), ("v", 2, 1e9 + 5)], "video_id string, idx int, t double")
    asked = [("v", 4e8, 0), ("v", 6e8, 1), ("v", -500.0, 0), ("v", 2e9, 2), ("v", None, None), ("none", 1.0, None)]
    times = spark.createDataFrame([(v, t) for v, t, _ in asked], "video_id string, at double")
    got = sorted(((r.video_id, r.at, r.idx) for r in joins._nearest(times, lines, "at", "idx").collect()), key=str)
    assert got == sorted((a for a in asked if a[0] == "v"), key=str)


def test_filled_neighbours_over_blocks(spark):
    filled = {at: at * 10 for at in range(-40, 200, 7)}
    rows = [("k", at, filled.get(at), filled.get(at)) for at in range(-50, 210)]
    cells = spark.createDataFrame(rows, "k string, at bigint, first bigint, last bigint")
    for r in ordered.filled_neighbours(cells, ["k"], "at", fan=4).collect():
        assert r.before == max((v for at, v in filled.items() if at < r["at"]), default=None)
        assert r.after == min((v for at, v in filled.items() if at > r["at"]), default=None)


def test_pages_of_a_day_with_many_snapshots(spark):
    clips = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "clip_id string, published boolean")
    snaps = spark.range(25).selectExpr("'a' AS clip_id", "timestamp'2024-05-01 10:00:00' + make_interval(0, 0, 0, 0, 0, 0, id DIV 3) AS snapshot_time",
                                       "id AS event_id", "id AS views", "1.0D AS watch_time")
    got = {(r.clip_id, r.page): [s.event_id for s in r.snapshots or []] for r in joins.published_with_snapshots(clips, snaps, rows=10).collect()}
    assert got == {("a", 0): list(range(10)), ("a", 1): list(range(10, 20)), ("a", 2): list(range(20, 25)), ("b", None): []}


def test_replies_are_flagged_in_one_pass(spark):
    replies = spark.createDataFrame([("ok", '[{"title": "A"}]'), ("cut", '[{"title": "B"'), ("no", "sorry"), ("null", None)], "id string, response string")
    flagged = responses.flag_responses(replies)
    assert {r.id: r.quarantined for r in flagged.collect()} == {"ok": False, "cut": False, "no": True, "null": True}
    assert [r.title for r in responses.extract_list(flagged.where("NOT quarantined"), "id").orderBy("id").collect()] == ["B", "A"]
    plan = flagged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("mend_batches") == 1


def test_camera_way_equals_interpolated_frames(spark):
    rows = [("c", f, f % 2 == 0, True, 5, (f * 37) % 101, 50, "FREEZE" if f % 4 == 0 else "TRACK", f % 5 == 0) for f in range(0, 60, 3)]
    rows.append(("one", 0, True, False, 5, 7, 50, "TRACK", False))
    samples = spark.createDataFrame(rows, "clip_id string, frame bigint, has_face boolean, active boolean, face_cx bigint, crop_x bigint, crop_w bigint, state string, switched boolean")
    want = {r.clip_id: round(r.avg_movement, 2) for r in reports.movement(reports.interpolate(samples)).collect()}
    frozen = {r.clip_id: r.freeze_events for r in reports.freeze_events(samples).collect()}
    for block in (4, 1024):
        got = {r.clip_id: r for r in reports.camera_qa(samples, block=block).collect()}
        assert {k: r.avg_movement_per_frame for k, r in got.items()} == want
        assert {k: r.freeze_events for k, r in got.items()} == frozen


def test_line_flags_at_word_borders(spark):
    """Flags by one pattern each equal the plain reading: whole words, any white space around, NULL for NULL."""
    texts = ["", " \t\n", "2nd try", "in 7 days", "_one", "one_", "ONE.", "überone", "oné", "why", "so\nwe", " So, yes", "soon", "and́", "OK?  \n", "x. ",
             "12", "a12 12b", "éand", "...and", "Well", "end! \t", "end!x", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    text = F.col("text")
    got = df.select("i", tx.is_hook(text).alias("hook"), tx.opens_cleanly(text).alias("clean"), tx.is_blank(text).alias("blank"),
                    tx.ends_sentence(text).alias("ends"))
    plain = df.select("i", (F.contains(text, F.lit("?")) | tx.has_number(text) | F.arrays_overlap(
        tx.word_runs(F.lower(text)), tx.words_of(lx.HOOK_WORDS))).alias("hook"),
        (~tx.first_word(text).isin(lx.CONJUNCTIONS + lx.FILLERS)).alias("clean"), (tx.strip(text) == "").alias("blank"),
        tx.strip(text).rlike(r"[.?!]\z").alias("ends"))
    assert got.orderBy("i").collect() == plain.orderBy("i").collect()


def test_derived_neighbours_equal_given_ones(spark):
    rows = spark.range(40).selectExpr("id % 2 AS k", "id DIV 2 AS i", "repeat('x', int(id % 5)) AS t")
    derive = lambda df: df.withColumn("n", F.length("t")).drop("t")
    args = (["k"], F.floor(F.col("i") / 4), ["i"], ["i", "n"])
    lazy = ordered.with_neighbours(rows, *args, derive=derive)
    given = ordered.with_neighbours(derive(rows), *args)
    assert sorted(lazy.collect()) == sorted(given.select(lazy.columns).collect())


def _a_clip(spark):
    lines = spark.createDataFrame([("v", i, "So, here we go. What now 10 million people", i * 3.0, 2.8) for i in range(12)], "video_id string, line_idx int, text string, start double, duration double")
    return spark.createDataFrame([("v", "k", 3.0, 30.0), ("v", "late", 90.0, 99.0)], "video_id string, clip_id string, start_time double, end_time double"), lines


def test_subtitles_by_lines_are_those_by_words(spark):
    clips, lines = _a_clip(spark)
    for kw in ({}, {"safe_mode": True}, {"style": "karaoke"}):
        by_lines, by_words = (sb.render_event_text(sb.subtitle_events(sb.subtitle_chunks(clips, w(lines), **kw))).orderBy("chunk", "active").collect()
                              for w in (sb.word_lines, sb.word_timing))
        assert by_lines == by_words and len(by_lines) > 20


def test_a_dialogue_line_is_rendered_once(spark):
    """A filter on the parsed line was pushed below it, which rendered it again for every use."""
    clips, lines = _a_clip(spark)
    shown = sb.render_event_text(sb.subtitle_events(sb.subtitle_chunks(clips, sb.word_lines(lines), style="classic")))
    plan = logs.parse_ass_events(shown.select("clip_id", "dialogue"), "dialogue")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Default,,0,0,0,,") == 1


def test_drop_reasons_reads_texts_once(spark, monkeypatch):
    """The word sets of every clip were made anew for each use while the groups were named."""
    rows = [("v", i, i * 50.0, i * 50.0 + 40, i * 20, i * 20 + 9, 9.0 - i, f"title {i // 2}", None, f"alpha beta gamma delta word{i // 2}") for i in range(4)]
    clips = spark.createDataFrame(rows, """video_id string, ord int, start_time double, end_time double, start_index int, end_index int, virality_score double,
        title string, shorts_title string, text string""")
    plans, cut = [], dedup.cut_lineage
    monkeypatch.setattr(dedup, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    got = dedup.drop_reasons(clips, clips.where("ord % 2 = 0"))
    assert {(r.ord, r.kept_ord, r.reason) for r in got.collect()} == {(1, 0, "text-level semantic redundancy"), (3, 2, "text-level semantic redundancy")}
    assert "regexp_extract_all" in plans[0] and "regexp_extract_all" not in plans[-1]
