"""Parsers, exports, stage tables, state and subtitles."""

import pytest
from pyspark.sql import functions as F

from sparkreel.operators import joins, state, subtitles as sb
from sparkreel.sources import clips as clip_source, logs, markdown, responses, stages, transcripts

VTT = "WEBVTT\n\nNOTE text\n\n00:00:01.000 --> 00:00:04.500\n<c>Hello</c>   world!\n\n00:00:04.500 --> 00:00:08.250\nSecond\nline\n"
SRT = "1\n00:00:01,200 --> 00:00:03,800\nFirst one\n\n2\n00:00:03,800 --> 00:00:07,100\n42\nNext one\n\n3\n00:00:09,000 --> 00:00:09,000\nshort\n"


def test_read_subtitles(spark, tmp_path):
    (tmp_path / "abc.vtt").write_text(VTT)
    (tmp_path / "def.srt").write_bytes(SRT.replace("\n", "\r\n").encode())
    rows = transcripts.read_subtitles(spark, str(tmp_path)).orderBy("video_id", "line_idx").collect()
    assert [(r.video_id, r.line_idx, r.text, r.start, round(r.duration, 6)) for r in rows] == [
        ("abc", 0, "Hello world!", 1.0, 3.5), ("abc", 1, "Second line", 4.5, 3.75),
        ("def", 0, "First one", 1.2, 2.6), ("def", 1, "Next one", 3.8, 3.3), ("def", 2, "short", 9.0, 0.1)]


def test_transcript_json(spark, tmp_path):
    (tmp_path / "v1.json").write_text('[{"text": "a", "start": 0.0, "duration": 1.5},\n {"text": "b", "start": 1.5, "duration": 2}]')
    rows = transcripts.read_transcript_json(spark, str(tmp_path)).orderBy("line_idx").collect()
    assert [(r.video_id, r.line_idx, r.text, r.duration) for r in rows] == [("v1", 0, "a", 1.5), ("v1", 1, "b", 2.0)]


@pytest.mark.parametrize("reply,titles", [
    ('{"clips": [{"title": "Clip\n1", "start_index": 1,},]}', ["Clip\n1"]), ('{"clips": [{"title": "Clip 1", "start_index": 1', ["Clip 1"]),
    ('Here:\n```json\n[{"title": "A"}, {"title": "B"}]\n```', ["A", "B"]), ('{"n": 1, "found": [{"title": "x"}]}', ["x"]), ('{"clips": [{"title": "cut of', ["cut of"])])
def test_responses(spark, reply, titles):
    good, bad = responses.read_responses(spark.createDataFrame([("r", reply)], "id string, response string"))
    assert [r.title for r in responses.extract_list(good, "id").orderBy("ord").collect()] == titles
    assert bad.count() == 0


def test_hopeless_response_is_quarantined(spark):
    good, bad = responses.read_responses(spark.createDataFrame([("r", "sorry, no")], "id string, response string"))
    assert (good.count(), bad.count()) == (0, 1)


def test_export_csv(spark, tmp_path):
    df = spark.createDataFrame([("c1", 8.5, '{"hook_strength": 9, "surprise": 4}', None, True, False, 1500, 10, None, 1.5, None), ("c2", 1.0, "{bad", "Good", None, None, None, None, None, None, None)],
                               "clip_id string, virality_score double, detailed_scores string, feedback string, creator_selected boolean, creator_rejected boolean, views int, likes int, comments int, watch_time double, retention double")
    clip_source.export_csv(df, str(tmp_path / "out"))
    rows = {r.clip_id: r for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()}
    assert (rows["c1"].hook_strength, rows["c1"].views, rows["c1"].creator_selected, rows["c1"].comments) == ("9.0", "1500", "1", "0")
    assert rows["c2"].surprise in (None, "") and rows["c2"].feedback == "Good" and len(rows["c2"]) == 18


def test_stage_tables(spark, tmp_path):
    path = str(tmp_path / "stages")
    rows = lambda *r: spark.createDataFrame(list(r), "checkpoint_key string, x int")
    stages.save_stage(rows(("v1_a", 1), ("v2_a", 2)), path, "scored")
    stages.save_stage(rows(("v1_a", 5)), path, "scored")
    stages.save_stage(rows(("v1_b", 7)), path, "curated")
    assert sorted(r.x for r in stages.load_stage(spark, path, "scored").collect()) == [2, 5]
    assert stages.clear_stages(spark, path, "v1") == 2
    assert [r.x for r in stages.load_stage(spark, path, "scored").collect()] == [2]


def test_markdown(spark):
    assert markdown.markdown_table(spark.createDataFrame([("a", 1.5)], "k string, v double")) == "| k | v |\n| --- | --- |\n| a | 1.5000 |"


def test_replacing_metadata_resets_metrics(spark):
    meta = spark.createDataFrame([("c1", 1, 1, "t1"), ("c1", 5, 9, "t2"), ("c2", 1, 2, "u")], "clip_id string, ts int, seq int, title string")
    metrics = spark.createDataFrame([("c1", 3, 3, 100), ("c2", 2, 4, 7), ("zz", 2, 5, 9)], "clip_id string, ts int, seq int, views int")
    acts = spark.createDataFrame([("c2", 2, 5, True, None, True), ("c2", 3, 6, False, True, False)], "clip_id string, ts int, seq int, selected boolean, rejected boolean, published boolean")
    fb = spark.createDataFrame([("c1", 6, 7, "Good")], "clip_id string, ts int, seq int, feedback string")
    rows = {r.clip_id: r for r in state.current_clips(meta, metrics, acts, fb).collect()}
    assert set(rows) == {"c1", "c2"}
    assert (rows["c1"].title, rows["c1"].views, rows["c1"].feedback) == ("t2", 0, "Good")
    assert (rows["c2"].views, rows["c2"].selected, rows["c2"].rejected, rows["c2"].published) == (7, False, True, False)


def test_retained(spark):
    jobs = spark.createDataFrame([("a", "completed", 1800), ("b", "completed", 4200), ("c", "processing", 4200), ("d", "processing", 15120)], "id string, status string, age int")
    df = jobs.withColumn("created_at", F.lit(1e6) - F.col("age"))
    assert sorted(r.id for r in state.retained(df, F.lit(1e6)).collect()) == ["a", "c"]


def test_match_channel_orders(spark):
    clips = spark.createDataFrame([("c1", 1, "big secret plan today", "", None), ("c2", 2, "other", "", "x1"), ("c3", 3, "big secret plan today", "", None)],
                                  "clip_id string, ord int, title string, shorts_title string, youtube_video_id string")
    videos = spark.createDataFrame([("x1", "Big Secret plan TODAY"), ("x2", "big secret plan today now"), ("x3", "nothing alike"), ("x4", "")], "id string, title string")
    got = lambda **kw: {r.id: r.clip_id for r in joins.match_channel(videos, clips, **kw).collect()}
    assert got() == {"x1": "c2", "x2": "c1"}
    assert got(table_order=True) == {"x1": "c1", "x2": "c1"}


def test_ass_events(spark):
    line = r"Dialogue: 0,0:00:01.20,0:00:02.50,Default,,0,0,0,,{\c&H0000FFFF&}WOW{\c&H00FFFFFF&} nice 🤖🚀"
    r = logs.parse_ass_events(spark.createDataFrame([(line,), ("Comment: no",)], "value string")).collect()
    assert len(r) == 1 and (r[0].start, r[0].end, r[0].highlight, r[0].emoji, r[0].clean_text) == (1.2, 2.5, "WOW", "🤖🚀", "WOW nice")


def test_dense_subtitles_fall_back_to_classic(spark):
    lines = spark.createDataFrame([("v", i, "a b c d e f g h i j k l", i * 1.0, 1.0) for i in range(10)], "video_id string, line_idx int, text string, start double, duration double")
    clips = spark.createDataFrame([("v", "k", 0.0, 10.0)], "video_id string, clip_id string, start_time double, end_time double")
    m = sb.subtitle_metrics(sb.subtitle_chunks(clips, sb.word_timing(lines))).head()
    assert (m.fallback_used, m.subtitle_style) == (True, "classic") and m.highlight_count > 0 and m.ass_event_count < 120


def test_chunks_keep_order_and_do_not_overlap(spark):
    lines = spark.createDataFrame([("v", i, "So, here we go. What now 10 million people", i * 3.0, 2.8) for i in range(12)], "video_id string, line_idx int, text string, start double, duration double")
    clips = spark.createDataFrame([("v", "k", 3.0, 30.0)], "video_id string, clip_id string, start_time double, end_time double")
    rows = sb.subtitle_chunks(clips, sb.word_timing(lines)).orderBy("chunk").collect()
    assert all(a.chunk_end <= b.chunk_start + 1e-9 for a, b in zip(rows, rows[1:])) and all(len(r.words) <= 4 for r in rows)
    assert all(r.chunk_start < r.chunk_end for r in rows)


def test_tracks_are_not_repeated_soon(spark):
    lib = spark.createDataFrame([(f"calm/{c}.mp3", "calm") for c in "abcdefg"], "path string, category string")
    clips = spark.createDataFrame([("j", i, f"k{i}", "calm") for i in range(9)], "job_id string, seq int, clip_id string, category string")
    got = {r.clip_id: r.track[5] for r in sb.fifo_track_choice(clips, lib).collect()}
    assert "".join(got[f"k{i}"] for i in range(9)) == "abcdefabc"
