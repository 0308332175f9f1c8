"""What may not grow: shuffled bytes, scans and repeated work of the clip queries."""

import re

from pyspark.sql import functions as F

from sparkreel.functions import text as tx
from sparkreel.operators import dedup, joins, subtitles as sb
from sparkreel.plans import inputs


def _exchanged(df):
    """The columns of every shuffle and the plan's node for it."""
    spark = df.sparkSession
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\n]*)\]\nArguments: (.*)", plan)


def _transcript(spark, n=40):
    rows = [("v", i, f"So, line {i} goes here. What now 10 million", i * 3.0, 2.8 if i % 3 else 4.0) for i in range(n)]
    lines = spark.createDataFrame(rows + [("v", n, " \t", n * 3.0, 2.0)], "video_id string, line_idx int, text string, start double, duration double")
    clips = [("v", f"k{i}", i * 7.0, i * 7.0 + 20.0) for i in range(18)] + [("v", "k1", 7.0, 27.0), ("v", None, 7.0, 27.0), ("v", "late", 900.0, 909.0), (None, "none", 0.0, 9.0)]
    return spark.createDataFrame(clips, "video_id string, clip_id string, start_time double, end_time double"), lines


def test_chunks_of_clips_across_blocks_of_lines(spark, monkeypatch):
    monkeypatch.setattr(sb, "BLOCK_LINES", 4)
    clips, lines = _transcript(spark)
    for kw in ({}, {"safe_mode": True}):
        by_lines, by_words = (sorted(sb.subtitle_chunks(clips, w(lines), **kw).collect(), key=str) for w in (sb.word_lines, sb.word_timing))
        assert by_lines == by_words and len({r.clip_id for r in by_lines}) == 18 + 1


def test_lines_are_shuffled_once_and_as_text(spark):
    """The words of every line travelled three times, as arrays."""
    clips, lines = _transcript(spark)
    found = _exchanged(sb.subtitle_chunks(clips, sb.word_lines(lines)))
    carried = [(columns, how) for columns, how in found if re.search(r"\b(ws|text|joined)#", columns)]
    assert carried and all("ws#" not in columns and "_tile" not in how for columns, how in carried)


def test_lines_of_odd_blanks(spark, tmp_path):
    texts = [" a  b\tc\n", "", None, "   ", "x", "one two three four five six seven eight nine", "a\x0b\x0c b \r\n c d e f g h i  l  ", "\u0085 z", " \t"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.video_id, r.line_idx): r.text for r in inputs.lines(spark, str(tmp_path)).collect()}
    words = {f"v{i}": re.split("[ \t\n\r\f\x0B]+", t.strip(" \t\n\r\f\x0B")) for i, t in enumerate(texts) if t and t.strip(" \t\n\r\f\x0B")}
    assert got == {(v, i): " ".join(w[i * 8:i * 8 + 8]) for v, w in words.items() for i in range(-(-len(w) // 8))}
    row = spark.range(1).select(F.trim(tx.spaced(F.lit(" a \t b\n"))).alias("t")).first()
    assert row.t == "a b"


def test_texts_do_not_travel_to_their_clips(spark, monkeypatch):
    """Every clip's lines were shuffled to it: twelve times the text."""
    monkeypatch.setattr(joins, "TEXT_TILE", 16)
    monkeypatch.setattr(joins, "TEXT_TILES", 2)
    n = 200
    text = lambda i: f"line {i}"
    lines = [("v", i, text(i)) for i in range(n)] + [("gap", i, text(i)) for i in range(0, 90, 7)] + [("two", i, text(i)) for i in range(30) for _ in range(2)]
    lines = spark.createDataFrame(lines + [(None, 0, "x"), ("v", None, "x")], "video_id string, line_idx int, text string")
    spans = [(v, i, i * 3, i * 3 + d) for v in ("v", "gap") for i, d in enumerate([4, 0, 20, 31, 60, 3, 2, 150, 9, -2, 30, 31, 32, 33, 400])]
    spans += [("two", 0, 2, 20), ("two", 1, 0, 3), ("two", 1, 0, 3), ("two", 1, 25, 99), ("v", 99, -5, 2), ("v", 98, -5, -1), ("v", 97, 400, 410), ("gap", 96, 85, 95),
              (None, 1, 0, 5), ("v", None, 0, 5), ("none", 1, 0, 5), ("v", 90, None, 5), ("v", 91, 5, None)]
    clips = spark.createDataFrame(spans, "video_id string, ord int, start_index int, end_index int")
    got = joins.clip_text(clips, lines)
    low = F.col("start_index").alias("low"), F.col("end_index").alias("high")
    gathered = joins.lines_between(clips.select("video_id", "ord", *low), lines, ["ord"]).select(
        "video_id", "ord", F.array_join(F.transform("lines", lambda c: c["text"]), " ").alias("text"))
    want = clips.join(gathered, ["video_id", "ord"], "left").select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.columns == [*clips.columns, "text"]
    assert not any("cells#" in columns and "lines#" in columns for columns, _ in _exchanged(got))
    dealt = [how for columns, how in _exchanged(joins.clip_text(clips.where("ord < 3"), lines)) if re.search(r"\btext#", columns)]
    assert dealt and all("hashpartitioning(video_id" in how and "coarse" in how or "block" in how for how in dealt)


def test_clips_are_read_once_for_their_silences(spark):
    """Clips, however costly, were worked out twice: for their silences and for the rows."""
    clips = [("v", 0, 0.0, 40.0), ("v", 1, 0.0, 47.9), ("v", 2, 30.0, 40.0), ("v", 3, 0.0, 100.0), ("v", 4, 0.0, 41.0), ("v", 4, 0.0, 40.6), ("v", None, 0.0, 40.0),
             (None, 0, 0.0, 40.0), ("v", 5, 0.0, None), ("v", 6, None, 40.0), ("v", 7, 45.0, 40.0)]
    clips = spark.createDataFrame(clips, "video_id string, ord int, start_time double, end_time double").withColumn("end_time", F.round("end_time", 7))
    quiet = spark.createDataFrame([("v", t) for t in (39.5, 39.5, 40.5, 49.0, 97.5, 95.0)] + [("w", 40.0), ("v", None)], "video_id string, t double")
    out = joins.snap_to_silence(clips, quiet)
    got = sorted(((r.video_id, r.ord, r.end_time, r.audio_refined) for r in out.collect()), key=str)
    assert got == sorted([("v", 0, 39.5, True), ("v", 1, 49.0, True), ("v", 2, 40.0, False), ("v", 3, 100.0, False), ("v", 4, 40.5, True), ("v", 4, 40.5, True),
                          ("v", None, 40.0, False), (None, 0, 40.0, False), ("v", 5, None, False), ("v", 6, 40.0, False), ("v", 7, 40.0, False)], key=str)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("round(end_time") == 1


def test_reasons_from_nodes_staged_once(spark, monkeypatch):
    """Clips were staged twice, their word sets twice and once more with the names of their groups."""
    rows = [("v", i, i * 50.0, i * 50.0 + 40, i * 20, i * 20 + 9, 9.0 - i % 7, f"title {i // 2}", None, f"alpha beta gamma delta word{i // 2}") for i in range(24)]
    rows += [("v", 24, 10.0, 60.0, 900, 905, 1.0, "other", None, "something else"), (None, 0, 0.0, 9.0, 0, 3, 1.0, "a", None, "b")]
    clips = spark.createDataFrame(rows, """video_id string, ord int, start_time double, end_time double, start_index int, end_index int, virality_score double,
        title string, shorts_title string, text string""")
    plain = dedup.drop_reasons(clips, dedup.dedup_clips(clips, 8)).collect()
    plans, cut = [], dedup.cut_lineage
    nodes = cut(dedup.clip_nodes(clips))
    monkeypatch.setattr(dedup, "cut_lineage", lambda df: plans.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString())) or cut(df))
    ids = nodes.select("video_id", "ord")
    assert sorted(dedup.drop_reasons(ids, dedup.dedup_clips(ids, 1024, nodes), nodes).collect()) == sorted(plain) and len(plain) >= 12
    assert all("words" not in columns and "regexp_extract_all" not in plan for columns, plan in plans)
