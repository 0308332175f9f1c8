"""Known results of single rules."""

import pytest
from pyspark.sql import functions as F

from sparkreel.functions import sanitize as sn, scoring, stats, text as tx


def value(spark, column, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return row.select(column.alias("v")).head()[0]


@pytest.mark.parametrize("url,want", [
    ("https://www.youtube.com/watch?v=dQw4w9WgXcQ", "dQw4w9WgXcQ"), ("https://youtu.be/dQw4w9WgXcQ", "dQw4w9WgXcQ"),
    ("https://youtube.com/shorts/dQw4w9WgXcQ", "dQw4w9WgXcQ"), ("https://www.youtube.com/watch?list=a&v=dQw4w9WgXcQ&t=3", "dQw4w9WgXcQ"),
    ("invalid-url", None)])
def test_video_id(spark, url, want):
    assert value(spark, tx.video_id(F.col("u")), u=url) == want


@pytest.mark.parametrize("text,want", [("Why is this happening?", True), ("We spent 10 million dollars", True), ("This is a simple sentence", True), ("we go here", False)])
def test_is_hook(spark, text, want):
    assert value(spark, tx.is_hook(F.col("t")), t=text) is want


@pytest.mark.parametrize("text,changed,score", [
    ("We talk about plain things. Nothing more.", {}, 5.0),
    ("So back in the day we did things.", {"hook_strength": 3.0, "first_3_second_hook": 3.0}, None),
    ("Never do this if you want to win 100%.", {"hook_strength": 7.0, "first_3_second_hook": 6.0}, None),
    ("Why is this the worst fight in history?", {"curiosity_gap": 6.0, "controversy": 6.0}, None)])
def test_adjusted_scores(spark, text, changed, score):
    scores = F.create_map(F.lit("surprise"), F.lit(5.0))
    got = value(spark, scoring.adjusted_scores(F.col("t"), scores), t=text)
    for name, want in changed.items():
        assert got[name] == want
    if score is not None:
        assert value(spark, scoring.virality(scoring.adjusted_scores(F.col("t"), scores)), t=text) == score


@pytest.mark.parametrize("sec,want", [(0.0, "0:00:00.00"), (-3.0, "0:00:00.00"), (3661.239, "1:01:01.24"), (59.999, "0:00:59.99")])
def test_ass_clock(spark, sec, want):
    assert value(spark, tx.format_ass_clock(F.col("s")), s=sec) == want


def test_ass_color(spark):
    assert value(spark, tx.ass_color(F.col("c")), c="#FFD400") == "&H0000D4FF&"
    assert value(spark, tx.ass_color(F.col("c")), c="#FFF") == "&H00FFFFFF&"


@pytest.mark.parametrize("text,want", [("", True), ("[Music] (music)", True), ("one two three four", True), ("loop loop loop loop loop loop loop word", True),
                                       ("this is a proper spoken sentence", False), ("[12] [1.00 - 2.00] ok", True)])
def test_non_verbal(spark, text, want):
    assert value(spark, tx.is_non_verbal(F.col("t")), t=text) is want


def test_word_characters_are_unicode(spark):
    assert value(spark, tx.word_set(F.col("t")), t="Größe_1 the #tag ñandú") == ["größe_1", "ñandú"]


@pytest.mark.parametrize("ys,want", [([2, 4, 6, 8, 10], 1.0), ([10, 8, 6, 4, 2], -1.0), ([7, 7, 7, 7, 7], 0.0), ([3], 0.0)])
def test_pearson(spark, ys, want):
    df = spark.createDataFrame([(float(i + 1), float(y)) for i, y in enumerate(ys)], "x double, y double")
    assert df.agg(stats.pearson(F.col("x"), F.col("y"))).head()[0] == pytest.approx(want)


def test_erf_matches_math(spark):
    import math
    xs = [0.0, 1e-9, 0.1, 0.5, 1.0, 2.5, 4.0, 5.9, 7.0, -1.3]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(stats.erf(F.col("x"))).collect()]
    assert got == pytest.approx([math.erf(x) for x in xs], abs=1e-13)


def test_welch(spark):
    a, b = [10, 11, 12, 10, 11, 12, 10, 11, 12, 11], [1, 2, 3, 1, 2, 3, 1, 2, 3, 2]
    df = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "g string, v double")
    of = lambda g: F.when(F.col("g") == g, F.col("v"))
    t = df.agg(*[f(of(g)).alias(f"{n}{g}") for g in "ab" for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]).select(
        stats.welch(*[F.col(c) for c in ("na", "ma", "va", "nb", "mb", "vb")]).alias("t")).head()[0]
    assert t.t_statistic > 0 and t.p_value < 0.001 and t.confidence_level > 99


def test_iou(spark):
    box = lambda x: {"x": F.lit(float(x)), "y": F.lit(0.0), "w": F.lit(10.0), "h": F.lit(10.0)}
    assert value(spark, stats.box_iou(box(0), box(0))) == 1.0
    assert value(spark, stats.box_iou(box(0), box(50))) == 0.0
    assert 0.28 < value(spark, stats.box_iou(box(0), box(5))) < 0.40


def test_sanitize_emotion(spark):
    got = value(spark, sn.sanitize_emotion(F.col("d")), d='{"emotion": "chaotic", "energy_level": 7}')
    assert (got.emotion, got.energy_level, got.volume_pct) == ("motivational", 7, 8)
    got = value(spark, sn.sanitize_emotion(F.col("d")), d="not json")
    assert (got.emotion, got.energy_level, got.fade_out_secs) == ("motivational", 6, 2.0)


def test_seo_defaults(spark):
    tags = value(spark, sn.seo_tags(F.col("t"), F.lit(None).cast("array<string>")), t="Missing SEO Clip")
    assert tags == ["missing", "clip", "shorts"]
    assert value(spark, sn.seo_title(F.col("t"), F.lit(None)), t="Missing SEO Clip") == "Missing SEO Clip #shorts"


def test_caption_margin_without_face(spark):
    assert tuple(value(spark, sn.caption_margin(F.lit(None).cast("double")))) == (300, "LOW")
