"""Refinement, deduplication and joins on small cases, and both ways of every two-way operator."""

import random

import pytest
from pyspark.sql import functions as F

from sparkreel.operators import dedup, joins, ordered, refine, selection, statistics
from sparkreel.plans import inputs

LINES = "video_id string, line_idx int, text string, start double, duration double"
CANDS = "video_id string, ord int, title string, start_index int, end_index int, virality_score double"


def lines(spark, rows, video="v"):
    return spark.createDataFrame([(video, i, t, float(s), float(d)) for i, (t, s, d) in enumerate(rows)], LINES)


def cands(spark, rows, video="v"):
    return spark.createDataFrame([(video, i, f"clip {chr(65 + i)}", s, e, v) for i, (s, e, v) in enumerate(rows)], CANDS)


def bounds(df):
    return [(r.start_index, r.end_index) for r in df.orderBy("ord").collect()]


def test_clamp_pulls_back_to_the_next_line(spark):
    src = lines(spark, [("a.", 0, 15), ("b.", 15, 15), ("c.", 30, 15), ("d.", 43, 15)])
    assert refine.clamp_duration(cands(spark, [(0, 2, 1.0)]), src).head().end_time == 43.0


def test_clamp_grows_and_shrinks(spark):
    src = lines(spark, [(f"line {i}.", 5 * i, 5) for i in range(20)])
    assert bounds(refine.clamp_duration(cands(spark, [(2, 4, 1.0), (0, 15, 1.0)]), src)) == [(2, 9), (0, 10)]


def test_clamp_short_video(spark):
    src = lines(spark, [("a.", 0, 5), ("b.", 5, 5)])
    row = refine.clamp_duration(cands(spark, [(0, 0, 1.0)]), src).head()
    assert (row.start_time, row.end_time) == (0.0, 10.0)


@pytest.mark.parametrize("margin,want", [(0.4, 45.4), (0.8, 45.8)])
def test_clamp_margin(spark, margin, want):
    src = lines(spark, [(f"l{i}.", 5 * i, 5) for i in range(9)] + [("late.", 100, 5)])
    assert refine.clamp_duration(cands(spark, [(0, 8, 1.0)]), src, margin).head().end_time == want


def test_clamp_across_long_gaps(spark):
    src = lines(spark, [("a.", 0, 5), ("b.", 500, 5), ("c.", 1000, 5)])
    rows = refine.clamp_duration(cands(spark, [(0, 0, 1.0), (1, 1, 1.0), (2, 2, 1.0)]), src).orderBy("ord").collect()
    assert [(r.start_index, r.end_index, r.start_time) for r in rows] == [(0, 0, 0.0), (1, 1, 500.0), (1, 1, 500.0)]


def test_refine_moves_to_sentence_borders(spark):
    rows = [("It was a day.", 0, 5), ("Some folks came", 5, 5), ("and they sat down", 10, 5), ("why not go home", 15, 5), ("we sat", 20, 5), ("until late.", 25, 5)]
    assert bounds(refine.refine_boundaries(cands(spark, [(2, 3, 1.0), (3, 4, 1.0)]), lines(spark, rows))) == [(1, 5), (3, 5)]


def test_nearest_line(spark):
    src = lines(spark, [("x", 5 * i, 5) for i in range(30)])
    timed = spark.createDataFrame([("v", 0, 10.0, 50.0)], "video_id string, ord int, start_time double, end_time double")
    assert bounds(joins.nearest_line(timed, src)) == [(2, 9)]


@pytest.mark.parametrize("limit", [1024, 2])
def test_dedup_candidates(spark, limit):
    kept = dedup.dedup_candidates(cands(spark, [(2, 8, 9.0), (3, 9, 8.0), (15, 22, 9.5), (16, 23, 7.0), (30, 35, 8.5)]), limit)
    assert sorted(r.title[-1] for r in kept.collect()) == ["A", "C", "E"]


def test_blocks_of_any_size_equal_plain_greedy(spark):
    rng = random.Random(7)
    rows = []
    for video, n in (("a", 300), ("b", 40), ("c", 1)):
        for i in range(n):
            s = rng.randrange(400)
            rows.append((video, i, "t", s, s + rng.randrange(1, 40), float(rng.randrange(5))))
    df = spark.createDataFrame(rows, CANDS)
    want = set()
    for video in "abc":
        kept = []
        for r in sorted((r for r in rows if r[0] == video), key=lambda r: (-r[5], r[1])):
            if not any(k[3] <= r[4] and k[4] >= r[3] for k in kept):
                kept.append(r)
        want |= {(r[0], r[1]) for r in kept}
    for limit in (1024, 100, 8):
        assert {(r.video_id, r.ord) for r in dedup.dedup_candidates(df, limit).collect()} == want


def full_clips(spark, rows):
    """rows: (ord, start, end, title, text, score)."""
    return spark.createDataFrame([("v", o, float(s), float(e), int(s // 2), int(e // 2), t, f"{t} #shorts", x, sc) for o, s, e, t, x, sc in rows],
                                 "video_id string, ord int, start_time double, end_time double, start_index int, end_index int, title string, shorts_title string, text string, virality_score double")


@pytest.mark.parametrize("limit", [1024, 2])
def test_dedup_clips_by_hook_and_text(spark, limit):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(0, 0, 40, "secret plan works well now", words, 9.0), (1, 100, 140, "secret plan works well now", "other text here entirely", 8.0),
            (2, 200, 240, "different headline about cats", words + " lambda", 7.0), (3, 300, 340, "unrelated dogs story", "nothing in common", 6.0),
            (4, 30, 70, "overlapping in time", "some words", 5.0), (5, 400, 440, "the a an", "is are", 4.0), (6, 500, 540, "the of", "was", 3.0)]
    kept = {r.ord for r in dedup.dedup_clips(full_clips(spark, rows), limit).collect()}
    assert kept == {0, 3, 5, 6}
    reasons = {r.ord: r.reason for r in dedup.drop_reasons(full_clips(spark, rows), dedup.dedup_clips(full_clips(spark, rows), limit)).collect()}
    assert reasons == {1: "hook concept redundancy", 2: "text-level semantic redundancy", 4: "temporal overlap"}


def test_dedup_clips_in_blocks_equal_one_fold_on_random_clips(spark):
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(14)]
    rows = []
    for i in range(120):
        s = rng.randrange(0, 3000)
        rows.append((i, s, s + rng.randrange(20, 60), " ".join(rng.sample(pool, 4)), " ".join(rng.sample(pool, 9)), float(rng.randrange(4))))
    df = full_clips(spark, rows)
    fold, blocks = ({r.ord for r in dedup.dedup_clips(df, limit).collect()} for limit in (1024, 16))
    assert fold == blocks and 0 < len(fold) < 120


def test_a_chain_of_clips_of_equal_score(spark):
    """Every clip overlaps the next one only, so each decision depends on the one before; blocks carry them on, not single clips."""
    n = 6000
    df = cands(spark, [(2 * i, 2 * i + 2, 5.0) for i in range(n)])
    kept = sorted(r.ord for r in dedup.dedup_candidates(df, 2048).collect())
    assert kept == list(range(0, n, 2))


def test_many_clips_of_nearly_the_same_text(spark):
    """Whatever block they are in, clips that resemble one kept clip meet it through their rarest words, not each other."""
    words = [f"word{k}" for k in range(40)]
    rows = [(i, 100 * i, 100 * i + 40, f"headline{i} number{i} of{i}", " ".join([*words, f"own{i}"]), 5.0) for i in range(600)]
    assert [r.ord for r in dedup.dedup_clips(full_clips(spark, rows), 256).collect()] == [0]


def test_finished_clips_never_overlap(spark, sf):
    src = inputs.lines(spark, sf)
    kept = refine.validate_clips(dedup.dedup_candidates(inputs.candidates(spark, sf)), src)
    counts = joins.overlap_counts(kept.select("video_id", "ord", "start_time", "end_time"))
    assert counts.where("overlaps > 0").count() == 0
    assert kept.where("end_time - start_time > 58.0 + 1e-6").count() == 0


def test_sweep_of_overlapping_candidates(spark):
    src = lines(spark, [(f"word{i} talk{i * 7 % 31} here{i * 13 % 97}.", 2.5 * i, 2.5) for i in range(720)])
    df = cands(spark, [(i * 17 % 700, i * 17 % 700 + 16, float(i % 9 + 1)) for i in range(40)])
    kept = refine.validate_clips(df, src)
    assert joins.overlap_counts(kept.select("video_id", "ord", "start_time", "end_time")).where("overlaps > 0").count() == 0


def test_even_sample(spark):
    df = cands(spark, [(i, i + 1, 1.0) for i in range(100)])
    assert sorted(r.ord for r in selection.even_sample(df, 3).collect()) == [0, 20, 40, 59, 79, 99]


def test_experiment_guardrails(spark):
    cols = "experiment_id string, variant_id string, views double, retention double, shares double"
    def table(n):
        return spark.createDataFrame([("", v, 100.0 + i + (500 if v == "B" else 0), 50.0 + i % 3 + (30 if v == "B" else 0), 1.0 + (5 if v == "B" else 0))
                                      for v in "AB" for i in range(n)], cols)
    few, many = statistics.ab_test(table(5)).head(), statistics.ab_test(table(35)).head()
    assert (few.current_leader, few.winner, few.thresholds_met) == ("B", None, False)
    assert (many.winner, many.thresholds_met) == ("B", True)
    one = statistics.ab_test(table(1)).head()
    assert (one.current_leader, one.winner, one.thresholds_met, one.p_value) == (None, None, False, 1.0)


def test_neighbours_do_not_depend_on_blocks(spark, sf):
    jobs = inputs.job_events(spark, sf)
    def near(block):
        rows = ordered.with_neighbours(jobs, ["job_id"], block, ["ts", "event_id"], ["event_id"])
        return {(r.event_id, r.prev and r.prev.event_id, r.next and r.next.event_id) for r in rows.collect()}
    assert near(F.lit(0)) == near(F.to_date("ts")) == near(F.date_trunc("minute", "ts"))


def test_longest_run_across_blocks(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for clip in range(40):
        flags = [rng.random() < 0.7 for _ in range(rng.randrange(1, 60))]
        best = run = 0
        for f in flags:
            run = run + 1 if f else 0
            best = max(best, run)
        want[clip] = best
        rows += [(clip, i, f) for i, f in enumerate(flags)]
    df = spark.createDataFrame(rows, "clip_id int, frame int, lost boolean")
    for block in (1, 2, 7, 1024):
        got = {r.clip_id: r.longest_run for r in ordered.longest_run(df, F.col("lost"), block).collect()}
        assert got == want


def test_evict_plan_with_equal_times(spark):
    files = spark.createDataFrame([(f"f{i}.mp4", float(i // 4), 10) for i in range(20)] + [("m.json", 0.0, 999)], "path string, mtime double, size int")
    plan = ordered.evict_plan(files, limit=150, target=100)
    assert plan.count() == 10 and plan.agg(F.max("mtime")).head()[0] == 2.0
    assert ordered.evict_plan(files, limit=200, target=100).count() == 0
