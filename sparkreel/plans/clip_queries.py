"""Candidate clips: joins with transcript lines, refinement, deduplication, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkreel.functions import text as tx
from sparkreel.operators import dedup, joins, refine, selection
from sparkreel.plans import inputs
from sparkreel.session import cut_lineage
from sparkreel.plans.registry import query
from sparkreel.plans.views import VIEWS, ends_sentence, is_hook, jaccard, opens_cleanly, strip, with_views, word_runs, word_set

VIEWS["flags"] = (["lines"], f"""
    SELECT *, lag(start) OVER w AS prev_start, lead(fin) OVER w AS next_fin, lead(start) OVER w AS next_start,
           coalesce(lag(ends) OVER w, true) AS prev_ends, count(*) OVER (PARTITION BY video_id) AS n,
           last_value(fin) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS video_end
    FROM (SELECT video_id, line_idx AS idx, start, start + duration AS fin, {is_hook('text')} AS hook,
                 NOT {opens_cleanly('text')} AS bad, {strip('text')} = '' AS blank, {ends_sentence('text')} AS ends FROM lines)
    WINDOW w AS (PARTITION BY video_id ORDER BY idx)""")


def refine_ctes(source: str) -> dict[str, str]:
    """CTEs r0..r4: boundary refinement of ``source``; the result is r4(s, e)."""
    return {
        "r0": f"""SELECT c.* EXCLUDE (start_index, end_index), fs.hook AS locked, fs.n, fs.video_end, c.s, c.e, fe.fin AS end_at
            FROM (SELECT c.*, start_index AS s, greatest(start_index, least(end_index, n - 1)) AS e
                  FROM {source} c JOIN (SELECT DISTINCT video_id, n FROM flags) USING (video_id)) c
            JOIN flags fs ON fs.video_id = c.video_id AND fs.idx = c.s JOIN flags fe ON fe.video_id = c.video_id AND fe.idx = c.e""",
        "r1": """SELECT *, CASE WHEN locked THEN s ELSE coalesce((SELECT max(idx) FROM flags f WHERE f.video_id = r0.video_id
            AND f.idx < r0.s AND (f.blank OR f.ends OR r0.end_at - f.start > 58)) + 1, 0) END AS s1 FROM r0""",
        "r2": """SELECT *, CASE WHEN locked THEN s ELSE s1 - coalesce((SELECT min(s1 - idx) FROM flags f WHERE f.video_id = r1.video_id
            AND f.idx BETWEEN r1.s1 - 4 AND r1.s1 AND NOT (idx > 0 AND bad AND r1.end_at - f.prev_start <= 58)), 5) END AS s2 FROM r1""",
        "r3": """SELECT r2.*, CASE WHEN locked OR f0.hook THEN s2 ELSE coalesce((SELECT min(idx) FROM flags f WHERE f.video_id = r2.video_id
            AND f.idx BETWEEN r2.s2 + 1 AND r2.s2 + 3 AND f.idx < r2.e AND f.hook AND NOT f.bad AND r2.end_at - f.start >= 38), s2) END AS s3
            FROM r2 JOIN flags f0 ON f0.video_id = r2.video_id AND f0.idx = r2.s2""",
        "r4": """SELECT r3.* EXCLUDE (s, e, s1, s2, s3), s3 AS s, e + coalesce((SELECT min(idx - r3.e) FROM flags f
            WHERE f.video_id = r3.video_id AND f.idx BETWEEN r3.e AND r3.e + 5
            AND NOT coalesce(f.idx < f.n - 1 AND NOT f.blank AND NOT f.ends AND f.next_fin - f3.start <= 58, false)), 6) AS e
            FROM r3 JOIN flags f3 ON f3.video_id = r3.video_id AND f3.idx = r3.s3""",
    }


def clamp_ctes(source: str) -> dict[str, str]:
    """CTEs k1..k5: duration limits on ``source``(s, e, n, video_end); the result is k5."""
    stop = lambda a: f"least({a}.fin + 0.4e0, c.video_end)"
    return {
        "k1": f"""SELECT c.* EXCLUDE (e), CASE WHEN {stop('fe')} - fs.start >= 38 THEN c.e ELSE coalesce((SELECT min(idx) FROM flags f
            WHERE f.video_id = c.video_id AND f.idx >= c.e AND {stop('f')} - fs.start >= 38), c.n - 1) END AS e
            FROM {source} c JOIN flags fs ON fs.video_id = c.video_id AND fs.idx = c.s JOIN flags fe ON fe.video_id = c.video_id AND fe.idx = c.e""",
        "k2": f"""SELECT c.* EXCLUDE (s), CASE WHEN {stop('fe')} - fs.start >= 38 THEN c.s ELSE coalesce((SELECT max(idx) FROM flags f
            WHERE f.video_id = c.video_id AND f.idx <= c.s AND {stop('fe')} - f.start >= 38), 0) END AS s
            FROM k1 c JOIN flags fs ON fs.video_id = c.video_id AND fs.idx = c.s JOIN flags fe ON fe.video_id = c.video_id AND fe.idx = c.e""",
        "k3": f"""SELECT c.* EXCLUDE (e), fs.start AS begin, CASE WHEN {stop('fe')} - fs.start <= 58 THEN c.e ELSE coalesce((SELECT max(idx)
            FROM flags f WHERE f.video_id = c.video_id AND f.idx >= c.s AND f.idx < c.e AND {stop('f')} - fs.start <= 58), c.s) END AS e
            FROM k2 c JOIN flags fs ON fs.video_id = c.video_id AND fs.idx = c.s JOIN flags fe ON fe.video_id = c.video_id AND fe.idx = c.e""",
        "k4": f"""SELECT c.*, fe.start AS last_start, fe.next_start, CASE WHEN {stop('fe')} - begin < 38 THEN least(begin + 35, c.video_end)
            WHEN {stop('fe')} - begin > 58 THEN least(begin + 58, c.video_end) ELSE {stop('fe')} END AS finish
            FROM k3 c JOIN flags fe ON fe.video_id = c.video_id AND fe.idx = c.e""",
        "k5": """SELECT * EXCLUDE (begin, finish), round_even(begin * 100, 0) / 100 AS start_time, round_even(CASE WHEN next_start < finish AND next_start > last_start
            THEN next_start ELSE finish END * 100, 0) / 100 AS end_time FROM k4""",
    }


GRADED = """SELECT k.*, NOT fs.bad AS start_clean, fe.ends AS end_clean, fs.idx = 0 OR fs.prev_ends AS sentence_start, fs.hook AS opens_with_hook,
    end_time - start_time AS span FROM k5 k JOIN flags fs ON fs.video_id = k.video_id AND fs.idx = k.s
    JOIN flags fe ON fe.video_id = k.video_id AND fe.idx = k.e"""


def grade(audio: str) -> str:
    return f"""greatest(1e0, least(10e0, round(5e0 + CASE WHEN start_clean THEN 1.5e0 ELSE -0.5e0 END + CASE WHEN sentence_start THEN 1.5e0 ELSE 0e0 END
        + CASE WHEN opens_with_hook THEN 2e0 ELSE 0e0 END + CASE WHEN end_clean THEN 1.5e0 ELSE 0e0 END
        + CASE WHEN {audio} THEN 1.5e0 WHEN end_clean THEN 1e0 ELSE 0e0 END
        + CASE WHEN span BETWEEN 30 AND 45 THEN 1e0 WHEN span BETWEEN 25 AND 58 THEN 0.5e0 ELSE 0e0 END, 1)))"""


RAW = "SELECT c.*, start_index AS s, greatest(start_index, least(end_index, n - 1)) AS e, n, video_end FROM candidates c JOIN (SELECT DISTINCT video_id, n, video_end FROM flags) USING (video_id)"

# The greedy choice, one clip of every video per step.
CHOICE = {
    "ranked": """SELECT video_id, ord, start_index AS s, end_index AS e,
        row_number() OVER (PARTITION BY video_id ORDER BY virality_score DESC, ord) AS rn FROM candidates""",
    "choice": """SELECT video_id, 0::BIGINT AS rn, []::STRUCT(ord INTEGER, s INTEGER, e INTEGER)[] AS kept FROM (SELECT DISTINCT video_id FROM ranked)
        UNION ALL SELECT c.video_id, r.rn, CASE WHEN len(list_filter(c.kept, lambda k: k.s <= r.e AND k.e >= r.s)) > 0 THEN c.kept
            ELSE list_append(c.kept, {'ord': r.ord, 's': r.s, 'e': r.e}) END
        FROM choice c JOIN ranked r ON r.video_id = c.video_id AND r.rn = c.rn + 1""",
    "chosen": "SELECT video_id, unnest(list_transform(arg_max(kept, rn), lambda k: k.ord)) AS ord FROM choice GROUP BY video_id",
}
CHOSEN = {**CHOICE, "picked": "SELECT candidates.* FROM candidates JOIN chosen USING (video_id, ord)"}

# Finished clips after comparing everything with everything that was kept.
FINAL = {
    **CHOSEN, **refine_ctes("picked"), **clamp_ctes("r4"), "graded": GRADED,
    "texts": """SELECT g.video_id, g.ord, string_agg(l.text, ' ' ORDER BY l.line_idx) AS text FROM k5 g JOIN lines l
        ON l.video_id = g.video_id AND l.line_idx BETWEEN g.s AND g.e GROUP BY ALL""",
    "nodes": f"""SELECT g.*, text, {word_set('text')} AS words, {word_set("title || ' #shorts ' || title")} AS hooks,
        row_number() OVER (PARTITION BY video_id ORDER BY CASE WHEN virality_score > 0 THEN virality_score ELSE end_time - start_time END DESC, ord) AS rn
        FROM graded g JOIN texts USING (video_id, ord)""",
    "final": f"""SELECT video_id, 0::BIGINT AS rn, []::STRUCT(ord INTEGER, s DOUBLE, e DOUBLE, ls BIGINT, le BIGINT, words VARCHAR[], hooks VARCHAR[])[] AS kept
        FROM (SELECT DISTINCT video_id FROM nodes)
        UNION ALL SELECT f.video_id, n.rn, CASE WHEN len(list_filter(f.kept, lambda k: (k.s < n.end_time AND k.e > n.start_time)
            OR greatest(0, least(k.le, n.e) - greatest(k.ls, n.s) + 1) > 0.6e0 * (k.le - k.ls + n.e - n.s + 2 - greatest(0, least(k.le, n.e) - greatest(k.ls, n.s) + 1))
            OR {jaccard('k.words', 'n.words')} > 0.8e0 OR {jaccard('k.hooks', 'n.hooks')} > 0.75e0)) > 0 THEN f.kept
            ELSE list_append(f.kept, {{'ord': n.ord, 's': n.start_time, 'e': n.end_time, 'ls': n.s::BIGINT, 'le': n.e::BIGINT, 'words': n.words, 'hooks': n.hooks}}) END
        FROM final f JOIN nodes n ON n.video_id = f.video_id AND n.rn = f.rn + 1""",
    "finished": "SELECT video_id, unnest(arg_max(kept, rn)) AS k FROM final GROUP BY video_id",
}


def _picked(spark, sf):
    return dedup.dedup_candidates(inputs.candidates(spark, sf))


@query("line_flags", with_views("SELECT video_id, idx, hook, bad AS bad_start, ends, prev_ends FROM flags", "flags"))
def line_flags(spark, sf):
    return refine.line_flags(inputs.lines(spark, sf)).select("video_id", "idx", "hook", "bad_start", "ends", "prev_ends")


@query("clip_text", with_views("""SELECT c.video_id, c.ord, length(t) AS chars, md5(t) AS digest FROM (
    SELECT c.video_id, c.ord, string_agg(l.text, ' ' ORDER BY l.line_idx) AS t FROM candidates c JOIN lines l
    ON l.video_id = c.video_id AND l.line_idx BETWEEN c.start_index AND c.end_index GROUP BY ALL) c""", "candidates"))
def clip_text(spark, sf):
    src = inputs.lines(spark, sf)
    return joins.clip_text(inputs.candidates(spark, sf).select("video_id", "ord", "start_index", "end_index"), src).select(
        "video_id", "ord", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


@query("context_window", with_views("""SELECT video_id, ord, lo AS window_start, hi AS window_end, md5(t) AS digest FROM (
    SELECT c.video_id, c.ord, min(l.line_idx) AS lo, max(l.line_idx) AS hi, string_agg(
        '[' || line_idx || '] [' || printf('%.2f', start) || ' - ' || printf('%.2f', start + duration) || '] ' || l.text, chr(10) ORDER BY l.line_idx) AS t
    FROM picked c JOIN lines l ON l.video_id = c.video_id AND l.line_idx BETWEEN c.start_index - 8 AND c.end_index + 8 GROUP BY ALL)""",
    "candidates", **CHOSEN))
def context_window(spark, sf):
    out = joins.context_window(_picked(spark, sf), inputs.lines(spark, sf))
    return out.select("video_id", "ord", "window_start", "window_end", F.md5("context").alias("digest"))


@query("editor_window", with_views("""SELECT video_id, ord, CASE WHEN ok THEN a ELSE start_index END AS start_index,
    CASE WHEN ok THEN b ELSE end_index END AS end_index, ok AS accepted FROM (
      SELECT *, a >= greatest(0, start_index - 8) AND a <= b AND b <= least(n - 1, end_index + 8) AS ok FROM (
        SELECT c.*, n, (ord - h % 12)::INTEGER AS a, (end_index + h % 11)::INTEGER AS b FROM (SELECT *, length(title) AS h FROM candidates) c
        JOIN (SELECT video_id, count(*) AS n FROM lines GROUP BY 1) USING (video_id)))""", "candidates"))
def editor_window(spark, sf):
    cands = inputs.candidates(spark, sf)
    size = F.length("title")
    edits = cands.select("video_id", "ord", (F.col("ord") - size % 12).cast("int").alias("adjusted_start"),
                         (F.col("end_index") + size % 11).cast("int").alias("adjusted_end"))
    sized = cands.join(refine.video_stats(inputs.lines(spark, sf)), "video_id")
    return refine.within_window(sized, edits).select("video_id", "ord", "start_index", "end_index", "accepted")


@query("dedup_candidates", with_views("SELECT video_id, ord, start_index, end_index, virality_score FROM picked", "candidates", **CHOSEN))
def dedup_candidates(spark, sf):
    return _picked(spark, sf).select("video_id", "ord", "start_index", "end_index", "virality_score")


@query("refine_boundaries", with_views("SELECT video_id, ord, s::INTEGER AS start_index, e::INTEGER AS end_index FROM r4",
                                       "candidates", "flags", **refine_ctes("candidates")))
def refine_boundaries(spark, sf):
    return refine.refine_boundaries(inputs.candidates(spark, sf), inputs.lines(spark, sf)).select("video_id", "ord", "start_index", "end_index")


@query("clamp_duration", with_views("SELECT video_id, ord, s::INTEGER AS start_index, e::INTEGER AS end_index, start_time, end_time FROM k5",
                                    "candidates", "flags", raw=RAW, **clamp_ctes("raw")))
def clamp_duration(spark, sf):
    return refine.clamp_duration(inputs.candidates(spark, sf), inputs.lines(spark, sf)).select(
        "video_id", "ord", "start_index", "end_index", "start_time", "end_time")


@query("completeness", with_views(f"""SELECT video_id, ord, start_clean, end_clean, sentence_start, opens_with_hook,
    {grade('false')} AS story_completeness_score FROM graded""", "candidates", "flags", raw=RAW, **clamp_ctes("raw"), graded=GRADED))
def completeness(spark, sf):
    return refine.with_quality(inputs.candidates(spark, sf), inputs.lines(spark, sf), refine=False).select(
        "video_id", "ord", "start_clean", "end_clean", "sentence_start", "opens_with_hook", "story_completeness_score")


@query("validate_clips", with_views(f"""SELECT n.video_id, n.ord, s::INTEGER AS start_index, e::INTEGER AS end_index, start_time, end_time,
    {grade('false')} AS story_completeness_score, title || ' #shorts' AS shorts_title, md5(text) AS digest
    FROM nodes n JOIN finished f ON f.video_id = n.video_id AND f.k.ord = n.ord""", "candidates", "flags", **FINAL))
def validate_clips(spark, sf):
    out = refine.validate_clips(_picked(spark, sf), inputs.lines(spark, sf))
    return out.select("video_id", "ord", "start_index", "end_index", "start_time", "end_time", "story_completeness_score",
                      "shorts_title", F.md5("text").alias("digest"))


@query("drop_reasons", with_views(f"""SELECT video_id, ord, arg_min(kept_ord, krn) AS kept_ord, arg_min(reason, krn) AS reason FROM (
    SELECT n.video_id, n.ord, k.ord AS kept_ord, k.rn AS krn, CASE
        WHEN k.start_time < n.end_time AND k.end_time > n.start_time THEN 'temporal overlap'
        WHEN greatest(0, least(k.e, n.e) - greatest(k.s, n.s) + 1) > 0.6e0 * (k.e - k.s + n.e - n.s + 2 - greatest(0, least(k.e, n.e) - greatest(k.s, n.s) + 1)) THEN 'index redundancy'
        WHEN {jaccard('k.words', 'n.words')} > 0.8e0 THEN 'text-level semantic redundancy'
        WHEN {jaccard('k.hooks', 'n.hooks')} > 0.75e0 THEN 'hook concept redundancy' END AS reason
    FROM nodes n ANTI JOIN held h ON h.video_id = n.video_id AND h.ord = n.ord JOIN (SELECT n.* FROM nodes n JOIN held h USING (video_id, ord)) k
    ON k.video_id = n.video_id AND k.rn < n.rn) WHERE reason IS NOT NULL GROUP BY video_id, ord""", "candidates", "flags", **FINAL,
    held="SELECT video_id, k.ord AS ord FROM finished"))
def drop_reasons(spark, sf):
    # Of the prepared clips only what they are compared by is staged, once for both steps.
    nodes = cut_lineage(dedup.clip_nodes(refine.prepared_clips(_picked(spark, sf), inputs.lines(spark, sf))))
    ids = nodes.select("video_id", "ord")
    return dedup.drop_reasons(ids, dedup.dedup_clips(ids, nodes=nodes), nodes)


@query("nearest_line", with_views("""
    SELECT t.video_id, ord, arg_min(idx, [abs(f.start - a), idx::DOUBLE])::INTEGER AS start_index,
           arg_min(idx, [abs(f.fin - b), idx::DOUBLE])::INTEGER AS end_index
    FROM (SELECT video_id, ord, ord * 3e0 + 0.75e0 AS a, ord * 3e0 + 0.75e0 + end_index * 0.5e0 AS b FROM candidates) t JOIN flags f USING (video_id)
    GROUP BY t.video_id, ord""", "candidates", "flags"))
def nearest_line(spark, sf):
    # Lines and times are read several times, and cutting texts into lines costs more than all that follows.
    lines = cut_lineage(inputs.lines(spark, sf).select("video_id", "line_idx", "start", "duration", inputs.end_index()))
    at = F.col("ord") * 3.0 + 0.75
    times = lines.withColumnRenamed("line_idx", "ord").select("video_id", "ord", at.alias("start_time"), (at + F.col("end_index") * 0.5).alias("end_time"))
    return joins.nearest_line(times, lines).select("video_id", "ord", "start_index", "end_index")


TIMED = "SELECT *, start_index * 2.5e0 AS start_time, (end_index + 1) * 2.5e0 AS end_time FROM candidates"


def _timed(spark, sf):
    return inputs.candidates(spark, sf).withColumns({"start_time": F.col("start_index") * 2.5, "end_time": (F.col("end_index") + 1) * 2.5})


@query("overlap_counts", with_views("""SELECT a.video_id, a.ord, count(b.ord) AS overlaps FROM timed a LEFT JOIN timed b
    ON b.video_id = a.video_id AND b.ord <> a.ord AND b.start_time < a.end_time AND b.end_time > a.start_time GROUP BY ALL""",
    "candidates", timed=TIMED))
def overlap_counts(spark, sf):
    return joins.overlap_counts(_timed(spark, sf))


SILENCES = "SELECT video_id, start + duration AS t FROM lines WHERE duration < 2.5"


def _silences(spark, sf):
    return inputs.lines(spark, sf).where("duration < 2.5").select("video_id", (F.col("start") + F.col("duration")).alias("t"))


SNAP = """SELECT c.* EXCLUDE (end_time), CASE WHEN ok THEN round_even(q * 100, 0) / 100 ELSE end_time END AS end_time, coalesce(ok AND round_even(q * 100, 0) / 100 <> end_time, false) AS audio_refined
    FROM (SELECT *, abs(q - end_time) <= 2 AND q - start_time >= 25 AS ok FROM (
      SELECT c.*, (SELECT arg_min(t, [abs(t - c.end_time), t]) FROM silences s WHERE s.video_id = c.video_id
                   AND t BETWEEN greatest(c.start_time, c.end_time - 3) AND c.end_time + 3) AS q FROM {source} c)) c"""


@query("snap_to_silence", with_views("SELECT video_id, ord, end_time, audio_refined FROM snapped", "candidates", timed=TIMED, silences=SILENCES,
                                     snapped=SNAP.format(source="timed")))
def snap_to_silence(spark, sf):
    return joins.snap_to_silence(_timed(spark, sf), _silences(spark, sf)).select("video_id", "ord", "end_time", "audio_refined")


@query("refine_audio_end", with_views(f"""SELECT video_id, ord, end_time, audio_refined, {grade('audio_refined')} AS story_completeness_score
    FROM (SELECT * EXCLUDE (span), end_time - start_time AS span FROM snapped)""", "candidates", "flags", raw=RAW, **clamp_ctes("raw"), graded=GRADED,
    silences=SILENCES, snapped=SNAP.format(source="graded")))
def refine_audio_end(spark, sf):
    graded = refine.with_quality(inputs.candidates(spark, sf), inputs.lines(spark, sf), refine=False)
    return refine.refine_audio_end(graded, _silences(spark, sf)).select("video_id", "ord", "end_time", "audio_refined", "story_completeness_score")


@query("top_clips", with_views("""SELECT video_id, ord, virality_score, rank FROM (SELECT *, row_number() OVER (
    PARTITION BY video_id ORDER BY virality_score DESC, ord)::INTEGER AS rank FROM candidates) WHERE rank <= 5""", "candidates"))
def top_clips(spark, sf):
    return selection.top_clips(inputs.candidates(spark, sf), 5).select("video_id", "ord", "virality_score", "rank")


@query("even_sample", with_views("""SELECT c.video_id, c.ord FROM candidates c JOIN (SELECT video_id, count(*) AS n FROM candidates GROUP BY 1) USING (video_id)
    WHERE n <= 10 OR ord IN (SELECT round_even(i * (n - 1) / 9e0, 0)::INTEGER FROM range(10) t(i))""", "candidates"))
def even_sample(spark, sf):
    return selection.even_sample(inputs.candidates(spark, sf), 5).select("video_id", "ord")


@query("merge_selection", with_views("""SELECT s.video_id, s.start_index, s.end_index, coalesce(s.title, c.title) AS title,
    CASE WHEN c.ord IS NULL THEN s.virality_score ELSE c.virality_score END AS virality_score, c.ord
    FROM (SELECT video_id, ord AS start_index, (end_index - ord % 2)::INTEGER AS end_index, CASE WHEN length(title) > 40 THEN 'Best: ' || title END AS title,
                 1e0 AS virality_score FROM candidates) s
    LEFT JOIN (SELECT DISTINCT ON (video_id, start_index, end_index) * FROM candidates ORDER BY video_id, start_index, end_index, ord) c
    USING (video_id, start_index, end_index)""", "candidates"))
def merge_selection(spark, sf):
    cands = inputs.candidates(spark, sf)
    selected = cands.select("video_id", F.col("ord").alias("start_index"), (F.col("end_index") - F.col("ord") % 2).cast("int").alias("end_index"),
                            F.when(F.length("title") > 40, F.concat(F.lit("Best: "), "title")).alias("title"), F.lit(1.0).alias("virality_score"))
    return selection.merge_selection(selected, cands).select("video_id", "start_index", "end_index", "title", "virality_score", "ord")


@query("chunk_transcript", with_views("""SELECT video_id, (line_idx // 300)::INTEGER AS chunk, md5(string_agg('[' || line_idx || '] [' || printf('%.2f', start)
    || ' - ' || printf('%.2f', start + duration) || '] ' || trim(text), chr(10) ORDER BY line_idx)) AS digest FROM lines GROUP BY ALL""", "lines"))
def chunk_transcript(spark, sf):
    return selection.chunk_transcript(inputs.lines(spark, sf)).select("video_id", "chunk", F.md5("text").alias("digest"))


@query("limit_minutes", with_views("""SELECT video_id, count(*) AS n_lines, max(start) AS last_start FROM lines
    WHERE start < 600 OR video_id NOT IN (SELECT 'v' || doc_id FROM labels) GROUP BY video_id""", "lines"))
def limit_minutes(spark, sf):
    listed = inputs.table(spark, sf, "labels").select(F.concat(F.lit("v"), "doc_id").alias("video_id"))
    return selection.limit_minutes(inputs.lines(spark, sf), listed).groupBy("video_id").agg(
        F.count("*").alias("n_lines"), F.max("start").alias("last_start"))


@query("seo_defaults", with_views(f"""SELECT video_id, ord, title || ' #shorts' AS shorts_title,
    'Interesting peak point. Subscribe for more awesome clips! #shorts #learning' AS shorts_description,
    CASE WHEN len(w) = 0 THEN 'shorts,video,highlights' WHEN list_contains(w[1:5], 'shorts') THEN array_to_string(w[1:5], ',')
         ELSE array_to_string(list_append(w[1:5], 'shorts'), ',') END AS shorts_tags
    FROM (SELECT *, list_filter({word_runs('lower(title)')}, lambda x: length(x) > 3) AS w FROM candidates)""", "candidates"))
def seo_defaults(spark, sf):
    return refine.with_seo(inputs.candidates(spark, sf)).select(
        "video_id", "ord", "shorts_title", "shorts_description", F.array_join("shorts_tags", ",").alias("shorts_tags"))


@query("clips_in_order", with_views("SELECT video_id, clip_id, virality_score FROM clips", "clips"))
def clips_in_order(spark, sf):
    return selection.spread_by_score(inputs.clips(spark, sf).withColumn("ord", F.col("doc_id"))).select("video_id", "clip_id", "virality_score")
