"""Subtitles of back-to-back clips that cover every transcript completely."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkreel import lexicon as lx
from sparkreel.functions import text as tx
from sparkreel.operators import ordered, subtitles as sb
from sparkreel.plans import inputs
from sparkreel.plans.registry import query
from sparkreel.plans.views import VIEWS, listing, q, with_views

VIEWS["spoken"] = (["lines"], """
    SELECT *, CASE WHEN span < 0.5 THEN duration ELSE span END AS spoken FROM (
      SELECT *, least(start + duration, coalesce(lead(start) OVER (PARTITION BY video_id ORDER BY line_idx), start + duration)) - start AS span FROM lines)""")
VIEWS["words"] = (["spoken"], """
    SELECT video_id, line_idx, (i - 1)::INTEGER AS pos, w[i] AS word, start AS line_start, start + duration AS line_end,
           start + (i - 1) * (spoken / len(w)) + 0.05e0 AS start, start + i * (spoken / len(w)) + 0.05e0 AS fin
    FROM (SELECT *, string_split(text, ' ') AS w, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM spoken)""")
VIEWS["clip_words"] = (["words", "tiled_clips"], """
    SELECT c.clip_id, c.start_time, c.end_time, w.*, row_number() OVER (PARTITION BY c.clip_id ORDER BY w.start, line_idx, pos) AS rn,
           count(*) OVER (PARTITION BY c.clip_id) AS n_words
    FROM tiled_clips c JOIN words w ON w.video_id = c.video_id AND w.start < c.end_time AND w.fin > c.start_time
         AND w.line_start < c.end_time AND w.line_end > c.start_time""")


def chunk_ctes(safe: bool) -> dict[str, str]:
    if safe:
        split = "f.n >= 3 OR regexp_matches(f.word, '[.?!,]$')"
    else:
        split = """f.n >= 4 OR regexp_matches(f.word, '[.,?!;:]$') OR w.start - f.fin > 0.35e0 OR w.fin - f.first > 3
            OR (f.n >= 2 AND (f.n + 1) / greatest(0.1e0, w.fin - f.first) * 60 > 260)"""
    pause = "0e0" if safe else "CASE WHEN regexp_matches(last_word, '[.?!]$') THEN 0.25e0 ELSE 0e0 END"
    return {
        "fold": f"""SELECT clip_id, rn, word, fin, 1 AS n, start AS first, 0 AS chunk FROM clip_words WHERE rn = 1
            UNION ALL SELECT w.clip_id, w.rn, w.word, w.fin, CASE WHEN {split} THEN 1 ELSE f.n + 1 END, CASE WHEN {split} THEN w.start ELSE f.first END,
                CASE WHEN {split} THEN f.chunk + 1 ELSE f.chunk END
            FROM fold f JOIN clip_words w ON w.clip_id = f.clip_id AND w.rn = f.rn + 1""",
        "chunks": f"""SELECT *, lead(ss) OVER (PARTITION BY clip_id ORDER BY chunk) AS nx, {pause} AS p FROM (
            SELECT clip_id, chunk, any_value(start_time) AS start_time, any_value(end_time) AS end_time, any_value(n_words) AS n_words,
                   min(start) - any_value(start_time) AS ss, arg_max(w.fin, rn) - any_value(start_time) AS se, arg_max(w.word, rn) AS last_word,
                   list(w.word ORDER BY rn) AS ws, list(w.start - start_time ORDER BY rn) AS starts
            FROM clip_words w JOIN (SELECT clip_id, rn, chunk FROM fold) USING (clip_id, rn) GROUP BY clip_id, chunk)""",
        "timed": """SELECT clip_id, -1 AS chunk, 0e0 AS cs, 0e0 AS ce FROM (SELECT DISTINCT clip_id FROM chunks)
            UNION ALL SELECT clip_id, chunk, cs, CASE WHEN cs >= ce THEN cs + 0.05e0 ELSE ce END FROM (
              SELECT clip_id, chunk, cs, CASE WHEN ce - cs < 0.3e0 THEN CASE WHEN nx IS NULL THEN cs + 0.3e0 ELSE least(cs + 0.3e0, nx) END ELSE ce END AS ce FROM (
                SELECT c.clip_id, c.chunk, nx, greatest(t.ce, ss - 0.1e0) AS cs,
                       CASE WHEN nx IS NULL THEN least(se + p, end_time - start_time) ELSE least(se + p, greatest(se, nx - 0.1e0)) END AS ce
                FROM timed t JOIN chunks c ON c.clip_id = t.clip_id AND c.chunk = t.chunk + 1))""",
    }


CHUNKS = chunk_ctes(False)
CLEAN = r"lower(regexp_replace({}, '[^\p{{L}}\p{{N}}_$]', '', 'g'))"
KIND = (f"CASE WHEN list_contains({listing(lx.EMPHASIS_WORDS)}, {CLEAN.format('{w}')}) THEN 'emphasis' WHEN regexp_matches({{w}}, '[0-9$]') THEN 'number' "
        f"WHEN contains({{w}}, '?') OR list_contains({listing(lx.QUESTION_WORDS)}, {CLEAN.format('{w}')}) THEN 'question' ELSE 'plain' END")
kind = lambda w: KIND.replace("{w}", w)
VIEWS_BREAK = f"""SELECT clip_id, chunk, coalesce(arg_max(i, [s, -i]), -1)::INTEGER AS brk FROM (
    SELECT clip_id, chunk, ws, i, CASE WHEN regexp_matches(ws[i + 1], '[.,?!;:]$') THEN 100 ELSE 0 END - abs(a - b) * 2
           - CASE WHEN len(ws) - i - 1 = 1 THEN 50 ELSE 0 END - greatest(a - 22, 0) * 5 - greatest(b - 22, 0) * 5 AS s
    FROM (SELECT *, length(array_to_string(ws[1 : i + 1], ' ')) AS a, length(array_to_string(ws[i + 2 :], ' ')) AS b FROM (
            SELECT clip_id, chunk, ws, unnest(range(0, len(ws) - 1))::INTEGER AS i FROM chunks WHERE len(ws) >= 2 AND NOT (len(ws) <= 2 AND length(array_to_string(ws, ' ')) <= 18)))
    WHERE NOT list_contains({listing(lx.PROTECTED_PAIRS)}, {CLEAN.format('ws[i + 1]')} || ' ' || {CLEAN.format('ws[i + 2]')}))
    GROUP BY clip_id, chunk"""
EVENTS = """SELECT c.clip_id, c.chunk, i - 1 AS active, ws, coalesce(brk, -1) AS brk, es,
        CASE WHEN ee > es THEN ee ELSE es + 0.05e0 END AS ee
    FROM (SELECT c.*, i, CASE WHEN i = 1 THEN cs ELSE greatest(cs, starts[i]) END AS es, CASE WHEN i = len(ws) THEN ce ELSE least(ce, starts[i + 1]) END AS ee
          FROM (SELECT c.*, t.cs, t.ce, unnest(range(1, len(ws) + 1)) AS i FROM chunks c JOIN timed t USING (clip_id, chunk)) c) c
    LEFT JOIN breaks b ON b.clip_id = c.clip_id AND b.chunk = c.chunk"""
POP = r"\fscx100\fscy100\1a&H26&\t(0,80,\fscx118\fscy118\1a&H00&)\t(80,180,\fscx107\fscy107)\t(180,260,\fscx100\fscy100)"
TINT = f"CASE {kind('x')} WHEN 'emphasis' THEN '&H001A9FFF&' WHEN 'number' THEN '&H0073D52E&' WHEN 'question' THEN '&H00E9EC10&' ELSE '&H0000D4FF&' END"
CLOCK = ("((floor({t}) / 3600)::BIGINT)::VARCHAR || ':' || lpad(((floor({t})::BIGINT // 60) % 60)::VARCHAR, 2, '0') || ':' || "
         "lpad((floor({t})::BIGINT % 60)::VARCHAR, 2, '0') || '.' || lpad(least(round_even(({t} - floor({t})) * 100, 0)::BIGINT, 99)::VARCHAR, 2, '0')")
RENDERED = f"""SELECT clip_id, chunk, active, 'Dialogue: 0,' || {CLOCK.format(t='es')} || ',' || {CLOCK.format(t='ee')} || ',Default,,0,0,0,,' ||
        CASE WHEN brk < 0 THEN array_to_string(p, ' ') ELSE array_to_string(p[1 : brk + 1], ' ') || '\\N' || array_to_string(p[brk + 2 :], ' ') END AS dialogue
    FROM (SELECT *, list_transform(ws, lambda x, j: CASE WHEN j - 1 = active THEN '{{' || CASE WHEN chunk = 0 AND active = 0 THEN '\\fad(120,0)' ELSE '' END
              || {q(POP)} || '\\c' || {TINT} || '}}' || replace(upper(replace(x, 'ß', '~~')), '~~', 'SS') || '{{\\fscx100\\fscy100\\c&H00FFFFFF&}}'
            ELSE replace(upper(replace(x, 'ß', '~~')), '~~', 'SS') END) AS p FROM events_)"""


def _words(spark, sf):
    return sb.word_timing(inputs.lines(spark, sf))


def _chunks(spark, sf, **kw):
    return sb.subtitle_chunks(inputs.tiled_clips(spark, sf), sb.word_lines(inputs.lines(spark, sf)), **kw)


@query("spoken_duration", with_views("SELECT video_id, line_idx, spoken FROM spoken", "spoken"))
def spoken_duration(spark, sf):
    return ordered.spoken_durations(inputs.lines(spark, sf)).select("video_id", "line_idx", "spoken")


@query("word_timing", with_views('SELECT video_id, line_idx, pos, word, round(start, 6) AS start, round(fin, 6) AS "end" FROM words', "words"))
def word_timing(spark, sf):
    return _words(spark, sf).select("video_id", "line_idx", "pos", "word", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query("words_in_clip", with_views("SELECT clip_id, count(*) AS n_words, round(min(start), 6) AS first_start, round(max(fin), 6) AS last_end FROM clip_words GROUP BY clip_id", "clip_words"))
def words_in_clip(spark, sf):
    return sb.clip_words(inputs.tiled_clips(spark, sf), _words(spark, sf)).groupBy("clip_id").agg(
        F.count("*").alias("n_words"), F.round(F.min("start"), 6).alias("first_start"), F.round(F.max("end"), 6).alias("last_end"))


CHUNK_ROWS = """SELECT clip_id, c.chunk::INTEGER AS chunk, array_to_string(ws, ' ') AS words, round(cs, 6) AS chunk_start, round(ce, 6) AS chunk_end
    FROM chunks c JOIN timed t USING (clip_id, chunk)"""


def _chunk_rows(df):
    return df.select("clip_id", F.col("chunk").cast("int").alias("chunk"), F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("words"),
                     F.round("chunk_start", 6).alias("chunk_start"), F.round("chunk_end", 6).alias("chunk_end"))


@query("chunk_words", with_views("SELECT clip_id, chunk::INTEGER AS chunk, array_to_string(ws, ' ') AS words FROM chunks", "clip_words", **CHUNKS))
def chunk_words(spark, sf):
    return _chunk_rows(_chunks(spark, sf)).select("clip_id", "chunk", "words")


@query("chunk_timing", with_views(CHUNK_ROWS, "clip_words", **CHUNKS))
def chunk_timing(spark, sf):
    return _chunk_rows(_chunks(spark, sf))


@query("fallback_chunks", with_views(CHUNK_ROWS, "clip_words", **chunk_ctes(True)))
def fallback_chunks(spark, sf):
    return _chunk_rows(_chunks(spark, sf, safe_mode=True))


@query("line_break", with_views("""SELECT c.clip_id, c.chunk::INTEGER AS chunk, coalesce(brk, -1) AS break_after FROM chunks c
    LEFT JOIN breaks b ON b.clip_id = c.clip_id AND b.chunk = c.chunk""", "clip_words", **CHUNKS, breaks=VIEWS_BREAK))
def line_break(spark, sf):
    return _chunks(spark, sf).select("clip_id", F.col("chunk").cast("int").alias("chunk"), sb.line_break().alias("break_after"))


@query("active_word_events", with_views("""SELECT clip_id, chunk::INTEGER AS chunk, active::INTEGER AS active, round(es, 6) AS event_start,
    round(ee, 6) AS event_end FROM events_""", "clip_words", **CHUNKS, breaks=VIEWS_BREAK, events_=EVENTS))
def active_word_events(spark, sf):
    return sb.subtitle_events(_chunks(spark, sf)).select("clip_id", F.col("chunk").cast("int").alias("chunk"), F.col("active").cast("int").alias("active"),
                                                         F.round("event_start", 6).alias("event_start"), F.round("event_end", 6).alias("event_end"))


@query("word_class", with_views(f"SELECT kind, count(*) AS n, count(DISTINCT word) AS distinct_words FROM (SELECT word, {kind('word')} AS kind FROM words) GROUP BY kind", "words"))
def word_class(spark, sf):
    return _words(spark, sf).select("word", sb.word_class(F.col("word")).alias("kind")).groupBy("kind", "word").agg(
        F.count("*").alias("n")).groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("distinct_words"))


@query("render_event_text", with_views("SELECT clip_id, chunk::INTEGER AS chunk, active::INTEGER AS active, dialogue FROM rendered", "clip_words", **CHUNKS,
                                       breaks=VIEWS_BREAK, events_=EVENTS, rendered=RENDERED))
def render_event_text(spark, sf):
    return sb.render_event_text(sb.subtitle_events(_chunks(spark, sf))).select(
        "clip_id", F.col("chunk").cast("int").alias("chunk"), F.col("active").cast("int").alias("active"), "dialogue")


COUNTED = f"""SELECT clip_id, any_value(n_words) AS n_words, count(*) AS n_chunks, any_value(end_time) - any_value(start_time) AS len,
    sum(len(list_filter(ws, lambda x: {kind('x')} = 'plain')))::BIGINT AS plain, sum(len(list_filter(ws, lambda x: {kind('x')} = 'emphasis')))::BIGINT AS emphasis
    FROM chunks GROUP BY clip_id"""


@query("subtitle_metrics", with_views("""SELECT clip_id, n_words AS ass_event_count, n_words / (len / 60) > 600 AS fallback_used, plain AS highlight_count,
    emphasis AS emphasis_count, round(n_words / n_chunks, 2) AS words_per_chunk, round(n_words / len * 60, 2) AS reading_speed,
    'kinetic' AS subtitle_style FROM counted""", "clip_words", **CHUNKS, counted=COUNTED))
def subtitle_metrics(spark, sf):
    return sb.subtitle_metrics(_chunks(spark, sf)).drop("video_id")


@query("density_guard", with_views("""SELECT clip_id, n_words / (len / 60) > 150 AS fallback_used, CASE WHEN n_words / (len / 60) > 150 THEN n_chunks ELSE n_words END AS ass_event_count,
    CASE WHEN n_words / (len / 60) > 150 THEN 'classic' ELSE 'kinetic' END AS subtitle_style, plain AS highlight_count FROM counted""", "clip_words", **CHUNKS, counted=COUNTED))
def density_guard(spark, sf):
    return sb.subtitle_metrics(_chunks(spark, sf, max_density=150.0)).select("clip_id", "fallback_used", "ass_event_count", "subtitle_style", "highlight_count")


@query("spoken_rate", with_views("""SELECT clip_id, round(n / len * 60, 4) AS wpm, CASE WHEN n / len * 60 > 200 THEN 'karaoke' WHEN n / len * 60 < 130 THEN 'classic'
    ELSE 'kinetic' END AS style FROM (SELECT clip_id, count(*) AS n, any_value(end_time - start_time) AS len FROM clip_words GROUP BY clip_id)""", "clip_words"))
def spoken_rate(spark, sf):
    rows = sb.clip_words(inputs.tiled_clips(spark, sf), _words(spark, sf)).groupBy("clip_id", "start_time", "end_time").agg(F.count("*").alias("n"))
    wpm = F.col("n") / (F.col("end_time") - F.col("start_time")) * 60
    return rows.select("clip_id", F.round(wpm, 4).alias("wpm"), sb.spoken_style(wpm).alias("style"))


@query("karaoke_events", with_views("SELECT clip_id, count(*) AS n_events FROM clip_words GROUP BY clip_id", "clip_words"))
def karaoke_events(spark, sf):
    shown = sb.render_event_text(sb.subtitle_events(_chunks(spark, sf, style="karaoke")))
    return shown.groupBy("clip_id").agg(F.count("dialogue").alias("n_events"))


@query("cooldown_select", with_views("""SELECT clip_id, round(p.s, 6) AS start, round(p.e, 6) AS "end" FROM (
      SELECT clip_id, unnest(arg_max(out, rn)) AS p FROM walk GROUP BY clip_id)""", "clip_words",
    ev="""SELECT clip_id, start - start_time AS s, fin - start_time AS e, row_number() OVER (PARTITION BY clip_id ORDER BY start - start_time, fin - start_time) AS rn
          FROM clip_words WHERE length(word) >= 6 AND start - start_time >= 2 AND fin - start_time <= end_time - start_time - 2""",
    walk="""SELECT clip_id, 0::BIGINT AS rn, -10e0 AS last, []::STRUCT(s DOUBLE, e DOUBLE)[] AS out FROM (SELECT DISTINCT clip_id FROM ev)
        UNION ALL SELECT v.clip_id, v.rn, CASE WHEN s - last >= 8 THEN e ELSE last END, CASE WHEN s - last >= 8 THEN list_append(out, {'s': s, 'e': e}) ELSE out END
        FROM walk w JOIN ev v ON v.clip_id = w.clip_id AND v.rn = w.rn + 1"""))
def cooldown_select(spark, sf):
    words = sb.clip_words(inputs.tiled_clips(spark, sf), _words(spark, sf))
    events = words.select("clip_id", (F.col("start") - F.col("start_time")).alias("start"), (F.col("end") - F.col("start_time")).alias("end"),
                          F.when(F.length("word") >= 6, F.col("word")).otherwise("").alias("emoji"), (F.col("end_time") - F.col("start_time")).alias("duration"))
    return sb.cooldown_select(events).select("clip_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))
