"""Parsers and exports, fed with text that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkreel import lexicon as lx
from sparkreel.functions import sanitize as sn, text as tx
from sparkreel.operators import subtitles as sb
from sparkreel.plans import inputs
from sparkreel.plans.registry import query
from sparkreel.plans.subtitle_queries import CHUNKS, EVENTS, VIEWS_BREAK, _chunks
from sparkreel.plans.views import BLANKS, factor_of, with_views
from sparkreel.session import new_folder
from sparkreel.sources import clips as clip_source, logs, markdown, responses, stages, transcripts


def _files(spark, sf, body):
    """One document per row: its lines as text made by ``body`` of (text, start, end)."""
    docs = inputs.table(spark, sf, "documents").select(F.concat(F.lit("v"), "doc_id").alias("video_id"), tx.tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    last = F.ceil(F.size("w") / 8).cast("int") - 1
    def cell(i):
        text = F.array_join(F.slice("w", i * 8 + 1, F.lit(8)), " ")
        return tx.bind(F.struct(text.alias("text"), (i * 2.5).alias("start"), (2.0 + 0.125 * F.pmod(F.length(text), F.lit(8))).alias("duration")), body)
    return docs.select("video_id", F.transform(F.sequence(F.lit(0), last), cell).alias("cells"))


def _clock(sec):
    milli = F.round(sec * 1000).cast("bigint")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(milli / 3600000), F.floor(F.pmod(milli, F.lit(3600000)) / 60000),
                           F.floor(F.pmod(milli, F.lit(60000)) / 1000), F.pmod(milli, F.lit(1000)))


CUES = f"""SELECT video_id, start, duration, trim(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '{BLANKS}', ' ', 'g')) AS text FROM lines
    WHERE NOT regexp_matches(text, '^\\p{{Nd}}+$') AND text <> 'WEBVTT' AND NOT contains(text, 'NOTE')"""


@query("read_subtitles", with_views("""SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY start) - 1)::INTEGER AS line_idx, text, start, duration
    FROM cues WHERE text <> ''""", "lines", cues=CUES))
def read_subtitles(spark, sf):
    files = _files(spark, sf, lambda l: F.concat(_clock(l["start"]), F.lit(" --> "), _clock(l["start"] + l["duration"]), F.lit("\n"), l["text"], F.lit("\n")))
    content = F.concat(F.lit("WEBVTT\n\nNOTE made from a document\n\n"), F.array_join("cells", "\n"))
    return transcripts.parse_subtitles(files.select("video_id", content.alias("content")))


@query("read_transcript_json", with_views("SELECT video_id, line_idx, text, start, duration FROM lines", "lines"))
def read_transcript_json(spark, sf):
    files = _files(spark, sf, lambda l: l).select("video_id", F.to_json("cells").alias("content"))
    return transcripts.parse_transcript_json(files)


TIERS = """SELECT 'v' || doc_id AS video_id, 0 AS tier, quality * 5 AS n FROM labels UNION ALL SELECT 'v' || doc_id, 1, CASE WHEN lang = 'en' THEN n_chars // 2000 ELSE 0 END FROM documents
    UNION ALL SELECT 'v' || doc_id, 3, CASE WHEN n_chars > 1500 THEN 3 ELSE 0 END FROM documents UNION ALL SELECT 'v' || doc_id, 5, CASE WHEN lang <> 'de' THEN n_chars // 400 ELSE 0 END FROM documents"""


@query("resolve_transcript", with_views("""SELECT video_id, best AS tier, CASE best WHEN 0 THEN 'cache' WHEN 1 THEN 'youtube_transcript_api' WHEN 3 THEN 'yt_dlp_manual' WHEN 5 THEN 'faster_whisper' END AS source,
    coalesce(best >= 3, false) AS fallback_used, coalesce(failures, '') AS failures FROM (SELECT video_id, min(tier) FILTER (n > 0) AS best FROM tiers GROUP BY 1)
    LEFT JOIN (SELECT t.video_id, string_agg(tier::VARCHAR, ',' ORDER BY tier) AS failures FROM tiers t JOIN (SELECT video_id, min(tier) FILTER (n > 0) AS b FROM tiers GROUP BY 1) USING (video_id)
               WHERE tier > 0 AND (b IS NULL OR tier < b) GROUP BY 1) USING (video_id)""", tiers=TIERS))
def resolve_transcript(spark, sf):
    docs, labels = inputs.table(spark, sf, "documents"), inputs.table(spark, sf, "labels")
    name, chars = F.concat(F.lit("v"), "doc_id").alias("video_id"), F.col("n_chars")
    tier = lambda df, n, size: df.select(name, F.lit(n).alias("tier"), size.cast("bigint").alias("n_lines"))
    sources = (tier(labels, 0, F.col("quality") * 5).unionByName(tier(docs, 1, F.when(F.col("lang") == "en", F.floor(chars / 2000)).otherwise(0)))
               .unionByName(tier(docs, 3, F.when(chars > 1500, 3).otherwise(0))).unionByName(tier(docs, 5, F.when(F.col("lang") != "de", F.floor(chars / 400)).otherwise(0))))
    return transcripts.resolve_transcript(sources).withColumn("failures", F.array_join("failures", ","))


EXPORT = ", ".join(f"CAST({factor_of(f)} AS VARCHAR) AS {f}" for f in clip_source.EXPORT_FACTORS)


@query("export_csv", with_views(f"""SELECT clip_id, virality_score, {EXPORT}, '' AS feedback, creator_selected::INTEGER AS creator_selected, creator_rejected::INTEGER AS creator_rejected,
    views, likes, comments, watch_time, retention FROM clips""", "clips"))
def export_csv(spark, sf):
    return clip_source.export_frame(inputs.clips(spark, sf).withColumn("feedback", F.lit(None).cast("string")))


def _replies(spark, sf):
    """Candidate lists as model replies: bare, fenced, with chatter, trailing commas, raw breaks, or cut off."""
    rows = inputs.clips(spark, sf).select("clip_id", "video_id", "variant_id", "experiment_id", "virality_score", "published",
                                          F.regexp_replace("title", r'[\\"\p{Cntrl}]', " ").alias("title"))
    item = F.concat(F.lit('{"title": "'), "title", F.lit('", "start_index": 3, "virality_score": '), F.col("virality_score").cast("string"), F.lit(', "reason": "a\nb", "end_index": 9'))
    kind = F.pmod(F.length("title"), F.lit(5))
    reply = (F.when(kind == 0, F.concat(F.lit('Sure: {"clips": ['), item, F.lit(",}, ]} done")))
             .when(kind == 1, F.concat(F.lit("```json\n["), item, F.lit("}]\n```")))
             .when(kind == 2, F.concat(F.lit('{"status": "ok", "found": ['), item))
             .when(kind == 3, F.concat(F.lit("no brackets here: "), "title"))
             .otherwise(F.regexp_replace(F.concat(F.lit("["), item, F.lit("}]")), "\n", " ")))
    return rows.select("clip_id", reply.alias("response"))


@query("read_responses", with_views("""SELECT clip_id, n = 3 AND NOT regexp_matches(title, '[\\[{]') AS quarantined, CASE WHEN n <> 3 THEN t END AS title, CASE WHEN n <> 3 THEN 3 END AS start_index,
    CASE WHEN n <> 3 THEN 9 END AS end_index, CASE WHEN n <> 3 THEN virality_score END AS virality_score FROM (
      SELECT *, length(t) % 5 AS n FROM (SELECT *, regexp_replace(title, '[\\\\"\\p{Cc}]', ' ', 'g') AS t FROM clips))""", "clips"))
def read_responses(spark, sf):
    # One row per clip of a reply that parses, one without a clip for each other reply.
    flagged = responses.flag_responses(_replies(spark, sf))
    cell = F.explode_outer(F.when(F.col("quarantined"), F.lit(None)).otherwise(responses.listed_clips(F.col("json"))))
    return flagged.select("clip_id", "quarantined", cell.alias("c")).where("quarantined OR c IS NOT NULL").select(
        "clip_id", "quarantined", "c.title", "c.start_index", "c.end_index", "c.virality_score")


@query("extract_list", with_views("""SELECT clip_id, ord, title || ord AS title FROM clips, (SELECT unnest([0, 1]) AS ord) WHERE variant_id = 'A' OR ord = 0""", "clips"))
def extract_list(spark, sf):
    clips = inputs.clips(spark, sf)
    item = lambda i: F.struct(F.concat("title", F.lit(str(i))).alias("title"))
    two, one = F.array(item(0), item(1)), F.array(item(0))
    doc = (F.when((F.col("variant_id") == "A") & F.col("published"), F.to_json(two)).when(F.col("variant_id") == "A", F.to_json(F.struct(F.lit(1).alias("n"), two.alias("clips"))))
           .otherwise(F.to_json(F.struct(F.lit("x").alias("note"), one.alias("found")))))
    return responses.extract_list(clips.select("clip_id", doc.alias("json")), "clip_id").select("clip_id", "ord", "title")


@query("stage_reuse", with_views("SELECT video_id || '_' || substr(sha256(video_id), 1, 16) AS checkpoint_key, clip_id, virality_score FROM clips", "clips"))
def stage_reuse(spark, sf):
    clips = inputs.clips(spark, sf).select(sn.settings_key(F.col("video_id"), F.col("video_id")).alias("checkpoint_key"), "clip_id", "virality_score")
    path = new_folder(spark, "stages")
    stages.save_stage(clips.withColumn("virality_score", F.lit(0.0)), path, "scored")
    stages.save_stage(clips, path, "scored")
    return stages.load_stage(spark, path, "scored")


@query("read_loudness", """SELECT event_id, CASE WHEN event_type = 'error' THEN -15e0 ELSE -value END AS mean_volume, CASE WHEN event_type IN ('error', 'view') THEN 0e0 ELSE value / 4 END AS max_volume FROM events""")
def read_loudness(spark, sf):
    value, kind = F.col("value"), F.col("event_type")
    log = F.when(kind == "error", "no audio").otherwise(F.concat(F.lit("[volumedetect] mean_volume: -"), value.cast("string"), F.lit(" dB\n"), F.when(
        kind == "view", "max_volume: unknown").otherwise(F.concat(F.lit("[volumedetect] max_volume: "), (value / 4).cast("string"), F.lit(" dB")))))
    return logs.read_loudness(inputs.table(spark, sf, "events").select("event_id", log.alias("log"))).drop("log")


@query("read_silences", with_views("SELECT video_id, line_idx, start + x AS t FROM (SELECT *, unnest([0.5e0, duration]) AS x FROM lines) WHERE x = 0.5 OR duration < 2.5", "lines"))
def read_silences(spark, sf):
    quiet = F.when(F.col("duration") < 2.5, F.concat(F.lit("\nsilence_end: 1 | silence_start: "), F.col("duration").cast("string"))).otherwise("")
    log = F.concat(F.lit("[silencedetect] silence_start: 0.5"), quiet)
    return logs.read_silences(inputs.lines(spark, sf).select("video_id", "line_idx", F.col("start").alias("scan_start"), log.alias("log"))).select("video_id", "line_idx", "t")


@query("read_ass_events", with_views("""SELECT clip_id, chunk::INTEGER AS chunk, round(floor(cs) + least(round_even((cs - floor(cs)) * 100, 0), 99) / 100, 2) AS start, replace(upper(replace(array_to_string(ws, ' '), 'ß', '~~')), '~~', 'SS') AS text,
    replace(upper(replace(ws[1], 'ß', '~~')), '~~', 'SS') AS highlight FROM chunks c JOIN timed t USING (clip_id, chunk)
    WHERE NOT regexp_matches(array_to_string(ws, ' '), '[{}]')""", "clip_words", **CHUNKS))
def read_ass_events(spark, sf):
    shown = sb.render_event_text(sb.subtitle_events(_chunks(spark, sf, style="classic"))).where(~F.array_join(F.transform("words", lambda w: w["word"]), " ").rlike("[{}]"))
    parsed = logs.parse_ass_events(shown.select("clip_id", "chunk", "dialogue"), "dialogue")
    return parsed.select("clip_id", F.col("chunk").cast("int").alias("chunk"), F.round("start", 2).alias("start"),
                         F.replace("text", F.lit("\\N"), F.lit(" ")).alias("text"), "highlight")


@query("clip_report", with_views("""SELECT '| ' || clip_id || ' | ' || video_id || ' | ' || printf('%.4f', virality_score) || ' | ' || views || ' | '
    || CASE WHEN published THEN 'true' ELSE 'false' END || ' | ' || coalesce(experiment_id, '') || ' |' AS line FROM clips""", "clips"))
def clip_report(spark, sf):
    """The clip table as a Markdown report, written as text and read back."""
    folder = new_folder(spark, "report")
    markdown.write_report(inputs.clips(spark, sf).select("clip_id", "video_id", "virality_score", "views", "published", "experiment_id"), folder)
    return markdown.read_report(spark, folder)
