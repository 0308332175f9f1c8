"""Scalar rules over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkreel import lexicon as lx
from sparkreel.functions import sanitize as sn, scoring, stats, text as tx
from sparkreel.operators import scorer
from sparkreel.plans import inputs
from sparkreel.plans.registry import query
from sparkreel.plans.views import (BLANKS, NOT_WORD, VIEWS, code_sum, factor_of, first_word, ends_sentence, has_number, is_hook, jaccard, listing,
                                   opens_cleanly, q, strip, tokens, with_views, word_runs, word_set)

# Links of every page: its own URL plus a video link whose form depends on the page's URL.
VIEWS["urls"] = ([], """SELECT page_id, v, CASE WHEN url LIKE 'https%' THEN CASE WHEN contains(url, '?') THEN 'https://www.youtube.com/watch?list=x&v=' || v ELSE 'https://youtu.be/' || v END
        WHEN contains(url, '#') THEN 'https://youtube.com/shorts/' || v || '?f=1' WHEN contains(url, '?') THEN url ELSE 'http://www.youtube.com/embed/' || v END AS link
    FROM (SELECT *, substr(md5(url), 1, 11) AS v FROM pages)""")


def urls(spark, sf):
    v = F.substring(F.md5("url"), 1, 11)
    query_, secure, anchor = (F.contains("url", F.lit("?")), F.startswith("url", F.lit("https")), F.contains("url", F.lit("#")))
    link = (F.when(secure & query_, F.concat(F.lit("https://www.youtube.com/watch?list=x&v="), v)).when(secure, F.concat(F.lit("https://youtu.be/"), v))
            .when(anchor, F.concat(F.lit("https://youtube.com/shorts/"), v, F.lit("?f=1"))).when(query_, F.col("url"))
            .otherwise(F.concat(F.lit("http://www.youtube.com/embed/"), v)))
    return inputs.table(spark, sf, "pages").select("page_id", "url", v.alias("v"), link.alias("link"))


@query("video_id", with_views("SELECT page_id, CASE WHEN contains(link, 'youtu') THEN v END AS video_id FROM urls", "urls"))
def video_id(spark, sf):
    return urls(spark, sf).select("page_id", tx.video_id(F.col("link")).alias("video_id"))


@query("parse_ts", "SELECT event_id, value, round(hour(ts) * 3600 + minute(ts) * 60 + second(ts) + ((epoch_us(ts) // 1000) % 1000) / 1000e0, 3) AS seconds FROM events")
def parse_ts(spark, sf):
    clock = F.date_format(F.col("ts"), "HH:mm:ss.SSS")
    return inputs.table(spark, sf, "events").select("event_id", "value", F.round(tx.parse_clock(clock), 3).alias("seconds"))


@query("format_ass_ts", """SELECT event_id, CASE WHEN w < 0 THEN '0:00:00.00' ELSE (w // 3600) || ':' || lpad((w // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((w % 60)::VARCHAR, 2, '0') || '.'
        || lpad(least(round_even((t - w) * 100, 0)::BIGINT, 99)::VARCHAR, 2, '0') END AS clock,
      CASE WHEN w < 0 THEN 0e0 ELSE round(w + least(round_even((t - w) * 100, 0), 99) / 100, 2) END AS parsed
    FROM (SELECT *, floor(t)::BIGINT AS w FROM (SELECT event_id, (value - 20) * 25e0 AS t FROM events))""")
def format_ass_ts(spark, sf):
    clock = tx.format_ass_clock((F.col("value") - 20) * 25)
    rows = inputs.table(spark, sf, "events").select("event_id", clock.alias("clock"))
    return rows.withColumn("parsed", F.round(tx.parse_ass_clock(F.col("clock")), 2))


@query("ass_color", """SELECT page_id, CASE WHEN contains(url, '?') THEN '&H00FFFFFF&' ELSE '&H00' || substr(m, 5, 2) || substr(m, 3, 2) || substr(m, 1, 2) || '&' END AS color
    FROM (SELECT *, md5(url) AS m FROM pages)""")
def ass_color(spark, sf):
    m = F.md5("url")
    code = F.concat(F.lit("#"), F.substring(m, 1, 6), F.when(F.contains("url", F.lit("?")), "ff").otherwise(""))
    return inputs.table(spark, sf, "pages").select("page_id", tx.ass_color(code).alias("color"))


NON_VERBAL = """SELECT {id}, kept < 10 OR n < 5 OR coalesce(top > 0.7 * n, false) AS non_verbal FROM (
    SELECT {id}, length(kept) AS kept, coalesce(len(w), 0) AS n,
           (SELECT max(c) FROM (SELECT count(*) AS c FROM unnest(w) t(x) GROUP BY x)) AS top
    FROM (SELECT {id}, regexp_replace(regexp_replace(regexp_replace(low, '\\[\\d+\\]', '', 'g'), '\\[\\d+\\.\\d+\\s*-\\s*\\d+\\.\\d+\\]', '', 'g'), '""" + NOT_WORD + """', '', 'g') AS kept,
          list_filter(list_transform(list_filter(""" + tokens("lower(text)") + """, lambda x: NOT (x LIKE '[%' AND x LIKE '%]')), lambda x: regexp_replace(x, '""" + NOT_WORD + """', '', 'g')), lambda x: x <> '') AS w
          FROM (SELECT *, """ + "".join("replace(" for _ in lx.NON_VERBAL_TAGS) + "lower(text)" + "".join(f", {q(t)}, '')" for t in lx.NON_VERBAL_TAGS) + """ AS low FROM {table})))"""


@query("non_verbal_gate", with_views(NON_VERBAL.replace("{id}", "video_id, line_idx").replace("{table}", "lines"), "lines"))
def non_verbal_gate(spark, sf):
    return inputs.lines(spark, sf).select("video_id", "line_idx", tx.is_non_verbal(F.col("text")).alias("non_verbal"))


@query("is_non_verbal", NON_VERBAL.replace("{id}", "doc_id").replace("{table}", "documents"))
def is_non_verbal(spark, sf):
    return inputs.table(spark, sf, "documents").select("doc_id", tx.is_non_verbal(F.col("text")).alias("non_verbal"))


A, B = f"list_distinct({tokens('lower(a.text)')})", f"list_distinct({tokens('lower(b.text)')})"


@query("jaccard_words", f"""SELECT conv_id, turn, round({jaccard('x', 'y')}, 6) AS similarity FROM (
    SELECT a.conv_id, a.turn, {A} AS x, {B} AS y FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)""")
def jaccard_words(spark, sf):
    turns = inputs.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return turns.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(tx.jaccard_words(F.col("text"), F.col("reply")), 6).alias("similarity"))


@query("word_set", f"SELECT doc_id, len(w) AS n, array_to_string(list_sort(w), ' ') AS words FROM (SELECT doc_id, {word_set('text')} AS w FROM documents)")
def word_set_(spark, sf):
    rows = inputs.table(spark, sf, "documents").select("doc_id", tx.word_set(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("bigint").alias("n"), F.array_join(F.array_sort("w"), " ").alias("words"))


@query("is_hook", f"SELECT conv_id, turn, {is_hook('text')} AS hook, {has_number('text')} AS has_number FROM conversations")
def is_hook_(spark, sf):
    return inputs.table(spark, sf, "conversations").select("conv_id", "turn", tx.is_hook(F.col("text")).alias("hook"), tx.has_number(F.col("text")).alias("has_number"))


@query("first_word", f"SELECT conv_id, turn, {first_word('text')} AS first_word, {opens_cleanly('text')} AS start_clean, {ends_sentence('text')} AS end_clean FROM conversations")
def first_word_(spark, sf):
    text = F.col("text")
    return inputs.table(spark, sf, "conversations").select("conv_id", "turn", tx.first_word(text).alias("first_word"), tx.opens_cleanly(text).alias("start_clean"),
                                                           tx.ends_sentence(text).alias("end_clean"))


SCORE_COLUMNS = ", ".join(f"{factor_of(f)} AS {f}" for f in lx.FACTORS)


@query("mock_scores", f"SELECT doc_id, {SCORE_COLUMNS} FROM (SELECT doc_id, {code_sum('text')} AS h FROM documents)")
def mock_scores(spark, sf):
    rows = inputs.table(spark, sf, "documents").select("doc_id", scoring.mock_scores(F.col("text")).alias("m"))
    return rows.select("doc_id", *[F.col("m")[f].alias(f) for f in lx.FACTORS])


def _any(phrases):
    return "(" + " OR ".join(f"contains(low, {q(p)})" for p in phrases) + ")"


def _move(name):
    parts = {
        "hook_strength": [("filler", -2), ("strong", 1), ("num", 1)], "first_3_second_hook": [("filler", -2), ("strong", 1)],
        "curiosity_gap": [("question", 1), ("prediction", 0.5), ("secret", 1)], "controversy": [("conflict", 1), ("mistake", 1)],
        "surprise": [("surprised", 1)], "emotional_intensity": [("mistake", 1)]}.get(name, [])
    body = factor_of(name) + "".join(f" + CASE WHEN {t} THEN {d}e0 ELSE 0e0 END" for t, d in parts)
    return f"greatest(1e0, least(10e0, {body}))"


RULED = f"""SELECT *, {", ".join(f"{_move(f)} AS {f}" for f in lx.FACTORS)} FROM (
    SELECT *, list_contains({listing(lx.OPENING_FILLERS)}, first) AS filler, list_contains({listing(lx.OPENING_STRONG)}, first) AS strong,
           list_contains({listing(lx.OPENING_QUESTIONS)}, first) AS question, {_any(lx.CONFLICT_PHRASES)} AS conflict, {_any(lx.SURPRISE_PHRASES)} AS surprised,
           {_any(lx.PREDICTION_PHRASES)} AS prediction, {_any(lx.MISTAKE_PHRASES)} AS mistake, {_any(lx.SECRET_PHRASES)} AS secret,
           {has_number('low')} OR {_any(lx.NUMBER_PHRASES)} AS num
    FROM (SELECT clip_id, h, {strip('lower(text)')} AS low, coalesce(({tokens(f"lower({strip("regexp_extract(text, '^[^.!?]*')")})")})[1], '') AS first FROM clips))"""


@query("virality_score", with_views("SELECT clip_id, " + ", ".join(lx.FACTORS) + ", round(0e0 + " + " + ".join(f"{f} * {w}e0" for f, w in lx.WEIGHTS_A.items())
                                    + ", 2) AS virality_score FROM ruled", "clips", ruled=RULED))
def virality_score(spark, sf):
    out = scorer.with_virality(inputs.clips(spark, sf))
    return out.select("clip_id", "adjusted.*", "virality_score")


@query("custom_scorer", with_views("SELECT clip_id, shares > likes AS failed, CASE WHEN shares > likes THEN virality_score ELSE round(0e0 + "
                                   + " + ".join(f"r.{f} * {w}e0" for f, w in lx.WEIGHTS_A.items()) + ", 2) END AS virality_score FROM clips JOIN ruled r USING (clip_id)",
                                   "clips", ruled=RULED))
def custom_scorer(spark, sf):
    """A scorer of the user's own, which fails for clips with more shares than likes."""
    own = lambda df: df.withColumn("detailed_scores", F.when(F.col("shares") <= F.col("likes"), F.col("detailed_scores")))
    return scorer.score_candidates(inputs.clips(spark, sf), own).select("clip_id", "failed", "virality_score")


@query("assign_variant", with_views("""SELECT clip_id, variant_id, variant_id AS scoring_version, 'prompt_v1' AS prompt_version,
    CASE variant_id WHEN 'A' THEN 'weight_v1_baseline' ELSE 'weight_v2_high_hook' END AS weight_version FROM clips""", "clips"))
def assign_variant(spark, sf):
    return scorer.assign_variant(inputs.clips(spark, sf).drop("variant_id"), scorer.arm_table(spark)).select(
        "clip_id", "variant_id", "scoring_version", "prompt_version", "weight_version")


# Mood JSON of every event: the type picks a mood, the value the numbers; errors carry broken fields.
@query("sanitize_emotion", """SELECT event_id, CASE event_type WHEN 'view' THEN 'calm' WHEN 'click' THEN 'urgent' ELSE 'motivational' END AS emotion,
    CASE WHEN event_type = 'error' THEN 6 ELSE greatest(1, least(10, floor(value)::INTEGER)) END AS energy_level,
    CASE WHEN event_type IN ('signup', 'purchase') THEN 'uplifting background music' ELSE event_type END AS music_description,
    CASE WHEN event_type = 'purchase' THEN 8 ELSE greatest(6, least(10, floor(value / 10)::INTEGER)) END AS volume_pct,
    round(greatest(0.5e0, least(2e0, value / 50)), 4) AS fade_in_secs, CASE WHEN event_type = 'click' THEN 2e0 ELSE round(greatest(1e0, least(3e0, value / 30)), 4) END AS fade_out_secs
    FROM events""")
def sanitize_emotion(spark, sf):
    value, kind = F.col("value"), F.col("event_type")
    mood = F.when(kind == "view", '"calm"').when(kind == "click", '"urgent"').when(kind == "signup", '"chaotic"').otherwise("7")
    doc = F.concat(F.lit('{"emotion": '), mood, F.lit(', "energy_level": '), F.when(kind == "error", '"high"').otherwise(value.cast("string")),
                   F.when(kind == "purchase", "").otherwise(F.concat(F.lit(', "volume_pct": '), (value / 10).cast("string"))),
                   F.lit(', "music_description": '), F.when(kind == "signup", '"  "').when(kind == "purchase", "5").otherwise(F.concat(F.lit('"'), kind, F.lit(' "'))),
                   F.lit(', "fade_in_secs": '), (value / 50).cast("string"), F.lit(', "fade_out_secs": '),
                   F.when(kind == "click", "null").otherwise((value / 30).cast("string")), F.lit("}"))
    out = inputs.table(spark, sf, "events").select("event_id", sn.sanitize_emotion(doc).alias("m")).select("event_id", "m.*")
    return out.withColumns({"fade_in_secs": F.round("fade_in_secs", 4), "fade_out_secs": F.round("fade_out_secs", 4)})


MOODS = " ".join(f"WHEN {q(e)} THEN {q(c)}" for e, c in lx.EMOTION_CATEGORY.items())
MOOD_OF = f"({listing(lx.EMOTIONS + ['unknown'])})[1 + k % 11]"


@query("emotion_category", f"SELECT event_id, CASE mood {MOODS} ELSE 'corporate' END AS category FROM (SELECT event_id, {MOOD_OF} AS mood FROM (SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k FROM events))")
def emotion_category(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    mood = F.initcap(F.get(tx.words_of(lx.EMOTIONS + ["unknown"]), k % 11))
    return inputs.table(spark, sf, "events").select("event_id", sn.emotion_category(mood).alias("category"))


@query("adaptive_gain", "SELECT event_id, greatest(0e0, least(12e0, -14e0 - (value - 60))) AS gain_db FROM events")
def adaptive_gain(spark, sf):
    return inputs.table(spark, sf, "events").select("event_id", sn.adaptive_gain(F.col("value") - 60).alias("gain_db"))


@query("sanitize_moments", """SELECT event_id, CASE WHEN event_type = 'signup' THEN 0 ELSE 3 END AS n, CASE WHEN event_type = 'signup' THEN '' ELSE
    CASE WHEN event_type = 'view' THEN 'early' ELSE 'middle' END || ':' || event_type || ':ding|late:' || user_id || ':impact|middle::impact' END AS moments FROM events""")
def sanitize_moments(spark, sf):
    kind = F.col("event_type")
    hint = F.when(kind == "view", "early").otherwise("soon")
    listed = F.concat(F.lit('[{"timestamp_hint": "'), hint, F.lit('", "word": " '), kind, F.lit('", "effect_type": "ding"}, {"timestamp_hint": "late", "word": "'),
                      F.col("user_id").cast("string"), F.lit('", "effect_type": "boom"}, {"word": ""}, {"timestamp_hint": "late", "word": "x", "effect_type": "ding"}]'))
    doc = F.when(kind == "click", F.concat(F.lit('{"moments": '), listed, F.lit("}"))).when(kind == "signup", "no moments").otherwise(listed)
    rows = inputs.table(spark, sf, "events").select("event_id", sn.sanitize_moments(doc).alias("m"))
    return rows.select("event_id", F.size("m").alias("n"), F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["timestamp_hint"], x["word"], x["effect_type"])), "|").alias("moments"))


@query("hint_seconds", """SELECT event_id, round(greatest(0.5e0, least(value * CASE event_type WHEN 'view' THEN 0.2e0 WHEN 'click' THEN 0.8e0 ELSE 0.5e0 END, value - 0.5e0)), 6) AS at_seconds FROM events""")
def hint_seconds(spark, sf):
    hint = F.when(F.col("event_type") == "view", "early").when(F.col("event_type") == "click", "late").otherwise("whenever")
    return inputs.table(spark, sf, "events").select("event_id", F.round(sn.hint_seconds(hint, F.col("value")), 6).alias("at_seconds"))


@query("overlay_times", """SELECT event_id, n, round(value * s, 6) AS at_seconds FROM (
    SELECT event_id, value, unnest(f) AS s, unnest(range(len(f))) AS n FROM (SELECT *, CASE WHEN value < 15 THEN [0.5e0] WHEN value <= 30 THEN [0.25e0, 0.75e0] ELSE [0.15e0, 0.5e0, 0.85e0] END AS f FROM events))
    WHERE value * s >= 0.5 AND value * s + 2.5e0 <= value - 0.5e0""")
def overlay_times(spark, sf):
    value = F.col("value")
    rows = inputs.table(spark, sf, "events").select("event_id", "value", F.explode(sn.overlay_times(value)).alias("t"))
    share = F.round(F.col("t") / F.col("value"), 2)
    n = F.when(value < 15, 0).when(value <= 30, F.when(share < 0.5, 0).otherwise(1)).otherwise(F.when(share < 0.3, 0).when(share < 0.6, 1).otherwise(2))
    return rows.select("event_id", n.cast("bigint").alias("n"), F.round("t", 6).alias("at_seconds"))


PACKAGE = "struct<titles:array<string>,description:string,hashtags:array<string>,keywords:array<string>," + ",".join(f"{k}:string" for k in lx.PACKAGE_TEXT_DEFAULTS) + ">"


def _package(kind):
    """Upload package JSON of a clip: complete parts for some arms, empty ones for others."""
    doc = F.when(kind == "A", F.to_json(F.struct(F.array("title").alias("titles"), F.lit("").alias("description"), F.array(F.lit("#a"), F.lit("#b")).alias("hashtags"), F.col("video_id").alias("category"))))
    return F.from_json(F.coalesce(doc, F.lit("{}")), PACKAGE)


@query("package_defaults", with_views(f"""SELECT clip_id, CASE WHEN variant_id = 'A' THEN title ELSE 'Secret Reveal: ' || substr(title, 1, 40) END AS first_title,
    {q(lx.PACKAGE_DESCRIPTION)} AS description, CASE WHEN variant_id = 'A' THEN '#a #b' ELSE {q(' '.join(lx.PACKAGE_HASHTAGS))} END AS hashtags,
    CASE WHEN variant_id = 'A' THEN video_id ELSE 'Education' END AS category, {q(' '.join(lx.PACKAGE_KEYWORDS))} AS keywords, 'TRUTH EXPOSED' AS thumbnail_text FROM clips""", "clips"))
def package_defaults(spark, sf):
    full = inputs.clips(spark, sf).withColumn("p", sn.package_defaults(_package(F.col("variant_id")), F.col("title")))
    return full.select("clip_id", F.get("p.titles", F.lit(0)).alias("first_title"), "p.description", F.array_join("p.hashtags", " ").alias("hashtags"), "p.category",
                       F.array_join("p.keywords", " ").alias("keywords"), "p.thumbnail_text")


@query("upload_snippet", with_views("""SELECT clip_id, substr(CASE WHEN variant_id = 'A' AND title <> '' THEN title ELSE coalesce(nullif(text, ''), 'Highlight Clip ' || clip_id) END, 1, 100) AS title,
    CASE WHEN variant_id = 'A' THEN chr(10) || chr(10) || '#a #b' ELSE substr(coalesce(nullif(text, ''), 'Check out this highlight clip!'), 1, 5000) END AS description,
    CASE WHEN variant_id = 'A' THEN '#a,#b,Shorts' ELSE 'SHORTS,' || video_id END AS tags FROM clips""", "clips"))
def upload_snippet(spark, sf):
    tags = F.array(F.lit("SHORTS"), F.col("video_id"))
    made = sn.upload_snippet(F.col("clip_id"), _package(F.col("variant_id")), F.col("text"), F.col("text"), tags, direct=True)
    return inputs.clips(spark, sf).select("clip_id", made.alias("s")).select("clip_id", "s.title", "s.description", F.array_join("s.tags", ",").alias("tags"))


@query("clip_key", with_views("SELECT clip_id, substr(sha256(video_id || '_' || title || '_' || printf('%.2f', duration) || '_' || printf('%.2f', duration * 2)), 1, 8) AS clip_key, "
                              "video_id || '_' || substr(sha256('{\"n\": ' || views || '}'), 1, 16) AS settings_key FROM clips", "clips"))
def clip_key(spark, sf):
    settings = F.concat(F.lit('{"n": '), F.col("views").cast("string"), F.lit("}"))
    return inputs.clips(spark, sf).select("clip_id", sn.clip_key(F.col("video_id"), F.col("title"), F.col("duration"), F.col("duration") * 2).alias("clip_key"),
                                          sn.settings_key(F.col("video_id"), settings).alias("settings_key"))


@query("youtube_derived", "SELECT event_id, round_even(value / 60 * 100, 0) / 100 AS watch_time, CASE WHEN event_type = 'view' THEN least(100e0, round_even(value / 30 * 100 * 100, 0) / 100) ELSE least(100e0, round_even(value / (user_id + 1e0) * 100 * 100, 0) / 100) END AS retention FROM events")
def youtube_derived(spark, sf):
    duration = F.when(F.col("event_type") == "view", 0.0).otherwise(F.col("user_id") + 1.0)
    return inputs.table(spark, sf, "events").select("event_id", sn.watch_hours(F.col("value")).alias("watch_time"), sn.retention_pct(F.col("value"), duration).alias("retention"))


DIS = {f: factor_of(f) for f in lx.FACTORS}


@query("disagreement_cause", with_views(f"""SELECT clip_id, CASE WHEN virality_score >= 7.5 AND creator_rejected THEN CASE WHEN {DIS['controversy']} >= 8 THEN {q(lx.CAUSE_CONTROVERSY)}
      WHEN {DIS['storytelling']} >= 8 AND {DIS['actionability']} <= 5 THEN {q(lx.CAUSE_NARRATIVE)} ELSE {q(lx.CAUSE_OVERVALUED)} END
    WHEN virality_score <= 5 AND creator_selected THEN CASE WHEN {DIS['actionability']} >= 7 AND {DIS['first_3_second_hook']} <= 5 THEN {q(lx.CAUSE_UTILITY)}
      WHEN {DIS['storytelling']} >= 7 AND {DIS['first_3_second_hook']} <= 5 THEN {q(lx.CAUSE_SLOW_STORY)} ELSE {q(lx.CAUSE_NICHE)} END END AS cause FROM clips""", "clips"))
def disagreement_cause(spark, sf):
    return inputs.clips(spark, sf).select("clip_id", scoring.disagreement_cause(F.col("virality_score"), F.col("creator_selected"), F.col("creator_rejected"), F.col("detailed_scores")).alias("cause"))


@query("line_label", with_views("SELECT video_id, line_idx, '[' || line_idx || '] [' || printf('%.2f', start) || ' - ' || printf('%.2f', start + duration) || '] ' || text AS label FROM lines", "lines"))
def line_label(spark, sf):
    return inputs.lines(spark, sf).select("video_id", "line_idx", tx.line_label(F.col("line_idx"), F.col("start"), F.col("start") + F.col("duration"), F.col("text")).alias("label"))


BOX = "(CASE WHEN w > 0 AND h > 0 THEN w * h ELSE 0e0 END)"


@query("iou", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN u > 0 THEN round({BOX} / u, 6) ELSE 0e0 END AS iou FROM (
    SELECT *, l_quantity * l_quantity + 900 - {BOX} AS u FROM (
      SELECT *, greatest(0e0, least(x + l_quantity, 60e0) - greatest(x, 30e0)) AS w, greatest(0e0, least(y + l_quantity, 60e0) - greatest(y, 30e0)) AS h
      FROM (SELECT *, (l_partkey % 50)::DOUBLE AS x, (l_suppkey % 50)::DOUBLE AS y FROM lineitem)))""")
def iou(spark, sf):
    size = F.col("l_quantity")
    a = {"x": (F.col("l_partkey") % 50).cast("double"), "y": (F.col("l_suppkey") % 50).cast("double"), "w": size, "h": size}
    b = {k: F.lit(30.0) for k in "xywh"}
    return inputs.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.round(stats.box_iou(a, b), 6).alias("iou"))
