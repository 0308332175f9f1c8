"""Event-sourced state, upserts, channel matching and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkreel import lexicon as lx
from sparkreel.functions import scoring, text as tx
from sparkreel.operators import joins, ordered, state, subtitles as sb
from sparkreel.plans import inputs
from sparkreel.plans.registry import query
from sparkreel.plans.views import VIEWS, jaccard, listing, q, tokens, with_views

# Saved metadata: every document once at the start, and labelled ones again on a later day.
VIEWS["saved"] = ([], """
    SELECT 'c' || doc_id AS clip_id, 0::BIGINT AS ts, doc_id AS seq, source AS video_id, n_chars FROM documents
    UNION ALL SELECT 'c' || doc_id, epoch_us(TIMESTAMP '2024-01-02') + (n_chars % 20) * 86400000000, doc_id, source, n_chars + 1 FROM documents JOIN labels USING (doc_id)""")
EVENT_TIME = "SELECT 'c' || user_id AS clip_id, epoch_us(ts) AS ts, event_id AS seq, * EXCLUDE (ts) FROM events"


def _event_tables(spark, sf):
    docs, labels = inputs.table(spark, sf, "documents"), inputs.table(spark, sf, "labels")
    clip = F.concat(F.lit("c"), "doc_id").alias("clip_id")
    first = docs.select(clip, F.lit(0).cast("bigint").alias("ts"), F.col("doc_id").alias("seq"), F.col("source").alias("video_id"), "n_chars")
    later = F.lit(1704153600000000) + F.pmod("n_chars", F.lit(20)) * 86400000000
    again = docs.join(labels, "doc_id").select(clip, later.alias("ts"), F.col("doc_id").alias("seq"), F.col("source").alias("video_id"), (F.col("n_chars") + 1).alias("n_chars"))
    ev = inputs.table(spark, sf, "events").withColumns({
        "clip_id": F.concat(F.lit("c"), "user_id"), "at": inputs.micros(F.col("ts"))})
    kind = F.col("event_type")
    head = ["clip_id", F.col("at").alias("ts"), F.col("event_id").alias("seq")]
    metrics = ev.where(kind == "view").select(*head, F.get_json_object("props", "$.k").cast("bigint").alias("views"), F.col("event_id").alias("likes"),
                                              (F.col("value") / 60).alias("watch_time"), F.col("value").alias("retention"))
    high = F.col("value") > 30
    flag = lambda name: F.when(kind == name, high)
    actions = ev.where(kind.isin("click", "signup", "purchase")).select(
        *head, flag("click").alias("selected"), flag("signup").alias("rejected"), flag("purchase").alias("published"))
    feedback = ev.where(kind == "error").select(*head, F.get(tx.words_of(lx.FEEDBACK_VALUES), (F.col("event_id") % 4).cast("int")).alias("feedback"))
    return first.unionByName(again), metrics, actions, feedback


def _newest(value, where):
    return f"(SELECT arg_max({value}, [e.ts, e.seq]) FROM ev e WHERE e.clip_id = m.clip_id AND e.ts >= m.since AND {where})"


@query("current_clips", with_views(f"""
    SELECT m.clip_id, video_id, n_chars, coalesce(v.views, 0) AS views, coalesce(v.likes, 0) AS likes, coalesce(v.retention, 0) AS retention,
           coalesce(s.f, false) AS selected, coalesce(r.f, false) AS rejected, coalesce(p.f, false) AS published, fb.feedback
    FROM meta m
    LEFT JOIN (SELECT clip_id, arg_max(CAST(json_extract_string(props, '$.k') AS BIGINT), seq) AS views, arg_max(seq, seq) AS likes, arg_max(value, seq) AS retention FROM live WHERE event_type = 'view' GROUP BY 1) v USING (clip_id)
    LEFT JOIN (SELECT clip_id, arg_max(value > 30, seq) AS f FROM live WHERE event_type = 'click' GROUP BY 1) s USING (clip_id)
    LEFT JOIN (SELECT clip_id, arg_max(value > 30, seq) AS f FROM live WHERE event_type = 'signup' GROUP BY 1) r USING (clip_id)
    LEFT JOIN (SELECT clip_id, arg_max(value > 30, seq) AS f FROM live WHERE event_type = 'purchase' GROUP BY 1) p USING (clip_id)
    LEFT JOIN (SELECT clip_id, arg_max(({listing(lx.FEEDBACK_VALUES)})[1 + seq % 4], seq) AS feedback FROM live WHERE event_type = 'error' GROUP BY 1) fb USING (clip_id)""",
    "saved", meta="SELECT clip_id, max(ts) AS since, arg_max(video_id, ts) AS video_id, arg_max(n_chars, ts) AS n_chars FROM saved GROUP BY clip_id",
    ev=EVENT_TIME, live="SELECT ev.* FROM ev JOIN meta USING (clip_id) WHERE ev.ts >= since"))
def current_clips(spark, sf):
    return state.current_clips(*_event_tables(spark, sf)).drop("watch_time")


@query("upsert_snapshots", """SELECT 'c' || user_id AS clip_id, (epoch_us(date_trunc('day', ts)) // 1000000)::BIGINT AS snapshot_time,
    arg_max(value, event_id) AS watch_time, max(event_id) AS ingested FROM events GROUP BY ALL""")
def upsert_snapshots(spark, sf):
    day = F.floor(inputs.micros(F.col("ts")) / 86400000000) * 86400
    rows = inputs.table(spark, sf, "events").select(F.concat(F.lit("c"), "user_id").alias("clip_id"), day.alias("snapshot_time"),
                                                    F.col("value").alias("watch_time"), F.col("event_id").alias("ingested"), "event_type")
    old, new = rows.where("event_type <> 'view'").drop("event_type"), rows.where("event_type = 'view'").drop("event_type")
    return state.upsert_snapshots(old, new)


@query("upsert_transcript_metrics", """SELECT 'v' || user_id AS video_id, arg_max(event_type, event_id) AS source, arg_max(value, event_id) AS duration,
    max(event_id) AS created_at FROM events GROUP BY user_id""")
def upsert_transcript_metrics(spark, sf):
    rows = inputs.table(spark, sf, "events").select(F.concat(F.lit("v"), "user_id").alias("video_id"), F.col("event_type").alias("source"),
                                                    F.col("value").alias("duration"), F.col("event_id").alias("created_at"))
    return state.upsert_transcript_metrics(rows.where("source <> 'error'"), rows.where("source = 'error'"))


# Channel uploads: every benchmark passage and every page, titled by its first sentence or <title>.
VIEWS["channel"] = ([], r"""
    SELECT 'b' || item_id AS id, regexp_extract(text, '^[^.!?\n]*') AS title FROM benchmark
    UNION ALL SELECT 'p' || page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) FROM pages
    UNION ALL SELECT 'd' || doc_id, regexp_extract(text, '^[^.!?\n]*') FROM documents""")
VIEWS["stock"] = (["clips"], "SELECT clip_id, doc_id AS ord, title, video_id || ' ' || title AS shorts_title, CASE WHEN published THEN 'd' || doc_id END AS youtube_video_id, published FROM clips")
TITLE_WORDS = lambda t: f"list_distinct({tokens(f'lower({t})')})"
MATCHES = f"""SELECT id, arg_min(clip_id, [rank, ord]) AS clip_id, CASE WHEN min(rank) = 0 THEN 'id' ELSE 'title' END AS matched_by FROM (
    SELECT id, clip_id, ord, 0::BIGINT AS rank FROM channel JOIN stock ON youtube_video_id = id
    UNION ALL SELECT id, clip_id, ord, 1 FROM (SELECT id, {TITLE_WORDS('title')} AS w FROM channel) c
        JOIN (SELECT clip_id, ord, unnest([{TITLE_WORDS('title')}, {TITLE_WORDS('shorts_title')}]) AS w FROM stock) s
        ON len(list_intersect(c.w, s.w)) > 0 WHERE {jaccard('c.w', 's.w')} > 0.6e0) GROUP BY id"""


def channel(spark, sf):
    head = tx.headline(F.col("text"))
    bench = inputs.table(spark, sf, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), head.alias("title"))
    pages = inputs.table(spark, sf, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    docs = inputs.table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), head.alias("title"))
    return bench.unionByName(pages).unionByName(docs).withColumn("desc", F.lit("uploaded"))


def stock(spark, sf):
    clips = inputs.clips(spark, sf)
    return clips.select("clip_id", F.col("doc_id").alias("ord"), "title", F.concat_ws(" ", "video_id", "title").alias("shorts_title"),
                        F.when(F.col("published"), F.concat(F.lit("d"), "doc_id")).alias("youtube_video_id"), "published")


@query("match_channel", with_views("SELECT * FROM matches", "channel", "stock", matches=MATCHES))
def match_channel(spark, sf):
    return joins.match_channel(channel(spark, sf), stock(spark, sf))


@query("publish_update", with_views("""SELECT clip_id, id AS youtube_video_id, 'https://youtu.be/' || id AS youtube_url, true AS published
    FROM stock JOIN (SELECT clip_id, max(id) AS id FROM matches GROUP BY 1) USING (clip_id) WHERE youtube_video_id IS DISTINCT FROM id OR NOT published""",
    "channel", "stock", matches=MATCHES))
def publish_update(spark, sf):
    clips = stock(spark, sf)
    return state.publish_update(clips, joins.match_channel(channel(spark, sf), clips))


@query("register_external", with_views("""SELECT 'yt_' || substr(id, 1, 8) AS clip_id, 'external_uploads' AS video_id, 6e0 AS virality_score, title, 30e0 AS duration,
    'https://youtu.be/' || id AS youtube_url, 'external,youtube' AS shorts_tags FROM channel ANTI JOIN matches USING (id)""", "channel", "stock", matches=MATCHES))
def register_external(spark, sf):
    videos = channel(spark, sf)
    out = state.register_external(videos, joins.match_channel(videos, stock(spark, sf)))
    return out.select("clip_id", "video_id", "virality_score", "title", "duration", "youtube_url", F.array_join("shorts_tags", ",").alias("shorts_tags"))


CHECKED = """SELECT event_id, concat_ws(',', CASE WHEN views < 0 THEN 'views' END, CASE WHEN watch_time < 0 THEN 'watch_time' END,
      CASE WHEN contains(clip_id, ' ') THEN 'clip_id' END, CASE WHEN feedback = 'Bad' THEN 'feedback' END) AS errors
    FROM (SELECT event_id, k - 10 AS views, value - 5 AS watch_time, CASE WHEN k > 90 THEN 'clip ' ELSE 'clip-' END || user_id AS clip_id,
                 CASE event_type WHEN 'error' THEN 'Bad' WHEN 'view' THEN 'Great' END AS feedback
          FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def _submissions(spark, sf):
    k, kind = F.get_json_object("props", "$.k").cast("bigint"), F.col("event_type")
    none = F.lit(0)
    return inputs.table(spark, sf, "events").select(
        "event_id", (k - 10).alias("views"), none.alias("likes"), none.alias("comments"), none.alias("shares"), (F.col("value") - 5).alias("watch_time"),
        F.lit(0.0).alias("retention"), F.concat(F.when(k > 90, "clip ").otherwise("clip-"), "user_id").alias("clip_id"),
        F.when(kind == "error", "Bad").when(kind == "view", "Great").alias("feedback"))


@query("validate_metrics", f"SELECT event_id, errors, errors = '' AS accepted FROM ({CHECKED})")
def validate_metrics(spark, sf):
    good, bad = state.validate_metrics(_submissions(spark, sf))
    return good.select("event_id", F.lit("").alias("errors"), F.lit(True).alias("accepted")).unionByName(
        bad.select("event_id", F.array_join("errors", ",").alias("errors"), F.lit(False).alias("accepted")))


NOW = "epoch_us(TIMESTAMP '2024-01-15 12:00:00') / 1e6"


@query("retained", with_views(f"""SELECT job_id, event_id, status FROM (SELECT *, CASE WHEN progress = 0 THEN NULL ELSE {NOW} - epoch_us(ts) / 1e6 END AS age FROM job_events)
    WHERE NOT CASE WHEN age IS NULL THEN status IN ('completed', 'failed') WHEN status IN ('completed', 'failed') THEN age > 3600 ELSE age > 10800 END""", "job_events"))
def retained(spark, sf):
    jobs = inputs.job_events(spark, sf)
    dated = jobs.withColumn("created_at", F.when(F.col("progress") == 0, F.lit(0.0)).otherwise(inputs.micros(F.col("ts")) / 1e6))
    return state.retained(dated, F.lit(1705320000.0)).select("job_id", "event_id", "status")


@query("dedup_submissions", with_views("""SELECT video_id, arg_min(event_id, event_id) AS seq, arg_min(status, event_id) AS status
    FROM (SELECT substr(md5(job_id), 1, 11) AS video_id, * FROM job_events) WHERE status <> 'failed' GROUP BY video_id""", "job_events"))
def dedup_submissions(spark, sf):
    url = F.concat(F.lit("https://youtu.be/"), F.substring(F.md5("job_id"), 1, 11))
    jobs = inputs.job_events(spark, sf).select(tx.video_id(url).alias("video_id"), "ts", F.col("event_id").alias("seq"), "status")
    return state.dedup_submissions(jobs).select("video_id", "seq", "status")


@query("carry_forward", with_views("""SELECT clip_id, CASE WHEN shares > likes THEN views ELSE views + 100 END AS views, shares > likes AS ok,
    CASE WHEN shares > likes THEN retention ELSE retention / 2 END AS retention FROM clips""", "clips"))
def carry_forward(spark, sf):
    clips = inputs.clips(spark, sf)
    fetched = clips.select("clip_id", (F.col("shares") > F.col("likes")).alias("ok"), "views", "retention")
    previous = clips.select("clip_id", (F.col("views") + 100).alias("views"), (F.col("retention") / 2).alias("retention"))
    return state.carry_forward(fetched, previous, ["views", "retention"])


# Lookups fetch the clips of every labelled document, so they run over the whole label table.
WANTED = "SELECT 'c' || doc_id AS clip_id FROM labels"


@query("scan_clips", with_views("SELECT clip_id, video_id, views, published FROM clips", "clips"))
def scan_clips(spark, sf):
    from sparkreel.sources.clips import scan_clips as scan
    return scan(inputs.clips(spark, sf)).select("clip_id", "video_id", "views", "published")


@query("clips_by_video", with_views("SELECT video_id, clip_id, virality_score, h % 7 + 3e0 AS hook_strength FROM clips WHERE video_id IN (SELECT source FROM documents JOIN labels USING (doc_id))", "clips"))
def clips_by_video(spark, sf):
    from sparkreel.sources.clips import clips_by_video as lookup
    wanted = inputs.table(spark, sf, "documents").join(inputs.table(spark, sf, "labels"), "doc_id").select(F.col("source").alias("video_id"))
    raw = inputs.clips(spark, sf).withColumn("detailed_scores", F.to_json("detailed_scores"))
    return lookup(raw, wanted).select("video_id", "clip_id", "virality_score", F.col("detailed_scores")["hook_strength"].alias("hook_strength"))


@query("clip_by_id", with_views("SELECT clip_id, title, CASE WHEN views > 0 THEN h % 7 + 3e0 END AS hook_strength FROM clips WHERE clip_id IN (SELECT clip_id FROM wanted)", "clips", wanted=WANTED))
def clip_by_id(spark, sf):
    from sparkreel.sources.clips import clips_by_id
    wanted = inputs.table(spark, sf, "labels").select(F.concat(F.lit("c"), "doc_id").alias("clip_id"))
    raw = inputs.clips(spark, sf).withColumn("detailed_scores", F.when(F.col("views") > 0, F.to_json("detailed_scores")).otherwise("{bad"))
    return clips_by_id(raw, wanted).select("clip_id", "title", F.col("detailed_scores")["hook_strength"].alias("hook_strength"))


@query("snapshots_of", with_views("SELECT clip_id, event_id, views, watch_time FROM snapshots WHERE clip_id IN (SELECT clip_id FROM wanted)", "snapshots", wanted=WANTED))
def snapshots_of(spark, sf):
    from sparkreel.sources.clips import snapshots_of as lookup
    wanted = inputs.table(spark, sf, "labels").select(F.concat(F.lit("c"), "doc_id").alias("clip_id"))
    return lookup(inputs.snapshots(spark, sf), wanted).select("clip_id", "event_id", "views", "watch_time")


@query("published_with_snapshots", with_views("""SELECT clip_id, day, page, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS series
    FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS day, (row_number() OVER (PARTITION BY clip_id, ts::DATE ORDER BY ts, event_id) - 1) // 1000 AS page
          FROM (SELECT clip_id, snapshot_time AS ts, event_id FROM snapshots)) JOIN (SELECT clip_id FROM clips WHERE published) USING (clip_id) GROUP BY ALL
    UNION ALL SELECT clip_id, NULL, NULL, 0, NULL FROM clips WHERE published AND clip_id NOT IN (SELECT clip_id FROM snapshots)""", "clips", "snapshots"))
def published_with_snapshots(spark, sf):
    out = joins.published_with_snapshots(inputs.clips(spark, sf).select("clip_id", "published"), inputs.snapshots(spark, sf))
    series = F.array_join(F.transform("snapshots", lambda s: s["event_id"].cast("string")), ",")
    return out.select("clip_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "page", F.coalesce(F.size("snapshots"), F.lit(0)).cast("bigint").alias("n"), series.alias("series"))


# Music library: parts are tracks, the type is the folder; small sizes lie in "default".
VIEWS["library"] = ([], "SELECT folder || '/' || p_partkey || '.mp3' AS path, folder AS category, p_partkey, p_brand, p_type, p_size FROM (SELECT *, CASE WHEN p_size < 5 THEN 'default' ELSE lower(p_type) END AS folder FROM part)")


def library(spark, sf):
    folder = F.when(F.col("p_size") < 5, "default").otherwise(F.lower("p_type"))
    return inputs.table(spark, sf, "part").select(F.concat(folder, F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".mp3")).alias("path"), folder.alias("category"), "p_partkey", "p_brand", "p_type", "p_size")


@query("assign_tracks", with_views("""SELECT clip_id, category, coalesce((SELECT min(path) FROM library l WHERE l.category = c.category), (SELECT min(path) FROM library WHERE category = 'default'),
    (SELECT min(path) FROM library)) AS track FROM (SELECT clip_id, CASE WHEN variant_id = 'A' THEN 'economy' WHEN published THEN 'standard' ELSE 'calm' END AS category FROM clips) c""", "clips", "library"))
def assign_tracks(spark, sf):
    category = F.when(F.col("variant_id") == "A", "economy").when(F.col("published"), "standard").otherwise("calm")
    return joins.assign_tracks(inputs.clips(spark, sf).select("clip_id", category.alias("category")), library(spark, sf))


@query("track_license", with_views("""SELECT path, CASE WHEN p_size < 15 THEN 'base ' || p_brand WHEN p_type = 'ECONOMY' THEN 'full ' || p_brand ELSE 'Unknown (Locally Placed)' END AS license,
    CASE WHEN p_size < 15 OR p_type = 'ECONOMY' THEN p_partkey END AS license_id FROM library""", "library"))
def track_license(spark, sf):
    tracks, key = library(spark, sf), F.col("p_partkey")
    base = tracks.where("p_size < 15").select(F.regexp_replace("path", "mp3$", "json").alias("path"), F.concat(F.lit("base "), "p_brand").alias("license"), key.alias("license_id"))
    full = tracks.where("p_type = 'ECONOMY'").select(F.concat("path", F.lit(".json")).alias("path"), F.concat(F.lit("full "), "p_brand").alias("license"), key.alias("license_id"))
    return joins.track_license(tracks.select("path"), base.unionByName(full)).select("path", "license", "license_id")


@query("unprocessed", "SELECT 'v' || doc_id AS video_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unprocessed(spark, sf):
    name = F.concat(F.lit("v"), "doc_id").alias("video_id")
    return joins.unprocessed(inputs.table(spark, sf, "documents").select(name), inputs.table(spark, sf, "labels").select(name))


# A job is an order: its lines are the clips of one request, at most a handful.
VIEWS["job_clips"] = ([], "SELECT l_orderkey AS job_id, rn AS seq, l_orderkey || '-' || rn AS clip_id, CASE l_returnflag WHEN 'A' THEN 'economy' WHEN 'N' THEN 'standard' ELSE 'default' END AS category "
                          "FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem)")


@query("fifo_track_choice", with_views("""SELECT job_id, p.clip_id AS clip_id, p.track AS track FROM (SELECT job_id, unnest(arg_max(out, seq)) AS p FROM walk GROUP BY job_id)""", "job_clips", "library",
    tracks="SELECT category, list_sort(list(path)) AS tracks FROM library GROUP BY category",
    walk="""SELECT job_id, 0::BIGINT AS seq, []::VARCHAR[] AS used, []::STRUCT(clip_id VARCHAR, track VARCHAR)[] AS out FROM (SELECT DISTINCT job_id FROM job_clips)
        UNION ALL SELECT job_id, seq, list_append(used, t)[-5:], list_append(out, {'clip_id': clip_id, 'track': t}) FROM (
          SELECT w.job_id, c.seq, used, out, clip_id, coalesce(list_filter(tracks, lambda x: NOT list_contains(used, x))[1], tracks[1]) AS t
          FROM walk w JOIN job_clips c ON c.job_id = w.job_id AND c.seq = w.seq + 1 JOIN tracks USING (category))"""))
def fifo_track_choice(spark, sf):
    from pyspark.sql import Window
    flag = F.col("l_returnflag")
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    clips = inputs.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), seq.alias("seq"), F.concat_ws("-", "l_orderkey", seq).alias("clip_id"),
                                                       F.when(flag == "A", "economy").when(flag == "N", "standard").otherwise("default").alias("category"))
    return sb.fifo_track_choice(clips, library(spark, sf))
