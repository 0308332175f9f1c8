"""The numbered queries: each maps the given tables to an operator of this package and its results back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkreel.llm import (attribution, decontamination, fixity, manifest, near_duplicates, near_vectors, packing, personal_data, ranked_search,
                           repeated_text, sharding, toxicity, url_rules)
from sparkreel.llm.records import read, transcripts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn
    return register


@query()
def op3_shard_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("transcript", F.lit(""))
    rows = transcripts(read(spark, sf_dir, "documents")).select(
        "video_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharding.shuffle_into_shards(rows, shards=16).select(
        F.col("video_id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


#: The rules of the query.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
             ("com", "/de/", "block")]

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


@query(f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULE_ROWS}),
pages_ AS (SELECT page_id,
        translate(regexp_extract(coalesce(url, ''), '^(.*?)://([^/?#]*)([^?#]*)', 2, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '^(.*?)://([^/?#]*)([^?#]*)', 3, 's') AS path FROM pages),
best AS (SELECT host, path, max(struct_pack(n := length(rule_host) + length(rule_path), h := length(rule_host), v := rule_verdict,
               r := rule_host || rule_path)) AS b
         FROM (SELECT DISTINCT host, path FROM pages_) JOIN rules
         ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY ALL)
SELECT page_id, host, path, b.r AS rule, coalesce(b.v, 'allow') AS verdict FROM pages_ LEFT JOIN best USING (host, path)
""")
def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    uploads = read(spark, sf_dir, "pages").select(F.col("page_id").alias("clip_id"), F.col("url").alias("youtube_url"))
    rules = spark.sql(f"SELECT * FROM VALUES {_RULE_ROWS} AS r(host, path, verdict)")
    return url_rules.url_verdicts(uploads, rules).select(F.col("clip_id").alias("page_id"), "host", "path", "rule", "verdict")


@query()
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find_personal_data(transcripts(read(spark, sf_dir, "documents")))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == personal_data.KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")
    return found.select(F.col("video_id").alias("doc_id"), *map(count, personal_data.KINDS),
                        F.sha2(personal_data.span_list(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        personal_data.span_list(F.col("spans")).alias("spans"))


@query()
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(transcripts(read(spark, sf_dir, "documents")), words=4).withColumnRenamed("video_id", "doc_id")


@query()
def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), F.col("embedding").alias("vector"), "label")
    return near_vectors.near_vectors(clips, cosine=0.98).withColumnRenamed("clip_id", "vec_id")


def _third(key: str):
    """crc32 of a key as text, modulo 3; rows where it is 1 are held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3, F.lit(0))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    learnt = read(spark, sf_dir, "labels").filter(_third("doc_id") != 1)
    return toxicity.fit(transcripts(docs), learnt.select(F.col("doc_id").alias("video_id"), "toxic"))


@query()
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(transcripts(docs), toxicity_model(spark, docs, sf_dir), fitted=True)
    return scored.select(F.col("video_id").alias("doc_id"), (_third("video_id") == 1).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


def _shingles(table: str, key: str) -> str:
    return f"""
        SELECT DISTINCT {key}, array_to_string(w[i + 1 : i + 5], ' ') AS shingle
        FROM (SELECT {key}, w, unnest(range(0, greatest(len(w) - 5, 0) + 1)) AS i
              FROM (SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table}) WHERE len(w) > 0)"""


@query(f"""
WITH parts AS ({_shingles('benchmark', 'item_id')}),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM parts GROUP BY 1),
held AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ({_shingles('documents', 'doc_id')}) JOIN parts USING (shingle) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM held JOIN sizes USING (item_id) WHERE n_shared * 100 >= n_shingles * 80
""")
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("clip_id"), "text")
    found = decontamination.contaminated(transcripts(read(spark, sf_dir, "documents")), held_out)
    return found.withColumnsRenamed({"video_id": "doc_id", "clip_id": "item_id"})


@query()
def op2_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(transcripts(read(spark, sf_dir, "documents"))).select(
        F.col("video_id").alias("doc_id"), "start", "length", "ids_crc32", F.col("tokens").alias("doc_tokens"), F.col("window_id").alias("sequence_id"), "offset")


#: Pages an archive holds, and the bytes reserved for each.
ARCHIVE_PAGES, SLOT = 1000, 1 << 20


def _warc(html: str) -> Column:
    """A WARC response record of a page."""
    body = F.coalesce(F.col(html), F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")), F.lit("\r\nContent-Length: "),
                    F.octet_length(body), F.lit("\r\n\r\n"), body)


@query(f"""
WITH records AS (SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: '
    || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' AS head, coalesce(html, '') AS body,
    chr(13) || chr(10) || chr(13) || chr(10) AS gap FROM pages),
sides AS (SELECT page_id, CASE WHEN page_id % 509 <> 3 THEN sha256(head || strlen(body) || gap || body) END AS l,
    CASE WHEN page_id % 503 <> 5 THEN sha256(head || strlen(b) || gap || b) END AS r
    FROM (SELECT *, CASE WHEN page_id % 499 = 7 THEN replace(body, '<p>', '<q>') ELSE body END AS b FROM records))
SELECT page_id, 'pages-' || (page_id // {ARCHIVE_PAGES}) AS archive, (page_id % {ARCHIVE_PAGES}) * {SLOT} AS record_offset,
    CASE WHEN l IS NULL THEN 'missing_left' WHEN r IS NULL THEN 'missing_right' ELSE 'changed' END AS status, l AS left_sha256, r AS right_sha256
FROM sides WHERE l IS DISTINCT FROM r
""")
def op6_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as an archive, against a replica in which pages were lost on either side and altered, by their numbers."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    place = [F.concat(F.lit("pages-"), F.floor(F.col("page_id") / ARCHIVE_PAGES)).alias("archive"),
             (F.col("page_id") % ARCHIVE_PAGES * SLOT).alias("record_offset")]
    left = pages.filter("page_id % 509 <> 3").select(*place, _warc("html").alias("payload"))
    altered = pages.withColumn("html", F.when(F.col("page_id") % 499 == 7, F.replace("html", F.lit("<p>"), F.lit("<q>"))).otherwise(F.col("html")))
    right = altered.filter("page_id % 503 <> 5").select(*place, _warc("html").alias("payload"))
    number = F.substring_index("archive", "-", -1).cast("bigint") * ARCHIVE_PAGES + (F.col("record_offset") / SLOT).cast("bigint")
    return fixity.audit_replicas(left, right).select(
        number.alias("page_id"), "archive", "record_offset", "status", F.col("left_digest").alias("left_sha256"), F.col("right_digest").alias("right_sha256"))


@query()
def op7_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.token_counts(transcripts(read(spark, sf_dir, "documents")), rule="first").withColumnRenamed("video_id", "doc_id")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query(f"""
WITH words AS (SELECT doc_id, unnest(t) AS term, len(t) AS n FROM (SELECT doc_id, {_TERMS} AS t FROM documents)),
counts AS (SELECT doc_id, term, n, count(*) AS tf FROM words GROUP BY ALL),
facts AS (SELECT count(DISTINCT doc_id) AS docs, count(*) AS tokens FROM words),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts CROSS JOIN facts GROUP BY term, docs),
named AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // tokens))))::BIGINT AS score
    FROM named JOIN counts USING (term) JOIN weights USING (term) CROSS JOIN facts GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
    FROM scored WHERE score > 0) WHERE rank <= 20
""")
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("clip_id"), "text")
    return ranked_search.rank_transcripts(transcripts(read(spark, sf_dir, "documents")), asked, limit=20).withColumnsRenamed(
        {"clip_id": "item_id", "video_id": "doc_id"})


def _counted(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({column}::VARCHAR) || ':' || {column} END"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_counted(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


#: crc32 (polynomial 0xEDB88320) of a short string of digits, bit by bit.
_CRC = """list_reduce(list_concat([4294967295::BIGINT], [ascii(x)::BIGINT for x in string_split(doc_id::VARCHAR, '')]),
    lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
        lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END))"""


@query(f"""
WITH RECURSIVE docs AS (SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf,
        CASE WHEN xor({_CRC}, 4294967295) % 7 = 0 THEN {_leaf_sql('(n_chars + 1)')} ELSE {_leaf_sql('n_chars')} END AS claimed FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM docs),
up AS (SELECT lang, 0 AS h, i, leaf AS d, n FROM leaves
    UNION ALL SELECT lang, h + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY lang, h, i // 2, n),
subs AS (SELECT lang, d AS subroot, h AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS h, i, subroot AS d, n FROM subs
    UNION ALL SELECT h + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY h, i // 2, n),
low AS (SELECT l.lang, l.i, u.h, CASE WHEN u.i % 2 = 0 THEN u.d ELSE '' END AS a, CASE WHEN u.i % 2 = 1 THEN u.d ELSE '' END AS z
    FROM leaves l JOIN up u ON u.lang IS NOT DISTINCT FROM l.lang AND u.i = xor(l.i >> u.h, 1)),
high AS (SELECT s.lang, t.h, CASE WHEN t.i % 2 = 0 THEN t.d ELSE '' END AS a, CASE WHEN t.i % 2 = 1 THEN t.d ELSE '' END AS z
    FROM subs s JOIN top t ON t.i = xor(s.i >> t.h, 1)),
steps AS (SELECT lang, i, list(h ORDER BY h) AS hs, list(a ORDER BY h) AS az, list(z ORDER BY h) AS zz FROM low GROUP BY lang, i),
tops AS (SELECT lang, list(h ORDER BY h) AS hs, list(a ORDER BY h) AS az, list(z ORDER BY h) AS zz FROM high GROUP BY lang),
tall AS (SELECT max(h) AS height, max(d) FILTER (n = 1) AS root FROM top),
ways AS (SELECT l.doc_id, l.leaf, l.claimed, s.subroot, root,
        [coalesce(st.az[list_position(st.hs, h)], '') for h in range(s.height)] || [coalesce(tp.az[list_position(tp.hs, h)], '') for h in range(tall.height)] AS az,
        [coalesce(st.zz[list_position(st.hs, h)], '') for h in range(s.height)] || [coalesce(tp.zz[list_position(tp.hs, h)], '') for h in range(tall.height)] AS zz
    FROM leaves l JOIN subs s ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN tall
    LEFT JOIN steps st ON st.lang IS NOT DISTINCT FROM l.lang AND st.i = l.i LEFT JOIN tops tp ON tp.lang IS NOT DISTINCT FROM l.lang),
folds AS (SELECT doc_id, leaf, subroot, root, az, zz, claimed AS way, 0 AS h FROM ways
    UNION ALL SELECT doc_id, leaf, subroot, root, az, zz, sha256(az[h + 1] || way || zz[h + 1]), h + 1 FROM folds WHERE h < len(az))
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(range(len(az)), lambda h: az[h + 1] || zz[h + 1]), '')) AS proof_sha256,
    way AS folded_root, way = root AS verified FROM folds WHERE h = len(az)
""")
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of the records of which one in seven was altered, held against the manifest of the unaltered ones."""
    docs = read(spark, sf_dir, "documents")
    leaf = lambda n: manifest.record_digest(*[F.col(c) for c in ("doc_id", "source", "lang")], n, F.col("text"))
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = docs.select(F.col("doc_id").alias("video_id"), F.col("lang").alias("language"), leaf(F.col("n_chars")).alias("leaf"),
                         leaf(F.when(altered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))).alias("claimed"))
    built = manifest.build_manifest(leaves)
    return manifest.prove(built, built.placed).select(
        F.col("video_id").alias("doc_id"), "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")).alias("proof_sha256"),
        manifest.folded_root(F.col("claimed"), F.col("proof")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


@query("""
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM texts)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM windows) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM late CROSS JOIN range(50) r(k)),
runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (p IS NULL OR p < i - 1) AS n_spans
    FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM gone) GROUP BY doc_id),
bytes AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS b FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS i FROM texts)),
kept AS (SELECT doc_id, string_agg(b, '' ORDER BY i) AS h FROM bytes ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, len(t.h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(coalesce(k.h, ''))) AS kept_sha256 FROM texts t LEFT JOIN runs USING (doc_id) LEFT JOIN kept k USING (doc_id)
""")
def op11_repeated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_text.repeated_text(transcripts(read(spark, sf_dir, "documents")), length=50).select(
        F.col("video_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
