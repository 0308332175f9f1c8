"""The same derived tables in DuckDB SQL, for the result checks."""

from __future__ import annotations

from sparkreel import lexicon as lx

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
BLANKS = r"[ \t\n\r\f\x0B]+"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listing(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def code_sum(expr: str) -> str:
    return (f"coalesce(list_sum(list_transform(list_filter(string_split({expr}, ''), lambda c: c <> ''), "
            "lambda c: unicode(c)))::BIGINT, 0)")


def factor_of(name: str, hashed: str = "h") -> str:
    return f"(({hashed} + {lx.FACTORS.index(name)}) % 7 + 3)::DOUBLE"


def weighted(hashed: str = "h", weights=lx.WEIGHTS_A) -> str:
    return "round(0e0 + " + " + ".join(f"{factor_of(f, hashed)} * {w}e0" for f, w in weights.items()) + ", 2)"


def tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{BLANKS}'), lambda x: x <> '')"


def strip(expr: str) -> str:
    return rf"regexp_replace({expr}, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g')"


def has_number(expr: str) -> str:
    return rf"regexp_matches({expr}, '(?:^|{NOT_WORD})\p{{Nd}}+(?:$|{NOT_WORD})')"


def word_runs(expr: str) -> str:
    return f"regexp_extract_all({expr}, '{WORD}+')"


def is_hook(expr: str) -> str:
    return f"(contains({expr}, '?') OR {has_number(expr)} OR list_has_any({word_runs(f'lower({expr})')}, {listing(lx.HOOK_WORDS)}))"


def first_word(expr: str) -> str:
    return f"lower(regexp_extract({strip(expr)}, '^{WORD}+'))"


def opens_cleanly(expr: str) -> str:
    return f"NOT list_contains({listing(lx.CONJUNCTIONS + lx.FILLERS)}, {first_word(expr)})"


def ends_sentence(expr: str) -> str:
    return rf"regexp_matches({strip(expr)}, '[.?!]$')"


def word_set(expr: str) -> str:
    plain = f"lower(regexp_replace({expr}, '#[a-zA-Z0-9_-]+', '', 'g'))"
    return f"list_filter(list_distinct({word_runs(plain)}), lambda w: NOT list_contains({listing(lx.STOP_WORDS)}, w))"


def jaccard(a: str, b: str) -> str:
    return (f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0e0 ELSE len(list_intersect({a}, {b}))::DOUBLE / "
            f"(len({a}) + len({b}) - len(list_intersect({a}, {b}))) END")


VIEWS = {
    "doc_words": ([], f"SELECT doc_id, {tokens('text')} AS w FROM documents"),
    "lines": (["doc_words"], """
        SELECT video_id, line_idx, text, line_idx * 2.5e0 AS start, 2e0 + 0.125e0 * (length(text) % 8) AS duration
        FROM (SELECT 'v' || doc_id AS video_id, line_idx::INTEGER AS line_idx,
                     array_to_string(w[line_idx * 8 + 1 : line_idx * 8 + 8], ' ') AS text
              FROM (SELECT doc_id, w, unnest(range(0, (len(w) + 7) // 8)) AS line_idx FROM doc_words))"""),
    "candidates": (["lines"], f"""
        SELECT video_id, line_idx AS ord, text AS title, line_idx AS start_index,
               (line_idx + 3 + length(text) % 17)::INTEGER AS end_index, {weighted()} AS virality_score
        FROM (SELECT *, {code_sum('text')} AS h FROM lines)"""),
    "metrics": ([], """
        SELECT user_id AS doc_id, count(*) FILTER (event_type = 'view') AS views,
               count(*) FILTER (event_type = 'click') AS likes, count(*) FILTER (event_type = 'signup') AS comments,
               count(*) FILTER (event_type = 'purchase') AS shares, round(sum(value) / 60, 6) AS watch_time,
               round(least(100e0, avg(value)), 6) AS retention
        FROM events GROUP BY user_id"""),
    "clips": (["metrics"], f"""
        SELECT doc_id, 'c' || doc_id AS clip_id, source AS video_id, title, text, h, {weighted()} AS virality_score,
               coalesce(views, 0) AS views, coalesce(likes, 0) AS likes, coalesce(comments, 0) AS comments,
               coalesce(shares, 0) AS shares, coalesce(watch_time, 0) AS watch_time,
               coalesce(retention, 0) AS retention, coalesce(quality, 0) = 1 AS creator_selected,
               coalesce(toxic, 0) = 1 AS creator_rejected, coalesce(quality, 0) = 1 AS published,
               CASE WHEN lang <> 'en' THEN 'exp_' || lang END AS experiment_id,
               CASE WHEN substr(sha256('c' || doc_id), 1, 1) < '8' THEN 'A' ELSE 'B' END AS variant_id,
               20e0 + n_chars % 41 AS duration
        FROM (SELECT *, {code_sum('title')} AS h
              FROM (SELECT *, regexp_extract(text, '^[^.!?\\n]*') AS title FROM documents))
        LEFT JOIN labels USING (doc_id) LEFT JOIN metrics USING (doc_id)"""),
    "snapshots": ([], """
        SELECT 'c' || user_id AS clip_id, ts AS snapshot_time, event_id,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS views, value AS watch_time FROM events"""),
    "job_events": ([], """
        SELECT 'j' || user_id AS job_id, event_id, ts,
               CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed'
                    WHEN 'signup' THEN 'queued' ELSE 'running' END AS status,
               floor(value / 25)::INTEGER AS progress FROM events"""),
    "tiled_clips": (["lines"], """
        SELECT video_id, video_id || '_' || part AS clip_id, start_time, end_time
        FROM (SELECT video_id, line_idx // 16 AS part, min(start) AS start_time, max(start + 2.5e0) AS end_time
              FROM lines GROUP BY ALL)"""),
}


def with_views(body: str, *names: str, **extra: str) -> str:
    """``body`` behind the CTEs it needs; ``extra`` adds local ones after the shared views."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEWS[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    ctes = [f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in ordered] + [f"{n} AS ({sql})" for n, sql in extra.items()]
    return (("WITH RECURSIVE " + ",\n".join(ctes) + "\n") if ctes else "") + body
