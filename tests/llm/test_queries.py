"""The numbered queries and the pipeline on the smallest tables: against their SQL, or against plain Python."""

import re
from collections import defaultdict

import duckdb
import pytest

import corpus_pipeline
from sparkreel.llm import queries, stages
from tools.check import compare, norm

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    want = [tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()]
    problem, rows = compare(got, want)
    assert problem is None and got, rows


def test_thirteen_operators_and_five_stages():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]


def test_columns_of_the_contracts(spark, sf):
    shards = queries.QUERIES["op3_shard_shuffle"](spark, sf)
    assert shards.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


@pytest.fixture(scope="module")
def docs(spark):
    words = lambda seed, n: " ".join(f"w{(seed * 7919 + k * 104729) % 5003}" for k in range(n))
    rows = [(k, words(k, 80), "en", "s", 1) for k in range(1, 20)]
    rows += [(30, words(1, 80), "de", "t", 2), (31, words(1, 79) + " other", "en", "s", 1), (32, None, None, None, None), (33, "", "en", "s", 0),
             (34, "ask me@mail.example.com or +1 (784) 555-9263", "en", "s", 1), (None, words(77, 30), "en", "s", 1), (5, words(5, 80), "en", "s", 1)]
    return spark.createDataFrame(rows, DOCUMENT)


def test_near_duplicate_stage_keeps_one_of_each_group(spark, sf, docs):
    kept = stages.drop_near_duplicates(spark, docs, sf)
    assert kept.columns == stages.DOCUMENT
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=lambda x: (x is None, x or 0)) == [*range(1, 20), 32, 33, 34, None]


def test_contaminated_documents_go_and_clean_ones_stay(spark, sf, docs):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    dirty = spark.createDataFrame([(90, "before it " + item + " and after", "en", "s", 1)], DOCUMENT)
    kept = stages.drop_contaminated(spark, docs.union(dirty), sf)
    assert kept.count() == docs.count() and kept.filter("doc_id = 90").count() == 0


def test_rows_are_dropped_one_by_one_where_ids_are_null_or_repeat(spark, sf):
    words = lambda seed, n: " ".join(f"w{(seed * 7919 + k * 104729) % 5003}" for k in range(n))
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    row = lambda doc_id, text: (doc_id, text, "en", "s", 1)
    # Of each list the first rows stay.
    clean = [row(None, words(1, 80)), row(5, words(2, 80)), row(3, words(3, 80)), (None, words(4, 80), None, "en", 1), (None, words(5, 80), "en", None, 1)]
    table = lambda rows: spark.createDataFrame(rows, DOCUMENT)
    kept = stages.drop_contaminated(spark, table(clean + [row(None, "x " + item), row(5, item + " x")]), sf)
    assert sorted(map(str, kept.collect())) == sorted(map(str, table(clean).collect()))
    alike = [row(5, words(3, 79) + " other"), row(None, words(1, 79) + " other"), row(None, words(2, 80)), row(3, words(3, 78) + " one more")]
    texts = [r.text for r in stages.drop_near_duplicates(spark, table(clean + alike), sf).collect()]
    first = lambda seed: [t for t in texts if t.startswith(words(seed, 70))]
    assert len(texts) == 5 and [len(first(k)) for k in range(1, 6)] == [1] * 5 and first(2) == [words(2, 80)]


def test_redaction_changes_only_spans(spark, sf, docs):
    before = {r.doc_id: r for r in docs.collect()}
    for r in stages.redact_personal_data(spark, docs, sf).collect():
        if r.doc_id == 34:
            assert r.text == "ask <email> or <phone>" and r.n_chars == len(r.text)
        else:
            assert r.text == before[r.doc_id].text and r.n_chars == before[r.doc_id].n_chars


def test_toxicity_stage_drops_rows_only(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = stages.drop_toxic(spark, docs, sf)
    assert kept.columns == stages.DOCUMENT and kept.exceptAll(docs.select(stages.DOCUMENT)).count() == 0


def test_pipeline_end_to_end(spark, sf):
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens))
    assert pieces
    for own in pieces.values():
        own.sort()
        assert sum(n for _, n, _ in own) == own[0][2] and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:]))
    ids = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert set(pieces) <= ids
