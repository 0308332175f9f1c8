"""The numbered operators against plain Python on small tables, with the awkward rows every one of them must take."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkreel.llm import (attribution, decontamination, fixity, graph, near_duplicates, near_vectors, packing, personal_data, sharding,
                           toxicity, url_rules)

LONG = "lorem ipsum dolor sit amet " * 8000
AWKWARD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (5, LONG), (None, "some words without any id here"), (7, "a b c d e f g h"),
           (7, "a b c d e f g h"), (8, "a b c d e f g h"), (9, "x" * 50_000), (10, "żółć 😀 日本語 " * 20), (11, "1" * 5000)]


@pytest.fixture(scope="module")
def awkward(spark):
    """Rows with NULLs, empty and very long texts, ties and repeats, beside columns whose names the operators use themselves."""
    return spark.createDataFrame([(*row, 0, "x", 0.5) for row in AWKWARD], "video_id bigint, transcript string, row int, shard string, score double")


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.filter("false")


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def shingles(text, n):
    w = words_of(text)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


# 1 -----------------------------------------------------------------------------------------------------------------------------------

def test_contaminated(spark, awkward, empty):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    item = [word() for _ in range(40)]
    part = item[:36]
    noise = lambda n: [word() for _ in range(n)]
    docs = [(1, " ".join(noise(500) + item + noise(500))), (2, " ".join(noise(100) + part + noise(10))), (3, " ".join(item[:20])), (4, " ".join(noise(300))),
            (5, "! ".join(item).upper()), (6, "Two words"), (7, "so two words here")]
    items = [(1, " ".join(item)), (2, " ".join(item)), (3, "two words"), (4, None), (5, ""), (None, " ".join(item[:10]))]
    found = decontamination.contaminated(spark.createDataFrame(docs, "video_id bigint, transcript string"), spark.createDataFrame(items, "clip_id bigint, text string"))
    got = {(r.video_id, r.clip_id): (r.n_shared, r.n_shingles) for r in found.collect()}
    want = {}
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    cut = lambda t: {tuple(split(t)[i:i + 5]) for i in range(max(1, len(split(t)) - 4))} if split(t) else set()
    for d, text in docs:
        for i, t in items:
            s = cut(t)
            if s and 100 * len(s & cut(text)) >= 80 * len(s):
                want[d, i] = (len(s & cut(text)), len(s))
    assert got == want and (6, 3) in got and (7, 3) not in got and (1, None) in got
    held = awkward.select(F.col("video_id").alias("clip_id"), F.col("transcript").alias("text"))
    pairs = {(r.video_id, r.clip_id) for r in decontamination.contaminated(awkward, held).collect()}
    assert {(5, 5), (7, 8), (8, 7), (None, None)} <= pairs and not {1, 2, 3} & {v for v, _ in pairs}
    assert decontamination.contaminated(empty, held).count() == 0 == decontamination.contaminated(awkward, held.filter("false")).count()


# 2 -----------------------------------------------------------------------------------------------------------------------------------

def reference_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens.encode_special_tokens = True
    return np.array([*tokens.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_encoder_is_the_given_tokenizer():
    tokens = packing.encoder(packing.vocabulary_file())
    rng = random.Random(2)
    texts = [t for _, t in AWKWARD if t and len(t) < 60_000] + ["<|endoftext|> it's  \n\n we'll\r\n1234 %%% \u00a0\u2003x"]
    texts += ["".join(rng.choice(" \n'aéßÑ9.,$日😀st") for _ in range(80)) for _ in range(300)]
    for text in texts:
        assert tokens.encode_ordinary(text) == reference_ids(text)[:-1].tolist()


def test_encoding_looks_for_no_special_tokens(monkeypatch):
    """Without special tokens the search for them stops at every place of a text."""
    tokens = packing.encoder(packing.vocabulary_file())
    monkeypatch.setattr(type(tokens), "encode_to_numpy", lambda *_, **__: pytest.fail("special tokens are looked for"))
    batch = pa.RecordBatch.from_pydict({"video_id": [1, 2, 3], "row": [0, 1, 2], "transcript": ["it's  <|endoftext|> \u00e9\U0001f600", None, ""]})
    found = next(packing._encoded(packing.vocabulary_file(), 2048)(iter([batch]))).column("ids").to_pylist()
    assert found == [reference_ids(text).tobytes() for text in batch.column("transcript").to_pylist()]


def test_pack_is_lossless(spark, awkward, empty):
    window = 64
    rows = packing.pack(awkward, window=window, capacity=4096).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.row].append(r)
        sequences[r.window_id].append(r)
    texts = Counter((v, t) for v, t in AWKWARD)
    for own in pieces.values():
        own.sort(key=lambda r: r.start)
        match = [(v, t) for v, t in texts if v == own[0].video_id]
        ids = next(x for x in (reference_ids(t) for _, t in match) if len(x) == own[0].tokens)
        at = 0
        for r in own:
            assert r.start == at and zlib.crc32(ids[at:at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    assert len(pieces) == len(AWKWARD)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist() and sum(r.length for r in own) <= window
    assert packing.pack(empty).count() == 0


def test_windows_hold_neighbours():
    rng = np.random.default_rng(3)
    topics = [np.arange(k * 40, k * 40 + 40, dtype=np.uint32) for k in range(5)]
    docs = [rng.choice(topics[k % 5], 30).astype(np.uint32) for k in range(50)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=200)
    windows = packing.fill_windows(docs, np.log((50 - df + 0.5) / (df + 0.5)), 120)
    assert sum(n for w in windows for _, _, n in w) == 1500 and all(sum(n for _, _, n in w) == 120 for w in windows[:-1])
    same = [len({d % 5 for d, _, _ in w}) == 1 for w in windows]
    assert sum(same) >= len(windows) - 4
    scores = packing.Shard(docs, np.ones(200)).scores(docs[0])
    length = np.array([len(d) for d in docs])
    tf = np.array([[np.sum(d == t) for t in np.unique(docs[0])] for d in docs])
    bm25 = (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / length.mean())[:, None])).sum(axis=1)
    assert np.allclose(scores, bm25, rtol=1e-5)


def test_statistics_cover_whole_transcripts_and_common_tokens(spark):
    texts = ["tail " * 5 + "common words of a source"] * 3 + ["rare opening " + "x y z " * 40, "something else", None]
    df = spark.createDataFrame(list(enumerate(texts)), "video_id bigint, transcript string").repartition(3)
    rows = df.select("video_id", "transcript", F.monotonically_increasing_id().alias("row"))
    encoded = rows.mapInArrow(packing._encoded(packing.vocabulary_file(), 16),
                              "video_id bigint, row bigint, tokens bigint, crcs array<bigint>, ids binary, near bigint, found binary")
    idf, average = packing.corpus_statistics(encoded)
    ids = [reference_ids(t) for t in texts]
    n = np.zeros(1 << 16)
    for own in ids:
        n[np.unique(own)] += 1
    assert np.allclose(idf, np.log(1 + (6 - n + 0.5) / (n + 0.5)), rtol=1e-5) and (idf > 0).all()
    assert average == pytest.approx(np.mean([len(x) for x in ids])) and n[ids[3][0]] == 1  # stands in a full window alone
    shard = packing.Shard(ids, idf, average)
    assert shard.scores(ids[0])[1] > shard.scores(ids[0])[4] and len(shard.matrix)


# 3 -----------------------------------------------------------------------------------------------------------------------------------

def test_shards(spark, awkward, empty):
    rows = spark.range(5003).select(F.lit(1).alias("video_id"), F.col("id").cast("string").alias("transcript")).repartition(7)
    got = sharding.shuffle_into_shards(rows, shards=16).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(by) == 16 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and {r.transcript for r in got} == {str(k) for k in range(5003)}
    # No trend is left: neither shard nor slot follows the order of the input.
    assert abs(np.corrcoef([int(r.transcript) for r in got], [r.slot for r in got])[0, 1]) < 0.06
    mixed = sharding.shuffle_into_shards(awkward, shards=5)
    assert mixed.count() == len(AWKWARD) and mixed.schema["shard"].dataType.simpleString() == "int"
    assert sharding.shuffle_into_shards(empty).count() == 0


def test_matrix_has_its_margins_and_law():
    matrix = np.array(sharding.communication_matrix([1000, 3, 0, 499_997], [167_000, 167_000, 167_000], 1))
    assert matrix.sum(axis=1).tolist() == [1000, 3, 0, 499_997] and matrix.sum(axis=0).tolist() == [167_000] * 3
    rng = random.Random(4)
    for good, bad, draws in ((30, 70, 40), (3000, 7000, 4000)):
        drawn = np.array([sharding.hypergeometric(rng, good, bad, draws) for _ in range(4000)])
        mean, n = draws * good / (good + bad), good + bad
        sd = (draws * good * bad * (n - draws) / (n * n * (n - 1))) ** 0.5
        assert abs(drawn.mean() - mean) < 5 * sd / 4000 ** 0.5 and 0.94 < drawn.std() / sd < 1.06


# 4 -----------------------------------------------------------------------------------------------------------------------------------

def components_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_super_minhash_estimates_jaccard():
    rng = np.random.default_rng(5)
    errors = []
    for n, shared in ((40, 30), (400, 330), (3000, 1500)):
        for _ in range(20):
            pool = np.unique(rng.integers(1, 1 << 63, 2 * n - shared, dtype=np.uint64))
            a, b = pool[:n], pool[len(pool) - n:]
            table = near_duplicates.super_minhash(np.concatenate([a, b]), np.array([0, n, 2 * n]), 128)
            errors.append((table[0] == table[1]).mean() - shared / len(pool))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    assert (near_duplicates.super_minhash(np.zeros(0, np.uint64), np.array([0, 0])) == ~np.uint64(0)).all()


def test_near_duplicates(spark, awkward, empty):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    common = [word() for _ in range(60)]
    for _ in range(12):
        base = [word() for _ in range(80)]
        texts.append(base)
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    texts += [common + [word() for _ in range(30)] for _ in range(20)]
    rows = [(100 + i, " ".join(t)) for i, t in enumerate(texts)]
    for words in (4, 5):
        sets = {i: shingles(t, words) for i, t in rows}
        links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        want = components_of(sets, links)
        got = {r.video_id: r for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "video_id bigint, transcript string"), words).collect()}
        assert {i: r.component_id for i, r in got.items()} == want and all(r.n_shingles == len(sets[i]) for i, r in got.items())
        assert all(r.kept == (i == r.component_id) for i, r in got.items())
    got = [(r.video_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates.near_duplicates(awkward).collect()]
    assert len(got) == len(AWKWARD) and {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (8, 4, 7, False), (None, 2, None, True)} <= set(got)
    assert near_duplicates.near_duplicates(empty).count() == 0


def test_trees_learn_from_every_example(spark):
    """A hundred addresses among 60,000 other proposals: a draw of 20,000 would hold too few of them."""
    rows = [f"{'ab ' * k} mail x{k}@mail.example.com now" for k in range(100)] + [" " * k + "12 34 56 words " * 1000 for k in range(15)] * 2
    rows += [" " * k + "1.22.333 words " * 1000 for k in range(15)] + [" " * k + "1 2 3 4 words " * 1000 for k in range(14)] + [" " * k + "12.34 5 words " * 1000 for k in range(14)]
    df = spark.createDataFrame(list(enumerate(rows)), "video_id bigint, transcript string")
    assert "email" in personal_data.fit(df)


def test_threshold_is_the_lowest_precise_margin(spark):
    rng = random.Random(4)
    rows = [(round(rng.gauss(label, 1.0), 1), float(label)) for label in (0, 1) for _ in range(400)]
    for precision in (0.5, 0.8, 0.9, 0.99):
        margins = sorted({m for m, _ in rows})
        kept = [[y for m, y in rows if m >= low] for low in margins]
        want = min((low for low, own in zip(margins, kept, strict=True) if sum(own) >= precision * len(own)), default=None)
        assert personal_data._lowest_precise(spark.createDataFrame(rows, "margin double, label double"), precision) == want
    assert personal_data._lowest_precise(spark.createDataFrame([(1.0, 0.0)], "margin double, label double"), 0.9) is None


def test_rounds_of_components_keep_estimates_small(spark, capsys):
    """Sizes estimated for joins of checkpoints are products; over rounds they filled the driver."""
    links = spark.range(60).selectExpr("id AS a", "id + 1 AS b")
    capsys.readouterr()
    graph.components(links).explain(mode="cost")
    plan = capsys.readouterr().out
    assert "sizeInBytes" in plan and "EiB" not in plan and "E+" not in plan


def test_signatures_agree_slot_by_slot(spark):
    table = np.random.default_rng(3).integers(0, 1 << 63, (40, near_duplicates.LONG), dtype=np.uint64)
    table[1:20, :200] = table[0, :200]
    bits = near_duplicates.mixed(table) & np.uint64(15)
    rows = [(k, row.view(np.int64).tolist()) for k, row in enumerate(near_duplicates._planes(table))]
    df = spark.createDataFrame(rows, "k int, x array<bigint>").withColumn("first", F.lit(rows[0][1]))
    whole, short = near_duplicates._agreeing(F.col("x"), F.col("first")), near_duplicates._agreeing(F.col("x"), F.col("first"), near_duplicates.SHORT)
    assert str(whole).count("^") <= near_duplicates.LONGS  # every number once, as the driver plans the whole expression time and again
    for r in df.select("k", whole.alias("whole"), short.alias("short")).collect():
        assert (r.whole, r.short) == ((bits[r.k] == bits[0]).sum(), (bits[r.k, :64] == bits[0, :64]).sum())


def test_components_of_a_chain(spark):
    links = spark.range(60).selectExpr("id AS a", "id + 1 AS b").union(spark.createDataFrame([(100, 100), (200, 201)], "a bigint, b bigint"))
    assert {r.node: r.root for r in graph.components(links).collect()} == {k: 0 for k in range(61)} | {200: 200, 201: 200}


# 5 -----------------------------------------------------------------------------------------------------------------------------------

def test_toxicity_on_held_out_rows(spark, awkward, empty):
    rng = random.Random(7)
    plain = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    stems = ["grotz", "vulk", "schmiq"]
    rows = []
    for i in range(1500):
        text, bad = [rng.choice(plain) for _ in range(rng.randint(10, 120))], i % 5 == 0
        for _ in range(3 * bad):
            text.insert(rng.randrange(len(text)), rng.choice(stems) + rng.choice(["", "en", "ot", "ish"]))
        rows.append((i, " ".join(text), int(bad)))
    df = spark.createDataFrame(rows, "video_id bigint, transcript string, toxic int")
    model = toxicity.fit(df, df.filter("video_id < 1000").select("video_id", "toxic"))
    got = toxicity.score_toxicity(df.filter("video_id >= 1000"), model).join(df.select("video_id", "toxic"), "video_id").collect()
    hit = [r for r in got if r.score >= 0.7]
    assert sum(r.toxic for r in hit) >= 0.9 * sum(r.toxic for r in got) and sum(r.toxic for r in hit) >= 0.95 * len(hit)
    scored = toxicity.score_toxicity(awkward, model).collect()
    assert len(scored) == len(AWKWARD) and all(0 <= r.score <= 1 for r in scored) and len({r.score for r in scored if r.video_id in (1, 2, 3)}) == 1
    assert toxicity.score_toxicity(empty, model).count() == 0
    blank = toxicity.fit(df, df.filter("false").select("video_id", "toxic"))
    assert {round(r.score, 6) for r in toxicity.score_toxicity(df.limit(5), blank).collect()} == {0.0}


def test_word_ratios_equal_plain_kneser_ney(spark):
    """Against the definition over dictionaries: class counts of labelled rows, continuations of the words of all rows."""
    texts = [(1, "Bad badder banana", 1), (2, "good banana, ban BAN!", 0), (3, "gooder bad ox", 0), (4, "bade goods xylo x", None), (5, None, 1), (6, "", 0)]
    df = spark.createDataFrame(texts, "video_id bigint, transcript string, toxic int")
    model = toxicity.fit(df, df.select("video_id", "toxic"))
    held = {r.video_id for r in df.dropna(subset=["toxic"]).filter(F.pmod(F.xxhash64("video_id", F.lit(5)), F.lit(4)) == 0).collect()}
    counts = {1: Counter(), 0: Counter()}
    kinds = set()
    grams = lambda w: [(w[max(0, i - 5):i + 1]) for i in range(1, len(w))]
    for key, text, label in texts:
        for w in re.findall("[a-z]+", (text or "").lower()):
            for top in grams(f"<{w}>"):
                kinds |= {top[k:] for k in range(len(top) - 1)}
                if label is not None and key not in held:
                    counts[label][top] += 1
    follow = Counter(g[1:] for g in kinds)

    def smoothed(table, gram, behind):
        same = [c for g, c in table.items() if g[:-1] == gram[:-1] and len(g) == len(gram) and c > 0]
        return (max(table[gram] - 0.75, 0) + 0.75 * len(same) * behind) / sum(same) if same else behind

    def shared(gram):
        return 1 / 256 if not gram else smoothed(follow, gram, shared(gram[1:]))

    words = ["bad", "banana", "good", "xylo", "x", "unheard", "ban", "zq", "goods"]
    rows = spark.createDataFrame([(i, w.encode()) for i, w in enumerate(words)], "hash bigint, word binary")
    got = {words[r.hash]: r.ratio for r in toxicity.word_ratios(rows, model).collect()}
    for w in words:
        logs = [np.log(smoothed(counts[1], g, shared(g[1:]))) - np.log(smoothed(counts[0], g, shared(g[1:]))) for g in grams(f"<{w}>")]
        assert got[w] == pytest.approx(sum(logs) / len(logs), abs=1e-9), w
    assert any(got.values())


def test_calibration_takes_every_row_of_its_quarter(spark):
    """Toxic rows that come after the 30,000 rows of the smallest hash still calibrate."""
    rank = F.xxhash64("video_id", F.lit(5))
    ids = spark.range(140_000).withColumnRenamed("id", "video_id").withColumn("rank", rank)
    last = ids.filter(F.pmod("rank", F.lit(4)) == 0).orderBy(F.desc("rank")).limit(200).select("video_id", F.lit(True).alias("late"))
    counted = (F.pmod("rank", F.lit(4)) != 0) & (F.col("video_id") % 50 == 0)
    df = ids.join(last, "video_id", "left").withColumn("toxic", (F.col("late").isNotNull() | counted).cast("int")).select(
        "video_id", F.when(F.col("toxic") == 1, "grotz vulk").otherwise("plain rest").alias("transcript"), "toxic")
    model = toxicity.fit(df, df.select("video_id", "toxic"))
    assert model.weights[1:].any()
    assert {(r.transcript, r.score > 0.7) for r in toxicity.score_toxicity(df, model).select("transcript", "score").distinct().collect()} == {
        ("grotz vulk", True), ("plain rest", False)}


def test_ratios_of_fitted_transcripts_are_computed_once(spark, monkeypatch):
    """Words beyond the common ones take their ratios from the model's table, not from the n-grams again, and the steps' tables go."""
    rows = [(i, f"word{i % 7} plain text {'grotz vulk' if i % 3 == 0 else 'rest'} n{i}", int(i % 3 == 0)) for i in range(120)]
    df = spark.createDataFrame([*rows, *rows[:3], (None, None, 0)], "video_id bigint, transcript string, toxic int")
    asked, folders, own, new = [], [], toxicity.word_ratios, toxicity.new_folder
    monkeypatch.setattr(toxicity, "word_ratios", lambda words, model: asked.append(1) or own(words, model))
    monkeypatch.setattr(toxicity, "new_folder", lambda *a: folders.append(new(*a)) or folders[-1])
    few, all_ = (toxicity.fit(df, df.select("video_id", "toxic"), common=n) for n in (5, 10_000))
    scores = [sorted((r.video_id or 0, r.transcript or "", r.score) for r in toxicity.score_toxicity(df, m, fitted=True).collect()) for m in (few, all_)]
    assert len(asked) == 2 and len(scores[0]) == 124
    for a, b in zip(*scores, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-9)
    left = {name for f in folders for name in os.listdir(f.removeprefix("file:"))}
    assert left == {"grams", "ratios"}


def test_calibration_is_the_ridge_logistic(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, toxicity.WIDTH)) * 3 + 1
    y = (x[:, 0] + rng.normal(size=300) > 1).astype(int)
    rows = spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x, y, strict=True)], "toxic int, x array<double>").repartition(5)
    means, spreads = x.mean(axis=0), x.std(axis=0)
    z, w = np.column_stack([np.ones(300), (x - means) / spreads]), toxicity._logistic(rows, means, spreads)
    p = 1 / (1 + np.exp(-z @ w))
    assert np.abs(z.T @ (y - p) - np.array([1e-3, *[1.0] * toxicity.WIDTH]) * w).max() < 1e-6  # the gradient vanishes


def test_scores_do_not_depend_on_which_words_are_common(spark, awkward):
    rows = [(i, f"word{i % 7} plain text {'grotz vulk' if i % 3 == 0 else 'rest'} n{i}", int(i % 3 == 0)) for i in range(120)]
    df = spark.createDataFrame(rows, "video_id bigint, transcript string, toxic int")
    both = [toxicity.fit(df, df.select("video_id", "toxic"), common=n) for n in (5, 10_000)]
    assert not both[0].all_common and both[1].all_common
    more = df.unionByName(awkward.select("video_id", "transcript", F.lit(0).alias("toxic")))
    scores = [sorted((r.video_id or 0, r.transcript or "", r.score) for r in toxicity.score_toxicity(more, m).collect()) for m in both]
    assert len(scores[0]) == 120 + len(AWKWARD)
    for a, b in zip(*scores, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-9)


# 6 -----------------------------------------------------------------------------------------------------------------------------------

def test_fixity(spark):
    rows = [(f"a{k % 3}", k * 700, f"payload {k}") for k in range(300)] + [(None, None, None), ("a0", 5, "x"), ("a0", 5, "x"), ("b", 1 << 40, "far")]
    left = spark.createDataFrame(rows, "archive string, record_offset bigint, payload string").withColumn("digest", F.lit(1))
    changed = [(a, o, "broken" if o == 7000 else p) for a, o, p in rows if o != 14_000] + [("new", 3, "extra")]
    right = spark.createDataFrame(changed, left.drop("digest").schema)
    got = {(r.archive, r.record_offset): r.status for r in fixity.audit_replicas(left, right, span=4096).collect()}
    assert got == {("a1", 7000): "changed", ("a2", 14_000): "missing_right", ("new", 3): "missing_left"}
    assert fixity.audit_replicas(left, left, span=4096).count() == 0
    none = left.filter("false")
    assert fixity.audit_replicas(none, none).count() == 0 and fixity.audit_replicas(left, none).count() == 303
    once = left.dropDuplicates(["archive", "record_offset", "payload"])
    assert [(r.archive, r.record_offset, r.status) for r in fixity.audit_replicas(left, once, span=4096).collect()] == [("a0", 5, "changed")]


# 7 -----------------------------------------------------------------------------------------------------------------------------------

def test_attribution_rules():
    sizes, starts, stops = np.array([3, 4, 2, 5]), np.array([0, 5, 8, 12]), np.array([5, 8, 9, 20])
    assert attribution.attributed(sizes, starts, stops, "first").tolist() == [0, 0, 1, -1]
    assert attribution.attributed(sizes, starts, stops, "most").tolist() == [0, 0, 1, 3]
    assert attribution.attributed(sizes, np.array([0, 0]), np.array([14, 14]), "first").tolist() == [0] * 4
    assert attribution.attributed(sizes, np.array([4]), np.array([4]), "most").tolist() == [-1] * 4


def test_token_counts(spark, awkward, empty):
    totals = defaultdict(int)
    got = attribution.token_counts(awkward).collect()
    for r in got:
        totals[r.video_id] += r.n_tokens
    want = defaultdict(int)
    for v, t in AWKWARD:
        want[v] += len(reference_ids(t)) - 1
    assert totals == want
    own = spark.createDataFrame([(1, "Intro line. Main part äöü here", [(0, 11), (11, 30), (None, 3), (5, 2), (40, 999)])],
                                "video_id bigint, transcript string, sections array<struct<start:int,stop:int>>")
    counts = {r.section: r.n_tokens for r in attribution.token_counts(own).collect()}
    assert counts[-1] == counts[2] == counts[3] == counts[4] == 0 and counts[0] + counts[1] == len(reference_ids("Intro line. Main part äöü here")) - 1
    assert attribution.token_counts(empty).count() == 0
    with pytest.raises(ValueError):
        attribution.token_counts(awkward, rule="last")


# 8 -----------------------------------------------------------------------------------------------------------------------------------

def test_url_verdicts(spark):
    rules = [("org", "/", "allow"), ("Example.ORG", "/es/", "block"), ("example.org", "/en/1", "block"), ("example.org", "/en/1", "allow"), (None, "/", "block"), ("", "/", "block"),
             ("b.example.org", "/e", "allow")]
    urls = ["http://a.EXAMPLE.org/es/x?q", "https://example.org/en/100#t", "http://notexample.org/es/", "http://org", "http://x.net/a", None, "no scheme", "",
            "ftp://h.b.example.org/en/1", "http://a://b.org/", "http://" + ".".join("x" * 3000) + ".org/", "://example.org/es/", "http://ex ample.org/é\n/x"]
    rows = [(k, u, "mine") for k, u in enumerate([*urls, urls[0]])]
    uploads = spark.createDataFrame(rows, "clip_id bigint, youtube_url string, verdict string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string").withColumn("rule", F.lit(1))
    want = {}
    for k, u, _ in rows:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h) + len(p), len(h), v, h.lower() + p) for h, p, v in rules if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        want[k] = (host, path, max(fits)[3], max(fits)[2]) if fits else (host, path, None, "allow")
    assert {r.clip_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.url_verdicts(uploads, table).collect()} == want
    assert {r.verdict for r in url_rules.url_verdicts(uploads, table.filter("false"), default="block").collect()} == {"block"}
    assert url_rules.url_verdicts(uploads.filter("false"), table).count() == 0


# 9 -----------------------------------------------------------------------------------------------------------------------------------

def test_near_vectors(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 20))
    rows = [(k, (c := centres[k % 30] + rng.normal(size=20) * rng.choice([0.02, 0.2, 0.6])).tolist(), "ab"[k % 2] if k % 17 else None) for k in range(700)]
    rows += [(1000, None, "a"), (1001, [], "a"), (1002, [0.0] * 20, "a"), (1003, [float("nan")] * 20, "a"), (1004, [float("inf")] + [1.0] * 19, "a"), (1005, [None] + [1.0] * 19, "a"),
             (1006, rows[1][1], rows[1][2]), (1006, rows[1][1], rows[1][2]), (1007, [2 * x for x in rows[1][1]], rows[1][2]), (None, rows[1][1], rows[1][2]), (1008, [1.0, 2.0], "a")]
    clips = spark.createDataFrame(rows, "clip_id bigint, vector array<double>, label string").withColumn("node", F.lit("mine"))
    good = [k for k, (_, v, label) in enumerate(rows) if label and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links.append((a, b))
    degree = Counter(x for pair in links for x in pair)
    got = near_vectors.near_vectors(clips).collect()
    assert len(got) == len(rows)
    order = lambda k: (k is None, k or 0)
    count = lambda items: sorted(items, key=lambda x: (order(x[0]), x[1]))
    assert count((r.clip_id, r.n_links) for r in got) == count((row[0], degree[k]) for k, row in enumerate(rows))
    roots, firsts = components_of(range(len(rows)), links), {}
    for k, root in roots.items():
        firsts[root] = min(firsts.get(root, (None,)) + (rows[k][0],), key=order)  if root in firsts else rows[k][0]
        firsts[root] = (firsts[root],) if not isinstance(firsts[root], tuple) else firsts[root]
    lowest = {root: min((rows[k][0] for k in roots if roots[k] == root), key=order) for root in set(roots.values())}
    assert Counter((r.clip_id, r.component_id) for r in got) == Counter((rows[k][0], lowest[root]) for k, root in roots.items())
    assert near_vectors.near_vectors(clips.filter("false")).count() == 0
    scored = spark.createDataFrame([(1, {"hook": 1.0}, "e")], "clip_id bigint, detailed_scores map<string,double>, experiment_id string")
    assert near_vectors.near_vectors(near_vectors.factor_vectors(scored)).count() == 1


def test_lengths_of_one_padded_size_stay_apart(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=20)
    short = [(base + 0.01 * rng.normal(size=20)).tolist() for _ in range(6)]
    rows = [(k, v, "a") for k, v in enumerate(short)] + [(10 + k, v + [0.0] * 4, "a") for k, v in enumerate(short)]
    got = near_vectors.near_vectors(spark.createDataFrame(rows, "clip_id bigint, vector array<double>, label string")).collect()
    assert {r.clip_id: (r.n_links, r.component_id) for r in got} == {k: (5, 10 * (k >= 10)) for k, _, _ in rows}


def test_recall_of_the_tables():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98 ** 2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    a, b = near_vectors.probed(x, 5, 2, 2, 9), near_vectors.probed(y, 5, 2, 2, 9)
    met = (a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)
    assert met.any(axis=1).mean() >= 0.9


# 10 ----------------------------------------------------------------------------------------------------------------------------------

# The base patterns in their plain form.
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and luhn(digits or "1"),
                    "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal_data(spark, awkward, empty):
    rng = random.Random(10)
    make = {"email": lambda: f"{rng.choice('abcd')}x{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com", "ip": lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)),
            "card": lambda: "4539 1488 0343 6467", "phone": lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"}
    filler = lambda: " ".join(rng.choice(["the", "of", "in 1999", "page 12", "v1.2", "room 7"]) for _ in range(8))
    rows = [(k, f"{filler()} {rng.choice(list(make.values()))()} {filler()}") for k in range(800)]
    soup = ["".join(rng.choice("a1.@-+ 23() %_456b789c.é😀") for _ in range(rng.randint(0, 120))) for _ in range(300)]
    soup += ["a@b." * 3000, "+1 234 567 8901 " * 800, "1 " * 5000, "1.2.3.4" * 500, "256.1.1.1 1.1.1.1", "write to bob (at) example (dot) com", "(784) 555-9263 call"]
    rows += [(1000 + k, t) for k, t in enumerate(soup)]
    df = spark.createDataFrame(rows, "video_id bigint, transcript string")
    models = personal_data.fit(df.filter("video_id < 1000"), least=20)
    texts = dict(rows)
    spans = {}
    for r in personal_data.find_personal_data(df, models).collect():
        assert [(x.start, x.kind, x.stop) for x in r.base] == plain_spans(texts[r.video_id])
        spans[r.video_id] = [(x.start, x.kind, x.stop) for x in r.spans]
        assert set(map(tuple, spans[r.video_id])) >= set(plain_spans(texts[r.video_id]))
    assert models and spans[1000 + len(soup) - 2]  # the spoken address is added
    both = [r for r in personal_data.find_personal_data(awkward, models).collect()]
    assert len(both) == len(AWKWARD) and all(not r.base for r in both if r.video_id in (1, 2, 3))
    assert personal_data.find_personal_data(empty, models).count() == 0 and personal_data.fit(empty) == {}
    one = personal_data.find_personal_data(spark.createDataFrame([(1, "é a@b.co, 1.2.3.4!"), (2, None), (3, "none")], "video_id bigint, transcript string"), {})
    assert [r[0] for r in one.orderBy("video_id").select(personal_data.redacted(F.col("transcript"), F.col("spans"))).collect()] == ["é <email>, <ip>!", None, "none"]
    assert one.filter("video_id = 1").select(personal_data.span_list(F.col("base"))).first()[0] == "email:2:8,ip:10:17"


def test_spoken_addresses_are_proposed_in_any_text(spark):
    texts = ["write to jane [at] example.com soon", "write to jane(at)example.com", "write to jane at example.com", "jane [at] mail dot example.org", "meet me at home"]
    df = spark.createDataFrame(list(enumerate(texts)), "video_id bigint, transcript string")
    every = {"email": personal_data.Trees([1.0], [1.0], 0.0)}  # takes whatever is proposed
    got = {r.video_id: [r.transcript[x.start:x.stop] for x in r.spans] for r in personal_data.find_personal_data(df, every).collect()}
    assert got == {0: ["jane [at] example.com"], 1: ["jane(at)example.com"], 2: ["jane at example.com"], 3: ["jane [at] mail dot example.org"], 4: []}


def test_copies_do_not_fill_the_sample(spark):
    single = [f"{'ab ' * k} mail x{k}@mail.example.com and host {k % 250}.2.3.4" for k in range(150)]
    copied = [f"{'cd ' * k} page 12 34 56 of {k}" for k in range(20)] * 500
    df = spark.createDataFrame(list(enumerate(single + copied)), "video_id bigint, transcript string")
    assert {"email", "ip"} <= set(personal_data.fit(df, sample=250, least=20))
