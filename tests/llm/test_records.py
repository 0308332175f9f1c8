"""Repeated text, ranked search and the manifest against plain Python, with the awkward rows each must take."""

import hashlib
import math
import random
import re
import tempfile
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkreel.llm import manifest, ranked_search, repeated_text, suffixes

LONG = "lorem ipsum dolor sit amet " * 4000
AWKWARD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (5, LONG), (None, "some words without any id here, and enough of them to fill a window of text"),
           (7, "a b c d e f g h"), (7, "a b c d e f g h"), (8, "a b c d e f g h"), (9, "x" * 20_000), (10, "żółć 😀 日本語 " * 20), (11, "1" * 5000), (12, LONG),
           (None, "some words without any id here, and enough of them to fill a window of text"), (13, "before: " + "some words without any id here, and enough of them to fill")]


@pytest.fixture(scope="module")
def awkward(spark):
    """NULLs, empty and very long texts, ties and repeats, beside columns whose names the operators use themselves."""
    return spark.createDataFrame([(*row, 0, "x", 0.5, "d") for row in AWKWARD], "video_id bigint, transcript string, number int, key string, score double, first string")


# 11 ----------------------------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("how", [{}, {"in_memory": 0}, {"folder": tempfile.gettempdir(), "budget": 100}, {"folder": tempfile.gettempdir(), "budget": 100, "in_memory": 2}])
def test_suffixes_in_order_and_equal_windows(how):
    rng = random.Random(5)
    for _ in range(25):
        alphabet = rng.choice([b"ab", b"aab", bytes(range(97, 110)), b"\x00\xff a"])
        strings = [bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 12))]
        strings += rng.choice([[], [b"a" * 60, b"a" * 55 + b"b", b"b" + b"a" * 70]])
        text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.uint16) + 1
        text[np.cumsum([len(s) + 1 for s in strings]) - 1] = 0
        every = [s[k:] for s in strings for k in range(len(s) + 1)]
        found = [every[p] for at, _ in suffixes.induced(text, 9, **how) for p in at.tolist()]
        assert found == sorted((s for s in every if s), reverse=True)
        length = rng.choice([2, 3, 5, 8])
        got, want = defaultdict(set), defaultdict(set)
        for i, k, group in zip(*(x.tolist() for x in suffixes.equal_windows(strings, length, **how))):
            got[group].add((i, k))
        for i, s in enumerate(strings):
            for k in range(len(s) - length + 1):
                want[s[k:k + length]].add((i, k))
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def plain_repeats(rows, length):
    first, place = {}, lambda i: (i is None, i or 0)
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, raw in texts:
        for k in range(len(raw) - length + 1):
            w = raw[k:k + length]
            first[w] = min(first.get(w, place(i)), place(i))
    out = []
    for i, raw in texts:
        spans = []
        for k in range(len(raw) - length + 1):
            if first[raw[k:k + length]] < place(i):
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + length
                else:
                    spans.append([k, k + length])
        kept = b"".join(raw[a:b] for a, b in zip([0, *[s[1] for s in spans]], [*[s[0] for s in spans], len(raw)]))
        out.append((i, len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest(), [s[0] for s in spans], [s[1] for s in spans]))
    return sorted(out, key=repr)


def repeats(df, **how):
    return sorted((tuple(r) for r in repeated_text.repeated_text(df, **how).collect()), key=repr)


def test_repeated_text_of_awkward_rows(spark, awkward):
    rows = [tuple(r) for r in awkward.select("video_id", "transcript").collect()]
    assert repeats(awkward) == plain_repeats(rows, 50)
    assert repeats(awkward.filter("false")) == []
    with pytest.raises(ValueError):
        repeated_text.repeated_text(awkward, length=20)


def test_repeated_text_of_shared_passages_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(repeated_text, "ANCHOR_PART", 4000)
    monkeypatch.setattr(repeated_text, "STRIP_PART", 2000)
    monkeypatch.setattr(repeated_text, "GATHERED", 3000)
    monkeypatch.setattr(repeated_text, "PIECE", 97)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8)))
    noise = lambda n: " ".join(word() for _ in range(n))
    passages = [noise(14) for _ in range(4)] + ["ab" * 80, "é" * 60]
    rows = []
    for k in range(150):
        text = noise(rng.randint(0, 30))
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            cut = rng.randint(0, 20)
            text += p[cut:] + noise(rng.randint(0, 5))
        rows.append((f"v{rng.randint(0, 140):03}", text))
    rows += rows[:10]
    got = repeats(spark.createDataFrame(rows, "video_id string, transcript string"), budget=2000)
    # Ids of strings: the smallest first, as in the plain version, by their place in order.
    order = {name: n for n, name in enumerate(sorted({i for i, _ in rows}))}
    want = plain_repeats([(order[i], t) for i, t in rows], 50)
    assert sorted(((order[r[0]], *r[1:]) for r in got), key=repr) == want and sum(r[2] for r in want) > 2000


# 12 ----------------------------------------------------------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_ranks(docs, queries, limit):
    held = [(i, terms(t)) for i, t in docs]
    n, total = sum(1 for _, t in held if t), sum(len(t) for _, t in held)
    df = Counter(w for _, t in held for w in set(t))
    out = []
    for clip, text in queries:
        scores = []
        for i, words in held:
            tf, m = Counter(words), 75 + 25 * len(words) * n // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10 ** 9 * tf[w] // (1000 * tf[w] + 12 * m)) for w in terms(text) if tf[w])
            if score > 0:
                scores.append((-score, i is None, i if i is not None else 0))
        out += [(clip, k + 1, None if absent else i, -s) for k, (s, absent, i) in enumerate(sorted(scores)[:limit])]
    return sorted(out, key=repr)


def ranks(docs, queries, limit):
    return sorted((tuple(r) for r in ranked_search.rank_transcripts(docs, queries, limit).collect()), key=repr)


def test_ranked_search_against_every_score(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "DOCS", 16)
    monkeypatch.setattr(ranked_search, "WIDTH", 4)
    monkeypatch.setattr(ranked_search, "SEARCHES", 5)
    rng = random.Random(2)
    pool = [f"w{int(abs(rng.gauss(0, 12)))}" for _ in range(200)] + ["Über", "naïve", "X9"]
    text = lambda n: rng.choice(" ,.-\n").join(rng.choice(pool) for _ in range(n))
    docs = [(k, text(rng.randint(1, 40))) for k in range(150)]
    docs += [(k + 500, t) for k, t in docs[:40]] + [(None, docs[0][1]), (None, docs[1][1]), (7, "w1 w1"), (900, None), (901, "--")]
    queries = [(k, text(rng.randint(1, 9))) for k in range(12)] + [(3, docs[0][1]), (None, "w1 W1 ÜBER"), (50, None), (51, " "), (52, "nowhere")]
    given = spark.createDataFrame(docs, "video_id bigint, transcript string").repartition(3), spark.createDataFrame(queries, "clip_id bigint, text string")
    assert ranks(*given, 5) == plain_ranks(docs, queries, 5)
    empty = given[0].filter("false")
    assert ranks(empty, given[1], 5) == [] == ranks(given[0], given[1].filter("false"), 5)


def test_ranked_search_of_awkward_rows(spark, awkward):
    rows = [tuple(r) for r in awkward.select("video_id", "transcript").collect()]
    asked = awkward.select(F.col("video_id").alias("clip_id"), F.col("transcript").alias("text"), F.lit(1).alias("rank"))
    assert ranks(awkward, asked, 20) == plain_ranks(rows, rows, 20)
    names = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "z")], "video_id string, transcript string")
    assert [r.video_id for r in ranked_search.rank_transcripts(names, spark.createDataFrame([("q", "x")], "clip_id string, text string")).orderBy("rank").collect()] == ["a", "b"]


# 13 ----------------------------------------------------------------------------------------------------------------------------------

def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """The top, and of each node its siblings left and right, from the bottom up."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            run = nodes[place // 2 * 2:place // 2 * 2 + 2]
            ways[k].append(("".join(run[:place % 2]), "".join(run[place % 2 + 1:])))
        at = [p // 2 for p in at]
        nodes = [digest(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
    return (nodes[0] if nodes else None), ways


def plain_manifest(rows):
    """rows: (key, shard, leaf)."""
    shards = defaultdict(list)
    for key, shard, leaf in rows:
        shards[shard].append((key is not None, key or "", leaf))
    names = sorted(shards, key=lambda s: (s is not None, s or ""))
    trees = {s: plain_tree([leaf for *_, leaf in sorted(shards[s])]) for s in names}
    root, ways = plain_tree([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, ways):
        for (has, key, leaf), way in zip(sorted(shards[s]), trees[s][1]):
            out.append((key if has else None, leaf, trees[s][0], root, tuple(way + up)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [8, 2])
def test_manifest_against_a_plain_tree(spark, monkeypatch, bits):
    monkeypatch.setattr(manifest, "BITS", bits)
    monkeypatch.setattr(manifest, "BLOCK", 1 << bits)
    rng = random.Random(4)
    rows = [(f"v{k}", rng.choice(["en", "en", "de", None, "é"]), digest(str(k))) for k in range(70)]
    rows += [("v1", "en", digest("again")), (None, "en", digest("n")), (None, "en", digest("n")), ("only", "xx", digest("o"))]
    df = spark.createDataFrame([(*r, 1, "e") for r in rows], "video_id string, language string, leaf string, rank_ int, extra string").repartition(4)
    built = manifest.build_manifest(df)
    proved = manifest.prove(built, built.placed)
    got = [(r.video_id, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.proof)) for r in proved.collect()]
    assert sorted(got, key=repr) == plain_manifest(rows)
    checks = proved.select("leaf", "root", manifest.folded_root(F.col("leaf"), F.col("proof")).alias("same"), manifest.folded_root(F.sha2("leaf", 256), F.col("proof")).alias("other"),
                           manifest.proof_digest(F.col("proof")).alias("siblings"), "proof").collect()
    assert all(r.same == r.root != r.other and r.siblings == digest(*[s.left + s.right for s in r.proof]) for r in checks)
    some = manifest.prove(built, built.placed.filter("video_id = 'v5'")).collect()
    assert [(r.video_id, r.root) for r in some] == [("v5", built.root)]


def test_manifest_of_few_rows(spark, awkward):
    one = spark.createDataFrame([("v", "en", "ab")], "video_id string, language string, leaf string")
    built = manifest.build_manifest(one)
    assert built.root == "ab" and [r.proof for r in manifest.prove(built, built.placed).collect()] == [[]]
    empty = manifest.build_manifest(one.filter("false"))
    assert empty.root is None and manifest.prove(empty, empty.placed).count() == 0
    leaf = lambda r: digest("-" if r[0] is None else f"{len(str(r[0]))}:{r[0]}", "-" if r[1] is None else f"{len(r[1].encode())}:{r[1]}")
    rows = [tuple(r) for r in awkward.select("video_id", "transcript").collect()]
    got = awkward.select(manifest.record_digest(F.col("video_id"), F.col("transcript")).alias("d")).collect()
    assert sorted(r.d for r in got) == sorted(map(leaf, rows))
