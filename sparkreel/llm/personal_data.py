"""Personal data in transcripts: proposed spans, boosted trees, calibrated thresholds, redaction.

Everything is an expression on the transcript column: nothing is shuffled but the examples the trees are fitted on.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from sparkreel.llm.records import ascii_lower, let
from sparkreel.operators.ordered import running_total
from sparkreel.session import cut_lineage

# The kinds in the order they are listed, and the base patterns. The look-behinds and possessive quantifiers keep the
# leftmost matches what they are without them, and keep the time linear in texts that are one long run of digits or letters.
KINDS = ["email", "ip", "card", "phone"]
LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
CARD = r"(?=[0-9])(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Generators: addresses in words, chains of digits under any punctuation, and groups of few digits. They may overlap.
AT, DOT = r"(?:@|\x20?[(\[]at[)\]]\x20?|\x20at\x20)", r"(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)"
SPOKEN_EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)++"
DIGIT_CHAIN = r"(?<![0-9])(?:[+(]|(?=[0-9]))[0-9](?:[\x20()./-]{0,2}[0-9]){6,30}+(?![0-9])"
DIGIT_GROUPS = r"(?=[0-9])(?<![0-9.])[0-9]{1,5}+(?:[.\x20-][0-9]{1,5}+){2,8}+(?![0-9])"
#: What every match of SPOKEN_EMAIL holds.
SPOKEN_CORE = rf"{AT}[A-Za-z0-9-]++{DOT}[A-Za-z0-9-]"
#: (pattern, what a text must hold for it)
GENERATORS = [(SPOKEN_EMAIL, SPOKEN_CORE), (DIGIT_CHAIN, "[0-9](?:[ ()./-]{0,2}[0-9]){6}"), (DIGIT_GROUPS, "[0-9][. -][0-9]")]

#: What a text must hold for any span at all; most texts are done with after this one look.
ANY = f"[0-9@]|{SPOKEN_CORE}"

# Context words that speak for a kind.
HINTS = {"email": "mail|e-mail|contact|write|schreib|courriel|correo", "ip": r"\bip\b|host|server|addr|login",
         "card": "card|visa|credit|karte|carte|tarjeta|konto", "phone": "phone|call|tel|mobile|fax|anruf|appel|llam"}
FEATURES = ["digits", "marks", "dots", "groups", "largest", "brackets", "size", "lead", "joined_before", "joined_after", "assigned",
            "letters", "tail", "hint_email", "hint_ip", "hint_card", "hint_phone"]
CONTEXT = 24

BLOCK = 256


def _no_spans() -> Column:
    return F.expr("CAST(array() AS array<struct<start:int,stop:int,kind:int>>)")


def _located(text: Column, pattern: str, may: Column) -> Column:
    """All leftmost matches as array<struct<start, stop, match, before, after>>, in code points; none in a text without ``may``.

    A match starts where the gaps and matches before it end. These are summed in blocks, so that a text of very many matches costs
    no square of their number.
    """
    step = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,stop:int,match:string,before:string,after:string>>)").alias("out"))

    def add(state: Column, piece: Column) -> Column:
        start = state["at"] + piece["gap"]
        stop = start + F.length(piece["match"])
        return F.struct(stop.alias("at"), F.array_append(state["out"], F.struct(
            start.alias("start"), stop.alias("stop"), *[piece[c].alias(c) for c in ("match", "before", "after")])).alias("out"))

    def place(pieces: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int"))
        block = lambda k: F.slice(pieces, k * BLOCK + 1, F.lit(BLOCK))
        total = lambda items: F.aggregate(items, F.lit(0), lambda a, x: a + x["gap"] + F.length(x["match"]))
        return let(F.transform(numbers, lambda k: total(block(k))), lambda sums: F.flatten(F.transform(numbers, lambda k: F.aggregate(
            block(k), F.struct(F.aggregate(F.slice(sums, F.lit(1), k), F.lit(0), lambda a, x: a + x).alias("at"), step["out"].alias("out")),
            add)["out"])))

    def pieces(text: Column, matches: Column) -> Column:
        # The context is cut from the gaps: cutting it from the text would walk the text for every match.
        return let(F.split(text, pattern, -1), lambda gaps: F.transform(matches, lambda match, i: F.struct(
            F.length(gaps[i]).alias("gap"), match.alias("match"), F.right(gaps[i], F.lit(CONTEXT)).alias("before"),
            F.left(gaps[i + 1], F.lit(1)).alias("after"))))

    def matched(text: Column) -> Column:
        return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda matches: F.when(
            F.size(matches) > 0, let(pieces(text, matches), place)).otherwise(step["out"]))

    return let(F.when(may, text).otherwise(F.lit("")), matched)


def _worth(transcript: Column) -> Column:
    return F.when(transcript.rlike(ANY), transcript).otherwise(F.lit(""))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    def weigh(digit: Column, place: Column) -> Column:
        value = digit.cast("int")
        return F.when(place % 2 == 1, F.when(value > 4, value * 2 - 9).otherwise(value * 2)).otherwise(value)
    return F.aggregate(F.transform(F.split(F.reverse(_digits(text)), "(?<=.)(?=.)"), weigh), F.lit(0), lambda a, x: a + x) % 10 == 0


def _of_kind(kind: Column) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), kind.alias("kind"))


def base_spans(text: Column) -> Column:
    """Base spans as array<struct<start int, stop int, kind int>>, by start, then kind; stops are exclusive, in code points."""
    digits = lambda x: F.length(_digits(x["match"]))
    rules = [("email", text.contains("@"), EMAIL, None),
             ("ip", text.rlike(r"[0-9]\.[0-9]"), IP, lambda x: x["match"].rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")),
             ("card", text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), CARD, lambda x: _luhn(x["match"])),
             ("phone", text.contains("+"), PHONE, lambda x: digits(x).between(9, 15))]
    found = []
    for kind, may, pattern, valid in rules:
        spans = _located(text, pattern, may)
        spans = F.filter(spans, valid) if valid else spans
        found.append(F.transform(spans, _of_kind(F.lit(KINDS.index(kind)))))
    by_place = lambda a, b: (F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))
    return F.array_sort(F.concat(*found), by_place)


def _features(x: Column) -> list[Column]:
    match, before, after = x["match"], ascii_lower(x["before"]), x["after"]
    groups = F.split(match, "[^0-9]+")
    flag = lambda c: c.cast("double")
    values = {
        "digits": F.length(_digits(match)), "marks": F.length(F.regexp_replace(match, "[0-9A-Za-z]", "")),
        "dots": F.length(match) - F.length(F.replace(match, F.lit("."), F.lit(""))), "groups": F.size(F.filter(groups, lambda g: g != "")),
        "largest": F.array_max(F.transform(groups, F.length)), "brackets": flag(match.rlike(r"\(")), "size": F.length(match),
        "lead": F.coalesce(F.substring(_digits(match), 1, 1).try_cast("int"), F.lit(-1)), "joined_before": flag(before.rlike(r"[\p{L}\p{N}]$")),
        "joined_after": flag(after.rlike(r"[\p{L}\p{N}]")), "assigned": flag(before.rlike(r"[=:]\s*[\"']?\w*$")),
        "letters": F.length(F.regexp_replace(match, "[^A-Za-z]", "")), "tail": F.length(F.regexp_extract(match, "([A-Za-z]*)$", 1)),
    } | {f"hint_{kind}": flag(before.rlike(words)) for kind, words in HINTS.items()}
    return [F.coalesce(values[name].cast("double"), F.lit(0.0)).alias(name) for name in FEATURES]


def _described(labelled: bool) -> Callable[[Column], Column]:
    def has(match: Column) -> Column:
        """Whether the match is base data of each kind: the labels the trees learn from."""
        digits = F.length(_digits(match))
        tests = [match.rlike(f"{LOCAL}@[A-Za-z0-9-]+[.][A-Za-z0-9-]"), match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"),
                 match.rlike(r"^[0-9](?:[\x20-]?[0-9]){11,18}$") & _luhn(match), match.startswith("+") & digits.between(9, 15)]
        return F.array(*[t.cast("double") for t in tests])

    return lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), *_features(x),
                              *([has(x["match"]).alias("is")] if labelled else []))


def proposals(text: Column, labelled: bool = False) -> Column:
    """Proposed spans with format and context features: array<struct<start, stop, features...>>; they may overlap."""
    return F.concat(*[F.transform(_located(text, pattern, text.rlike(may)), _described(labelled))
                      for pattern, may in GENERATORS])


@dataclass
class Trees:
    """Boosted trees of one kind: nested (feature, threshold, left, right) tuples or leaf values, their weights, and the margin from
    which a proposal is taken."""
    roots: list = field(default_factory=list)
    weights: list = field(default_factory=list)
    threshold: float = 0.0

    def margin(self, candidate: Column) -> Column:
        def grown(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            name, threshold, left, right = node
            return F.when(candidate[name] <= threshold, grown(left)).otherwise(grown(right))
        total = F.lit(0.0)
        for root, weight in zip(self.roots, self.weights, strict=True):
            total = total + grown(root) * weight
        return total


def _grown(node) -> tuple | float:
    if node.subtreeDepth() == 0:
        return node.prediction()
    split = node.split()
    return FEATURES[split.featureIndex()], split.threshold(), _grown(node.leftChild()), _grown(node.rightChild())


def _lowest_precise(scored: DataFrame, precision: float) -> float | None:
    """The smallest margin from which on at least ``precision`` of the rows ``scored(margin, label)`` are of label 1."""
    # Decimals: the sums are exact, whatever the order of the rows.
    own = F.sum(F.col("label").cast("decimal(20,6)") - F.lit(Decimal(str(precision))).cast("decimal(20,6)"))
    ties = scored.withColumn("down", -F.col("margin")).groupBy("down").agg(own.alias("over"))
    upto = running_total(ties, [], [F.floor("down"), F.floor(F.col("down") * 256)], ["down"], F.col("over"), "ahead")
    lowest = upto.filter("ahead >= 0").agg(F.max("down")).first()[0]
    return None if lowest is None else -lowest


def fit(transcripts: DataFrame, sample: int | None = None, least: int = 40, precision: float = 0.99, trees: int = 10, depth: int = 3,
        seed: int = 10) -> dict[str, Trees]:
    """Boosted trees per kind, learnt from the transcripts' own base spans.

    A proposal is an example of a kind if it is such base data itself. What the base rules test (a plus sign, a checksum, an at sign)
    is no feature, so the trees learn what such data look like and where they stand. All distinct proposals of all transcripts are
    examples; the copies of a text count once. A caller may ask for ``sample`` of them instead (smallest hash first). Four fifths of
    them fit the trees; on the rest the smallest margin with at least ``precision`` is the threshold. Kinds with fewer than ``least``
    examples for or against, or which never reach the precision, get no trees and add no spans.
    """
    proposed = transcripts.filter(F.col("transcript").rlike(ANY)).select(
        F.explode(proposals(F.col("transcript"), labelled=True)).alias("x")).select("x.start", *[f"x.{c}" for c in FEATURES], "x.is").distinct()
    rows = proposed.withColumn("_draw", F.xxhash64("start", *FEATURES, F.lit(seed)))
    rows = rows if sample is None else rows.orderBy("_draw").limit(sample)
    # Written, so that the many jobs of the fits neither plan nor repeat the search for proposals.
    drawn = cut_lineage(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
    models = {}
    for k, kind in enumerate(KINDS):
        own = drawn.select("features", "_draw", F.col("is")[k].alias("label"))
        held = F.pmod(F.col("_draw"), F.lit(5)) == 0
        counts = own.agg(*[F.count_if(cond & (F.col("label") == value)) for cond in (held, ~held) for value in (0.0, 1.0)]).first()
        if min(counts[2], counts[3]) < least or min(counts[0], counts[1]) < least / 4:
            continue
        # Spark looks for split points among the square of maxBins rows: with as many bins it looks at every example.
        bins = max(32, math.isqrt(counts[2] + counts[3]) + 1)
        model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, maxBins=bins, stepSize=0.3, cacheNodeIds=False).fit(own.filter(~held))
        grown = Trees([_grown(tree.rootNode()) for tree in model._java_obj.trees()], list(model.treeWeights))
        reached = _lowest_precise(drawn.filter(held).select(
            grown.margin(F.struct(*FEATURES)).alias("margin"), F.col("is")[k].alias("label")), precision)
        if reached is not None:
            grown.threshold = reached
            models[kind] = grown
    return models


def chosen_spans(text: Column, models: dict[str, Trees]) -> Column:
    """struct<base, spans>: the base spans, and these with the proposals the trees select.

    A proposal is selected for the kind whose margin exceeds its threshold most. One that overlaps a base span, or a selected one that
    starts before it, is left out.
    """
    names = [k for k in KINDS if k in models]

    def judged(candidate: Column) -> Column:
        over = [models[kind].margin(candidate) - F.lit(models[kind].threshold) for kind in names]
        best = F.array_max(F.array(*[F.struct(o.alias("over"), F.lit(KINDS.index(k)).alias("kind")) for o, k in zip(over, names, strict=True)]))
        return F.struct(candidate["start"].alias("start"), candidate["stop"].alias("stop"), best["kind"].alias("kind"), best["over"].alias("over"))

    by_place = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"])

    def added(base: Column) -> Column:
        if not names:
            return _no_spans()
        span = lambda is_base: lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"), F.lit(is_base).alias("base"))
        selected = F.transform(F.filter(F.transform(proposals(text), judged), lambda x: x["over"] >= 0.0), span(False))
        order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["base"].cast("int") - a["base"].cast("int"))
        plain = lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"))
        none = F.lit(None).cast("struct<start:int,stop:int,kind:int>")
        held = lambda s, x: F.when(s["open"].isNotNull() & (s["open"]["stop"] <= x["start"]), F.array_append(s["out"], s["open"])).otherwise(s["out"])

        def sweep(s: Column, x: Column) -> Column:
            """``open`` is the last selected span; it stays unless a base span starts inside it."""
            fits = (x["start"] >= s["end"]) & (s["open"].isNull() | (s["open"]["stop"] <= x["start"]))
            return (F.when(x["base"], F.struct(F.greatest(s["end"], x["stop"]).alias("end"), none.alias("open"), held(s, x).alias("out")))
                    .when(fits, F.struct(s["end"].alias("end"), plain(x).alias("open"), held(s, x).alias("out"))).otherwise(s))

        return F.aggregate(F.array_sort(F.concat(F.transform(base, span(True)), selected), order),
                           F.struct(F.lit(0).alias("end"), none.alias("open"), _no_spans().alias("out")), sweep,
                           lambda s: F.when(s["open"].isNotNull(), F.array_append(s["out"], s["open"])).otherwise(s["out"]))

    return let(base_spans(text), lambda base: F.struct(base.alias("base"), F.array_sort(F.concat(base, added(base)), by_place).alias("spans")))


def find_personal_data(transcripts: DataFrame, models: dict[str, Trees] | None = None) -> DataFrame:
    """Spans of e-mail addresses, IP addresses, card and phone numbers in every whole transcript.

    ``transcripts(video_id, transcript)``. Returns ``(video_id, transcript, base, spans)``, one row per row; both are
    ``array<struct<start int, stop int, kind int>>`` (``KINDS[kind]``) by start, then kind, in code points, stop exclusive. ``base`` holds
    the rule-based spans, ``spans`` these and what the boosted trees add. ``models`` come from ``fit``; without them they are fitted
    on ``transcripts`` first.

    NULL and empty transcripts have no spans; repeated rows each get theirs; other columns are not carried.
    """
    models = fit(transcripts) if models is None else models
    both = let(_worth(F.col("transcript")), lambda text: chosen_spans(text, models))
    # The explode of one element keeps the optimizer from copying the expression to each of its fields.
    return transcripts.select("video_id", "transcript", F.explode(F.array(both)).alias("_")).select("video_id", "transcript", "_.base", "_.spans")


def span_list(spans: Column) -> Column:
    """``kind:start:stop`` of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"], x["stop"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in angle brackets; of overlapping spans, the first by start names the stretch."""
    kinds = F.array(*map(F.lit, KINDS))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(state: Column, x: Column) -> Column:
        mark = F.concat(F.substring(text, state["at"] + 1, x["start"] - state["at"]), F.lit("<"), F.element_at(kinds, x["kind"] + 1), F.lit(">"))
        return F.struct(F.greatest(state["at"], x["stop"]).alias("at"), F.concat(state["out"], F.when(x["start"] >= state["at"], mark).otherwise("")).alias("out"))

    whole = F.aggregate(spans, start, add, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
