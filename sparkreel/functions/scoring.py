"""Clip scoring expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sparkreel import lexicon as lx
from sparkreel.functions import text as tx

DEFAULT_FACTOR = 5.0


def factor(scores: Column, name: str, default: float = DEFAULT_FACTOR) -> Column:
    return F.coalesce(scores[name], F.lit(default))


def mock_scores(title: Column) -> Column:
    """Eleven factor values between 3 and 9 that depend on the title's code points only."""
    total = F.aggregate(F.split(title, ""), F.lit(0).cast("bigint"), lambda acc, c: acc + F.ascii(c))
    values = lambda t: F.transform(F.sequence(F.lit(0), F.lit(len(lx.FACTORS) - 1)),
                                   lambda i: (F.pmod(t + i, F.lit(7)) + 3).cast("double"))
    return F.map_from_arrays(tx.words_of(lx.FACTORS), tx.bind(total, values))


def weighted_score(scores: Column, weights: dict[str, float] = lx.WEIGHTS_A) -> Column:
    def total(m: Column) -> Column:
        out = F.lit(0.0)
        for name, weight in weights.items():
            out = out + factor(m, name) * F.lit(weight)
        return F.round(out, 2)

    return tx.bind(scores, total)


def adjusted_scores(text: Column, scores: Column) -> Column:
    """Factor values after the wording rules, each within 1..10, as a struct of 11 doubles."""
    opening = F.lower(tx.strip(F.regexp_extract(text, r"^[^.!?]*", 0)))
    facts = F.struct(tx.strip(F.lower(text)).alias("low"), scores.alias("scores"),
                     F.coalesce(F.get(tx.tokens(opening), F.lit(0)), F.lit("")).alias("first"))

    def tested(v: Column) -> Column:
        low, first = v["low"], v["first"]
        tests = {
            "filler": first.isin(lx.OPENING_FILLERS), "strong": first.isin(lx.OPENING_STRONG),
            "question": first.isin(lx.OPENING_QUESTIONS), "conflict": tx.contains_any(low, lx.CONFLICT_PHRASES),
            "surprise": tx.contains_any(low, lx.SURPRISE_PHRASES), "prediction": tx.contains_any(low, lx.PREDICTION_PHRASES),
            "mistake": tx.contains_any(low, lx.MISTAKE_PHRASES), "secret": tx.contains_any(low, lx.SECRET_PHRASES),
            "number": tx.has_number(low) | tx.contains_any(low, lx.NUMBER_PHRASES),
        }
        return F.struct(v["scores"].alias("scores"), *[t.alias(n) for n, t in tests.items()])

    moves = {
        "hook_strength": [("filler", -2.0), ("strong", 1.0), ("number", 1.0)],
        "first_3_second_hook": [("filler", -2.0), ("strong", 1.0)],
        "curiosity_gap": [("question", 1.0), ("prediction", 0.5), ("secret", 1.0)],
        "controversy": [("conflict", 1.0), ("mistake", 1.0)],
        "surprise": [("surprise", 1.0)],
        "emotional_intensity": [("mistake", 1.0)],
    }

    def moved(t: Column) -> Column:
        fields = []
        for name in lx.FACTORS:
            value = factor(t["scores"], name)
            for test, delta in moves.get(name, []):
                value = value + F.when(t[test], F.lit(delta)).otherwise(F.lit(0.0))
            fields.append(F.greatest(F.lit(1.0), F.least(F.lit(10.0), value)).alias(name))
        return F.struct(*fields)

    return tx.bind(facts, lambda v: tx.bind(tested(v), moved))


def virality(adjusted: Column, weights: dict[str, float] = lx.WEIGHTS_A) -> Column:
    """Weighted sum of adjusted factors, 2 decimals."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + adjusted[name] * F.lit(weight)
    return F.round(total, 2)


def arm_of(clip_id: Column) -> Column:
    """A/B arm from the clip id alone, so that a re-run or a lost task picks the same arm."""
    return F.when(F.substring(F.sha2(clip_id, 256), 1, 1) < "8", F.lit("A")).otherwise(F.lit("B"))


def completeness(start_clean: Column, sentence_start: Column, hook: Column, end_clean: Column,
                 duration: Column, audio_refined: Column) -> Column:
    """Story completeness between 1 and 10."""
    score = (F.lit(5.0) + F.when(start_clean, 1.5).otherwise(-0.5) + F.when(sentence_start, 1.5).otherwise(0.0)
             + F.when(hook, 2.0).otherwise(0.0) + F.when(end_clean, 1.5).otherwise(0.0)
             + F.when(audio_refined, 1.5).when(end_clean, 1.0).otherwise(0.0)
             + F.when(duration.between(30.0, 45.0), 1.0).when(duration.between(25.0, 58.0), 0.5).otherwise(0.0))
    return F.greatest(F.lit(1.0), F.least(F.lit(10.0), F.round(score, 1)))


def disagreement(score: Column, selected: Column, rejected: Column) -> Column:
    """``overvalued`` / ``undervalued`` / NULL."""
    return F.when((score >= 7.5) & rejected, "overvalued").when((score <= 5.0) & selected, "undervalued")


def disagreement_cause(score: Column, selected: Column, rejected: Column, scores: Column) -> Column:
    controversy, story = factor(scores, "controversy"), factor(scores, "storytelling")
    action, hook = factor(scores, "actionability"), factor(scores, "first_3_second_hook")
    over = (F.when(controversy >= 8.0, lx.CAUSE_CONTROVERSY)
            .when((story >= 8.0) & (action <= 5.0), lx.CAUSE_NARRATIVE).otherwise(lx.CAUSE_OVERVALUED))
    under = (F.when((action >= 7.0) & (hook <= 5.0), lx.CAUSE_UTILITY)
             .when((story >= 7.0) & (hook <= 5.0), lx.CAUSE_SLOW_STORY).otherwise(lx.CAUSE_NICHE))
    kind = disagreement(score, selected, rejected)
    return F.when(kind == "overvalued", over).when(kind == "undervalued", under)


def creator_action(selected: Column, rejected: Column) -> Column:
    return F.when(rejected, "Rejected").when(selected, "Selected").otherwise("Pending")
