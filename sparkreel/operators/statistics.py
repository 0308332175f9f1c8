"""Correlation, weight recommendation, experiments and disagreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkreel import lexicon as lx
from sparkreel.functions import scoring, stats


def correlation_input(clips: DataFrame) -> DataFrame:
    """Clips with any performance; only five columns are read and the filter reaches the scan."""
    return clips.where("views > 0 OR retention > 0 OR shares > 0").select(
        "virality_score", "detailed_scores", "views", "retention", "shares")


def performance_correlations(clips: DataFrame) -> DataFrame:
    """(factor, metric, r): all 33 coefficients from one partial aggregation; empty below two rows."""
    rows = correlation_input(clips).where("detailed_scores IS NOT NULL")
    cells = [(f, m) for f in lx.FACTORS for m in lx.PERFORMANCE_METRICS]
    wide = rows.agg(F.count("*").alias("n"), *[
        stats.pearson(scoring.factor(F.col("detailed_scores"), f), F.col(m)).alias(f"{f}.{m}") for f, m in cells])
    long = F.explode(F.array(*[
        F.struct(F.lit(f).alias("factor"), F.lit(m).alias("metric"), F.col(f"`{f}.{m}`").alias("r")) for f, m in cells]))
    return wide.where("n >= 2").select(long.alias("cell")).select("cell.*")


def recommend_weights(correlations: DataFrame, weights: dict[str, float] = lx.WEIGHTS_A) -> DataFrame:
    """Per factor: composite correlation, current and recommended weight and their difference."""
    pair = [F.lit(v) for kv in weights.items() for v in kv]
    share = [F.lit(v) for kv in lx.COMPOSITE_SHARE.items() for v in kv]
    per_factor = correlations.groupBy("factor").agg(
        F.sum(F.col("r") * F.create_map(*share)[F.col("metric")]).alias("composite"))
    current = F.create_map(*pair)[F.col("factor")]
    raised = per_factor.select("factor", "composite", current.alias("current_weight"),
                               F.greatest(F.lit(0.02), current * (1 + 0.5 * F.col("composite"))).alias("raw"))
    # Eleven rows: one per factor.
    total = F.sum("raw").over(Window.partitionBy())
    return raised.withColumn("recommended_weight", F.round(F.col("raw") / total, 4)).withColumn(
        "weight_change", F.round(F.col("recommended_weight") - F.col("current_weight"), 4)).drop("raw")


def top_bottom_factors(recommended: DataFrame, n: int = 3) -> DataFrame:
    """The strongest and weakest ``n`` factors by composite correlation; ties keep factor order."""
    order = F.array_position(F.array(*[F.lit(f) for f in lx.FACTORS]), F.col("factor"))
    # Sums of distributed rows differ in their last bits from run to run, so factors that agree in nine digits are tied.
    level = F.round("composite", 9)
    best = Window.partitionBy().orderBy(level.desc(), order)
    worst = Window.partitionBy().orderBy(level.asc(), order)
    ranked = recommended.select("factor", "composite", F.row_number().over(best).alias("top"),
                                F.row_number().over(worst).alias("bottom"))
    ends = F.filter(F.array(F.struct(F.lit("top").alias("side"), F.col("top").alias("rank")),
                            F.struct(F.lit("bottom").alias("side"), F.col("bottom").alias("rank"))),
                    lambda e: e["rank"] <= n)
    return ranked.select("factor", F.round("composite", 4).alias("correlation"), F.explode(ends).alias("e")).select(
        "e.side", "e.rank", "factor", "correlation")


def with_scaled(df: DataFrame, columns: list[str], scope: DataFrame | None = None) -> DataFrame:
    """Each column scaled to 0..10 over all of ``scope``; a constant column gives 5.

    The limits are one row, read as a scalar subquery: no join and no single-partition window.
    """
    limits = (scope or df).agg(*[f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)])
    bounds = limits.select(F.struct("*").alias("b")).scalar()

    def scaled(c: str) -> Column:
        low, high = bounds[f"min_{c}"], bounds[f"max_{c}"]
        return F.when(high > low, F.try_divide(10.0 * (F.col(c) - low), (high - low).cast("double"))).otherwise(5.0)

    return df.withColumns({f"{c}_scaled": scaled(c) for c in columns})


def with_composite(clips: DataFrame) -> DataFrame:
    scaled = with_scaled(clips, lx.PERFORMANCE_METRICS)
    return scaled.withColumn("composite", F.lit(0.4) * F.col("views_scaled") + F.lit(0.4) * F.col("retention_scaled")
                             + F.lit(0.2) * F.col("shares_scaled"))


def arm_summary(clips: DataFrame) -> DataFrame:
    """Per experiment: count, mean and sample variance of the composite in arms A and B."""
    experiment = F.coalesce(F.nullif("experiment_id", F.lit("")), F.lit(lx.ACTIVE_EXPERIMENT))
    fallback = F.nullif("scoring_version", F.lit("")) if "scoring_version" in clips.columns else F.lit(None)
    arm = F.coalesce(F.nullif("variant_id", F.lit("")), fallback, F.lit("A"))
    rows = with_composite(clips).select(experiment.alias("experiment_id"), arm.alias("arm"), "composite")
    of = lambda name: F.when(F.col("arm") == name, F.col("composite"))
    return rows.groupBy("experiment_id").agg(*[
        f.alias(f"{label}_{name}") for name in ("A", "B")
        for label, f in (("n", F.count(of(name))), ("mean", F.avg(of(name))), ("var", F.var_samp(of(name))))])


def judge_arms(summary: DataFrame, min_sample: int = 30, min_confidence: float = 95.0) -> DataFrame:
    """Welch's test, leader and guarded winner from an ``arm_summary``."""
    test = stats.welch(*[F.coalesce(F.col(c), F.lit(0)) for c in ("n_A", "mean_A", "var_A", "n_B", "mean_B", "var_B")])
    enough = (F.col("n_A") >= 2) & (F.col("n_B") >= 2)
    leader = F.when(enough, F.when(F.col("mean_A") == F.col("mean_B"), "Tie").when(F.col("mean_A") > F.col("mean_B"), "A")
                    .otherwise("B"))
    met = (F.col("n_A") >= min_sample) & (F.col("n_B") >= min_sample) & (F.col("test.confidence_level") >= min_confidence)
    return summary.withColumn("test", test).withColumn("current_leader", leader).withColumn("thresholds_met", met).select(
        "experiment_id", F.col("n_A").alias("sample_size_a"), F.col("n_B").alias("sample_size_b"),
        F.round(F.when(enough, F.col("mean_A")), 4).alias("mean_composite_a"),
        F.round(F.when(enough, F.col("mean_B")), 4).alias("mean_composite_b"), "test.*", "current_leader",
        F.when(F.col("thresholds_met") & (F.col("current_leader") != "Tie"), F.col("current_leader")).alias("winner"),
        "thresholds_met",
        F.when(F.col("thresholds_met"), "Statistically Significant Winner Declared")
        .otherwise("Experiment Running - More Data Required").alias("status"))


def ab_test(clips: DataFrame) -> DataFrame:
    return judge_arms(arm_summary(clips))


def guardrails(result: DataFrame, min_sample: int = 30, min_confidence: float = 95.0) -> DataFrame:
    checks = [("Minimum Sample Size (A)", "sample_size_a", min_sample), ("Minimum Sample Size (B)", "sample_size_b", min_sample),
              ("Minimum Confidence", "confidence_level", min_confidence)]
    rows = F.explode(F.array(*[F.struct(
        F.lit(name).alias("guardrail"), F.lit(float(limit)).alias("required"), F.col(c).cast("double").alias("current"),
        F.when(F.col(c) >= limit, "Pass").otherwise("Fail").alias("status")) for name, c, limit in checks]))
    return result.select("experiment_id", rows.alias("g")).select("experiment_id", "g.*")


def disagreements(clips: DataFrame) -> DataFrame:
    """Clips whose score and creator decision contradict each other, with the telling factors."""
    score, chosen, refused = F.col("virality_score"), F.col("creator_selected"), F.col("creator_rejected")
    kind = scoring.disagreement(score, chosen, refused)
    telling = F.when(F.col("kind") == "overvalued", F.map_filter("detailed_scores", lambda k, v: v >= 8.0)).otherwise(
        F.map_filter("detailed_scores", lambda k, v: v <= 4.0))
    return clips.withColumn("kind", kind).where("kind IS NOT NULL").select(
        "clip_id", "video_id", "kind", "virality_score", telling.alias("telling_factors"),
        scoring.creator_action(chosen, refused).alias("creator_action"),
        scoring.disagreement_cause(score, chosen, refused, F.col("detailed_scores")).alias("probable_cause"))


def arm_weights(clips: DataFrame, arms: DataFrame) -> DataFrame:
    """Score of every clip under the weights of its arm.

    ``arms`` is (variant_id, weights MAP): one row per arm, so the join is a lookup and the factors
    never leave their row. A clip whose arm is unknown keeps its row and has no score.
    """
    joined = clips.join(arms, "variant_id", "left")
    total = F.aggregate(F.map_entries("weights"), F.lit(0.0),
                        lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at("detailed_scores", e["key"]), F.lit(5.0)))
    return joined.withColumn("arm_score", F.round(total, 2)).drop("weights")
