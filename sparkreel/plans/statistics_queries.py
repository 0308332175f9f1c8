"""Statistics over the clip table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkreel import lexicon as lx
from sparkreel.operators import statistics as st
from sparkreel.plans import inputs
from sparkreel.plans.registry import query
from sparkreel.plans.views import factor_of, q, with_views

ACTIVE = "WHERE views > 0 OR retention > 0 OR shares > 0"
LONG = " UNION ALL ".join(
    f"SELECT {q(f)} AS factor, {q(m)} AS metric, {factor_of(f)} AS x, {m}::DOUBLE AS y FROM clips {ACTIVE}"
    for f in lx.FACTORS for m in lx.PERFORMANCE_METRICS)
CORR = f"""SELECT factor, metric, CASE WHEN min(x) = max(x) OR min(y) = max(y) THEN 0e0 ELSE corr(x, y) END AS r
           FROM ({LONG}) GROUP BY factor, metric HAVING count(*) >= 2"""
WEIGHTS = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {q(f)}, {w}e0, {lx.WEIGHTS_B[f]}e0)" for i, (f, w) in enumerate(lx.WEIGHTS_A.items())) + ") t(ord, factor, w, wb)"
COMPOSITE = """SELECT ord, factor, w, greatest(0.02e0, w * (1 + 0.5e0 * composite)) AS raw, composite
    FROM weights JOIN (SELECT factor, sum(r * CASE metric WHEN 'shares' THEN 0.2e0 ELSE 0.4e0 END) AS composite
                       FROM correlations GROUP BY factor) USING (factor)"""
SCALED = ", ".join(
    f"CASE WHEN max({m}) OVER () > min({m}) OVER () THEN 10e0 * ({m} - min({m}) OVER ()) / "
    f"(max({m}) OVER () - min({m}) OVER ()) ELSE 5e0 END AS {m}_scaled" for m in lx.PERFORMANCE_METRICS)
ARMS = """SELECT coalesce(experiment_id, 'exp_virality_v1') AS experiment_id, variant_id AS arm,
    0.4e0 * views_scaled + 0.4e0 * retention_scaled + 0.2e0 * shares_scaled AS c FROM scaled"""
# erf through the lower incomplete gamma series, written with log-gamma instead of a running product.
ERF = """CASE WHEN z / sqrt(2e0) > 6 THEN 1e0 WHEN z = 0 THEN 0e0 ELSE least(1e0,
    exp(-z * z / 2) * list_sum(list_transform(range(0, 200), lambda n:
        exp((2 * n + 1) * ln(z / sqrt(2e0)) - lgamma(n + 1.5e0))))) END"""
JUDGED = f"""SELECT *, CASE WHEN usable THEN round(t, 4) ELSE 0e0 END AS t_statistic,
        CASE WHEN usable THEN round(1 - e, 4) ELSE 1e0 END AS p_value,
        CASE WHEN usable THEN round(e * 100, 2) ELSE 0e0 END AS confidence_level
    FROM (SELECT *, {ERF} AS e
          FROM (SELECT *, CASE WHEN usable AND df > 1 THEN abs(t) * (1 - 1 / (4 * df)) / sqrt(1 + t * t / (2 * df)) ELSE abs(t) END AS z
                FROM (SELECT *, CASE WHEN usable THEN (ma - mb) / sqrt(s1 + s2) ELSE 0e0 END AS t,
                             (s1 + s2) * (s1 + s2) / (s1 * s1 / (na - 1) + s2 * s2 / (nb - 1)) AS df
                      FROM (SELECT *, na >= 2 AND nb >= 2 AND va / na + vb / nb > 0 AS usable, va / na AS s1, vb / nb AS s2
                            FROM (SELECT experiment_id, count(*) FILTER (arm = 'A') AS na, count(*) FILTER (arm = 'B') AS nb,
                                         avg(c) FILTER (arm = 'A') AS ma, avg(c) FILTER (arm = 'B') AS mb,
                                         var_samp(c) FILTER (arm = 'A') AS va, var_samp(c) FILTER (arm = 'B') AS vb
                                  FROM arms GROUP BY experiment_id)))))"""
RESULT = """SELECT experiment_id, na AS sample_size_a, nb AS sample_size_b,
    round(ma, 4) AS mean_composite_a, round(mb, 4) AS mean_composite_b, t_statistic, p_value, confidence_level,
    CASE WHEN ma = mb THEN 'Tie' WHEN ma > mb THEN 'A' ELSE 'B' END AS current_leader,
    CASE WHEN na >= 30 AND nb >= 30 AND confidence_level >= 95 AND ma <> mb
         THEN CASE WHEN ma > mb THEN 'A' ELSE 'B' END END AS winner,
    na >= 30 AND nb >= 30 AND confidence_level >= 95 AS thresholds_met,
    CASE WHEN na >= 30 AND nb >= 30 AND confidence_level >= 95 THEN 'Statistically Significant Winner Declared'
         ELSE 'Experiment Running - More Data Required' END AS status FROM judged"""


@query("correlation_input", with_views(f"""
    SELECT virality_score, {factor_of('hook_strength')} AS hook_strength, views, retention, shares FROM clips {ACTIVE}""", "clips"))
def correlation_input(spark, sf):
    return st.correlation_input(inputs.clips(spark, sf)).withColumn(
        "hook_strength", F.col("detailed_scores")["hook_strength"]).drop("detailed_scores")


@query("performance_correlations", with_views("SELECT factor, metric, round(r, 6) AS r FROM correlations",
                                              "clips", correlations=CORR))
def performance_correlations(spark, sf):
    return st.performance_correlations(inputs.clips(spark, sf)).withColumn("r", F.round("r", 6))


@query("pearson", """
    SELECT event_type, CASE WHEN count(*) < 2 THEN 0e0 ELSE round(corr(value, hour(ts)), 6) END AS r, 0e0 AS r_constant
    FROM events GROUP BY event_type""")
def pearson(spark, sf):
    from sparkreel.functions.stats import pearson as r
    return inputs.table(spark, sf, "events").groupBy("event_type").agg(
        F.round(r(F.col("value"), F.hour("ts")), 6).alias("r"), r(F.col("value"), F.lit(1)).alias("r_constant"))


@query("recommend_weights", with_views("""
    SELECT factor, round(composite, 6) AS composite, w AS current_weight,
           round(raw / sum(raw) OVER (), 4) AS recommended_weight,
           round(round(raw / sum(raw) OVER (), 4) - w, 4) AS weight_change FROM composites""",
    "clips", correlations=CORR, weights=WEIGHTS, composites=COMPOSITE))
def recommend_weights(spark, sf):
    return st.recommend_weights(st.performance_correlations(inputs.clips(spark, sf))).withColumn(
        "composite", F.round("composite", 6))


@query("top_bottom_factors", with_views("""
    SELECT 'top' AS side, rank, factor, correlation FROM (
        SELECT factor, round(composite, 4) AS correlation, row_number() OVER (ORDER BY round(composite, 9) DESC, ord)::INTEGER AS rank
        FROM composites) WHERE rank <= 3
    UNION ALL SELECT 'bottom', rank, factor, correlation FROM (
        SELECT factor, round(composite, 4) AS correlation, row_number() OVER (ORDER BY round(composite, 9), ord)::INTEGER AS rank
        FROM composites) WHERE rank <= 3""", "clips", correlations=CORR, weights=WEIGHTS, composites=COMPOSITE))
def top_bottom_factors(spark, sf):
    return st.top_bottom_factors(st.recommend_weights(st.performance_correlations(inputs.clips(spark, sf))))


@query("minmax_scale", with_views("""SELECT clip_id, round(views_scaled, 6) AS views_scaled,
    round(retention_scaled, 6) AS retention_scaled, round(shares_scaled, 6) AS shares_scaled FROM scaled""",
    "clips", scaled=f"SELECT *, {SCALED} FROM clips"))
def minmax_scale(spark, sf):
    scaled = st.with_scaled(inputs.clips(spark, sf), lx.PERFORMANCE_METRICS)
    return scaled.select("clip_id", *[F.round(f"{m}_scaled", 6).alias(f"{m}_scaled") for m in lx.PERFORMANCE_METRICS])


@query("welch_t", with_views("""SELECT experiment_id, na AS n_a, nb AS n_b, t_statistic, p_value, confidence_level FROM judged""",
    "clips", scaled=f"SELECT *, {SCALED} FROM clips", arms=ARMS.replace(
        "0.4e0 * views_scaled + 0.4e0 * retention_scaled + 0.2e0 * shares_scaled", "virality_score"), judged=JUDGED))
def welch_t(spark, sf):
    from sparkreel.functions.stats import welch
    of = lambda name: F.when(F.col("variant_id") == name, F.col("virality_score"))
    clips = inputs.clips(spark, sf).withColumn("experiment_id", F.coalesce("experiment_id", F.lit(lx.ACTIVE_EXPERIMENT)))
    arms = clips.groupBy("experiment_id").agg(*[
        f(of(n)).alias(f"{label}_{n.lower()}") for n in "AB" for label, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    test = welch(*[F.coalesce(F.col(c), F.lit(0)) for c in ("n_a", "m_a", "v_a", "n_b", "m_b", "v_b")])
    return arms.select("experiment_id", "n_a", "n_b", test.alias("t")).select("experiment_id", "n_a", "n_b", "t.*")


@query("ab_test", with_views(RESULT, "clips", scaled=f"SELECT *, {SCALED} FROM clips", arms=ARMS, judged=JUDGED))
def ab_test(spark, sf):
    return st.ab_test(inputs.clips(spark, sf))


@query("guardrails", with_views("""
    SELECT experiment_id, 'Minimum Sample Size (A)' AS guardrail, 30e0 AS required, sample_size_a::DOUBLE AS current,
           CASE WHEN sample_size_a >= 30 THEN 'Pass' ELSE 'Fail' END AS status FROM result
    UNION ALL SELECT experiment_id, 'Minimum Sample Size (B)', 30e0, sample_size_b::DOUBLE,
           CASE WHEN sample_size_b >= 30 THEN 'Pass' ELSE 'Fail' END FROM result
    UNION ALL SELECT experiment_id, 'Minimum Confidence', 95e0, confidence_level,
           CASE WHEN confidence_level >= 95 THEN 'Pass' ELSE 'Fail' END FROM result""",
    "clips", scaled=f"SELECT *, {SCALED} FROM clips", arms=ARMS, judged=JUDGED, result=RESULT))
def guardrails(spark, sf):
    return st.guardrails(st.ab_test(inputs.clips(spark, sf)))


def _scores_text(test: str) -> str:
    parts = [f"CASE WHEN {factor_of(f)} {test} THEN {q(f + '=')} || CAST({factor_of(f)}::INTEGER AS VARCHAR) END" for f in lx.FACTORS]
    return f"concat_ws(', ', {', '.join(parts)})"


F_ = {f: factor_of(f) for f in lx.FACTORS}
DISAGREE = f"""SELECT clip_id, video_id, virality_score, CASE WHEN over THEN 'overvalued' ELSE 'undervalued' END AS kind,
    CASE WHEN over THEN {_scores_text('>= 8')} ELSE {_scores_text('<= 4')} END AS telling,
    CASE WHEN creator_rejected THEN 'Rejected' ELSE 'Selected' END AS creator_action,
    CASE WHEN over THEN CASE WHEN {F_['controversy']} >= 8 THEN {q(lx.CAUSE_CONTROVERSY)}
             WHEN {F_['storytelling']} >= 8 AND {F_['actionability']} <= 5 THEN {q(lx.CAUSE_NARRATIVE)}
             ELSE {q(lx.CAUSE_OVERVALUED)} END
         ELSE CASE WHEN {F_['actionability']} >= 7 AND {F_['first_3_second_hook']} <= 5 THEN {q(lx.CAUSE_UTILITY)}
             WHEN {F_['storytelling']} >= 7 AND {F_['first_3_second_hook']} <= 5 THEN {q(lx.CAUSE_SLOW_STORY)}
             ELSE {q(lx.CAUSE_NICHE)} END END AS probable_cause
    FROM (SELECT *, virality_score >= 7.5 AND creator_rejected AS over FROM clips)
    WHERE over OR (virality_score <= 5.0 AND creator_selected)"""


@query("disagreements", with_views(DISAGREE, "clips"))
def disagreements(spark, sf):
    telling = F.array_join(F.transform(F.map_entries("telling_factors"), lambda e: F.concat_ws(
        "=", e["key"], e["value"].cast("int").cast("string"))), ", ")
    return st.disagreements(inputs.clips(spark, sf)).withColumn("telling", telling).drop("telling_factors")


@query("disagreement_counts", with_views("""
    SELECT CASE WHEN virality_score >= 7.5 AND creator_rejected THEN 'overvalued' ELSE 'undervalued' END AS kind, count(*) AS n
    FROM clips WHERE (virality_score >= 7.5 AND creator_rejected) OR (virality_score <= 5.0 AND creator_selected) GROUP BY 1""", "clips"))
def disagreement_counts(spark, sf):
    return st.disagreements(inputs.clips(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"))


ARM_SUM = "0e0 + " + " + ".join(
    f"{factor_of(f)} * CASE variant_id WHEN 'A' THEN {lx.WEIGHTS_A[f]}e0 ELSE {lx.WEIGHTS_B[f]}e0 END" for f in lx.FACTORS)


@query("arm_weights", with_views(f"SELECT clip_id, variant_id, weight_version, round({ARM_SUM}, 2) AS arm_score FROM (SELECT *, "
                                 "CASE variant_id WHEN 'A' THEN 'weight_v1_baseline' ELSE 'weight_v2_high_hook' END AS weight_version FROM clips)", "clips"))
def arm_weights(spark, sf):
    from sparkreel.operators.scorer import arm_table
    return st.arm_weights(inputs.clips(spark, sf), arm_table(spark)).select("clip_id", "variant_id", "weight_version", "arm_score")
