"""Statistics as aggregate or scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sparkreel.functions.text import bind


def pearson(x: Column, y: Column) -> Column:
    """Population correlation; 0 below two rows or where either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.coalesce(F.try_divide(F.covar_pop(a, b), spread), F.lit(0.0))


def erf(x: Column) -> Column:
    """Error function by the all-positive series e^(-x^2) * sum (2x^2)^n x / (2n+1)!!.

    Beyond |x| = 6 the value is 1 to double precision; below that 200 terms are more than enough.
    """
    def series(a: Column) -> Column:
        def step(acc: Column, n: Column) -> Column:
            return bind(acc["term"] * 2 * a * a / (2 * n + 1),
                        lambda t: F.struct(t.alias("term"), (acc["total"] + t).alias("total")))
        total = F.aggregate(F.sequence(F.lit(1), F.lit(200)), F.struct(a.alias("term"), a.alias("total")), step,
                            lambda acc: acc["total"])
        near = F.least(F.exp(-a * a) * total * F.lit(1.1283791670955126), F.lit(1.0))
        return F.when(a > 6, F.lit(1.0)).otherwise(near)

    return F.signum(x) * bind(F.abs(x), series)


def welch(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> Column:
    """Welch's test from counts, means and sample variances: struct(t, p, confidence)."""
    def result(t: Column, p: Column, confidence: Column) -> Column:
        return F.struct(t.alias("t_statistic"), p.alias("p_value"), confidence.alias("confidence_level"))

    def test(r: Column) -> Column:
        s1, s2, k1, k2 = r["s1"], r["s2"], r["k1"], r["k2"]
        df = F.coalesce(F.try_divide((s1 + s2) * (s1 + s2), s1 * s1 / (k1 - 1) + s2 * s2 / (k2 - 1)), k1 + k2 - 2)
        parts = F.struct((r["gap"] / F.sqrt(s1 + s2)).alias("t"), df.alias("df"))

        def finish(v: Column) -> Column:
            t, d = v["t"], v["df"]
            z = F.when(d > 1, F.abs(t) * (1 - 1 / (4 * d)) / F.sqrt(1 + t * t / (2 * d))).otherwise(F.abs(t))
            return bind(erf(z / F.sqrt(F.lit(2.0))), lambda e: result(
                F.round(t, 4), F.round(1 - e, 4), F.round(e * 100, 2)))

        return F.when((k1 >= 2) & (k2 >= 2) & (s1 + s2 > 0), bind(parts, finish)).otherwise(
            result(F.lit(0.0), F.lit(1.0), F.lit(0.0)))

    inputs = F.struct(F.try_divide(v1, n1).alias("s1"), F.try_divide(v2, n2).alias("s2"), n1.cast("double").alias("k1"),
                      n2.cast("double").alias("k2"), (m1 - m2).alias("gap"))
    return bind(inputs, test)


def box_iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Overlap over union of two x/y/w/h boxes, 0 where the union is empty."""
    width = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    height = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    union = a["w"] * a["h"] + b["w"] * b["h"] - width * height
    return F.when(union > 0, F.try_divide(width * height, union)).otherwise(F.lit(0.0))
