"""Functions under names that SQL can call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from . import stats


def _horner(coefficients: Sequence[float], x: str) -> str:
    out = f"{coefficients[0]!r}D"
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c!r}D))"
    return out


def _norm_inv() -> str:
    """The quantile of stats.norm_inv as the text of an expression of p; null outside (0, 1)."""
    low, mid = 0.02425, "(p - 0.5D)"
    tail = lambda q: f"{_horner(stats.ACKLAM_C, q)} / {_horner((*stats.ACKLAM_D, 1.0), q)}"
    middle = f"{_horner(stats.ACKLAM_A, f'({mid} * {mid})')} * {mid} / {_horner((*stats.ACKLAM_B, 1.0), f'({mid} * {mid})')}"
    return f"CASE WHEN p <= 0 OR p >= 1 THEN NULL WHEN p < {low}D THEN {tail('sqrt(-2 * ln(p))')} WHEN p <= {1 - low!r}D THEN {middle} ELSE -({tail('sqrt(-2 * ln(1 - p))')}) END"


def register(spark: SparkSession) -> None:
    """SQL functions as temporary SQL bodies, so they stay in code generation, and gamma_inv over Arrow.

    interp(x, xs, ys) is linear over ascending xs and holds the ends; normal_depth(q, b, n, s) is that of a rectangle up to 200 deep."""
    flow = "(b * m) * power(b * m / (b + 2 * m), 2D / 3) * sqrt(s) / n"
    bodies = {
        "haversine_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE)": "2 * 6371 * asin(least(1D, sqrt(power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2))))",
        "scs_pe(p DOUBLE, cn DOUBLE)": "CASE WHEN p > 0.2 * (25400 / cn - 254) THEN power(p - 0.2 * (25400 / cn - 254), 2) / (p + 0.8 * (25400 / cn - 254)) ELSE 0D END",
        "hazard_class(h DOUBLE, v DOUBLE)": "CASE WHEN h IS NULL OR v IS NULL THEN NULL WHEN h * v <= 0.3 AND h <= 0.3 AND v <= 2 THEN 'H1' WHEN h * v <= 0.6 AND h <= 0.5 AND v <= 2 THEN 'H2' WHEN h * v <= 0.6 AND h <= 1.2 AND v <= 2 THEN 'H3' WHEN h * v <= 1 AND h <= 2 AND v <= 2 THEN 'H4' WHEN h * v <= 4 AND h <= 4 AND v <= 4 THEN 'H5' ELSE 'H6' END",
        "critical_depth(q DOUBLE, b DOUBLE)": "cbrt(q * q / (b * b * 9.81))",
        "norm_inv(p DOUBLE)": _norm_inv(),
        "interp(x DOUBLE, xs ARRAY<DOUBLE>, ys ARRAY<DOUBLE>)": "CASE WHEN x IS NULL THEN NULL WHEN x <= xs[0] THEN ys[0] WHEN x >= element_at(xs, -1) THEN element_at(ys, -1) ELSE aggregate(sequence(1, size(xs) - 1), CAST(NULL AS DOUBLE), (a, i) -> CASE WHEN a IS NULL AND x <= xs[i] THEN ys[i - 1] + (x - xs[i - 1]) / (xs[i] - xs[i - 1]) * (ys[i] - ys[i - 1]) ELSE a END) END",
        "normal_depth(q DOUBLE, b DOUBLE, n DOUBLE, s DOUBLE)": f"aggregate(sequence(1, 80), named_struct('lo', 0D, 'hi', 200D), (a, i) -> transform(array((a.lo + a.hi) / 2), m -> named_struct('lo', CASE WHEN {flow} < q THEN m ELSE a.lo END, 'hi', CASE WHEN {flow} < q THEN a.hi ELSE m END))[0], a -> (a.lo + a.hi) / 2)",
    }
    for head, body in bodies.items():
        kind = "STRING" if head.startswith("hazard") else "DOUBLE"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udf.register("gamma_inv", stats.gamma_inv)
