"""Special functions and distributions as Column expressions.

Everything here stays inside whole-stage code generation; only the gamma inverse, which iterates, is a
pandas function over Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import interpolate

# Acklam's rational approximation of the normal inverse.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
# Abramowitz and Stegun 7.1.26, and Lanczos' series for g = 7.
ERF = (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592)
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
# Reduced mean and deviation of Gumbel's variate by sample size, and chi-square at 5 %.
GUMBEL_N = (10, 15, 20, 25, 30, 35, 40, 45, 50, 60, 80, 100)
GUMBEL_YN = (0.4952, 0.5128, 0.5236, 0.5309, 0.5362, 0.5403, 0.5436, 0.5463, 0.5485, 0.5521, 0.5569, 0.5600)
GUMBEL_SN = (0.9496, 1.0206, 1.0628, 1.0915, 1.1124, 1.1285, 1.1413, 1.1518, 1.1607, 1.1747, 1.1938, 1.2065)
CHI2_5 = (3.84, 5.99, 7.81, 9.49, 11.07, 12.59, 14.07, 15.51, 16.92, 18.31, 19.68, 21.03, 22.36, 23.68, 25.00)


def horner(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def norm_inv(p: Column) -> Column:
    """Standard normal quantile; null outside (0, 1)."""
    low = 0.02425

    def tail(q: Column) -> Column:
        return horner(ACKLAM_C, q) / horner((*ACKLAM_D, 1.0), q)

    q = p - F.lit(0.5)
    middle = horner(ACKLAM_A, q * q) * q / horner((*ACKLAM_B, 1.0), q * q)
    return F.when((p <= 0) | (p >= 1), F.lit(None).cast("double")).when(p < low, tail(F.sqrt(-2 * F.log(p)))).when(p <= 1 - low, middle).otherwise(-tail(F.sqrt(-2 * F.log(1 - p))))


def erf(x: Column) -> Column:
    t = 1 / (1 + F.lit(0.3275911) * F.abs(x))
    y = 1 - horner(ERF, t) * t * F.exp(-x * x)
    return F.when(x >= 0, y).otherwise(-y)


def norm_cdf(z: Column) -> Column:
    return F.lit(0.5) * (1 + erf(z / F.lit(math.sqrt(2))))


def ln_gamma(x: Column) -> Column:
    """ln of the gamma function for x of 0.5 or more; below, by reflection."""

    def series(v: Column) -> Column:
        v = v - 1
        total = F.lit(LANCZOS[0])
        for i, c in enumerate(LANCZOS[1:], 1):
            total = total + F.lit(c) / (v + i)
        t = v + F.lit(7.5)
        return F.lit(0.5 * math.log(2 * math.pi)) + (v + 0.5) * F.log(t) - t + F.log(total)

    return F.when(x < 0.5, F.log(F.lit(math.pi) / F.sin(F.lit(math.pi) * x)) - series(1 - x)).otherwise(series(x))


def k_pearson(skew: Column, p: Column) -> Column:
    """Pearson III frequency factor (Wilson and Hilferty)."""
    z, k = norm_inv(p), skew / 6
    safe = F.when(F.abs(skew) < 1e-6, F.lit(1.0)).otherwise(skew)
    return F.when(F.abs(skew) < 1e-6, z).otherwise((2 / safe) * (F.pow((z - k) * k + 1, F.lit(3.0)) - 1))


def gumbel_yn(n: Column) -> Column:
    return interpolate.table(n.cast("double"), GUMBEL_N, GUMBEL_YN)


def gumbel_sn(n: Column) -> Column:
    return interpolate.table(n.cast("double"), GUMBEL_N, GUMBEL_SN)


def adjusted_skew(value: Column) -> Column:
    """Aggregate: n / ((n - 1)(n - 2)) sum d^3 / s^3; null with fewer than three values."""
    n = F.count(value).cast("double")
    return F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))


def chi2_critical(df: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, CHI2_5)), (df - 1).cast("int")), F.lit(25.0))


def outlier_kn(n: Column) -> Column:
    """Grubbs and Beck's K_N at 10 % by the polynomial of Bulletin 17B."""
    n = n.cast("double")
    return F.lit(-3.62201) + F.lit(6.28446) * F.pow(n, F.lit(0.25)) - F.lit(2.49835) * F.sqrt(n) + F.lit(0.491436) * F.pow(n, F.lit(0.75)) - F.lit(0.037911) * n


# --- the gamma inverse, vectorised -------------------------------------------------------------


def np_norm_inv(p: np.ndarray) -> np.ndarray:
    p = np.asarray(p, float)
    with np.errstate(all="ignore"):
        lower, upper = np.sqrt(-2 * np.log(p)), np.sqrt(-2 * np.log(1 - p))
        tail = lambda q: np.polyval(ACKLAM_C, q) / np.polyval((*ACKLAM_D, 1.0), q)
        q = p - 0.5
        middle = np.polyval(ACKLAM_A, q * q) * q / np.polyval((*ACKLAM_B, 1.0), q * q)
        return np.where((p <= 0) | (p >= 1), np.nan, np.where(p < 0.02425, tail(lower), np.where(p <= 1 - 0.02425, middle, -tail(upper))))


_ln_gamma = np.vectorize(math.lgamma, otypes=[float])


def np_gamma_p(s: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma: power series below s + 1, continued fraction (Lentz) above.

    Near x = s both need some multiple of sqrt(s) terms, so their number follows the largest s."""
    s, x = np.broadcast_arrays(np.asarray(s, float), np.asarray(x, float))
    most = 400 + int(20 * math.sqrt(np.max(s, initial=0.0, where=np.isfinite(s))))
    with np.errstate(all="ignore"):
        front = np.exp(-x + s * np.log(x) - _ln_gamma(s))
        term = total = 1 / s
        a = s.copy()
        for _ in range(most):
            a = a + 1
            term = term * x / a
            total = total + term
            if np.all(~(np.abs(term) > np.abs(total) * 1e-14) | (x >= s + 1)):
                break
        b = x + 1 - s
        c = np.full_like(b, 1e300)
        d = 1 / np.where(b == 0, 1e-300, b)
        h = d.copy()
        for i in range(1, most):
            an = -i * (i - s)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + an / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            h = h * d * c
            if np.all(~(np.abs(d * c - 1) >= 1e-14) | (x < s + 1)):
                break
        return np.where(x <= 0, 0.0, np.where(x < s + 1, total * front, 1 - front * h))


def np_gamma_inv(s: np.ndarray, p: np.ndarray) -> np.ndarray:
    """x with P(s, x) = p: Wilson and Hilferty's start, then damped Newton steps."""
    s, p = np.broadcast_arrays(np.asarray(s, float), np.asarray(p, float))
    with np.errstate(all="ignore"):
        x = s * (1 - 1 / (9 * s) + np_norm_inv(p) / (3 * np.sqrt(s))) ** 3
        x = np.where(x > 0, x, 1e-3)
        for _ in range(60):
            slope = np.exp((s - 1) * np.log(x) - x - _ln_gamma(s))
            step = np.where(slope < 1e-300, 0.0, (np_gamma_p(s, x) - p) / slope)
            step = np.clip(np.nan_to_num(step), -0.5 * x, 0.5 * x)
            x = np.maximum(x - step, 1e-12)
            if np.all(np.abs(step) < 1e-11 * x):
                break
        return np.where((p <= 0) | ~(s > 0), np.where(s > 0, 0.0, np.nan), x)


@F.pandas_udf(DoubleType())
def gamma_inv(s: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series(np_gamma_inv(s.to_numpy(float), p.to_numpy(float)))


@F.pandas_udf(DoubleType())
def gamma_p(s: pd.Series, x: pd.Series) -> pd.Series:
    return pd.Series(np_gamma_p(s.to_numpy(float), x.to_numpy(float)))


DISTRIBUTIONS = ("normal", "lognormal", "pearson3", "logpearson3", "gumbel", "gamma")


def quantile(dist: str, t: Column, m: dict[str, Column]) -> Column:
    """Quantile of return period t from moments: n, mean, std, skew, mean_ln, std_ln, mean_log, std_log, skew_log."""
    p = 1 - 1 / t
    if dist == "normal":
        return m["mean"] + norm_inv(p) * m["std"]
    if dist == "lognormal":
        return F.exp(m["mean_ln"] + norm_inv(p) * m["std_ln"])
    if dist == "pearson3":
        return m["mean"] + k_pearson(m["skew"], p) * m["std"]
    if dist == "logpearson3":
        return F.pow(F.lit(10.0), m["mean_log"] + k_pearson(m["skew_log"], p) * m["std_log"])
    if dist == "gumbel":
        yn, sn = (m["yn"], m["sn"]) if "yn" in m else (gumbel_yn(m["n"]), gumbel_sn(m["n"]))
        return m["mean"] + m["std"] * (-F.log(-F.log(p)) - yn) / sn
    if dist == "gamma":
        return m["std"] * m["std"] / m["mean"] * gamma_inv(F.pow(m["mean"] / m["std"], F.lit(2.0)), p)
    raise ValueError(dist)
