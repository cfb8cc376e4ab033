"""Piecewise-linear interpolation as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def table(x: Column, xs: Sequence[float], ys: Sequence[float], log_x: bool = False, extend: bool = False) -> Column:
    """y at x over constant knots in ascending order. Clamped at the ends; with extend the last segment goes on. log_x: linear in ln x."""
    scale = F.log if log_x else (lambda c: c)

    def segment(i: int) -> Column:
        a, b = scale(F.lit(float(xs[i]))), scale(F.lit(float(xs[i + 1])))
        return F.lit(float(ys[i])) + (scale(x) - a) / (b - a) * F.lit(float(ys[i + 1] - ys[i]))

    out = F.when(x.isNull(), F.lit(None).cast("double")).when(x <= float(xs[0]), F.lit(float(ys[0])))
    for i in range(len(xs) - 1):
        out = out.when(x <= float(xs[i + 1]), segment(i))
    return out.otherwise(segment(len(xs) - 2) if extend else F.lit(float(ys[-1])))


def curve(x: Column, knots: Column, x_name: str = "x", y_name: str = "y", after: str = "hold") -> Column:
    """y at x over an array of structs sorted by x. before the first knot: its y; after the last: hold it, "zero" or "extend"."""
    below = F.filter(knots, lambda k: k[x_name] <= x)
    above = F.filter(knots, lambda k: k[x_name] > x)
    a, b = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
    last = F.try_element_at(knots, F.lit(-1))
    end = {"hold": last[y_name], "zero": F.when(x == last[x_name], last[y_name]).otherwise(F.lit(0.0))}.get(after)
    if after == "extend":
        prior = F.try_element_at(knots, F.lit(-2))
        end = last[y_name] + (x - last[x_name]) * (last[y_name] - prior[y_name]) / (last[x_name] - prior[x_name])
    inside = a[y_name] + (x - a[x_name]) / (b[x_name] - a[x_name]) * (b[y_name] - a[y_name])
    return F.when(F.size(below) == 0, F.try_element_at(knots, F.lit(1))[y_name]).when(F.size(above) == 0, end).otherwise(inside)
