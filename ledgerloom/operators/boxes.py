"""Validity boxes: map<axis, struct<lo, hi>>; a missing axis or a null end is unbounded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def _lo(x: Column) -> Column:
    return F.coalesce(F.when(F.isnan(x["lo"]), F.lit(None)).otherwise(x["lo"]), F.lit(-INF))


def _hi(x: Column) -> Column:
    return F.coalesce(F.when(F.isnan(x["hi"]), F.lit(None)).otherwise(x["hi"]), F.lit(INF))


def tidy(box: Column) -> Column:
    """The box with its open ends written out; null becomes the empty (unrestricted) box, null entries go."""
    known = F.map_filter(box, lambda k, v: v.isNotNull())
    return F.coalesce(F.transform_values(known, lambda k, v: F.struct(_lo(v).alias("lo"), _hi(v).alias("hi"))), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<lo:double,hi:double>>")))


def intersection(a: Column, b: Column) -> Column:
    """Axis by axis, of two tidy boxes; null if some axis is left empty."""
    both = F.map_zip_with(a, b, lambda k, x, y: F.struct(F.greatest(F.coalesce(x["lo"], F.lit(-INF)), F.coalesce(y["lo"], F.lit(-INF))).alias("lo"), F.least(F.coalesce(x["hi"], F.lit(INF)), F.coalesce(y["hi"], F.lit(INF))).alias("hi")))
    return F.when(~F.exists(F.map_values(both), lambda v: v["lo"] > v["hi"]), both)


def meet(a: Column, b: Column) -> Column:
    """Whether two tidy boxes share a point."""
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return ~F.exists(shared, lambda k: F.greatest(F.element_at(a, k)["lo"], F.element_at(b, k)["lo"]) > F.least(F.element_at(a, k)["hi"], F.element_at(b, k)["hi"]))


def contains(box: Column, point: Column) -> Column:
    """Whether a point map<axis, double> lies in a tidy box: the empty box holds every point; a box that shares no axis with the point does not hold it."""
    shared = F.array_intersect(F.map_keys(box), F.map_keys(point))
    inside = ~F.exists(shared, lambda k: (F.element_at(point, k) < F.element_at(box, k)["lo"]) | (F.element_at(point, k) > F.element_at(box, k)["hi"]))
    return (F.size(box) == 0) | ((F.size(shared) > 0) & inside)


def gap_point(a: Column, b: Column) -> Column:
    """For disjoint tidy boxes: per separating axis the middle between them."""
    gap = F.map_zip_with(a, b, lambda k, x, y: F.struct(F.least(F.coalesce(x["hi"], F.lit(INF)), F.coalesce(y["hi"], F.lit(INF))).alias("lo"), F.greatest(F.coalesce(x["lo"], F.lit(-INF)), F.coalesce(y["lo"], F.lit(-INF))).alias("hi")))
    return F.transform_values(F.map_filter(gap, lambda k, v: v["lo"] < v["hi"]), lambda k, v: (v["lo"] + v["hi"]) / 2)


def agree(a: Column, b: Column) -> Column:
    """Whether two map<axis, array<value>> regimes share a value on every common axis; null is unrestricted."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>"))
    x, y = F.coalesce(a, none), F.coalesce(b, none)
    return ~F.exists(F.array_intersect(F.map_keys(x), F.map_keys(y)), lambda k: ~F.coalesce(F.arrays_overlap(F.element_at(x, k), F.element_at(y, k)), F.lit(True)))
