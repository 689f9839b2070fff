"""Numeric, geometric, set and sequence scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """of two boxes (x1, y1, x2, y2); 0 where the union is empty."""
    side = lambda lo, hi: F.greatest(hi - lo, F.lit(0.0))
    inter = side(F.greatest(a[0], b[0]), F.least(a[2], b[2])) * side(F.greatest(a[1], b[1]), F.least(a[3], b[3]))
    union = side(a[0], a[2]) * side(a[1], a[3]) + side(b[0], b[2]) * side(b[1], b[3]) - inter
    return F.coalesce(F.try_divide(inter, union), F.lit(0.0))


def centre_inside(a: list[Column], b: list[Column]) -> Column:
    """the centre of box a lies in box b."""
    x, y = (a[0] + a[2]) / 2, (a[1] + a[3]) / 2
    return x.between(b[0], b[2]) & y.between(b[1], b[3])


def span_iou(a: list[Column], b: list[Column]) -> Column:
    """of two time spans, over the hull of both."""
    inter = F.greatest(F.least(a[1], b[1]) - F.greatest(a[0], b[0]), F.lit(0.0))
    return F.coalesce(F.try_divide(inter, F.greatest(a[1], b[1]) - F.least(a[0], b[0])), F.lit(0.0))


def merged(spans: Column) -> Column:
    """Overlapping or touching (start, end) structs of an array joined, in order."""
    start = F.slice(spans, 1, 0)

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (x["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(spans), start, step)


def spans_iou(a: Column, b: Column) -> Column:
    """of two lists of spans, each merged first."""
    total = lambda s: F.aggregate(s, F.lit(0.0), lambda acc, x: acc + (x["end"] - x["start"]))
    a, b = merged(a), merged(b)
    pair = lambda x, y: F.greatest(F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"]), F.lit(0.0))
    inter = F.aggregate(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: pair(x, y)))), F.lit(0.0), lambda acc, x: acc + x)
    return F.coalesce(F.try_divide(inter, total(a) + total(b) - inter), F.lit(0.0))


def mean_relative_accuracy(truth: Column, value: Column) -> Column:
    """the share of thresholds 0.50, 0.55, ... 0.95 that 1 minus the relative error exceeds or meets.

    Ten further thresholds from 1 up can't be met and don't count in the divisor.
    """
    error = F.abs(value - truth) / F.abs(F.nullif(truth, F.lit(0.0)))
    met = [(error <= 1 - (0.5 + 0.05 * i)).cast("int") for i in range(10)]
    return sum(met[1:], met[0]) / 10.0


def jaccard(a: Column, b: Column) -> Column:
    """1 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)).cast("double"))


def set_equal(a: Column, b: Column) -> Column:
    """F41"""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def set_precision(found: Column, truth: Column) -> Column:
    """the share of found elements that are true; 0 for none found."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(found, truth)).cast("double"), F.size(F.array_distinct(found))), F.lit(0.0))


def common_prefix_ratio(a: Column, b: Column) -> Column:
    """length of the longest common prefix over that of the truth ``b``; 1 if both are empty."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    first = F.array_position(same, F.lit(False))
    n = F.when(first == 0, F.least(F.size(a), F.size(b))).otherwise(first - 1)
    return F.when(F.size(b) == 0, (F.size(a) == 0).cast("double")).otherwise(n / F.nullif(F.size(b), F.lit(0)).cast("double"))


def mean_square(a: Column, b: Column) -> Column:
    """F44"""
    d = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.try_divide(F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x), F.size(d))


def relative_closeness(truth: Column, value: Column) -> Column:
    """F45"""
    return F.greatest(F.lit(0.0), 1 - F.abs(F.try_divide(value - truth, truth)))


def geo_proximity(lat1: Column, lon1: Column, lat2: Column, lon2: Column, scale_km: float = 100.0) -> Column:
    """exp(-distance / scale), by the great circle on a sphere."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.exp(-(2 * 6371.0088 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))) / scale_km)


def bucket(value: Column, bounds: list[float], labels: list[str]) -> Column:
    """right-closed bins."""
    out = F.when(value <= bounds[0], labels[0])
    for b, label in zip(bounds[1:], labels[1:], strict=False):
        out = out.when(value <= b, label)
    return out.otherwise(labels[-1] if len(labels) > len(bounds) else F.lit(None))


def loss_weight(n: Column) -> Column:
    """1 / sqrt(n); 0 for 0."""
    return F.when(n > 0, 1 / F.sqrt(n.cast("double"))).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    """V8"""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """V4"""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column, least: float = 1e-12) -> Column:
    """V2: null for a vector that is too short to have a direction."""
    return F.when(norm(a) > least, F.transform(a, lambda x: x.cast("double") / norm(a)))


def resized(width: Column, height: Column, most: int, least: int, stride: int) -> Column:
    """(width, height) scaled to the long edge at most, the short edge at least, in whole strides."""
    scale = F.least(F.lit(most) / F.greatest(width, height), F.lit(1.0))
    scale = F.greatest(scale, F.lit(least) / F.least(width, height))
    side = lambda x: F.greatest(F.lit(stride), (F.round(x * scale / stride) * stride).cast("int"))
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def angle_error(a: Column, b: Column) -> Column:
    """degrees between two angles, the short way round."""
    turn = F.abs(a - b) % 360
    return F.least(turn, 360 - turn)


def quantile(sorted_values: Column, share: float) -> Column:
    """The linear quantile of a sorted array of doubles; null for an empty one. The neighbours' shares are added with one
    rounding, as ``quantile_cont`` does in DuckDB: a pixel on the edge between two levels shows the last bit."""

    def at(place: Column) -> Column:
        low = F.floor(place).cast("int")
        a, b = F.get(sorted_values, low), F.get(sorted_values, F.least(low + 1, F.size(sorted_values) - 1))
        return F.try_reflect(F.lit("java.lang.Math"), F.lit("fma"), a, 1.0 - (place - low), b * (place - low)).cast("double")

    return F.element_at(F.transform(F.array((F.size(sorted_values) - 1) * F.lit(share)), at), 1)


def stretched(pixels: Column, lowest: float | None = None, highest: float | None = None, missing: float | None = None, fewest: int = 16) -> Column:
    """pixels as whole numbers 0 to 255 between two quantiles, or between the least and the greatest where none are
    named. Pixels of the missing value don't count for the quantiles, unless fewer than ``fewest`` others are left."""
    values = F.transform(pixels, lambda x: x.cast("double"))
    valid = F.filter(values, lambda x: x < missing) if missing is not None else values
    valid = F.when(F.size(valid) < fewest, values).otherwise(valid) if missing is not None else valid

    def scale(ends: Column) -> Column:
        lo, hi = ends["lo"], ends["hi"]
        if lowest is None:
            level = lambda x: F.when(hi > lo, (x - lo) / (hi - lo) * 255.0).otherwise(0.0)
        else:
            top = F.when(hi > lo, hi).otherwise(lo + 1.0)
            level = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / (top - lo))) * 255.0
        return F.transform(values, lambda x: F.floor(level(x)).cast("int"))

    def ends(s: Column) -> Column:
        return F.struct(quantile(s, lowest or 0.0).alias("lo"), quantile(s, 1.0 if highest is None else highest).alias("hi"))

    return F.element_at(F.transform(F.array(F.element_at(F.transform(F.array(F.array_sort(valid)), ends), 1)), scale), 1)
