"""Classic and exponential histograms as array expressions.

A classic histogram's buckets are an array of (le, count) with cumulative counts, the last le infinite. An
exponential one is a struct of count, sum, scale, zero_count, positive and negative: maps from a bucket's
index to its count; bucket i covers (base^i, base^(i+1)] with base = 2^(2^-scale).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ieee import INF, NAN

HISTOGRAM = "struct<count:double,sum:double,scale:int,zero_count:double,positive:map<int,double>,negative:map<int,double>>"


def cumulative(bounds: Column, counts: Column) -> Column:
    """Array of (le, count): each bucket's count with those below it, the last one's bound infinite."""
    return F.transform(
        counts,
        lambda c, i: F.struct(F.coalesce(F.get(bounds, i), F.lit(INF)).alias("le"), F.aggregate(F.slice(counts, F.lit(1), i + 1), F.lit(0.0), lambda a, x: a + x).alias("count")),
    )


def coalesced(buckets: Column) -> Column:
    """Buckets in the order of their bounds, counts of equal bounds added, and made to never fall."""
    bounds = F.array_sort(F.array_distinct(F.transform(buckets, lambda b: b["le"])))
    summed = F.transform(bounds, lambda le: F.struct(le.alias("le"), F.aggregate(F.filter(buckets, lambda b: b["le"] == le), F.lit(0.0), lambda a, b: a + b["count"]).alias("count")))
    # small falls or rises, within 1e-12 of the pair's sum, are noise and folded away
    keep = lambda last, c: F.when((c < last) | (F.abs(c - last) <= (c + last) * 1e-12), last).otherwise(c)
    empty = F.array().cast("array<struct<le:double,count:double>>")
    step = lambda out, b: F.array_append(out, F.struct(b["le"].alias("le"), F.when(F.size(out) == 0, b["count"]).otherwise(keep(F.element_at(out, F.when(F.size(out) == 0, F.lit(1)).otherwise(F.size(out)))["count"], b["count"])).alias("count")))
    return F.aggregate(summed, empty, lambda out, b: F.when(F.size(out) == 0, F.array(b)).otherwise(step(out, b)))


def classic_quantile(buckets: Column, phi: float) -> Column:
    """Interpolated quantile of coalesced buckets."""
    if phi != phi:
        return F.lit(NAN)
    if phi < 0 or phi > 1:
        return F.lit(-INF if phi < 0 else INF)
    n = F.size(buckets)
    at = lambda i: F.get(buckets, i)
    total = at(n - 1)["count"]
    rank = total * phi
    place = F.size(F.filter(F.slice(buckets, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda b: b["count"] < rank))
    low = F.when(place > 0, at(place - 1)["le"]).otherwise(0.0)
    below = F.when(place > 0, at(place - 1)["count"]).otherwise(0.0)
    inside = at(place)["count"] - below
    value = (
        F.when(place == n - 1, at(n - 2)["le"])
        .when((place == 0) & (at(F.lit(0))["le"] <= 0), at(F.lit(0))["le"])
        .when(inside <= 0, at(place)["le"])
        .otherwise(low + (at(place)["le"] - low) * F.try_divide(rank - below, inside))
    )
    return F.when((n < 2) | (at(n - 1)["le"] != INF) | (total == 0), F.lit(NAN)).otherwise(value)


def exponential(count: Column, sum_: Column, scale: Column, zero_count: Column, positive_offset: Column, positive: Column, negative_offset: Column, negative: Column) -> Column:
    """An exponential histogram from offsets and arrays of counts."""
    entries = lambda offset, counts: F.map_from_entries(F.filter(F.transform(counts, lambda c, i: F.struct((offset + i).cast("int").alias("key"), c.cast("double").alias("value"))), lambda e: e["value"] != 0))
    return F.struct(count.cast("double").alias("count"), sum_.cast("double").alias("sum"), scale.cast("int").alias("scale"), zero_count.cast("double").alias("zero_count"), entries(positive_offset, positive).alias("positive"), entries(negative_offset, negative).alias("negative"))


def _grouped(entries: Column) -> Column:
    """Map of entries (key, value), values of equal keys added."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.aggregate(F.filter(entries, lambda e: e["key"] == k), F.lit(0.0), lambda a, e: a + e["value"]).alias("value"))))


def _shifted(buckets: Column, by: Column) -> Column:
    return F.transform(F.map_entries(buckets), lambda e: F.struct(F.floor(e["key"] / F.pow(F.lit(2.0), by)).cast("int").alias("key"), e["value"].alias("value")))


def added(histograms: Column, factor: float = 1.0) -> Column:
    """Sum of an array of histograms at the coarsest of their scales, times a factor."""
    scale = F.array_min(F.transform(histograms, lambda h: h["scale"]))
    total = lambda f: F.aggregate(histograms, F.lit(0.0), lambda a, h: a + f(h)) * factor
    side = lambda name: F.transform_values(_grouped(F.flatten(F.transform(histograms, lambda h: _shifted(h[name], h["scale"] - scale)))), lambda _, v: v * factor)
    return F.struct(total(lambda h: h["count"]).alias("count"), total(lambda h: h["sum"]).alias("sum"), scale.alias("scale"), total(lambda h: h["zero_count"]).alias("zero_count"), side("positive").alias("positive"), side("negative").alias("negative"))


def scaled(h: Column, factor: Column) -> Column:
    side = lambda name: F.transform_values(h[name], lambda _, v: v * factor).alias(name)
    return F.struct((h["count"] * factor).alias("count"), (h["sum"] * factor).alias("sum"), h["scale"].alias("scale"), (h["zero_count"] * factor).alias("zero_count"), side("positive"), side("negative"))


def _in_order(h: Column, name: str) -> Column:
    return F.array_sort(F.map_entries(F.map_filter(h[name], lambda _, v: v != 0)))


def same(a: Column, b: Column) -> Column:
    """Whether two histograms are equal; empty buckets don't count."""
    flat = lambda h: F.struct(h["count"], h["sum"], h["scale"], h["zero_count"], _in_order(h, "positive"), _in_order(h, "negative"))
    return flat(a).eqNullSafe(flat(b))


def fell(a: Column, b: Column) -> Column:
    """Whether a histogram counter was reset between a and b: its count, zero count or a bucket fell, or its scale rose."""
    scale = F.least(a["scale"], b["scale"])
    at = lambda h, name: _grouped(_shifted(h[name], h["scale"] - scale))

    def less(name: str) -> Column:
        after = at(b, name)
        return F.exists(F.map_entries(at(a, name)), lambda e: F.coalesce(F.try_element_at(after, e["key"]), F.lit(0.0)) < e["value"])

    return (b["count"] < a["count"]) | (b["zero_count"] < a["zero_count"]) | (b["scale"] > a["scale"]) | less("positive") | less("negative")


def text(h: Column) -> Column:
    """A histogram as text: count, sum, and its buckets by their bounds, from the least up."""
    number = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    bucket = lambda b: F.concat(F.when(b["low"] < 0, "[").when(b["low"] == b["high"], "[").otherwise("("), number(b["low"]), F.lit(","), number(b["high"]), F.when((b["low"] < 0) & (b["low"] != b["high"]), ")").otherwise("]"), F.lit(":"), number(b["count"]))
    return F.concat(F.lit("{count:"), number(h["count"]), F.lit(", sum:"), number(h["sum"]), F.when(F.size(regions(h)) > 0, F.concat(F.lit(", "), F.array_join(F.transform(regions(h), bucket), ", "))).otherwise(""), F.lit("}"))


def regions(h: Column) -> Column:
    """Populated buckets as an array of (low, high, count), from the least values up."""
    base = F.pow(F.lit(2.0), F.pow(F.lit(2.0), -h["scale"]))
    edge = lambda i: F.pow(base, i)
    entry = lambda low, high, n: F.struct(low.cast("double").alias("low"), high.cast("double").alias("high"), n.alias("count"))
    positive = F.transform(F.array_sort(F.map_entries(h["positive"])), lambda e: entry(edge(e["key"]), edge(e["key"] + 1), e["value"]))
    negative = F.reverse(F.transform(F.array_sort(F.map_entries(h["negative"])), lambda e: entry(-edge(e["key"] + 1), -edge(e["key"]), e["value"])))
    zero = F.array(entry(F.lit(0.0), F.lit(0.0), h["zero_count"]))
    return F.filter(F.concat(negative, zero, positive), lambda b: b["count"] != 0)


def exponential_quantile(h: Column, phi: float) -> Column:
    """Quantile with geometric interpolation within a bucket; from the top down for phi of a half or more."""
    if phi != phi:
        return F.lit(NAN)
    if phi < 0 or phi > 1:
        return F.lit(-INF if phi < 0 else INF)
    buckets = regions(h) if phi < 0.5 else F.reverse(regions(h))
    rank = h["count"] * (phi if phi < 0.5 else 1 - phi)
    passed = lambda i: F.aggregate(F.slice(buckets, F.lit(1), i), F.lit(0.0), lambda a, b: a + b["count"])
    reached = F.filter(F.transform(buckets, lambda b, i: F.struct(i.alias("i"), (passed(i + 1) >= rank).alias("ok"))), lambda x: x["ok"])
    place = F.coalesce(F.get(reached, F.lit(0))["i"], F.size(buckets) - 1)
    b = F.get(buckets, place)
    part = F.try_divide(rank - passed(place), b["count"])
    share = part if phi < 0.5 else 1 - part
    value = F.when(b["low"] > 0, b["low"] * F.pow(b["high"] / b["low"], share)).when(b["high"] < 0, b["high"] * F.pow(b["low"] / b["high"], 1 - share)).otherwise(0.0)
    return F.when(h["count"] == 0, F.lit(NAN)).otherwise(value)


def fraction(h: Column, low: float, high: float) -> Column:
    """Share of the observations within [low, high], interpolated geometrically."""
    if not low < high:
        return F.lit(0.0 if low >= high else NAN)

    def below(x: float) -> Column:
        def of(b: Column) -> Column:
            a, c = b["low"], b["high"]
            inside = F.when(a > 0, F.log(F.lit(abs(x) or 1.0) / a) / F.log(c / a)).otherwise(1 - F.log(F.lit(abs(x) or 1.0) / -c) / F.log(a / c))
            return F.when(c <= x, b["count"]).when((a >= x) | (a == c), 0.0).otherwise(b["count"] * inside)

        if abs(x) == INF:
            return h["count"] if x > 0 else F.lit(0.0)
        return F.aggregate(regions(h), F.lit(0.0), lambda s, b: s + of(b))

    return F.when(h["count"] == 0, F.lit(NAN)).otherwise((below(high) - below(low)) / h["count"])


def mean(h: Column) -> Column:
    return F.try_divide(h["sum"], h["count"])


def variance(h: Column) -> Column:
    """Variance with each bucket at its geometric mean."""
    middle = lambda b: F.when(b["low"] == b["high"], 0.0).otherwise(F.signum(b["high"]) * F.sqrt(b["low"] * b["high"]))
    total = F.aggregate(regions(h), F.lit(0.0), lambda s, b: s + b["count"] * F.pow(middle(b) - mean(h), F.lit(2.0)))
    return F.try_divide(total, h["count"])
