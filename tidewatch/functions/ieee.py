"""Floating-point arithmetic as telemetry queries define it, where Spark's ANSI mode raises or gives null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def div(a: Column, b: Column) -> Column:
    """a / b; by zero a signed infinity, or NaN for 0 / 0."""
    return F.when(b == 0, F.when(F.isnan(a) | (a == 0), F.lit(NAN)).otherwise(F.signum(a) * F.lit(INF))).otherwise(F.try_divide(a, b))


def mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of a; by zero NaN."""
    return F.when((b == 0) | F.isnan(b) | F.isnan(a) | (F.abs(a) == INF), F.lit(NAN)).when(F.abs(b) == INF, a).otherwise(F.try_mod(a, b))


def _log(a: Column, log: Column) -> Column:
    return F.when(F.isnan(a) | (a < 0), F.lit(NAN)).when(a == 0, F.lit(-INF)).otherwise(log)


def ln(a: Column) -> Column:
    return _log(a, F.log(a))


def log2(a: Column) -> Column:
    return _log(a, F.log2(a))


def log10(a: Column) -> Column:
    return _log(a, F.log10(a))


def _ordered(a: Column, b: Column, holds: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), F.lit(False)).otherwise(holds)


COMPARE = {
    "==": lambda a, b: _ordered(a, b, a == b),
    "!=": lambda a, b: F.isnan(a) | F.isnan(b) | (a != b),
    ">": lambda a, b: _ordered(a, b, a > b),
    "<": lambda a, b: _ordered(a, b, a < b),
    ">=": lambda a, b: _ordered(a, b, a >= b),
    "<=": lambda a, b: _ordered(a, b, a <= b),
}
ARITHMETIC = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": div,
    "%": mod,
    "^": lambda a, b: F.pow(a, b),
    "atan2": F.atan2,
}


def _whole(a: Column, f) -> Column:
    """f, a function to whole numbers, of a double; doubles of 2**53 or more, infinities and NaN are what they are."""
    return F.when(F.abs(a) < 2.0**53, f(a).cast("double")).otherwise(a)


def ceil(a: Column) -> Column:
    return _whole(a, F.ceil)


def floor(a: Column) -> Column:
    return _whole(a, F.floor)


def round_to(a: Column, nearest: float = 1.0) -> Column:
    """a rounded to a multiple of nearest, halves up."""
    inverse = 1.0 / nearest
    return floor(a * inverse + 0.5) / inverse


def rounded(a: Column, digits: int) -> Column:
    """a rounded to decimal digits, halves away from zero; what rounds to zero keeps its sign."""
    return let(F.round(a, digits), lambda r: F.when(r == 0, a * 0.0).otherwise(r))


def least_number(a: Column) -> Column:
    """Aggregate: the least value; NaN only if all are."""
    return F.coalesce(F.min(F.when(~F.isnan(a), a)), F.min(a))


def greatest_number(a: Column) -> Column:
    return F.coalesce(F.max(F.when(~F.isnan(a), a)), F.max(a))


def percentile(a: Column, phi: float) -> Column:
    """Aggregate: the interpolated quantile, summed up as counts of values; NaN counts as the least value."""
    if phi != phi or phi < 0 or phi > 1:
        return F.max(F.lit(NAN if phi != phi else -INF if phi < 0 else INF))
    found = F.percentile(F.when(F.isnan(a), F.lit(-INF)).otherwise(a), phi)
    return F.when(F.bool_or(F.isnan(a)) & ((found == -INF) | F.isnan(found)), F.lit(NAN)).otherwise(found)


def quantile(values: Column, phi: float) -> Column:
    """Interpolated quantile of an array of numbers; phi below 0 or over 1 gives an infinity."""
    if phi != phi:
        return F.lit(NAN)
    if phi < 0 or phi > 1:
        return F.lit(-INF if phi < 0 else INF)

    def of(x: Column) -> Column:
        # NaN sorts first here: it counts as the least value
        ordered = F.concat(F.filter(x, F.isnan), F.array_sort(F.filter(x, lambda v: ~F.isnan(v))))
        rank = F.lit(phi) * (F.size(x) - 1)
        low = F.floor(rank).cast("int")
        ends = let(ordered, lambda o: F.struct(F.get(o, low).alias("a"), F.get(o, F.least(low + 1, F.size(o) - 1)).alias("b")))
        return F.when(F.size(x) == 0, F.lit(NAN)).otherwise(let(ends, lambda e: e["a"] * (1 - (rank - low)) + e["b"] * (rank - low)))

    return let(values, of)


def percentile(a: Column, phi: float) -> Column:
    """Aggregate: the interpolated quantile, summed up as counts of values; NaN counts as the least value."""
    if phi != phi or phi < 0 or phi > 1:
        return F.max(F.lit(NAN if phi != phi else -INF if phi < 0 else INF))
    found = F.percentile(F.when(F.isnan(a), F.lit(-INF)).otherwise(a), phi)
    return F.when(F.bool_or(F.isnan(a)) & ((found == -INF) | F.isnan(found)), F.lit(NAN)).otherwise(found)


def quantile(values: Column, phi: float) -> Column:
    """Interpolated quantile of an array of numbers; phi below 0 or over 1 gives an infinity."""
    if phi != phi:
        return F.lit(NAN)
    if phi < 0 or phi > 1:
        return F.lit(-INF if phi < 0 else INF)
    # NaN sorts first here: it counts as the least value
    nans = F.filter(values, F.isnan)
    ordered = F.concat(nans, F.array_sort(F.filter(values, lambda x: ~F.isnan(x))))
    rank = F.lit(phi) * (F.size(values) - 1)
    low = F.floor(rank).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(values) - 1))
    return F.when(F.size(values) == 0, F.lit(NAN)).otherwise(a * (1 - (rank - low)) + b * (rank - low))
