"""Range-vector functions over a window's samples: an array of (ts in ms, v), in time order, one for each ts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ieee


def _values(s: Column) -> Column:
    return F.transform(s, lambda x: x["v"])


def _fold(s: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Sum over neighbouring values (before, after) of step, a double."""
    start = F.struct(F.get(s, F.lit(0))["v"].alias("before"), F.lit(0.0).alias("sum"))
    return F.aggregate(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), start, lambda a, x: F.struct(x["v"].alias("before"), (a["sum"] + step(a["before"], x["v"])).alias("sum")), lambda a: a["sum"])


def first(s: Column) -> Column:
    return F.get(s, F.lit(0))


def last(s: Column) -> Column:
    return F.get(s, F.size(s) - 1)


def extrapolated(change: Column, first_ts: Column, last_ts: Column, n: Column, first_v: Column, end: Column, range_ms: int, counter: bool, per_second: bool) -> Column:
    """A change between a window's first and last sample, carried on to the window's edges.

    An edge farther than 1.1 mean gaps counts as half a gap away; a counter's start isn't carried below zero.
    """
    covered = (last_ts - first_ts).cast("double")
    gap = covered / (n - 1)
    to_start, to_end = (first_ts - (end - range_ms)).cast("double"), (end - last_ts).cast("double")
    start = F.when(to_start >= gap * 1.1, gap / 2).otherwise(to_start)
    if counter:
        to_zero = F.when((change > 0) & (first_v >= 0), covered * F.try_divide(first_v, change)).otherwise(start)
        start = F.least(start, to_zero)
    stop = F.when(to_end >= gap * 1.1, gap / 2).otherwise(to_end)
    factor = F.try_divide(covered + start + stop, covered)
    out = change * (factor / (range_ms / 1000.0) if per_second else factor)
    return F.when((n >= 2) & (covered > 0), out)


def resets_added(s: Column) -> Column:
    """What a counter lost in resets."""
    return _fold(s, lambda a, b: F.when(b < a, a).otherwise(0.0))


def _rate(counter: bool, per_second: bool):
    def out(s: Column, end: Column, range_ms: int) -> Column:
        change = last(s)["v"] - first(s)["v"] + (resets_added(s) if counter else F.lit(0.0))
        return extrapolated(change, first(s)["ts"], last(s)["ts"], F.size(s), first(s)["v"], end, range_ms, counter, per_second)

    return out


def between(a: Column, b: Column, per_second: bool) -> Column:
    """Change from sample a to b; per second a counter's, whose fall is a reset."""
    change = F.when(b["v"] < a["v"], b["v"]).otherwise(b["v"] - a["v"]) if per_second else b["v"] - a["v"]
    gap = (b["ts"] - a["ts"]) / 1000.0
    return F.when(gap > 0, F.try_divide(change, gap) if per_second else change)


def _instant(per_second: bool):
    return lambda s, end, range_ms: F.when(F.size(s) >= 2, between(F.get(s, F.size(s) - 2), last(s), per_second))


def _line(s: Column, origin: Column) -> tuple[Column, Column]:
    """Least-squares slope a second and value at origin (ms)."""
    x = lambda p: (p["ts"] - origin) / 1000.0
    n = F.size(s).cast("double")
    total = lambda f: F.aggregate(s, F.lit(0.0), lambda a, p: a + f(p))
    sx, sy = total(x), total(lambda p: p["v"])
    sxy, sxx = total(lambda p: x(p) * p["v"]), total(lambda p: x(p) * x(p))
    steady = F.forall(s, lambda p: p["v"] == first(s)["v"])
    slope = F.when(steady, 0.0).otherwise(F.try_divide(sxy - sx * sy / n, sxx - sx * sx / n))
    return slope, F.when(steady, first(s)["v"]).otherwise(sy / n - slope * sx / n)


def deriv(s: Column, end: Column, range_ms: int) -> Column:
    return F.when(F.size(s) >= 2, _line(s, first(s)["ts"])[0])


def predict_linear(seconds: float):
    def out(s: Column, end: Column, range_ms: int) -> Column:
        slope, at_end = _line(s, end)
        return F.when(F.size(s) >= 2, at_end + slope * seconds)

    return out


def double_exponential_smoothing(smoothing: float, trend: float):
    if not (0 < smoothing < 1 and 0 < trend < 1):
        raise ValueError("both factors must lie between 0 and 1")

    def out(s: Column, end: Column, range_ms: int) -> Column:
        a, b = first(s)["v"], F.get(s, F.lit(1))["v"]
        start = F.struct(a.alias("level"), a.alias("before"), (b - a).alias("trend"), F.lit(0).alias("i"))

        def step(c: Column, p: Column) -> Column:
            # the second sample keeps the trend of the first pair
            slope = F.when(c["i"] == 0, c["trend"]).otherwise(trend * (c["level"] - c["before"]) + (1 - trend) * c["trend"])
            level = smoothing * p["v"] + (1 - smoothing) * (c["level"] + slope)
            return F.struct(level.alias("level"), c["level"].alias("before"), slope.alias("trend"), (c["i"] + 1).alias("i"))

        return F.when(F.size(s) >= 2, F.aggregate(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), start, step, lambda c: c["level"]))

    return out


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def squares(values: Column) -> Column:
    """Sum of the squared distances from the mean."""
    about = lambda x, mean: F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    return ieee.let(values, lambda x: ieee.let(_sum(x) / F.size(x), lambda mean: about(x, mean)))


def _variance(s: Column) -> Column:
    return squares(_values(s)) / F.size(s)


def _extreme(s: Column, top: bool) -> Column:
    numbers = F.filter(_values(s), lambda v: ~F.isnan(v))
    return F.coalesce(F.array_max(numbers) if top else F.array_min(numbers), F.lit(ieee.NAN))


def _time_of(s: Column, top: bool) -> Column:
    """Seconds of the last sample with the extreme value."""
    at = ieee.let(_extreme(s, top), lambda most: F.get(F.reverse(F.filter(s, lambda p: p["v"] == most)), F.lit(0)))
    return F.coalesce(at["ts"], last(s)["ts"]) / 1000.0


def quantile_over_time(phi: float):
    return lambda s, end, range_ms: ieee.quantile(_values(s), phi)


def mad_over_time(s: Column, end: Column, range_ms: int) -> Column:
    away = lambda x, middle: ieee.quantile(F.transform(x, lambda v: F.abs(v - middle)), 0.5)
    return ieee.let(_values(s), lambda x: ieee.let(ieee.quantile(x, 0.5), lambda middle: away(x, middle)))


#: Functions (samples, window's end in ms, range in ms) -> value or null. Those with parameters are made by the functions above.
FUNCTIONS: dict[str, Callable[[Column, Column, int], Column]] = {
    "rate": _rate(True, True),
    "increase": _rate(True, False),
    "delta": _rate(False, False),
    "irate": _instant(True),
    "idelta": _instant(False),
    "deriv": deriv,
    "changes": lambda s, e, r: _fold(s, lambda a, b: F.when(a.eqNullSafe(b), 0.0).otherwise(1.0)),
    "resets": lambda s, e, r: _fold(s, lambda a, b: F.when(b < a, 1.0).otherwise(0.0)),
    "sum_over_time": lambda s, e, r: _sum(_values(s)),
    "avg_over_time": lambda s, e, r: _sum(_values(s)) / F.size(s),
    "min_over_time": lambda s, e, r: _extreme(s, False),
    "max_over_time": lambda s, e, r: _extreme(s, True),
    "count_over_time": lambda s, e, r: F.size(s).cast("double"),
    "first_over_time": lambda s, e, r: first(s)["v"],
    "last_over_time": lambda s, e, r: last(s)["v"],
    "stddev_over_time": lambda s, e, r: F.sqrt(_variance(s)),
    "stdvar_over_time": lambda s, e, r: _variance(s),
    "mad_over_time": mad_over_time,
    "present_over_time": lambda s, e, r: F.lit(1.0),
    "ts_of_first_over_time": lambda s, e, r: first(s)["ts"] / 1000.0,
    "ts_of_last_over_time": lambda s, e, r: last(s)["ts"] / 1000.0,
    "ts_of_max_over_time": lambda s, e, r: _time_of(s, True),
    "ts_of_min_over_time": lambda s, e, r: _time_of(s, False),
    "log_rate": lambda s, e, r: F.size(s) / (r / 1000.0),
}
#: These keep the metric's name.
NAMED = {"first_over_time", "last_over_time"}
