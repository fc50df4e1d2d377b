"""Selectors, range functions, aggregations and sorting of metric samples.

A sample frame has the columns labels (map<string,string>, with the metric's name as __name__), ts (long,
milliseconds) and value (double). Vectors and matrices over a grid have the same columns, ts being the
grid's point. Grouping and joining use a canonical string of the labels, since maps can't be join keys.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ieee, labels as lb, ranges
from ..plans.grid import LOOKBACK_MS, Grid, Windows

COLUMNS = ["labels", "ts", "value"]
#: Calendar functions know times up to the year 9999.
LAST_SECOND = 253_402_300_800.0
SAME_LABELS = "vector cannot contain metrics with the same labelset"


def select(samples: DataFrame, *matchers: tuple[str, str, str]) -> DataFrame:
    """Samples whose labels pass all matchers (name, `=` `!=` `=~` `!~`, value); patterns must match whole values."""
    return reduce(lambda df, m: df.where(lb.matches(F.col("labels"), *m)), matchers, samples)


def instant(samples: DataFrame, grid: Grid, lookback_ms: int = LOOKBACK_MS, offset_ms: int = 0, at: int | None = None) -> DataFrame:
    """The newest sample of each series at each point, not as old as the lookback."""
    if at is not None:
        return pinned(instant(samples, Grid.instant(at), lookback_ms, offset_ms), grid)
    windows = Windows(grid, lookback_ms, offset_ms)  # open on the left
    kept = samples.where(windows.relevant(F.col("ts"))).withColumns({"key": lb.key(F.col("labels")), "slot": windows.slot(F.col("ts"))})
    newest = F.max(F.struct("ts", "value"))
    slots = kept.groupBy("key", "slot").agg(F.any_value("labels").alias("labels"), newest.alias("s"))
    spread = slots.withColumn("point", F.explode(windows.points(F.col("slot"))))
    found = spread.groupBy("key", "point").agg(F.any_value("labels").alias("labels"), F.max("s").alias("s"))
    return found.select("labels", F.col("point").alias("ts"), F.col("s.value").alias("value"))


def timestamps(samples: DataFrame, grid: Grid, lookback_ms: int = LOOKBACK_MS, offset_ms: int = 0) -> DataFrame:
    """timestamp(): seconds of the sample that :func:`instant` takes at each point."""
    return map_values(instant(samples.withColumn("value", F.col("ts") / 1000.0), grid, lookback_ms, offset_ms), lambda v: v)


def exemplars(rows: DataFrame, first: int, last: int, *matchers: tuple[str, str, str]) -> DataFrame:
    """(labels, exemplar_labels, ts, value): the exemplars, within these milliseconds, of rows (labels, exemplars) whose
    labels pass the matchers; exemplars is an array of structs of ts, value and labels."""
    found = select(rows, *matchers).select("labels", F.explode("exemplars").alias("e")).where(F.col("e.ts").between(first, last))
    return found.select("labels", F.col("e.labels").alias("exemplar_labels"), "e.ts", "e.value")


def pinned(vector: DataFrame, grid: Grid) -> DataFrame:
    """A vector evaluated once (at a pinned time), at each point of the grid."""
    return vector.withColumn("ts", F.explode(F.sequence(F.lit(grid.start).cast("long"), F.lit(grid.end).cast("long"), F.lit(grid.step).cast("long"))))


def _identity(named: bool) -> tuple[Column, dict[str, Column], dict[str, Column], Callable[[Column], Column]]:
    """Key of a series, with or without its metric's name; how its labels go through two groupings; and a check of
    its values, which makes the job fail if two metrics have the same labels without their names."""
    own = F.col("labels") if named else lb.nameless(F.col("labels"))
    if named:
        return lb.key(own), {"labels": F.any_value("labels")}, {"labels": F.any_value("labels")}, lambda v: v
    name = lb.label(F.col("labels"), "__name__")
    first = {"labels": F.any_value(own), "name": F.min(name), "last_name": F.max(name)}
    second = {"labels": F.any_value("labels"), "name": F.min("name"), "last_name": F.max("last_name")}
    fail = F.raise_error(F.lit(SAME_LABELS)).cast("double")
    return lb.key(own), first, second, lambda v: F.when(F.col("name") != F.col("last_name"), fail).otherwise(v)


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(k) for k, c in columns.items()]


def windowed(samples: DataFrame, windows: Windows, once: bool = True, named: bool = True) -> DataFrame:
    """Each series' samples in each window, as (key, labels, point, one, s): in order, with `once` one for each time;
    one is 1, or fails the job if two metrics have these labels.

    Samples are gathered by slot before slots are spread, so a sample is shuffled once whatever the overlap.
    """
    key, first, second, checked = _identity(named)
    kept = samples.where(windows.relevant(F.col("ts"))).withColumns({"key": key, "slot": windows.slot(F.col("ts"))})
    slots = kept.groupBy("key", "slot").agg(*_named(first), F.collect_list(F.struct("ts", F.col("value").alias("v"))).alias("s"))
    spread = slots.withColumn("point", F.explode(windows.points(F.col("slot"))))
    gathered = spread.groupBy("key", "point").agg(*_named(second), F.array_sort(F.flatten(F.collect_list("s"))).alias("s"))
    gathered = gathered.select("key", "labels", "point", checked(F.lit(1.0)).alias("one"), "s")
    if not once:
        return gathered
    s = F.col("s")
    return gathered.withColumn("s", F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["ts"] != x["ts"], F.lit(True))))


def over_time(samples: DataFrame, function: str | Callable[[Column, Column, int], Column], grid: Grid, range_ms: int, offset_ms: int = 0, at: int | None = None, once: bool = True) -> DataFrame:
    """A range function at each point, by name or as made by a factory of functions.ranges.

    Functions whose windows can be put together from slots go the way of :func:`rolled`, others gather the
    samples of a window.
    """
    if at is not None:
        return pinned(over_time(samples, function, Grid.instant(at), range_ms, offset_ms, once=once), grid)
    if isinstance(function, str) and function in (ROLLED if once else ROLLED_REPEATED):
        found = rolled(samples, [function], grid, range_ms, offset_ms, once, function in ranges.NAMED)
        return found.select("labels", "ts", F.col(function).alias("value")).where("value is not null")
    apply = ranges.FUNCTIONS[function] if isinstance(function, str) else function
    end = F.col("point") - offset_ms
    value = ieee.let(F.col("s"), lambda s: apply(s, end, range_ms))
    gathered = windowed(samples, Windows(grid, range_ms, offset_ms), once, function in ranges.NAMED)
    return gathered.select("labels", F.col("point").alias("ts"), F.when(F.col("one") == 1, value).alias("value")).where("value is not null")


#: Functions that :func:`rolled` knows, and those that it knows where a time may hold several samples.
ROLLED_REPEATED = {"count_over_time", "sum_over_time", "avg_over_time", "min_over_time", "max_over_time", "present_over_time", "log_rate", "ts_of_first_over_time", "ts_of_last_over_time", "first_over_time", "last_over_time", "stddev_over_time", "stdvar_over_time"}
ROLLED = ROLLED_REPEATED | {"rate", "increase", "delta", "changes", "resets", "irate", "idelta"}


def rolled(samples: DataFrame, functions: list[str], grid: Grid, range_ms: int, offset_ms: int = 0, once: bool = False, named: bool = False) -> DataFrame:
    """Several range functions over one scan, as columns beside labels and ts.

    For functions whose windows can be put together from slots: sums, counts, extremes, ends, spreads, and the rate
    family. A slot's few numbers stand for its samples, so long windows cost no more than short ones. With `once`
    a time has one sample, the greatest. The metric's name goes unless `named`; two metrics whose labels are then
    the same make the job fail.
    """
    windows = Windows(grid, range_ms, offset_ms)
    key, first_labels, second_labels, checked = _identity(named)
    kept = samples.where(windows.relevant(F.col("ts"))).withColumns({"key": key, "slot": windows.slot(F.col("ts"))})
    needs_order = bool({"rate", "increase", "delta", "changes", "resets", "irate", "idelta"} & {*functions})
    spreads = bool({"stddev_over_time", "stdvar_over_time"} & {*functions})
    if once or needs_order:
        slots = kept.groupBy("key", "slot").agg(*_named(first_labels), F.array_sort(F.collect_list(F.struct("ts", F.col("value").alias("v")))).alias("s"))
        s = F.col("s")
        slots = slots.withColumn("s", F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["ts"] != x["ts"], F.lit(True))))
        values = F.transform(s, lambda x: x["v"])
        numbers = F.filter(values, lambda v: ~F.isnan(v))
        n, total = F.size(s).cast("long"), F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
        columns = {
            "n": n, "total": total, "first": ranges.first(s), "last": ranges.last(s),
            "least": F.coalesce(F.array_min(numbers), F.lit(ieee.NAN)), "most": F.coalesce(F.array_max(numbers), F.lit(ieee.NAN)),
        }
        if spreads:
            columns |= {"mean": total / n, "apart": ranges.squares(values)}
        if needs_order:
            columns |= {"lost": ranges.resets_added(s), "changes": ranges.FUNCTIONS["changes"](s, s, 0), "resets": ranges.FUNCTIONS["resets"](s, s, 0), "last_but_one": F.get(s, F.size(s) - 2)}
        slots = slots.select("key", "slot", *first_labels, *_named(columns))
        if needs_order:
            order = Window.partitionBy("key").orderBy("slot")
            before = F.lag("last").over(order)
            slots = slots.withColumns({"fell": F.col("first.v") < before["v"], "moved": ~F.col("first.v").eqNullSafe(before["v"]), "before": before})
    else:
        at = F.struct("ts", F.col("value").alias("v"))
        base = {"n": F.count("*"), "total": F.sum("value"), "least": ieee.least_number(F.col("value")), "most": ieee.greatest_number(F.col("value")), "first": F.min(at), "last": F.max(at)}
        if spreads:
            base |= {"mean": F.avg("value"), "apart": F.var_pop("value") * F.count("*")}
        slots = kept.groupBy("key", "slot").agg(*_named(first_labels), *_named(base))
    spread = slots.withColumn("point", F.explode(windows.points(F.col("slot"))))
    sums = {"n": F.sum("n"), "total": F.sum("total"), "least": ieee.least_number(F.col("least")), "most": ieee.greatest_number(F.col("most")), "first": F.min("first"), "last": F.max("last")}
    if spreads:
        # squares about the slots' means, and the means' own about the whole
        sums |= {"apart": F.sum("apart"), "parts": F.collect_list(F.struct("n", "mean"))}
    if needs_order:
        # a fall between two slots counts if both lie in the window, that is, for all its slots but the first
        joint = lambda c, x: F.sum(F.when(F.col(c), x).otherwise(0.0)) - F.min_by(F.when(F.col(c), x).otherwise(0.0), "slot")
        # the last sample but one lies in the last slot, or ends the one before it
        sums |= {
            "lost": F.sum("lost") + joint("fell", F.col("before.v")),
            "changes": F.sum("changes") + joint("moved", F.lit(1.0)),
            "resets": F.sum("resets") + joint("fell", F.lit(1.0)),
            "last_but_one": F.max_by(F.coalesce("last_but_one", "before"), "slot"),
        }
    found = spread.groupBy("key", "point").agg(*_named(second_labels), *_named(sums))
    end, n = F.col("point") - offset_ms, F.col("n")

    def variance() -> Column:
        between = lambda mean: F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["n"] * (x["mean"] - mean) * (x["mean"] - mean))
        return (F.col("apart") + ieee.let(F.col("total") / n, between)) / n

    def value(name: str) -> Column:
        if name in ("rate", "increase", "delta"):
            change = F.col("last.v") - F.col("first.v") + (F.lit(0.0) if name == "delta" else F.col("lost"))
            return ranges.extrapolated(change, F.col("first.ts"), F.col("last.ts"), n, F.col("first.v"), end, range_ms, name != "delta", name == "rate")
        if name in ("irate", "idelta"):
            return F.when(n >= 2, ranges.between(F.col("last_but_one"), F.col("last"), name == "irate"))
        return {
            "count_over_time": lambda: n.cast("double"), "sum_over_time": lambda: F.col("total"), "avg_over_time": lambda: F.col("total") / n,
            "min_over_time": lambda: F.col("least"), "max_over_time": lambda: F.col("most"),
            "stdvar_over_time": variance, "stddev_over_time": lambda: F.sqrt(variance()),
            "first_over_time": lambda: F.col("first.v"), "last_over_time": lambda: F.col("last.v"),
            "ts_of_first_over_time": lambda: F.col("first.ts") / 1000.0, "ts_of_last_over_time": lambda: F.col("last.ts") / 1000.0,
            "present_over_time": lambda: F.lit(1.0), "log_rate": lambda: n / (range_ms / 1000.0),
            "changes": lambda: F.col("changes"), "resets": lambda: F.col("resets"),
        }[name]()

    return found.select("labels", F.col("point").alias("ts"), *(checked(value(f)).alias(f) for f in functions))


def delta_rate(samples: DataFrame, grid: Grid, range_ms: int, per_second: bool = True, offset_ms: int = 0) -> DataFrame:
    """rate (or increase) of counters stored as increases: the window's increases without the first one's.

    Samples are summed by slot first, those before the grid in one slot, so that the running total, which the
    extrapolation needs, goes over slots and not over samples.
    """
    windows = Windows(grid, range_ms, offset_ms)
    key, first_labels, second_labels, checked = _identity(False)
    earlier = grid.start - offset_ms - range_ms
    slot = F.when(F.col("ts") > earlier, windows.slot(F.col("ts")))
    kept = samples.where(F.col("ts") <= grid.end - offset_ms).withColumns({"key": key, "slot": F.coalesce(slot, F.lit(-(1 << 62)))})
    at = F.struct("ts", F.col("value").alias("v"))
    slots = kept.groupBy("key", "slot").agg(*_named(first_labels), F.count("*").alias("n"), F.sum("value").alias("total"), F.min(at).alias("first"), F.max(at).alias("last"))
    before = F.sum("total").over(Window.partitionBy("key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    slots = slots.withColumn("before", F.coalesce(before, F.lit(0.0))).where(F.col("slot") > -(1 << 62))
    spread = slots.withColumn("point", F.explode(windows.points(F.col("slot"))))
    sums = {"n": F.sum("n"), "total": F.sum("total"), "first": F.min("first"), "last": F.max("last"), "before": F.min_by("before", "slot")}
    found = spread.groupBy("key", "point").agg(*_named(second_labels), *_named(sums))
    level = F.col("before") + F.col("first.v")
    value = ranges.extrapolated(F.col("total") - F.col("first.v"), F.col("first.ts"), F.col("last.ts"), F.col("n"), level, F.col("point") - offset_ms, range_ms, True, per_second)
    return found.select("labels", F.col("point").alias("ts"), checked(value).alias("value")).where("value is not null")


def delta_irate(samples: DataFrame, grid: Grid, range_ms: int, offset_ms: int = 0) -> DataFrame:
    """irate of counters stored as increases: the window's last increase for each second since the one before it."""
    value = lambda s, end, range_ms: F.when(F.size(s) >= 2, F.try_divide(ranges.last(s)["v"], (ranges.last(s)["ts"] - F.get(s, F.size(s) - 2)["ts"]) / 1000.0))
    return over_time(samples, value, grid, range_ms, offset_ms)


def subquery(evaluate: Callable[[Grid], DataFrame], function, grid: Grid, range_ms: int, step_ms: int = 60_000, offset_ms: int = 0) -> DataFrame:
    """A range function over an expression evaluated on multiples of its own step."""
    shifted = Grid(grid.start - offset_ms, grid.end - offset_ms, grid.step)
    return over_time(evaluate(shifted.inner(range_ms, step_ms)), function, grid, range_ms, offset_ms)


def map_values(vector: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """f of each value, without the samples for which it is null; the metric's name goes."""
    return vector.select(lb.nameless(F.col("labels")).alias("labels"), "ts", f(F.col("value")).cast("double").alias("value")).where("value is not null")


def absent(vector: DataFrame, grid: Grid, labels: dict[str, str] | None = None) -> DataFrame:
    """1 at each point where the vector has no sample, with labels taken from equality matchers."""
    own = F.create_map(*(F.lit(x) for kv in sorted((labels or {}).items()) for x in kv)) if labels else F.create_map().cast("map<string,string>")
    return grid.frame(vector.sparkSession).join(vector.select("ts").distinct(), "ts", "left_anti").select(own.alias("labels"), "ts", F.lit(1.0).alias("value"))


def absent_over_time(samples: DataFrame, grid: Grid, range_ms: int, offset_ms: int = 0, labels: dict[str, str] | None = None) -> DataFrame:
    windows = Windows(grid, range_ms, offset_ms)
    slots = samples.where(windows.relevant(F.col("ts"))).select(windows.slot(F.col("ts")).alias("slot")).distinct()
    return absent(slots.select(F.explode(windows.points(F.col("slot"))).alias("ts")), grid, labels)


def scalar(vector: DataFrame, grid: Grid) -> DataFrame:
    """(ts, value): the only series' value at each point, NaN if there is none or more than one."""
    one = vector.groupBy("ts").agg(F.when(F.count("*") == 1, F.any_value("value")).otherwise(F.lit(ieee.NAN)).alias("value"))
    return grid.frame(vector.sparkSession).join(one, "ts", "left").select("ts", F.coalesce("value", F.lit(ieee.NAN)).alias("value"))


def constant(spark, grid: Grid, value: float | Column) -> DataFrame:
    """A vector of one series without labels; with time() as value, seconds of the point."""
    return grid.frame(spark).select(F.create_map().cast("map<string,string>").alias("labels"), "ts", (value if isinstance(value, Column) else F.lit(float(value))).cast("double").alias("value"))


def time_() -> Column:
    return F.col("ts") / 1000.0


# Instant functions of a value.

def clamp(v: Column, low: float, high: float) -> Column:
    """v within the bounds; NaN if a bound is NaN, null (no sample) if they are the wrong way round."""
    if low != low or high != high:
        return F.lit(ieee.NAN)
    if low > high:
        return F.lit(None).cast("double")
    return F.when(F.isnan(v), v).otherwise(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), v)))


def _calendar(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """f of seconds as a time in UTC; NaN for NaN and for times out of range."""
    return lambda v: F.when(F.abs(v) < LAST_SECOND, f(F.timestamp_micros((v * 1e6).try_cast("long"))).cast("double")).otherwise(F.lit(ieee.NAN))


INSTANT: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs, "ceil": ieee.ceil, "floor": ieee.floor, "round": ieee.round_to, "sqrt": F.sqrt, "exp": F.exp,
    "ln": ieee.ln, "log2": ieee.log2, "log10": ieee.log10, "sgn": F.signum, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh, "deg": F.degrees, "rad": F.radians, "negate": lambda v: -v,
    "year": _calendar(F.year), "month": _calendar(F.month), "day_of_month": _calendar(F.dayofmonth), "day_of_week": _calendar(lambda t: F.dayofweek(t) - 1),
    "day_of_year": _calendar(F.dayofyear), "days_in_month": _calendar(lambda t: F.dayofmonth(F.last_day(t))), "hour": _calendar(F.hour), "minute": _calendar(F.minute),
}


# Aggregations.

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "avg": F.avg, "min": ieee.least_number, "max": ieee.greatest_number, "count": lambda v: F.count("*").cast("double"),
    "group": lambda v: F.lit(1.0) + F.count("*") * 0.0, "stddev": F.stddev_pop, "stdvar": F.var_pop,
}


def grouping(by: list[str] | None = None, without: list[str] | None = None) -> Column:
    """The labels that a series is grouped under."""
    return lb.canonical(lb.without(F.col("labels"), without) if without is not None else lb.by(F.col("labels"), by or []))


def aggregate(vector: DataFrame, how: str | Callable[[Column], Column], by: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """An aggregate over the series of each group at each point; nothing for no series."""
    f = AGGREGATES[how] if isinstance(how, str) else how
    return vector.withColumn("labels", grouping(by, without)).groupBy("labels", "ts").agg(f(F.col("value")).alias("value"))


def quantile(vector: DataFrame, phi: float, by: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    return aggregate(vector, lambda v: ieee.percentile(v, phi), by, without)


def ranked(vector: DataFrame, k: int, top: bool, by: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """topk or bottomk: the k series with the greatest (least) values of each group and point, labels kept; NaN comes last."""
    value = F.when(F.isnan("value"), None).otherwise(F.col("value"))
    order = [value.desc_nulls_last() if top else value.asc_nulls_last(), lb.key(F.col("labels"))]
    w = Window.partitionBy(lb.key(grouping(by, without)), "ts").orderBy(*order)
    return vector.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(int(k), 0)).select(*COLUMNS)


def limitk(vector: DataFrame, k: int, by: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """k series of each group, the first in the order of their labels."""
    w = Window.partitionBy(lb.key(grouping(by, without)), "ts").orderBy(lb.key(F.col("labels")))
    return vector.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*COLUMNS)


def limit_ratio(vector: DataFrame, ratio: float) -> DataFrame:
    """About that share of the series, by their labels' hash; a negative ratio gives those that 1 + ratio leaves out."""
    place = F.conv(F.substring(F.md5(lb.key(F.col("labels"))), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return vector.where(place < ratio if ratio >= 0 else place >= 1 + ratio)


def count_values(vector: DataFrame, name: str, by: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """Number of series with each value, which becomes a label."""
    labelled = vector.withColumn("labels", lb.with_label(grouping(by, without), name, number_text(F.col("value"))))
    return labelled.groupBy(lb.canonical(F.col("labels")).alias("labels"), "ts").agg(F.count("*").cast("double").alias("value"))


def number_text(v: Column) -> Column:
    """Shortest decimal text of a double, without an exponent: its digits with the point moved or zeros put in."""
    text = v.cast("string")
    digits = F.regexp_replace(F.regexp_replace(text, r"E.*$|[-.]", ""), r"(?<=.)0+$", "")
    power = F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    before = F.substring(digits, F.lit(1), power + 1)
    after = F.substring(digits, power + 2, F.length(digits))
    large = F.concat(F.rpad(before, power + 1, F.lit("0")), F.when(after == "", "").otherwise(F.concat(F.lit("."), after)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    plain = F.concat(F.when(v < 0, "-").otherwise(""), F.when(power >= 0, large).otherwise(small))
    return F.when(F.isnan(v), "NaN").when(v == ieee.INF, "+Inf").when(v == -ieee.INF, "-Inf").when(text.contains("E"), plain).otherwise(F.regexp_replace(text, r"\.0$", ""))


def _ordered(vector: DataFrame, *keys: tuple[Column, bool]) -> DataFrame:
    """Ordered by keys (and whether descending), each a column of its own first: a sort works out an expression anew
    for each comparison."""
    names = [f"tw_{i}" for i in range(len(keys))]
    made = vector.select("*", *(k.alias(n) for n, (k, _) in zip(names, keys, strict=True)))
    return made.orderBy(*(F.desc(n) if down else F.asc(n) for n, (_, down) in zip(names, keys, strict=True))).drop(*names)


def sort(vector: DataFrame, descending: bool = False) -> DataFrame:
    return _ordered(vector, (F.isnan("value"), False), (F.col("value"), descending), (lb.key(F.col("labels")), False))


def sort_by_label(vector: DataFrame, names: list[str], descending: bool = False) -> DataFrame:
    """Ordered by labels, runs of digits as numbers; ties by all labels."""
    keys = [lb.natural(lb.label(F.col("labels"), n)) for n in names] + [lb.key(F.col("labels"))]
    return _ordered(vector, *((k, descending) for k in keys))
