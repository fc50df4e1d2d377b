"""Histogram frames: quantiles, sums and joins. A histogram frame has labels, ts and hist in place of value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import histograms as hg, labels as lb
from ..functions.ranges import extrapolated
from ..plans.grid import Grid, Windows
from .matching import match_key
from .metrics import grouping, instant, over_time as over_samples


def bucket_series(rows: DataFrame) -> DataFrame:
    """Rows (labels, ts, bounds, counts) of histogram tables as cumulative series with an `le` label."""
    each = rows.select("labels", "ts", F.explode(hg.cumulative(F.col("bounds"), F.col("counts"))).alias("b"))
    le = F.when(F.col("b.le") == hg.INF, "+Inf").otherwise(F.regexp_replace(F.col("b.le").cast("string"), r"\.0$", ""))
    return each.select(lb.with_label(F.col("labels"), "le", le).alias("labels"), "ts", F.col("b.count").alias("value"))


def bucket_ranges(rows: DataFrame, function: str, grid: Grid, range_ms: int, offset_ms: int = 0) -> DataFrame:
    """A range function of each bucket of rows (labels, ts, bounds, counts), as `le` series; bounds may change over time."""
    return over_samples(bucket_series(rows), function, grid, range_ms, offset_ms)


def newest_buckets(rows: DataFrame, grid: Grid, lookback_ms: int, offset_ms: int = 0) -> DataFrame:
    """The buckets of each series' newest row at each point, as `le` series."""
    return instant(bucket_series(rows), grid, lookback_ms, offset_ms)


def quantile(buckets: DataFrame, phi: float | list[float], name: str = "quantile") -> DataFrame:
    """Quantile of each group of `le` series; with several phi, one series each under a label."""
    own = lb.canonical(lb.without(F.col("labels"), ["le"]))
    le = F.expr("try_cast(replace(labels['le'], '+Inf', 'Infinity') as double)")
    gathered = buckets.where(F.map_contains_key("labels", F.lit("le"))).select(own.alias("labels"), "ts", F.struct(le.alias("le"), F.col("value").alias("count")).alias("b")).where("b.le is not null")
    grouped = gathered.groupBy("labels", "ts").agg(F.collect_list("b").alias("buckets")).withColumn("buckets", hg.coalesced(F.col("buckets")))
    if isinstance(phi, list):
        values = F.explode(F.array(*(F.struct(F.lit(str(p)).alias("phi"), hg.classic_quantile(F.col("buckets"), p).alias("value")) for p in phi)))
        return grouped.withColumn("x", values).select(lb.with_label(F.col("labels"), name, F.col("x.phi")).alias("labels"), "ts", F.col("x.value").alias("value"))
    return grouped.select("labels", "ts", hg.classic_quantile(F.col("buckets"), phi).alias("value"))


VALUES = {
    "histogram_count": lambda h: h["count"],
    "histogram_sum": lambda h: h["sum"],
    "histogram_avg": hg.mean,
    "histogram_stdvar": hg.variance,
    "histogram_stddev": lambda h: F.sqrt(hg.variance(h)),
}


def value_of(rows: DataFrame, function) -> DataFrame:
    """A number of each histogram, by name or as an expression; rows without one are left out."""
    f = VALUES[function] if isinstance(function, str) else function
    return rows.where("hist is not null").select(lb.nameless(F.col("labels")).alias("labels"), "ts", f(F.col("hist")).alias("value"))


def aggregate(rows: DataFrame, how: str = "sum", by: list[str] | None = None, without: list[str] | None = None, most_buckets: int = 10_000) -> DataFrame:
    """sum or avg of the histograms of each group, at the coarsest scale among them.

    Buckets are added before histograms are put together, so a group's histograms are never in one place; a
    merged histogram of more buckets than most_buckets fails the job.
    """
    own = rows.where("hist is not null").select(grouping(by, without).alias("labels"), "ts", "hist")
    scales = own.groupBy("labels", "ts").agg(F.min("hist.scale").alias("scale"), F.sum("hist.count").alias("count"), F.sum("hist.sum").alias("sum"), F.sum("hist.zero_count").alias("zero_count"), F.count("*").alias("n"))
    side = lambda name, sign: F.transform(F.map_entries(F.col(f"hist.{name}")), lambda e: F.struct(F.lit(sign).alias("sign"), e["key"].alias("key"), e["value"].alias("value")))
    each = own.select("labels", "ts", F.col("hist.scale").alias("own"), F.explode(F.concat(side("positive", 1), side("negative", -1))).alias("e"))
    keyed = lambda df: df.withColumn("k", lb.key(F.col("labels")))
    # a first sum at each histogram's own scale makes few rows of many before they meet the group's scale
    summed = keyed(each.groupBy("labels", "ts", "own", "e.sign", "e.key").agg(F.sum("e.value").alias("value"))).drop("labels").join(keyed(scales).select("k", "ts", "scale"), ["k", "ts"])
    moved = summed.withColumn("key", F.floor(F.col("key") / F.pow(F.lit(2.0), F.col("own") - F.col("scale"))).cast("int")).groupBy("k", "ts", "sign", "key").agg(F.sum("value").alias("value"))
    maps = moved.groupBy("k", "ts").agg(*(F.collect_list(F.when(F.col("sign") == s, F.struct("key", "value"))).alias(n) for s, n in ((1, "positive"), (-1, "negative"))))
    both = keyed(scales).join(maps, ["k", "ts"], "left")
    empty = F.array().cast("array<struct<key:int,value:double>>")
    guard = lambda c: F.when(F.size(c) > most_buckets, F.raise_error(F.lit("merged histogram has too many buckets")).cast("array<struct<key:int,value:double>>")).otherwise(F.coalesce(c, empty))
    sign = F.when(F.lit(how == "avg"), 1.0 / F.col("n")).otherwise(1.0)
    hist = F.struct("count", "sum", "scale", "zero_count", *(F.map_from_entries(guard(F.col(n))).alias(n) for n in ("positive", "negative")))
    return both.select("labels", "ts", hg.scaled(hist, sign).alias("hist"))


def _windowed(rows: DataFrame, grid: Grid, range_ms: int) -> DataFrame:
    """(labels, ts, s): each series' samples (ts, hist) in each window, in order."""
    windows = Windows(grid, range_ms)
    kept = rows.where(windows.relevant(F.col("ts")) & F.col("hist").isNotNull()).withColumns({"k": lb.key(F.col("labels")), "slot": windows.slot(F.col("ts"))})
    slots = kept.groupBy("k", "slot").agg(F.any_value("labels").alias("labels"), F.collect_list(F.struct("ts", "hist")).alias("s"))
    spread = slots.withColumn("point", F.explode(windows.points(F.col("slot"))))
    gathered = spread.groupBy("k", "point").agg(F.any_value("labels").alias("labels"), F.flatten(F.collect_list("s")).alias("s"))
    in_order = F.array_sort(F.col("s"), lambda a, b: F.when(a["ts"] < b["ts"], -1).when(a["ts"] > b["ts"], 1).otherwise(0))
    return gathered.select(lb.nameless(F.col("labels")).alias("labels"), F.col("point").alias("ts"), in_order.alias("s"))


def over_time(rows: DataFrame, how: str, grid: Grid, range_ms: int) -> DataFrame:
    """sum_over_time, avg_over_time; the extrapolated increase or rate of histogram counters, or the delta of gauges;
    irate and idelta of the last two."""
    gathered = _windowed(rows, grid, range_ms)
    s = F.col("s")
    if how in ("sum_over_time", "avg_over_time"):
        total = hg.added(F.transform(s, lambda x: x["hist"]))
        hist = hg.scaled(total, 1.0 / F.size(s)) if how == "avg_over_time" else total
        return gathered.select("labels", "ts", hist.alias("hist"))
    first, last, before = F.get(s, F.lit(0)), F.get(s, F.size(s) - 1), F.get(s, F.size(s) - 2)
    minus = lambda a, b: hg.added(F.array(a, hg.scaled(b, F.lit(-1.0))))
    if how in ("irate", "idelta"):
        gap = (last["ts"] - before["ts"]) / 1000.0
        change = F.when(hg.fell(before["hist"], last["hist"]), last["hist"]).otherwise(minus(last["hist"], before["hist"])) if how == "irate" else minus(last["hist"], before["hist"])
        pairs = gathered.where((F.size("s") >= 2) & (gap > 0))
        return pairs.select("labels", "ts", change.alias("hist"), gap.alias("gap")).select("labels", "ts", (hg.scaled(F.col("hist"), 1.0 / F.col("gap")) if how == "irate" else F.col("hist")).alias("hist"))
    counter = how != "delta"
    ends = gathered.where(F.size("s") >= 2).select("labels", "ts", "s", minus(last["hist"], first["hist"]).alias("change"))
    if counter:
        fell = F.transform(s, lambda x, i: (i > 0) & F.coalesce(hg.fell(F.get(s, i - 1)["hist"], x["hist"]), F.lit(False)))
        ends = ends.withColumn("fell", fell)
        lost = F.filter(F.transform(s, lambda x, i: F.when(F.get("fell", i + 1), x["hist"])), lambda x: x.isNotNull())
        ends = ends.withColumn("lost", lost).withColumn("change", hg.added(F.concat(F.array("change"), F.col("lost"))))
    whole = ends.select("labels", "ts", F.col("change").alias("hist"), first["ts"].alias("first_ts"), last["ts"].alias("last_ts"), first["hist"]["count"].alias("first"), F.size("s").alias("n"))
    # the factor is that of any change that is carried on to the edges, here of the counts
    one = extrapolated(F.col("hist.count"), F.col("first_ts"), F.col("last_ts"), F.col("n"), F.col("first"), F.col("ts"), range_ms, counter, how == "rate")
    carried = extrapolated(F.lit(1.0), F.col("first_ts"), F.col("last_ts"), F.col("n"), F.lit(1e300), F.col("ts"), range_ms, False, how == "rate")
    factor = F.when(F.col("hist.count") == 0, carried).otherwise(F.try_divide(one, F.col("hist.count")))
    return whole.select("labels", "ts", hg.scaled(F.col("hist"), factor).alias("hist")).where("hist.count is not null")


def changes(rows: DataFrame, how: str, grid: Grid, range_ms: int) -> DataFrame:
    """resets or changes of histograms in each window, as numbers."""
    s = F.col("s")
    moved = (lambda a, b: hg.fell(a, b)) if how == "resets" else (lambda a, b: ~hg.same(a, b))
    pairs = F.filter(F.transform(s, lambda x, i: (i > 0) & moved(F.get(s, i - 1)["hist"], x["hist"])), lambda x: F.coalesce(x, F.lit(False)))
    return _windowed(rows, grid, range_ms).select("labels", "ts", F.size(pairs).cast("double").alias("value"))


def counted(rows: DataFrame, how: str = "count", by: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """count or group of the series of each group, histograms and numbers alike."""
    value = F.count("*").cast("double") if how == "count" else F.lit(1.0) + F.count("*") * 0.0
    return rows.withColumn("labels", grouping(by, without)).groupBy("labels", "ts").agg(value.alias("value"))


def count_values(rows: DataFrame, name: str, by: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """Number of histograms with each text, which becomes a label."""
    labelled = rows.where("hist is not null").withColumn("labels", lb.with_label(grouping(by, without), name, hg.text(F.col("hist"))))
    return labelled.groupBy(lb.canonical(F.col("labels")).alias("labels"), "ts").agg(F.count("*").cast("double").alias("value"))


def numbers(rows: DataFrame) -> DataFrame:
    """The numbers of a mixed frame (labels, ts, value, hist): aggregations that know no histograms drop them."""
    return rows.where("hist is null").select("labels", "ts", "value")


def binary(left: DataFrame, op: str, right: DataFrame, on: list[str] | None = None, ignoring: list[str] | None = None) -> DataFrame:
    """Histogram + or - histogram, or == / != keeping the left one where it holds."""
    key = match_key(on, ignoring)
    both = left.withColumn("k", key).join(right.select(key.alias("k"), "ts", F.col("hist").alias("other")), ["k", "ts"])
    own = lb.nameless(F.col("labels")).alias("labels")
    if op in "+-":
        return both.select(own, "ts", hg.added(F.array(F.col("hist"), hg.scaled(F.col("other"), F.lit(1.0 if op == "+" else -1.0)))).alias("hist"))
    same = hg.same(F.col("hist"), F.col("other"))
    return both.where(same if op == "==" else ~same).select("labels", "ts", "hist")


def scale_by(rows: DataFrame, factor: DataFrame | float, divide: bool = False, on: list[str] | None = None, ignoring: list[str] | None = None) -> DataFrame:
    """Histograms times (or divided by) a number, or a matching vector's values."""
    f = lambda c: 1.0 / c if divide else c
    if not isinstance(factor, DataFrame):
        return rows.select(lb.nameless(F.col("labels")).alias("labels"), "ts", hg.scaled(F.col("hist"), f(F.lit(float(factor)))).alias("hist"))
    key = match_key(on, ignoring)
    both = rows.withColumn("k", key).join(factor.select(key.alias("k"), "ts", "value"), ["k", "ts"])
    return both.select(lb.nameless(F.col("labels")).alias("labels"), "ts", hg.scaled(F.col("hist"), f(F.col("value"))).alias("hist"))
