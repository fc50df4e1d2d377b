"""Log queries: streams, pipelines, and metrics made of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as lb, logs as lg
from ..plans.grid import Grid
from . import metrics as m


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are computed once a row, however often later steps and filters read them.

    An optimizer puts a column's expression wherever the column is read, so a parsed line would be parsed again for
    each test of its labels; what a generator gives is not put anywhere, and filters on it stay above it.
    """
    made = F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items()))))
    names = [*rows.columns, *(name for name in columns if name not in rows.columns)]
    return rows.select(*(c for c in rows.columns if c not in columns), made).select(*names)


def streams(records: DataFrame, *matchers: tuple[str, str, str]) -> DataFrame:
    """Records (ts, line, resource, attributes, severity) of the streams whose labels pass the matchers, as a log frame.

    Matchers see the resource's labels; then the attributes join them, resource labels winning, and the level.
    """
    kept = once(records, labels=lb.sanitised(F.col("resource")), attributes=F.col("attributes"))
    for matcher in matchers:
        kept = kept.where(lb.matches(F.col("labels"), *matcher))
    every = lb.canonical(lb.merged(F.col("labels"), lb.sanitised(F.col("attributes"))))
    level = lg.detected_level(F.col("attributes"), F.col("severity"))
    return once(kept, labels=lb.with_label(every, "detected_level", level)).select("ts", "line", "labels")


def lines(logs: DataFrame, op: str, *values: str) -> DataFrame:
    return logs.where(lg.line_matches(F.col("line"), op, *values))


def parse(logs: DataFrame, parser, *args, **options) -> DataFrame:
    """Labels parsed from each line, by a parser of functions.logs."""
    return once(logs, labels=parser(F.col("labels"), F.col("line"), *args, **options))


def unpack(logs: DataFrame) -> DataFrame:
    labels, line = lg.unpack(F.col("labels"), F.col("line"))
    return once(logs, labels=labels, line=line)


def where(logs: DataFrame, condition: lg.Condition) -> DataFrame:
    """Label filter, made of functions.logs' condition, all_of and any_of; comparing numbers, durations or bytes
    marks values that can't be read."""
    stays, labels = condition(F.col("labels"))
    return once(logs, labels=labels, tw_stays=stays).where("tw_stays").drop("tw_stays")


def where_label(logs: DataFrame, name: str, op: str, value: float | str, kind: str = "string") -> DataFrame:
    """Label filter of one comparison."""
    return where(logs, lg.condition(name, op, value, kind))


def line_format(logs: DataFrame, template: str) -> DataFrame:
    return once(logs, line=lg.template(template, F.col("labels"), F.col("line"), F.col("ts")))


def label_format(logs: DataFrame, **targets: str) -> DataFrame:
    """Labels set from templates."""
    labels = F.col("labels")
    for name, template in targets.items():
        labels = lb.with_label(labels, name, lg.template(template, F.col("labels"), F.col("line"), F.col("ts")))
    return once(logs, labels=labels)


def rename_label(logs: DataFrame, target: str, source: str) -> DataFrame:
    labels = F.col("labels")
    return logs.withColumn("labels", F.map_filter(lb.with_label(labels, target, lb.label(labels, source)), lambda k, _: k != source))


def _without(labels: Column, name: str) -> Column:
    return F.map_filter(labels, lambda k, _: k != name)


def drop(logs: DataFrame, *names: str, matchers: tuple[tuple[str, str, str], ...] = ()) -> DataFrame:
    """Without these labels, and those that pass a matcher on their value."""
    labels = F.map_filter(F.col("labels"), lambda k, _: ~k.isin(*names)) if names else F.col("labels")
    for name, op, value in matchers:
        labels = F.when(lb.matches(F.col("labels"), name, op, value), _without(labels, name)).otherwise(labels)
    return logs.withColumn("labels", labels)


def keep(logs: DataFrame, *names: str) -> DataFrame:
    """Only these labels and error labels."""
    return logs.withColumn("labels", F.map_filter(F.col("labels"), lambda k, _: k.isin(*names, lg.ERROR, "__error_details__")))


def decolorize(logs: DataFrame) -> DataFrame:
    return logs.withColumn("line", lg.decolorize(F.col("line")))


def _samples(logs: DataFrame, value: Column, labels: Column | None = None) -> DataFrame:
    own = F.col("labels") if labels is None else labels
    return once(logs, labels=own, value=value.cast("double")).where("value is not null").select("labels", F.floor(F.col("ts") / 1000).cast("long").alias("ts"), "value")


def over_lines(logs: DataFrame, function: str, grid: Grid, range_ms: int, offset_ms: int = 0) -> DataFrame:
    """count_over_time, rate, bytes_over_time or bytes_rate of each stream."""
    bytes_ = function.startswith("bytes")
    counted = m.rolled(_samples(logs, F.octet_length("line") if bytes_ else F.lit(1.0)), ["sum_over_time"], grid, range_ms, offset_ms)
    per = range_ms / 1000.0 if function in ("rate", "bytes_rate") else 1.0
    return counted.select("labels", "ts", (F.col("sum_over_time") / per).alias("value"))


def over_values(logs: DataFrame, label: str, function, grid: Grid, range_ms: int, kind: str = "number", by: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """A range function over a label's values; the label leaves the streams' identity."""
    value, labels = lg.unwrap(F.col("labels"), label, kind)
    if by is not None:
        labels = lb.by(labels, by)
    elif without is not None:
        labels = lb.without(labels, without)
    samples = _samples(logs, value, lb.canonical(labels))
    if function == "rate":
        counted = m.rolled(samples, ["sum_over_time"], grid, range_ms)
        return counted.select("labels", "ts", (F.col("sum_over_time") / (range_ms / 1000.0)).alias("value"))
    if function == "rate_counter":
        return m.over_time(samples, "rate", grid, range_ms)
    return m.over_time(samples, function, grid, range_ms, once=False)


def variants(logs: DataFrame, functions: list[str], grid: Grid, range_ms: int) -> DataFrame:
    """Several line functions over one scan, told apart by the label __variant__."""
    both = logs.select("labels", F.floor(F.col("ts") / 1000).cast("long").alias("ts"), F.octet_length("line").cast("double").alias("value"))
    found = m.rolled(both, ["count_over_time", "sum_over_time"], grid, range_ms)
    value = {"count_over_time": F.col("count_over_time"), "rate": F.col("count_over_time") / (range_ms / 1000.0), "bytes_over_time": F.col("sum_over_time"), "bytes_rate": F.col("sum_over_time") / (range_ms / 1000.0)}
    each = F.explode(F.array(*(F.struct(F.lit(str(i)).alias("variant"), value[f].alias("value")) for i, f in enumerate(functions))))
    return found.withColumn("x", each).select(lb.with_label(F.col("labels"), "__variant__", F.col("x.variant")).alias("labels"), "ts", F.col("x.value").alias("value"))
