"""Telemetry tables as collectors write them, read as samples, histograms, logs and spans.

Tables and columns have the names that the OpenTelemetry exporters for column stores give them; both can be
overridden. A metric's name is looked for in the tables that may hold it, and filters on it reach their scans.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import histograms as hg, labels as lb
from ..operators import histograms as ho

# The exporters' names of tables and columns.
TABLES = {"gauge": "otel_metrics_gauge", "sum": "otel_metrics_sum", "histogram": "otel_metrics_histogram", "exponential": "otel_metrics_exponential_histogram", "logs": "otel_logs", "traces": "otel_traces"}
COLUMNS = {
    "name": "MetricName", "attributes": "Attributes", "time": "TimeUnix", "value": "Value", "resource": "ResourceAttributes", "service": "ServiceName", "temporality": "AggregationTemporality",
    "count": "Count", "sum": "Sum", "bounds": "ExplicitBounds", "buckets": "BucketCounts", "scale": "Scale", "zero_count": "ZeroCount",
    "positive_offset": "PositiveOffset", "positive": "PositiveBucketCounts", "negative_offset": "NegativeOffset", "negative": "NegativeBucketCounts", "exemplars": "Exemplars",
    "log_time": "Timestamp", "body": "Body", "severity": "SeverityText", "log_attributes": "LogAttributes",
    "trace_id": "TraceId", "span_id": "SpanId", "parent_id": "ParentSpanId", "span_name": "SpanName", "kind": "SpanKind", "status": "StatusCode", "status_message": "StatusMessage",
    "start": "Timestamp", "duration": "Duration", "span_attributes": "SpanAttributes", "scope_name": "ScopeName", "scope_version": "ScopeVersion", "events": "Events", "links": "Links",
}
DELTA = 1  # the temporality of counters that are stored as increases


@dataclass(frozen=True)
class Store:
    """read gives the table of a name; tables and columns override single names."""

    read: Callable[[str], DataFrame]
    tables: dict[str, str] = field(default_factory=dict)
    columns: dict[str, str] = field(default_factory=dict)

    def table(self, kind: str) -> DataFrame:
        return self.read({**TABLES, **self.tables}[kind])

    def column(self, name: str) -> Column:
        return F.col({**COLUMNS, **self.columns}[name])

    def _labels(self, suffix: str = "") -> Column:
        return lb.with_label(lb.with_resource(lb.sanitised(self.column("attributes")), self.column("resource"), self.column("service")), lb.NAME, self._metric(suffix))

    def _time(self) -> Column:
        return F.unix_millis(self.column("time").cast("timestamp"))

    def _metric(self, suffix: str = "") -> Column:
        return F.concat(F.regexp_replace(self.column("name"), "[^a-zA-Z0-9_:]", "_"), F.lit(suffix))

    def _named(self, kind: str, name: str | None, pattern: str | None = None, suffix: str = "") -> DataFrame:
        """The rows of a table, or those of the metrics whose name, dotted or not, is this one, or, with the suffix,
        matches a pattern; the table's own column is tested, so other rows get no labels."""
        rows = self.table(kind)
        if pattern is not None:
            rows = rows.where(self._metric(suffix).rlike(lb.anchored(pattern)))
        return rows if name is None else rows.where(self.column("name").isin(lb.candidates(name)))

    def numbers(self, kind: str, name: str | None = None, delta: bool | None = None, pattern: str | None = None) -> DataFrame:
        """Samples of the gauge or sum table; delta chooses counters stored as increases, or the others."""
        rows = self._named(kind, name, pattern)
        if delta is not None:
            rows = rows.where(self.column("temporality") == DELTA if delta else self.column("temporality") != DELTA)
        return rows.select(self._labels().alias("labels"), self._time().alias("ts"), self.column("value").cast("double").alias("value"))

    def classic(self, name: str | None = None, pattern: str | None = None, suffix: str = "") -> DataFrame:
        """Rows (labels, ts, bounds, counts, count, sum) of classic histograms."""
        bounds, counts = self.column("bounds").cast("array<double>"), self.column("buckets").cast("array<double>")
        return self._named("histogram", name, pattern, suffix).select(self._labels().alias("labels"), self._time().alias("ts"), bounds.alias("bounds"), counts.alias("counts"), self.column("count").cast("double").alias("count"), self.column("sum").cast("double").alias("sum"))

    def exponential(self, name: str | None = None, pattern: str | None = None, suffix: str = "") -> DataFrame:
        """Rows (labels, ts, hist) of exponential histograms."""
        c = self.column
        hist = hg.exponential(c("count"), c("sum"), c("scale"), c("zero_count"), c("positive_offset"), c("positive"), c("negative_offset"), c("negative"))
        return self._named("exponential", name, pattern, suffix).select(self._labels().alias("labels"), self._time().alias("ts"), hist.alias("hist"))

    def _companions(self, name: str | None, suffix: str, pattern: str | None) -> list[DataFrame]:
        """Counts or sums of both kinds of histogram as samples named with the suffix."""
        renamed = lambda: lb.with_label(F.col("labels"), lb.NAME, F.concat(lb.label(F.col("labels"), lb.NAME), F.lit(suffix)))
        part = suffix[1:]
        return [
            self.classic(name, pattern, suffix).select(renamed().alias("labels"), "ts", F.col(part).alias("value")),
            self.exponential(name, pattern, suffix).select(renamed().alias("labels"), "ts", F.col(f"hist.{part}").alias("value")),
        ]

    def samples(self, name: str | None = None, pattern: str | None = None) -> DataFrame:
        """Samples of a metric's name: of gauges and sums, and, if it ends so, the buckets, counts or sums of histograms.

        Without a name the samples of all tables; with a pattern those whose whole name, suffix included, matches it.
        """
        found = [self.numbers("gauge", name, pattern=pattern), self.numbers("sum", name, pattern=pattern)]
        for suffix in ("_bucket", "_count", "_sum"):
            if name is not None and not name.endswith(suffix):
                continue
            base = name.removesuffix(suffix) if name is not None else None
            if suffix != "_bucket":
                found += self._companions(base, suffix, pattern)
                continue
            series = ho.bucket_series(self.classic(base, pattern, suffix))
            found.append(series.withColumn("labels", lb.with_label(F.col("labels"), lb.NAME, F.concat(lb.label(F.col("labels"), lb.NAME), F.lit(suffix)))))
        return reduce(DataFrame.unionByName, (f.select("labels", "ts", "value") for f in found))

    def catalogue(self) -> DataFrame:
        """(metric, kind): the names of all metrics, with gauge, counter or histogram."""
        kinds = {"gauge": "gauge", "sum": "counter", "histogram": "histogram", "exponential": "histogram"}
        name = F.regexp_replace(self.column("name"), "[^a-zA-Z0-9_:]", "_").alias("metric")
        return reduce(DataFrame.unionByName, (self.table(t).select(name, F.lit(k).alias("kind")).distinct() for t, k in kinds.items())).distinct()

    def logs(self) -> DataFrame:
        """Log records (ts, line, resource, attributes, severity); the service is a label of the resource."""
        c = self.column
        resource = lb.with_label(c("resource"), "service_name", F.coalesce(F.nullif(lb.label(c("resource"), "service.name"), F.lit("")), c("service"), F.lit("")))
        return self.table("logs").select(F.unix_micros(c("log_time").cast("timestamp")).alias("ts"), c("body").alias("line"), resource.alias("resource"), c("log_attributes").alias("attributes"), c("severity").alias("severity"))

    def spans(self) -> DataFrame:
        """The span frame of operators.traces; events, links and the scope come along where the table has them."""
        c, rows = self.column, self.table("traces")
        named = {**COLUMNS, **self.columns}
        more = [c(n).alias(n) for n in ("status_message", "scope_name", "scope_version", "events", "links") if named[n] in rows.columns]
        return rows.select(
            *(c(n).alias(n) for n in ("trace_id", "span_id", "parent_id")), c("span_name").alias("name"), c("service").alias("service"), c("kind").alias("kind"), c("status").alias("status"),
            F.unix_millis(c("start").cast("timestamp")).alias("start"), (c("duration") / 1e6).cast("long").alias("duration"), c("resource").alias("resource"), c("span_attributes").alias("attributes"), *more,
        )

    def trace_times(self) -> DataFrame:
        """First and last millisecond of each trace: a small table that bounds scans for a trace's spans."""
        spans = self.spans()
        return spans.groupBy("trace_id").agg(F.min("start").alias("first"), F.max(F.col("start") + F.col("duration")).alias("last"))

    def trace(self, trace_id: str, times: DataFrame | None = None) -> DataFrame:
        """A trace's spans; with the table of times, the scan is bounded by the trace's."""
        spans = self.spans().where(F.col("trace_id") == trace_id)
        bounds = times.where(F.col("trace_id") == trace_id).first() if times is not None else None
        return spans.where(F.col("start").between(bounds["first"], bounds["last"])) if bounds else spans
