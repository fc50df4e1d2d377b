import datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import histograms as hg, labels as lb, logs as lg
from tidewatch.operators import histograms as h, logs as lo, metadata as md, metrics as m, traces as t
from tidewatch.plans.grid import Grid
from tidewatch.sources.store import Store

SPAN = "trace_id string, span_id string, parent_id string, name string, service string, kind string, status string, start long, duration long, resource map<string,string>, attributes map<string,string>"


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def test_store_reads_logs_and_traces(spark):
    logs = spark.createDataFrame([(at(1), "line", "WARN", {"k": "v"}, {"service.name": "a"}, "b"), (at(2), "two", "", {}, {}, "b")], "Timestamp timestamp, Body string, SeverityText string, LogAttributes map<string,string>, ResourceAttributes map<string,string>, ServiceName string")
    spans = spark.createDataFrame([("t", "a", "", "root", "s", "Server", "Ok", at(0), 5_000_000, {}, {"x": "1"}), ("t", "b", "a", "leaf", "s", "Client", "Ok", at(9), 2_000_000, {}, {})], "TraceId string, SpanId string, ParentSpanId string, SpanName string, ServiceName string, SpanKind string, StatusCode string, Timestamp timestamp, Duration long, ResourceAttributes map<string,string>, SpanAttributes map<string,string>")
    store = Store({"otel_logs": logs, "spans": spans}.__getitem__, tables={"traces": "spans"})
    found = lo.streams(store.logs(), ("service_name", "=", "a")).collect()
    assert [(r.line, r.labels["detected_level"], r.labels["k"]) for r in found] == [("line", "warn", "v")]
    times = store.trace_times()
    row = times.first()
    assert row.last - row.first == 9_002 and store.trace("t", times).count() == 2 and store.trace("none", times).count() == 0
    assert t.structural(s := store.spans(), s.where("name = 'root'"), ">", s).select("span_id").collect()[0][0] == "b"


def test_store_finds_a_name_in_its_tables(spark):
    layout = "MetricName string, Attributes map<string,string>, TimeUnix timestamp, Value double, ResourceAttributes map<string,string>, ServiceName string, AggregationTemporality int"
    gauge = spark.createDataFrame([("cpu.load", {"a.b": "1", "host": "own"}, at(0), 1.0, {"host": "other", "zone": "z"}, "svc", 0)], layout)
    sums = spark.createDataFrame([("hits", {}, at(0), 2.0, {}, "svc", 1), ("hits", {}, at(1), 3.0, {}, "svc", 2)], layout)
    none = "MetricName string, Attributes map<string,string>, TimeUnix timestamp, ResourceAttributes map<string,string>, ServiceName string, Count long, Sum double, "
    classic = spark.createDataFrame([], none + "ExplicitBounds array<double>, BucketCounts array<long>")
    exponential = spark.createDataFrame([("took", {}, at(0), {}, "", 3, 6.0, 0, 1, 0, [1, 1], 0, [])], none + "Scale int, ZeroCount long, PositiveOffset int, PositiveBucketCounts array<long>, NegativeOffset int, NegativeBucketCounts array<long>")
    store = Store({"otel_metrics_gauge": gauge, "otel_metrics_sum": sums, "otel_metrics_histogram": classic, "otel_metrics_exponential_histogram": exponential}.__getitem__)
    assert [r.labels for r in store.samples("cpu_load").collect()] == [{"__name__": "cpu_load", "a_b": "1", "host": "own", "service_name": "svc", "zone": "z"}]
    assert [r.value for r in store.numbers("sum", "hits", delta=True).collect()] == [2.0]
    assert {(r.labels["__name__"], r.value) for r in store.samples("took_count").collect()} == {("took_count", 3.0)}
    assert store.samples("took").count() == 0 and store.samples().count() == 5
    assert store.exponential("took").first().hist.positive == {0: 1.0, 1: 1.0}
    for pattern, n in (("took_(count|sum)", 2), ("took", 0), ("cpu_l.*|hits", 3)):
        found, all_ = store.samples(pattern=pattern), m.select(store.samples(), ("__name__", "=~", pattern))
        assert sorted(map(repr, found.collect())) == sorted(map(repr, all_.collect())) and found.count() == n
    assert "map_filter" not in store.numbers("sum", pattern="took_.*")._jdf.queryExecution().optimizedPlan().toString().split("Filter")[-1]


def spans(spark, *rows):
    return spark.createDataFrame([("t", i, p, n, "s", "k", "Ok", k, 1, {}, {}) for k, (i, p, n) in enumerate(rows)], SPAN)


def test_paths_of_deep_traces_circles_and_orphans(spark):
    deep = [("0", "", "root")] + [(str(i), str(i - 1), "x") for i in range(1, 300)]
    s = spans(spark, *deep, ("a", "b", "circle"), ("b", "a", "circle"), ("me", "me", "circle"), ("o", "gone", "orphan"), ("p", "o", "orphan"))
    found = {r.span_id: r.above for r in t.paths(s).collect()}
    assert len(found) == 300 and found["299"] == [str(i) for i in range(299)] and found["0"] == []
    assert [r.span_id for r in t.structural(s, s.where("span_id = '3'"), "<<", s.where("span_id in ('1', '2', '4')")).orderBy("span_id").collect()] == ["1", "2"]


def test_parents_and_booleans(spark):
    s = spark.createDataFrame([("t", "a", "", "A", "s", "k", "Ok", 0, 1, {"r": "1"}, {"ok": "true"}), ("t", "b", "a", "B", "s", "k", "Ok", 0, 1, {}, {"ok": "x"})], SPAN)
    found = t.with_parent(s).where((t.attribute("r", "parent.resource") == "1") & t.exists("ok", "parent")).collect()
    assert [r.span_id for r in found] == ["b"]
    assert [r[0] for r in s.orderBy("span_id").select(t.boolean("ok")).collect()] == [True, None]
    assert [r[0] for r in s.orderBy("span_id").select(t.attribute("r", "any")).collect()] == ["1", ""]


def test_line_templates_do_not_depend_on_partitions(spark):
    lines = [f"user {i} logged in from host-{i % 7}" for i in range(90)] + [f"disk full on {c}" for c in "abcdef" * 10] + ["rare line"]
    logs = spark.createDataFrame([(i, x, {"detected_level": "info"}) for i, x in enumerate(lines)], "ts long, line string, labels map<string,string>")
    want = {("info", "user <_> logged in from <_>", 90), ("info", "disk full on <_>", 60)}
    for n in (1, 7):
        assert {tuple(r) for r in md.templates(logs.repartition(n)).collect()} == want


def test_histogram_counters_with_resets(spark):
    hist = lambda count, buckets: (float(count), float(count), 0, 0.0, {k: float(v) for k, v in buckets.items()}, {})
    rows = [({"a": "x"}, 0, hist(4, {0: 4})), ({"a": "x"}, 30_000, hist(10, {0: 6, 1: 4})), ({"a": "x"}, 60_000, hist(3, {1: 3}))]
    s = spark.createDataFrame(rows, f"labels map<string,string>, ts long, hist {hg.HISTOGRAM}")
    grid = Grid.instant(60_000)
    increase = h.over_time(s, "increase", grid, 61_000).first().hist
    # the change from first to last and what was lost at the reset: 3 - 4 + 10, carried on to the start by the second before it
    assert increase["count"] == pytest.approx(9 * 61 / 60)
    delta = h.over_time(s, "delta", grid, 61_000).first().hist
    assert delta["count"] == pytest.approx(-1 * 61 / 60) and delta["positive"][0] == pytest.approx(-4 * 61 / 60)
    assert h.over_time(s, "irate", grid, 61_000).first().hist["count"] == pytest.approx(3 / 30)
    assert h.over_time(s, "idelta", grid, 61_000).first().hist["count"] == -7.0
    assert [h.changes(s, how, grid, 61_000).first().value for how in ("resets", "changes")] == [1.0, 2.0]
    assert s.limit(1).select(hg.text(F.col("hist"))).first()[0] == "{count:4, sum:4, (1,2]:4}"
    assert h.count_values(s, "v").count() == 3 and h.counted(s, "group").count() == 3
    one = h.over_time(s.where("ts = 0"), "rate", grid, 61_000)
    assert one.count() == 0


def test_label_conditions(spark):
    rows = spark.createDataFrame([(i, "", {"a": a, "b": b}) for i, (a, b) in enumerate([("1", "x"), ("no", "x"), ("9", "y"), ("", "x")])], "ts long, line string, labels map<string,string>")
    found = lo.where(rows, lg.any_of(lg.condition("a", ">", 5, "number"), lg.condition("b", "=", "x"))).orderBy("ts").collect()
    assert [(r.ts, r.labels.get("__error__")) for r in found] == [(0, None), (1, "LabelFilterErr"), (2, None), (3, None)]
    found = lo.where(rows, lg.all_of(lg.condition("a", ">", 0, "number"), lg.condition("b", "=", "x"))).orderBy("ts").collect()
    assert [(r.ts, r.labels.get("__error__")) for r in found] == [(0, None), (1, "LabelFilterErr")]


def test_json_levels_numbers_and_clashes(spark):
    line = '{"a":{"b":{"c":1}},"n":2.5,"s":"{\\\\"x\\\\":1}","e":{},"a-b":"x","a_b":"y","big":12345678901234567890}'
    row = spark.createDataFrame([(line.replace("\\\\", "\\"), {})], "line string, labels map<string,string>").select(lg.parse_json(F.col("labels"), F.col("line")).alias("l")).first()
    assert row.l == {"a_b_c": "1", "n": "2.5", "s": '{"x":1}', "a_b": "y", "big": "12345678901234567890"}


def test_exemplars_and_context(spark):
    rows = spark.createDataFrame([({"__name__": "m", "a": "1"}, [(5, 1.0, {"trace": "t"}), (50, 2.0, {})])], "labels map<string,string>, exemplars array<struct<ts:long,value:double,labels:map<string,string>>>")
    assert [(r.ts, r.value, r.exemplar_labels) for r in m.exemplars(rows, 0, 10, ("a", "=", "1")).collect()] == [(5, 1.0, {"trace": "t"})]
    assert (Grid(0, 60_000, 15_000).range_seconds, Grid(0, 60_000, 15_000).step_seconds, Grid.instant(5).step_seconds) == (60.0, 15.0, 0.0)
    assert lb.candidates("a_b") == ["a_b", "a.b"]
