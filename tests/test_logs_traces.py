import json
import tempfile
from collections import Counter

from pyspark.sql import functions as F

from tidewatch.functions import labels as lb, logs as lg
from tidewatch.operators import logs as lo, metadata as md, traces as t
from tidewatch.queries import logs as log_queries, traces as trace_queries
from tidewatch.sources import adapters as ad
from tidewatch.streaming.tail import follow, tail

SPAN = "trace_id string, span_id string, parent_id string, name string, service string, kind string, status string, start long, duration long, resource map<string,string>, attributes map<string,string>"


def logs(spark, *rows):
    return spark.createDataFrame([(i, line, labels) for i, (line, labels) in enumerate(rows)], "ts long, line string, labels map<string,string>")


def labels(df):
    return [r.labels for r in df.orderBy("ts").collect()]


def test_json_flattens_and_keeps_stream_labels(spark):
    found = labels(lo.parse(logs(spark, ('{"a":{"b":1.0},"a_b":2,"level":"warn","x":[1],"n":null,"t":true}', {"level": "error"}), ("no", {})), lg.parse_json))
    assert found[0] == {"level": "error", "a_b": "2", "level_extracted": "warn", "n": "", "t": "true"}
    assert found[1] == {"__error__": "JSONParserErr"}


def test_logfmt_pattern_regexp_unpack(spark):
    line = 'level=info msg="a \\"b\\"" n=1 n=2 empty='
    assert labels(lo.parse(logs(spark, (line, {})), lg.parse_logfmt)) == [{"level": "info", "msg": 'a "b"', "n": "2"}]
    assert labels(lo.parse(logs(spark, ("10.0.0.1 - GET /x", {})), lg.parse_pattern, "<ip> - <method> <_>")) == [{"ip": "10.0.0.1", "method": "GET"}]
    assert labels(lo.parse(logs(spark, ("GET /x", {})), lg.parse_regexp, r"(?P<method>\w+) (?P<path>\S+)")) == [{"method": "GET", "path": "/x"}]
    row = lo.unpack(logs(spark, ('{"_entry":"line","a":"1"}', {}))).first()
    assert (row.line, row.labels) == ("line", {"a": "1"})


def test_label_filter_marks_what_it_cannot_read(spark):
    rows = logs(spark, *(("", {"status": s}) for s in ("200", "500", "oops")), ("", {}))
    assert labels(lo.where_label(rows, "status", ">=", 400, "number")) == [{"status": "500"}, {"status": "oops", "__error__": "LabelFilterErr"}]


def test_units_and_ip(spark):
    row = spark.range(1).select(lg.duration_seconds(F.lit("1h30m")).alias("d"), lg.byte_size(F.lit("2KiB")).alias("b"), lg.byte_size(F.lit("x")).alias("n"), lg.has_ip(F.lit("from 192.168.4.7 on"), "192.168.4.0/24").alias("i"), lg.has_ip(F.lit("from ::1 on"), "::/64").alias("j"), lg.has_ip(F.lit("1.2.3.4.5"), "0.0.0.0/0").alias("k")).first()
    assert (row.d, row.b, row.n, row.i, row.j, row.k) == (5400.0, 2048.0, None, True, True, False)


def test_levels(spark):
    row = spark.range(1).select(lg.detected_level(F.create_map(F.lit("level"), F.lit("WRN")), F.lit("x")).alias("a"), lg.detected_level(F.create_map().cast("map<string,string>"), F.lit("")).alias("b")).first()
    assert (row.a, row.b) == ("warn", "unknown")


def spans(spark, *rows):
    return spark.createDataFrame([("t", i, p, n, "s", "k", "Ok", k, 1, {}, {}) for k, (i, p, n) in enumerate(rows)], SPAN)


def ids(df):
    return sorted(r.span_id for r in df.collect())


def test_structure_leaves_orphans_out(spark):
    s = spans(spark, ("a", "", "A"), ("b", "a", "B"), ("c", "b", "C"), ("r", "", "R"), ("x", "gone", "X"), ("y", "x", "C"), ("z", "gone", "Z"))
    where = lambda n: s.where(F.col("name") == n)
    assert ids(t.structural(s, where("A"), ">>", where("C"))) == ["c"]
    assert ids(t.structural(s, where("X"), ">", where("C"))) == []
    assert ids(t.structural(s, where("C"), "<<", where("A"))) == ["a"]
    assert ids(t.structural(s, where("A"), "!>>", where("C"))) == ["y"]
    assert ids(t.structural(s, where("A"), "&>>", where("C"))) == ["a", "c"]
    assert ids(t.structural(s, where("A"), "~", where("R"))) == ["r"]
    assert ids(t.structural(s, where("X"), "~", where("Z"))) == []


def test_nested_sets(spark):
    s = spans(spark, ("a", "", "A"), ("b", "a", "B"), ("c", "b", "C"), ("d", "a", "D"), ("x", "gone", "X"))
    found = {r.span_id: (r.nested_left, r.nested_right, r.nested_parent) for r in t.nested_sets(s).collect()}
    assert found == {"a": (1, 8, -1), "b": (2, 5, 1), "c": (3, 4, 2), "d": (6, 7, 1), "x": (0, 0, 0)}


def test_nested_sets_numbers_repeated_and_prefixed_ids(spark):
    s = spans(spark, ("a", "", "A"), ("b", "a", "B"), ("b", "a", "B"), ("bc", "a", "C"), ("d", "b", "D"), ("e", "f", "E"), ("f", "e", "F"))
    found = sorted((r.span_id, r.nested_left, r.nested_right, r.nested_parent) for r in t.nested_sets(s).collect())
    assert found == [("a", 1, 8, -1), ("b", 2, 5, 1), ("b", 2, 5, 1), ("bc", 6, 7, 1), ("d", 3, 4, 2), ("e", 0, 0, 0), ("f", 0, 0, 0)]


def test_nested_sets_are_dealt_by_trace_once(spark):
    s = spans(spark, ("a", "", "A"), ("b", "a", "B"), ("c", "b", "C"))
    plan = t.nested_sets(s)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan  # sizes, parents and unrooted spans take no joins


SMALL = "/root/testdata/sf0.001"


def test_nested_sets_of_all_spans(spark):
    rows = trace_queries.spans(spark, SMALL).select("trace_id", "span_id", "parent_id", "name").collect()
    children, want = {}, {}
    for r in rows:
        children.setdefault((r.trace_id, r.parent_id), set()).add(r.span_id)

    def walk(trace, span, left, parent):
        right = left + 1
        for child in sorted(children.get((trace, span), ())):
            right = walk(trace, child, right, left) + 1
        want[trace, span] = (left, right, parent)
        return right

    for trace in {r.trace_id for r in rows}:
        begin = 1
        for root in sorted(children.get((trace, ""), ())):
            begin = walk(trace, root, begin, -1) + 1
    found = trace_queries.QUERIES["nested_sets_all"](spark, SMALL).collect()
    assert len(found) == len(rows) and sum(r.name == "item" for r in rows) > 1000
    assert {(r.trace_id, r.span_id): (r.nested_left, r.nested_right, r.nested_parent) for r in found} == want


def test_compare_of_all_attributes(spark):
    counts = {}
    for r in trace_queries.spans(spark, SMALL).collect():
        fixed = {"name": r.name, "status": r.status, "kind": r.kind, "resource.service.name": r.service}
        for k, v in {**fixed, **{f"resource.{k}": v for k, v in r.resource.items()}, **{f"span.{k}": v for k, v in r.attributes.items()}}.items():
            counts.setdefault((r.status == "Error", k), Counter())[v] += 1
    want = {(*key, v, n) for key, c in counts.items() for v, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:3]}
    found = {tuple(r) for r in trace_queries.QUERIES["span_compare_all"](spark, SMALL).select("selected", "attribute", "val", "n").collect()}
    assert found == want and {"span.price", "span.quantity", "span.supplier"} <= {x[1] for x in found}


def test_detected_fields_with_parsed_ones(spark):
    rows = spark.read.parquet(f"{SMALL}/events.parquet").collect()
    exact = {"event_type": {r.event_type for r in rows}, "user": {r.user_id for r in rows}, "k": {json.loads(r.props)["k"] for r in rows}, "detected_level": {"error", "info"}}
    found = {r.field: r for r in log_queries.QUERIES["detected_fields_all"](spark, SMALL).collect()}
    assert {f: r.kind for f, r in found.items()} == {"event_type": "string", "user": "int", "k": "int", "detected_level": "string"}
    assert all(abs(found[f].cardinality - len(x)) <= max(1, 0.15 * len(x)) for f, x in exact.items())


def test_templates(spark):
    rows = logs(spark, *((f"user {i} logged in from host{i}", {"detected_level": "info"}) for i in range(40)))
    assert [(r.template, r.n) for r in md.templates(rows).collect()] == [("user <_> logged in from <_>", 40)]


def test_tail_follows_files(spark):
    folder, where = tempfile.mkdtemp(), tempfile.mkdtemp()
    source = spark.createDataFrame([(1, "x error", {"app": "a"}, {}, "ERR"), (2, "y", {"app": "b"}, {}, "")], "ts long, line string, resource map<string,string>, attributes map<string,string>, severity string")
    source.write.mode("append").parquet(folder)
    stream = tail(follow(spark, folder, source.schema), (("app", "=", "a"),), lambda l: lo.lines(l, "|=", "error"))
    query = stream.writeStream.format("memory").queryName("tailed").option("checkpointLocation", where).start()
    query.processAllAvailable()
    query.stop()
    assert [r.labels["detected_level"] for r in spark.table("tailed").collect()] == ["error"]
    assert lb.NAME == "__name__"


def test_a_line_is_parsed_once_however_often_its_labels_are_read(spark):
    rows = logs(spark, ('{"k":60}', {}), ('{"k":"x"}', {}))
    sized = lo.where_label(lo.label_format(lo.parse(rows, lg.parse_json), size="{{.k}}KiB"), "size", ">=", 51200, "bytes")
    assert sized._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == lg.JSON_LEVELS
    assert labels(sized) == [{"k": "60", "size": "60KiB"}, {"k": "x", "size": "xKiB", "__error__": "LabelFilterErr"}]
    assert [r.b for r in spark.createDataFrame([("5",), ("-2KB",), ("1e3",), ("5b",), ("5d",), ("KB",)], "t string").select(lg.byte_size(F.col("t")).alias("b")).collect()] == [5.0, -2000.0, 1000.0, 5.0, 5.0, None]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_summaries_sort_roots_only(spark):
    one = lambda trace, span, parent, start, duration: (trace, span, parent, f"n{span}", f"s{span}", "", "Ok", start, duration, {}, {})
    spans = spark.createDataFrame([one("a", "1", "", 5, 10), one("a", "2", "1", 3, 1), one("a", "3", "", 4, 1), one("b", "1", "x", 7, 2), one("c", "1", "", 1, 1)], SPAN)
    found = t.summaries(spans, spans.where("trace_id in ('a', 'b')"))
    assert sorted(map(tuple, found.collect())) == [("a", "n3", "s3", 3, 12, 3), ("b", "", "", 7, 2, 1)]
    assert not any("SortAggregate" in line and "duration" in line for line in _plan(found))


def test_tags_read_spans_once_and_items_are_not_sorted(spark):
    spans = spark.createDataFrame([("1", {"x": "1"}, {"r": ""}), ("2", None, {"r": "2"}), ("3", {}, None)], "span_id string, attributes map<string,string>, resource map<string,string>")
    found = t.tags(spans)
    assert sorted(map(tuple, found.collect())) == [("resource", "r"), ("span", "x")]
    assert sum("Scan" in line for line in _plan(t.tags(spans))) == 1
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not any("SortMergeJoin" in line for line in _plan(trace_queries.spans(spark, "/root/testdata/sf0.001")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_events_of_one_row_group_are_dealt_to_many_tasks(spark, tmp_path):
    n = 400_000
    made = spark.range(n).selectExpr("id as event_id", "timestamp_micros(id * 1000000) as ts", "id % 7 as user_id", "'view' as event_type", "1.0D as value", "concat('{\"k\": ', id, '}') as props")
    made.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    logs = ad.event_logs(spark, str(tmp_path))
    rows = logs.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), *(F.max(F.to_json(c) if c in ("resource", "attributes") else c) for c in logs.columns)).collect()
    assert len(rows) > 1 and sum(r["n"] for r in rows) == n and max(r["n"] for r in rows) <= n // 2 + 1000
