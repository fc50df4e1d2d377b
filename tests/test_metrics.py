import math

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import histograms as hg, labels as lb, ranges
from tidewatch.operators import histograms as h, matching as mt, metrics as m
from tidewatch.plans.grid import Grid, Windows
from tidewatch.queries import histograms as histogram_queries, metrics as metric_queries

SCHEMA = "labels map<string,string>, ts long, value double"


def frame(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def values(df):
    return sorted((tuple(sorted(r.labels.items())), r.ts, r.value) for r in df.collect())


def test_window_arithmetic_against_brute_force(spark):
    for grid, range_ms, offset in ((Grid(100, 400, 30), 70, 0), (Grid(0, 90, 10), 5, 3), (Grid(50, 50, 1), 20, 0)):
        w = Windows(grid, range_ms, offset)
        found = spark.range(0, 500).select(F.col("id").alias("ts")).where(w.relevant(F.col("ts"))).select("ts", F.explode(w.points(w.slot(F.col("ts")))).alias("p"))
        want = {(t, p) for p in range(grid.start, grid.end + 1, grid.step) for t in range(500) if p - offset - range_ms < t <= p - offset}
        assert {(r.ts, r.p) for r in found.collect()} == want


def test_increase_counts_a_repeated_timestamp_once(spark):
    s = frame(spark, *(({"__name__": "c"}, t * 1000, v) for t, v in ((60, 10.0), (120, 20.0), (180, 30.0), (240, 40.0), (240, 40.0))))
    assert values(m.over_time(s, "increase", Grid.instant(300_000), 300_000)) == [((), 300_000, 50.0)]


def test_rate_adds_resets_and_rolled_agrees(spark):
    s = frame(spark, *(({"a": "x"}, t * 10_000, v) for t, v in enumerate([1.0, 5.0, 2.0, 8.0, 3.0, 4.0, 9.0])))
    grid = Grid(30_000, 60_000, 10_000)
    for f in sorted(m.ROLLED - ranges.NAMED):
        one = values(m.over_time(s, ranges.FUNCTIONS[f], grid, 30_000))  # from the whole windows
        other = values(m.rolled(s, [f], grid, 30_000).withColumnRenamed(f, "value").where("value is not null"))
        assert [x[:2] for x in one] == [x[:2] for x in other]
        assert [x[2] for x in one] == pytest.approx([x[2] for x in other])


def test_delta_counters_leave_the_first_increase_out(spark):
    s = frame(spark, *(({}, t, v) for t, v in ((-61_000, 90.0), (-29_000, 10.0), (0, 40.0))))
    found = values(m.delta_rate(s, Grid.instant(1_000), 60_000))
    assert found[0][2] == pytest.approx(40 * (29 + 30 + 1) / 29 / 60)
    assert values(m.delta_irate(s, Grid.instant(1_000), 60_000))[0][2] == pytest.approx(40 / 29)


def test_instant_selector_leaves_out_a_sample_as_old_as_the_lookback(spark):
    s = frame(spark, ({"a": "old"}, 0, 1.0), ({"a": "new"}, 1, 2.0))
    assert values(m.instant(s, Grid.instant(300_000))) == [((("a", "new"),), 300_000, 2.0)]


def test_nan_rules(spark):
    s = frame(spark, ({"a": "1"}, 0, math.nan), ({"a": "2"}, 0, 1.0))
    assert values(m.aggregate(s, "max")) == [((), 0, 1.0)]
    assert values(mt.with_scalar(s, "!=", 1.0)) != []
    assert [r.value for r in m.sort(s).collect()][0] == 1.0


def test_quantile_bounds(spark):
    s = frame(spark, ({"a": "1"}, 0, 1.0), ({"a": "2"}, 0, 3.0))
    assert values(m.quantile(s, 1.5))[0][2] == math.inf
    assert values(m.quantile(s, 0.5))[0][2] == 2.0
    assert values(m.over_time(s, ranges.quantile_over_time(-1), Grid.instant(0), 10))[0][2] == -math.inf


def test_many_to_many_fails(spark):
    left = frame(spark, ({"a": "1", "b": "1"}, 0, 1.0), ({"a": "1", "b": "2"}, 0, 1.0))
    with pytest.raises(Exception, match="duplicate series"):
        mt.binary(left, "+", left, on=["a"]).collect()


def test_duplicate_label_sets_fail(spark):
    s = frame(spark, ({"__name__": "x", "a": "1"}, 0, 1.0), ({"__name__": "y", "a": "1"}, 0, 1.0))
    with pytest.raises(Exception, match="same labelset"):
        m.over_time(s, "sum_over_time", Grid.instant(0), 10).collect()
    for found in (m.over_time(s, "deriv", Grid.instant(0), 10), m.rolled(s, ["count_over_time"], Grid.instant(0), 10), m.delta_rate(s, Grid.instant(0), 10)):
        with pytest.raises(Exception, match="same labelset"):
            found.collect()


def test_division_by_zero(spark):
    s = frame(spark, ({"a": "1"}, 0, 1.0), ({"a": "2"}, 0, 0.0))
    out = [x[2] for x in values(mt.with_scalar(s, "/", 0.0))]
    assert out[0] == math.inf and math.isnan(out[1])


def test_labels(spark):
    s = spark.createDataFrame([({"b": "2", "a": "1", "c": ""}, {"a": "1", "b": "2"})], "x map<string,string>, y map<string,string>")
    row = s.select(lb.key(F.col("x")).alias("x"), lb.key(F.col("y")).alias("y"), lb.label_replace(F.col("x"), "d", "$1-${n}", "b", "(?P<n>.)").alias("r"), lb.natural(F.lit("a10b")).alias("n")).first()
    assert row.x == row.y and row.r == {"a": "1", "b": "2", "d": "2-2"} and row.n > "a" + "0" * 31 + "9"


def test_whole_numbers_bounds_and_dates_of_odd_values(spark):
    odd = [math.nan, math.inf, -math.inf, 1e20, -2.5, 2.5]
    s = frame(spark, *(({"a": str(i)}, 0, v) for i, v in enumerate(odd)))
    got = lambda f: [x[2] for x in values(m.map_values(s, f))]
    same = lambda a, b: all(x == y or (math.isnan(x) and math.isnan(y)) for x, y in zip(a, b, strict=True))
    assert same(got(m.INSTANT["ceil"]), [*odd[:4], -2.0, 3.0]) and same(got(m.INSTANT["floor"]), [*odd[:4], -3.0, 2.0])
    assert same(got(m.INSTANT["round"]), [*odd[:4], -2.0, 3.0])
    assert got(lambda v: m.clamp(v, 3, 1)) == [] and same(got(lambda v: m.clamp(v, -1, 1)), [math.nan, 1, -1, 1, -1, 1])
    assert same(got(m.INSTANT["year"]), [math.nan] * 4 + [1969, 1970])


def test_count_values_text(spark):
    odd = {1.5e25: "15000000000000000000000000", 1.5e-7: "0.00000015", -1.25e10: "-12500000000", 12345678.5: "12345678.5", 1e7: "10000000", -2e-12: "-0.000000000002", 3.0: "3", 123456789.125: "123456789.125"}
    texts = frame(spark, *(({"a": t}, 0, v) for v, t in odd.items())).select(F.col("labels")["a"].alias("want"), m.number_text(F.col("value")).alias("got")).collect()
    assert [r.got for r in texts] == [r.want for r in texts]
    s = frame(spark, ({"a": "1"}, 0, 1e8), ({"a": "2"}, 0, 0.5), ({"a": "3"}, 0, 0.5))
    assert values(m.count_values(s, "v")) == [((("v", "0.5"),), 0, 2.0), ((("v", "100000000"),), 0, 1.0)]


def test_classic_quantile_adds_equal_bounds_and_forces_counts_up(spark):
    b = [({"le": le}, 0, v) for le, v in (("1", 4.0), ("1.0", 1.0), ("2", 3.0), ("+Inf", 10.0))]
    assert values(h.quantile(frame(spark, *b), 0.25)) == [((), 0, 0.5)]
    assert values(h.quantile(frame(spark, *b), 0.9)) == [((), 0, 2.0)]


def test_exponential_histograms_meet_at_the_coarser_scale(spark):
    df = spark.range(1).select(hg.added(F.array(*(hg.exponential(F.lit(3), F.lit(6.0), F.lit(s), F.lit(1), F.lit(o), F.array(F.lit(1), F.lit(1)), F.lit(0), F.array().cast("array<int>")) for s, o in ((1, 2), (0, 1))))).alias("x"))
    x = df.first().x
    assert (x["count"], x["scale"], x["zero_count"], x["positive"]) == (6.0, 0, 2.0, {1: 3.0, 2: 1.0})


def test_instant_functions_keep_the_sign_of_zero(spark, tmp_path):
    at = spark.sql("select 1L as event_id, timestamp'2024-01-02 11:00:00' as ts, 7L as user_id, 'view' as event_type, 0.0D as value, '{}' as props")
    at.unionByName(at.withColumns({"user_id": F.lit(8).cast("long"), "value": F.lit(177.5)})).write.parquet(f"{tmp_path}/events.parquet")
    rows = {r.user: r for r in metric_queries.QUERIES["instant_functions"](spark, str(tmp_path)).collect()}
    assert math.copysign(1, rows["7"].f_negate) == -1 and math.copysign(1, rows["7"].f_abs) == 1 and math.copysign(1, rows["7"].f_sin) == 1
    assert rows["8"].f_cos == 0 and math.copysign(1, rows["8"].f_cos) == -1


def test_exponential_changes_evaluates_each_histogram_once(spark):
    plan = histogram_queries.QUERIES["exponential_changes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1


def test_sorting_does_not_work_out_its_keys_for_each_comparison(spark):
    vector = spark.createDataFrame([({"user": u}, 0, v) for u, v in (("10", 1.0), ("9", 2.0), ("a", float("nan")))], "labels map<string,string>, ts long, value double")
    by_label, by_value = m.sort_by_label(vector, ["user"]), m.sort(vector, True)
    for ordered in (by_label, by_value):
        line = next(x for x in ordered._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Sort [" in x)
        assert "(" not in line and ordered.columns == ["labels", "ts", "value"]
    assert [r.labels["user"] for r in by_label.collect()] == ["9", "10", "a"] and [r.labels["user"] for r in by_value.collect()] == ["9", "10", "a"]
