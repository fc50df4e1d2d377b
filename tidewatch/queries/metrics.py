"""Metric queries over `events` and `orders`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ieee, labels as lb, ranges
from ..operators import matching as mt, metrics as m
from ..plans.grid import Grid
from ..sources import adapters as ad
from ..sources.store import Store

HOUR = 3_600_000
START, END = 1_704_153_600_000, 1_706_659_200_000  # 2024-01-02 to 2024-01-31, past the last event
DAYS = Grid(START, END, 12 * HOUR)
RANGE = 24 * HOUR
INSTANT = Grid.instant(END)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def flat(vector: DataFrame, *names: str, digits: int = 8) -> DataFrame:
    """Labels as columns, the value rounded."""
    return vector.select(*(lb.label(F.col("labels"), n).alias(n) for n in names), "ts", F.round("value", digits).alias("value"))


def _by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.event_samples(spark, sf_dir, event_type="event_type")


_SERIES = "s as (select event_type, (epoch_us(ts) // 1000) as t, max(value) as v from events group by 1, 2)"


def _grid(grid: Grid) -> str:
    return f"g as (select {grid.start} + i * {grid.step} as p from generate_series(0, {grid.points - 1}) as x(i))"


def _windows(grid: Grid = DAYS, range_ms: int = RANGE, offset: int = 0) -> str:
    return f"""with {_SERIES}, {_grid(grid)},
w as (select event_type, p, t, v, row_number() over o as i, row_number() over (partition by event_type, p order by t desc) as j,
             lag(v) over o as pv, lag(t) over o as pt
      from s join g on t > p - {offset} - {range_ms} and t <= p - {offset} window o as (partition by event_type, p order by t)),
a as (select event_type, p, count(*) as n, min(t) as ft, max(t) as lt, arg_min(v, t) as fv, arg_max(v, t) as lv, sum(v) as total, avg(v) as mean,
             sum(case when v < pv then pv else 0 end) as lost, sum(case when v < pv then 1.0::double else 0.0::double end) as resets, sum(case when v <> pv then 1.0::double else 0.0::double end) as changes,
             min(v) as least, max(v) as most, stddev_pop(v) as sd, var_pop(v) as var, median(v) as med,
             max(case when j = 1 then pv end) as lpv, max(case when j = 1 then pt end) as lpt,
             regr_slope(v, t / 1000.0) as slope, regr_slope(v, (t - p) / 1000.0) as slope_end, regr_intercept(v, (t - p) / 1000.0) as at_end
      from w group by 1, 2)
"""


def _extrapolated(change: str, counter: bool, per_second: bool, range_ms: int = RANGE, offset: int = 0) -> str:
    start = f"case when ft - (p - {offset} - {range_ms}) >= 1.1 * gap then gap / 2 else ft - (p - {offset} - {range_ms}) end"
    if counter:
        start = f"least({start}, case when change > 0 and fv >= 0 then c * (fv / change) else {start} end)"
    stop = f"case when p - {offset} - lt >= 1.1 * gap then gap / 2 else p - {offset} - lt end"
    value = f"change * ((c + {start} + {stop}) / c)" + (f" / {range_ms / 1000.0}" if per_second else "")
    return f", b as (select *, {change} as change, (lt - ft)::double as c, (lt - ft)::double / (n - 1) as gap from a where n >= 2 and lt > ft) select event_type, p as ts, round({value}, 8) as value from b"


_RANGE_SQL = {
    "rate": _extrapolated("lv - fv + lost", True, True),
    "increase": _extrapolated("lv - fv + lost", True, False),
    "delta": _extrapolated("lv - fv", False, False),
    "irate": "(case when lv < lpv then lv else lv - lpv end) / ((lt - lpt) / 1000.0)",
    "idelta": "lv - lpv",
    "deriv": "slope",
    "changes": "changes", "resets": "resets", "sum_over_time": "total", "avg_over_time": "mean", "min_over_time": "least", "max_over_time": "most",
    "count_over_time": "n::double", "first_over_time": "fv", "last_over_time": "lv", "stddev_over_time": "sd", "stdvar_over_time": "var",
    "present_over_time": "1.0::double", "ts_of_first_over_time": "ft / 1000.0", "ts_of_last_over_time": "lt / 1000.0", "log_rate": f"n / {RANGE / 1000.0}",
}


def _range_sql(name: str) -> str:
    body = _RANGE_SQL[name]
    if body.startswith(","):
        return _windows() + body
    guard = " where n >= 2" if name in ("irate", "idelta", "deriv") else ""
    return _windows() + f"select event_type, p as ts, round({body}, 8) as value from a{guard}"


for _name in _RANGE_SQL:
    query(f"range_{_name}", _range_sql(_name))(lambda spark, sf, f=_name: flat(m.over_time(_by_type(spark, sf), f, DAYS, RANGE), "event_type"))
for _top, _name in ((True, "max"), (False, "min")):
    query(f"range_ts_of_{_name}_over_time", _windows() + f"select w.event_type, w.p as ts, round(max(t) / 1000.0, 8) as value from w join a using (event_type, p) where v = {'most' if _top else 'least'} group by 1, 2")(
        lambda spark, sf, f=f"ts_of_{_name}_over_time": flat(m.over_time(_by_type(spark, sf), f, DAYS, RANGE), "event_type")
    )
query("range_quantile_over_time", _windows() + "select event_type, p as ts, round(quantile_cont(v, 0.9), 8) as value from w group by 1, 2")(
    lambda spark, sf: flat(m.over_time(_by_type(spark, sf), ranges.quantile_over_time(0.9), DAYS, RANGE), "event_type")
)
query("range_mad_over_time", _windows() + "select w.event_type, w.p as ts, round(median(abs(v - med)), 8) as value from w join a using (event_type, p) group by 1, 2")(
    lambda spark, sf: flat(m.over_time(_by_type(spark, sf), "mad_over_time", DAYS, RANGE), "event_type")
)
query("range_predict_linear", _windows() + "select event_type, p as ts, round(at_end + slope_end * 3600, 4) as value from a where n >= 2")(
    lambda spark, sf: flat(m.over_time(_by_type(spark, sf), ranges.predict_linear(3600), DAYS, RANGE), "event_type", digits=4)
)
query(
    "range_double_exponential_smoothing",
    _windows().replace("with s as", "with recursive s as")
    + """, h as (select event_type, p, 2::bigint as i, 0.5 * v + 0.5 * (pv + (v - pv)) as level, pv as before, v - pv as slope from w where i = 2
union all select w.event_type, w.p, w.i, 0.5 * w.v + 0.5 * (h.level + (0.3 * (h.level - h.before) + 0.7 * h.slope)), h.level, 0.3 * (h.level - h.before) + 0.7 * h.slope
from h join w on w.event_type = h.event_type and w.p = h.p and w.i = h.i + 1)
select event_type, p as ts, round(arg_max(level, i), 4) as value from h group by 1, 2""",
)(lambda spark, sf: flat(m.over_time(_by_type(spark, sf), ranges.double_exponential_smoothing(0.5, 0.3), DAYS, RANGE), "event_type", digits=4))
query("range_offset", _windows(offset=6 * HOUR) + _extrapolated("lv - fv + lost", True, True, offset=6 * HOUR))(
    lambda spark, sf: flat(m.over_time(_by_type(spark, sf), "rate", DAYS, RANGE, 6 * HOUR), "event_type")
)
query("range_at_pinned", _windows(INSTANT).replace(_grid(INSTANT), _grid(INSTANT)) + f", r as ({_extrapolated('lv - fv + lost', True, False)[2:].replace('b as (', 'with b as (', 1)}) select event_type, {DAYS.start} + i * {DAYS.step} as ts, value from r cross join generate_series(0, {DAYS.points - 1}) as x(i)")(
    lambda spark, sf: flat(m.over_time(_by_type(spark, sf), "increase", DAYS, RANGE, at=END), "event_type")
)


@query("rolled_range_functions", _windows(Grid(START, END, HOUR), 24 * HOUR)
       + """select event_type, p as ts, n as n, round(total, 6) as total, least as least, most as most, resets as resets, changes as changes from a""")
def rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["count_over_time", "sum_over_time", "min_over_time", "max_over_time", "resets", "changes"]
    found = m.rolled(_by_type(spark, sf_dir), names, Grid(START, END, HOUR), 24 * HOUR)
    return found.select(
        lb.label(F.col("labels"), "event_type").alias("event_type"), "ts", F.col("count_over_time").cast("long").alias("n"), F.round("sum_over_time", 6).alias("total"),
        F.col("min_over_time").alias("least"), F.col("max_over_time").alias("most"), "resets", "changes",
    )


@query("rolled_rate", _windows(Grid(START, END, HOUR), 24 * HOUR) + _extrapolated("lv - fv + lost", True, True, 24 * HOUR))
def rolled_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = m.rolled(_by_type(spark, sf_dir), ["rate"], Grid(START, END, HOUR), 24 * HOUR)
    return flat(found.withColumnRenamed("rate", "value"), "event_type").where("value is not null")


@query("sum_by_type_of_counts", f"with {_grid(DAYS)} select event_type, p as ts, count(*)::double as value from events join g on (epoch_us(ts) // 1000) > p - {RANGE} and (epoch_us(ts) // 1000) <= p group by 1, 2")
def sum_by_type_of_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: events of each type in the day before each half-day."""
    counts = m.rolled(ad.event_samples(spark, sf_dir, event_type="event_type", user="user_id"), ["count_over_time"], DAYS, RANGE)
    return flat(m.aggregate(counts.withColumnRenamed("count_over_time", "value"), "sum", by=["event_type"]), "event_type")


def _subquery_points(grid: Grid, range_ms: int, step: int) -> str:
    inner = grid.inner(range_ms, step)
    return f"i as (select {inner.start} + k * {inner.step} as q from generate_series(0, {inner.points - 1}) as y(k))"


query("subquery_max_of_increase", f"""with {_SERIES}, {_grid(DAYS)}, {_subquery_points(DAYS, RANGE, 6 * HOUR)},
c as (select event_type, q, sum(v) as v from s join i on t > q - {6 * HOUR} and t <= q group by 1, 2)
select event_type, p as ts, round(max(v), 8) as value from c join g on q > p - {RANGE} and q <= p group by 1, 2""")(
    lambda spark, sf: flat(m.subquery(lambda inner: m.over_time(_by_type(spark, sf), "sum_over_time", inner, 6 * HOUR), "max_over_time", DAYS, RANGE, 6 * HOUR), "event_type")
)

_VECTOR = f"""with {_grid(DAYS)}, u as (select event_type, user_id::varchar as "user", p, count(*) as n, arg_max(value, (epoch_us(ts) // 1000)) as v, max((epoch_us(ts) // 1000)) as t
from events join g on (epoch_us(ts) // 1000) > p - {RANGE} and (epoch_us(ts) // 1000) <= p group by 1, 2, 3)
"""


def _vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest sample of each type and user in the last day, at each point."""
    return m.instant(ad.event_samples(spark, sf_dir), DAYS, RANGE)


query("instant_selector", _VECTOR.replace("(epoch_us(ts) // 1000) > p -", "(epoch_us(ts) // 1000) > p -") + 'select event_type, "user", p as ts, round(v, 8) as value from u')(lambda spark, sf: flat(_vector(spark, sf), "event_type", "user"))
query("matchers", _VECTOR + """select event_type, "user", p as ts, round(v, 8) as value from u where event_type <> 'view' and regexp_full_match("user", '1.*') and not regexp_full_match("user", '.*5')""")(
    lambda spark, sf: flat(m.select(_vector(spark, sf), ("event_type", "!=", "view"), ("user", "=~", "1.*"), ("user", "!~", ".*5"), ("missing", "=", "")), "event_type", "user")
)
_AGGREGATE_SQL = {"sum": "sum(v)", "avg": "avg(v)", "min": "min(v)", "max": "max(v)", "count": "count(*)::double", "group": "1.0::double", "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)"}
for _name, _sql in _AGGREGATE_SQL.items():
    query(f"aggregate_{_name}", _VECTOR + f"select event_type, p as ts, round({_sql}, 8) as value from u group by 1, 2")(lambda spark, sf, f=_name: flat(m.aggregate(_vector(spark, sf), f, by=["event_type"]), "event_type"))
query("aggregate_without", _VECTOR + 'select "user", p as ts, round(sum(v), 8) as value from u group by 1, 2')(lambda spark, sf: flat(m.aggregate(_vector(spark, sf), "sum", without=["event_type"]), "user"))
query("aggregate_all", _VECTOR + "select p as ts, round(avg(v), 8) as value from u group by 1")(lambda spark, sf: flat(m.aggregate(_vector(spark, sf), "avg")))
query("aggregate_quantile", _VECTOR + "select event_type, p as ts, round(quantile_cont(v, 0.75), 8) as value from u group by 1, 2")(lambda spark, sf: flat(m.quantile(_vector(spark, sf), 0.75, by=["event_type"]), "event_type"))
for _name, _top in (("topk", True), ("bottomk", False)):
    query(_name, _VECTOR + f"""select event_type, "user", p as ts, round(v, 8) as value from u
qualify row_number() over (partition by event_type, p order by v {'desc' if _top else 'asc'}, '{{"event_type":"' || event_type || '","user":"' || "user" || '"}}') <= 3""")(lambda spark, sf, t=_top: flat(m.ranked(m.map_values(_vector(spark, sf), lambda v: v + 0.0), 3, t, by=["event_type"]), "event_type", "user"))
_KEY = """'{"__name__":"event_value","event_type":"' || event_type || '","user":"' || "user" || '"}'"""
query("limitk", _VECTOR + f'select event_type, "user", p as ts, round(v, 8) as value from u qualify row_number() over (partition by event_type, p order by {_KEY}) <= 2')(lambda spark, sf: flat(m.limitk(_vector(spark, sf), 2, by=["event_type"]), "event_type", "user"))
_PLACE = f"('0x' || substr(md5({_KEY}), 1, 8))::bigint / {float(1 << 32)}::double"
for _name, _ratio, _sql in (("limit_ratio", 0.3, "< 0.3"), ("limit_ratio_rest", -0.7, ">= 0.3")):
    query(_name, _VECTOR + f'select event_type, "user", p as ts, round(v, 8) as value from u where {_PLACE} {_sql}')(lambda spark, sf, r=_ratio: flat(m.limit_ratio(_vector(spark, sf), r), "event_type", "user"))
query("count_values", _VECTOR + """select event_type, cast(floor(v / 100) as bigint)::varchar as hundreds, p as ts, count(*)::double as value from u group by 1, 2, 3""")(
    lambda spark, sf: flat(m.count_values(m.map_values(_vector(spark, sf), lambda v: F.floor(v / 100).cast("double")), "hundreds", by=["event_type"]), "event_type", "hundreds")
)
_INSTANT_SQL = {
    "abs": "abs(v - 50)", "ceil": "ceil(v - 50) + 0.0::double", "floor": "floor(v - 50)", "sqrt": "sqrt(v)", "exp": "exp(v / 100)", "ln": "ln(v)", "log2": "log2(v)", "log10": "log10(v)", "sgn": "sign(v - 50)::double",
    "sin": "sin(v)", "cos": "cos(v)", "tan": "tan(v / 1000)", "asin": "asin(v / 1000)", "acos": "acos(v / 1000)", "atan": "atan(v)", "sinh": "sinh(v / 100)", "cosh": "cosh(v / 100)", "tanh": "tanh(v / 100)",
    "asinh": "asinh(v)", "acosh": "acosh(v + 1)", "atanh": "atanh(v / 1000)", "deg": "degrees(v)", "rad": "radians(v)", "negate": "-v", "round": "floor(v + 0.5)",
}
_SHIFT = {"abs": lambda v: v - 50, "ceil": lambda v: v - 50, "floor": lambda v: v - 50, "sgn": lambda v: v - 50, "exp": lambda v: v / 100, "tan": lambda v: v / 1000, "asin": lambda v: v / 1000, "acos": lambda v: v / 1000, "sinh": lambda v: v / 100, "cosh": lambda v: v / 100, "tanh": lambda v: v / 100, "acosh": lambda v: v + 1, "atanh": lambda v: v / 1000}


@query("instant_functions", _VECTOR + 'select event_type, "user", p as ts, ' + ", ".join(f"round({sql}, 4) as f_{name}" for name, sql in _INSTANT_SQL.items()) + " from u")
def instant_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return _vector(spark, sf_dir).select(*(lb.label(F.col("labels"), n).alias(n) for n in ("event_type", "user")), "ts", *(ieee.rounded(m.INSTANT[n](_SHIFT.get(n, lambda x: x)(v)), 4).alias(f"f_{n}") for n in _INSTANT_SQL))


_DATES = {"year": "year(d)", "month": "month(d)", "day_of_month": "day(d)", "day_of_week": "dayofweek(d)", "day_of_year": "dayofyear(d)", "days_in_month": "day(last_day(d))", "hour": "hour(d)", "minute": "minute(d)"}


@query("date_functions", f"with {_grid(Grid(START, END, 7 * HOUR))}, x as (select p, make_timestamp(p * 1000) as d from g) select p as ts, " + ", ".join(f"({sql})::double as {name}" for name, sql in _DATES.items()) + " from x")
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = m.constant(spark, Grid(START, END, 7 * HOUR), m.time_())
    return now.select("ts", *(m.INSTANT[n](F.col("value")).alias(n) for n in _DATES))


query("clamp", _VECTOR + 'select event_type, "user", p as ts, round(greatest(20, least(100, v)), 8) as value from u')(lambda spark, sf: flat(m.map_values(_vector(spark, sf), lambda v: m.clamp(v, 20, 100)), "event_type", "user"))
def _exemplar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of events with each day's events as exemplars."""
    e = F.struct(ad.epoch_ms("ts").alias("ts"), "value", ad.labelled(user="user_id").alias("labels"))
    days = ad.table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.collect_list(e).alias("exemplars"))
    return days.select(ad.labelled("event_value", event_type="event_type").alias("labels"), "exemplars")


def _odd_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    odd = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(x).alias("v")) for k, x in (("nan", ieee.NAN), ("inf", ieee.INF), ("big", 1e20), ("neg", -2.5), ("pos", 2.5)))))
    rows = ad.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("nation"), odd.alias("x")).select("nation", "x.k", "x.v")
    shown = lambda x: F.when(F.isnan(x), -777.0).when(F.abs(x) == ieee.INF, 777.0).otherwise(x)
    found = {"up": m.INSTANT["ceil"](v), "down": m.INSTANT["floor"](v), "near": m.INSTANT["round"](v), "held": m.clamp(v, -1, 1), "year": m.INSTANT["year"](v)}
    return rows.select("nation", "k", *(shown(x).alias(name) for name, x in found.items()))


query("timestamp_of", _VECTOR + 'select event_type, "user", p as ts, round(t / 1000.0, 3) as value from u')(
    lambda spark, sf: flat(m.timestamps(ad.event_samples(spark, sf), DAYS, RANGE), "event_type", "user", digits=3)
)
query("query_context", f"with {_grid(DAYS)} select p as ts, {DAYS.range_seconds}::double + {DAYS.step_seconds}::double as value from g")(lambda spark, sf: flat(m.constant(spark, DAYS, DAYS.range_seconds + DAYS.step_seconds)))
query("exemplars", f"""select event_type, user_id::varchar as "user", epoch_us(ts) // 1000 as ts, round(value, 8) as value from events where event_type = 'purchase' and epoch_us(ts) // 1000 between {START} and {START + 24 * HOUR}""")(
    lambda spark, sf: flat(m.exemplars(_exemplar_rows(spark, sf), START, START + 24 * HOUR, ("event_type", "=", "purchase")).withColumn("labels", lb.merged(F.col("labels"), F.col("exemplar_labels"))), "event_type", "user")
)
_ODD = {"nan": "'nan'::double", "inf": "'inf'::double", "big": "1e20", "neg": "-2.5", "pos": "2.5"}
query("odd_numbers", "with x as (select n_nationkey::varchar as nation, k, v + 0.0 * n_nationkey as v from nation cross join (values " + ", ".join(f"('{k}', {v}::double)" for k, v in _ODD.items()) + """) as o(k, v))
select nation, k, """ + ", ".join(f"(case when isnan({e}) then -777 when isinf({e}) then 777 else {e} end)::double as {n}" for n, e in {
    "up": "ceil(v)::double", "down": "floor(v)::double", "near": "(case when isinf(v) then v else floor(v + 0.5)::double end)", "held": "(case when isnan(v) then v else least(greatest(v, -1.0), 1.0)::double end)",
    "year": "(case when v = 2.5 then 1970.0::double when v = -2.5 then 1969.0::double else 'nan'::double end)"}.items()) + " from x")(
    lambda spark, sf: _odd_numbers(spark, sf)
)
query("delta_rate", f"""with s as (select event_type, epoch_us(ts) // 1000 as t, sum(value) as v from events group by 1, 2), l as (select *, sum(v) over (partition by event_type order by t) as level from s), {_grid(DAYS)},
a as (select event_type, p, count(*) as n, min(t) as ft, max(t) as lt, arg_min(level, t) as fv, sum(v) - arg_min(v, t) as change, (max(t) - min(t))::double as c, (max(t) - min(t))::double / nullif(count(*) - 1, 0) as gap
      from l join g on t > p - {RANGE} and t <= p group by 1, 2 having count(*) >= 2 and max(t) > min(t)),
e as (select *, case when ft - (p - {RANGE}) >= 1.1 * gap then gap / 2 else ft - (p - {RANGE}) end as a, case when p - lt >= 1.1 * gap then gap / 2 else p - lt end as z from a)
select event_type, p as ts, round(change * ((c + least(a, case when change > 0 then c * (fv / change) else a end) + z) / c) / {RANGE / 1000.0}, 6) as value from e""")(
    lambda spark, sf: flat(m.delta_rate(ad.increments(spark, sf), DAYS, RANGE), "event_type", digits=6)
)
query("delta_irate", f"""with s as (select event_type, epoch_us(ts) // 1000 as t, sum(value) as v from events group by 1, 2), {_grid(DAYS)},
w as (select event_type, p, t, v, lag(t) over (partition by event_type, p order by t) as pt, row_number() over (partition by event_type, p order by t desc) as j from s join g on t > p - {RANGE} and t <= p)
select event_type, p as ts, round(v / ((t - pt) / 1000.0), 6) as value from w where j = 1 and pt is not null""")(
    lambda spark, sf: flat(m.delta_irate(ad.increments(spark, sf), DAYS, RANGE), "event_type", digits=6)
)
query("scalar_of_one", _VECTOR + "select p as ts, round(sum(v), 8) as value from u group by 1")(lambda spark, sf: m.scalar(m.aggregate(_vector(spark, sf), "sum"), DAYS).select("ts", F.round("value", 8).alias("value")))
query("absent", f"with {_grid(DAYS)} select 'nothing' as job, p as ts, 1.0::double as value from g")(lambda spark, sf: flat(m.absent(m.select(_vector(spark, sf), ("job", "=", "nothing")), DAYS, {"job": "nothing"}), "job"))
query("scalar_of_many", f"with {_grid(DAYS)} select p as ts, true as is_nan from g")(lambda spark, sf: m.scalar(_vector(spark, sf), DAYS).select("ts", F.isnan("value").alias("is_nan")))
query("absent_some", f"""with {_grid(Grid(START, END, HOUR))} select '7' as "user", p as ts, 1.0::double as value from g
where not exists (select 1 from events where user_id = 7 and (epoch_us(ts) // 1000) > p - {3 * HOUR} and (epoch_us(ts) // 1000) <= p)""")(
    lambda spark, sf: flat(m.absent(m.instant(m.select(ad.event_samples(spark, sf), ("user", "=", "7")), Grid(START, END, HOUR), 3 * HOUR), Grid(START, END, HOUR), {"user": "7"}), "user")
)
query("absent_over_time", f"""with {_grid(Grid(START, END, HOUR))} select p as ts, 1.0::double as value from g
where not exists (select 1 from events where user_id = 7 and (epoch_us(ts) // 1000) > p - {6 * HOUR} and (epoch_us(ts) // 1000) <= p)""")(
    lambda spark, sf: flat(m.absent_over_time(m.select(ad.event_samples(spark, sf), ("user", "=", "7")), Grid(START, END, HOUR), 6 * HOUR))
)
query("label_replace", _VECTOR + """select event_type, "user", regexp_extract("user", '^(.)(.*)$', 1) || '-' || event_type as tag, p as ts, round(v, 8) as value from u""")(
    lambda spark, sf: flat(_vector(spark, sf).withColumn("labels", lb.label_join(lb.label_replace(F.col("labels"), "head", "$1", "user", "(.)(.*)"), "tag", "-", ["head", "event_type"])), "event_type", "user", "tag")
)
query("sort_by_value", _VECTOR + 'select event_type, "user", p as ts, round(v, 8) as value from u order by v desc')(lambda spark, sf: flat(m.sort(_vector(spark, sf), True), "event_type", "user"))
query("sort_by_label", _VECTOR + 'select event_type, "user", p as ts, round(v, 8) as value from u order by "user"::int')(lambda spark, sf: flat(m.sort_by_label(_vector(spark, sf), ["user"]), "event_type", "user"))

# Vector matching: counts against newest values.
_COUNTS = _VECTOR + ", e as (select event_type, p, sum(v) as total from u group by 1, 2)\n"


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.over_time(ad.event_samples(spark, sf_dir), "count_over_time", DAYS, RANGE)


_OPS = {"add": ("+", "v + n"), "sub": ("-", "v - n"), "mul": ("*", "v * n"), "div": ("/", "v / n"), "mod": ("%", "fmod(v, n)"), "pow": ("^", "pow(v, n)"), "atan2": ("atan2", "atan2(v, n)")}
for _name, (_op, _sql) in _OPS.items():
    query(f"binary_{_name}", _VECTOR + f'select event_type, "user", p as ts, round({_sql}, 4) as value from u')(lambda spark, sf, op=_op: flat(mt.binary(_vector(spark, sf), op, _counts(spark, sf)), "event_type", "user", digits=4))
for _name, _op, _sql in (("eq", "==", "v = n"), ("ne", "!=", "v <> n"), ("gt", ">", "v > n"), ("lt", "<", "v < n"), ("ge", ">=", "v >= n"), ("le", "<=", "v <= n")):
    query(f"compare_{_name}", _VECTOR + f'select event_type, "user", p as ts, round(v, 8) as value from u where {_sql}')(lambda spark, sf, op=_op: flat(mt.binary(_vector(spark, sf), op, _counts(spark, sf), ignoring=["__name__"]), "event_type", "user"))
query("compare_bool", _VECTOR + 'select event_type, "user", p as ts, (v > n)::int::double as value from u')(lambda spark, sf: flat(mt.binary(_vector(spark, sf), ">", _counts(spark, sf), as_bool=True), "event_type", "user"))
query("match_on_group_left", _COUNTS + 'select event_type, "user", p as ts, round(v / total, 8) as value from u join e using (event_type, p)')(
    lambda spark, sf: flat(mt.binary(_vector(spark, sf), "/", m.aggregate(_vector(spark, sf), "sum", by=["event_type"]), on=["event_type"], group="left"), "event_type", "user")
)
query("match_ignoring_group_right", _COUNTS + 'select event_type, "user", p as ts, round(total - v, 8) as value from u join e using (event_type, p)')(
    lambda spark, sf: flat(mt.binary(m.aggregate(_vector(spark, sf), "sum", by=["event_type"]), "-", _vector(spark, sf), ignoring=["user"], group="right"), "event_type", "user")
)
query("match_include", _COUNTS + 'select event_type, "user", event_type || \'!\' as mark, p as ts, round(v * total, 4) as value from u join e using (event_type, p)')(
    lambda spark, sf: flat(
        mt.binary(
            _vector(spark, sf), "*",
            m.aggregate(_vector(spark, sf), "sum", by=["event_type"]).withColumn("labels", lb.label_replace(F.col("labels"), "mark", "$1!", "event_type", "(.*)")),
            on=["event_type"], group="left", include=["mark"],
        ),
        "event_type", "user", "mark", digits=4,
    )
)
query("scalar_arithmetic", _VECTOR + 'select event_type, "user", p as ts, round(100 - v, 8) as value from u')(lambda spark, sf: flat(mt.with_scalar(_vector(spark, sf), "-", 100, swapped=True), "event_type", "user"))
_BIG, _SMALL = "v > 20", "v < 60"


def _arms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = _vector(spark, sf_dir)
    return v.where("value > 20"), v.where("value < 60")


query("set_and", _VECTOR + f'select event_type, "user", p as ts, round(v, 8) as value from u where {_BIG} and {_SMALL}')(lambda spark, sf: flat(mt.and_(*_arms(spark, sf)), "event_type", "user"))
query("set_unless", _VECTOR + f'select event_type, "user", p as ts, round(v, 8) as value from u where {_BIG} and not {_SMALL}')(lambda spark, sf: flat(mt.unless(*_arms(spark, sf)), "event_type", "user"))
query("set_or", _VECTOR + 'select event_type, "user", p as ts, round(v, 8) as value from u')(lambda spark, sf: flat(mt.or_(*_arms(spark, sf)), "event_type", "user"))
query("set_or_all", _VECTOR + 'select event_type, "user", p as ts, round(case when v > 20 then v else n end, 8) as value from u')(lambda spark, sf: flat(mt.or_all([_arms(spark, sf)[0], _counts(spark, sf)]), "event_type", "user"))
query("set_and_all", _VECTOR + f'select event_type, "user", p as ts, round(v, 8) as value from u where {_BIG} and {_SMALL}')(lambda spark, sf: flat(mt.and_all([*_arms(spark, sf), _counts(spark, sf)]), "event_type", "user"))
query("info_labels", """select c_custkey::varchar as instance, c_mktsegment as segment, coalesce(n_name, '') as nation, 0::bigint as ts, round(c_acctbal, 8) as value from customer left join nation on c_nationkey = n_nationkey""")(
    lambda spark, sf: flat(
        mt.info(
            ad.table(spark, sf, "customer").select(ad.labelled("balance", instance="c_custkey", job="c_nationkey", segment="c_mktsegment").alias("labels"), F.lit(0).cast("long").alias("ts"), F.col("c_acctbal").alias("value")),
            ad.table(spark, sf, "nation").select(ad.labelled("target_info", job="n_nationkey", nation="n_name").alias("labels"), F.lit(0).cast("long").alias("ts"), F.lit(1.0).alias("value")),
            identity=["job"],
        ),
        "instance", "segment", "nation",
    )
)


# Tables in the layout of collectors, made of the example tables.
def _tables(spark: SparkSession, sf_dir: str) -> Store:
    no_map = F.create_map().cast("map<string,string>")
    events = ad.table(spark, sf_dir, "events").select(
        F.lit("event.value").alias("MetricName"), F.create_map(F.lit("event.type"), F.col("event_type")).alias("Attributes"), F.col("ts").cast("timestamp").alias("When"), F.col("value").alias("Value"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("event.type"), F.lit("hidden")).alias("ResourceAttributes"), F.lit("shop").alias("ServiceName"), F.lit(2).alias("AggregationTemporality"),
    )
    items = ad.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("Count"), F.sum("l_quantity").alias("Sum"), *(F.count_if(F.col("l_quantity").between(a, b)).alias(f"c{i}") for i, (a, b) in enumerate(((0, 10), (11, 25), (26, 1000))))
    )
    histogram = items.select(
        F.lit("quantity").alias("MetricName"), F.create_map(F.lit("flag"), "l_returnflag").alias("Attributes"), F.lit(0).cast("timestamp").alias("When"), no_map.alias("ResourceAttributes"), F.lit("").alias("ServiceName"),
        "Count", "Sum", F.array(F.lit(10.0), F.lit(25.0)).alias("ExplicitBounds"), F.array("c0", "c1", "c2").alias("BucketCounts"),
    )
    empty = histogram.where("false").select(*histogram.columns, *(F.lit(0).alias(c) for c in ("Scale", "ZeroCount", "PositiveOffset", "NegativeOffset")), *(F.array().cast("array<bigint>").alias(c) for c in ("PositiveBucketCounts", "NegativeBucketCounts")))
    found = {"gauges": events.where("false"), "otel_metrics_sum": events, "otel_metrics_histogram": histogram, "otel_metrics_exponential_histogram": empty}
    return Store(found.__getitem__, tables={"gauge": "gauges"}, columns={"time": "When"})


query("store_samples", """select event_type, user_id::varchar as "user", 'shop' as service_name, epoch_us(ts) // 1000 as ts, round(value, 8) as value from events""")(
    lambda spark, sf: flat(_tables(spark, sf).samples("event_value"), "event_type", "user", "service_name")
)
_COMPANIONS = "h as (select l_returnflag as flag, count(*)::double as n, sum(l_quantity)::double as total, count(*) filter (where l_quantity <= 10)::double as a, count(*) filter (where l_quantity <= 25)::double as b from lineitem group by 1)"
query("store_companions", f"with {_COMPANIONS} select 'quantity_count' as __name__, flag, '' as le, 0::bigint as ts, n as value from h union all select 'quantity_sum', flag, '', 0, total from h union all select 'quantity_bucket', flag, '10', 0, a from h union all select 'quantity_bucket', flag, '25', 0, b from h union all select 'quantity_bucket', flag, '+Inf', 0, n from h")(
    lambda spark, sf: flat(_tables(spark, sf).samples(pattern="quantity_.*"), "__name__", "flag", "le")
)
query("store_catalogue", "select 'event_value' as metric, 'counter' as kind union all select 'quantity', 'histogram'")(lambda spark, sf: _tables(spark, sf).catalogue())
