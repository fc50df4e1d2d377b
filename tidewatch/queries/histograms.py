"""Histogram queries over `lineitem` and `orders`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import histograms as hg, labels as lb
from ..operators import histograms as h, matching as mt, metrics as m
from ..plans.grid import Grid
from ..sources import adapters as ad
from .metrics import flat

QUERIES: dict = {}
SQL: dict[str, str] = {}
BOUNDS = [5.0, 10.0, 20.0, 30.0, 45.0]


def classic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of line items by flag and status as classic histograms: rows (labels, ts, bounds, counts)."""
    items = ad.table(spark, sf_dir, "lineitem").select(ad.labelled("quantity", flag="l_returnflag", status="l_linestatus").alias("labels"), "l_quantity")
    place = F.size(F.filter(F.array(*map(F.lit, BOUNDS)), lambda b: b < F.col("l_quantity")))
    counts = items.groupBy("labels").agg(*(F.sum((place == i).cast("double")).alias(f"c{i}") for i in range(len(BOUNDS) + 1)))
    return counts.select("labels", F.lit(0).cast("long").alias("ts"), F.array(*map(F.lit, BOUNDS)).alias("bounds"), F.array(*(f"c{i}" for i in range(len(BOUNDS) + 1))).alias("counts"))


_CLASSIC = "b as (select l_returnflag as flag, l_linestatus as status, le, count(*) filter (where l_quantity <= le)::double as n from lineitem cross join (values " + ", ".join(f"({b}::double)" for b in BOUNDS) + ", ('inf'::double)) as x(le) group by 1, 2, 3)"


def _quantile_sql(phi: float, keys: str, source: str = "b") -> str:
    return f"""r as (select *, coalesce(lag(n) over o, 0) as below, coalesce(lag(le) over o, 0) as low, max(n) over (partition by {keys}) * {phi}::double as rank,
  max(case when isfinite(le) then le end) over (partition by {keys}) as top from {source} window o as (partition by {keys} order by le)),
f as (select *, row_number() over (partition by {keys} order by le) as i from r where n >= rank)
select {keys}, 0::bigint as ts, round(case when isinf(le) then top else low + (le - low) * (rank - below) / (n - below) end, 8) as value from f where i = 1"""


QUERIES["histogram_buckets"] = lambda spark, sf: flat(h.bucket_series(classic(spark, sf)), "flag", "status", "le")
SQL["histogram_buckets"] = f"with {_CLASSIC} select flag, status, case when isinf(le) then '+Inf' else (le::int)::varchar end as le, 0::bigint as ts, n as value from b"
for _p in (0.5, 0.9, 0.99):
    QUERIES[f"histogram_quantile_p{int(_p * 100)}"] = lambda spark, sf, p=_p: flat(h.quantile(h.bucket_series(classic(spark, sf)), p), "flag", "status")
    SQL[f"histogram_quantile_p{int(_p * 100)}"] = f"with {_CLASSIC}, " + _quantile_sql(_p, "flag, status")
QUERIES["histogram_quantile_of_sum"] = lambda spark, sf: flat(h.quantile(m.aggregate(h.bucket_series(classic(spark, sf)), "sum", by=["le", "flag"]), 0.9), "flag")
SQL["histogram_quantile_of_sum"] = f"with {_CLASSIC}, c as (select flag, le, sum(n) as n from b group by 1, 2), " + _quantile_sql(0.9, "flag", "c")
QUERIES["histogram_quantiles"] = lambda spark, sf: flat(h.quantile(h.bucket_series(classic(spark, sf)), [0.5, 0.95], "phi"), "flag", "status", "phi")
SQL["histogram_quantiles"] = f"with {_CLASSIC}, " + " union all ".join(f"(select flag, status, '{p}' as phi, ts, value from (with {_quantile_sql(p, 'flag, status')}))" for p in (0.5, 0.95)).replace("with r as", "with r as", 1).join(["select * from (", ")"])

SCALE = 2


def exponential(spark: SparkSession, sf_dir: str, sign: int = 1) -> DataFrame:
    """Order prices by status and priority as exponential histograms, of a finer scale for urgent ones."""
    orders = ad.table(spark, sf_dir, "orders").withColumn("scale", F.when(F.col("o_orderpriority").startswith("1"), SCALE + 1).otherwise(SCALE))
    index = (F.ceil(F.log2("o_totalprice") * F.pow(F.lit(2.0), "scale")) - 1).cast("int")
    buckets = orders.groupBy("o_orderstatus", "o_orderpriority", "scale", index.alias("i")).agg(F.count("*").cast("double").alias("n"), F.sum("o_totalprice").alias("total"))
    rows = buckets.groupBy("o_orderstatus", "o_orderpriority", "scale").agg(F.sum("n").alias("count"), F.sum("total").alias("sum"), F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("positive"))
    none = F.create_map().cast("map<int,double>")
    hist = F.struct("count", "sum", "scale", F.lit(0.0).alias("zero_count"), "positive", none.alias("negative"))
    return rows.select(ad.labelled("price", status="o_orderstatus", priority="o_orderpriority").alias("labels"), F.lit(0).cast("long").alias("ts"), hist.alias("hist"))


_SCALE = "(case when o_orderpriority like '1%' then 3 else 2 end)"
_EXP = f"e as (select o_orderstatus as status, o_orderpriority as priority, {_SCALE} as scale, (ceil(log2(o_totalprice) * pow(2, {_SCALE})) - 1)::int as i, count(*)::double as n, sum(o_totalprice) as total from orders group by 1, 2, 3, 4)"
_EXP_ALL = "c as (select status, floor(i / pow(2, scale - 2))::int as i, sum(n) as n, sum(total) as total from e group by 1, 2)"


def _exp_quantile(phi: float, keys: str, source: str, scale: str) -> str:
    """Walks from the top, as for phi of a half or more."""
    return f"""w as (select *, {scale} as s, sum(n) over (partition by {keys} order by i desc) as above, sum(n) over (partition by {keys}) * (1 - {phi}::double) as rank from {source}),
f as (select *, row_number() over (partition by {keys} order by i desc) as k from w where above >= rank)
select {keys}, 0::bigint as ts, round(pow(pow(2, pow(2, -s)), i) * pow(pow(2, pow(2, -s)), 1 - (rank - (above - n)) / n), 4) as value from f where k = 1"""


QUERIES["exponential_quantile"] = lambda spark, sf: flat(h.value_of(exponential(spark, sf), lambda x: hg.exponential_quantile(x, 0.9)), "status", "priority", digits=4)
SQL["exponential_quantile"] = f"with {_EXP}, " + _exp_quantile(0.9, "status, priority", "e", "scale")
QUERIES["exponential_sum_quantile"] = lambda spark, sf: flat(h.value_of(h.aggregate(exponential(spark, sf), "sum", by=["status"]), lambda x: hg.exponential_quantile(x, 0.75)), "status", digits=4)
SQL["exponential_sum_quantile"] = f"with {_EXP}, {_EXP_ALL}, " + _exp_quantile(0.75, "status", "c", "2")


def _stats(rows: DataFrame, *names: str) -> DataFrame:
    hist = F.col("hist")
    return rows.select(*(lb.label(F.col("labels"), n).alias(n) for n in names), F.round(hist["count"], 4).alias("n"), F.round(hist["sum"], 2).alias("total"), F.round(hg.mean(hist), 4).alias("mean"), F.round(hg.variance(hist), 0).alias("var"), F.size(hist["positive"]).alias("buckets"))


_MIDDLE = "sqrt(pow(pow(2, pow(2, -2)), i) * pow(pow(2, pow(2, -2)), i + 1))"
_STATS = """t as (select status, sum(n) as n, sum(total) as total from c group by 1)
select status, round({f} * t.n, 4) as n, round({f} * t.total, 2) as total, round(t.total / t.n, 4) as mean, round(sum(c.n * pow({m} - t.total / t.n, 2)) / t.n, 0) as var, count(*)::int as buckets
from c join t using (status) group by status, t.n, t.total"""
QUERIES["exponential_sum"] = lambda spark, sf: _stats(h.aggregate(exponential(spark, sf), "sum", by=["status"]), "status")
SQL["exponential_sum"] = f"with {_EXP}, {_EXP_ALL}, " + _STATS.format(f="1", m=_MIDDLE)
QUERIES["exponential_avg"] = lambda spark, sf: _stats(h.aggregate(exponential(spark, sf), "avg", by=["status"]), "status")
SQL["exponential_avg"] = f"with {_EXP}, {_EXP_ALL}, k as (select count(distinct priority) as k from e), " + _STATS.format(f="(1.0::double / (select k from k))", m=_MIDDLE)
QUERIES["exponential_binary_add"] = lambda spark, sf: _stats(h.binary(h.aggregate(exponential(spark, sf), "sum", by=["status"]), "+", h.aggregate(exponential(spark, sf), "sum", by=["status"])), "status")
SQL["exponential_binary_add"] = f"with {_EXP}, {_EXP_ALL}, " + _STATS.format(f="2", m=_MIDDLE)
QUERIES["exponential_scaled"] = lambda spark, sf: _stats(h.scale_by(h.aggregate(exponential(spark, sf), "sum", by=["status"]), 0.5), "status")
SQL["exponential_scaled"] = f"with {_EXP}, {_EXP_ALL}, " + _STATS.format(f="0.5::double", m=_MIDDLE)
QUERIES["exponential_fraction"] = lambda spark, sf: flat(h.value_of(h.aggregate(exponential(spark, sf), "sum", by=["status"]), lambda x: hg.fraction(x, 1000, 100000)), "status")
_BELOW = "sum(n * greatest(0, least(1, (log2({x}) - i / 4.0::double) * 4)))"
SQL["exponential_fraction"] = f"with {_EXP}, {_EXP_ALL} select status, 0::bigint as ts, round(({_BELOW.format(x=100000)} - {_BELOW.format(x=1000)}) / sum(n), 8) as value from c group by 1"


# Histograms over time: prices of each half-year's orders by status, at its end.
HALF = 182 * 86_400_000
FIRST = 788_918_400_000 - 3 * 365 * 86_400_000
HALVES = Grid(FIRST, FIRST + 14 * HALF, HALF)


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = ad.table(spark, sf_dir, "orders").withColumn("ts", (F.lit(FIRST) + F.ceil((ad.epoch_ms("o_orderdate") - FIRST) / F.lit(HALF)) * HALF).cast("long"))
    buckets = orders.groupBy("o_orderstatus", "ts", (F.ceil(F.log2("o_totalprice")) - 1).cast("int").alias("i")).agg(F.count("*").cast("double").alias("n"), F.sum("o_totalprice").alias("total"))
    rows = buckets.groupBy("o_orderstatus", "ts").agg(F.sum("n").alias("count"), F.sum("total").alias("sum"), F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("positive"))
    hist = F.struct("count", "sum", F.lit(0).alias("scale"), F.lit(0.0).alias("zero_count"), "positive", F.create_map().cast("map<int,double>").alias("negative"))
    return rows.select(ad.labelled("price", status="o_orderstatus").alias("labels"), "ts", hist.alias("hist"))


def _totals(rows: DataFrame, digits: int = 4) -> DataFrame:
    return rows.select(lb.label(F.col("labels"), "status").alias("status"), "ts", F.round("hist.count", digits).alias("n"), F.round("hist.sum", digits).alias("total"), F.size("hist.positive").alias("buckets"))


_HALVES = f"""with b as (select o_orderstatus as status, {FIRST} + ceil((epoch_ms(o_orderdate) - {FIRST}) / {HALF}::double)::bigint * {HALF} as t, (ceil(log2(o_totalprice)) - 1)::int as i, count(*)::double as n, sum(o_totalprice) as total from orders group by 1, 2, 3),
s as (select status, t, sum(n) as n, sum(total) as total, lag(t) over o as pt, lag(sum(n)) over o as pn, lag(sum(total)) over o as ptotal from b group by 1, 2 window o as (partition by status order by t)),
g as (select {FIRST} + i * {HALF} as p from generate_series(0, {HALVES.points - 1}) as x(i))
"""
QUERIES["exponential_sum_over_time"] = lambda spark, sf: _totals(h.over_time(halves(spark, sf), "sum_over_time", HALVES, 3 * HALF), 2)
SQL["exponential_sum_over_time"] = _HALVES + f"select status, p as ts, round(sum(b.n), 2) as n, round(sum(b.total), 2) as total, count(distinct i)::int as buckets from b join g on t > p - {3 * HALF} and t <= p group by 1, 2"
_ENDS = f"""e as (select status, p, count(*) as k, min(t) as ft, max(t) as lt, arg_min(n, t) as fn, arg_max(n, t) as ln, arg_min(total, t) as ftotal, arg_max(total, t) as ltotal from s join g on t > p - {3 * HALF} and t <= p group by 1, 2 having count(*) >= 2),
w as (select *, (lt - ft)::double as c, (lt - ft)::double / (k - 1) as gap from e),
f as (select *, (c + case when ft - (p - {3 * HALF}) >= 1.1 * gap then gap / 2 else ft - (p - {3 * HALF}) end + case when p - lt >= 1.1 * gap then gap / 2 else p - lt end) / c as factor from w)
"""
QUERIES["exponential_delta"] = lambda spark, sf: _totals(h.over_time(halves(spark, sf), "delta", HALVES, 3 * HALF), 4).drop("buckets")
SQL["exponential_delta"] = _HALVES + ", " + _ENDS + "select status, p as ts, round((ln - fn) * factor, 4) as n, round((ltotal - ftotal) * factor, 4) as total from f"
QUERIES["exponential_idelta"] = lambda spark, sf: _totals(h.over_time(halves(spark, sf), "idelta", HALVES, 2 * HALF), 2).drop("buckets")
SQL["exponential_idelta"] = _HALVES + f"select status, t as ts, round(n - pn, 2) as n, round(total - ptotal, 2) as total from s join g on t = p where pt = t - {HALF}"
_FELL = "exists (select 1 from b x where x.status = s.status and x.t = s.pt and x.n > coalesce((select y.n from b y where y.status = s.status and y.t = s.t and y.i = x.i), 0))"
QUERIES["exponential_irate"] = lambda spark, sf: _totals(h.over_time(halves(spark, sf), "irate", HALVES, 2 * HALF), 8).drop("buckets")
SQL["exponential_irate"] = _HALVES + f"select status, t as ts, round((case when {_FELL} then n else n - pn end) / {HALF / 1000.0}, 8) as n, round((case when {_FELL} then total else total - ptotal end) / {HALF / 1000.0}, 8) as total from s join g on t = p where pt = t - {HALF}"
QUERIES["exponential_resets"] = lambda spark, sf: flat(h.changes(halves(spark, sf), "resets", HALVES, 4 * HALF), "status")
SQL["exponential_resets"] = _HALVES + f", r as (select status, t, pt, {_FELL} as fell from s) select status, p as ts, sum(case when pt > p - {4 * HALF} and fell then 1 else 0 end)::double as value from r join g on t > p - {4 * HALF} and t <= p group by 1, 2"
QUERIES["exponential_increase"] = lambda spark, sf: _totals(h.over_time(halves(spark, sf), "increase", HALVES, 4 * HALF), 4).drop("buckets")
SQL["exponential_increase"] = _HALVES + f""", r as (select *, {_FELL} as fell from s),
e as (select status, p, count(*) as k, min(t) as ft, max(t) as lt, arg_min(n, t) as fn, arg_max(n, t) - arg_min(n, t) + sum(case when fell and pt > p - {4 * HALF} then pn else 0 end) as change,
      arg_max(total, t) - arg_min(total, t) + sum(case when fell and pt > p - {4 * HALF} then ptotal else 0 end) as grown from r join g on t > p - {4 * HALF} and t <= p group by 1, 2 having count(*) >= 2),
w as (select *, (lt - ft)::double as c, (lt - ft)::double / (k - 1) as gap from e),
z as (select *, case when ft - (p - {4 * HALF}) >= 1.1 * gap then gap / 2 else ft - (p - {4 * HALF}) end as first, case when p - lt >= 1.1 * gap then gap / 2 else p - lt end as last from w),
f as (select *, (c + least(first, case when change > 0 then c * (fn / change) else first end) + last) / c as factor from z)
select status, p as ts, round(change * factor, 4) as n, round(grown * factor, 4) as total from f"""
# each histogram twice, from one evaluation: sums added in another order differ in their last digits
_TWICE = lambda spark, sf: halves(spark, sf).withColumn("ts", F.explode(F.array(F.col("ts"), F.col("ts") + 1000)))
QUERIES["exponential_changes"] = lambda spark, sf: flat(h.changes(_TWICE(spark, sf), "changes", Grid(FIRST + 2000, FIRST + 2000 + 14 * HALF, HALF), 4 * HALF), "status")
SQL["exponential_changes"] = _HALVES + f"select status, p + 2000 as ts, sum(case when pt is not null and pt > p + 1000 - {4 * HALF} then 1 else 0 end)::double as value from s join g on t + 1000 > p + 2000 - {4 * HALF} and t <= p group by 1, 2"
QUERIES["exponential_count"] = lambda spark, sf: flat(h.counted(exponential(spark, sf), "count", by=["status"]), "status")
SQL["exponential_count"] = f"with {_EXP} select status, 0::bigint as ts, count(distinct priority)::double as value from e group by 1"
QUERIES["exponential_group"] = lambda spark, sf: flat(h.counted(exponential(spark, sf), "group", by=["priority"]), "priority")
SQL["exponential_group"] = "select distinct o_orderpriority as priority, 0::bigint as ts, 1.0::double as value from orders"
_EMPTY = lambda spark, sf: halves(spark, sf).withColumn("hist", F.col("hist").withField("sum", F.lit(0.0)).withField("positive", F.create_map(F.lit(1), F.col("hist.count"))))
QUERIES["exponential_count_values"] = lambda spark, sf: flat(h.count_values(_EMPTY(spark, sf), "text"), "text")
SQL["exponential_count_values"] = _HALVES + "select '{count:' || n::bigint || ', sum:0, (2,4]:' || n::bigint || '}' as text, t as ts, count(*)::double as value from s group by 1, 2"
QUERIES["exponential_scaled_by_vector"] = lambda spark, sf: _stats(h.scale_by(sums := h.aggregate(exponential(spark, sf), "sum", by=["status"]), h.value_of(sums, "histogram_count"), divide=True), "status").drop("var")
SQL["exponential_scaled_by_vector"] = f"with {_EXP}, {_EXP_ALL} select status, 1.0::double as n, round(sum(total) / sum(n), 2) as total, round(sum(total) / sum(n), 4) as mean, count(*)::int as buckets from c group by 1"


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of the half-years, or, where there is none, the value of another series."""
    late = halves(spark, sf_dir).where(F.col("ts") > FIRST + 5 * HALF)
    values = m.map_values(h.value_of(halves(spark, sf_dir), "histogram_count"), lambda v: v)
    return mt.or_(late, values, on=["status"])


QUERIES["mixed_or"] = lambda spark, sf: _mixed(spark, sf).select(lb.label(F.col("labels"), "status").alias("status"), "ts", F.col("hist.count").alias("n"), "value")
SQL["mixed_or"] = _HALVES + f"select status, t as ts, case when t > {FIRST + 5 * HALF} then n end as n, case when t <= {FIRST + 5 * HALF} then n end as value from s"
QUERIES["mixed_max"] = lambda spark, sf: flat(m.aggregate(h.numbers(_mixed(spark, sf)), "max"))
SQL["mixed_max"] = _HALVES + f"select t as ts, max(n) as value from s where t <= {FIRST + 5 * HALF} group by 1"


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of the line items shipped so far, by flag, as classic histograms at the end of each half-year."""
    ts = (F.lit(FIRST) + F.ceil((ad.epoch_ms("l_shipdate") - FIRST) / F.lit(HALF)) * HALF).cast("long")
    place = F.size(F.filter(F.array(*map(F.lit, BOUNDS)), lambda b: b < F.col("l_quantity")))
    each = ad.table(spark, sf_dir, "lineitem").groupBy("l_returnflag", ts.alias("ts")).agg(*(F.sum((place == i).cast("double")).alias(f"c{i}") for i in range(len(BOUNDS) + 1)))
    so_far = Window.partitionBy("l_returnflag").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    counts = F.array(*(F.sum(f"c{i}").over(so_far) for i in range(len(BOUNDS) + 1)))
    return each.select(ad.labelled("quantity", flag="l_returnflag").alias("labels"), "ts", F.array(*map(F.lit, BOUNDS)).alias("bounds"), counts.alias("counts"))


_LE = "(values " + ", ".join(f"({b}::double)" for b in BOUNDS) + ", ('inf'::double)) as x(le)"
_COUNTERS = f"""with k as (select l_returnflag as flag, {FIRST} + ceil((epoch_ms(l_shipdate) - {FIRST}) / {HALF}::double)::bigint * {HALF} as t, le, count(*) filter (where l_quantity <= le)::double as n from lineitem cross join {_LE} group by 1, 2, 3),
s as (select flag, le, t, sum(n) over (partition by flag, le order by t) as v from k), g as (select {FIRST} + i * {HALF} as p from generate_series(0, {HALVES.points - 1}) as x(i)),
a as (select flag, le, p, count(*) as m, min(t) as ft, max(t) as lt, arg_min(v, t) as fv, arg_max(v, t) - arg_min(v, t) as change from s join g on t > p - {4 * HALF} and t <= p group by 1, 2, 3 having count(*) >= 2),
w as (select *, (lt - ft)::double as c, (lt - ft)::double / (m - 1) as gap from a),
z as (select *, case when ft - (p - {4 * HALF}) >= 1.1 * gap then gap / 2 else ft - (p - {4 * HALF}) end as first, case when p - lt >= 1.1 * gap then gap / 2 else p - lt end as last from w),
b as (select flag, le, p, change * ((c + least(first, case when change > 0 then c * (fv / change) else first end) + last) / c) as n from z)
"""
_le_text = "case when isinf(le) then '+Inf' else (le::int)::varchar end as le"
QUERIES["bucket_increase"] = lambda spark, sf: flat(h.bucket_ranges(counters(spark, sf), "increase", HALVES, 4 * HALF), "flag", "le", digits=6)
SQL["bucket_increase"] = _COUNTERS + f"select flag, {_le_text}, p as ts, round(n, 6) as value from b"
QUERIES["histogram_quantile_of_increase"] = lambda spark, sf: flat(h.quantile(m.aggregate(h.bucket_ranges(counters(spark, sf), "increase", HALVES, 4 * HALF), "sum", by=["le", "flag"]), 0.9), "flag", digits=6)
SQL["histogram_quantile_of_increase"] = _COUNTERS + ", " + _quantile_sql(0.9, "flag, p").replace("flag, p, 0::bigint as ts", "flag, p as ts").replace(", 8) as value", ", 6) as value")
QUERIES["bucket_newest"] = lambda spark, sf: flat(h.newest_buckets(counters(spark, sf), HALVES, 3 * HALF), "flag", "le")
SQL["bucket_newest"] = _COUNTERS + f"select flag, {_le_text}, p as ts, arg_max(v, t) as value from s join g on t > p - {3 * HALF} and t <= p group by 1, le, p"

_sums = lambda spark, sf: h.aggregate(exponential(spark, sf), "sum", by=["status"])
QUERIES["exponential_binary_sub"] = lambda spark, sf: _stats(h.binary(_sums(spark, sf), "-", h.scale_by(_sums(spark, sf), 0.25)), "status")
SQL["exponential_binary_sub"] = f"with {_EXP}, {_EXP_ALL}, " + _STATS.format(f="0.75::double", m=_MIDDLE)
_other = lambda spark, sf: halves(spark, sf).withColumn("hist", hg.scaled(F.col("hist"), F.when(lb.label(F.col("labels"), "status") == "F", 1.0).otherwise(2.0)))
for _op, _sign in (("==", "="), ("!=", "<>")):
    QUERIES[f"exponential_{'equal' if _op == '==' else 'unequal'}"] = lambda spark, sf, op=_op: _totals(h.binary(halves(spark, sf), op, _other(spark, sf)), 2).drop("buckets")
    SQL[f"exponential_{'equal' if _op == '==' else 'unequal'}"] = _HALVES + f"select status, t as ts, round(n, 2) as n, round(total, 2) as total from s where status {_sign} 'F'"
