"""Trace queries: customers as traces, their orders and line items as spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import traces as t
from ..plans.grid import Grid
from ..sources import adapters as ad

QUERIES: dict = {}
SQL: dict[str, str] = {}
DAY = 86_400_000
GRID = Grid(788_918_400_000, 788_918_400_000 + 14 * 180 * DAY, 180 * DAY)  # past the last line item

_SPANS = """with o as (select * from orders), spans as (
select c_custkey::varchar as trace_id, 'c' || c_custkey as span_id, '' as parent_id, 'customer' as name, 'nation-' || c_nationkey as service, 'Unset' as status, 788918400000::bigint as start, 0::bigint as duration, c_mktsegment as segment, null as priority, null::double as quantity, null as flag from customer
union all select o_custkey::varchar, 'o' || o_orderkey, 'c' || o_custkey, 'order', 'status-' || o_orderstatus, case when o_orderstatus = 'F' then 'Error' else 'Ok' end, epoch_ms(o_orderdate), trunc(o_totalprice)::bigint, null, o_orderpriority, null, null from o
union all select o_custkey::varchar, 'l-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, 'o' || l_orderkey, 'item', 'flag-' || l_returnflag, case when l_returnflag = 'R' then 'Error' else 'Ok' end, epoch_ms(l_shipdate), trunc(l_extendedprice)::bigint, null, null, l_quantity, l_returnflag from lineitem join o on l_orderkey = o_orderkey)
"""


def add(name: str, f, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = _SPANS + sql


def spans(s: SparkSession, d: str) -> DataFrame:
    return ad.order_spans(s, d)


def ids(df: DataFrame) -> DataFrame:
    return df.select("trace_id", "span_id", "name")


A = lambda: (F.col("name") == "customer") & (t.attribute("segment", "resource") == "BUILDING")  # noqa: E731, E741
B = lambda: (F.col("name") == "item") & (t.number("quantity") > 45)  # noqa: E731, E741
O = lambda: (F.col("name") == "order") & (t.attribute("priority") == "1-URGENT")  # noqa: E731, E741
_A, _B, _O = "(name = 'customer' and segment = 'BUILDING')", "(name = 'item' and quantity > 45)", "(name = 'order' and priority = '1-URGENT')"

add("span_filter", lambda s, d: ids(spans(s, d).where((F.col("duration") > 50000) & t.attribute("priority").rlike("^(?:1|2).*") & (F.col("status") == "Error"))), "select trace_id, span_id, name from spans where duration > 50000 and regexp_full_match(priority, '(1|2).*') and status = 'Error'")
add("span_arithmetic", lambda s, d: ids(spans(s, d).where((t.number("quantity") * 1000 > F.col("duration")) & ~(F.col("status") == "Error"))), "select trace_id, span_id, name from spans where quantity * 1000 > duration and not status = 'Error'")
add("span_attribute_exists", lambda s, d: ids(spans(s, d).where(t.exists("priority") | t.exists("segment", "resource"))), "select trace_id, span_id, name from spans where priority is not null or segment is not null")
add("span_in", lambda s, d: ids(spans(s, d).where(t.attribute("segment", "resource").isin("BUILDING", "MACHINERY"))), "select trace_id, span_id, name from spans where segment in ('BUILDING', 'MACHINERY')")
add("trace_intrinsics", lambda s, d: t.with_trace(spans(s, d)).where("name = 'order'").select("trace_id", "span_id", "root_name", "root_service", "trace_duration", "child_count"),
    "select o.trace_id, o.span_id, r.name as root_name, r.service as root_service, d.duration as trace_duration, coalesce(k.n, 0) as child_count from spans o join spans r on r.trace_id = o.trace_id and r.parent_id = '' join (select trace_id, max(start + duration) - min(start) as duration from spans group by 1) d on d.trace_id = o.trace_id left join (select trace_id, parent_id, count(*) as n from spans group by 1, 2) k on k.trace_id = o.trace_id and k.parent_id = o.span_id where o.name = 'order'")
add("spanset_and", lambda s, d: ids(t.together(spans(s, d).where(A()), spans(s, d).where(B()))), f"select distinct trace_id, span_id, name from spans where ({_A} or {_B}) and trace_id in (select trace_id from spans where {_A}) and trace_id in (select trace_id from spans where {_B})")
add("spanset_or", lambda s, d: ids(t.both(spans(s, d).where(A()), spans(s, d).where(O()))), f"select distinct trace_id, span_id, name from spans where {_A} or {_O}")


def structural(op: str, left, right):
    return lambda s, d: ids(t.structural(sp := spans(s, d), sp.where(left()), op, sp.where(right()))).distinct()


_DESC = "(select a.trace_id, a.span_id as x, b.span_id as y from spans a join spans b on a.trace_id = b.trace_id and b.parent_id = a.span_id union select a.trace_id, a.span_id, c.span_id from spans a join spans b on a.trace_id = b.trace_id and b.parent_id = a.span_id join spans c on c.trace_id = b.trace_id and c.parent_id = b.span_id) k"


def _semi(right: str, left: str, own: str, other: str, negate: bool = False) -> str:
    a = left
    for c in ("name", "segment", "quantity", "priority"):
        a = a.replace(c, "a." + c)
    return f"select distinct b.trace_id, b.span_id, b.name from (select * from spans where {right}) b where (b.trace_id, b.span_id) {'not ' if negate else ''}in (select k.trace_id, {own} from {_DESC} join spans a on a.trace_id = k.trace_id and a.span_id = {other} where {a})"


_CHILDREN = _DESC.split(" union select")[0] + ") k"
add("structural_child", structural(">", A, O), _semi(_O, _A, "k.y", "k.x").replace(_DESC, _CHILDREN))
add("structural_descendant", structural(">>", A, B), _semi(_B, _A, "k.y", "k.x"))
add("structural_parent", structural("<", O, A), _semi(_A, _O, "k.x", "k.y").replace(_DESC, _CHILDREN))
add("structural_ancestor", structural("<<", B, A), _semi(_A, _B, "k.x", "k.y"))
add("structural_not_child", structural("!>", A, O), _semi(_O, _A, "k.y", "k.x", True).replace(_DESC, _CHILDREN))
add("structural_not_descendant", structural("!>>", A, B), _semi(_B, _A, "k.y", "k.x", True))
_SIB = "exists (select 1 from spans a where a.trace_id = b.trace_id and a.parent_id = b.parent_id and a.span_id <> b.span_id and a.name = 'order' and a.priority = '1-URGENT')"
add("structural_sibling", structural("~", O, lambda: F.col("name") == "order"), f"select distinct trace_id, span_id, name from spans b where name = 'order' and {_SIB}")
add("structural_not_sibling", structural("!~", O, lambda: F.col("name") == "order"), f"select distinct trace_id, span_id, name from spans b where name = 'order' and not {_SIB}")
add("structural_union_child", structural("&>", A, O), _semi(_O, _A, "k.y", "k.x").replace(_DESC, _CHILDREN) + " union " + _semi(_A, _O, "k.x", "k.y").replace(_DESC, _CHILDREN))
add("structural_union_descendant", structural("&>>", A, B), _semi(_B, _A, "k.y", "k.x") + " union " + _semi(_A, _B, "k.x", "k.y"))
add("structural_not_parent", structural("!<", O, A), _semi(_A, _O, "k.x", "k.y", True).replace(_DESC, _CHILDREN))
add("structural_not_ancestor", structural("!<<", B, A), _semi(_A, _B, "k.x", "k.y", True))
add("structural_union_parent", structural("&<", O, A), _semi(_A, _O, "k.x", "k.y").replace(_DESC, _CHILDREN) + " union " + _semi(_O, _A, "k.y", "k.x").replace(_DESC, _CHILDREN))
add("structural_union_ancestor", structural("&<<", B, A), _semi(_A, _B, "k.x", "k.y") + " union " + _semi(_B, _A, "k.y", "k.x"))
_PAIRED = "select distinct b.trace_id, b.span_id, b.name from spans b join spans a on a.trace_id = b.trace_id and a.parent_id = b.parent_id and a.span_id <> b.span_id where "
add("structural_union_sibling", structural("&~", lambda: (F.col("name") == "order") & (t.attribute("priority") == "5-LOW"), lambda: (F.col("name") == "order") & (F.col("status") == "Error")),
    _PAIRED + "b.name = 'order' and b.status = 'Error' and a.name = 'order' and a.priority = '5-LOW' union " + _PAIRED + "b.name = 'order' and b.priority = '5-LOW' and a.name = 'order' and a.status = 'Error'")
for _how, _op, _value, _sql in (("count", ">", 60, "count(*)"), ("avg", ">=", 40000, "avg(duration)"), ("max", "<", 90000, "max(duration)"), ("min", ">", 100, "min(duration)"), ("sum", ">", 2_000_000, "sum(duration)")):
    add(f"trace_aggregate_{_how}", lambda s, d, h=_how, o=_op, v=_value: t.where_aggregate(spans(s, d).where("name <> 'customer'"), h, o, v, F.col("duration")).select("trace_id", F.round("aggregate", 4).alias("aggregate")).distinct(), f"select trace_id, round(({_sql})::double, 4) as aggregate from spans where name <> 'customer' group by 1 having {_sql} {_op} {_value}")
add("trace_group_by", lambda s, d: t.where_aggregate(spans(s, d), "count", ">", 10, by=F.col("status")).select("trace_id", F.col("group").alias("status"), "aggregate").distinct(), "select trace_id, status, count(*)::double as aggregate from spans group by 1, 2 having count(*) > 10")
add("trace_search", lambda s, d: t.summaries(sp := spans(s, d), sp.where(B())), f"""select s.trace_id, min(case when parent_id = '' then name end) as root_name, min(case when parent_id = '' then service end) as root_service, min(start) as start, max(start + duration) - min(start) as duration, min(m.n) as matched
from spans s join (select trace_id, count(*) as n from spans where {_B} group by 1) m on m.trace_id = s.trace_id group by 1""")
add("trace_limit", lambda s, d: ids(t.newest_traces(spans(s, d).where("name = 'order'"), 20)), "select trace_id, span_id, name from spans where name = 'order' and trace_id in (select trace_id from spans where name = 'order' group by 1 order by min(start) desc, trace_id limit 20)")
add("trace_select", lambda s, d: spans(s, d).where(B()).select("trace_id", "span_id", "service", t.number("quantity").alias("quantity"), t.attribute("flag", "resource").alias("flag")), f"select trace_id, span_id, service, quantity, flag from spans where {_B}")
add("nested_sets", lambda s, d: t.nested_sets(spans(s, d).where("name <> 'item'")), """select trace_id, span_id, case when name = 'customer' then 1 else 2 * row_number() over (partition by trace_id, name order by span_id) end as nested_left,
case when name = 'customer' then 2 * count(*) over (partition by trace_id) else 2 * row_number() over (partition by trace_id, name order by span_id) + 1 end as nested_right, case when name = 'customer' then -1 else 1 end as nested_parent from spans where name <> 'item'""")
# all spans, three levels deep: the closed form above knows two, so tests walk the trees
add("nested_sets_all", lambda s, d: t.nested_sets(spans(s, d)))

_STEP = f"({GRID.start} + ceil((start - {GRID.start}) / {GRID.step}::double) * {GRID.step})::bigint"
_IN = f"start > {GRID.start - GRID.step} and start <= {GRID.end}"
BY = lambda: {"service": F.col("service")}
for _how, _sql in {"rate": f"count(*) / {GRID.step / 1000.0}::double", "count_over_time": "count(*)::double", "min_over_time": "min(duration)::double", "max_over_time": "max(duration)::double", "sum_over_time": "sum(duration)::double", "avg_over_time": "avg(duration)"}.items():
    add(f"span_{_how}", lambda s, d, h=_how: t.metric(spans(s, d), h, GRID, F.col("duration"), BY()).withColumn("value", F.round("value", 8)), f"select service, {_STEP} as ts, round({_sql}, 8) as value from spans where {_IN} group by 1, 2")
add("span_histogram_over_time", lambda s, d: t.histogram_over_time(spans(s, d), GRID, F.col("duration"), {"name": F.col("name")}), f"select name, pow(2, ceil(log2(duration))) as bucket, {_STEP} as ts, count(*)::double as value from spans where {_IN} and duration >= 2 group by 1, 2, 3")
add("span_quantile_over_time", lambda s, d: t.quantile_over_time(spans(s, d), GRID, F.col("duration"), [0.5, 0.9], {"name": F.col("name")}).withColumn("value", F.round("value", 6)), f""", h as (select name, pow(2, ceil(log2(duration))) as bucket, {_STEP} as ts, count(*)::double as n from spans where {_IN} and duration >= 2 group by 1, 2, 3),
c as (select *, sum(n) over (partition by name, ts order by bucket) as upto, sum(n) over (partition by name, ts) as total from h)
select name, ts, p, round(bucket / 2 * pow(2, (p * total - (upto - n)) / n), 6) as value from c cross join (values (0.5::double), (0.9::double)) as q(p) where upto >= p * total and upto - n < p * total""")
add("span_exact_quantile", lambda s, d: t.exact_quantile(spans(s, d), F.col("duration"), 0.9, {"name": F.col("name")}).withColumn("value", F.round("value", 6)), "select name, round(quantile_cont(duration, 0.9), 6) as value from spans group by 1")
_COUNTS = f", c as (select service, {_STEP} as ts, count(*)::double as value from spans where {_IN} group by 1, 2) "
for _name, _way in (("topk", {"top": 3}), ("bottomk", {"bottom": 3})):
    add(f"span_{_name}", lambda s, d, w=_way: t.second_stage(t.metric(spans(s, d), "count_over_time", GRID, by=BY()), ["service"], **w), _COUNTS + f"select service, ts, value from c qualify row_number() over (partition by ts order by value {'desc' if _name == 'topk' else 'asc'}, service) <= 3")
add("span_threshold", lambda s, d: t.second_stage(t.metric(spans(s, d), "count_over_time", GRID, by=BY()), ["service"], op=">", value=100), _COUNTS + "select service, ts, value from c where value > 100")
add("span_compare", lambda s, d: t.compare(spans(s, d).where("name = 'order'").withColumns({"attributes": F.map_filter("attributes", lambda k, _: k == "priority")}), F.col("status") == "Error", 3), """, x as (select status = 'Error' as selected, unnest([{'a': 'name', 'v': name}, {'a': 'status', 'v': status}, {'a': 'kind', 'v': 'Client'}, {'a': 'resource.service.name', 'v': service}, {'a': 'resource.status', 'v': service[8:]}, {'a': 'span.priority', 'v': priority}]) as e from spans where name = 'order')
select selected, e.a as attribute, e.v as val, count(*) as n from x group by 1, 2, 3 qualify row_number() over (partition by selected, e.a order by count(*) desc, e.v) <= 3""")
# all spans with all attributes; tests count by hand
add("span_compare_all", lambda s, d: t.compare(spans(s, d), F.col("status") == "Error", 3))
add("span_exemplars", lambda s, d: ids(t.exemplars(spans(s, d), GRID, 2)), f"select trace_id, span_id, name from spans where {_IN} qualify row_number() over (partition by {_STEP} order by start, trace_id, span_id) <= 2")
add("span_tags", lambda s, d: t.tags(spans(s, d)), "select * from (values ('resource', 'segment'), ('resource', 'status'), ('resource', 'flag'), ('span', 'balance'), ('span', 'priority'), ('span', 'price'), ('span', 'quantity'), ('span', 'supplier')) as x(scope, tag)")
add("span_tag_values", lambda s, d: t.tag_values(spans(s, d), "priority"), "select distinct priority as val from spans where priority is not null")


# Events, links, instrumentation, parents.
def eventful(s: SparkSession, d: str) -> DataFrame:
    return ad.orders_with_events(s, d)


_ORDERS = "select o_custkey::varchar as trace_id, 'o' || o_orderkey as span_id, 'order' as name from orders where "
QUERIES["event_attribute"] = lambda s, d: ids(eventful(s, d).where(t.any_attribute("event", "flag", lambda v: v.rlike("^(?:R|X)$"))))
SQL["event_attribute"] = _ORDERS + "o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')"
QUERIES["event_intrinsics"] = lambda s, d: ids(eventful(s, d).where(t.any_event(lambda name, since: (name == "ship-F") & (since > 100 * DAY))))
SQL["event_intrinsics"] = _ORDERS + f"exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linestatus = 'F' and epoch_ms(l_shipdate) - epoch_ms(o_orderdate) > {100 * DAY})"
QUERIES["event_attribute_missing"] = lambda s, d: ids(eventful(s, d).where(~t.exists("flag", "event") & (F.col("name") == "order")))
SQL["event_attribute_missing"] = _ORDERS + "o_orderkey not in (select l_orderkey from lineitem)"
QUERIES["link_attribute"] = lambda s, d: ids(eventful(s, d).where(t.any_attribute("link", "cause", lambda v: v == "Error") & t.any_nested("links", lambda x: x["trace_id"] == F.col("trace_id"))))
SQL["link_attribute"] = _ORDERS + "o_orderstatus = 'F'"
QUERIES["instrumentation_scope"] = lambda s, d: ids(eventful(s, d).where((F.col("scope_name") == "orders") & (t.attribute("kind", "instrumentation") == "Client") & F.col("status_message").startswith("failed")))
SQL["instrumentation_scope"] = _ORDERS + "o_orderstatus = 'F'"
QUERIES["parent_scope"] = lambda s, d: ids(t.with_parent(spans(s, d)).where((t.attribute("segment", "parent.resource") == "BUILDING") & (F.col("parent.name") == "customer") & (t.attribute("priority") == "1-URGENT")))
SQL["parent_scope"] = _ORDERS + "o_orderpriority = '1-URGENT' and o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')"
add("trace_coalesce", lambda s, d: t.coalesce(t.where_aggregate(spans(s, d), "count", ">", 10, by=F.col("status")), F.col("duration")).select("trace_id", "spans", "total"),
    "select s.trace_id, count(distinct s.span_id) as spans, sum(s.duration)::double as total from spans s join (select trace_id, status from spans group by 1, 2 having count(*) > 10) g using (trace_id, status) group by 1")
add("trace_by_id", lambda s, d: ids(t.trace(spans(s, d), "7")), "select trace_id, span_id, name from spans where trace_id = '7'")
add("trace_recent", lambda s, d: ids(t.started_between(spans(s, d), 980_000_000_000, 981_000_000_000)), "select trace_id, span_id, name from spans where trace_id in (select trace_id from spans where start between 980000000000 and 981000000000)")
add("span_compare_over_time", lambda s, d: t.compare_over_time(spans(s, d).where("name = 'order'").withColumns({"attributes": F.map_filter("attributes", lambda k, _: k == "priority")}), F.col("status") == "Error", GRID, 2), f""", x as (
select status = 'Error' as selected, {_STEP} as ts, unnest([{{'a': 'name', 'v': name}}, {{'a': 'status', 'v': status}}, {{'a': 'kind', 'v': 'Client'}}, {{'a': 'resource.service.name', 'v': service}}, {{'a': 'resource.status', 'v': service[8:]}}, {{'a': 'span.priority', 'v': priority}}]) as e from spans where name = 'order' and {_IN}),
c as (select selected, e.a as a, e.v as v, ts, count(*) as n from x group by 1, 2, 3, 4), f as (select selected, a, v from c group by 1, 2, 3 qualify row_number() over (partition by selected, a order by sum(n) desc, v) <= 2),
g as (select {GRID.start} + i * {GRID.step} as ts from generate_series(0, {GRID.points - 1}) as z(i))
select f.selected, f.a as attribute, f.v as val, g.ts, coalesce(c.n, 0) as n, coalesce(k.total, 0)::bigint as total from f cross join g left join c using (selected, a, v, ts) left join (select selected, a, ts, sum(n) as total from c group by 1, 2, 3) k using (selected, a, ts)""")
