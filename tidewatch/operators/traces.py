"""Trace queries: span sets, structure, per-trace aggregates and span metrics.

A span frame has trace_id, span_id, parent_id (empty for roots), name, service, kind, status, start (long,
milliseconds), duration (long), resource and attributes (map<string,string>). It may have status_message, scope_name,
scope_version and scope_attributes (of the instrumentation), events (array of structs of name, ts and attributes) and
links (array of structs of trace_id, span_id and attributes).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ieee, labels as lb
from ..plans.grid import Grid
from ..plans.stored import stored

ID = ["trace_id", "span_id"]
#: Columns that hold the attributes of a scope.
SCOPES = {"span": "attributes", "resource": "resource", "instrumentation": "scope_attributes", "parent": "parent.attributes", "parent.resource": "parent.resource"}


def attribute(name: str, scope: str = "span") -> Column:
    """An attribute of a scope (span, resource, instrumentation, or after :func:`with_parent` parent and
    parent.resource), for `any` of the span or else the resource; empty if missing."""
    if scope == "any":
        return F.coalesce(F.nullif(attribute(name, "span"), F.lit("")), attribute(name, "resource"))
    return lb.label(F.col(SCOPES[scope]), name)


def number(name: str, scope: str = "span") -> Column:
    return attribute(name, scope).try_cast("double")


def boolean(name: str, scope: str = "span") -> Column:
    """true or false as written; null for anything else."""
    text = attribute(name, scope)
    return F.when(text == "true", True).when(text == "false", False)


def exists(name: str, scope: str = "span") -> Column:
    """Whether an attribute is there (`!= nil`); a negation is `= nil`. Events and links count if any of theirs has it."""
    if scope in ("event", "link"):
        return any_nested(f"{scope}s", lambda x: F.map_contains_key(x["attributes"], F.lit(name)))
    return F.coalesce(F.map_contains_key(SCOPES[scope], F.lit(name)), F.lit(False))


def any_nested(nested: str, test: Callable[[Column], Column]) -> Column:
    """Whether any of a span's events or links (an array of structs with attributes) passes a test."""
    return F.coalesce(F.exists(nested, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))


def any_attribute(scope: str, name: str, test: Callable[[Column], Column]) -> Column:
    """Whether an attribute of any event or link passes a test; scope is `event` or `link`."""
    return any_nested(f"{scope}s", lambda x: F.map_contains_key(x["attributes"], F.lit(name)) & test(x["attributes"][name]))


def any_event(test: Callable[[Column, Column], Column]) -> Column:
    """Whether any event passes a test of its name and of the milliseconds since the span's start."""
    return any_nested("events", lambda e: test(e["name"], e["ts"] - F.col("start")))


def with_parent(spans: DataFrame) -> DataFrame:
    """Spans with `parent`, a struct of their parent's columns, null for roots and where it is missing."""
    own = [c for c in spans.columns if c != "parent"]
    parents = spans.select("trace_id", F.col("span_id").alias("parent_id"), F.struct(*own).alias("parent")).dropDuplicates(["trace_id", "parent_id"])
    return spans.select(own).join(parents, ["trace_id", "parent_id"], "left").select(*own, "parent")


def with_trace(spans: DataFrame) -> DataFrame:
    """Spans with root_name, root_service, trace_duration and child_count."""
    root = F.struct("start", "name", "service")
    traces = spans.groupBy("trace_id").agg(F.min(F.when(F.col("parent_id") == "", root)).alias("root"), (F.max(F.col("start") + F.col("duration")) - F.min("start")).alias("trace_duration"))
    children = spans.where("parent_id <> ''").groupBy("trace_id", F.col("parent_id").alias("span_id")).agg(F.count("*").alias("child_count"))
    both = spans.join(traces, "trace_id").join(children, ID, "left")
    return both.select(*spans.columns, F.coalesce("root.name", F.lit("")).alias("root_name"), F.coalesce("root.service", F.lit("")).alias("root_service"), "trace_duration", F.coalesce("child_count", F.lit(0)).alias("child_count"))


def paths(spans: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(trace_id, span_id, parent_id, above): the ids above each span that hangs from a root, nearest last; of those
    with ids in `of` only, if given.

    Only spans that have children are walked: each round doubles the stretch that is known above one, by a join; so
    the rounds are as many as the logarithm of the deepest trace's depth, which has no limit. What has reached its
    root is written once. The others, most of all, take the path of their parent. Spans whose chain breaks off or goes
    in a circle are left out.
    """
    slim = stored(spans.groupBy("trace_id", "span_id", "parent_id").agg(F.count("*").alias("n")), "spans")
    return _above(slim, slim if of is None else slim.join(of.select(ID).distinct(), ID, "left_semi")).where("above is not null").drop("n")


def _above(slim: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted spans with `above`, as :func:`paths` has it; null if they hang from no root. slim is stored, a row a span."""
    parents = slim.where("parent_id <> ''").select("trace_id", F.col("parent_id").alias("span_id")).distinct()
    none = F.array().cast("array<string>")
    state = stored(slim.drop("n").join(parents, ID, "left_semi").withColumns({"above": F.when(F.col("parent_id") == "", none).otherwise(F.array("parent_id")), "top": F.col("parent_id")}), "paths")
    done, rest = [state.where("top = ''")], state.where("top <> ''")
    open_, before = rest.count(), -1
    while open_ and open_ != before:  # where nothing more reaches its root, what is left goes in circles
        known = functools.reduce(DataFrame.unionByName, [*done, rest])
        up = known.select("trace_id", F.col("span_id").alias("top"), F.col("above").alias("more"), F.col("top").alias("next"))
        longer = stored(rest.join(up, ["trace_id", "top"]).select("trace_id", "span_id", "parent_id", F.concat("more", "above").alias("above"), F.col("next").alias("top")), "paths")
        done, rest = [*done, longer.where("top = ''")], longer.where("top <> ''")
        open_, before = rest.count(), open_
    up = functools.reduce(DataFrame.unionByName, done).select("trace_id", F.col("span_id").alias("parent_id"), F.array_append("above", F.col("span_id")).alias("above"))
    hung = wanted.where("parent_id <> ''").join(up, ["trace_id", "parent_id"], "left").select(*wanted.columns, "above")
    rest = wanted.where("parent_id = '' or parent_id is null").withColumn("above", F.when(F.col("parent_id") == "", none))
    return rest.unionByName(hung)


def _tree(spans: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """:func:`paths` of both sides' spans, in the traces that hold spans of both."""
    traces = left.select("trace_id").distinct().join(right.select("trace_id").distinct(), "trace_id")
    return stored(paths(spans.join(traces, "trace_id", "left_semi"), left.select(ID).unionByName(right.select(ID))), "tree")


def _related(tree: DataFrame, left: DataFrame, right: DataFrame, relation: str) -> DataFrame:
    """Pairs of ids (trace_id, span_id of right, left_id) in a relation, among spans that hang from a root."""
    mine = tree.join(right.select(ID).distinct(), ID, "left_semi")
    a = left.select("trace_id", F.col("span_id").alias("left_id")).distinct()
    hung = tree.join(left.select(ID).distinct(), ID, "left_semi")
    if relation == ">":  # right is a child of left
        return mine.select("trace_id", "span_id", F.col("parent_id").alias("left_id")).join(a, ["trace_id", "left_id"])
    if relation == ">>":
        return mine.select("trace_id", "span_id", F.explode("above").alias("left_id")).join(a, ["trace_id", "left_id"])
    if relation == "<":
        return hung.select("trace_id", F.col("parent_id").alias("span_id"), F.col("span_id").alias("left_id")).join(mine.select(ID), ID)
    if relation == "<<":
        return hung.select("trace_id", F.explode("above").alias("span_id"), F.col("span_id").alias("left_id")).join(mine.select(ID), ID)
    if relation == "~":
        # siblings need only one other of their parent's children, so two of them stand for all
        some = hung.groupBy("trace_id", "parent_id").agg(F.min("span_id").alias("x"), F.max("span_id").alias("y"))
        both = mine.join(some, ["trace_id", "parent_id"])
        other = F.when(F.col("x") != F.col("span_id"), F.col("x")).when(F.col("y") != F.col("span_id"), F.col("y"))
        return both.select("trace_id", "span_id", other.alias("left_id")).where("left_id is not null")
    raise ValueError(f"no such relation: {relation}")


def structural(spans: DataFrame, left: DataFrame, op: str, right: DataFrame) -> DataFrame:
    """Spans of right in a relation to one of left: `>` child, `>>` descendant, `<` parent, `<<` ancestor, `~`
    sibling; with `!` those in none; with `&` both sides' spans that take part."""
    tree = _tree(spans, left, right)
    pairs = _related(tree, left, right, op.lstrip("!&"))
    if op[0] == "!":
        return right.join(pairs.select(ID).distinct(), ID, "left_anti")
    found = right.join(pairs.select(ID).distinct(), ID, "left_semi")
    if op[0] == "&":
        if op[1:] == "~":
            pairs = _related(tree, right, left, "~").select("trace_id", F.col("span_id").alias("left_id"))
        lefts = left.join(pairs.select("trace_id", F.col("left_id").alias("span_id")).distinct(), ID, "left_semi")
        return both(found, lefts)
    return found


def both(left: DataFrame, right: DataFrame) -> DataFrame:
    """Spans of either set, once each."""
    return left.unionByName(right.join(left.select(ID), ID, "left_anti").select(left.columns))


def together(left: DataFrame, right: DataFrame) -> DataFrame:
    """Spans of either set in the traces that have spans of both."""
    traces = left.select("trace_id").distinct().join(right.select("trace_id").distinct(), "trace_id")
    return both(left, right).join(traces, "trace_id", "left_semi")


def where_aggregate(spans: DataFrame, how: str, op: str, value: float, of: Column | None = None, by: Column | None = None) -> DataFrame:
    """Spans of the sets (one a trace, or one for each of its groups) whose count, min, max, sum or avg compares so."""
    keys = ["trace_id"] + (["group"] if by is not None else [])
    rows = spans.withColumn("group", by) if by is not None else spans
    f = {"count": lambda: F.count("*").cast("double"), "min": lambda: F.min(of), "max": lambda: F.max(of), "sum": lambda: F.sum(of), "avg": lambda: F.avg(of)}[how]()
    kept = rows.groupBy(*keys).agg(f.cast("double").alias("aggregate")).where(ieee.COMPARE[op](F.col("aggregate"), F.lit(float(value))))
    return rows.join(kept, keys)


def newest_traces(spans: DataFrame, n: int) -> DataFrame:
    """Spans of the n traces that start last; of equal starts those with the smaller id."""
    top = spans.groupBy("trace_id").agg(F.min("start").alias("begin")).orderBy(F.desc("begin"), "trace_id").limit(n)
    return spans.join(top.select("trace_id"), "trace_id", "left_semi")


def trace(spans: DataFrame, trace_id: str) -> DataFrame:
    """The spans of a trace, by start; the filter reaches the scan."""
    return spans.where(F.col("trace_id") == trace_id).orderBy("start", "span_id")


def started_between(spans: DataFrame, first: int, last: int) -> DataFrame:
    """All spans of the traces that have a span started in these milliseconds."""
    return spans.join(spans.where(F.col("start").between(first, last)).select("trace_id").distinct(), "trace_id", "left_semi")


def coalesce(spans: DataFrame, of: Column | None = None) -> DataFrame:
    """Sets of a trace's groups put together again: a row for each trace, with its spans' ids and number, and sums."""
    return spans.groupBy("trace_id").agg(F.array_sort(F.collect_set("span_id")).alias("span_ids"), F.count_distinct("span_id").alias("spans"), F.sum(of if of is not None else F.lit(0)).cast("double").alias("total"))


def nested_sets(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, nested_left, nested_right, nested_parent): numbers of a walk in the order of the ids.

    A span's left number is one more than those that the walk passed before it; a root's parent is -1, a
    span that hangs from no root has zeros. Repeated spans are numbered once. All numbers come from orders of a trace's
    spans, so what is dealt by trace is not dealt again.
    """
    slim = stored(spans.groupBy("trace_id", "span_id", "parent_id").agg(F.count("*").alias("n")), "spans")
    place = F.array_join(F.array_append("above", F.col("span_id")), "\x01")
    each = _above(slim, slim).repartition("trace_id").select("trace_id", "span_id", "parent_id", "n", F.when(F.col("above").isNotNull(), F.size("above")).alias("depth"), place.alias("place"))
    trace = Window.partitionBy("trace_id", F.col("place").isNull())
    opened = F.row_number().over(trace.orderBy("place"))
    closed = F.row_number().over(trace.orderBy(F.concat("place", F.lit("\x01\U0010ffff"))))
    # at a span's left number the walk has left all that it opened before but those it is in, at its right number those alone are open
    numbered = each.withColumns({"nested_left": 2 * opened - 1 - F.col("depth"), "nested_right": 2 * closed + F.col("depth")})
    # a first child's left number follows its parent's
    first = F.min("nested_left").over(Window.partitionBy("trace_id", "parent_id"))
    known = numbered.withColumn("nested_parent", F.when(F.col("depth") > 0, first - 1).when(F.col("depth") == 0, -1))
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    return known.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select(*ID, number("nested_left"), number("nested_right"), number("nested_parent"))


def summaries(spans: DataFrame, matched: DataFrame) -> DataFrame:
    """A row for each trace with matched spans: its root, start, duration and number of matched spans."""
    counts = matched.groupBy("trace_id").agg(F.count("*").alias("matched"))
    # numbers are added up in hash tables before the shuffle; structs would have all spans sorted, so only roots are
    times = spans.groupBy("trace_id").agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("duration")) - F.min("start")).alias("duration"))
    roots = spans.where("parent_id = ''").groupBy("trace_id").agg(F.min(F.struct("start", "name", "service")).alias("root"))
    whole = counts.join(times, "trace_id").join(roots, "trace_id", "left")
    return whole.select("trace_id", F.coalesce("root.name", F.lit("")).alias("root_name"), F.coalesce("root.service", F.lit("")).alias("root_service"), "start", "duration", "matched")


# Metrics of spans: time goes in steps, and a step's point is its end.

def _stepped(spans: DataFrame, grid: Grid) -> DataFrame:
    kept = spans.where((F.col("start") > grid.start - grid.step) & (F.col("start") <= grid.end))
    return kept.withColumn("ts", (F.lit(grid.start) + F.ceil((F.col("start") - grid.start) / F.lit(grid.step)) * grid.step).cast("long"))


def metric(spans: DataFrame, how: str, grid: Grid, of: Column | None = None, by: dict[str, Column] | None = None) -> DataFrame:
    """rate, count_over_time, or min, max, sum, avg_over_time of a number, by groups: by's columns, ts, value."""
    rows = _stepped(spans, grid).withColumns(by or {})
    value = {
        "rate": lambda: F.count("*") / (grid.step / 1000.0), "count_over_time": lambda: F.count("*").cast("double"), "min_over_time": lambda: F.min(of).cast("double"),
        "max_over_time": lambda: F.max(of).cast("double"), "sum_over_time": lambda: F.sum(of).cast("double"), "avg_over_time": lambda: F.avg(of),
    }[how]()
    return rows.groupBy(*(by or {}), "ts").agg(value.alias("value")).where("value is not null")


def log2_bucket(value: Column) -> Column:
    """The power of two that a value of 2 or more lies at or below; null below 2."""
    return F.when(value >= 2, F.pow(F.lit(2.0), F.ceil(F.log2(value)).cast("double")))


def histogram_over_time(spans: DataFrame, grid: Grid, of: Column, by: dict[str, Column] | None = None) -> DataFrame:
    """Number of spans in each bucket of powers of two and step."""
    rows = _stepped(spans, grid).withColumns({**(by or {}), "bucket": log2_bucket(of)}).where("bucket is not null")
    return rows.groupBy(*(by or {}), "bucket", "ts").agg(F.count("*").cast("double").alias("value"))


def quantile_over_time(spans: DataFrame, grid: Grid, of: Column, phis: list[float], by: dict[str, Column] | None = None) -> DataFrame:
    """Quantiles from the buckets of powers of two, interpolated geometrically in the bucket: with a column p."""
    keys = [*(by or {}), "ts"]
    counts = histogram_over_time(spans, grid, of, by)
    order = Window.partitionBy(*keys).orderBy("bucket")
    ranked = counts.withColumns({"upto": F.sum("value").over(order), "total": F.sum("value").over(Window.partitionBy(*keys))})
    each = ranked.withColumn("p", F.explode(F.array(*map(F.lit, phis)))).withColumn("rank", F.col("p") * F.col("total"))
    hit = each.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("value") < F.col("rank")))
    share = (F.col("rank") - (F.col("upto") - F.col("value"))) / F.col("value")
    return hit.select(*keys, "p", (F.col("bucket") / 2 * F.pow(F.lit(2.0), share)).alias("value"))


def exact_quantile(spans: DataFrame, of: Column, phi: float, by: dict[str, Column] | None = None) -> DataFrame:
    return spans.withColumns(by or {}).groupBy(*(by or {})).agg(F.percentile(of, phi).alias("value"))


def second_stage(series: DataFrame, keys: list[str], top: int | None = None, bottom: int | None = None, op: str | None = None, value: float = 0.0) -> DataFrame:
    """The top or bottom series of each point, or those whose value compares so."""
    if op:
        return series.where(ieee.COMPARE[op](F.col("value"), F.lit(float(value))))
    w = Window.partitionBy("ts").orderBy(F.col("value").desc() if top else F.col("value").asc(), *keys)
    return series.withColumn("n", F.row_number().over(w)).where(F.col("n") <= (top or bottom)).drop("n")


def _pairs() -> Column:
    """A span's intrinsics and attributes as pairs (attribute, val)."""
    fixed = {"name": "name", "status": "status", "kind": "kind", "resource.service.name": "service"}

    def entries(column: str, prefix: str) -> Column:
        return F.transform(F.map_entries(column), lambda e: F.struct(F.concat(F.lit(prefix), e["key"]).alias("attribute"), e["value"].alias("val")))

    own = F.array(*(F.struct(F.lit(k).alias("attribute"), F.col(c).alias("val")) for k, c in fixed.items()))
    return F.concat(own, entries("resource", "resource."), entries("attributes", "span."))


def compare(spans: DataFrame, selection: Column, top: int = 10) -> DataFrame:
    """Counts of each attribute's most frequent values within a selection and outside it."""
    counts = spans.select(selection.alias("selected"), F.explode(_pairs()).alias("x")).groupBy("selected", "x.attribute", "x.val").agg(F.count("*").alias("n"))
    w = Window.partitionBy("selected", "attribute").orderBy(F.desc("n"), "val")
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).drop("place")


def compare_over_time(spans: DataFrame, selection: Column, grid: Grid, top: int = 10) -> DataFrame:
    """:func:`compare` for each step of a grid: selected, attribute, val, ts, n, and total, the spans with the attribute.

    The most frequent values are those of the whole grid; a step without one of them has n = 0.
    """
    rows = _stepped(spans, grid).select(selection.alias("selected"), "ts", F.explode(_pairs()).alias("x"))
    counts = rows.groupBy("selected", "x.attribute", "x.val", "ts").agg(F.count("*").alias("n"))
    each = ["selected", "attribute"]
    totals = counts.groupBy(*each, "ts").agg(F.sum("n").alias("total"))
    w = Window.partitionBy(*each).orderBy(F.desc("all"), "val")
    frequent = counts.groupBy(*each, "val").agg(F.sum("n").alias("all")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)
    steps = frequent.select(*each, "val", F.explode(F.sequence(F.lit(grid.start).cast("long"), F.lit(grid.end).cast("long"), F.lit(grid.step).cast("long"))).alias("ts"))
    found = steps.join(counts, [*each, "val", "ts"], "left").join(totals, [*each, "ts"], "left")
    return found.select(*each, "val", "ts", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0)).alias("total"))


def exemplars(spans: DataFrame, grid: Grid, each: int = 1) -> DataFrame:
    """A few spans of each step, the first by start and id."""
    w = Window.partitionBy("ts").orderBy("start", *ID)
    return _stepped(spans, grid).withColumn("n", F.row_number().over(w)).where(F.col("n") <= each).drop("n")


def tags(spans: DataFrame) -> DataFrame:
    """(scope, tag): names of attributes."""
    kinds = spans.select(F.map_keys("attributes").alias("span"), F.map_keys("resource").alias("resource")).distinct()
    named = lambda scope: F.transform(F.coalesce(scope, F.array().cast("array<string>")), lambda k: F.struct(F.lit(scope).alias("scope"), k.alias("tag")))
    return kinds.select(F.inline(F.concat(named("span"), named("resource")))).distinct()


def tag_values(spans: DataFrame, name: str, scope: str = "span") -> DataFrame:
    return spans.where(exists(name, scope)).select(attribute(name, scope).alias("val")).distinct()
