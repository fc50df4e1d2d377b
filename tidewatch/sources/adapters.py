"""The example tables as samples, logs and spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import NAME


def epoch_ms(column: str) -> Column:
    """Milliseconds of a timestamp; the session's time zone must be UTC."""
    return F.unix_millis(F.col(column).cast("timestamp"))


def labelled(name: str | None = None, **columns: str) -> Column:
    """A label map from columns, with a metric's name."""
    pairs = [(NAME, F.lit(name))] if name else []
    pairs += [(k, F.coalesce(F.col(c).cast("string"), F.lit(""))) for k, c in columns.items()]
    return F.create_map(*(x for k, v in pairs for x in (F.lit(k), v)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_samples(spark: SparkSession, sf_dir: str, name: str = "event_value", **labels: str) -> DataFrame:
    """`events` as samples of one metric; labels maps label names to columns."""
    columns = labels or {"event_type": "event_type", "user": "user_id"}
    return table(spark, sf_dir, "events").select(labelled(name, **columns).alias("labels"), epoch_ms("ts").alias("ts"), "value")


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as log records: the JSON of props as the line, the type as stream label.

    Rows are dealt anew: a file's row group is one task, and a row's labels and fields cost far more than its shuffle.
    """
    return table(spark, sf_dir, "events").repartition("event_id").select(
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
        F.col("props").alias("line"),
        labelled(event_type="event_type").alias("resource"),
        labelled(user="user_id").alias("attributes"),
        F.when(F.col("event_type") == "error", "ERR").otherwise("Information").alias("severity"),
    )


def document_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as log records: a line for each text, its source and language as stream labels."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ts"), F.coalesce("text", F.lit("")).alias("line"), labelled(source="source", lang="lang").alias("resource"),
        labelled(id="doc_id").alias("attributes"), F.lit("").alias("severity"),
    )


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as traces: a root span for each, its orders as children, their line items as grandchildren."""
    columns = ["trace_id", "span_id", "parent_id", "name", "service", "kind", "status", "start", "duration", "resource", "attributes"]
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("trace_id"), F.concat(F.lit("c"), "c_custkey").alias("span_id"), F.lit("").alias("parent_id"),
        F.lit("customer").alias("name"), F.concat(F.lit("nation-"), "c_nationkey").alias("service"), F.lit("Server").alias("kind"), F.lit("Unset").alias("status"),
        F.lit(788918400000).cast("long").alias("start"), F.lit(0).cast("long").alias("duration"),
        labelled(segment="c_mktsegment").alias("resource"), labelled(balance="c_acctbal").alias("attributes"),
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("trace_id"), F.concat(F.lit("o"), "o_orderkey").alias("span_id"), F.concat(F.lit("c"), "o_custkey").alias("parent_id"),
        F.lit("order").alias("name"), F.concat(F.lit("status-"), "o_orderstatus").alias("service"), F.lit("Client").alias("kind"), F.when(F.col("o_orderstatus") == "F", "Error").otherwise("Ok").alias("status"),
        epoch_ms("o_orderdate").alias("start"), F.col("o_totalprice").cast("long").alias("duration"),
        labelled(status="o_orderstatus").alias("resource"), labelled(priority="o_orderpriority", price="o_totalprice").alias("attributes"),
    )
    # orders are hashed, a quarter of the items, so that no task sorts its items
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("string").alias("trace_id"), F.concat_ws("-", F.lit("l"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("span_id"), F.concat(F.lit("o"), "l_orderkey").alias("parent_id"),
        F.lit("item").alias("name"), F.concat(F.lit("flag-"), "l_returnflag").alias("service"), F.lit("Internal").alias("kind"), F.when(F.col("l_returnflag") == "R", "Error").otherwise("Ok").alias("status"),
        epoch_ms("l_shipdate").alias("start"), F.col("l_extendedprice").cast("long").alias("duration"),
        labelled(flag="l_returnflag").alias("resource"), labelled(quantity="l_quantity", supplier="l_suppkey").alias("attributes"),
    )
    return customers.select(columns).unionByName(orders.select(columns)).unionByName(items.select(columns))


def orders_with_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as spans of their customers' traces, with their line items as events, a link to the customer and a scope."""
    attributes = lambda **columns: labelled(**columns)
    event = F.struct(F.concat(F.lit("ship-"), "l_linestatus").alias("name"), epoch_ms("l_shipdate").alias("ts"), attributes(flag="l_returnflag", quantity="l_quantity").alias("attributes"))
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(event).alias("events"))
    orders = order_spans(spark, sf_dir).where("name in ('order', 'customer')").withColumn("l_orderkey", F.expr("try_cast(substr(span_id, 2) as bigint)"))
    link = F.struct("trace_id", F.concat(F.lit("c"), "trace_id").alias("span_id"), F.create_map(F.lit("cause"), F.col("status")).alias("attributes"))
    orders_only = F.col("name") == "order"
    both = orders.join(items.withColumn("name", F.lit("order")), ["l_orderkey", "name"], "left").drop("l_orderkey")
    return both.withColumns({
        "events": F.coalesce("events", F.expr("cast(array() as array<struct<name:string,ts:bigint,attributes:map<string,string>>>)")),
        "links": F.when(orders_only, F.array(link)).otherwise(F.expr("cast(array() as array<struct<trace_id:string,span_id:string,attributes:map<string,string>>>)")),
        "scope_name": F.when(orders_only, "orders").otherwise("customers"), "scope_version": F.lit("1.2"),
        "scope_attributes": F.create_map(F.lit("kind"), F.col("kind")), "status_message": F.when(F.col("status") == "Error", F.concat(F.lit("failed "), "span_id")).otherwise(""),
    })


def increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a counter of each type that is stored as increases: the values of one millisecond added."""
    each = table(spark, sf_dir, "events").groupBy("event_type", epoch_ms("ts").alias("ts")).agg(F.sum("value").alias("value"))
    return each.select(labelled("event_total", event_type="event_type").alias("labels"), "ts", "value")
