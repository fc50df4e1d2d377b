"""Binary operators between vectors: arithmetic and comparison joins, set operators, info labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ieee, labels as lb

OPERATORS = ieee.ARITHMETIC | ieee.COMPARE


def match_key(on: list[str] | None = None, ignoring: list[str] | None = None) -> Column:
    """What two series must have in common: the labels named, or all but those and the name."""
    own = F.col("labels")
    return lb.key(lb.by(own, on) if on is not None else lb.without(own, ignoring or []))


def _checked(side: DataFrame, message: str) -> DataFrame:
    """side by its match key and point; the job fails where there is more than one row."""
    fail = F.raise_error(F.lit(message)).cast("double")
    each = side.groupBy("key", "ts").agg(F.any_value("labels").alias("labels"), F.any_value("value").alias("value"), F.count("*").alias("n"))
    return each.select("key", "ts", "labels", F.when(F.col("n") > 1, fail).otherwise(F.col("value")).alias("value"))


def binary(left: DataFrame, op: str, right: DataFrame, on: list[str] | None = None, ignoring: list[str] | None = None, group: str | None = None, include: list[str] | None = None, as_bool: bool = False) -> DataFrame:
    """left op right, matched by labels at each point; group `left` or `right` allows many on that side.

    Comparisons keep the left value where they hold, or give 0 and 1 with as_bool. A side that must be
    unique and isn't fails the job. include copies labels from the one side.
    """
    key = match_key(on, ignoring)
    many, one = (right, left) if group == "right" else (left, right)
    many, one = many.withColumn("key", key), one.withColumn("key", key)
    message = "found duplicate series for the match group; many-to-many matching not allowed: matching labels must be unique on one side"
    one = _checked(one, message)
    if group is None:
        many = _checked(many, message.replace("many-to-many matching not allowed: ", "multiple matches for labels: "))
    both = many.join(one.select("key", "ts", F.col("labels").alias("one_labels"), F.col("value").alias("one_value")), ["key", "ts"])
    a, b = (F.col("one_value"), F.col("value")) if group == "right" else (F.col("value"), F.col("one_value"))
    held = OPERATORS[op](a, b)
    drops_name = op in ieee.ARITHMETIC or as_bool
    if group is None:
        own = lb.by(F.col("labels"), on) if on is not None else (lb.without(F.col("labels"), ignoring or []) if drops_name or ignoring is not None else F.col("labels"))
        if not drops_name and on is None and not ignoring:
            own = F.col("labels")
    else:
        own = lb.nameless(F.col("labels")) if drops_name else F.col("labels")
        for name in include or []:
            own = lb.with_label(own, name, lb.label(F.col("one_labels"), name))
    if op in ieee.ARITHMETIC:
        return both.select(own.alias("labels"), "ts", held.cast("double").alias("value"))
    if as_bool:
        return both.select(own.alias("labels"), "ts", held.cast("double").alias("value"))
    return both.where(held).select(own.alias("labels"), "ts", a.alias("value"))


def with_scalar(vector: DataFrame, op: str, number: float | DataFrame, swapped: bool = False, as_bool: bool = False) -> DataFrame:
    """vector op number (number op vector if swapped); a frame (ts, value) gives a number for each point."""
    if isinstance(number, DataFrame):
        vector = vector.join(number.select("ts", F.col("value").alias("number")), "ts")
        n = F.col("number")
    else:
        n = F.lit(float(number))
    v = F.col("value")
    held = OPERATORS[op](n, v) if swapped else OPERATORS[op](v, n)
    own = lb.nameless(F.col("labels")).alias("labels")
    if op in ieee.ARITHMETIC or as_bool:
        return vector.select(own, "ts", held.cast("double").alias("value"))
    return vector.where(held).select("labels", "ts", "value")


def and_(left: DataFrame, right: DataFrame, on: list[str] | None = None, ignoring: list[str] | None = None) -> DataFrame:
    key = match_key(on, ignoring)
    return left.withColumn("key", key).join(right.select(key.alias("key"), "ts"), ["key", "ts"], "left_semi").select(*left.columns)


def unless(left: DataFrame, right: DataFrame, on: list[str] | None = None, ignoring: list[str] | None = None) -> DataFrame:
    key = match_key(on, ignoring)
    return left.withColumn("key", key).join(right.select(key.alias("key"), "ts"), ["key", "ts"], "left_anti").select(*left.columns)


def or_(left: DataFrame, right: DataFrame, on: list[str] | None = None, ignoring: list[str] | None = None) -> DataFrame:
    return left.unionByName(unless(right, left, on, ignoring), allowMissingColumns=True)


def or_all(arms: list[DataFrame], on: list[str] | None = None, ignoring: list[str] | None = None) -> DataFrame:
    """A chain of `or` in one pass: of each match key and point, the rows of the earliest arm."""
    every = reduce(DataFrame.unionByName, [a.select("labels", "ts", "value").withColumn("arm", F.lit(i)) for i, a in enumerate(arms)])
    first = F.min("arm").over(Window.partitionBy(match_key(on, ignoring), "ts"))
    return every.withColumn("first", first).where("arm = first").select("labels", "ts", "value")


def and_all(arms: list[DataFrame], on: list[str] | None = None, ignoring: list[str] | None = None) -> DataFrame:
    """A chain of `and`: the first arm's rows whose match key is in every arm at that point."""
    key = match_key(on, ignoring)
    others = reduce(DataFrame.unionByName, [a.select(key.alias("key"), "ts").withColumn("arm", F.lit(i)) for i, a in enumerate(arms[1:])])
    everywhere = others.groupBy("key", "ts").agg(F.count_distinct("arm").alias("n")).where(F.col("n") == len(arms) - 1)
    return arms[0].withColumn("key", key).join(everywhere, ["key", "ts"], "left_semi").select(*arms[0].columns)


def info(base: DataFrame, infos: DataFrame, identity: list[str] | None = None, include: list[str] | None = None, drop_unmatched: bool = False) -> DataFrame:
    """base with the labels of the info series that has the same identifying labels; base's own labels win."""
    names = identity or ["instance", "job"]
    key = lb.key(lb.by(F.col("labels"), names))
    extra = lb.without(F.col("labels"), names)
    if include:
        extra = lb.by(extra, include)
    found = infos.select(key.alias("key"), "ts", lb.canonical(extra).alias("extra"))
    per = found.groupBy("key", "ts").agg(F.collect_set(lb.key(F.col("extra"))).alias("seen"), F.any_value("extra").alias("extra"))
    fail = F.raise_error(F.lit("found conflicting info series for the same identity")).cast("map<string,string>")
    per = per.select("key", "ts", F.when(F.size("seen") > 1, fail).otherwise(F.col("extra")).alias("extra"))
    both = base.withColumn("key", key).join(per, ["key", "ts"], "inner" if drop_unmatched else "left")
    labels = F.when(F.col("extra").isNull(), F.col("labels")).otherwise(lb.merged(F.col("labels"), F.col("extra")))
    return both.select(labels.alias("labels"), "ts", "value")
