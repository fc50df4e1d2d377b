"""Discovery: names and values of labels, series, volumes, detected fields, line templates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as lb


def within(samples: DataFrame, first: int, last: int) -> DataFrame:
    """Samples or log lines of a stretch of time, ends included; the filter reaches the scan."""
    return samples.where(F.col("ts").between(first, last))


def label_names(samples: DataFrame) -> DataFrame:
    return samples.select(F.explode(F.map_keys("labels")).alias("label")).distinct()


def label_values(samples: DataFrame, name: str) -> DataFrame:
    return samples.select(lb.label(F.col("labels"), name).alias("val")).where("val <> ''").distinct()


def series(samples: DataFrame) -> DataFrame:
    """Each series once, as the canonical text of its labels."""
    return samples.select(lb.key(F.col("labels")).alias("series")).distinct()


def stats(logs: DataFrame) -> DataFrame:
    """Streams, entries and bytes of a log frame."""
    return logs.agg(F.count_distinct(lb.key(F.col("labels"))).alias("streams"), F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length("line")), F.lit(0)).cast("long").alias("bytes"))


def volume(logs: DataFrame, names: list[str], top: int = 100) -> DataFrame:
    """Bytes of the largest groups of streams by labels."""
    by = [lb.label(F.col("labels"), n).alias(n) for n in names]
    return logs.groupBy(*by).agg(F.sum(F.octet_length("line")).cast("long").alias("bytes")).orderBy(F.desc("bytes"), *names).limit(top)


def detected_fields(logs: DataFrame) -> DataFrame:
    """Name, type and approximate number of values of each label: int, float, boolean, duration, bytes or string."""
    each = logs.select(F.explode("labels").alias("field", "val"))
    test = {"int": r"^[-+]?\d+$", "float": r"^[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?$", "boolean": r"^(?:true|false)$", "duration": r"^(?:\d+(?:\.\d+)?(?:ns|us|µs|ms|s|m|h))+$", "bytes": r"^\d+(?:\.\d+)?\s?(?:[kKMGTP]i?)?B$"}
    all_ = each.groupBy("field").agg(F.approx_count_distinct("val").alias("cardinality"), *(F.min(F.col("val").rlike(p)).alias(k) for k, p in test.items()))
    kind = F.lit("string")
    for k in reversed(test):
        kind = F.when(F.col(k), k).otherwise(kind)
    return all_.select("field", kind.alias("kind"), "cardinality")


class Templates:
    """Line templates by a tree of fixed depth: length, first words, then the most similar template."""

    def __init__(self, depth: int, similarity: float, children: int) -> None:
        self.depth, self.similarity, self.children = depth, similarity, children
        self.tree: dict = {}
        self.found: list[list] = []  # words, count

    def add(self, words: list[str], n: int = 1) -> None:
        node = self.tree.setdefault(len(words), {})
        for word in words[: self.depth - 2]:
            if any(c.isdigit() for c in word) or (word not in node and len(node) >= self.children):
                word = "<_>"
            node = node.setdefault(word, {})
        group = node.setdefault("", [])
        best, most = None, -1.0
        for template in group:
            same = sum(a == b for a, b in zip(template[0], words, strict=True)) / max(len(words), 1)
            if same > most:
                best, most = template, same
        if best is None or most < self.similarity:
            best = [list(words), 0]
            group.append(best)
            self.found.append(best)
        else:
            best[0] = [a if a == b else "<_>" for a, b in zip(best[0], words, strict=True)]
        best[1] += n


def templates(logs: DataFrame, depth: int = 4, similarity: float = 0.4, children: int = 100, at_least: int = 30) -> DataFrame:
    """(level, template, n): templates of lines mined level by level, those with at_least lines.

    Words with digits are masked first, and equal lines are counted by Spark, so mining sees each kind of line once.
    Kinds are mined in their own order, by level, number of words and first word, so the result does not depend on
    how lines lie in partitions.
    """
    masked = F.transform(F.split(F.trim("line"), r"\s+"), lambda w: F.when(w.rlike(r"\d"), "<_>").otherwise(w))
    rows = logs.select(lb.label(F.col("labels"), "detected_level").alias("level"), masked.alias("words"))
    kinds = rows.groupBy("level", F.array_join("words", " ").alias("line")).agg(F.count("*").alias("n"))
    kinds = kinds.withColumns({"words": F.size(F.split("line", " ")), "head": F.substring_index("line", " ", 1)})

    def mine(frame: pd.DataFrame) -> pd.DataFrame:
        found = Templates(depth, similarity, children)
        for line, n in sorted(zip(frame["line"], frame["n"], strict=True)):
            found.add(line.split(), n)
        return pd.DataFrame([(frame["level"].iloc[0], " ".join(t[0]), t[1]) for t in found.found], columns=["level", "template", "n"])

    merged = kinds.groupBy("level", "words", "head").applyInPandas(mine, "level string, template string, n long")
    return merged.groupBy("level", "template").agg(F.sum("n").alias("n")).where(F.col("n") >= at_least)
