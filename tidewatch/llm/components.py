"""Connected components by alternating large and small stars, and runs of equal keys in sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stored import stored
from .common import attach


def _to_least(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the least b of each a as m, never above a."""
    edges = stored(edges, "edges")
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
    return attach(edges, stored(least, "least"), "a", "n", edges.count())


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for the nodes of edges (a, b): the smallest node that each reaches.

    Each round joins every node's larger neighbours to its least neighbour, then its smaller ones; rounds go
    on until nothing changes, as many as the logarithm of the longest chain. Nodes with very many
    neighbours are handled by :func:`attach`.
    """
    tidy = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = stored(tidy(edges), "edges")
    before, after = None, state(now)
    while before != after:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = tidy(_to_least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        small = _to_least(large)
        now = stored(tidy(small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b")))), "edges")
        before, after = after, state(now)
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


class Forest:
    """Union-find over 0..n-1 whose roots are the least members."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal long keys from sorted batches: several runs each, a run never in two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        if held and any(held[-1].column(k)[-1].as_py() != c[-1] for k, c in zip(keys, columns, strict=True)):
            change = np.zeros(batch.num_rows - 1, dtype=bool)
            for c in columns:
                change |= c[1:] != c[:-1]
            last = int(np.flatnonzero(change)[-1]) + 1 if change.any() else 0
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def bounds(columns: list[np.ndarray]) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    change = np.ones(len(columns[0]) + 1, dtype=bool)
    if len(columns[0]):
        change[1:-1] = False
        for c in columns:
            change[1:-1] |= c[1:] != c[:-1]
    return np.flatnonzero(change)
