"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Vectors of length one are projected on random directions. Some directions, in groups, cut space into cells,
several times over. Within a cell every further projection is sorted, each vector as query gets the window of
ranks that lie around its own projection, and for each pair the projections whose window holds the other are
counted. Pairs with enough collisions are verified by their cosine. The window, the count and the number of
cuttings follow from the recall asked for at the threshold itself, which pairs lose only by being cut apart or by
too few collisions; more similar pairs are found more surely. Equal vectors are one class from the start. A cell
with very many vectors is handled in pairs of blocks, so no task gets it whole. Links are counted where they are
found, in the first cutting that two vectors share, and never listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, comb, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stored import stored
from .common import attach, mixed
from .components import Forest, bounds, components, runs

#: Vectors of a cell compared in one task; vectors that a cell should have; width of a cell's side.
BLOCK, CELL, SIDE = 2048, 128, 2.0
#: Further projections, and the share of them that a pair at the threshold meets in.
PROJECTIONS, MEETING = 24, 0.9
#: Queries that are looked at together.
QUERIES = 128


def directions(raw: np.ndarray) -> np.ndarray:
    """The vectors at length one; scaled by the largest component first, so that squares neither overflow nor vanish."""
    scaled = raw / np.abs(raw).max(axis=1, initial=0.0)[:, None]
    return scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]


@dataclass
class Cuttings:
    """Directions, offsets, window and count that fit a threshold and a number of vectors."""

    threshold: float
    cells: np.ndarray  # cuttings x directions x dimensions
    offsets: np.ndarray
    lines: np.ndarray  # further directions x dimensions
    window: float
    count: int

    @classmethod
    def fitting(cls, n: int, dimensions: int, threshold: float, recall: float, seed: int = 17) -> Cuttings:
        near, far = sqrt(2 - 2 * threshold), sqrt(2.0)
        together = lambda d: erf(SIDE / d / sqrt(2)) - 2 * d / (sqrt(2 * pi) * SIDE) * (1 - exp(-((SIDE / d) ** 2) / 2))
        sides = max(1, ceil(log(max(n, 1) / CELL) / -log(together(far)))) if n > CELL else 1
        tables = max(1, ceil(log(1 - sqrt(recall)) / log(1 - together(near) ** sides)))
        low, high = 0.0, 10.0
        for _ in range(60):  # the window in which a pair at the threshold meets so often
            middle = (low + high) / 2
            low, high = (middle, high) if erf(middle / near / sqrt(2)) < MEETING else (low, middle)
        count = max(k for k in range(PROJECTIONS + 1) if sum(comb(PROJECTIONS, j) * MEETING**j * (1 - MEETING) ** (PROJECTIONS - j) for j in range(k, PROJECTIONS + 1)) >= sqrt(recall))
        random = np.random.default_rng(seed)
        return cls(threshold, random.normal(size=(tables, sides, dimensions)), random.uniform(0, SIDE, (tables, sides)), random.normal(size=(PROJECTIONS, dimensions)), high, count)

    def cell_of(self, unit: np.ndarray) -> np.ndarray:
        """A number of each vector's cell in each cutting."""
        at = np.floor((np.einsum("nd,tsd->nts", unit, self.cells) + self.offsets) / SIDE).astype(np.int64)
        out = np.zeros(at.shape[:2], dtype=np.uint64)
        for s in range(at.shape[2]):
            out = mixed(out * np.uint64(3) + at[:, :, s].astype(np.uint64))
        return out.view(np.int64)

    def collisions(self, lines: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows, of left and right, that collide on enough projections (lines: a column for each)."""
        ranks = np.empty((lines.shape[1], len(right)), dtype=np.uint16)
        low, wide = (np.empty((lines.shape[1], len(left)), dtype=np.uint16) for _ in range(2))
        for k in range(lines.shape[1]):
            order = np.argsort(lines[right, k], kind="stable")
            ranks[k, order] = np.arange(len(right))
            line = lines[right[order], k]
            low[k] = np.searchsorted(line, lines[left, k] - self.window, "left")
            wide[k] = np.searchsorted(line, lines[left, k] + self.window, "right") - low[k]
        for i in range(0, len(left), QUERIES):
            met = np.zeros((len(left[i : i + QUERIES]), len(right)), dtype=np.uint8)
            for k in range(lines.shape[1]):  # a rank below the window's wraps around and is no less than its width
                met += ranks[k] - low[k, i : i + QUERIES, None] < wide[k, i : i + QUERIES, None]
            x, y = np.nonzero(met >= self.count)
            yield left[i + x], right[y]

    def links(self, raw: np.ndarray, cutting: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows, of left and right (or within left, if they are the same), that are first met in this cutting."""
        unit = directions(raw)
        norm = np.sqrt((unit * unit).sum(axis=1))
        found_a, found_b = [], []
        for x, y in self.collisions(unit @ self.lines.T, left, right):
            if left is right:
                x, y = x[x < y], y[x < y]
            ok = (unit[x] * unit[y]).sum(axis=1) / (norm[x] * norm[y]) >= self.threshold
            found_a.append(x[ok])
            found_b.append(y[ok])
        x, y = (np.concatenate(f) if f else np.zeros(0, dtype=np.int64) for f in (found_a, found_b))
        if cutting and len(x):
            cells = self.cell_of(unit)
            new = ~(cells[x, :cutting] == cells[y, :cutting]).any(axis=1)
            x, y = x[new], y[new]
        return x, y


def near_vectors(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each row of vectors: its id, n_links, component_id and kept.

    Vectors link at a cosine, in double precision, of the threshold or more. Null or zero vectors, and those
    with a null or non-finite component, or of another length than most, link with nothing. n_links counts
    other rows, copies included; equal vectors (rows repeated, or ties) are linked without being compared. kept marks
    the component's smallest id; rows with the same id are alike. recall is what a pair exactly at the threshold is
    found with, in expectation. Vectors may have any length, of which one task holds two blocks. An empty table gives an empty
    result; other columns are not read.
    """
    v = F.col("v")
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind, number = ("<f4", "float") if single else ("<f8", "double")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{number}>").alias("v"))
    sound = v.isNotNull() & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)) & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(sound, F.lit(False)))
    size = rows.where("ok").groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    dimensions = size["d"] if size else 1
    rows = rows.withColumn("ok", F.col("ok") & (F.size("v") == dimensions) & F.col("id").isNotNull())
    key = F.concat_ws("/", F.xxhash64("v").cast("string"), F.xxhash64(F.lit(1), "v").cast("string"))
    rows = rows.withColumn("key", F.when(F.col("ok"), key))
    classes = stored(rows.where("ok").groupBy("key").agg(F.min("id").alias("node"), F.count("*").alias("size"), F.any_value("v").alias("v")), "classes")
    n = classes.count()
    cuttings = Cuttings.fitting(n, dimensions, threshold, recall)
    given = vectors.sparkSession.sparkContext.broadcast(cuttings)
    # vectors travel as the bytes of their own numbers
    matrix = lambda column: np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, dimensions).astype(np.float64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                numbers = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dimensions)
                cells = given.value.cell_of(directions(numbers.astype(np.float64)))
                tables = cells.shape[1]
                each = pa.array(np.repeat(np.arange(len(numbers)), tables))
                packed = pa.array([x.tobytes() for x in numbers], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.take(each) for c in (batch.column("node"), batch.column("size"), packed)), pa.array(np.tile(np.arange(tables), len(numbers)).astype(np.int64)), pa.array(cells.ravel())], names=["node", "size", "v", "cutting", "cell"])

    placed = classes.select("node", "size", "v").mapInArrow(cut, "node long, size long, v binary, cutting long, cell long")
    placed = placed.withColumn("spot", F.xxhash64("cutting", "cell"))
    counts = stored(placed.groupBy("spot").agg(F.count("*").alias("k")).where("k > 1"), "cells")
    placed = attach(placed, counts, "spot", "k", n * len(cuttings.cells)).where("k > 1")
    n_blocks = F.ceil(F.col("k") / BLOCK)
    placed = placed.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "node"), n_blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)))
    placed = placed.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    keys = ["spot", "low", "high"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, keys):
            table = table.combine_chunks()
            raw, nodes, sizes = matrix(table.column("v")), table["node"].to_numpy(), table["size"].to_numpy()
            block, low, high, cutting = (table[c].to_numpy() for c in ("block", "low", "high", "cutting"))
            starts = bounds([table[k].to_numpy() for k in keys])
            links, up = np.zeros(len(raw), dtype=np.int64), np.arange(len(raw))
            for a, b in zip(starts, starts[1:], strict=False):
                if b - a < 2:
                    continue
                left = np.arange(b - a) if low[a] == high[a] else np.flatnonzero(block[a:b] == low[a])
                right = left if low[a] == high[a] else np.flatnonzero(block[a:b] == high[a])
                x, y = given.value.links(raw[a:b], int(cutting[a]), left, right)
                np.add.at(links, a + x, sizes[a + y])
                np.add.at(links, a + y, sizes[a + x])
                forest = Forest(b - a)
                for i, j in zip(x.tolist(), y.tolist(), strict=True):
                    forest.join(i, j)
                up[a:b] = [a + forest.root(i) for i in range(b - a)]
            found = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[found]), pa.array(links[found]), pa.array(nodes[up[found]])], names=["node", "links", "root"])

    dealt = placed.select("node", "size", "v", "cutting", "block", *keys).repartition(*keys).sortWithinPartitions(*keys)
    found = stored(dealt.mapInArrow(link, "node long, links long, root long"), "links")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    facts = classes.select("key", "node", "size").join(linked, "node", "left").join(joined, "node", "left")
    facts = facts.select("key", "size", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    slim = stored(rows.select("id", "key"), "keys")
    known = attach(slim.where("key is not null"), stored(facts, "facts"), "key", "size", slim.count()).drop("key", "size")
    rest = slim.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = known.unionByName(rest).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    return out.withColumnRenamed("id", id_col)


def op6_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
