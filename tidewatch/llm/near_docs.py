"""Near-duplicate documents: an exact Jaccard join of word shingles by parity sketches.

The shingles of a document are XORed into sketches: each shingle toggles one bit, so two sketches differ in
no more bits than their sets' symmetric difference has members. Documents are handled in bands of size,
each as wide as two similar sets can differ in size; within a band, sets similar enough differ in at most D
shingles. By hash, a band's shingles fall into D + m blocks, and each block keeps the XOR of its shingles'
64-bit hashes: a wide parity sketch. By the pigeonhole principle two similar sets agree in m blocks at
least, so they share one of the first D + 1 blocks of each in any common order. The order puts empty blocks
last, and before them blocks made of frequent shingles only (by a table of shingle counts of fixed size), so
passages that many documents share cost little. Documents that share a block's value are compared by their
bit sketches, and pairs whose sketches differ in few enough bits are verified on their whole sets.

Only connections matter, so equal sets are one class, a block's documents are compared with the first of
them, and later only those that are not yet connected are compared with each other. A key with many sets is
cut into blocks of sets in the order of their components, and each pair of its blocks is one piece of work, but
for pairs that lie in one component: no task holds more than two blocks.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stored import stored
from .common import PACKED_COUNTS, Words, attach, hashes_of, likely_members, mixed, only_members, packed_counts, slices, summed_cells
from .components import bounds, components, runs

WORDS = 5
#: Similarity as a fraction of whole numbers.
PART, WHOLE = 80, 100
CELLS = 1 << 20
SLICE_ROWS = 800
#: After the first pairs, so many nearest sets of each are compared in turn; in the end all that are not connected.
NEAREST = (4, None)
#: Sets of a key that are compared with each other in one task at most.
BLOCK = 4096
#: Pairs that a task gives on together.
PAIRS = 100_000


def _apart(total: int) -> int:
    """Most members of the symmetric difference of two similar sets with so many members together."""
    return total * (WHOLE - PART) // (WHOLE + PART)


class Bands:
    """Bands of set sizes; two similar sets meet in the band of the smaller."""

    def __init__(self) -> None:
        self.low = [1]
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, self.low[-1] * WHOLE // PART))
        self.high = [b - 1 for b in self.low[1:]]
        self.apart = [_apart(h + h * WHOLE // PART) for h in self.high]
        self.blocks = [d + 1 + -(-d * 15 // 100) for d in self.apart]
        self.words = [-(-4 * h // 64) for h in self.high]  # 64-bit words of a bit sketch

    def of(self, size: int) -> list[int]:
        """The band of a size, and those before it whose smaller sets may be similar."""
        own = bisect_right(self.low, size) - 1
        return [b for b in range(max(0, own - 3), own + 1) if size <= self.high[b] * WHOLE // PART]


BANDS = Bands()


class Sets:
    """The shingle sets of some texts, empty ones left out."""

    def __init__(self, texts: pa.Array) -> None:
        found = Words.of(texts)
        words = hashes_of(found.words)[found.code]
        n = max(0, len(words) - WORDS + 1)
        shingles = np.zeros(n, dtype=np.uint64)
        for k in range(WORDS):
            shingles = mixed(shingles + words[k : k + n] + np.uint64(k + 1))
        members, end = [], 0
        for size in found.sizes.tolist():
            start, end = end, end + size
            if size >= WORDS:
                members.append(np.unique(shingles[start : end - WORDS + 1]))
            else:  # the whole sequence
                whole = np.full(min(size, 1), size, dtype=np.uint64)
                for word in words[start:end]:
                    whole = mixed(whole * np.uint64(3) + word)
                members.append(whole)
        self.sizes = np.array([len(m) for m in members], dtype=np.int64)
        self.members = np.concatenate(members) if members else np.zeros(0, dtype=np.uint64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        filled = np.flatnonzero(self.sizes)
        spread = mixed(self.members + np.uint64(1))
        self.set_id = np.zeros(len(members), dtype=np.int64)
        if len(filled):
            both = np.add.reduceat(spread, self.starts[filled]) ^ (np.bitwise_xor.reduceat(mixed(spread), self.starts[filled]) * np.uint64(3))
            self.set_id[filled] = mixed(both + self.sizes[filled].astype(np.uint64)).view(np.int64)
        self.filled = filled

    def banded(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each of the rows with each of its bands."""
        pairs = [(r, b) for r in rows.tolist() for b in BANDS.of(int(self.sizes[r]))]
        return np.array([p[0] for p in pairs], dtype=np.int64), np.array([p[1] for p in pairs], dtype=np.int64)

    def _spread(self, rows: np.ndarray, bands: np.ndarray, seed: int, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Members of banded rows, each one's place within its row's width, and the starts of the rows' widths."""
        sizes = self.sizes[rows]
        item = np.arange(sizes.sum()) + np.repeat(self.starts[rows] - (np.cumsum(sizes) - sizes), sizes)
        members = self.members[item]
        salted = mixed(members + np.repeat(bands.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed), sizes))
        place = ((salted >> np.uint64(32)) * np.repeat(width.astype(np.uint64), sizes)) >> np.uint64(32)
        starts = np.cumsum(width) - width
        return members, place.astype(np.int64) + np.repeat(starts, sizes), starts

    def sketches(self, rows: np.ndarray, bands: np.ndarray) -> list[np.ndarray]:
        """Bit sketch of each banded row."""
        width = np.array([BANDS.words[b] for b in bands], dtype=np.int64)
        _, bit, starts = self._spread(rows, bands, 5, width * 64)
        out = np.zeros(width.sum(), dtype=np.uint64)
        np.bitwise_xor.at(out, bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64))
        return np.split(out.view(np.int64), (starts // 64)[1:]) if len(rows) else []

    def keys(self, rows: np.ndarray, bands: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each banded row the values of its first D + 1 blocks; with the number of the banded row."""
        width = np.array([BANDS.blocks[b] for b in bands], dtype=np.int64)
        members, place, starts = self._spread(rows, bands, 9, width)
        value = np.zeros(width.sum(), dtype=np.uint64)
        np.bitwise_xor.at(value, place, mixed(members + np.uint64(77)))
        often = np.full(len(value), 63, dtype=np.int64)  # an empty block is the most frequent
        np.minimum.at(often, place, counts[(members % np.uint64(CELLS)).astype(np.int64)])
        row = np.repeat(np.arange(len(rows)), width)
        block = np.arange(len(value)) - starts[row]
        key = mixed(value ^ mixed(block.astype(np.uint64) * np.uint64(64) + bands[row].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))
        # by row, frequency and key (its first 34 bits, then the block: an order that all sets of a band have in common)
        order = np.argsort(row.astype(np.uint64) << np.uint64(40) | often.astype(np.uint64) << np.uint64(34) | key >> np.uint64(30), kind="stable")
        take = order[(np.arange(len(order)) - starts[row]) <= np.array([BANDS.apart[b] for b in bands], dtype=np.int64)[row]]
        return key[take].view(np.int64), row[take]


def cell_levels(counts: DataFrame, total: int) -> np.ndarray:
    """How often the shingles of each cell occur, so many in total, as levels of powers of two over the mean.

    Tasks leave out the cells that hold at most twice their own mean: a cell's sum lacks at most twice the mean of
    all, so one with six times the mean is surely seen as frequent.
    """
    return summed_cells(counts, CELLS, lambda n: np.frexp(n / max(1.0, 4 * total / CELLS + 8))[1].clip(0, 40).astype(np.uint8)).astype(np.int64)


def _first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, band, set_id) sorted by key and set: pairs with a key's first set as `other`, and, with a null
    `other`, the rows of keys with three sets or more. Of a key only its first and its last set are held."""
    open_key, first_set, last_set, n = None, 0, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key, band, sets = (batch.column(c).to_numpy() for c in ("key", "band", "set_id"))
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (sets[1:] != sets[:-1])
        new[0] = open_key is None or key[0] != open_key or sets[0] != last_set
        key, band, sets = key[new], band[new], sets[new]
        if not len(key):
            continue
        starts = bounds([key])
        sizes = np.diff(starts)
        rank = np.arange(len(key)) - np.repeat(starts[:-1], sizes)
        first = np.repeat(sets[starts[:-1]], sizes)
        before = np.concatenate([[last_set], sets[:-1]]).astype(np.int64)
        if key[0] == open_key:
            rank[: sizes[0]] += n
            first[: sizes[0]] = first_set
        star, more, third = np.flatnonzero(rank > 0), np.flatnonzero(rank > 1), np.flatnonzero(rank == 2)
        at = np.concatenate([star, more, third, third])
        if len(at):
            own = np.concatenate([sets[star], sets[more], first[third], before[third]])
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(band[at]), pa.array(own), pa.concat_arrays([pa.array(first[star]), pa.nulls(len(at) - len(star), pa.int64())])], names=["key", "band", "set_id", "other"])
        open_key, first_set, last_set, n = key[-1], first[-1], sets[-1], int(rank[-1]) + 1


def _blocked(size: int):
    """From rows sorted by key and component: the rows with a block, of so many rows of one key at most."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, n, part, last = None, 0, TaskContext.get().partitionId() << 40, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            starts = bounds([key])
            sizes = np.diff(starts)
            place = np.arange(len(key)) - np.repeat(starts[:-1], sizes)
            if key[0] == open_key:
                place[: sizes[0]] += n
            begins = place % size == 0
            number = last + np.cumsum(begins)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part + number)], names=[*batch.schema.names, "block"])
            open_key, n, last = key[-1], int(place[-1]) + 1, int(number[-1])

    return block


def block_pairs(many: DataFrame, size: int) -> DataFrame:
    """The rows (key, band, set_id, component) with the pieces of work (block_a, block_b) that each is part of.

    A key of so many rows at most is one piece; a larger one has a piece for each pair of its blocks, and for
    each block itself, that has more than one component. Columns of many may stand in any order.
    """
    many = many.select("key", "band", "set_id", "component")  # as _blocked gives them on
    sizes = many.groupBy("key").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > size).select("key")
    small = many.join(large, "key", "left_anti").select("*", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("block_a"), F.lit(0).cast("long").alias("block_b"))
    ordered = many.join(large, "key", "left_semi").repartitionByRange("key", "component", "set_id").sortWithinPartitions("key", "component", "set_id")
    rows = stored(ordered.mapInArrow(_blocked(size), "key long, band int, set_id long, component long, block long"), "blocks")
    blocks = rows.groupBy("key", "block").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    a, b = (blocks.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("block", "low", "high"))) for x in "ab")
    work = a.join(b, "key").where((F.col("block_a") <= F.col("block_b")) & (F.least("low_a", "low_b") < F.greatest("high_a", "high_b")))
    work = work.select("key", "block_a", "block_b", F.explode(F.array_distinct(F.array("block_a", "block_b"))).alias("block"))
    return small.unionByName(rows.join(work, ["key", "block"]).select(*small.columns))


def _close(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.minimum(n, m) * WHOLE >= np.maximum(n, m) * PART


def _unconnected_pairs(most: int | None):
    """From rows sorted by pieces of work and block: pairs of a piece's sets, of both blocks if it has two, that are
    not connected and whose sketches are near; of each set with those after it, the nearest ones, so many at most
    (all if None)."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, held = [], [], 0

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(np.concatenate(v) if v else np.zeros(0, dtype=np.int64)) for v in (left, right)]
            left.clear()
            right.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["set_id", "other"])

        for table in runs(batches, ["key", "block_a", "block_b"]):
            table = table.combine_chunks()
            sets, parts, sizes, block = (table[c].to_numpy() for c in ("set_id", "component", "size", "block"))
            sketches = table.column("sketch").chunk(0)
            flat, offsets = sketches.values.to_numpy(), sketches.offsets.to_numpy()
            starts = bounds([table[c].to_numpy() for c in ("key", "block_a", "block_b")])
            for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False):
                if b - a < 2 or (parts[a:b] == parts[a]).all():
                    continue
                own = flat[offsets[a] : offsets[b]].reshape(b - a, -1).view(np.uint64)
                second = int(np.searchsorted(block[a:b], block[b - 1]))  # 0 if the piece has one block
                for x in range(second or b - a - 1):
                    f = max(second, x + 1)
                    y = f + np.flatnonzero((parts[a + f : b] != parts[a + x]) & _close(sizes[a + f : b], sizes[a + x]))
                    if not len(y):
                        continue
                    apart = np.bitwise_count(own[y] ^ own[x]).sum(axis=1)
                    near = apart <= (sizes[a + y] + sizes[a + x]) * (WHOLE - PART) // (WHOLE + PART)
                    y, apart = y[near], apart[near]
                    if most and len(y) > most:
                        y = y[np.argpartition(apart, most)[:most]]
                    if len(y):
                        left.append(np.full(len(y), sets[a + x]))
                        right.append(sets[a + y])
                        held += len(y)
                        if held > PAIRS:
                            yield flush()
                            held = 0
        yield flush()

    return pair


def near_docs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: its id, n_shingles and component_id.

    Sets of distinct five-word shingles link at a Jaccard similarity of 0.8 or more; component_id is the
    smallest id that a document reaches by links. A text with fewer words is one shingle; without words, or
    null, it links with nothing. Texts are read whole, however long; sketches grow with them. Rows with the same id and
    set are alike, repeated or not; of ties the smallest id names the component. A null id is never a component's
    unless all its ids are null. An empty table gives an empty result; other columns of docs are not read. Shingles
    and sets are told apart by 64 bits.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The documents' sets, and rows that count shingles by cell, many batches together."""
        seen, n = np.zeros(CELLS, dtype=np.int64), 0
        ids = pa.nulls(1)
        names = ["id", "size", "set_id", "bands", "sketches", "part", "cells", "counts"]

        def counted() -> pa.RecordBatch:
            cells = np.flatnonzero(seen > 2 * seen.mean())
            packed = packed_counts(cells, seen[cells])
            seen[:] = 0
            none = [pa.nulls(packed.num_rows, t) for t in (ids.type, pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int64())))]
            return pa.RecordBatch.from_arrays([*none, *packed.columns], names=names)

        for batch in slices(batches, "text", SLICE_ROWS):
            ids = batch.column("id")
            sets = Sets(batch.column("text"))
            row, band = sets.banded(sets.filled)
            sketches = sets.sketches(row, band)
            per_row = np.bincount(row, minlength=batch.num_rows)
            outer = pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32))
            inner = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sketches])]).astype(np.int32))
            values = pa.array(np.concatenate(sketches) if sketches else np.zeros(0, dtype=np.int64))
            no_counts = [pa.nulls(batch.num_rows, t) for t in (pa.int32(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sets.sizes), pa.array(sets.set_id), pa.ListArray.from_arrays(outer, pa.array(band.astype(np.int32))), pa.ListArray.from_arrays(outer, pa.ListArray.from_arrays(inner, values)), *no_counts],
                names=names,
            )
            np.add.at(seen, (sets.members % np.uint64(CELLS)).astype(np.int64), 1)
            n += len(sets.members)
            if n > 8 * CELLS:
                yield counted()
                n = 0
        if n:
            yield counted()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_ROWS):
            sets = Sets(batch.column("text"))
            once = np.unique(sets.set_id[sets.filled], return_index=True)[1]
            row, band = sets.banded(sets.filled[once])
            key, at = sets.keys(row, band, levels.value)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(band[at].astype(np.int32)), pa.array(sets.set_id[row[at]])], names=["key", "band", "set_id"])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_ROWS):
            sets = Sets(batch.column("text"))
            offsets = pa.array(np.append(sets.starts, len(sets.members)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets.set_id), pa.ListArray.from_arrays(offsets, pa.array(sets.members.view(np.int64)))], names=["id", "set_id", "members"])

    described = stored(rows.mapInArrow(describe, f"id {id_type}, size long, set_id long, bands array<int>, sketches array<array<long>>, {PACKED_COUNTS}"), "documents")
    about = described.where("size is not null").drop("part", "cells", "counts")
    counts = described.where("part is not null")
    levels = spark.sparkContext.broadcast(cell_levels(counts, about.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]))
    classes = about.where("size > 0").groupBy("set_id").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands"), F.any_value("sketches").alias("sketches"))
    classes = stored(classes, "classes")
    sketches = classes.select("set_id", "size", F.explode(F.arrays_zip("bands", "sketches")).alias("z")).select("set_id", "size", F.col("z.bands").alias("band"), F.col("z.sketches").alias("sketch"))
    dealt = rows.select("text").mapInArrow(emit, "key long, band int, set_id long").repartition("key").sortWithinPartitions("key", "set_id")
    met = stored(dealt.mapInArrow(_first_pairs, "key long, band int, set_id long, other long"), "met")

    def whole(ids: DataFrame) -> DataFrame:
        """The members of the sets with these ids."""
        chosen = lambda df: df.withColumn("chosen", F.xxhash64("set_id", "id"))
        wanted = stored(chosen(classes.select("set_id", F.col("least").alias("id")).join(ids.distinct(), "set_id", "left_semi")), "wanted")
        n = wanted.count()
        own = likely_members(rows, "id", wanted.select("id"), n).mapInArrow(shingles, f"id {id_type}, set_id long, members array<long>")
        own = only_members(chosen(own), "chosen", wanted.select("chosen").distinct(), n)
        return stored(own.dropDuplicates(["set_id"]).select("set_id", "members"), "members")

    def linked(pairs: DataFrame, own: DataFrame) -> DataFrame:
        """The pairs (set_id, other) that are similar indeed."""
        other = own.select(F.col("set_id").alias("other"), F.col("members").alias("others"))
        both = pairs.join(own, "set_id").join(other, "other")
        shared = F.size(F.array_intersect("members", "others"))
        return both.where(shared * (WHOLE + PART) >= PART * (F.size("members") + F.size("others"))).select(F.col("set_id").alias("a"), F.col("other").alias("b"))

    pairs = met.where("other is not null").select("band", "set_id", "other").dropDuplicates(["set_id", "other"])
    far = sketches.select(F.col("set_id").alias("other"), "band", F.col("size").alias("other_size"), F.col("sketch").alias("other_sketch"))
    apart = F.aggregate(F.zip_with("sketch", "other_sketch", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    near = (apart * (WHOLE + PART) <= (F.col("size") + F.col("other_size")) * (WHOLE - PART)) & (F.least("size", "other_size") * WHOLE >= F.greatest("size", "other_size") * PART)
    pairs = stored(pairs.join(sketches, ["set_id", "band"]).join(far, ["other", "band"]).where(near).select("set_id", "other"), "pairs")
    own = whole(pairs.select(F.explode(F.array("set_id", "other")).alias("set_id")))
    edges = stored(linked(pairs, own), "edges")
    parts = stored(components(edges), "parts")

    def torn(rows: DataFrame) -> DataFrame:
        """The rows (key, band, set_id) whose key has more than one component, with it."""
        rows = stored(rows.join(parts.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id")), "placed")
        keys = rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where("x < y")
        return attach(rows, stored(keys.select("key", "n", F.lit(True).alias("torn")), "keys"), "key", "n", rows.count()).where("torn").drop("torn", "n")

    many = stored(torn(met.where("other is null").select("key", "band", "set_id")), "torn")
    own = whole(many.select("set_id"))
    for most in NEAREST:
        if many.isEmpty():
            break
        work = block_pairs(many, BLOCK).join(sketches, ["set_id", "band"]).select("key", "block_a", "block_b", "block", "set_id", "component", "size", "sketch")
        dealt = work.repartition("key", "block_a", "block_b").sortWithinPartitions("key", "block_a", "block_b", "block")
        found = dealt.mapInArrow(_unconnected_pairs(most), "set_id long, other long")
        found = found.select(F.least("set_id", "other").alias("set_id"), F.greatest("set_id", "other").alias("other")).distinct()
        new = stored(linked(stored(found, "pairs"), own), "edges")
        if not new.isEmpty():
            edges = edges.unionByName(new)
            parts = stored(components(edges), "parts")
            many = stored(torn(many.drop("component")), "torn")
    parts = parts.withColumnRenamed("node", "set_id")
    facts = classes.select("set_id", "n", "least").join(parts, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    least = facts.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = stored(facts.join(least, "component").select("set_id", "n", "component_id"), "facts")
    slim = about.select("id", "size", "set_id")
    known = attach(slim.where("size > 0"), facts, "set_id", "n", about.count()).select("id", "size", "component_id")
    alone = slim.where("size = 0").select("id", "size", F.col("id").alias("component_id"))
    return known.unionByName(alone).select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id")


def op8_near_docs(spark, sf_dir: str) -> DataFrame:
    return near_docs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
