"""Shared pieces: words of texts, packed numbers, membership filters and joins that survive hot keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stored import stored

#: At most this many keys are ever broadcast by :func:`attach`.
HOT_KEYS = 10_000
#: Largest filter that :func:`filter_words` gives: 2**22 words of 64 bits, 32 MB of bits.
MAX_LOG2_WORDS = 22

def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser of hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random number for each byte at each of the first places of a string; later places use them times an odd number.
_TABLE = np.random.default_rng(20).integers(0, 1 << 63, (64, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hashes_of(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string's bytes: the sum of a random number for each byte and its place, mixed."""
    if not len(strings):
        return np.zeros(0, dtype=np.uint64)
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    values = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    ends = ends - ends[0]
    sizes = np.diff(ends)
    place = np.arange(len(values)) - np.repeat(ends[:-1], sizes)
    each = _TABLE[place & 63, values]
    if len(sizes) and sizes.max(initial=0) > 64:
        each = each * (2 * (place >> 6) + 1).astype(np.uint64)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(each, dtype=np.uint64)])
    return mixed(mixed(sums[ends[1:]] - sums[ends[:-1]]) + sizes.astype(np.uint64))


def planes(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes: planes that are alike compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplaned(packed: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(packed, dtype=np.uint8).reshape(width, -1).T).view(kind).ravel()


def packed_sorted(items: np.ndarray) -> bytes:
    """Sorted 64-bit items as the byte planes of their differences."""
    return planes(np.diff(items, prepend=np.uint64(0)).astype("<u8"))


def unpacked_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unplaned(packed, "<u8"), dtype=np.uint64)


#: Cells of a table of counts that are packed together, and the columns of such packs.
TOGETHER, PACKED_COUNTS = 1 << 13, "part int, cells binary, counts binary"


def packed_counts(cells: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Counts of different, sorted cells, packed by groups of cells."""
    parts, starts = np.unique(cells // TOGETHER, return_index=True)
    cuts = [*zip(starts.tolist(), [*starts.tolist(), len(cells)][1:], strict=True)]
    inside, counts = (cells % TOGETHER).astype("<u2"), counts.astype("<u4")
    arrays = [pa.array(parts.astype(np.int32)), *(pa.array([planes(x[a:b]) for a, b in cuts], pa.binary()) for x in (inside, counts))]
    return pa.RecordBatch.from_arrays(arrays, names=["part", "cells", "counts"])


def summed_cells(packs: DataFrame, n_cells: int, finish: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """A number for each cell: finish of the sums of packed counts (int64), by groups of cells.

    A task adds up the packs of its groups one after another, so it holds a number for each of its cells,
    however many packs there are; what reaches the driver has the size of the table, whatever the input.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, cells, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "cells", "counts")), strict=True):
                own = sums.setdefault(part, np.zeros(TOGETHER, dtype=np.int64))
                own[unplaned(cells, "<u2")] += unplaned(counts, "<u4")
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([finish(x).tobytes() for x in sums.values()], pa.binary())], names=["part", "done"])

    none = finish(np.zeros(TOGETHER, dtype=np.int64))
    out = np.tile(none, n_cells // TOGETHER)
    for row in packs.select("part", "cells", "counts").repartition("part").mapInArrow(add, "part int, done binary").collect():
        out[row["part"] * TOGETHER :][:TOGETHER] = np.frombuffer(row["done"], dtype=none.dtype)
    return out


def segment_of(items: np.ndarray, log2_segments: int) -> np.ndarray:
    return (items >> np.uint64(64 - log2_segments)).astype(np.int64) if log2_segments else np.zeros(len(items), dtype=np.int64)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_rows: int, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of batches with so many rows, and so many bytes in a string column, at most (a row at least)."""
    for whole in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(whole.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < whole.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = min(start + most_rows, max(start + 1, int(np.searchsorted(ends, before + most_bytes, "right"))))
            yield whole.slice(start, stop - start)
            start = stop
        pa.default_memory_pool().release_unused()


@dataclass
class Words:
    """The words of some strings, A-Z lower-cased, cut at ASCII white space; a null string has none."""

    words: pa.Array  # the different words
    code: np.ndarray  # of each word in the strings, its place among these
    sizes: np.ndarray  # words of each string

    @classmethod
    def of(cls, strings: pa.Array) -> Words:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(strings, "")))
        coded = lists.flatten().dictionary_encode()
        code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at an end gives an empty word
        if not real.all():
            kept = real[code]
            sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kept], minlength=len(sizes))
            code = (np.cumsum(real) - 1)[code[kept]]
            words = words.filter(pa.array(real))
        return cls(words, code, sizes)


def filter_words(n_keys: int) -> int:
    """log2 of the 64-bit words for n_keys: about 16 bits a key, within fixed bounds."""
    return min(MAX_LOG2_WORDS, max(10, (max(n_keys, 1) // 4).bit_length()))


def filter_cell(hashed: str, log2_words: int) -> list[Column]:
    """Word and two-bit mask that a 64-bit hash column has in a blocked Bloom filter."""
    return [
        F.expr(f"shiftrightunsigned({hashed}, {64 - log2_words})").alias("tw_word"),
        F.expr(f"shiftleft(1L, cast({hashed} & 63 as int)) | shiftleft(1L, cast(shiftright({hashed}, 6) & 63 as int))").alias("tw_mask"),
    ]


def members(keys: DataFrame, hashed: str, log2_words: int) -> DataFrame:
    """Blocked Bloom filter of a 64-bit hash column: at most 2**log2_words rows (tw_word, tw_bits)."""
    return keys.select(*filter_cell(hashed, log2_words)).groupBy("tw_word").agg(F.bit_or("tw_mask").alias("tw_bits"))


def repeats(hashes: DataFrame, hashed: str) -> tuple[DataFrame, int]:
    """Blocked Bloom filter of the 64-bit hashes that may occur more than once, and log2 of its words.

    The cells of 48 bits that hashes take are counted, combined before the shuffle; those taken twice or more
    make the filter, which has about 16 bits for each of them, within fixed bounds.
    """
    cells = hashes.select(F.expr(f"shiftrightunsigned({hashed}, 16)").alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    twice = stored(cells.where("n > 1").select("cell"), "cells")
    words = filter_words(twice.count())
    return stored(members(twice.select(_spread_cell("cell").alias("h")), "h", words), "repeats"), words


def _spread_cell(cell: str | Column) -> Column:
    return F.xxhash64(F.lit(5), cell)


def probed_repeats(rows: DataFrame, hashed: str, bloom: DataFrame, log2_words: int) -> DataFrame:
    """rows with tw_maybe: whether the filter of :func:`repeats` may hold the row's hash."""
    spread = rows.withColumn("tw_cell", _spread_cell(F.expr(f"shiftrightunsigned({hashed}, 16)")))
    return probed(spread, "tw_cell", bloom, log2_words).drop("tw_cell")


def probed(rows: DataFrame, hashed: str, bloom: DataFrame, log2_words: int) -> DataFrame:
    """rows with tw_maybe: whether the filter may hold the row's hash. The filter's size is bounded, so it is broadcast."""
    cells = rows.select("*", *filter_cell(hashed, log2_words))
    hit = F.coalesce(F.col("tw_bits").bitwiseAND(F.col("tw_mask")) == F.col("tw_mask"), F.lit(False))
    return cells.join(F.broadcast(bloom), "tw_word", "left").withColumn("tw_maybe", hit).drop("tw_word", "tw_mask", "tw_bits")


def likely_members(rows: DataFrame, key: str, keys: DataFrame, n_keys: int) -> DataFrame:
    """The rows whose key is in keys (same column name), and a few others, without a shuffle of rows."""
    words = filter_words(n_keys)
    hashed = lambda df: df.withColumn("tw_h", F.xxhash64(F.lit(7), key))
    return probed(hashed(rows), "tw_h", members(hashed(keys), "tw_h", words), words).where("tw_maybe").drop("tw_maybe", "tw_h")


def only_members(rows: DataFrame, key: str, keys: DataFrame, n_keys: int) -> DataFrame:
    """The rows whose key, not null, is in keys (distinct); others are sorted out by a filter before the shuffle."""
    return likely_members(rows, key, keys, n_keys).join(keys, key, "left_semi")


def without(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key is not in keys (distinct, same column name); only rows that may be in it are shuffled."""
    words = filter_words(keys.count())
    hashed = lambda df: df.withColumn("tw_h", F.xxhash64(F.lit(7), key))
    tried = probed(hashed(rows), "tw_h", members(hashed(keys), "tw_h", words), words).drop("tw_h")
    rest = tried.where("tw_maybe").drop("tw_maybe").join(keys, key, "left_anti")
    return tried.where(~F.col("tw_maybe")).drop("tw_maybe").unionByName(rest.select(*rows.columns))


def one_each(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """rows, of those whose key is in keys (distinct, same column name) one for each key, whichever comes first.

    Other rows are not shuffled, but for the few that a filter of the keys falsely holds.
    """
    n = keys.count()
    if not n:
        return rows
    words = filter_words(n)
    hashed = lambda df: df.withColumn("tw_h", F.xxhash64(F.lit(7), key))
    tried = probed(hashed(rows), "tw_h", members(hashed(keys), "tw_h", words), words).drop("tw_h")
    maybe = tried.where("tw_maybe").drop("tw_maybe")
    twins = maybe.join(keys, key, "left_semi").select(*rows.columns).dropDuplicates([key])
    return tried.where(~F.col("tw_maybe")).drop("tw_maybe").unionByName(maybe.join(keys, key, "left_anti").select(*rows.columns)).unionByName(twins)


def attach(rows: DataFrame, facts: DataFrame, key: str, weight: str, n_rows: int) -> DataFrame:
    """rows left-joined to facts, one fact a key; weight counts the rows that have the key.

    Keys with a ten-thousandth of all rows (at least 100 rows) are hot: there are at most HOT_KEYS
    of them, whatever the input, so their facts are broadcast. The other keys are small and are joined
    by a shuffle.
    """
    at_least = max(100, -(-n_rows // HOT_KEYS))
    hot = F.broadcast(facts.where(F.col(weight) >= at_least).withColumn("tw_hot", F.lit(True)))
    cold = facts.where(F.col(weight) < at_least)
    tried = rows.join(hot, key, "left")
    done = tried.where("tw_hot").drop("tw_hot")
    rest = tried.where("tw_hot is null").select(*rows.columns).join(cold, key, "left")
    return done.unionByName(rest)
