"""Removing lines that nearly repeat an earlier line: an exact set-similarity join.

A line is the set of its words. Words are ordered by rarity, from a table of word counts of fixed size, kept
as levels of a sixth of an octave (words of one level tie; any common order gives right results). Two sets
with a Jaccard similarity of t or more share a word among the first n - ceil(t * n) + 1 of each: these prefixes
are dealt by word, and a word's lines are compared under the length and the positional filter, then by parity
sketches that are as wide as the lines are long and whose Hamming distance never exceeds the sets' symmetric
difference. Candidates are verified on their whole sets. A line goes if it matches any line that stands earlier,
in the order of document ids and line numbers; equal sets match, so of a set's lines only the first can stay.

Of the earlier lines that a line may match, the nearest by sketch is verified, then a few more; a line that has
still more, and that these did not decide, is compared with all of them afterwards. A word in very many prefixes is cut into blocks
of lines by hash, and each pair of its blocks is dealt by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ieee import let
from ..plans.stored import stored
from .common import PACKED_COUNTS, Words, attach, filter_words, hashes_of, likely_members, members, mixed, only_members, packed_counts, packed_sorted, planes, probed, segment_of, slices, summed_cells, unpacked_sorted, unplaned
from .components import bounds

THRESHOLD = 0.8
#: Cells of the table of word counts, and levels to an octave of counts.
CELLS, OCTAVE = 1 << 22, 6
#: Earlier lines under a word that a line is verified against at first, if the nearest is near and if it is not.
FEW, MANY = 64, 2000
#: Lines of a word that are compared in one piece; words that are cut into such blocks, the most frequent ones.
BLOCK, HOT_WORDS = 2048, 10_000
#: Widest sketch in 64-bit words, pairs that are looked at together, documents that are parsed together.
WIDEST, PAIRS, SLICE_ROWS = 64, 1 << 17, 500
#: log2 of the postings that a segment has at most on average, segments in a partition; how columns of postings are packed.
LOG2_POSTINGS, SEGMENTS = 17, 2
POSTING = {"key": "", "doc": "<i8", "line": "<i4", "set_id": "<i8", "about": "<i8", "sketch": ""}


class Lines:
    """The non-blank lines of some texts as sets of words, each set ordered by rarity."""

    def __init__(self, texts: pa.Array, levels: np.ndarray | None = None) -> None:
        lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
        per_text = lines.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        found = Words.of(lines.flatten())
        filled = np.flatnonzero(found.sizes)
        self.text = np.repeat(np.arange(len(texts)), per_text)[filled]
        self.line = (np.arange(len(found.sizes)) - np.repeat(np.cumsum(per_text) - per_text, per_text))[filled].astype(np.int32)
        sizes = found.sizes[filled]
        hashes = hashes_of(found.words)
        self.counts = hashes, np.bincount(found.code, minlength=len(hashes))
        cells = (hashes & np.uint64(CELLS - 1)).astype(np.int64)
        if levels is None:  # rarity in these texts only
            level = level_of(np.maximum(self.counts[1], 1))
            order = np.argsort(level, kind="stable")
        else:
            level = levels[cells]
            order = np.lexsort([hashes, level])
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        many = max(len(order), 1)
        line = np.repeat(np.arange(len(sizes)), sizes)
        pairs = np.sort(line * many + rank[found.code])
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
        of, rank = pairs // many, pairs % many
        self.words, self.levels, self.of = hashes[order][rank], level[order][rank], of
        self.starts = np.searchsorted(of, np.arange(len(sizes)))
        self.sizes = np.diff(np.append(self.starts, len(of)))
        self.spread = mixed(hashes)[order][rank]
        self.set_id = self.check = np.zeros(0, dtype=np.int64)
        if len(sizes):
            total, parity = np.add.reduceat(self.spread, self.starts), np.bitwise_xor.reduceat(mixed(self.spread), self.starts)
            own = self.sizes.astype(np.uint64)
            self.set_id = mixed(total ^ mixed(parity + own)).view(np.int64)
            self.check = mixed(parity ^ mixed(total + own * np.uint64(3))).view(np.int64)

    def firsts(self, doc: np.ndarray) -> np.ndarray:
        """The first line of each set, by document id and line number."""
        order = np.lexsort([self.line, doc])
        return order[np.unique(self.set_id[order], return_index=True)[1]]

    def prefix_lengths(self, rows: np.ndarray, threshold: float) -> np.ndarray:
        """Words of the rows' prefixes; a set so small that one word more makes another set of it has none."""
        sizes = self.sizes[rows]
        return np.where(sizes >= threshold * (sizes + 1) - 1e-9, sizes - np.ceil(threshold * sizes - 1e-9) + 1, 0).astype(np.int64)

    def prefixes(self, rows: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the rows' prefixes without words that stand once in all texts: row, place in the row's set, place in words."""
        length = self.prefix_lengths(rows, threshold)
        row = np.repeat(rows, length)
        place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        item = self.starts[row] + place
        shared = self.levels[item] > 1
        return row[shared], place[shared], item[shared]

    def sketches(self) -> np.ndarray:
        """All lines' sketches in their widths, one after another."""
        wide = widths(self.sizes)
        starts = np.cumsum(wide) - wide
        bit = (self.spread & (wide[self.of].astype(np.uint64) * np.uint64(64) - np.uint64(1))).astype(np.int64)
        out = np.zeros(int(wide.sum()), dtype=np.uint64)
        np.bitwise_xor.at(out, starts[self.of] + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        return out


def level_of(counts: np.ndarray) -> np.ndarray:
    """Levels of counts from one on."""
    return np.minimum(1 + np.floor(OCTAVE * np.log2(counts)), 255).astype(np.uint8)


def widths(sizes: np.ndarray) -> np.ndarray:
    """64-bit words of the sketches of sets of these sizes: powers of two from two on, two bits for a member."""
    return np.minimum(1 << np.ceil(np.log2(np.maximum(sizes, 64) / 32)).astype(np.int64), WIDEST)


def folded(sketches: np.ndarray, width: int) -> np.ndarray:
    """Rows of sketches as narrower ones: a member's bit in a sketch is its hash modulo the width."""
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, width), axis=1)


def word_levels(counts: DataFrame) -> np.ndarray:
    """Levels of the cells of words, from :func:`packed_counts`: 0 never, 1 once, then sixths of octaves."""
    return summed_cells(counts, CELLS, lambda n: np.where(n > 0, level_of(np.maximum(n, 1)), 0).astype(np.uint8))


def flagged(hashes: DataFrame) -> np.ndarray:
    """Whether a cell holds one of the hashes (column h); as large as the cells, whatever the input."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.unique(batch.column("cell").to_numpy())
            yield packed_counts(cells, np.ones(len(cells), dtype=np.int64))

    cells = hashes.select(F.col("h").bitwiseAND(F.lit(CELLS - 1)).alias("cell"))
    return summed_cells(cells.mapInArrow(pack, PACKED_COUNTS), CELLS, lambda n: (n > 0).astype(np.uint8)) > 0


def _may_match(n: np.ndarray, m: np.ndarray, at_n: np.ndarray, at_m: np.ndarray, threshold: float) -> np.ndarray:
    """Positional filter for sets of n and m words that share the words at these places."""
    need = np.ceil(threshold / (1 + threshold) * (n + m) - 1e-9)
    return 1 + np.minimum(n - 1 - at_n, m - 1 - at_m) >= need


def _most_apart(n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Most members of the symmetric difference of similar sets of n and m words; -1 if different sets of these sizes
    have more for sure."""
    most = np.floor((n + m) * (1 - threshold) / (1 + threshold) + 1e-9).astype(np.int64)
    return np.where(most >= np.where(n == m, 2, np.abs(n - m)), most, -1)


def _nearest(late: np.ndarray, early: np.ndarray, apart: np.ndarray, limit: np.ndarray, few: int, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the nearest pairs of each late line, few if the nearest is surely similar, and whether it has more."""
    order = np.lexsort([early, apart, late])
    starts = bounds([late[order]])
    sizes = np.diff(starts)
    best = order[starts[:-1]]
    most = np.where(2 * apart[best] <= limit[best], few, many)
    rank = np.arange(len(order)) - np.repeat(starts[:-1], sizes)
    kept = rank < np.repeat(most, sizes)
    return order[kept], np.repeat(sizes > most, sizes)[kept]


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list[bytes]]]:
    """The packed columns of each segment, from batches sorted by segment: one segment is held beside a batch."""
    held: dict[str, list[bytes]] = {c: [] for c in POSTING}
    last = None
    for batch in batches:
        segment = batch.column("segment").to_numpy()
        cuts = bounds([segment]) if len(segment) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if last is not None and segment[a] != last:
                yield held
                held = {c: [] for c in POSTING}
            last = segment[a]
            for c in POSTING:
                held[c] += batch.column(c).slice(a, b - a).to_pylist()
    if last is not None:
        yield held


def _pairs(threshold: float, most: tuple[int, int] | None, at_once: int):
    """From packed postings, sorted by segment: pairs of an early and a late set that may be similar, with the bits
    that their sketches are apart; of each late set under a key the nearest ones,
    few or many, or all. So many pairs are looked at together."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in segments(batches):
            key = np.concatenate([unpacked_sorted(x) for x in columns["key"]]).view(np.int64)
            doc, line, sets, about = (np.concatenate([unplaned(x, POSTING[c]) for x in columns[c]]) for c in ("doc", "line", "set_id", "about"))
            flat = np.frombuffer(b"".join(columns["sketch"]), dtype=np.uint64)
            wide = widths(about >> 34)
            at_wide = np.cumsum(wide) - wide
            sketch = np.bitwise_xor.reduceat(flat, at_wide) if len(flat) else flat  # folded to 64 bits
            # the first posting of each set under a key; copies are few, so only these are put in order
            same = mixed(key.view(np.uint64) ^ mixed(sets.view(np.uint64)))
            order = np.argsort(same)
            again = same[order][1:] == same[order][:-1]
            copies = order[np.concatenate([[False], again]) | np.concatenate([again, [False]])] if len(order) else order
            copies = copies[np.lexsort([line[copies], doc[copies], same[copies]])]
            first = np.concatenate([[True], same[copies][1:] != same[copies][:-1]]) if len(copies) else np.zeros(0, dtype=bool)
            keep = np.ones(len(key), dtype=bool)
            keep[copies[~first]] = False
            kept = np.flatnonzero(keep)
            kept = kept[np.lexsort([about[kept], key[kept]])]
            key, doc, line, sets, about, sketch, wide, at_wide = (x[kept] for x in (key, doc, line, sets, about, sketch, wide, at_wide))
            run = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
            size, place, part, open_ = about >> 34, about >> 3 & 0x7FFFFFFF, about >> 1 & 3, about & 1 == 1
            at = {w: np.flatnonzero(wide == w) for w in np.unique(wide).tolist()}
            of = {w: flat[at_wide[i][:, None] + np.arange(w)] for w, i in at.items()}
            number = np.zeros(len(run), dtype=np.int64)
            for i in at.values():
                number[i] = np.arange(len(i))
            # the smaller set of a pair shares the word within a shorter prefix, that for a set of its own size
            opens = np.flatnonzero(_may_match(size, size, place, place, threshold))
            big = int(size.max(initial=0)) + 2
            at_open = (run * big + size)[opens]
            low = np.searchsorted(at_open, run * big + np.ceil(threshold * size - 1e-9).astype(np.int64))
            many = np.maximum(np.searchsorted(opens, np.arange(len(run))) - low, 0)
            ends = np.cumsum(many)
            found: list[np.ndarray] = []
            held, start = 0, 0

            def narrowed(found: list[np.ndarray]) -> list[np.ndarray]:
                whole = np.concatenate(found, axis=1) if found else np.zeros((5, 0), dtype=np.int64)
                if not most or not whole.shape[1]:
                    return [whole]
                take, more = _nearest(*whole[:4], *most)
                out = whole[:, take]
                # a line that had more once has more for good
                out[4] |= more | np.isin(out[0], whole[0][whole[4] == 1])
                return [out]

            while start < len(run):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + at_once, "right")))
                y = np.repeat(np.arange(start, stop), many[start:stop])
                x = np.arange(len(y)) - np.repeat(np.cumsum(many[start:stop]) - many[start:stop], many[start:stop]) + np.repeat(low[start:stop], many[start:stop])
                x = opens[x]
                start = stop
                ok = _may_match(size[x], size[y], place[x], place[y], threshold) & ((part[x] != part[y]) | (part[x] == 0)) & (open_[x] | open_[y])
                x, y = x[ok], y[ok]
                limit = _most_apart(size[x], size[y], threshold)
                apart = np.bitwise_count(sketch[x] ^ sketch[y]).astype(np.int64)
                ok = apart <= limit
                x, y, limit, apart = x[ok], y[ok], limit[ok], apart[ok]
                for w in at:
                    here = np.flatnonzero((np.minimum(wide[x], wide[y]) == w))
                    if not len(here):
                        continue
                    sides = []
                    for z in (x[here], y[here]):
                        bits = np.empty((len(z), w), dtype=np.uint64)
                        for v in at:
                            own = wide[z] == v
                            if v >= w and own.any():
                                bits[own] = folded(of[v][number[z[own]]], w)
                        sides.append(bits)
                    apart[here] = np.bitwise_count(sides[0] ^ sides[1]).sum(axis=1)
                ok = apart <= limit
                x, y, limit, apart = x[ok], y[ok], limit[ok], apart[ok]
                later = (doc[y] > doc[x]) | ((doc[y] == doc[x]) & ((line[y] > line[x]) | ((line[y] == line[x]) & (sets[y] > sets[x]))))
                late, early = np.where(later, y, x), np.where(later, x, y)
                ok = open_[late]
                found.append(np.stack([late[ok], early[ok], apart[ok], limit[ok], np.zeros(ok.sum(), dtype=np.int64)]))
                held += int(ok.sum())
                if held > 2 * at_once:
                    if not most:
                        yield _found(np.concatenate(found, axis=1), sets, doc)
                        found, held = [], 0
                    else:
                        found = narrowed(found)
                        held = found[0].shape[1] if found[0].shape[1] < at_once else 0
            yield _found(narrowed(found)[0], sets, doc)

    return pair


def _found(pairs: np.ndarray, sets: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    late, early, apart, _, more = pairs
    arrays = [pa.array(x) for x in (sets[late], doc[late], sets[early], doc[early], apart.astype(np.int32), more.astype(bool))]
    return pa.RecordBatch.from_arrays(arrays, names=["late", "late_doc", "early", "early_doc", "apart", "more"])


def repeated_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc, version, removed): the sorted numbers of the lines that go, for each document (long `doc`, its
    text's hash `version`, `text`) that has any."""
    spark = docs.sparkSession

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lines of the documents; in rows without a line, counts of words and of their prefixes."""
        names = ["doc", "version", "line", "set_id", "check", "part", "cells", "counts", "words", "n"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]

        def rows(many: int, **given: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([given.get(c, pa.nulls(many, k)) for c, k in zip(names, kinds, strict=True)], names=names)

        for batch in slices(batches, "text", SLICE_ROWS):
            found = Lines(batch.column("text"))
            doc, version = (batch.column(c).to_numpy(zero_copy_only=False)[found.text] for c in ("doc", "version"))
            yield rows(len(doc), doc=pa.array(doc), version=pa.array(version), line=pa.array(found.line), set_id=pa.array(found.set_id), check=pa.array(found.check))
            hashes, counts = found.counts
            cells, at = np.unique((hashes & np.uint64(CELLS - 1)).astype(np.int64), return_inverse=True)
            packed = packed_counts(cells, np.bincount(at, weights=counts, minlength=len(cells)).astype(np.int64))
            yield rows(packed.num_rows, **{c: packed.column(c) for c in packed.schema.names})
            # how many sets have a word in their prefix, going by the rarity of words in these documents
            firsts = found.firsts(doc)
            item = found.prefixes(firsts, threshold)[2]
            often, n = np.unique(found.words[item].view(np.int64), return_counts=True)
            listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
            yield rows(1, words=listed(often[n > 1]), n=listed(n[n > 1]), line=pa.array([found.prefix_lengths(firsts, threshold).sum()], pa.int32()))

    found = stored(docs.mapInArrow(lines, "doc long, version long, line int, set_id long, check long, part int, cells binary, counts binary, words array<long>, n array<long>"), "lines")
    often = found.where("words is not null")
    hot = often.select(F.explode(F.arrays_zip("words", "n")).alias("z")).groupBy(F.col("z.words").alias("word")).agg(F.sum("z.n").alias("n")).where(F.col("n") > BLOCK)
    hot = hot.orderBy(F.desc("n"), "word").limit(HOT_WORDS).toPandas().sort_values("word")
    log2_segments = ((often.agg(F.coalesce(F.sum("line"), F.lit(0))).first()[0]) >> LOG2_POSTINGS).bit_length()
    levels = spark.sparkContext.broadcast(word_levels(found.where("part is not null").select("part", "cells", "counts")))
    cut = spark.sparkContext.broadcast((hot["word"].to_numpy(dtype=np.int64), -(-hot["n"].to_numpy(dtype=np.int64) // BLOCK)))
    all_lines = found.where("doc is not null").select("doc", "version", "line", "set_id", "check")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_ROWS):
            found = Lines(batch.column("text"), levels.value)
            offsets = np.append(found.starts, len(found.words)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(found.set_id), pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.words.view(np.int64)))], names=["set_id", "words"])

    def prefix_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_ROWS):
            found = Lines(batch.column("text"), levels.value)
            row, _, item = found.prefixes(np.arange(len(found.sizes)), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(found.set_id[row]), pa.array(found.words[item].view(np.int64))], names=["set_id", "h"])

    def posted(words=None, open_sets=None) -> DataFrame:
        """Postings of the prefixes' words by segment, packed; with flags by cell, of the words and with the sets that are flagged."""

        def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hot_words, hot_blocks = cut.value
            cell = lambda x: (x & np.uint64(CELLS - 1)).astype(np.int64)
            for batch in slices(batches, "text", SLICE_ROWS):
                found = Lines(batch.column("text"), levels.value)
                doc = batch.column("doc").to_numpy(zero_copy_only=False)[found.text]
                row, place, item = found.prefixes(found.firsts(doc), threshold)
                if words is not None:
                    kept = words.value[cell(found.words[item])]
                    row, place, item = row[kept], place[kept], item[kept]
                if not len(row):
                    continue
                word = found.words[item]
                open_ = open_sets.value[cell(found.set_id.view(np.uint64))[row]] if open_sets is not None else np.ones(len(row), dtype=bool)
                low = high = part = np.zeros(len(row), dtype=np.int64)
                if len(hot_words):
                    near = np.minimum(np.searchsorted(hot_words, word.view(np.int64)), len(hot_words) - 1)
                    blocks = np.where(hot_words[near] == word.view(np.int64), hot_blocks[near], 1)
                    block = (mixed(found.set_id[row].view(np.uint64) + np.uint64(11)) % blocks.astype(np.uint64)).astype(np.int64)
                    each = np.repeat(np.arange(len(row)), blocks)
                    other = np.arange(len(each)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    row, place, word, block, open_ = row[each], place[each], word[each], block[each], open_[each]
                    low, high = np.minimum(block, other), np.maximum(block, other)
                    part = np.where(low == high, 0, np.where(block == low, 1, 2))
                key = np.where(high > 0, mixed(word ^ mixed((low * (1 << 24) + high).astype(np.uint64) + np.uint64(1))), word)
                order = np.argsort(key, kind="stable")
                key, row = key[order], row[order]
                about = found.sizes[row] << 34 | place[order] << 3 | part[order] << 1 | open_[order]
                width = widths(found.sizes)
                width, at = width[row], (np.cumsum(width) - width)[row]
                bits = found.sketches()[np.arange(width.sum()) + np.repeat(at - (np.cumsum(width) - width), width)]
                ends = np.concatenate([[0], np.cumsum(width)])
                segment = segment_of(key, log2_segments)
                each = np.unique(segment)
                cuts = [*zip(np.searchsorted(segment, each).tolist(), np.searchsorted(segment, each, "right").tolist(), strict=True)]
                columns = {"doc": doc[row], "line": found.line[row], "set_id": found.set_id[row], "about": about}
                packed = [[packed_sorted(key[a:b]) for a, b in cuts], *([planes(x[a:b].astype(POSTING[c])) for a, b in cuts] for c, x in columns.items()), [bits[ends[a] : ends[b]].tobytes() for a, b in cuts]]
                yield pa.RecordBatch.from_arrays([pa.array(each), *(pa.array(x, pa.binary()) for x in packed)], names=["segment", *POSTING])

        return docs.select("doc", "text").mapInArrow(postings, "segment long, " + ", ".join(f"{c} binary" for c in POSTING)).repartition((1 << log2_segments) // SEGMENTS + 1, "segment").sortWithinPartitions("segment")

    def matches(pairs: DataFrame) -> DataFrame:
        """The late sets of the stored pairs that are similar indeed."""
        ends = pairs.select(F.col("late").alias("set_id"), F.col("late_doc").alias("doc")).unionByName(pairs.select(F.col("early").alias("set_id"), F.col("early_doc").alias("doc")))
        wanted = stored(ends.groupBy("set_id").agg(F.min("doc").alias("doc")), "wanted")
        n = wanted.count()
        own = likely_members(docs, "doc", wanted.select("doc"), n).select("text").mapInArrow(sets, "set_id long, words array<long>")
        own = stored(only_members(own, "set_id", wanted.select("set_id"), n).dropDuplicates(["set_id"]), "sets")
        side = lambda name: own.select(F.col("set_id").alias(name), F.col("words").alias(f"{name}_words"))
        both = pairs.select("early", "late").join(side("early"), "early").join(side("late"), "late")
        shared = F.size(F.array_intersect("early_words", "late_words"))
        return both.where(shared * (1 + threshold) >= threshold * (F.size("early_words") + F.size("late_words")) - 1e-9).select(F.col("late").alias("set_id")).distinct()

    schema = "late long, late_doc long, early long, early_doc long, apart int, more boolean"
    nearest = F.array_sort(F.collect_set(F.struct("apart", "early", "early_doc")))
    near = posted().mapInArrow(_pairs(threshold, (FEW, MANY), PAIRS), schema).groupBy("late").agg(F.min("late_doc").alias("late_doc"), nearest.alias("near"), F.max("more").alias("more"))
    near = stored(near.select("late", "late_doc", F.slice("near", 1, MANY).alias("near"), (F.col("more") | (F.size("near") > MANY)).alias("more")), "candidates")
    cut.unpersist()
    listed = lambda df, start, stop: df.select("late", "late_doc", F.explode(F.slice("near", start, stop)).alias("e")).select("late", "late_doc", "e.early", "e.early_doc")
    late = stored(matches(stored(listed(near, 1, 1), "pairs")), "late")
    undecided = lambda df: df.join(late.select(F.col("set_id").alias("late")), "late", "left_anti")
    left = stored(undecided(near.where((F.size("near") > 1) | F.col("more"))), "undecided")
    if not left.isEmpty():
        late = stored(late.unionByName(matches(stored(listed(left, 2, MANY), "pairs"))).distinct(), "late")
        rest = stored(undecided(left.where("more")).select(F.col("late").alias("set_id"), F.col("late_doc").alias("doc")), "undecided")
        n = rest.count()
        if n:
            words = likely_members(docs, "doc", rest.select("doc"), n).select("text").mapInArrow(prefix_words, "set_id long, h long")
            flags = flagged(only_members(words, "set_id", rest.select("set_id"), n).select("h")), flagged(rest.select(F.col("set_id").alias("h")))
            more = posted(*map(spark.sparkContext.broadcast, flags)).mapInArrow(_pairs(threshold, None, PAIRS), schema)
            late = late.unionByName(matches(stored(more.select("late", "late_doc", "early", "early_doc").dropDuplicates(["late", "early"]), "pairs"))).distinct()
    # only sets that are late or stand twice take lines away
    places = all_lines.groupBy("set_id", "check").agg(F.min(F.struct("doc", "line")).alias("first"), F.count("*").alias("n"))
    facts = places.join(late.withColumn("late", F.lit(True)), "set_id", "left").where("n > 1 or late")
    facts = stored(facts.select(F.struct("set_id", "check").alias("both"), "first", "n", "late"), "facts")
    slim = all_lines.select("doc", "version", "line", F.struct("set_id", "check").alias("both"))
    judged = attach(likely_members(slim, "both", facts.select("both"), facts.count()), facts, "both", "n", all_lines.count())
    gone = F.coalesce("late", F.lit(False)) | (F.struct("doc", "line") != F.col("first"))
    return judged.where(gone).groupBy("doc", "version").agg(F.sort_array(F.collect_set("line")).alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with clean_text, n_lines and removed (numbers of the lines taken out, from 0).

    Blank lines stay and match nothing. A null text counts as empty; rows with a null id stay as they are and
    take part in nothing. Rows repeated with the same id and text are one document and lose the same lines; of
    rows with the same id and different texts, lines of one number stand in the order of a hash. Of ties, the
    smallest id and line number stays. Texts are read whole, however long; a line may have any number of words.
    An empty table gives an empty result. Sets of words are told apart by 128 bits. Columns of docs that have
    the names of the result's are replaced, all others stay, whatever their names.
    """
    names = ["clean_text", "n_lines", "removed"]
    keep = [c for c in docs.columns if c not in names]
    rows = docs.select(F.struct(*keep).alias("tw_row"), F.coalesce(F.col(text_col), F.lit("")).alias("tw_text"), F.col(id_col).cast("long").alias("doc")).withColumn("version", F.xxhash64("tw_text"))
    told = stored(repeated_lines(rows.where("doc is not null").select("doc", "version", F.col("tw_text").alias("text")), threshold), "removed")
    keyed = lambda df: df.withColumn("tw_h", F.xxhash64("doc", "version"))
    words = filter_words(told.count())
    tried = probed(keyed(rows), "tw_h", members(keyed(told), "tw_h", words), words).drop("tw_h")

    def without_lines(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    none = F.array().cast("array<int>")
    same = tried.where(~F.col("tw_maybe") | F.col("doc").isNull()).select("tw_row", "tw_text", none.alias("removed"), F.col("tw_text").alias("clean_text"))
    maybe = tried.where(F.col("tw_maybe") & F.col("doc").isNotNull()).join(told, ["doc", "version"], "left").withColumn("removed", F.coalesce("removed", none))
    maybe = maybe.select("tw_row", "tw_text", "removed", F.when(F.size("removed") == 0, F.col("tw_text")).otherwise(let(F.split("tw_text", "\n", -1), without_lines)).alias("clean_text"))
    n_lines = F.length("tw_text") - F.length(F.replace("tw_text", F.lit("\n"), F.lit(""))) + 1
    return same.unionByName(maybe).select("tw_row.*", "clean_text", n_lines.alias("n_lines"), "removed")


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed", F.sha2("clean_text", 256).alias("clean_sha256"))
