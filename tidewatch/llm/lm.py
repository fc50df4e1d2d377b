"""Language-model scores from a log-frequency Bloom filter.

Counts of n-grams (here words and pairs of words) are quantised to levels, 1 + floor(log2(count)), and an
n-gram of level q is put into a Bloom filter once for each level 1..q. A level is found by probing upwards
until a probe fails. The probability of a word w after a word h is smoothed by absolute discounting,

    P(w | h) = (max(q(h, w) - D, 0) + D * T(h) * P(w)) / Z(h),    P(w) = (q(w) + 1) / (sum of q + V + 1),

where q is the count that a level stands for, and Z and T are the sum of q and the number of different words
after h. Z is summed over the same quantised counts, so the probabilities after any h sum to one (V words and
the unknown one), but for false hits of the filter; tests hold that against exact tables.

The filter grows with the n-grams and is never in one place: it is made of segments, named by the first bits
of a hash, about so many that each has the same small number of n-grams at any size of the input. A word and the
pairs that it opens lie in one segment, which therefore knows Z and T; the pairs after a very frequent word,
or at the start of a text, are spread by their own hashes, and Z and T of these few contexts are summed before.

Texts go in batches of so many bytes, dealt by a hash of id and text, so that a batch is the same whenever it is
computed. A batch sends its different n-grams, sorted and packed, to their segments; a segment's task sums the
counts, builds the segment, looks up what each batch sent and answers it with levels, in the order in which it
was sent. A batch then meets its answers and is scored.

Beside it stands an exact unigram score: words travel as they are, and a segment answers their exact counts too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stored import stored
from .common import Words, hashes_of, mixed, packed_sorted, planes, segment_of, slices, unpacked_sorted, unplaned

#: Bits for each entry, probes for each entry, levels at most.
BITS, PROBES, LEVELS = 16, 4, 40
#: Bytes of text in a batch, log2 of the n-grams, as they are sent, that a segment gets at most.
BATCH_BYTES, LOG2_SENT = 8 << 20, 21
#: What each pair's count is lowered by.
DISCOUNT = 0.75
#: Words with a 512th of all training tokens are frequent, at any size the same ones. A word that often may still be
#: too much for one segment in a large corpus, so those that occur 2**21 times are too, but there are never more than 65,536.
SHARE, FREQUENT, MOST_FREQUENT = 512, 1 << 21, 1 << 16
#: Pairs that a task counts together before it gives them on.
COUNTED = 1 << 20
START = 0x9E3779B97F4A7C15
#: Bits of a word's hash that tell the words after one context apart.
SUCCESSOR = 40


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(mixed(before) + word * np.uint64(3))


@dataclass
class Batch:
    """Tokens of some texts: each ends with an end token, which is number 0."""

    words: pa.Array  # the different words; number 0, the empty one, is the end
    at: np.ndarray  # number of each token
    ends: np.ndarray  # past each text's last token

    @classmethod
    def of(cls, texts: pa.Array) -> Batch:
        found = Words.of(texts)
        ends = np.cumsum(found.sizes + 1)
        at = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
        real = np.ones(len(at), dtype=bool)
        real[ends - 1] = False
        at[real] = found.code + 1
        return cls(pa.concat_arrays([pa.array([b""]), found.words.cast(pa.binary())]), at, ends)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each different word, and for each token the number of the one before (-1: none)."""
        before = np.concatenate([[-1], self.at[:-1]]).astype(np.int64)[: len(self.at)]
        before[np.concatenate([[0], self.ends[:-1]])[: len(self.ends)].astype(np.int64)] = -1
        return hashes_of(self.words), before


@dataclass
class LogFrequencyBloom:
    bits: np.ndarray  # bytes, segment after segment
    log2_segments: int
    segment_bits: int

    def levels(self, items: np.ndarray) -> np.ndarray:
        """Level of each hash: 0 if it was not put in, up to chance."""
        level = np.zeros(len(items), dtype=np.int64)
        alive = np.arange(len(items))
        base = segment_of(items, self.log2_segments).astype(np.uint64) * np.uint64(self.segment_bits)
        for j in range(1, LEVELS + 1):
            if not len(alive):
                break
            hit = np.ones(len(alive), dtype=bool)
            for probe in places(items[alive], j, self.segment_bits):
                place = probe + base[alive]
                hit &= (self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            alive = alive[hit]
            level[alive] = j
        return level


def places(items: np.ndarray, level: int, n_bits: int) -> Iterator[np.ndarray]:
    """Bits of a segment that an entry takes."""
    for k in range(PROBES):
        salt = (level * PROBES + k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        yield mixed(items + np.uint64(salt)) % np.uint64(n_bits)


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(counts.astype(np.float64))[1], LEVELS)


def count_of(level: np.ndarray) -> np.ndarray:
    """Count that a level stands for."""
    return np.where(level < 2, level, 1.4 * np.exp2(level - 1.0))


def segment(items: np.ndarray, counts: np.ndarray, n_bits: int) -> np.ndarray:
    """A segment's bytes, with all items in it."""
    level = level_of(counts)
    out = np.zeros(n_bits // 8, dtype=np.uint8)
    for j in range(1, LEVELS + 1):
        for place in places(items[level >= j], j, n_bits):
            np.bitwise_or.at(out, (place >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (place & np.uint64(7)).astype(np.uint8)))
    return out


def segment_levels(items: np.ndarray, counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Levels of the different items of a segment, by a filter of those that were counted; its bits follow its entries."""
    put = counts > 0
    n_bits = max(64, -(-int(level_of(counts[put]).sum()) * bits // 64) * 64)
    return LogFrequencyBloom(segment(items[put], counts[put], n_bits), 0, n_bits).levels(items)


def word_counts(texts: DataFrame) -> DataFrame:
    """Word (binary; the empty one is the end of a text), its hash h and its count n, in a column `text` of all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 10_000):
            found = Batch.of(batch.column("text"))
            yield pa.RecordBatch.from_arrays([found.words, pa.array(hashes_of(found.words).view(np.int64)), pa.array(np.bincount(found.at, minlength=len(found.words)))], names=["word", "h", "n"])

    return texts.select("text").mapInArrow(count, "word binary, h long, n long").groupBy("word").agg(F.any_value("h").alias("h"), F.sum("n").alias("n"))


def quantised(n: Column) -> Column:
    """:func:`count_of` the level of a count, in Spark."""
    level = F.least(F.length(F.bin(n)), F.lit(LEVELS))
    return F.when(n < 2, n.cast("double")).otherwise(1.4 * F.pow(F.lit(2.0), level - 1))


def frequent_from(n: int) -> int:
    """Occurrences among n training tokens from which on a word is frequent."""
    return max(1, min(FREQUENT, -(-n // SHARE)), -(-n // MOST_FREQUENT))


def _pairs_after(known: np.ndarray):
    """From texts: how often each pair whose first word has one of these hashes (sorted) occurs, as (place of the
    hash, pair, n), added up over the batches of a task until very many pairs are held."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def together() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            place, pairs, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(pairs, kind="stable")
            starts = np.flatnonzero(np.diff(pairs[order], prepend=~pairs[order[:1]]))
            return place[order][starts], pairs[order][starts], np.add.reduceat(n[order], starts) if len(n) else n

        for some in slices(batches, "text", 10_000):
            batch = Batch.of(some.column("text"))
            words, before = batch.hashes()
            left = np.where(before < 0, np.uint64(START), words[before])
            place = np.minimum(np.searchsorted(known, left), len(known) - 1)
            here = known[place] == left
            pairs, first, n = np.unique(pair_hash(left[here], words[batch.at[here]]), return_index=True, return_counts=True)
            held.append((place[here][first], pairs, n))
            held[:] = [together()]
            if len(held[0][0]) > COUNTED:
                yield _counted(*held.pop())
        if held:
            yield _counted(*held.pop())

    return count


def _counted(place: np.ndarray, pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(place), pa.array(pairs.view(np.int64)), pa.array(n)], names=["place", "pair", "n"])


def frequent_contexts(texts: DataFrame, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, sorted, of the words with these hashes and of the start of a text, and Z and T of each.

    Only the pairs after these words are counted, by task first, then over all.
    """
    known = np.unique(np.append(hashes.astype(np.uint64), np.uint64(START)))

    counts = texts.select("text").mapInArrow(_pairs_after(known), "place long, pair long, n long").groupBy("place", "pair").agg(F.sum("n").alias("n"))
    sums = counts.groupBy("place").agg(F.sum(quantised(F.col("n"))).alias("z"), F.count("*").alias("t")).toPandas()
    z, t = np.zeros(len(known)), np.zeros(len(known))
    z[sums["place"].to_numpy(dtype=np.int64)], t[sums["place"].to_numpy(dtype=np.int64)] = sums["z"].to_numpy(), sums["t"].to_numpy()
    return known, z, t


class Question:
    """What a batch sends: its words by hash; the pairs that each opens, by context and hash of the second word;
    and the pairs after frequent contexts, by their own hash. It is the same in whatever order the texts come."""

    def __init__(self, texts: pa.Array, frequent: np.ndarray) -> None:
        self.batch = Batch.of(texts)
        words, self.before = self.batch.hashes()
        self.order = np.argsort(words, kind="stable")
        self.words = words[self.order]
        rank = np.empty(len(words), dtype=np.int64)
        rank[self.order] = np.arange(len(words))
        left = np.where(self.before < 0, np.uint64(START), words[self.before])
        self.place = np.minimum(np.searchsorted(frequent, left), len(frequent) - 1)
        self.spread = frequent[self.place] == left  # tokens whose pair goes by its own hash
        here, there = np.flatnonzero(~self.spread), np.flatnonzero(self.spread)
        successor = words[self.batch.at[here]] >> np.uint64(64 - SUCCESSOR)
        self.opened, self.opened_at = np.unique(rank[self.before[here]].astype(np.uint64) << np.uint64(SUCCESSOR) | successor, return_inverse=True)
        self.pairs, self.pairs_at = np.unique(pair_hash(left[there], words[self.batch.at[there]]), return_inverse=True)
        self.fan = np.bincount((self.opened >> np.uint64(SUCCESSOR)).astype(np.int64), minlength=len(words))
        parts = [np.bitwise_xor.reduce(mixed(x + np.arange(len(x), dtype=np.uint64))) for x in (self.words, self.opened, self.pairs)]
        self.check = int(np.bitwise_xor.reduce(mixed(np.array(parts, dtype=np.uint64) + np.arange(3, dtype=np.uint64))).view(np.int64))


def score_texts(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """A row for each row of docs: its id, n_tokens, n_known, train_tokens, base_score and score.

    The model is learned from the rows where training holds (null: it doesn't). base_score is the exact add-one
    unigram log10 probability, score the filter's, with so many bits for an entry. A null text counts as empty: it has its end token only. Texts
    are read whole. Repeated rows are scored each, and learned from each. Without training rows each token has
    probability 1 / (V + 1) = 1. An empty table gives an empty result; other columns of docs are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    learned = rows.where("training")
    zero = lambda c, x: F.coalesce(F.sum(c), F.lit(x))
    counts = stored(word_counts(learned).select("h", "n"), "words")
    sums = counts.agg(zero("n", 0).alias("n"), F.count("*").alias("v"), zero(quantised(F.col("n")), 0.0).alias("q")).first()
    size = rows.agg(zero(F.octet_length("text"), 0) + F.count("*")).first()[0]
    n = sums["n"]
    total, flat = n + sums["v"] + 1, sums["q"] + sums["v"] + 1
    often = counts.where(F.col("n") >= frequent_from(n)).select("h").toPandas()["h"].to_numpy(dtype=np.int64).view(np.uint64)
    contexts = docs.sparkSession.sparkContext.broadcast(frequent_contexts(learned, often))
    # a token has two bytes at least with the space after it, and sends a word and a pair at most
    log2_segments = (size >> LOG2_SENT).bit_length()
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("id", "text"), F.lit(size // BATCH_BYTES + 1)))

    def ask(table: pa.Table) -> pa.Table:
        q = Question(table.column("text").combine_chunks(), contexts.value[0])
        starts = np.concatenate([[0], q.batch.ends[:-1]])
        trained = np.repeat(table.column("training").to_numpy(), q.batch.ends - starts).astype(np.int64)
        times = np.bincount(q.batch.at[trained > 0], minlength=len(q.order))[q.order]
        opened = np.bincount(q.opened_at, weights=trained[~q.spread], minlength=len(q.opened)).astype(np.int64)
        pairs = np.bincount(q.pairs_at, weights=trained[q.spread], minlength=len(q.pairs)).astype(np.int64)
        word_segment, pair_segment = segment_of(q.words, log2_segments), segment_of(q.pairs, log2_segments)
        each = np.unique(np.concatenate([word_segment, pair_segment]))  # only segments that are asked something
        cuts = lambda of: zip(np.searchsorted(of, each).tolist(), np.searchsorted(of, each, "right").tolist(), strict=True)
        ends = np.concatenate([[0], np.cumsum(q.fan)])
        at_words, at_pairs = [*cuts(word_segment)], [*cuts(pair_segment)]
        at_opened = [(ends[a], ends[b]) for a, b in at_words]
        successor = (q.opened & np.uint64((1 << SUCCESSOR) - 1)).view(np.uint8).reshape(-1, 8)[:, : SUCCESSOR // 8]
        packed = lambda x, at: pa.array([planes(x[a:b].astype("<u4")) for a, b in at], pa.binary())
        offsets = pa.array(np.array([0, *(b for _, b in at_words)], dtype=np.int32))
        arrays = [
            pa.array(each.astype(np.int32)),
            pa.array(np.full(len(each), table.column("batch")[0].as_py())),
            pa.array(np.full(len(each), q.check)),
            pa.ListArray.from_arrays(offsets, q.batch.words.take(pa.array(q.order))),
            packed(times, at_words),
            packed(q.fan, at_words),
            pa.array([successor[a:b].T.tobytes() for a, b in at_opened], pa.binary()),
            packed(opened, at_opened),
            pa.array([packed_sorted(q.pairs[a:b]) for a, b in at_pairs], pa.binary()),
            packed(pairs, at_pairs),
        ]
        return pa.Table.from_arrays(arrays, names=["segment", "batch", "check", "words", "times", "fan", "opened", "opened_counts", "pairs", "pair_counts"])

    def answer(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists = table.column("words").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        code, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        joined = lambda c, kind="<u4": np.concatenate([unplaned(x, kind) for x in table.column(c).to_pylist()]).astype(np.int64)
        exact = np.bincount(code, weights=joined("times"), minlength=len(words)).astype(np.int64)
        hashes = hashes_of(words)
        context = np.repeat(code, joined("fan"))
        narrow = [np.frombuffer(x, dtype=np.uint8).reshape(SUCCESSOR // 8, -1).T for x in table.column("opened").to_pylist()]
        successor = np.zeros((len(context), 8), dtype=np.uint8)
        successor[:, : SUCCESSOR // 8] = np.concatenate(narrow)
        opened, first, opened_at = np.unique(pair_hash(hashes[context], successor.view("<u8").ravel()), return_index=True, return_inverse=True)
        opened_counts = np.bincount(opened_at, weights=joined("opened_counts"), minlength=len(opened)).astype(np.int64)
        sent = [unpacked_sorted(x) for x in table.column("pairs").to_pylist()]
        pairs, pairs_at = np.unique(np.concatenate(sent), return_inverse=True)
        pair_counts = np.bincount(pairs_at, weights=joined("pair_counts"), minlength=len(pairs)).astype(np.int64)
        level = segment_levels(np.concatenate([hashes, opened, pairs]), np.concatenate([exact, opened_counts, pair_counts]), bits).astype(np.uint8)
        opener, met = context[first], opened_counts > 0
        z = np.bincount(opener, weights=count_of(level_of(opened_counts)) * met, minlength=len(words))
        t = np.bincount(opener, weights=met, minlength=len(words))
        word_sizes, pair_sizes, opened_sizes = lists.value_lengths().to_numpy(zero_copy_only=False), np.array([len(x) for x in sent]), np.array([len(x) for x in narrow])
        cut = lambda x, sizes: pa.array([planes(x[a:b]) for a, b in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True)], pa.binary())
        arrays = [
            table.column("batch"),
            table.column("segment"),
            table.column("check"),
            cut(exact.astype("<i8")[code], word_sizes),
            cut(level[code], word_sizes),
            cut(z.astype("<f8")[code], word_sizes),
            cut(t.astype("<u4")[code], word_sizes),
            cut(level[len(words) + opened_at], opened_sizes),
            cut(level[len(words) + len(opened) + pairs_at], pair_sizes),
        ]
        return pa.Table.from_arrays(arrays, names=["batch", "segment", "check", "exact", "level", "z", "t", "opened", "pairs"])

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        frequent, frequent_z, frequent_t = contexts.value
        q = Question(table.column("text").combine_chunks(), frequent)
        answers = answers.sort_by("segment")
        if set(answers.column("check").to_pylist()) != {q.check}:
            raise ValueError("the texts of a batch changed between two readings")
        joined = lambda c, kind="u1": np.concatenate([unplaned(x, kind) for x in answers.column(c).to_pylist()])
        by_word = lambda x: x[np.argsort(q.order)]
        exact, level, z, t = (by_word(joined(c, kind)) for c, kind in (("exact", "<i8"), ("level", "u1"), ("z", "<f8"), ("t", "<u4")))
        single = np.where(exact > 0, count_of(level.astype(np.int64)) + 1, 1) / flat
        both = np.zeros(len(q.batch.at))
        both[~q.spread] = count_of(joined("opened").astype(np.int64))[q.opened_at]
        both[q.spread] = count_of(joined("pairs").astype(np.int64))[q.pairs_at]
        both[exact[q.batch.at] == 0] = 0  # a word never met is after no word
        context_z = np.where(q.spread, frequent_z[q.place], z[q.before])
        context_t = np.where(q.spread, frequent_t[q.place], t[q.before])
        alone = single[q.batch.at]
        after = (np.maximum(both - DISCOUNT, 0) + DISCOUNT * context_t * alone) / np.maximum(context_z, 1)
        chance = np.where(context_t > 0, np.minimum(after, 1.0), alone)
        starts = np.concatenate([[0], q.batch.ends[:-1]])
        per_text = lambda x: pa.array(np.add.reduceat(x, starts))
        arrays = [
            table.column("id"),
            pa.array(q.batch.ends - starts),
            per_text((exact > 0).astype(np.int64)[q.batch.at]),
            pa.array(np.full(len(starts), n)),
            per_text(np.log10((exact + 1) / total)[q.batch.at]),
            per_text(np.log10(chance)),
        ]
        return pa.Table.from_arrays(arrays, names=[id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    id_type = rows.schema["id"].dataType.simpleString()
    asked = dealt.groupBy("batch").applyInArrow(ask, "segment int, batch long, check long, words array<binary>, times binary, fan binary, opened binary, opened_counts binary, pairs binary, pair_counts binary")
    answers = asked.groupBy("segment").applyInArrow(answer, "batch long, segment int, check long, exact binary, level binary, z binary, t binary, opened binary, pairs binary")
    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, f"{id_col} {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return score_texts(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
