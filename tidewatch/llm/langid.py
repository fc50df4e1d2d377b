"""Language identification by unigram models over a fixed public vocabulary, summed over all segmentations.

Each language has a probability for each piece of the vocabulary. A word's probability is the sum, over
all ways to cut it into pieces, of the product of their probabilities: a forward pass over its letters, however
many they are, whose sums are scaled up where they grow too small. A text's words (runs of letters, lower-cased)
are independent. The probabilities are learned by
expectation-maximisation over the word counts of a bounded sample of labelled texts: expected piece
counts come from a forward and a backward pass, are summed on Spark, and only a table of pieces by
languages reaches the driver.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stored import stored

UNDETERMINED = "und"
#: Words that a worker remembers, and letters of the longest of these; words, and letters, handled at a time.
REMEMBERED, SHORT, CHUNK, LETTERS = 300_000, 40, 20_000, 1 << 18
#: Sums below LEAST are scaled up by its inverse; this is looked at every so many letters.
LEAST, EVERY = 1e-100, 8
#: Probability of a letter that no piece covers, and what each piece's expected count is raised by.
UNCOVERED, SMOOTHING = 1e-7, 0.02
_letters = regex.compile(r"\p{L}+").findall


def read_pieces(vocabulary: str) -> list[str]:
    """The letter pieces of a sentencepiece model, a leading word mark kept, in lower case, once each."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    names = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return list(dict.fromkeys(p for p in names if regex.fullmatch(r"▁?\p{L}+", p)))


@dataclass
class Segmenter:
    """Finds where pieces match in words."""

    pieces: list[str]

    def __post_init__(self) -> None:
        self.ids = {p: i for i, p in enumerate(self.pieces)}
        self.starting = {p[:n]: -1 for p in self.pieces for n in range(1, len(p))} | self.ids

    def matches(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word, start, end and piece of each match; piece -1 where a letter is crossed without one."""
        at_word, at_start, at_end, piece = [], [], [], []
        get = self.starting.get
        for k, word in enumerate(words):
            marked = "▁" + word
            for start in range(len(word)):
                here = 0 if not start else start + 1  # the mark may open a piece at the word's start only
                covered = False
                for begin in (0, 1) if not start else (here,):
                    for end in range(start + 1, len(word) + 1):
                        found = get(marked[begin : end + 1])
                        if found is None:
                            break
                        if found >= 0:
                            covered |= end == start + 1
                            at_word.append(k)
                            at_start.append(start)
                            at_end.append(end)
                            piece.append(found)
                if not covered:
                    at_word.append(k)
                    at_start.append(start)
                    at_end.append(start + 1)
                    piece.append(-1)
        return tuple(np.array(x, dtype=np.int64) for x in (at_word, at_start, at_end, piece))


def _sums(n: int, at: np.ndarray, add: np.ndarray) -> np.ndarray:
    out = np.zeros((n, add.shape[1]))
    for c in range(add.shape[1]):
        out[:, c] = np.bincount(at, weights=add[:, c], minlength=n)
    return out


def _scaled(sums: np.ndarray, scale: np.ndarray, window: slice, at: int) -> None:
    """Scales up the sums of a window of positions where they are too small at one of them."""
    small = (sums[at] > 0) & (sums[at] < LEAST)
    if small.any():
        factor = np.where(small, 1 / LEAST, 1.0)
        sums[window] *= factor
        scale[window] += small


def forward(n: int, found: tuple, weight: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward sums by position, word and column, and how often each was scaled up; weight has a row for each match."""
    word, start, end, _ = found
    most, longest = int(lengths.max(initial=0)), int((end - start).max(initial=1))
    alpha, scale = np.zeros((most + 1, n, weight.shape[1])), np.zeros((most + 1, n, weight.shape[1]), dtype=np.int32)
    alpha[0] = 1.0
    order = np.argsort(end, kind="stable")
    cuts = np.searchsorted(end[order], np.arange(1, most + 2))
    for j in range(1, most + 1):
        m = order[cuts[j - 1] : cuts[j]]
        scale[j] = scale[j - 1]
        alpha[j] = _sums(n, word[m], alpha[start[m], word[m]] * weight[m])
        if j % EVERY == 0:
            _scaled(alpha, scale, slice(max(0, j - longest), j + 1), j)
    return alpha, scale


def _backward(n: int, found: tuple, weight: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word, start, end, _ = found
    most, longest = int(lengths.max(initial=0)), int((end - start).max(initial=1))
    beta, scale = np.zeros((most + 1, n, weight.shape[1])), np.zeros((most + 1, n, weight.shape[1]), dtype=np.int32)
    beta[lengths, np.arange(n)] = 1.0
    order = np.argsort(start, kind="stable")
    cuts = np.searchsorted(start[order], np.arange(most + 2))
    for j in range(most - 1, -1, -1):
        m = order[cuts[j] : cuts[j + 1]]
        scale[j] = scale[j + 1]
        beta[j] += _sums(n, word[m], beta[end[m], word[m]] * weight[m])
        if j % EVERY == 0:
            _scaled(beta, scale, slice(j, min(most, j + longest) + 1), j)
    return beta, scale


def log_sums(alpha: np.ndarray, scale: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Logarithm of each word's probability, by column."""
    at = np.arange(len(lengths))
    return np.log(alpha[lengths, at]) + scale[lengths, at] * np.log(LEAST)


def expected(n: int, found: tuple, weight: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each match the share of the word's probability that segmentations with it have, for one column."""
    word, start, end, _ = found
    (alpha, up), (beta, down) = forward(n, found, weight, lengths), _backward(n, found, weight, lengths)
    whole = log_sums(alpha, up, lengths)[:, 0]
    log = np.log(alpha[start, word, 0]) + np.log(weight[:, 0]) + np.log(beta[end, word, 0]) + (up[start, word, 0] + down[end, word, 0]) * np.log(LEAST)
    return np.exp(log - whole[word])


def groups(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Places and words, those of like length together, so many letters at a time (a word at least)."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(lengths, kind="stable")
    start = 0
    while start < len(order):
        stop = min(start + CHUNK, len(order))
        while stop > start + 1 and (stop - start) * int(lengths[order[stop - 1]]) > LETTERS:
            stop = start + max(1, (stop - start) // 2)
        yield order[start:stop], [words[i] for i in order[start:stop]]
        start = stop


@dataclass
class LanguageModel:
    pieces: list[str]
    langs: list[str]
    prior: np.ndarray  # log, by language
    prob: np.ndarray  # by piece and language


def _weights(prob: np.ndarray, piece: np.ndarray) -> np.ndarray:
    return np.where(piece[:, None] < 0, UNCOVERED, prob[piece])


def fit(docs: DataFrame, vocabulary: str, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs_per_lang: int = 800, rounds: int = 3) -> LanguageModel:
    """A model of the labelled rows of docs.

    Learned from about docs_per_lang texts of each language (a documented bound), drawn by the hash of
    their ids (all rows of an id are drawn together); rows without language or text don't count. Repeated rows
    count each. No labelled rows, or an empty table: a model without languages.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    pieces = read_pieces(vocabulary)
    total = np.array([counts[x] for x in langs], dtype=float)
    prior = np.log(total / max(total.sum(), 1.0)) if langs else np.zeros(0)
    prob = np.full((len(pieces), len(langs)), 1.0 / len(pieces))
    if not langs:
        return LanguageModel(pieces, langs, prior, prob)
    share = F.create_map(*(F.lit(x) for k in langs for x in (k, min(1.0, docs_per_lang / counts[k]))))
    sample = rows.where((F.xxhash64(F.lit(11), "i").bitwiseAND(F.lit((1 << 30) - 1))) < share[F.col("lang")] * float(1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for word, n in Counter(_letters(text.lower())).items():
                    seen[lang, word] += n
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in seen], pa.string()), "word": pa.array([k[1] for k in seen], pa.string()), "n": pa.array(seen.values(), pa.int64())})

    words = stored(sample.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    column = {x: k for k, x in enumerate(langs)}
    for _ in range(rounds):
        given = docs.sparkSession.sparkContext.broadcast((pieces, prob))

        def expect(frames: Iterator[pd.DataFrame], given=given) -> Iterator[pd.DataFrame]:
            pieces, prob = given.value
            segment = Segmenter(pieces)
            total = np.zeros(prob.shape)
            for frame in frames:
                langs, times = frame["lang"].map(column).to_numpy(), frame["n"].to_numpy()
                for places, texts in groups(frame["word"].tolist()):
                    lang = langs[places]
                    found = segment.matches(texts)
                    word, _, _, piece = found
                    weight = np.where(piece < 0, UNCOVERED, prob[piece, lang[word]])[:, None]
                    share = expected(len(texts), found, weight, np.fromiter(map(len, texts), dtype=np.int64)) * times[places][word]
                    real = piece >= 0
                    np.add.at(total, (piece[real], lang[word[real]]), share[real])
            at = np.argwhere(total > 0)
            yield pd.DataFrame({"piece": at[:, 0], "lang": at[:, 1], "n": total[at[:, 0], at[:, 1]]})

        sums = words.mapInPandas(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        counted = np.full(prob.shape, SMOOTHING)
        counted[sums["piece"].to_numpy(), sums["lang"].to_numpy()] += sums["n"].to_numpy()
        prob = counted / counted.sum(axis=0)
    return LanguageModel(pieces, langs, prior, prob)


class Scorer:
    """A worker's model with the log-probabilities of words that it has met."""

    def __init__(self, model: LanguageModel) -> None:
        self.model, self.segment = model, Segmenter(model.pieces)
        self.known: dict[str, int] = {}
        self.table = np.zeros((REMEMBERED * 2, len(model.langs)))

    def logs(self, words: list[str]) -> np.ndarray:
        """Log-probabilities of words, by language."""
        out = np.zeros((len(words), len(self.model.langs)))
        for places, part in groups(words):
            lengths = np.fromiter(map(len, part), dtype=np.int64)
            found = self.segment.matches(part)
            out[places] = log_sums(*forward(len(part), found, _weights(self.model.prob, found[3]), lengths), lengths)
        return out

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > len(self.table):
            self.known.clear()
            new = list(words)
            if len(new) > len(self.table):
                self.table = np.zeros((len(new), len(self.model.langs)))
        base = len(self.known)
        self.table[base : base + len(new)] = self.logs(new)
        self.known.update(zip(new, range(base, base + len(new)), strict=True))

    def scores(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and posterior probability of each text; a word is met as often as it stands there."""
        split = [_letters(t.lower()) for t in texts]
        short = [[w for w in words if len(w) <= SHORT] for words in split]
        self.learn({w for words in short for w in words})
        out = []
        for words, known in zip(split, short, strict=True):
            if not words or not self.model.langs:
                out.append((UNDETERMINED, 0.0))
                continue
            ids = np.fromiter(map(self.known.__getitem__, known), dtype=np.int64, count=len(known))
            log = np.bincount(ids) @ self.table[: ids.max() + 1] if len(ids) > len(self.known) else self.table[ids].sum(axis=0)
            log = log + self.model.prior
            if len(known) < len(words):
                log = log + self.logs([w for w in words if len(w) > SHORT]).sum(axis=0)
            chance = np.exp(log - log.max())
            best = int(chance.argmax())
            out.append((self.model.langs[best], float(chance[best] / chance.sum())))
        return out


_loaded: dict[str, Scorer] = {}


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (the posterior of that language, 0 to 1).

    A null text, or one without any letter, is `und` with score 0, as is every text if the model has no
    language. Columns of those names are replaced, others stay, whatever their names. Whole texts are read, and
    words of any length; of equally likely languages the first by name is taken. Repeated rows are told alike,
    each by itself. An empty table gives an empty result.
    """
    given = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = Scorer(given.value)
        scorer = _loaded[key]
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                found = scorer.scores([t or "" for t in batch.column(text_col).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*keep, "lang_pred", "score"])

    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()), default_vocabulary())
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
