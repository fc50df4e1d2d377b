"""Byte-level BPE encoding and decoding.

Encoding: a batch's distinct words stand in sorted order, which is a depth-first walk of their trie:
neighbours share the path of their common prefix, and the states on the current path are kept on a
stack. A state is the last token of its prefix's encoding; it follows from the states above it, so
the encoding of a shared prefix is computed once. A token fits after a prefix if BPE would keep the
border between it and the prefix's last token, which is decided by undoing merges around the border,
latest first. Known words are remembered by a worker across batches, within a bound.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The pre-tokeniser's published pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and borders that a worker remembers; bytes of text or ids that it handles at a time (one row at least).
REMEMBERED, BORDERS, SLICE = 200_000, 400_000, 2 << 20
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in such vocabularies: printable ones for themselves, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairs:
    """Vocabulary and merges of a tokenizers JSON file with a byte-level pre-tokeniser."""

    def __init__(self, content: str, encodes: bool = True) -> None:
        spec = json.loads(content)
        letters = byte_letters()
        raw = lambda piece: bytes(letters[c] for c in piece)
        by_name = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*by_name.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for name, i in by_name.items():
            if name not in self.special:
                self.bytes_of[i] = raw(name)
        plain = [i for i, b in enumerate(self.bytes_of) if b]
        for name, i in self.special.items():
            self.bytes_of[i] = name.encode()
        self.length = [len(b) for b in self.bytes_of]
        self.lengths = np.array(self.length, dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        if not encodes:
            return
        self.ids = {self.bytes_of[i]: i for i in plain}
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.merged: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i = by_name[a + b]
            self.merged[by_name[a], by_name[b]] = i
            if self.rank[i] < 0:
                self.rank[i], self.left[i], self.right[i] = rank, by_name[a], by_name[b]
        #: Each beginning of a token, with the token's id if it is one itself, else -1.
        self.starting = {b[:n]: -1 for b in self.ids for n in range(1, len(b))} | self.ids
        self.split = regex.compile(PATTERN).findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.borders: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}

    def border(self, a: int, b: int) -> bool:
        """Whether BPE keeps the border between tokens a and b."""
        rank, merged, bound = self.rank, self.merged, NEVER
        while True:
            m = merged.get((a, b))
            if m is not None and rank[m] < bound:
                return False
            at_left, at_right = rank[a], rank[b]
            if at_left < 0 and at_right < 0:
                return True
            if at_left > at_right:
                bound, a = at_left, self.right[a]
            else:  # of merges of one rank, those further left come first
                bound, b = at_right + 1, self.left[b]

    def stands(self, t: int) -> bool:
        """Whether BPE makes token t of its own bytes."""
        if (found := self.whole.get(t)) is None:
            if self.rank[t] < 0:
                found = len(self.bytes_of[t]) == 1
            else:
                a, b = self.left[t], self.right[t]
                merge, self.merged[a, b] = self.merged[a, b], None
                found = self.stands(a) and self.stands(b) and self.border(a, b)
                self.merged[a, b] = merge
            self.whole[t] = found
        return found

    def encode_words(self, words: Iterable[str]) -> None:
        """Adds the words' encodings, as packed 32-bit ids, to what is known."""
        last, open_at = [0], [[]]  # by depth: the last token; the starts from which some token runs on
        before = b""
        get, borders, length = self.starting.get, self.borders, self.length
        for word, text in sorted((w.encode(), w) for w in words):
            same, most = 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            del last[same + 1 :], open_at[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                fit, still = -1, []
                for start in (*open_at[-1], end - 1):
                    token = get(word[start:end])
                    if token is None:
                        continue
                    still.append(start)
                    if fit >= 0 or token < 0:
                        continue
                    if not start:
                        fits = self.stands(token)
                    else:
                        pair = last[start] << 20 | token
                        fits = borders.get(pair)
                        if fits is None:
                            fits = self.stands(token) and self.border(last[start], token)
                            if len(borders) > BORDERS:
                                borders.clear()
                            borders[pair] = fits
                    if fits:
                        fit = token
                if fit < 0:
                    raise ValueError(f"no encoding for {word!r}")
                last.append(fit)
                open_at.append(still)
            ids, end = [], len(word)
            while end:
                token = last[end]
                ids.append(token)
                end -= length[token]
            self.known[text] = array("i", ids[::-1]).tobytes()
            before = word

    def pieces(self, text: str) -> Iterator[str | int]:
        """The text between special tokens, and the ids of those."""
        for part in self.at_special.split(text) if self.at_special else [text]:
            if part in self.special:
                yield self.special[part]
            elif part:
                yield part

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        split = [[p if isinstance(p, int) else self.split(p) for p in self.pieces(t)] for t in texts]
        new = {w for parts in split for p in parts if not isinstance(p, int) for w in p if w not in self.known}
        if len(self.known) + len(new) > REMEMBERED and self.known:
            self.known.clear()
            new = {w for parts in split for p in parts if not isinstance(p, int) for w in p}
        self.encode_words(new)
        of = self.known.__getitem__
        return [b"".join(np.int32(p).tobytes() if isinstance(p, int) else b"".join(map(of, p)) for p in parts) for parts in split]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.blob[at].tobytes().decode("utf-8", "replace")


_loaded: dict[str, BytePairs] = {}


def _pairs(content: str, encodes: bool) -> BytePairs:
    key = f"{hashlib.sha256(content.encode()).hexdigest()}{encodes}"
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = BytePairs(content, encodes)
    return _loaded[key]


def _slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about that many bytes of the column, a row at least."""
    column_of = batch.column(column)
    if pa.types.is_list(column_of.type):
        bytes_in = np.diff(column_of.offsets.to_numpy()) * 4
    else:
        bytes_in = pc.fill_null(pc.binary_length(column_of), 0).to_numpy(zero_copy_only=False)
    sizes = np.cumsum(bytes_in)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _with_column(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    names = [*(n for n in batch.schema.names if n != name), name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:-1]), column], names=names)


def _schema(df: DataFrame, name: str, kind: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != name), f"`{name}` {kind}"])


def bpe_encode(df: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with ids_col: the ids (array<int>) of each whole text, special tokens' strings as their ids.

    vocabulary is the path of a tokenizers JSON file. A null text is encoded as the empty one: no ids. An
    existing ids_col is replaced; an empty table stays empty. Memory: a few MB of text at a time, at least
    one text.
    """
    content = df.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _pairs(content.value, True)
        for whole in batches:
            for batch in _slices(whole, text_col, SLICE):
                packed = pairs.encode_batch([t or "" for t in batch.column(text_col).to_pylist()])
                offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(packed), dtype=np.int32))
                yield _with_column(batch, ids_col, pa.ListArray.from_arrays(pa.array(offsets), values))

    return df.mapInArrow(run, _schema(df, ids_col, "array<int>"))


def bpe_decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with text_col: the text of each row's ids, special tokens included; null or no ids give the empty text."""
    content = df.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _pairs(content.value, False)
        for whole in batches:
            for batch in _slices(whole, ids_col, SLICE):
                lists = batch.column(ids_col)
                offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
                texts = [pairs.decode(values[a:b].astype(np.int64)) for a, b in zip(offsets, offsets[1:], strict=False)]
                yield _with_column(batch, text_col, pa.array(texts, pa.string()))

    return df.mapInArrow(run, _schema(df, text_col, "string"))


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = bpe_decode(bpe_encode(docs, path).drop("text"), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
