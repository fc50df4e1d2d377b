"""Best-fit packing of documents into bins of fixed length, under conflicts.

No bin holds two pieces of one source, or two of one cluster of duplicates. Pieces of documents are dealt by hash
to shards of about the same number of pieces; within a shard, pieces are placed longest first. Bins stand in order
of the room left, a bitmap of rooms serves the successor search, and each bin carries a bitmap of its
sources and one of its duplicate clusters: the search starts at the piece's length and goes on to the next
larger room until a compatible bin is found.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stored import stored
from .exact_dedup import normalised

CAPACITY, SHARD_PIECES = 2048, 8000
WORD = r"[^\x20\x09-\x0D]+"


class Bins:
    """Open bins of a shard."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.room: list[int] = []
        self.sources: list[int] = []  # bitmaps
        self.clusters: list[int] = []
        self.at: dict[int, dict[int, None]] = defaultdict(dict)  # bins by room, oldest first
        self.held: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))  # by room: bins that hold a source
        self.rooms = 0  # bitmap of rooms that some bin has
        self.full_of: dict[int, int] = defaultdict(int)  # by source: rooms all of whose bins hold it

    def _count(self, room: int, bin_: int, by: int) -> None:
        bins, held = self.at[room], self.held[room]
        if by > 0:
            bins[bin_] = None
        else:
            del bins[bin_]
        self.rooms = self.rooms | 1 << room if bins else self.rooms & ~(1 << room)
        own = self.sources[bin_]
        while own:
            low = own & -own
            held[low.bit_length() - 1] += by
            own ^= low
        for source in [*held]:
            if bins and held[source] == len(bins):
                self.full_of[source] |= 1 << room
            else:
                self.full_of[source] &= ~(1 << room)
            if not held[source]:
                del held[source]

    def place(self, length: int, source: int, cluster: int) -> int:
        """The tightest compatible bin, the oldest of these; a new one if there is none. -1: no conflict."""
        mine = 1 << source if source >= 0 else 0
        same = 1 << cluster if cluster >= 0 else 0
        free = (self.rooms & ~(self.full_of[source] if mine else 0)) >> length
        room, chosen = length, -1
        while free and chosen < 0:
            step = (free & -free).bit_length() - 1
            room += step
            chosen = next((b for b in self.at[room] if not (self.sources[b] & mine or self.clusters[b] & same)), -1)
            free >>= step + 1
            room += 1
        if chosen < 0:
            chosen = len(self.room)
            self.room.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        else:
            self._count(self.room[chosen], chosen, -1)
        self.room[chosen] -= length
        self.sources[chosen] |= mine
        self.clusters[chosen] |= same
        if self.room[chosen]:
            self._count(self.room[chosen], chosen, 1)
        return chosen


def _pack_shard(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    frame = frame.sort_values(["length", "id", "part", "row"], ascending=[False, True, True, True], kind="stable")
    sources = pd.factorize(frame["source"])[0]
    clusters, values = pd.factorize(frame["cluster"])
    shared = np.bincount(clusters, minlength=len(values)) > 1
    number = np.where(shared, np.cumsum(shared) - 1, -1)[clusters]
    bins, out, offsets, used = Bins(capacity), [], [], defaultdict(int)
    for length, source, cluster in zip(frame["length"].tolist(), sources.tolist(), number.tolist(), strict=True):
        bin_ = bins.place(length, source, cluster)
        out.append(bin_)
        offsets.append(used[bin_])
        used[bin_] += length
    return pd.DataFrame({"id": frame["id"], "part": frame["part"], "start": frame["start"], "length": frame["length"], "bin_id": frame["shard"] * (1 << 32) + np.array(out, dtype=np.int64), "bin_offset": np.array(offsets, dtype=np.int64)})


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", ids_col: str | None = None, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """A row for each piece: its id, part, start, length, bin_id and bin_offset (in words, or in tokens of ids_col).

    Lengths are numbers of words of text_col or, if ids_col is given, of the tokens in that array. A document longer
    than the capacity is cut into pieces of that length and a rest. Duplicates are documents whose texts are equal
    but for white space; a null source conflicts with none, a null id is packed like any other. A text that is null
    or has no words takes no room: one row of length 0 with a null bin. Rows that are repeated are packed each
    (they conflict) and spread over shards like others. Of pieces of one length the one with the smaller id goes
    first. Shards are independent, so a bin holds pieces of one shard; a shard has shard_pieces pieces on average,
    whatever the input, so the last bins of a shard, one in some thousands of pieces, are all that sharding leaves
    open. An empty table gives an empty result; other columns of docs are not read.
    """
    length = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)) if ids_col is None else F.greatest(F.size(F.coalesce(ids_col, F.array())), F.lit(0))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.xxhash64(normalised(text_col)).alias("cluster"),
        length.cast("long").alias("n"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = stored(rows, "lengths")
    pieces = rows.agg(F.coalesce(F.sum(F.ceil(F.col("n") / capacity)), F.lit(0)).cast("long")).first()[0]
    shards = max(1, -(-pieces // shard_pieces))
    parts = rows.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)).cast("int"))).alias("part"))
    parts = parts.select(
        "id", "source", "cluster", "part", "row",
        (F.col("part").cast("long") * capacity).alias("start"),
        F.least(F.lit(capacity), F.col("n") - F.col("part") * capacity).cast("long").alias("length"),
        F.pmod(F.xxhash64("row", "part"), F.lit(shards)).alias("shard"),
    )
    schema = "id long, part int, start long, length long, bin_id long, bin_offset long"
    placed = parts.where("length > 0").groupBy("shard").applyInPandas(lambda frame: _pack_shard(frame, capacity), schema)
    empty = parts.where("length = 0").select("id", "part", "start", "length", F.lit(None).cast("long").alias("bin_id"), F.lit(0).cast("long").alias("bin_offset"))
    return placed.unionByName(empty).withColumnRenamed("id", id_col)


def filled(docs: DataFrame, pieces: DataFrame, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """A row for each bin: bin_id, ids (its tokens, piece after piece), and the pieces' ids and lengths.

    docs has one row for each id, with its tokens, and pieces what :func:`pack` gave for them.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(ids_col).alias("tokens"))
    cut = pieces.where("bin_id is not null").select(F.col(id_col).alias("id"), "start", "length", "bin_id", "bin_offset").join(own, "id")
    piece = F.struct("bin_offset", "id", "length", F.expr("slice(tokens, cast(start as int) + 1, cast(length as int))").alias("tokens"))
    bins = cut.select("bin_id", piece.alias("piece")).groupBy("bin_id").agg(F.array_sort(F.collect_list("piece")).alias("p"))
    field = lambda name: F.transform("p", lambda x: x[name])
    return bins.select("bin_id", F.flatten(field("tokens")).alias("ids"), field("id").alias("piece_ids"), field("length").alias("piece_lengths"))


def op4_packing(spark, sf_dir: str) -> DataFrame:
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.withColumnRenamed("start", "start_word").withColumnRenamed("length", "n_words")
