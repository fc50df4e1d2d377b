"""Exact deduplication of texts by two passes over Bloom filters of hashes, with DataFrame functions only.

Pass one counts how often each cell of a wide one-probe filter is taken. The filter is kept sparse, a number for
each cell taken: as bits it would have to be sent whole by every task, which costs more than the cells from the
eighth task on and grows with the square of the input. Cells are combined before the shuffle; texts stay where
they are. The cells taken twice or more make a second, blocked filter, whose size follows from their number.
Pass two probes it: a row that misses is the only one of its text and passes straight through; only the others
shuffle, as hash and id, to be grouped exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stored import stored
from .common import attach, one_each, probed_repeats, repeats, without

#: ASCII white space: space and tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: str | Column) -> Column:
    """Text with each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACES, " ")


def _hashed(docs: DataFrame, text: str) -> DataFrame:
    sha = F.unhex(F.sha2(normalised(text), 256))
    return docs.withColumn("tw_sha", sha).withColumn("tw_h", F.xxhash64("tw_sha"))


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Stored rows tw_id, tw_sha, tw_seq (a number of the row), keep_id, keep_seq and group_size."""
    slim = _hashed(docs.select(F.col(id_col).alias("tw_id"), F.col(text_col).alias("tw_text")), "tw_text")
    slim = stored(slim.select("tw_id", "tw_sha", "tw_h", F.monotonically_increasing_id().alias("tw_seq")), "hashes")
    bloom, words = repeats(slim, "tw_h")
    tried = probed_repeats(slim, "tw_h", bloom, words).drop("tw_h")
    least = F.min(F.struct(F.col("tw_id").isNull().alias("none"), "tw_id", "tw_seq"))
    groups = tried.where("tw_maybe").groupBy("tw_sha").agg(least.alias("first"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = stored(groups.select("tw_sha", F.col("first.tw_id").alias("keep_id"), F.col("first.tw_seq").alias("keep_seq"), "group_size"), "groups")
    alone = tried.where(~F.col("tw_maybe")).drop("tw_maybe").withColumns({"keep_id": F.col("tw_id"), "keep_seq": F.col("tw_seq"), "group_size": F.lit(1).cast("long")})
    again = attach(tried.where("tw_maybe").drop("tw_maybe"), groups, "tw_sha", "group_size", slim.count())
    single = F.col("group_size").isNull()
    again = again.withColumns({"keep_id": F.when(single, F.col("tw_id")).otherwise(F.col("keep_id")), "keep_seq": F.coalesce("keep_seq", "tw_seq"), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    return alone.unionByName(again)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of docs its id, keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after :func:`normalised`; of equal texts the row with the smallest id
    stays, of rows that share id and text one, whichever was read first. Null texts equal the empty text, long
    ones are read whole. A null id never wins against another. An empty table gives an empty result; other
    columns of docs are not read.
    """
    marked = _marked(docs, id_col, text_col)
    return marked.select(F.col("tw_id").alias(id_col), "keep_id", "group_size", (F.col("tw_seq") == F.col("keep_seq")).alias("kept"), F.lower(F.hex("tw_sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their own columns, whatever their names: one of each text.

    Rows that are to go are looked for by id and hash; a row is shuffled only if a filter of those may hold it.
    """
    marked = _marked(docs, id_col, text_col)
    key = lambda: F.struct(F.coalesce(F.col("tw_id").cast("string"), F.lit("")).alias("id"), "tw_sha").alias("tw_key")
    lost = stored(marked.where(F.col("tw_seq") != F.col("keep_seq")).select(key(), F.col("tw_id").eqNullSafe(F.col("keep_id")).alias("twin")).distinct(), "lost")
    gone, twins = lost.where("not twin").select("tw_key"), lost.where("twin").select("tw_key")
    rows = docs.select(F.struct(*docs.columns).alias("tw_row"), F.col(id_col).alias("tw_id"), F.unhex(F.sha2(normalised(text_col), 256)).alias("tw_sha")).select("tw_row", key())
    return one_each(without(rows, "tw_key", gone), "tw_key", twins).select("tw_row.*")


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, text_sha256
from t window w as (partition by text_sha256)
"""
