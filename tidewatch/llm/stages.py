"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and all but packing return documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, quality
from ..plans.stored import stored
from .common import one_each, without
from .exact_dedup import drop_exact_duplicates
from .near_docs import near_docs
from .packing import pack

#: Least probability of a text's language.
SURE = 0.5


def _apart(docs: DataFrame) -> DataFrame:
    """text, and the other columns as one, tw_rest: a stage's own columns clash with none, and a text is handed over once."""
    return docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("tw_rest"), "text")


def _put_back(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*(F.col("text") if c == "text" else F.col("tw_rest")[c].alias(c) for c in columns))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good; it is fitted on the stage's own input.

    A null text counts as empty, a null id is not learned from. Repeated rows are judged alike and all kept or all
    dropped. Without enough labelled rows, or for an empty table, nothing is learned, and the chance of one half is
    below the threshold: no row stays.
    """
    learn = ~langid.held_out()
    model = quality.fit(docs.where(learn), spark.read.parquet(f"{sf_dir}/labels.parquet").where(learn))
    return _put_back(quality.score(_apart(docs), model).where("predicted = 1"), docs.columns)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough certainty.

    Null texts and texts without letters are of no language and go, as do all if no row has a language to learn
    from. Repeated rows are judged alike. An empty table gives an empty result.
    """
    model = langid.fit(docs.where(~langid.held_out()), langid.default_vocabulary())
    told = langid.identify(_apart(docs), model)
    return _put_back(told.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= SURE)), docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text; nulls, ties and repeated rows as :func:`drop_exact_duplicates` has them."""
    return drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies.

    Documents without words have no copies and stay. Of rows that share an id and lie in one group the one with
    the smallest text hash stays, of rows that share id and text one. A null id counts as the largest. An empty
    table gives an empty result.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))
    rows = docs.select(F.struct(*docs.columns).alias("tw_row"), key.alias("tw_key"), "text")
    found = stored(near_docs(rows.select("tw_key", "text"), id_col="tw_key").groupBy("tw_key").agg(F.any_value("component_id").alias("component_id"), F.count("*").alias("n")), "near")
    gone, twins = found.where("tw_key <> component_id").select("tw_key"), found.where("tw_key = component_id and n > 1").select("tw_key")
    slim = rows.select("tw_row", "tw_key")
    return one_each(without(slim, "tw_key", stored(gone, "near-copies")), "tw_key", twins).select("tw_row.*")


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of the documents' pieces, as :func:`packing.pack` gives them, nulls, ties and repeated rows too."""
    return pack(docs).withColumnRenamed("start", "start_word").withColumnRenamed("length", "n_words")
