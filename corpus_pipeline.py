"""The corpus pipeline: documents through five operators of ``erario.llm``.

``STAGES`` lists (name, function); each function takes ``(spark, docs, sf_dir)``
and works on all that its predecessor kept. ``run`` writes each stage's result
as Parquet into the shared folder and reads it back for the next one. All but
the last stage return the columns of ``documents``; rows with a NULL text or a
repeated id are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erario.llm import langid, linededup, mixing, ngramjoin, packing, queries
from erario.llm.common import saved, table, word_count
from erario.session import apply_defaults

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is recognised go (NULL texts, texts
    without a letter, texts that share no n-gram with any profile); the others
    stay as they are."""
    found = langid.predict_languages(docs)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") > 0)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines are deleted from the texts; documents of
    which no word is left go. ``n_chars`` follows the text."""
    kept = linededup.dedup_lines(docs)
    kept = kept.where((F.col("n_removed") == 0) | (word_count(F.col("text")) > 0))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long"))
                           .otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with similar shingle sets the one with
    the smallest doc_id stays; documents without words link with nothing and stay."""
    return ngramjoin.one_per_component(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once for every pass of the mix that takes any of it."""
    return mixing.apply_mix(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the sequences. The cache
    is small: the workers still hold memory of the stages before."""
    return packing.pack(docs, queries.vocabulary(), cached=60_000)


def _prepared(stage):
    """The stage on a session with this library's settings: batches of whole
    texts must be bounded in bytes beside a small heap."""
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        apply_defaults(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(stage.__name__, _prepared(stage)) for stage in (language, lines, near_duplicates, mix, pack)]

#: Rank-order profiles, winnowing and tokenisation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
