"""The corpus pipeline: stages over documents, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  All but the last return the columns of documents, whatever further
columns there are and whatever their names.  Rows that repeat are rows each,
texts are taken whole however long they are, and an empty table gives an empty
table; what a stage does with nulls and ties stands beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from simplicia.llm import mixing, near_dedup, quality, sentence_pieces, toxicity
from simplicia.llm.shared import read, written


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go.

    A null or empty text is scored as a text without features, and a null
    doc_id doesn't matter to a score.  Repeated rows go or stay together.
    """
    return toxicity.keep_harmless(docs, read(spark, sf_dir, "labels"))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or diverge from their language go.

    A null or empty text has no words and goes.  A null language is a language
    of its own, the empty one another.  Repeated rows go or stay together.
    """
    return quality.keep_good(docs)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the smallest doc_id.

    Texts without words are no one's duplicates and stay, as do rows with a
    null doc_id.  Repeated rows of the doc_id that stays all stay.
    """
    return near_dedup.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document stands as often as the mix takes it.

    A null source is a source of its own.  Texts without words weigh nothing.
    Of equal rows at the cut of a source as many are taken as fit.
    """
    return mixing.mix_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the piece ids of every text of the mix, one row for each; a null or empty text has no ids."""
    return sentence_pieces.encode_texts(docs).select("doc_id", "lang", "source", "ids")


STAGES = [
    ("toxicity", harmless),
    ("quality", good),
    ("near_dedup", unique),
    ("mixing", mixed),
    ("sentence_pieces", encoded),
]

#: SQL can't express the learned toxicity stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
