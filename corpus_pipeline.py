"""From raw documents to packed sequences: each stage reads what the one before it wrote.

quality classifier -> exact dedup -> n-gram Jaccard join -> mixing sources to target weights -> best-fit packing.
All stages but the last return the columns of documents.

Every stage gives the result that its operator defines: a null text is empty; an empty text passes the first stage if the
classifier lets it, is one text in exact dedup, links with nothing, and is taken once by the mix; rows that repeat an identifier are told apart by
their texts and sources; an empty table gives an empty one; columns of any names are carried along and not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stridelake.llm import exact_dedup, gam, mixing, ngram_join, packing
from stridelake.llm.shared import Workspace, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return gam.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest doc_id."""
    return exact_dedup.deduplicate(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links hold together: the one with the smallest doc_id."""
    return ngram_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them."""
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mix), ("packing", pack)]

#: The classifier is trained, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.put(stage(spark, docs, sf_dir), f"{k}-{name.replace(' ', '-')}")
        if k:
            work.drop(f"{k - 1}-{STAGES[k - 1][0].replace(' ', '-')}")
    return docs
