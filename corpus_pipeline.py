"""From raw documents to training shards: five stages, each written before the next.

``STAGES`` lists (name, function); a function takes the session, the documents that the
stage before kept, and the data folder with ``labels`` and ``benchmark``. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoplytic.llm import cotraining, decontamination, mixing, near_duplicates, sharding
from shoplytic.llm.common import DOCUMENT, read, stored

SHARDS = 40


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained views take for good ones; the rejected go."""
    docs = docs.select(*DOCUMENT)
    fitted = cotraining.fit_views(docs, read(spark, sf_dir, "labels"))
    return cotraining.good_documents(docs, fitted)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of least doc_id."""
    return near_duplicates.without_near_duplicates(docs.select(*DOCUMENT))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item in them."""
    docs = docs.select(*DOCUMENT)
    leaks = decontamination.find_leaks(docs, read(spark, sf_dir, "benchmark"))
    return decontamination.without_leaks(docs, leaks)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source brought to its target: a row per document and pass that takes from it."""
    return mixing.mixed_documents(docs.select(*DOCUMENT))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with ``shard`` and ``slot``, shards of near equal bytes."""
    return sharding.document_shards(docs.select(*DOCUMENT), SHARDS)


STAGES = [
    ("quality classifier", keep_good),
    ("near duplicates", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("source mixing", mix_sources),
    ("sharding", shard),
]

# A trained classifier decides what the later stages see; SQL can't express that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, f"stage-{number}")
    return docs
