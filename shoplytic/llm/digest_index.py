"""Exact deduplication against a persistent index of text digests.

The index is a table bucketed and sorted by digest that lies in a folder of its own.
New documents shrink to one row per digest, a sort-merge anti-join with the index
leaves the digests it has not seen, and those are appended. The index side is read
bucket by bucket and is not shuffled, so a small arrival costs no exchange of the
many digests already known.

The first arrival decides which document stays; within one arrival it is the largest
doc_id. A null text is the empty text; a null doc_id is smaller than any other.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplytic.llm.common import text_or_empty
from shoplytic.session import pinned
from shoplytic.sources.ledger import Ledger


def text_digests(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the SHA-256 ``digest`` (32 bytes) of every text."""
    return docs.select("doc_id", F.unhex(F.sha2(text_or_empty(), 256)).alias("digest"))


class DigestIndex:
    """The digests seen so far, each with the document that stays (``keep_id``)."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 32) -> None:
        """Open the index in ``folder``, or begin an empty one there.

        The bucket count is kept beside the data; opening it with another one is refused, as
        digests would then be looked for in the wrong buckets.
        """
        self.spark, self.folder, self.buckets = spark, folder, buckets
        settings = Ledger(spark, f"{folder.rstrip('/')}/_settings", "buckets int")
        known = settings.entries().agg(F.min("buckets")).first()[0]
        if known is None:
            settings.add(buckets)
        elif known != buckets:
            raise ValueError(f"the index in {folder} has {known} buckets, not {buckets}")
        self.table = f"digest_index_{hashlib.sha256(folder.encode()).hexdigest()[:16]}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT) "
            "USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
            f"INTO {buckets} BUCKETS LOCATION '{folder}'"
        )

    def rows(self) -> DataFrame:
        """The whole index as bucketed table."""
        return self.spark.table(self.table)

    def unseen(self, digests: DataFrame) -> DataFrame:
        """One row per digest that the index lacks, with the doc_id to keep."""
        arrived = digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        return arrived.join(self.rows().hint("merge"), "digest", "left_anti")

    def append(self, digests: DataFrame) -> None:
        """Add what ``unseen`` leaves. Adding the same documents again adds nothing.

        The anti-join is pinned first: an insert must not read the table it changes,
        and a retried task must not see half of its own rows.
        """
        new = pinned(self.unseen(digests))
        new.repartition(self.buckets, "digest").select("digest", "keep_id").write.insertInto(
            self.table
        )
        self.spark.catalog.refreshTable(self.table)

    def kept_ids(self) -> DataFrame:
        """The index without its bucket layout.

        A bucketed side fixes the layout of a join, and AQE can then not split the
        digest that a third of all rows may share.
        """
        return self.spark.read.schema(self.rows().schema).parquet(self.folder)

    def assign(self, digests: DataFrame) -> DataFrame:
        """One row per document: which document of its text stays, and how many share it.

        Of rows that repeat both doc_id and text, one is kept. Hot digests are counted
        by partial sums; the join with them is split by AQE, as both sides are shuffled
        for it.
        """
        sizes = digests.groupBy("digest").agg(F.count("*").alias("group_size"))
        groups = pinned(sizes.join(self.kept_ids(), "digest"))
        rows = digests.groupBy("digest", "doc_id").agg(F.count("*").alias("copies"))
        return (
            rows.join(groups, "digest")
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
            .select(
                "doc_id",
                "keep_id",
                "group_size",
                (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                F.lower(F.hex("digest")).alias("text_sha256"),
            )
        )
