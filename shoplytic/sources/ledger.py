"""A ledger: what has been committed to a folder, one small file per entry.

Data is written first, into a place of its own; the entry that makes it count is written
last. The entry is a single file that the committer renames into place, so a reader sees
all of a load or nothing of it, and a load that is in the ledger is never written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Ledger:
    """Rows of ``schema`` in ``folder``; the folder is made if it isn't there."""

    def __init__(self, spark: SparkSession, folder: str, schema: str) -> None:
        self.spark, self.folder, self.schema = spark, folder, schema
        spark.createDataFrame([], schema).write.mode("ignore").parquet(folder)

    def entries(self) -> DataFrame:
        """All entries committed by now."""
        return self.spark.read.schema(self.schema).parquet(self.folder)

    def add(self, *values: object) -> None:
        """Commit one entry."""
        self.add_all(self.spark.createDataFrame([values], self.schema))

    def add_all(self, entries: DataFrame) -> None:
        """Commit some entries together, as one file."""
        entries.coalesce(1).write.mode("append").parquet(self.folder)
