"""An insert stream that never loads a key twice, however late it comes again.

The keys loaded so far are a persistent table, bucketed by key; each load is a partition.
A micro-batch keeps the first row of each of its keys, finds those that the index has
(the index is read bucket by bucket and is not shuffled), writes the rest into a folder of
its own, then their keys, and last an entry in the ledger. A batch that runs again replaces
what it left, and one that is in the ledger does nothing, so restarts and lost checkpoints
change nothing.

A null in a key is a value like any other. Of rows of one key in a batch the one of least
``first_by`` stays, then the one of least other columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shoplytic.session import pinned
from shoplytic.sources.ledger import Ledger

BUCKETS = 32
# Loads after which the index is written anew as one partition, a sorted file per bucket.
LOADS_PER_BASE = 64


class ArrivedKeys:
    """The index in ``folder``. Its bucket count is kept there; another one is refused."""

    def __init__(
        self, spark: SparkSession, folder: str, buckets: int = BUCKETS, per_base: int = LOADS_PER_BASE
    ) -> None:
        self.spark, self.folder, self.per_base = spark, folder, per_base
        settings = Ledger(spark, f"{folder}/settings", "buckets int")
        known = settings.entries().agg(F.min("buckets")).first()[0]
        if known is None:
            settings.add(buckets)
        elif known != buckets:
            raise ValueError(f"the index in {folder} has {known} buckets, not {buckets}")
        self.buckets = buckets
        # ``base``: the entry stands for all loads before it as well.
        self.ledger = Ledger(
            spark, f"{folder}/ledger", "load string, number long, base boolean, arrived long, loaded long"
        )
        self.table = f"arrived_keys_{hashlib.sha256(folder.encode()).hexdigest()[:16]}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (key STRING, load STRING) USING parquet "
            f"PARTITIONED BY (load) CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS "
            f"LOCATION '{folder}/keys'"
        )
        if not self.ledger.entries().isEmpty():
            spark.sql(f"MSCK REPAIR TABLE {self.table}")  # loads of earlier sessions

    def _loads(self) -> list:
        """Entries in order: one per load, a few numbers each."""
        return self.ledger.entries().orderBy("number").collect()

    def keys(self) -> DataFrame:
        """Every key that a committed load has added, once."""
        entries = self._loads()
        bases = [e.number for e in entries if e.base]
        since = max(bases, default=-1)
        loads = [e.load for e in entries if e.number >= since and (e.base or e.loaded)]
        return self.spark.table(self.table).filter(F.col("load").isin(loads)).select("key")

    def committed(self, load: str) -> bool:
        return not self.ledger.entries().filter(F.col("load") == load).isEmpty()

    def seen(self, keys: DataFrame) -> DataFrame:
        """Those of ``keys`` (distinct, column ``key``) that the index has.

        The keys asked for are built into hash tables bucket by bucket, the index streams by.
        """
        return self.keys().join(keys.hint("shuffle_hash"), "key", "left_semi")

    def add(self, keys: DataFrame, load: str, arrived: int, loaded: int) -> None:
        """Commit ``keys`` as ``load``; all rows that belong to it must be written by now."""
        self._write(keys, load)
        number = self.ledger.entries().agg(F.coalesce(F.max("number"), F.lit(-1))).first()[0] + 1
        self.ledger.add(load, number, False, arrived, loaded)
        entries = self._loads()
        last_base = max((e.number for e in entries if e.base), default=-1)
        if number - last_base >= self.per_base:
            self.compact()

    def _write(self, keys: DataFrame, load: str) -> None:
        view = f"{self.table}_{hashlib.sha256(load.encode()).hexdigest()[:8]}"
        keys.repartition(self.buckets, "key").createOrReplaceTempView(view)
        try:
            # Overwrites this load's partition only.
            keys.sparkSession.sql(
                f"INSERT OVERWRITE TABLE {self.table} PARTITION (load = '{load}') "
                f"SELECT key FROM {view}"
            )
        finally:
            keys.sparkSession.catalog.dropTempView(view)

    def compact(self) -> None:
        """Write all keys as one partition, which replaces the earlier ones for readers."""
        number = self.ledger.entries().agg(F.coalesce(F.max("number"), F.lit(-1))).first()[0] + 1
        self._write(pinned(self.keys()), f"base-{number}")
        self.ledger.add(f"base-{number}", number, True, 0, 0)


def key_text(key: Sequence[str]):
    """The key columns as one text, different for different keys."""
    return F.to_json(F.struct(*key), {"ignoreNullFields": "false"})


def load_once(
    rows: DataFrame, index: ArrivedKeys, target: str, load: str, key: Sequence[str], first_by: str
) -> None:
    """Write the rows of ``rows`` whose key no earlier load had to ``target``, as ``load``."""
    if index.committed(load):
        return
    others = [c for c in rows.columns if c != first_by]
    first = F.min(F.struct(F.struct(first_by, *others).alias("row"))).alias("first")
    # Repeats within the batch shrink before the shuffle.
    firsts = pinned(
        rows.groupBy(key_text(key).alias("key")).agg(first, F.count("*").alias("arrived"))
    )
    seen = index.seen(firsts.select("key"))
    new = pinned(firsts.join(seen, "key", "left_anti"))
    new.select("first.row.*").select(*rows.columns).write.mode("overwrite").parquet(
        f"{target}/load={load}"
    )
    arrived = firsts.agg(F.coalesce(F.sum("arrived"), F.lit(0))).first()[0]
    index.add(new.select("key"), load, arrived, new.count())


def query_id(batch: DataFrame) -> str:
    """The streaming query that ``batch`` belongs to; restarts keep it, a new checkpoint doesn't."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def insert_stream(
    stream: DataFrame,
    index: ArrivedKeys,
    target: str,
    checkpoint: str,
    key: Sequence[str] = ("order_id",),
    first_by: str = "order_ts",
) -> StreamingQuery:
    """Load everything available now; ``loaded_rows`` reads it back."""

    def load(batch: DataFrame, batch_id: int) -> None:
        load_once(batch, index, target, f"{query_id(batch)}-{batch_id}", key, first_by)

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(load)
        .trigger(availableNow=True)
        .start()
    )


def loaded_rows(index: ArrivedKeys, target: str, schema: str) -> DataFrame:
    """The rows of all committed loads."""
    loads = index.ledger.entries().filter("NOT base").select("load")
    rows = index.spark.read.schema(f"{schema}, load string").parquet(target)
    return rows.join(F.broadcast(loads), "load", "left_semi").drop("load")
