"""Table readers, the append sink and parametrised SQL."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplytic.schema import SCHEMAS, Tables
from shoplytic.session import pinned
from shoplytic.sources.ledger import Ledger


def typed(df: DataFrame, name: str) -> DataFrame:
    """``df`` in the column order and types of table ``name``.

    Columns the source lacks become null; ``order_date`` timestamps become dates.
    """
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in SCHEMAS[name].fields
        ]
    )


def read_files(spark: SparkSession, root: str, file_format: str = "parquet") -> Tables:
    """The six tables from ``root/<table>`` folders."""
    frames = {
        name: typed(spark.read.format(file_format).load(f"{root}/{name}"), name)
        for name in SCHEMAS
    }
    return Tables(**frames)


GROWING = ("customers", "orders", "order_items")


@dataclass(frozen=True)
class Split:
    """How a JDBC table is cut into parallel range reads."""

    column: str
    lower: int
    upper: int
    partitions: int


def read_database(
    spark: SparkSession,
    url: str,
    splits: Mapping[str, Split],
    options: Mapping[str, str] | None = None,
) -> Tables:
    """The six tables over JDBC; a table with a ``Split`` is read in parallel.

    Tables that grow with the shop must have one: without it a single task reads all.
    """
    missing = [name for name in GROWING if name not in splits]
    if missing:
        raise ValueError(f"give a Split for {', '.join(missing)}")
    frames = {}
    for name in SCHEMAS:
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
        reader = reader.options(**(options or {}))
        if name in splits:
            cut = splits[name]
            reader = reader.options(
                partitionColumn=cut.column,
                lowerBound=cut.lower,
                upperBound=cut.upper,
                numPartitions=cut.partitions,
            )
        frames[name] = typed(reader.load(), name)
    return Tables(**frames)


def append(
    df: DataFrame,
    target: str,
    columns: Sequence[str],
    file_format: str = "parquet",
    options: Mapping[str, str] | None = None,
) -> None:
    """Append ``columns`` of ``df``, in that order; an empty frame writes nothing.

    For ``file_format="jdbc"`` the target is the table name and ``options``
    carries the url and, say, ``batchsize``.
    """
    # Pinned, so that the test for rows and the write do not both run the plan.
    rows = pinned(df.select(*columns))
    if rows.isEmpty():
        return
    writer = rows.write.mode("append").format(file_format).options(**(options or {}))
    if file_format == "jdbc":
        writer.option("dbtable", target).save()
    else:
        writer.save(target)


LOADS = "_loads"


def _loads(spark: SparkSession, target: str) -> Ledger:
    # Spark skips folders that begin with an underscore when it reads the target.
    return Ledger(spark, f"{target}/{LOADS}", "load string, written long")


def append_once(df: DataFrame, target: str, columns: Sequence[str], load: str) -> bool:
    """Append ``columns`` of ``df`` as ``load``; false if that load is there already.

    A load is a partition of its own. Running it again after a failure replaces what it
    left, and other loads are not touched; the ledger entry, written last, makes it count.
    ``loaded`` reads the table.
    """
    ledger = _loads(df.sparkSession, target)
    if not ledger.entries().filter(F.col("load") == load).isEmpty():
        return False
    rows = pinned(df.select(*columns))
    rows.withColumn("load", F.lit(load)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("load").parquet(target)
    ledger.add(load, rows.count())
    return True


def loaded(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """The rows of all loads that ``append_once`` has finished; folders of others aren't read."""
    loads = [r["load"] for r in _loads(spark, target).entries().collect() if r["written"]]
    if not loads:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, load string").parquet(target)
    return rows.filter(F.col("load").isin(loads)).drop("load")


def register(t: Tables) -> None:
    """Name the tables as temporary views for SQL."""
    for name in SCHEMAS:
        frame = getattr(t, name)
        if frame is not None:
            frame.createOrReplaceTempView(name)


def query(t: Tables, text: str, params: Mapping[str, object] | None = None) -> DataFrame:
    """Run SQL with ``:name`` parameters over the tables."""
    register(t)
    spark = next(f for n in SCHEMAS if (f := getattr(t, n)) is not None).sparkSession
    return spark.sql(text, args=dict(params or {}))
