from __future__ import annotations

import datetime as dt

import pytest

from shoplytic.streaming import insert_once

SCHEMA = "order_id long, customer_id long, order_ts timestamp"


def at(day: int, hour: int = 0) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)


def add_file(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


class Home:
    def __init__(self, spark, tmp_path, **options):
        self.spark, self.tmp, self.options = spark, tmp_path, options

    def index(self):
        return insert_once.ArrivedKeys(
            self.spark, str(self.tmp / "index"), **{"buckets": 4, **self.options}
        )

    def run(self, state="state"):
        stream = (
            self.spark.readStream.schema(SCHEMA)
            .option("maxFilesPerTrigger", 1)
            .parquet(str(self.tmp / "in"))
        )
        insert_once.insert_stream(
            stream, self.index(), str(self.tmp / "out"), str(self.tmp / state)
        ).awaitTermination()
        return self.rows()

    def rows(self):
        found = insert_once.loaded_rows(self.index(), str(self.tmp / "out"), SCHEMA)
        return sorted(((r.order_id, r.customer_id) for r in found.collect()), key=str)


def test_a_key_repeated_after_thirty_days_and_a_restart(spark, tmp_path):
    home = Home(spark, tmp_path)
    folder = str(tmp_path / "in")
    add_file(spark, folder, [(1, 10, at(0)), (2, 20, at(0)), (1, 11, at(0, 1))])
    assert home.run() == [(1, 10), (2, 20)]
    add_file(spark, folder, [(1, 12, at(30)), (3, 30, at(31))])
    add_file(spark, folder, [(2, 21, at(90)), (3, 31, at(1)), (None, 1, at(91)), (None, 2, at(92))])
    # Restarted from its checkpoint; a null key is a key as well.
    expected = sorted([(1, 10), (2, 20), (3, 30), (None, 1)], key=str)
    assert home.run() == expected
    # A lost checkpoint sends everything again.
    assert home.run("fresh") == expected


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    home = Home(spark, tmp_path)
    index, target = home.index(), str(tmp_path / "out")
    first = spark.createDataFrame([(1, 1, at(0)), (2, 1, at(0))], SCHEMA)
    keys = index.keys()
    assert keys.count() == 0
    # The first try fails behind the rows and before the keys are committed.
    add, index.add = index.add, lambda *given: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        insert_once.load_once(first, index, target, "q-0", ["order_id"], "order_ts")
    assert home.rows() == []
    index.add = add
    for _ in range(2):
        insert_once.load_once(first, index, target, "q-0", ["order_id"], "order_ts")
        assert home.rows() == [(1, 1), (2, 1)]
    assert index.keys().count() == 2


def test_uncommitted_keys_do_not_count(spark, tmp_path):
    home = Home(spark, tmp_path)
    index, target = home.index(), str(tmp_path / "out")
    index._write(spark.createDataFrame([('{"order_id":1}',)], "key string"), "broken-0")
    batch = spark.createDataFrame([(1, 1, at(0))], SCHEMA)
    insert_once.load_once(batch, index, target, "q-0", ["order_id"], "order_ts")
    assert home.rows() == [(1, 1)]


def test_compaction_keeps_every_key(spark, tmp_path):
    home = Home(spark, tmp_path, per_base=2)
    target = str(tmp_path / "out")
    for n in range(5):
        batch = spark.createDataFrame([(n, n, at(n)), (n + 1, n, at(n))], SCHEMA)
        insert_once.load_once(batch, home.index(), target, f"q-{n}", ["order_id"], "order_ts")
    assert home.index().ledger.entries().filter("base").count() == 2
    assert home.index().keys().count() == 6
    assert [k for k, _ in home.rows()] == [0, 1, 2, 3, 4, 5]


def test_another_bucket_count_is_refused(spark, tmp_path):
    Home(spark, tmp_path).index()
    with pytest.raises(ValueError, match="4 buckets"):
        Home(spark, tmp_path, buckets=8).index()


def test_the_index_is_not_shuffled(spark, tmp_path):
    index = Home(spark, tmp_path).index()
    keys = spark.range(1000).selectExpr("CAST(id AS string) AS key")
    index.add(keys, "a", 1000, 1000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seen = index.seen(keys.filter("key LIKE '1%'"))
        plan = seen._jdf.queryExecution().executedPlan().toString()
        assert seen.count() == 111
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 1 and "ShuffledHashJoin" in plan
    assert "Bucketed: true" in plan and "Sort " not in plan
