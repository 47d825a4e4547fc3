from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from shoplytic.operators import sales
from shoplytic.schema import Tables
from shoplytic.streaming import running, sales_stream

SCHEMA = (
    "order_id long, customer_id long, payment_method string, total_amount decimal(18,2), "
    "order_ts timestamp"
)
START = dt.datetime(2024, 1, 1)


def orders(spark, rows):
    text = SCHEMA.replace("decimal(18,2)", "string")
    amount = F.col("total_amount").cast("decimal(18,2)")
    return spark.createDataFrame(rows, text).withColumn("total_amount", amount)


def made(count, days, seed=3):
    pick = random.Random(seed)
    return [
        (
            i,
            pick.choice([None, -5, 0, 32_768, 32_769, 10**12, *range(1, 40)]),
            pick.choice(["PayPal", "iDEAL"]),
            pick.choice([None, "19.99", "3.10", "250.00"]),
            START + dt.timedelta(minutes=pick.randrange(days * 1440)),
        )
        for i in range(count)
    ]


def add_file(spark, folder, rows):
    orders(spark, rows).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_distinct_customers_are_exact_in_every_batch(spark, tmp_path):
    rows, folder = made(300, 10), str(tmp_path / "in")
    for part in (rows[:5], rows[5:150], rows[150:]):
        add_file(spark, folder, part)

    def run():
        sales_stream.update_stream(
            running.customer_buckets(stream(spark, folder)),
            str(tmp_path / "out"), str(tmp_path / "state"),
        ).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    written = run()
    for batch, seen in enumerate((rows[:5], rows[:150], rows)):
        so_far = sales_stream.newest_rows(written.filter(F.col("batch_id") <= batch), "bucket")
        got = running.exact_totals(so_far).first()
        whole = orders(spark, seen).agg(
            F.count("*"), F.sum("total_amount"), F.countDistinct("customer_id")
        ).first()
        assert (got[0], got[1], got[3]) == tuple(whole)
    # 4 KB per bucket of 32,768 ids that has a customer, and one bucket for null.
    newest = sales_stream.newest_rows(written, "bucket")
    assert newest.agg(F.max(F.octet_length("customers"))).first()[0] == 4096
    assert newest.count() == len(
        {None if c is None else int((c if c <= 0 else c + 32_767) / 32_768) for _, c, *_ in rows}
    )
    # A restart goes on with the customers it knows.
    add_file(spark, folder, [(900, 7, "iDEAL", "1.00", START), (901, 777, "iDEAL", None, START)])
    again = running.exact_totals(sales_stream.newest_rows(run(), "bucket")).first()
    assert (again[0], again[3]) == (302, len({r[1] for r in rows if r[1] is not None}) + 1)


def test_buckets_of_two_streams_merge(spark):
    rows = made(200, 5)
    parts = [running.customer_buckets(orders(spark, rows[n::2])) for n in range(2)]
    both = running.exact_totals(running.merged_buckets(parts[0].union(parts[1]))).first()
    assert both == running.exact_totals(running.customer_buckets(orders(spark, rows))).first()
    assert both[3] == len({r[1] for r in rows if r[1] is not None})


def test_totals_of_nothing(spark):
    got = running.exact_totals(running.customer_buckets(orders(spark, []))).first()
    assert tuple(got) == (0, None, None, 0)


def features_of(spark, rows, series):
    shop = orders(spark, rows).withColumn("order_status", F.lit("shipped"))
    shop = shop.withColumn("order_date", F.to_date("order_ts"))
    return sales.sales_features(sales.daily_sales(Tables(orders=shop), series), series)


def test_running_features_equal_those_of_the_batch(spark, tmp_path):
    rows = sorted(made(900, 75, seed=8), key=lambda r: r[4])
    folder = str(tmp_path / "in")
    # Three files in the order of time, the last with an order far ahead that closes all days.
    ahead = (9999, 1, None, None, START + dt.timedelta(days=400))
    for part in (rows[:400], rows[400:650], [*rows[650:], ahead]):
        add_file(spark, folder, part)
    for series in ((), ("payment_method",)):
        home = tmp_path / str(len(series))
        with running.stateful_session(spark):
            days = running.closed_days(stream(spark, folder), series)
            query = sales_stream.append_stream(
                running.running_features(days, series), str(home / "out"), str(home / "state")
            )
            query.awaitTermination()
        expected = features_of(spark, rows, list(series))
        got = spark.read.parquet(str(home / "out")).select(*expected.columns)
        order = [*series, "sales_date"]
        assert expected.count() > 30
        for ours, theirs in zip(
            got.orderBy(*order).collect(), expected.orderBy(*order).collect(), strict=True
        ):
            assert ours == theirs
