import datetime as dt

import pytest
from pyspark.sql import functions as F

from shop_data import AS_OF, day, rows
from shoplytic.schema import SCHEMAS
from shoplytic.sources import tables, views
from shoplytic.streaming import sales_stream

STREAM = "order_id long, customer_id long, total_amount decimal(18,2), order_ts timestamp"


def _save(t, root):
    for name in SCHEMAS:
        getattr(t, name).write.mode("overwrite").parquet(f"{root}/{name}")


def test_round_trip(spark, small, tmp_path):
    _save(small, tmp_path)
    read = tables.read_files(spark, str(tmp_path))
    for name, schema in SCHEMAS.items():
        frame = getattr(read, name)
        assert [(f.name, f.dataType) for f in frame.schema] == [
            (f.name, f.dataType) for f in schema
        ]
        assert frame.count() == getattr(small, name).count()


def test_timestamps_become_dates(spark):
    raw = spark.createDataFrame([(1, dt.datetime(2024, 5, 6, 7, 8))], "order_id int, order_date timestamp")
    got = rows(tables.typed(raw, "orders"))[0]
    assert got["order_date"] == day("2024-05-06") and got["notes"] is None


def test_append(spark, small, tmp_path):
    target = str(tmp_path / "out")
    tables.append(small.categories.filter("false"), target, ["category_id"])
    assert not (tmp_path / "out").exists()
    for _ in range(2):
        tables.append(small.categories, target, ["category_name", "category_id"])
    got = spark.read.parquet(target)
    assert got.columns == ["category_name", "category_id"] and got.count() == 4


def test_query_with_parameters(small):
    text = "SELECT count(*) AS n FROM orders WHERE order_status = :status"
    assert rows(tables.query(small, text, {"status": "pending"})) == [{"n": 1}]


def test_views(spark, small, tmp_path):
    views.register_views(small, AS_OF)
    got = rows(spark.sql(
        "SELECT customer_tier, count(*) AS n FROM customer_ml_features GROUP BY customer_tier"))
    assert {r["customer_tier"]: r["n"] for r in got} == {"Gold": 2, "Bronze": 1, "Silver": 1}
    assert spark.table("daily_sales_features").count() == 0
    views.publish_affinity(small, str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 1
    views.publish_daily_sales(small, str(tmp_path / "daily"))


def _files(spark, folder, *batches):
    """One file per batch, oldest first."""
    for n, batch in enumerate(batches):
        records = [(o, c, a, dt.datetime.fromisoformat(ts)) for o, c, a, ts in batch]
        df = spark.createDataFrame(records, "order_id long, customer_id long, total_amount double, order_ts timestamp")
        df = df.withColumn("total_amount", F.col("total_amount").cast("decimal(18,2)"))
        df.coalesce(1).write.parquet(f"{folder}/part{n}")


BATCHES = (
    [(1, 1, 10.0, "2024-01-01T08:00:00"), (2, 1, 5.0, "2024-01-01T23:59:59"),
     (3, 2, 1.0, "2024-01-01T10:00:00")],
    [(2, 1, 5.0, "2024-01-01T23:59:59"), (4, 2, 7.0, "2024-01-02T01:00:00")],
    [(5, 3, 2.0, "2024-01-05T00:00:00")],
)


def _stream(spark, folder):
    return sales_stream.order_stream(
        spark, f"{folder}/*", STREAM, files="*.parquet", files_per_batch=1
    )


def _written(spark, stream, write, home):
    write(stream, str(home / "out"), str(home / "state")).awaitTermination()
    return spark.read.parquet(str(home / "out"))


def test_daily_stream_equals_batch(spark, tmp_path):
    _files(spark, str(tmp_path / "in"), *BATCHES)
    stream = sales_stream.day_customers(_stream(spark, tmp_path / "in"), "10 days")
    written = _written(spark, stream, sales_stream.update_stream, tmp_path)
    days = sales_stream.newest_rows(written, "sales_date", "customer_id")
    got = {r["sales_date"]: r for r in rows(sales_stream.daily_sales(days))}
    orders = spark.read.schema(STREAM).parquet(str(tmp_path / "in" / "*"))
    batch = orders.groupBy(F.to_date("order_ts").alias("d")).agg(
        F.count("*").alias("n"), F.sum("total_amount").alias("s"),
        F.countDistinct("customer_id").alias("c"))
    expected = {r["d"]: r for r in rows(batch)}
    # The newest day is there too.
    assert set(got) == {day("2024-01-01"), day("2024-01-02"), day("2024-01-05")}
    for date, row in got.items():
        assert (row["order_count"], row["daily_revenue"], row["unique_customers"]) == (
            expected[date]["n"], expected[date]["s"], expected[date]["c"])


def test_late_rows_are_counted(spark, tmp_path):
    _files(spark, str(tmp_path / "in"), *BATCHES[::-1])
    stream = sales_stream.day_customers(_stream(spark, tmp_path / "in"), "1 day")
    query = sales_stream.update_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    seen = spark.read.parquet(str(tmp_path / "out")).agg(F.sum("orders")).first()[0]
    assert sales_stream.late_rows(query) > 0 and seen < 6


def test_null_amounts_do_not_lower_the_average(spark, tmp_path):
    batch = [(1, 1, None, "2024-01-01T08:00:00"), (2, 2, 10.0, "2024-01-01T09:00:00")]
    _files(spark, str(tmp_path / "in"), batch)
    days = sales_stream.day_customers(_stream(spark, tmp_path / "in"))
    written = _written(spark, days, sales_stream.update_stream, tmp_path / "a")
    newest = sales_stream.newest_rows(written, "sales_date", "customer_id")
    assert rows(sales_stream.daily_sales(newest))[0]["avg_order_value"] == 10.0
    totals = sales_stream.running_totals(_stream(spark, tmp_path / "in"))
    written = _written(spark, totals, sales_stream.complete_stream, tmp_path / "b")
    assert rows(sales_stream.latest(written))[0]["avg_order_value"] == 10.0


def test_running_totals(spark, tmp_path):
    _files(spark, str(tmp_path / "in"), *BATCHES)
    stream = sales_stream.running_totals(_stream(spark, tmp_path / "in"))
    written = _written(spark, stream, sales_stream.complete_stream, tmp_path)
    assert written.count() == 3
    got = rows(sales_stream.latest(written))
    assert len(got) == 1
    assert (got[0]["total_orders"], float(got[0]["total_revenue"])) == (6, 30.0)
    assert got[0]["active_customers_estimate"] == 3


def test_repeats_are_loaded_once_and_replays_change_nothing(spark, tmp_path):
    _files(spark, str(tmp_path / "in"), *BATCHES)
    target = str(tmp_path / "out")

    def load(state):
        stream = sales_stream.first_arrivals(_stream(spark, tmp_path / "in"), late_by="2 days")
        sales_stream.append_stream(stream, target, str(tmp_path / state)).awaitTermination()
        return sorted(r["order_id"] for r in rows(spark.read.parquet(target)))

    assert load("state") == [1, 2, 3, 4, 5]
    assert load("state") == [1, 2, 3, 4, 5]  # nothing new
    assert load("fresh") == [1, 2, 3, 4, 5]  # same batches again, same folders


def test_large_tables_need_a_split(spark):
    with pytest.raises(ValueError, match="orders"):
        tables.read_database(spark, "jdbc:none", {})


def test_append_runs_its_plan_once(spark, small, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(value):
        runs.add(1)
        return value

    tables.append(
        small.categories.withColumn("category_id", counted("category_id")),
        str(tmp_path / "once"),
        ["category_id"],
    )
    assert runs.value == 2
