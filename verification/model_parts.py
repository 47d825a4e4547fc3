"""Registered queries on the parts of the models that SQL can check.

Splits, risk reports and the forecast calendar do not depend on what a model learned;
``model_checks`` states what must hold of fitted models, whatever they learned.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from shoplytic.functions.dates import weekday_from_monday
from shoplytic.functions.labels import risk_level
from shoplytic.functions.numeric import clamp
from shoplytic.operators import churn, sales
from shoplytic.operators.ranking import in_sorted_slices
from shoplytic.plans import churn as churn_model
from shoplytic.plans import forecast as forecast_model
from shoplytic.session import checkpoint_folder, pinned
from shoplytic.sources import tpch


def churn_split_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Per label: customers, and how many of them are for testing."""
    features = churn.churn_features(tpch.load(spark, folder), tpch.AS_OF)
    split = churn_model.stratified_split(features, "is_churned", "customer_id")
    return split.groupBy("is_churned").agg(
        F.count("*").alias("customers"), F.count_if("is_test").alias("for_test")
    )


def forecast_split(spark: SparkSession, folder: str) -> DataFrame:
    features = sales.sales_features(sales.daily_sales(tpch.load(spark, folder)))
    return forecast_model.chronological_split(features).select("sales_date", "is_test")


def forecast_split_by_payment(spark: SparkSession, folder: str) -> DataFrame:
    series = ["payment_method"]
    daily = sales.daily_sales(tpch.load(spark, folder), series)
    split = forecast_model.chronological_split(sales.sales_features(daily, series), series)
    return split.select("payment_method", "sales_date", "is_test")


def _scored_by_formula(spark: SparkSession, folder: str) -> DataFrame:
    """Active customers with a made-up probability that meets 0, 0.3, 0.7 and 1."""
    features = churn.churn_features(tpch.load(spark, folder), tpch.AS_OF, grain="order")
    probability = clamp((F.col("total_orders") % 13 - 1).cast("double") / 10, 0.0, 1.0)
    scored = features.filter(F.col("is_churned") == 0).select(
        "customer_id",
        "customer_tier",
        "total_orders",
        F.col("total_spent").cast("double").alias("total_spent"),
        "days_since_last_order",
        probability.alias("churn_probability"),
    )
    return scored.withColumn("risk_level", risk_level(F.col("churn_probability")))


def risk_levels_by_formula(spark: SparkSession, folder: str) -> DataFrame:
    return _scored_by_formula(spark, folder)


def risk_summary_by_formula(spark: SparkSession, folder: str) -> DataFrame:
    """The mean is left to rounding: it sums doubles in any order."""
    summary = churn_model.risk_summary(_scored_by_formula(spark, folder))
    return summary.withColumn("avg_churn_probability", F.round("avg_churn_probability", 9))


def risk_top_by_formula(spark: SparkSession, folder: str) -> DataFrame:
    return churn_model.risk_top_customers(_scored_by_formula(spark, folder))


def risk_points_by_formula(spark: SparkSession, folder: str) -> DataFrame:
    return churn_model.risk_points(_scored_by_formula(spark, folder))


def forecast_calendar(spark: SparkSession, folder: str) -> DataFrame:
    """Dates, day numbers and weekdays of the 30 days ahead."""
    from verification.queries import sales_forecast

    return sales_forecast(spark, folder).select(
        "forecast_date",
        "day_number",
        weekday_from_monday(F.col("forecast_date")).alias("day_of_week"),
    )


def _rank_auc(scored: DataFrame) -> DataFrame:
    """AUC by ranks: the share of (churned, kept) pairs in the right order, ties half.

    Ranks are numbered in range slices; one row per slice gives the offsets.
    """
    tied = scored.groupBy("p").agg(
        F.count_if(F.col("y") == 1).alias("churned"), F.count_if(F.col("y") == 0).alias("kept")
    )
    sliced = in_sorted_slices(tied, F.col("p").asc())
    earlier_slices = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy("_slice").agg(F.sum("kept").alias("rows")).select(
        "_slice", F.coalesce(F.sum("rows").over(earlier_slices), F.lit(0)).alias("offset")
    )
    in_slice = Window.partitionBy("_slice").orderBy("_row")
    earlier = in_slice.rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("offset") + F.coalesce(F.sum("kept").over(earlier), F.lit(0))
    ranked = sliced.join(offsets, "_slice").withColumn("below", below)
    pairs = F.sum("churned") * F.sum("kept")
    wins = F.sum(F.col("churned") * (F.col("below") + F.col("kept") / 2))
    return ranked.agg((wins / pairs).alias("auc"))


def model_checks(spark: SparkSession, folder: str) -> DataFrame:
    """``check_name, holds`` for statements that every fitted churn model must meet."""
    # Read by the training and by every check.
    features = pinned(churn.churn_features_at_horizon(tpch.load(spark, folder), tpch.AS_OF))
    model, metrics = churn_model.train_churn(features)
    given = {r["metric"]: r["value"] for r in metrics.collect()}
    split = churn_model.stratified_split(
        churn.churn_ratios(features), "is_churned", "customer_id"
    ).withColumn("class_weight", F.lit(1.0))
    tested = model.transform(split.filter("is_test")).select(
        F.col("is_churned").alias("y"), vector_to_array("probability")[1].alias("p"),
        F.col("rawPrediction"), (F.col("prediction") == F.col("is_churned")).alias("hit"),
    )
    tested = pinned(tested)
    auc = BinaryClassificationEvaluator(labelCol="y", numBins=0).evaluate(tested)
    by_rank = _rank_auc(tested).first()["auc"]
    accuracy = tested.agg(F.avg(F.col("hit").cast("int"))).first()[0]
    weights = churn_model._balanced(split.filter("NOT is_test")).groupBy("is_churned").agg(
        F.sum("class_weight").alias("weight")
    )
    weights = [r["weight"] for r in weights.collect()]
    path = f"{checkpoint_folder(spark)}/model-{uuid.uuid4()}"
    churn_model.save_model(model, path)
    scored = pinned(churn_model.score_churn(model, features))
    again = churn_model.score_churn(churn_model.load_model(path), features)
    churned = features.filter("is_churned = 1").select("customer_id")
    importances = churn_model.feature_importance(model)
    shares = importances.agg(F.sum("importance")).first()[0]
    ranked = churn_model.most_likely_first(scored).select("churn_probability", "customer_id")
    holds = {
        "auc is that of the rank formula": abs(auc - by_rank) < 1e-9
        and abs(given["auc_score"] - auc) < 1e-9,
        "accuracy is the share of hits": abs(given["test_accuracy"] - accuracy) < 1e-12,
        "classes weigh the same": max(weights) - min(weights) < 1e-6 * max(weights),
        "importances add up to one": abs(shares - 1) < 1e-9,
        "importances fall": _in_order(importances, ("importance", -1), ("feature", 0)),
        "the likeliest to leave come first": _in_order(
            ranked, ("churn_probability", -1), ("customer_id", 1)
        ),
        "a reloaded model scores the same": scored.exceptAll(again).isEmpty(),
        "nobody who has churned is scored": scored.join(churned, "customer_id").isEmpty(),
        "probabilities lie between 0 and 1": scored.filter(
            "churn_probability < 0 OR churn_probability > 1"
        ).isEmpty(),
    }
    return spark.createDataFrame(list(holds.items()), "check_name string, holds boolean")


def _in_order(frame: DataFrame, *columns) -> bool:
    """Whether the rows come as ``columns`` would sort them.

    Tasks compare their own rows; the first and last of every batch are compared here.
    """

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            rows = batch.to_pylist()
            keys = [[sign * r[c] if sign else r[c] for c, sign in columns] for r in rows]
            if rows:
                row = {
                    "task": task, "number": number, "first_row": rows[0], "last_row": rows[-1],
                    "ordered": all(a <= b for a, b in zip(keys, keys[1:], strict=False)),
                }
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    frame = frame.select(*[c for c, _ in columns])
    row = ", ".join(f"{name}: {kind}" for name, kind in frame.dtypes)
    schema = (
        f"task int, number int, first_row struct<{row}>, last_row struct<{row}>, ordered boolean"
    )
    arrow = to_arrow_schema(frame.sparkSession.createDataFrame([], schema).schema)
    found = sorted(frame.mapInArrow(ends, schema).collect(), key=lambda r: (r.task, r.number))
    keys = [
        [sign * r[c] if sign else r[c] for c, sign in columns]
        for batch in found
        for r in (batch.first_row, batch.last_row)
    ]
    return all(r.ordered for r in found) and keys == sorted(keys)


def forecast_checks(spark: SparkSession, folder: str) -> DataFrame:
    """``check_name, holds`` for what must hold of every forecast, whatever was learned.

    Errors are computed again from the model's own predictions, and the thirty steps from
    inputs rebuilt out of the forecast itself.
    """
    inputs = sales.sales_features(sales.daily_sales(tpch.load(spark, folder)))
    model, metrics = forecast_model.train_forecast(inputs)
    given = metrics.first()
    split = forecast_model.chronological_split(inputs).select(
        "sales_date", "is_test", F.col("daily_revenue").cast("double").alias("daily_revenue"),
        *[F.col(c).cast("double").alias(c) for c in forecast_model.FORECAST_COLUMNS],
    )
    predicted = model.transform(split).select(
        "sales_date", "is_test", "daily_revenue", "prediction"
    )
    days = sorted(predicted.collect())  # a row per day of the calendar

    def error(test: bool) -> float:
        off = [abs(d.daily_revenue - d.prediction) / abs(d.daily_revenue) for d in days
               if d.is_test == test]
        return sum(off) / len(off)

    steps = forecast_model.sales_forecast(model, inputs).orderBy("day_number").collect()
    seed = inputs.orderBy(F.desc("sales_date")).first()
    before = [float(seed["revenue_lag_1"]), *[s.predicted_revenue for s in steps]]
    rebuilt = []
    for number, step in enumerate(steps):
        last = seed["sales_date"] + dt.timedelta(days=number)
        row = {c: float(seed[c]) for c in forecast_model.FORECAST_COLUMNS}
        if number:
            row |= {"day_of_week": float(last.weekday()), "month": float(last.month)}
            row["revenue_lag_1"] = before[number]
        rebuilt.append((step.day_number, *row.values()))
    columns = ", ".join(f"{c} double" for c in forecast_model.FORECAST_COLUMNS)
    again = model.transform(spark.createDataFrame(rebuilt, f"day_number int, {columns}"))
    again = {r.day_number: r.prediction for r in again.select("day_number", "prediction").collect()}
    holds = {
        "training error is that of the predictions": abs(given["train_mape"] - error(False)) < 1e-9,
        "test error is that of the predictions": abs(given["test_mape"] - error(True)) < 1e-9,
        "the newest day is compared": (given["last_actual"], given["last_predicted"])
        == (days[-1].daily_revenue, days[-1].prediction),
        "the earliest days train": [d.is_test for d in days] == sorted(d.is_test for d in days),
        "every step feeds the next": all(
            abs(s.predicted_revenue - again[s.day_number]) <= 1e-9 * abs(s.predicted_revenue)
            for s in steps
        ),
        "thirty days on end": [s.forecast_date for s in steps]
        == [seed["sales_date"] + dt.timedelta(days=n) for n in range(1, 31)],
    }
    return spark.createDataFrame(list(holds.items()), "check_name string, holds boolean")


def part_queries() -> dict:
    found = (
        churn_split_counts,
        forecast_split,
        forecast_split_by_payment,
        risk_levels_by_formula,
        risk_summary_by_formula,
        risk_top_by_formula,
        risk_points_by_formula,
        forecast_calendar,
        model_checks,
        forecast_checks,
    )
    return {f.__name__: f for f in found}


def part_oracles(
    line_features: str, order_features: str, sales_features: str, by_payment: str
) -> dict[str, str]:
    """DuckDB SQL for the queries above; the arguments are SQL of the features."""
    scored = f"""{order_features},
scored AS (
    SELECT customer_id, customer_tier, total_orders, total_spent, days_since_last_order,
           greatest(least(CAST(total_orders % 13 - 1 AS DOUBLE) / 10, 1.0), 0.0)
               AS churn_probability
    FROM churn WHERE is_churned = 0
),
leveled AS (
    SELECT *, CASE WHEN churn_probability > 0 AND churn_probability <= 0.3 THEN 'Low Risk'
                   WHEN churn_probability > 0.3 AND churn_probability <= 0.7 THEN 'Medium Risk'
                   WHEN churn_probability > 0.7 AND churn_probability <= 1 THEN 'High Risk'
              END AS risk_level
    FROM scored
)"""
    checks = (
        "auc is that of the rank formula", "accuracy is the share of hits",
        "classes weigh the same", "importances add up to one", "importances fall",
        "the likeliest to leave come first", "a reloaded model scores the same", "nobody who has churned is scored",
        "probabilities lie between 0 and 1",
    )
    forecasts = (
        "training error is that of the predictions", "test error is that of the predictions",
        "the newest day is compared", "the earliest days train", "every step feeds the next",
        "thirty days on end",
    )

    def all_hold(names) -> str:
        rows = ", ".join(f"('{name}', TRUE)" for name in names)
        return f"SELECT * FROM (VALUES {rows}) AS checks(check_name, holds)"

    return {
        "churn_split_counts": f"""{line_features}
            SELECT is_churned, COUNT(*) AS customers,
                   CAST(ceil(COUNT(*) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS for_test
            FROM churn GROUP BY is_churned""",
        "forecast_split": f"""
            SELECT sales_date,
                   row_number() OVER (ORDER BY sales_date) > floor(COUNT(*) OVER () * CAST(0.8 AS DOUBLE)) AS is_test
            FROM ({sales_features})""",
        "forecast_split_by_payment": f"""
            SELECT payment_method, sales_date,
                   row_number() OVER (PARTITION BY payment_method ORDER BY sales_date)
                       > floor(COUNT(*) OVER (PARTITION BY payment_method)
                             * CAST(0.8 AS DOUBLE)) AS is_test
            FROM ({by_payment})""",
        "risk_levels_by_formula": f"{scored} SELECT * FROM leveled",
        "risk_summary_by_formula": f"""{scored},
            levels AS (SELECT unnest(['Low Risk', 'Medium Risk', 'High Risk']) AS risk_level)
            SELECT l.risk_level,
                   (SELECT COUNT(*) FROM leveled s WHERE s.risk_level = l.risk_level) AS customers,
                   round((SELECT AVG(churn_probability) FROM leveled), 9) AS avg_churn_probability,
                   (SELECT COUNT(*) FROM leveled) AS total_analyzed
            FROM levels l""",
        "risk_top_by_formula": f"""{scored}
            SELECT risk_level, CAST(place AS INTEGER) AS place, customer_id, customer_tier,
                   total_spent, churn_probability
            FROM (SELECT *, row_number() OVER (PARTITION BY risk_level
                      ORDER BY churn_probability DESC, customer_id) AS place FROM leveled
                  WHERE risk_level IN ('High Risk', 'Medium Risk'))
            WHERE place <= 5""",
        "risk_points_by_formula": f"""{scored}
            SELECT customer_id, customer_tier, total_spent, churn_probability FROM leveled""",
        "forecast_calendar": f"""
            SELECT CAST(newest + CAST(n AS INTEGER) AS DATE) AS forecast_date,
                   CAST(n AS INTEGER) AS day_number,
                   CAST(isodow(newest + CAST(n AS INTEGER)) - 1 AS INTEGER) AS day_of_week
            FROM (SELECT MAX(sales_date) AS newest FROM ({sales_features})),
                 range(1, 31) AS days(n)""",
        "model_checks": all_hold(checks),
        "forecast_checks": all_hold(forecasts),
    }
