"""The churn model: a random forest over ``churn_features``."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import (
    SQLTransformer,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoplytic.functions.labels import RISK_LEVELS, risk_level
from shoplytic.operators.churn import MODEL_COLUMNS, churn_ratios
from shoplytic.operators.filters import by_id
from shoplytic.operators.scaling import Scaling, fit_scaling
from shoplytic.session import pinned
from shoplytic.sources.ledger import Ledger

# Forest and split settings.
TREES = 100
MAX_DEPTH = 10
MIN_ROWS_PER_LEAF = 2
TEST_FRACTION = 0.2
SEED = 42

# Hash cells of the split; one label has at most this many.
_CELLS = 4096


def stratified_split(
    df: DataFrame,
    label: str,
    key: str,
    test_fraction: float = TEST_FRACTION,
    seed: int = SEED,
) -> DataFrame:
    """Add ``is_test``, true for exactly ``ceil(test_fraction * n)`` rows per label.

    The choice follows a hash of ``key``, so it repeats on every run. Rows are
    counted per label and hash cell; whole cells go to the test side until the
    next would be too many, and only that one cell's rows are ordered.
    """
    ordered = df.withColumn("_hash", F.xxhash64(key, F.lit(seed)))
    ordered = ordered.withColumn("_cell", F.pmod("_hash", F.lit(_CELLS)))
    cells = ordered.groupBy(label, "_cell").agg(F.count("*").alias("_rows"))
    in_label = Window.partitionBy(label)
    earlier = in_label.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        label,
        "_cell",
        (
            F.ceil(F.sum("_rows").over(in_label) * test_fraction)
            - F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
        ).alias("_room"),
    )
    in_cell = Window.partitionBy(label, "_cell").orderBy("_hash", key)
    placed = ordered.withColumn("_place", F.row_number().over(in_cell))
    return placed.join(cells, [label, "_cell"]).select(
        *df.columns, (F.col("_place") <= F.col("_room")).alias("is_test")
    )


def _balanced(train: DataFrame) -> DataFrame:
    """Weight each class by n / (2 * n_class), counted on the training rows."""
    counts = train.agg(
        F.count("*").alias("rows"), F.count_if(F.col("is_churned") == 1).alias("churned")
    ).first()
    churned, kept = counts["churned"], counts["rows"] - counts["churned"]
    weight = F.when(
        F.col("is_churned") == 1, F.lit(counts["rows"] / (2 * max(churned, 1)))
    ).otherwise(F.lit(counts["rows"] / (2 * max(kept, 1))))
    return train.withColumn("class_weight", weight)


def tier_codes() -> StringIndexer:
    return StringIndexer(
        inputCol="customer_tier",
        outputCol=MODEL_COLUMNS[0],
        stringOrderType="alphabetAsc",
        handleInvalid="keep",
    )


def churn_pipeline(
    tiers: StringIndexerModel, scaling: Scaling, seed: int = SEED, trees: int = TREES
) -> Pipeline:
    """Tier codes, standardised inputs, forest. Codes and scaling come fitted.

    The forest keeps the node that each row has reached in each tree, so a level of depth does
    not walk down from the roots again; the trees are the same as without.
    """
    scaled = [f"scaled_{c}" for c in MODEL_COLUMNS]
    inputs = VectorAssembler(inputCols=scaled, outputCol="features")
    forest = RandomForestClassifier(
        labelCol="is_churned",
        weightCol="class_weight",
        numTrees=trees,
        maxDepth=MAX_DEPTH,
        minInstancesPerNode=MIN_ROWS_PER_LEAF,
        cacheNodeIds=True,
        seed=seed,
    )
    columns = scaling.sql("scaled_")
    return Pipeline(
        stages=[tiers, SQLTransformer(statement=f"SELECT *, {columns} FROM __THIS__"), inputs, forest]
    )


def _accuracy(scored: DataFrame) -> float:
    hit = (F.col("prediction") == F.col("is_churned")).cast("int")
    return scored.agg(F.avg(hit)).first()[0]


def train_churn(
    features: DataFrame, seed: int = SEED, trees: int = TREES
) -> tuple[PipelineModel, DataFrame]:
    """Fit on 80 % and return the model with ``metric, value`` rows."""
    split = stratified_split(churn_ratios(features), "is_churned", "customer_id", seed=seed)
    # Read by the fit several times and by both evaluations: keep it in memory, and
    # on shared storage so that a lost executor does not mean reading all orders again.
    split = pinned(split).persist()
    try:
        # Codes and scales are those of all rows, test rows too.
        tiers = tier_codes().fit(split)
        scaling = fit_scaling(tiers.transform(split), MODEL_COLUMNS)
        train = _balanced(split.filter(~F.col("is_test")))
        model = churn_pipeline(tiers, scaling, seed, trees).fit(train)
        tested = model.transform(split.filter(F.col("is_test")))
        auc = BinaryClassificationEvaluator(
            labelCol="is_churned", metricName="areaUnderROC", numBins=0
        ).evaluate(tested)
        metrics = [
            ("train_accuracy", _accuracy(model.transform(train))),
            ("test_accuracy", _accuracy(tested)),
            ("auc_score", auc),
        ]
    finally:
        split.unpersist()
    spark = features.sparkSession
    return model, spark.createDataFrame(metrics, "metric string, value double")


def feature_importance(model: PipelineModel) -> DataFrame:
    """The model's inputs by importance, highest first."""
    forest = model.stages[-1]
    values = [float(v) for v in forest.featureImportances.toArray()]
    rows = list(zip(MODEL_COLUMNS, values, strict=True))
    spark = SparkSession.active()
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature"
    )


def score_churn(
    model: PipelineModel | None,
    features: DataFrame,
    customer_ids: Sequence[int] | DataFrame | None = None,
) -> DataFrame:
    """Churn probability and risk level of customers who have not churned yet."""
    if model is None:
        raise ValueError("train or load a churn model first")
    probability = vector_to_array("probability")[1]
    active = by_id(features, "customer_id", customer_ids).filter(F.col("is_churned") == 0)
    scored = model.transform(churn_ratios(active)).select(
        "customer_id",
        "customer_tier",
        F.col("total_orders").cast("long").alias("total_orders"),
        "total_spent",
        F.col("days_since_last_order").cast("int").alias("days_since_last_order"),
        probability.alias("churn_probability"),
    )
    return scored.withColumn("risk_level", risk_level(F.col("churn_probability")))


def most_likely_first(predictions: DataFrame) -> DataFrame:
    return predictions.orderBy(F.col("churn_probability").desc(), "customer_id")


MANIFEST = "number long, folder string, stages array<string>, tiers array<string>, details string"


def _manifests(spark: SparkSession, path: str) -> Ledger:
    return Ledger(spark, f"{path}/manifests", MANIFEST)


def save_model(
    model: PipelineModel | None, path: str, details: Mapping[str, object] | None = None
) -> str:
    """Save ``model`` as the newest version under ``path`` and return its folder's name.

    The version gets a folder of its own; the manifest that names it, with its stages, tier
    codes and ``details`` (as training figures), is committed last. Readers load a whole
    version at any time: the one before until then, and this one afterwards.
    """
    if model is None:
        raise ValueError("there is no trained model to save")
    spark = SparkSession.active()
    folder = f"version-{uuid.uuid4().hex}"
    model.write().save(f"{path}/{folder}")
    manifests = _manifests(spark, path)
    number = manifests.entries().agg(F.coalesce(F.max("number"), F.lit(0))).first()[0] + 1
    tiers = [label for s in model.stages if isinstance(s, StringIndexerModel) for label in s.labels]
    stages = [type(s).__name__ for s in model.stages]
    manifests.add(number, folder, stages, tiers, json.dumps(dict(details or {}), sort_keys=True))
    return folder


def saved_models(path: str) -> DataFrame:
    """The manifests of all versions under ``path``, newest first."""
    entries = _manifests(SparkSession.active(), path).entries()
    return entries.orderBy(F.desc("number"), F.desc("folder"))


def load_model(path: str, folder: str | None = None) -> PipelineModel:
    """The newest version under ``path``, or the one in ``folder``."""
    if folder is None:
        newest = saved_models(path).first()
        if newest is None:
            raise FileNotFoundError(f"no model has been saved in {path}")
        folder = newest["folder"]
    return PipelineModel.load(f"{path}/{folder}")


def risk_summary(predictions: DataFrame) -> DataFrame:
    """Customers per risk level, empty levels kept, with overall mean and count.

    Levels come from grouped rows, at most four, so the overall figures need no
    second pass.
    """
    grouped = predictions.groupBy("risk_level").agg(
        F.count("*").alias("customers"), F.sum("churn_probability").alias("_sum")
    )
    levels = F.explode(F.array(*[F.lit(level) for level in RISK_LEVELS]))
    domain = predictions.sparkSession.range(1).select(levels.alias("risk_level"))
    every = Window.partitionBy()
    joined = domain.join(grouped, "risk_level", "full")
    rows = F.sum("customers").over(every)
    return (
        joined.select(
            "risk_level",
            F.coalesce("customers", F.lit(0)).alias("customers"),
            (F.sum("_sum").over(every) / rows).alias("avg_churn_probability"),
            F.coalesce(rows, F.lit(0)).alias("total_analyzed"),
        )
        .filter(F.col("risk_level").isNotNull())
        .orderBy(F.col("customers").desc(), "risk_level")
    )


def risk_top_customers(
    predictions: DataFrame, n: int = 5, levels: Sequence[str] = ("High Risk", "Medium Risk")
) -> DataFrame:
    """The ``n`` likeliest to leave in each of ``levels``."""
    likeliest = Window.partitionBy("risk_level").orderBy(
        F.col("churn_probability").desc(), "customer_id"
    )
    return (
        predictions.filter(F.col("risk_level").isin(*levels))
        .withColumn("place", F.row_number().over(likeliest))
        .filter(F.col("place") <= n)
        .select(
            "risk_level", "place", "customer_id", "customer_tier", "total_spent",
            "churn_probability",
        )
    )


def risk_points(predictions: DataFrame) -> DataFrame:
    """Spend against churn probability, for a scatter plot."""
    return predictions.select(
        "customer_id", "customer_tier", "total_spent", "churn_probability"
    )
