"""Document quality by co-training two views.

The text view sees which words a document has, scaled by how unevenly the labelled classes
use them; the page view sees its language, source,
length and layout figures. Both start from the same labelled documents. In every round
each view scores every unlabelled document and hands its most confident guesses, of
either class, to the other view as training rows. At the end each view's margin is
calibrated on labelled documents kept out of training, and the calibrated log-odds are
added: a view without information is calibrated to the base rate and adds nothing.

Only the labelled documents of a fit are bounded: at most ``labelled``, chosen by a hash
of their id. The features of all documents are stored once; every round takes its
confidence thresholds over all unlabelled ones, and the fits run over all guesses beyond
them. However many there are, they weigh half as much as the labels at most.

Good means quality 1 and not toxic. A text of any length is one row of features, a word
counting once. A null text is empty; null language or source is a
value of its own. Without labels of both classes there is nothing to learn: every
document gets the share of good labels as its probability, 1 without any label.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import (
    ElementwiseProduct,
    FeatureHasher,
    HashingTF,
    StandardScaler,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplytic.llm.common import broadcast_if_small, release_shuffles, stored, text_or_empty

LABELLED = 10_000
ROUNDS, GIVEN = 3, 0.1
# Every word is a feature of the text view, by its hash. A vector stays just below 1 MB: the
# driver's collector lays out larger arrays by whole megabytes.
WORD_FEATURES = 131_000
SMOOTHING, LEAST_SCALE = 4.0, 0.2
HELD_OUT = 5
# Ids of labelled documents, 8 bytes each.
MOST_BROADCAST = 4_000_000
VIEWS = ("text", "page")
LAYOUT = (
    "log_chars", "log_lines", "word_length", "line_words", "upper", "digits", "stops", "calls",
    "bars",
)


@dataclass(frozen=True)
class CoTrained:
    """Fitted views: features, one margin model and one calibration each."""

    features: dict[str, Transformer]
    models: dict[str, LogisticRegressionModel]
    calibration: dict[str, tuple[float, float]]
    prior_log_odds: float


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.greatest(whole, F.lit(1)), F.lit(0.0)).cast("double")


def _count(text: Column, mark: str) -> Column:
    """How often a single character occurs; plain replacement is far below a pattern's cost."""
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _of_class(text: Column, letters: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{letters}]+", ""))


def with_raw_views(docs: DataFrame, *carried: str) -> DataFrame:
    """The raw features: ``tokens`` for the text view, the rest for the page view.

    ``carried`` columns come along.
    """
    text = text_or_empty()
    chars = F.length(text)
    lines = _count(text, "\n") + 1
    gaps = _count(text, " ") + lines
    return docs.select(
        "doc_id",
        *carried,
        F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+")).alias("tokens"),
        F.coalesce("lang", F.lit("(none)")).alias("lang"),
        F.coalesce("source", F.lit("(none)")).alias("source"),
        F.log1p(F.coalesce(F.greatest("n_chars", F.lit(0)), chars)).alias("log_chars"),
        F.log1p(lines).alias("log_lines"),
        _share(chars, gaps).alias("word_length"),
        _share(gaps, lines).alias("line_words"),
        _share(_of_class(text, "A-Z"), chars).alias("upper"),
        _share(_of_class(text, "0-9"), chars).alias("digits"),
        _share(_count(text, "."), gaps).alias("stops"),
        _share(_count(text, "!"), gaps).alias("calls"),
        _share(_count(text, "|"), gaps).alias("bars"),
    )


def _word_features(labelled: DataFrame) -> PipelineModel:
    """Hashed words, each scaled by how unevenly the classes of ``labelled`` use it.

    ``labelled`` has ``tokens`` and ``good``. The scale is the log-ratio of the classes'
    shares, both smoothed towards the base rate, plus a constant: a word that no label has
    seen is still a feature, and one that a few documents have by chance weighs little next
    to one that many documents of one class have.
    """
    hashed = HashingTF(
        inputCol="tokens", outputCol="hashed", binary=True, numFeatures=WORD_FEATURES
    )
    sums = hashed.transform(labelled).groupBy("good").agg(
        F.count("*").alias("rows"), Summarizer.sum(F.col("hashed")).alias("words")
    )
    # Two vectors as long as the hash space.
    rows, words = {}, {}
    for row in sums.collect():
        rows[row["good"]], words[row["good"]] = row["rows"], row["words"].toArray()
    whole = sum(rows.values())
    shares = [np.log((words[c] + SMOOTHING * rows[c] / whole) / rows[c]) for c in (0.0, 1.0)]
    scale = LEAST_SCALE + np.abs(shares[0] - shares[1])
    scaled = ElementwiseProduct(
        scalingVec=Vectors.dense(scale), inputCol="hashed", outputCol="text"
    )
    return PipelineModel(stages=[hashed, scaled])


def _page_features(raw: DataFrame) -> PipelineModel:
    """The page view's feature map, its scale taken over all documents."""
    page = [
        FeatureHasher(inputCols=["lang", "source"], outputCol="names", numFeatures=1 << 10),
        VectorAssembler(inputCols=list(LAYOUT), outputCol="figures"),
        StandardScaler(inputCol="figures", outputCol="scaled", withMean=True),
        VectorAssembler(inputCols=["names", "scaled"], outputCol="page"),
    ]
    return Pipeline(stages=page).fit(raw)


def _fit(rows: DataFrame, view: str) -> LogisticRegressionModel:
    return LogisticRegression(
        featuresCol=view,
        labelCol="good",
        weightCol="weight",
        maxIter=25,
        regParam=1e-3,
        standardization=False,
        aggregationDepth=2,
    ).fit(rows)


def _margin(model: LogisticRegressionModel, rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the model's log-odds of good."""
    named = model.copy().setPredictionCol("_class").setProbabilityCol("_p")
    named = named.setRawPredictionCol("_raw")
    scored = named.transform(rows)
    return scored.withColumn(name, vector_to_array("_raw")[1]).drop("_class", "_p", "_raw")


def _chosen(frame: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` rows, those of the smallest hash of doc_id: the same every time."""
    return frame.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def label_marks(labels: DataFrame) -> DataFrame:
    """``doc_id, good`` once per labelled document."""
    return labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.min(
            F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1.0).otherwise(0)
        ).alias("good")
    )


def fit_views(
    docs: DataFrame,
    labels: DataFrame,
    labelled: int = LABELLED,
    pool: int | None = None,
    rounds: int = ROUNDS,
    given: float = GIVEN,
) -> CoTrained | float:
    """The co-trained views, or the share of good labels if they are of one class.

    ``pool`` bounds the guesses that a fit takes, by a hash of their id; without it all are
    taken. Scores and thresholds are always those of all unlabelled documents.
    """
    marks = stored(label_marks(labels), "marks")
    known = _chosen(marks, labelled)
    part = F.pmod(F.xxhash64(F.lit(2), F.col("doc_id")), F.lit(HELD_OUT))
    # Only labels of documents that are there count.
    there = stored(docs.select("doc_id").join(F.broadcast(known), "doc_id"), "known")
    train = part != 0
    shares = there.filter(train).agg(F.avg("good"), F.count("*")).first()
    if not shares[1] or shares[0] in (0.0, 1.0):
        overall = there.agg(F.avg("good")).first()[0]
        return 1.0 if overall is None else float(overall)

    known_docs = docs.join(F.broadcast(known), "doc_id").filter(train)
    words = _word_features(with_raw_views(known_docs, "good").select("tokens", "good"))
    raw = words.transform(with_raw_views(docs)).drop("tokens", "hashed")
    raw = stored(raw, "views", "zstd")
    features = {"text": words, "page": _page_features(raw)}
    rows = features["page"].transform(raw).select("doc_id", *VIEWS)
    seen = rows.join(F.broadcast(known), "doc_id")
    seen = seen.repartition(docs.sparkSession.sparkContext.defaultParallelism, "doc_id")
    seen = stored(seen, "labelled").cache()
    taught = seen.filter(train).select(*VIEWS, "good", F.lit(1.0).alias("weight"))
    guesses: dict[str, DataFrame | None] = dict.fromkeys(VIEWS)
    models = {}
    for turn in range(rounds):
        for view in VIEWS:
            # What the fit before has left on the driver goes first.
            release_shuffles(docs.sparkSession)
            more = guesses[view]
            models[view] = _fit(taught if more is None else taught.union(more), view)
        if turn == rounds - 1:
            break
        release_shuffles(docs.sparkSession)
        sure = confident(rows, marks, models, given * (turn + 1), shares[0])
        sure = stored(sure, f"guesses-{turn}", "zstd")
        for view, other in (VIEWS, VIEWS[::-1]):
            guesses[other] = _guesses(sure, view, shares[1], pool)
    held = seen.filter(part == 0)
    calibration = {view: _calibrated(_margin(models[view], held, "margin")) for view in VIEWS}
    seen_odds = seen.agg(F.log(F.sum("good") + 1) - F.log(F.sum(1 - F.col("good")) + 1))
    prior = float(seen_odds.first()[0])
    seen.unpersist()
    return CoTrained(features, models, calibration, prior)


def confident(
    rows: DataFrame,
    marks: DataFrame,
    models: dict[str, LogisticRegressionModel],
    share: float,
    good: float,
) -> DataFrame:
    """``doc_id``, the views, and ``by_text, by_page``: 1 or 0 where that view is sure, or null.

    The surest ``share`` of all unlabelled rows of each view, both classes in the labels'
    proportion. The labels' ids are broadcast up to ``MOST_BROADCAST``, so that no vectors are
    shuffled; beyond that ids and margins, and then the sure rows, meet them in a shuffle.
    """
    known = broadcast_if_small(marks.select("doc_id"), MOST_BROADCAST)
    margins = [f"m_{view}" for view in VIEWS]
    for view, name in zip(VIEWS, margins, strict=True):
        rows = _margin(models[view], rows, name)
    unlabelled = rows.select("doc_id", *margins).join(known, "doc_id", "left_anti")
    unlabelled = stored(unlabelled, "margins", "zstd")
    cuts = unlabelled.approxQuantile(margins, [share * (1 - good), 1 - share * good], 0.001)
    for view, name, cut in zip(VIEWS, margins, cuts, strict=True):
        low, high = cut or (float("-inf"), float("inf"))
        sure = F.when(F.col(name) >= high, 1.0).when(F.col(name) <= low, 0.0)
        rows = rows.withColumn(f"by_{view}", sure)
    rows = rows.filter(F.coalesce(*[f"by_{view}" for view in VIEWS]).isNotNull()).drop(*margins)
    return rows.join(known, "doc_id", "left_anti")


def _guesses(sure: DataFrame, view: str, labels: int, pool: int | None) -> DataFrame:
    """What ``view`` hands over, as training rows."""
    guess = F.col(f"by_{view}")
    sure = sure.filter(guess.isNotNull())
    if pool is not None:
        sure = _chosen(sure, pool).repartition(sure.sparkSession.sparkContext.defaultParallelism)
    # A guess counts half a label, all of them together half of all labels at most.
    weight = 0.5 * min(1.0, labels / max(sure.count(), 1))
    return sure.select(*VIEWS, guess.alias("good"), F.lit(weight).alias("weight"))


def _calibrated(held: DataFrame) -> tuple[float, float]:
    """Slope and intercept that turn a margin into log-odds (Platt)."""
    rows = held.select("good", "margin", F.lit(1.0).alias("weight"))
    both = rows.agg(F.countDistinct("good")).first()[0]
    if both < 2:
        return 1.0, 0.0
    rows = VectorAssembler(inputCols=["margin"], outputCol="one").transform(rows)
    model = LogisticRegression(
        featuresCol="one", labelCol="good", weightCol="weight", maxIter=25, regParam=1e-6
    ).fit(rows)
    return float(model.coefficients[0]), float(model.intercept)


def score(docs: DataFrame, fitted: CoTrained | float, threshold: float = 0.5) -> DataFrame:
    """``doc_id, p_text, p_page, p_good, kept`` for every row of ``docs``.

    One pass without shuffle. ``kept``: the combined probability reaches the threshold.
    """
    if isinstance(fitted, float):
        p = F.lit(fitted)
        return docs.select(
            "doc_id", p.alias("p_text"), p.alias("p_page"), p.alias("p_good"),
            (p >= threshold).alias("kept"),
        )
    rows = with_raw_views(docs)
    return _scored(rows, fitted, threshold).select(
        "doc_id", "p_text", "p_page", "p_good", "kept"
    )


def _scored(rows: DataFrame, fitted: CoTrained, threshold: float) -> DataFrame:
    for view in VIEWS:
        rows = _margin(fitted.models[view], fitted.features[view].transform(rows), f"m_{view}")
    odds = {}
    for view in VIEWS:
        slope, intercept = fitted.calibration[view]
        odds[view] = F.lit(slope) * F.col(f"m_{view}") + F.lit(intercept)
    both = sum(odds.values(), F.lit(0.0)) - F.lit(fitted.prior_log_odds)

    def chance(log_odds: Column) -> Column:
        return 1 / (1 + F.exp(-log_odds))

    return rows.select(
        "*",
        *[chance(odds[view]).alias(f"p_{view}") for view in VIEWS],
        chance(both).alias("p_good"),
        (chance(both) >= threshold).alias("kept"),
    )


def good_documents(docs: DataFrame, fitted: CoTrained | float, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the combined views keep, with the columns they came with."""
    if isinstance(fitted, float):
        return docs if fitted >= threshold else docs.limit(0)
    names: Sequence[str] = docs.columns
    whole = docs.select(F.struct(*names).alias("row"), "doc_id", "text", "lang", "source", "n_chars")
    rows = with_raw_views(whole, "row")
    return _scored(rows, fitted, threshold).filter("kept").select("row.*")
