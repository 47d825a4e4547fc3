from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shoplytic.llm import cotraining

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"

LABEL = "doc_id long, quality int, toxic int"


def _corpus(spark, size=2000):
    """Junk comes from one source and in shouting; toxic texts have a word of a short list."""
    pick = random.Random(6)
    rows, labels, truth = [], [], {}
    for i in range(size):
        words = [f"w{pick.randrange(300)}" for _ in range(pick.randint(20, 60))]
        kind = pick.choice(["good"] * 6 + ["junk", "toxic"])
        if kind == "toxic":
            words[3:3] = pick.choices(["nasty", "awful", "filth"], k=3)
        text = " ".join(words)
        if kind == "junk":
            text = text.upper().replace(" ", "!! ")
        text = text.translate(str.maketrans("0123456789", "abcdefghij"))
        source = "dump" if kind == "junk" and pick.random() < 0.9 else f"s{pick.randrange(4)}"
        rows.append((i, text, "en", source, len(text)))
        truth[i] = kind == "good"
        if i % 2:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    return (
        spark.createDataFrame(rows, DOCUMENT), spark.createDataFrame(labels, LABEL), truth
    )


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels, truth = _corpus(spark)
    return docs, labels, truth, cotraining.fit_views(docs, labels, 1000, 1000, rounds=2)


def test_held_out_accuracy(fitted):
    docs, _, truth, views = fitted
    got = cotraining.score(docs, views).collect()
    assert len(got) == len(truth)
    unseen = [(r["kept"], truth[r["doc_id"]]) for r in got if r["doc_id"] % 2 == 0]
    assert sum(kept == good for kept, good in unseen) / len(unseen) > 0.93
    # The page view knows nothing of toxic words; the sum of both views does.
    assert all(0 <= r[c] <= 1 for r in got for c in ("p_text", "p_page", "p_good"))


def test_kept_rows_and_odd_rows(spark, fitted, documents, odd_texts):
    docs, _, _, views = fitted
    odd = documents(odd_texts).withColumn("tokens", F.lit(1)).withColumn("row", F.lit(2))
    scored = cotraining.score(odd, views).collect()
    assert len(scored) == len(odd_texts) and all(r["p_good"] is not None for r in scored)
    kept = cotraining.good_documents(odd, views)
    assert kept.columns == odd.columns
    assert kept.count() == sum(r["kept"] for r in scored)
    assert cotraining.score(documents([]), views).collect() == []


def test_labels_of_one_class_or_none(spark, documents):
    docs = documents([(1, "a"), (2, None)])
    for labels, chance in (
        ([], 1.0), ([(1, 1, 0)], 1.0), ([(1, 0, 0)], 0.0), ([(None, 0, 0), (9, 0, 1)], 1.0),
        ([(1, 1, None), (2, 1, 0)], 1.0),
    ):
        views = cotraining.fit_views(docs, spark.createDataFrame(labels, LABEL))
        assert views == chance
        assert {r["p_good"] for r in cotraining.score(docs, views).collect()} == {chance}
        assert cotraining.good_documents(docs, views).count() == 2 * (chance >= 0.5)


def test_every_unlabelled_document_is_scored_for_the_guesses(spark, monkeypatch):
    size, known = 24_000, 400
    word = F.transform(
        F.sequence(F.lit(0), F.lit(9)), lambda i: F.substring(F.md5(F.concat("id", i)), 1, 2)
    )
    docs = spark.range(size).select(
        F.col("id").alias("doc_id"),
        F.concat_ws(
            " ", word, F.when(F.col("id") % 3 == 0, "filth"), F.lpad("id", 6, "0")
        ).alias("text"),
        F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 5).alias("source"),
        F.lit(None).cast("long").alias("n_chars"),
    )
    labels = spark.range(known).select(
        F.col("id").alias("doc_id"), F.lit(1).alias("quality"),
        (F.col("id") % 3 == 0).cast("int").alias("toxic"),
    )
    fit, taken = cotraining._fit, []

    def counted(rows, view):
        guesses = rows.filter("weight < 1").agg(F.count("*"), F.sum("weight")).first()
        taken.append((rows.filter("weight = 1").count(), *guesses))
        return fit(rows, view)

    monkeypatch.setattr(cotraining, "_fit", counted)
    cotraining.fit_views(docs, labels, 300, rounds=2)
    assert [n for _, n, _ in taken[:2]] == [0, 0]
    # A tenth of all that are unlabelled at least (ties go along), none of a labelled one; the
    # guesses weigh half as much as the labels at most.
    for of_labels, n, weight in taken[2:]:
        assert n >= 0.095 * (size - known)
        assert weight <= 0.5 * of_labels + 1e-6


def test_no_guess_for_a_labelled_document(spark, monkeypatch):
    docs, labels, _ = _corpus(spark, 600)
    confident, found = cotraining.confident, []

    def kept(*given):
        found.append(confident(*given))
        return found[-1]

    monkeypatch.setattr(cotraining, "confident", kept)
    cotraining.fit_views(docs, labels, 100, rounds=2)
    ids = [r["doc_id"] for r in found[0].collect()]
    assert ids and all(i % 2 == 0 for i in ids)


def test_a_rare_word_is_a_feature(spark):
    docs, labels, _ = _corpus(spark)
    rare = [(9000 + i, "waa wbb rarefilth", "xx", "s1", 17) for i in range(3)]
    docs = docs.union(spark.createDataFrame(rare, DOCUMENT))
    labels = labels.union(spark.createDataFrame([(r[0], 1, 1) for r in rare], LABEL))
    views = cotraining.fit_views(docs, labels, rounds=1)
    asked = [(1, "waa wbb", "xx", "s1", 17), (2, "waa wbb rarefilth", "xx", "s1", 17)]
    scored = cotraining.score(spark.createDataFrame(asked, DOCUMENT), views).orderBy("doc_id")
    plain, toxic = [r["p_text"] for r in scored.collect()]
    assert toxic < 0.95 * plain


def test_vectors_are_not_shuffled_to_meet_the_labels(fitted, spark, monkeypatch):
    docs, labels, truth, views = fitted
    raw = cotraining.with_raw_views(docs)
    for view in cotraining.VIEWS:
        raw = views.features[view].transform(raw)
    rows, marks = raw.select("doc_id", *cotraining.VIEWS), cotraining.label_marks(labels)

    def found():
        return cotraining.confident(rows, marks, views.models, 0.1, 0.7)

    # As on large tables, where neither side is small by Spark's own limit.
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        sure = found()
        plan = sure._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        ids = sorted(r[0] for r in sure.select("doc_id").collect())
        assert ids and not set(ids) & {r[0] for r in marks.select("doc_id").collect()}
        # Labels beyond the bound are met in a shuffle, with the same result.
        monkeypatch.setattr(cotraining, "MOST_BROADCAST", 10)
        assert sorted(r[0] for r in found().select("doc_id").collect()) == ids
    finally:
        spark.conf.set(key, before)
