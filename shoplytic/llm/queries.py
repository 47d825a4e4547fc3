"""The registered queries of this package: each operator over a whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplytic.llm import (
    cotraining,
    decontamination,
    digest_index,
    katz,
    line_spread,
    merkle,
    mixing,
    near_duplicates,
    repeated_passages,
    secrets,
    sharding,
    warc,
    whitening,
)
from shoplytic.llm.common import read, text_or_empty
from shoplytic.session import checkpoint_folder, pinned

SHARDS = 40
KATZ_ORDER = 3


def op1_structured_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.span_digest(secrets.scan_secrets(read(spark, folder, "documents")))


def op2_cotraining_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return cotraining.score(docs, cotraining.fit_views(docs, read(spark, folder, "labels")))


def op3_block_mixing(spark: SparkSession, folder: str) -> DataFrame:
    placed = pinned(mixing.positions(read(spark, folder, "documents")))
    mixture = mixing.mix(placed)
    return mixing.words_taken(placed, mixture).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op4_histogram_sort(spark: SparkSession, folder: str) -> DataFrame:
    sharded = sharding.document_shards(read(spark, folder, "documents"), SHARDS)
    return sharded.select(
        "doc_id",
        sharding.document_size().alias("size"),
        F.crc32(text_or_empty()).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_digest_index(spark: SparkSession, folder: str) -> DataFrame:
    """Two arrivals, the larger half of the ids first: so the largest doc_id stays."""
    index = digest_index.DigestIndex(
        spark, f"{checkpoint_folder(spark).rstrip('/')}/digest-index-{uuid.uuid4().hex}"
    )
    digests = pinned(digest_index.text_digests(read(spark, folder, "documents")))
    middle = digests.agg(F.avg("doc_id")).first()[0]
    if middle is None:
        index.append(digests)
    else:
        late = F.coalesce(F.col("doc_id") >= middle, F.lit(False))
        index.append(digests.filter(late))
        index.append(digests.filter(~late))
    return index.assign(digests)


def op6_line_spread(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "source", "text")
    cut = line_spread.without_boilerplate(docs, line_spread.boilerplate_lines(docs))
    kept = F.coalesce("kept_text", F.lit(""))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


def op7_circulant_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(read(spark, folder, "documents"))


def op8_cover_anchors(spark: SparkSession, folder: str) -> DataFrame:
    cut = repeated_passages.remove_repeats(read(spark, folder, "documents"))
    return cut.select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op9_katz_backoff(spark: SparkSession, folder: str) -> DataFrame:
    return katz.score_documents(read(spark, folder, "documents"), KATZ_ORDER)


def op10_pigeonhole_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.find_leaks(
        read(spark, folder, "documents"), read(spark, folder, "benchmark")
    )


def op11_bitmap_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.proofs(merkle.build(read(spark, folder, "documents")))


def op12_boundary_chain(spark: SparkSession, folder: str) -> DataFrame:
    archives = f"{checkpoint_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return warc.page_records(spark, read(spark, folder, "pages"), archives)


def op13_lanczos_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(read(spark, folder, "embeddings"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_structured_secrets,
        op2_cotraining_quality,
        op3_block_mixing,
        op4_histogram_sort,
        op5_digest_index,
        op6_line_spread,
        op7_circulant_minhash,
        op8_cover_anchors,
        op9_katz_backoff,
        op10_pigeonhole_leaks,
        op11_bitmap_manifest,
        op12_boundary_chain,
        op13_lanczos_whitening,
        pipeline,
    )
    return {f.__name__: f for f in found}
