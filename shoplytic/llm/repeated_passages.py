"""Passages of 50 words that an earlier document has too, by difference-cover anchors.

A difference cover of period v has, for any two positions, a shift below v that takes
both to cover positions. So of two equal passages of W words, starting anywhere, some
run of W - v + 1 words begins at a cover position in both documents. Only runs at cover
positions ("anchors", 6 of 31) are hashed and counted. Where an anchor occurs in more
documents than one, the match is extended: all windows of W words around it are hashed,
and a window counts as repeated if its words also start in a document of smaller id.

Words are compared unchanged. Documents with the same words are one class named by its
least doc_id; another member of it has every window repeated. A null text has no words;
texts below W words have no window. A row without doc_id is no source of repeats and
keeps all its words, as no id is smaller or larger than null. Rows that repeat both id
and text are one document; of rows with one id and other texts none is smaller, and each is
cut for itself. A row is known by its id and a 64-bit hash of its text. Texts may have any
length; a task holds one batch of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplytic.llm.common import (
    broadcast_if_small,
    key_filter,
    maybe_among,
    split_words,
    stored,
    window_hashes,
    word_hashes,
)
from shoplytic.session import pinned

WINDOW = 50
# A perfect difference set modulo 31; every difference occurs once.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)


# What a row is known by.
ROW = ("doc_id", "part")


def known_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, part, text``."""
    return docs.select("doc_id", F.xxhash64("text").alias("part"), "text")


def _words_of(text: str | None) -> list[bytes]:
    # bytes.split knows ASCII white space only.
    return (text or "").encode().split()


def word_keys(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, part, words_key, n_words``: 128 bits equal for texts of the same words."""
    kind = dict(docs.dtypes)["doc_id"]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            found = [_words_of(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("part"),
                    pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in found], pa.binary()),
                    pa.array([len(w) for w in found], pa.int64()),
                ],
                names=["doc_id", "part", "words_key", "n_words"],
            )

    return docs.mapInArrow(keyed, f"doc_id {kind}, part long, words_key binary, n_words long")


def _doc_hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The word hashes of each text of the batch."""
    starts, flat = split_words(batch.column("text"))
    hashes = word_hashes(flat)
    for begin, end in zip(starts[:-1], starts[1:], strict=True):
        yield hashes[begin:end]


def _anchors(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every run of ``window - PERIOD + 1`` words at a cover position."""
    runs = window_hashes(hashes, window - PERIOD + 1)
    at = np.flatnonzero(np.isin(np.arange(PERIOD), COVER)[np.arange(len(runs)) % PERIOD])
    return at, runs[at]


def anchors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``hash, doc_id, part`` for every distinct anchor of every text."""
    kind = dict(docs.dtypes)["doc_id"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(_anchors(h, window)[1]) for h in _doc_hashes(batch)]
            rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
            values = np.concatenate([*found, np.empty(0, np.uint64)]).astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(values.view(np.int64)),
                    *(batch.column(c).take(pa.array(rows)) for c in ROW),
                ],
                names=["hash", *ROW],
            )

    return docs.mapInArrow(hashed, f"hash long, doc_id {kind}, part long")


def shared_anchors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, part, hits``: the anchors of each document that another document has too."""
    found = anchors(docs, window)
    shared = pinned(found.groupBy("hash").count().filter("count > 1").select("hash"))
    return (
        found.join(broadcast_if_small(shared, 4_000_000), "hash")
        .groupBy(*ROW)
        .agg(F.collect_set("hash").alias("hits"))
    )


def extended_windows(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, part, starts, hashes``: the windows of ``window`` words round each hit.

    ``texts`` has ``doc_id, part, text, hits``. A window is hashed if a hit begins in its
    first PERIOD words; every passage of ``window`` words shared with another document
    is among them.
    """
    kind = dict(texts.dtypes)["doc_id"]

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column("hits")
            starts, hashes = [], []
            for row, words in enumerate(_doc_hashes(batch)):
                at, runs = _anchors(words, window)
                known = hits[row].values.to_numpy().view(np.uint64)
                full = window_hashes(words, window)
                # +1 where a hit's windows begin, -1 behind their end: positive is inside.
                edge = np.zeros(len(full) + PERIOD + 1, dtype=np.int32)
                hit = at[np.isin(runs, known)]
                np.add.at(edge, np.maximum(hit - PERIOD + 1, 0), 1)
                np.add.at(edge, np.minimum(hit + 1, len(full)), -1)
                inside = np.flatnonzero(np.cumsum(edge)[: len(full)] > 0)
                starts.append(inside.astype(np.int32))
                hashes.append(full[inside].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ROW),
                    pa.array(starts, pa.list_(pa.int32())),
                    pa.array(hashes, pa.list_(pa.int64())),
                ],
                names=[*ROW, "starts", "hashes"],
            )

    return texts.select(*ROW, "text", "hits").mapInArrow(
        extended, f"doc_id {kind}, part long, starts array<int>, hashes array<long>"
    )


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, part, starts``: where windows begin whose words a smaller doc_id has too.

    The least document of each window hash is found by partial minima; the windows of
    more than one document are then joined with it. A passage in a third of all
    documents is one group of the first step and is split by AQE in the second.
    """
    hits = stored(shared_anchors(docs, window), "hits")
    # Texts without a hit stay where they are.
    texts = maybe_among(docs, pinned(key_filter(hits, ROW)), ROW, "maybe").filter("maybe")
    windows = stored(extended_windows(texts.join(hits, [*ROW]), window), "windows")
    each = windows.select(*ROW, F.explode(F.arrays_zip("starts", "hashes")).alias("w")).select(
        *ROW, F.col("w.starts").alias("start"), F.col("w.hashes").alias("hash")
    )
    least = each.groupBy("hash").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most")
    )
    least = stored(least.filter(F.col("least") != F.col("most")).select("hash", "least"), "least")
    return (
        each.join(least, "hash")
        .filter(F.col("least") < F.col("doc_id"))
        .groupBy(*ROW)
        .agg(F.sort_array(F.collect_set("start")).alias("starts"))
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text``, one row per document."""
    docs = known_rows(docs)
    keyed = pinned(word_keys(docs, window))
    long = keyed.filter((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    least = pinned(long.groupBy("words_key").agg(F.min("doc_id").alias("least")))
    copies = pinned(
        long.join(least, "words_key")
        .filter(F.col("doc_id") != F.col("least"))
        .select(*ROW, F.lit(True).alias("copy"))
        .distinct()
    )
    firsts = docs.filter(F.col("doc_id").isNotNull()).join(
        broadcast_if_small(copies.select(*ROW)), [*ROW], "left_anti"
    )
    starts = repeated_windows(firsts, window)
    # Only texts that lose words move to meet what they lose.
    gone = stored(starts.join(copies, [*ROW], "full"), "gone")
    marked = maybe_among(docs, pinned(key_filter(gone, ROW)), ROW, "maybe")
    nothing = marked.filter("NOT maybe").select(
        *ROW, "text", F.lit(None).cast("array<int>").alias("starts"), F.lit(False).alias("copy")
    )
    joined = nothing.unionByName(
        marked.filter("maybe").join(gone, [*ROW], "left").select(*nothing.columns)
    )
    kind = dict(docs.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept = [], [], []
            rows = zip(
                batch.column("text").to_pylist(),
                batch.column("starts"),
                batch.column("copy").to_pylist(),
                strict=True,
            )
            for text, begins, copy in rows:
                words = _words_of(text)
                gone = np.zeros(len(words) + 1, dtype=np.int32)
                if begins.is_valid:
                    at = begins.values.to_numpy()
                    at = at[at + window <= len(words)]
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                inside = np.cumsum(gone)[:-1] > 0
                if copy and len(words) >= window:
                    inside[:] = True
                sizes.append(len(words))
                removed.append(int(inside.sum()))
                kept.append(
                    b" ".join([w for w, out in zip(words, inside.tolist(), strict=True) if not out])
                )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return joined.select("doc_id", "text", "starts", "copy").mapInArrow(
        cut, f"doc_id {kind}, n_words long, n_removed long, kept_text string"
    )
