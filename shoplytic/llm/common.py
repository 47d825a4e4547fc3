"""Expressions and helpers that several operators share.

Documents are rows with ``doc_id``, ``text``, ``lang``, ``source`` and ``n_chars``.
Other columns may be there; an operator selects what it needs first, so their names
never clash with its own.
"""

from __future__ import annotations

import gc
import re
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplytic.operators.key_filter import key_filter, maybe_among  # noqa: F401
from shoplytic.session import checkpoint_folder

# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` as Parquet in the shared checkpoint folder: later reads repeat no work.

    Unlike a checkpoint it is columnar and compressed, so it suits wide rows.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the ``stored`` tables that ``df`` reads, once nothing needs them any more."""
    context = df.sparkSession.sparkContext
    home = checkpoint_folder(df.sparkSession).rstrip("/")
    for folder in {file.split("/")[-2] for file in df.inputFiles()}:
        if re.fullmatch(r"[\w-]+-[0-9a-f]{32}", folder):
            path = context._jvm.org.apache.hadoop.fs.Path(f"{home}/{folder}")
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs, which no frame refers to now.

    It takes two rounds: the first lets go of what Python held, the second finds the rest.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


BROADCAST_ROWS = 1_000_000


def broadcast_if_small(keys: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A frame of narrow key rows, to be broadcast if a count proves that it is small.

    Beyond that the join shuffles both sides.
    """
    return F.broadcast(keys) if keys.count() <= most_rows else keys


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words of every text on end, and where each text's words begin.

    ``starts`` has one entry more than there are texts. Null is an empty text.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    # White space at either end leaves an empty word there.
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values
    real = pc.greater(pc.binary_length(flat), 0)
    kept = real.to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(kept)])
    return before[offsets], flat.filter(real)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (splitmix64)."""
    z = values.astype(np.uint64, copy=True)
    z += np.uint64(0x9E3779B97F4A7C15)
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def word_hashes(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; every distinct word is hashed once per batch."""
    import xxhash

    if not len(flat):
        return np.empty(0, dtype=np.uint64)
    coded = flat.dictionary_encode()
    seed = xxhash.xxh3_64_intdigest
    distinct = np.fromiter(
        (seed(word) for word in coded.dictionary.cast(pa.large_binary()).to_pylist()),
        dtype=np.uint64,
        count=len(coded.dictionary),
    )
    return distinct[coded.indices.to_numpy()]


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` hashes, by doubling: log2(width) passes.

    A run's hash depends on its members and their order only. Entry i is that of the
    run starting at i; there are ``width - 1`` entries fewer than members.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    done, covered, piece, size, left = None, 0, mixed(hashes), 1, width
    while True:
        if left & 1:
            if done is None:
                done = piece[: len(hashes) - size + 1]
            else:
                m = len(hashes) - covered - size + 1
                tail = piece[covered : covered + m]
                done = mixed(done[:m] * np.uint64(0x9FB21C651E98DF25) ^ tail)
            covered += size
        left >>= 1
        if not left:
            return done[:n]
        m = len(piece) - size
        head, tail = piece[: max(m, 0)], piece[size:]
        piece = mixed(head * np.uint64(0xD6E8FEB86659FD93) ^ tail)
        size *= 2


def batches_of(table_batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.Table]:
    """Incoming batches joined up to a size, never splitting one."""
    held, size = [], 0
    for batch in table_batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most_bytes:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
