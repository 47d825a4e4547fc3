"""Near duplicates by circulant MinHash, confirmed on full shingle sets.

Two permutations make all coordinates of a signature. The first spreads a shingle over
a universe of 2^20 places; the second is one table over that universe, and coordinate k
reads it k places further on, round the end. So a shingle's values for all coordinates
lie side by side in the table, and a signature is the elementwise minimum over the
document's shingles. Bands of coordinates propose pairs; every link is decided by the
exact Jaccard similarity of the two whole sets.

Documents with the same words are one class, so copies of a text count once. Pairs are
never rows before they are decided. First each class meets the bucket's least class only,
and what is confirmed is joined into components: that settles most buckets. In a bucket
that still holds several components, the members' signatures are compared inside tasks,
block by block of a bounded number of members. Pairs of two components that agree in
enough coordinates are then compared on their full sets, again inside tasks, and of the
links found those that join something new come out. So no link that a bucket holds is
lost but for what is said below, and a group of near copies costs rows in proportion to its
size.

Texts may have any length. Beyond about a million shingles a text fills the universe, so its
signature tells it apart from other such texts less and less: they meet in common buckets and
are compared on their full sets. The result is the same, the cost grows with their number.

The chance that a pair at 0.75 shares no bucket is (1 - 0.75^4)^32, five in a million;
that it agrees in fewer coordinates than asked for is one in a million. Of coordinates 16 of
20 bits are kept: for texts of a handful of shingles, about one pair in 20,000 is taken for
one that met in an earlier band and is not compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplytic.llm.common import (
    broadcast_if_small,
    mixed,
    release_shuffles,
    split_words,
    window_hashes,
    word_hashes,
)
from shoplytic.llm.components import connected_components
from shoplytic.session import pinned

SHINGLE_WORDS = 5
# 100 * common >= PERCENT * union, in whole numbers.
PERCENT = 75
BANDS, BAND_ROWS = 32, 4
UNIVERSE_BITS = 20
SEED = 7
# Members of a bucket that are compared in one task, at most about twice as many.
BLOCK_MEMBERS = 1024


class Circulant:
    """The second permutation as a table, prolonged by one signature's length."""

    def __init__(self, coordinates: int, universe_bits: int, seed: int) -> None:
        table = np.random.default_rng(seed).permutation(1 << universe_bits).astype(np.int32)
        self.rows = sliding_window_view(
            np.concatenate([table, table[: coordinates - 1]]), coordinates
        )
        self.shift = np.uint64(64 - universe_bits)
        self.seed = np.uint64(seed)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """The minimum of every coordinate over the shingle hashes, block by block."""
        places = mixed(shingles ^ self.seed) >> self.shift
        best = None
        for at in range(0, len(places), 4096):
            part = self.rows[places[at : at + 4096]].min(axis=0)
            best = part if best is None else np.minimum(best, part)
        return best


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band, different between bands even for equal coordinates."""
    key = np.arange(bands, dtype=np.uint64)
    for column in signature.reshape(bands, -1).T:
        key = mixed(key ^ mixed(column.astype(np.uint64)))
    return key.view(np.int64)


def least_equal(coordinates: int, percent: int) -> int:
    """Five standard deviations below the coordinates that a pair at the limit agrees in."""
    share = percent / 100
    return int(coordinates * share - 5 * (coordinates * share * (1 - share)) ** 0.5)


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of the shingles; a shorter text is one shingle of all its words."""
    if not len(hashes):
        return np.empty(0, dtype=np.uint64)
    return np.unique(window_hashes(hashes, min(width, len(hashes))))


def _words_key(words: list[bytes]) -> bytes | None:
    """128 bits equal for equal words; none for no words."""
    import xxhash

    return xxhash.xxh3_128_digest(b" ".join(words)) if words else None


def _keys_of(texts: pa.Array) -> list[bytes | None]:
    # bytes.lower and bytes.split know ASCII letters and ASCII white space only.
    return [_words_key((t.as_py() or "").encode().lower().split()) for t in texts]


def sketches(
    docs: DataFrame,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
    universe_bits: int = UNIVERSE_BITS,
    shingle_words: int = SHINGLE_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """``doc_id, words_key, n_shingles, keys, signature``: one pass, no shuffle.

    ``keys`` has one entry per band, ``signature`` the low 16 bits of each coordinate. A
    text without words has a null ``words_key``, no keys and an empty signature.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circulant = Circulant(bands * band_rows, universe_bits, seed)
        for batch in batches:
            texts = batch.column(1)
            starts, flat = split_words(pc.ascii_lower(texts))
            hashes = word_hashes(flat)
            sizes, keys, low_bits = [], [], []
            for begin, end in zip(starts[:-1], starts[1:], strict=True):
                shingles = shingle_hashes(hashes[begin:end], shingle_words)
                sizes.append(len(shingles))
                found = circulant.signature(shingles) if len(shingles) else None
                keys.append([] if found is None else band_keys(found, bands))
                low_bits.append(b"" if found is None else found.astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(_keys_of(texts), pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(low_bits, pa.binary()),
                ],
                names=["doc_id", "words_key", "n_shingles", "keys", "signature"],
            )

    schema = (
        f"doc_id {kind}, words_key binary, n_shingles long, keys array<long>, signature binary"
    )
    return docs.select("doc_id", "text").mapInArrow(sketched, schema)


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """``words_key, set``: all shingle hashes of the classes in ``wanted``.

    ``wanted`` has ``words_key, class_id``; a class is read from the document that it is
    named after. Texts that take part in no pair are filtered out in the scan's tasks.
    """

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            starts, flat = split_words(pc.ascii_lower(texts))
            hashes = word_hashes(flat)
            sets = [
                shingle_hashes(hashes[begin:end], width).view(np.int64)
                for begin, end in zip(starts[:-1], starts[1:], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(_keys_of(texts), pa.binary()), pa.array(sets, pa.list_(pa.int64()))],
                names=["words_key", "set"],
            )

    ids = wanted.select(F.col("class_id").alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").join(broadcast_if_small(ids), "doc_id", "left_semi")
    # Rows may share a doc_id: the words themselves say which class a text is.
    sets = texts.select("text").mapInArrow(as_sets, "words_key binary, set array<long>")
    return sets.groupBy("words_key").agg(F.first("set").alias("set"))


def confirmed(
    pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int = PERCENT
) -> DataFrame:
    """The pairs (``a``, ``b``) of classes whose full sets are similar enough."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("words_key")).distinct()
    wanted = pinned(classes.select("words_key", "class_id").join(ids, "words_key", "left_semi"))
    sets = pinned(shingle_sets(docs, wanted))
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    return (
        pairs.join(sets.toDF("a", "set_a"), "a")
        .join(sets.toDF("b", "set_b"), "b")
        .filter(100 * common >= percent * union)
        .select("a", "b")
    )


def bucket_members(classes: DataFrame) -> DataFrame:
    """``key, band, least, node`` for the buckets that hold two classes or more.

    A node is a struct (words_key, n_shingles); ``least`` is the bucket's least one.
    Buckets are summed up before they are joined: one with a third of all classes is a
    few partial rows in the first step, and AQE splits it in the second.
    """
    rows = classes.select(
        F.posexplode("keys").alias("band", "key"),
        F.struct("words_key", "n_shingles").alias("node"),
    )
    buckets = rows.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    shared = buckets.filter(F.col("least") != F.col("most")).select("key", "least")
    return rows.join(shared, "key")


def _can_link(a: str, b: str, percent: int):
    """Whether two set sizes allow the similarity at all."""
    sizes = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return 100 * F.least(*sizes) >= percent * F.greatest(*sizes)


def near_duplicate_links(
    classes: DataFrame, docs: DataFrame, percent: int = PERCENT
) -> DataFrame:
    """Confirmed links (``a``, ``b``) of classes that connect whatever is connected.

    ``classes`` has ``words_key, class_id, n_shingles, keys``.
    """
    members = pinned(bucket_members(classes))
    stars = pinned(
        members.filter((F.col("node") != F.col("least")) & _can_link("node", "least", percent))
        .select(F.col("least.words_key").alias("a"), F.col("node.words_key").alias("b"))
        .distinct()
    )
    first = pinned(confirmed(stars, classes, docs, percent))
    release_shuffles(docs.sparkSession)

    parts = connected_components(first).withColumnRenamed("id", "words_key")
    placed = members.select("key", "band", F.col("node.words_key").alias("words_key"))
    placed = pinned(
        placed.join(parts, "words_key", "left").select(
            "key", "band", "words_key", F.coalesce("component", "words_key").alias("part")
        )
    )
    spread = placed.groupBy("key").agg(
        F.min("part").alias("least"), F.max("part").alias("most"), F.count("*").alias("members")
    )
    unsettled = spread.filter(F.col("least") != F.col("most")).select("key", "members")
    rows = placed.join(unsettled, "key").join(
        classes.select("words_key", "n_shingles", "signature"), "words_key"
    )
    return first.union(links_across(rows, classes, docs, percent))


def _block_groups(rows: DataFrame) -> DataFrame:
    """Rows of a bucket dealt to every two of its blocks: ``key, low, high``."""
    blocks = F.ceil(F.col("members") / BLOCK_MEMBERS)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("words_key"), blocks))
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    return rows.withColumn("other", other).select(
        "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "block", "band", "words_key", "part", "n_shingles", "signature",
    )


def links_across(rows: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Confirmed links between different parts of a bucket, as many as join something new.

    ``rows`` has ``key, members, band, words_key, part, n_shingles, signature``.
    """
    group = ["key", "low", "high"]

    def similar(table: pa.Table) -> pa.Table:
        count = len(table)
        signs = np.frombuffer(
            b"".join(table.column("signature").to_pylist()), dtype=np.uint16
        ).reshape(count, -1)
        sizes = table.column("n_shingles").to_numpy()
        block = table.column("block").to_numpy()
        part = table.column("part").combine_chunks().dictionary_encode().indices.to_numpy()
        band = table.column("band")[0].as_py()
        two_blocks = table.column("low")[0] != table.column("high")[0]
        partners: list[np.ndarray] = []
        used = np.zeros(count, dtype=bool)
        for at in range(count):
            rest = np.arange(at + 1, count)
            small, large = np.minimum(sizes[rest], sizes[at]), np.maximum(sizes[rest], sizes[at])
            rest = rest[(part[rest] != part[at]) & (100 * small >= percent * large)]
            if two_blocks:
                rest = rest[block[rest] != block[at]]
            equal = signs[rest] == signs[at]
            # A pair that shares an earlier band is looked at there.
            first = equal.reshape(len(rest), signs.shape[1] // BAND_ROWS, BAND_ROWS).all(axis=2).argmax(axis=1)
            rest = rest[(equal.sum(axis=1) >= least_equal(signs.shape[1], percent)) & (first == band)]
            partners.append(rest)
            used[rest] = True
            used[at] |= len(rest) > 0
        keys = table.column("words_key").combine_chunks()
        at = np.flatnonzero(used)
        ends = np.cumsum([0, *(len(partners[i]) for i in at)])
        flat = np.concatenate([*(partners[i] for i in at), np.empty(0, np.int64)]).astype(np.int64)
        found = table.select([*group, "words_key"]).take(pa.array(at))
        return found.append_column(
            "partners",
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), keys.take(pa.array(flat))),
        )

    kept = "key long, low long, high long, words_key binary"
    near = pinned(
        _block_groups(rows).groupBy(*group).applyInArrow(similar, f"{kept}, partners array<binary>")
    )
    ids = near.select("words_key").distinct()
    wanted = pinned(classes.select("words_key", "class_id").join(ids, "words_key", "left_semi"))
    release_shuffles(docs.sparkSession)
    sets = shingle_sets(docs, wanted)

    def linked(table: pa.Table) -> pa.Table:
        keys = table.column("words_key").to_pylist()
        own = {k: v.values.to_numpy() for k, v in zip(keys, table.column("set"), strict=True)}
        root = {k: k for k in keys}

        def top(k: bytes) -> bytes:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        links = []
        for a, partners in zip(keys, table.column("partners").to_pylist(), strict=True):
            for b in partners:
                if top(a) == top(b):
                    continue
                common = len(np.intersect1d(own[a], own[b], assume_unique=True))
                if 100 * common >= percent * (len(own[a]) + len(own[b]) - common):
                    root[top(a)] = top(b)
                    links.append((a, b))
        columns = list(zip(*links, strict=True)) or [(), ()]
        return pa.table({n: pa.array(c, pa.binary()) for n, c in zip("ab", columns, strict=True)})

    return near.join(sets, "words_key").groupBy(*group).applyInArrow(linked, "a binary, b binary")


def keyed_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """As ``near_duplicates``, with the ``words_key`` that tells rows of one doc_id apart."""
    sketched = pinned(sketches(docs))
    real = sketched.filter(F.col("words_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = pinned(
        real.groupBy("words_key").agg(
            F.min("doc_id").alias("class_id"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("keys").alias("keys"),
            F.first("signature").alias("signature"),
        )
    )
    release_shuffles(docs.sparkSession)
    links = pinned(near_duplicate_links(classes, docs, percent))
    release_shuffles(docs.sparkSession)
    parts = pinned(connected_components(links).withColumnRenamed("id", "words_key"))
    named = parts.join(classes.select("words_key", "class_id"), "words_key")
    least = named.groupBy("component").agg(F.min("class_id").alias("least_id"))
    linked = named.join(least, "component").select("words_key", "least_id")
    known = pinned(
        classes.select("words_key", "class_id")
        .join(linked, "words_key", "left")
        .select("words_key", F.coalesce("least_id", "class_id").alias("component_id"))
    )
    return (
        sketched.select("doc_id", "words_key", "n_shingles")
        .join(known, "words_key", "left")
        .withColumn(
            "component_id",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
        .select("doc_id", "words_key", "n_shingles", "component_id", "kept")
    )


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` and ``kept``, one row per document.

    ``component_id`` is the least doc_id reachable over links. A document without words,
    or without doc_id, is linked with nothing; the latter's component is null and it is
    kept. Rows that repeat doc_id and words are kept all or none.
    """
    return keyed_duplicates(docs, percent).drop("words_key")


def without_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, the one of least doc_id."""
    @F.pandas_udf("binary")
    def words_key(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: _words_key((text or "").encode().lower().split()))

    decided = keyed_duplicates(docs, percent)
    dropped = pinned(decided.filter(~F.col("kept")).select("doc_id", "words_key").distinct())
    rows = docs.select(F.struct("*").alias("row"), "doc_id", words_key("text").alias("words_key"))
    rows = rows.join(broadcast_if_small(dropped), ["doc_id", "words_key"], "left_anti")
    repeated = pinned(
        decided.filter("kept AND doc_id IS NOT NULL AND words_key IS NOT NULL")
        .groupBy("doc_id", "words_key")
        .count()
        .filter("count > 1")
        .select("doc_id", "words_key")
    )
    if not repeated.isEmpty():
        again = rows.join(repeated, ["doc_id", "words_key"], "left_semi")
        rows = rows.join(repeated, ["doc_id", "words_key"], "left_anti").union(
            again.groupBy("doc_id", "words_key")
            .agg(F.first("row").alias("row"))
            .select("doc_id", "words_key", "row")
            .select(*rows.columns)
        )
    return rows.select("row.*")
