"""Shards of equal size by histogram sort, in DataFrame operations only.

Rows are ordered by a key of two integers. Rounds of candidate boundaries ("probes")
are laid over the key range; one aggregation counts the exact bytes below each of
them, and the next round's probes go between the two that enclose a boundary still
looked for. When all boundaries are within the tolerance, the rows are exchanged once.
The driver holds the probes and one count for each, never rows.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplytic.session import pinned

LOWEST = -(2**63)

Key = tuple[int, int]


def _key_array(keys: list[Key]) -> Column:
    """The keys as one constant; JSON is parsed at once, thousands of literals are not."""
    rows = ",".join(f'{{"a":{a},"b":{b}}}' for a, b in keys)
    return F.from_json(F.lit(f"[{rows}]"), "array<struct<a:bigint,b:bigint>>")


def with_bin(df: DataFrame, key: str, bounds: list[Key], name: str) -> DataFrame:
    """Add how many of the sorted ``bounds`` are at or below ``key``: a binary search.

    The steps are folded within one expression, so a plan holds the bounds once and not once
    a step: the driver keeps plans and their texts.
    """
    if not bounds:
        return df.withColumn(name, F.lit(0))
    array = _key_array(bounds)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])

    def further(found: Column, step: Column) -> Column:
        beyond = F.get(array, found + step - 1) <= F.col(key)
        return F.when(beyond, found + step).otherwise(found)

    return df.withColumn(name, F.aggregate(steps, F.lit(0), further))


def _spread(low: Key, high: Key, count: int) -> set[Key]:
    """About ``count`` keys above ``low`` and up to ``high``, evenly spaced."""
    if low[0] == high[0]:
        step = high[1] - low[1]
        inner = {(low[0], low[1] + step * i // count) for i in range(1, count)}
    else:
        step = high[0] - low[0]
        inner = {(low[0] + step * i // count, LOWEST) for i in range(1, count)}
        inner.add((high[0], LOWEST))
    return {k for k in inner if low < k < high} | {high}


def _counts_below(keyed: DataFrame, bounds: list[Key]) -> tuple[list[int], list[int], dict]:
    """Exact bytes and rows below each bound, then of all; each bin's lowest and highest key.

    Bin b lies below ``bounds[b]`` and from ``bounds[b - 1]`` on. The driver gets one row
    per bin.
    """
    bins = {
        row["bin"]: row
        for row in with_bin(keyed, "key", bounds, "bin")
        .groupBy("bin")
        .agg(
            F.sum("bytes").alias("bytes"),
            F.count("*").alias("rows"),
            F.min("key").alias("low"),
            F.max("key").alias("high"),
        )
        .collect()
    }
    size, rows, sizes, counts = 0, 0, [], []
    for b in range(len(bounds) + 1):
        if b in bins:
            size, rows = size + int(bins[b]["bytes"]), rows + int(bins[b]["rows"])
        sizes.append(size)
        counts.append(rows)
    ends = {b: (tuple(row["low"]), tuple(row["high"])) for b, row in bins.items()}
    return sizes, counts, ends


def splitters(
    keyed: DataFrame, parts: int, tolerance: float = 0.0, probes: int = 4096
) -> tuple[list[Key], list[int]]:
    """The ``parts - 1`` boundary keys, and how many rows lie below each.

    ``keyed`` has ``key`` (struct of two longs) and ``bytes``. Boundary i is the first
    key with at least i/parts of all bytes before it. With a tolerance, a probe is taken
    once the bytes below it exceed that by at most this share of a part; at 0 the
    boundary is exact to one key. Rows with equal keys are never parted.
    """
    whole = keyed.agg(
        F.sum("bytes").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high")
    ).first()
    if parts < 2 or whole["low"] is None:
        return [], []
    total, end = int(whole["bytes"]), (whole["high"][0], whole["high"][1] + 1)
    # What is looked for lies above ``low`` and not above ``upper``; keys there reach ``high``.
    ranges = {i: (tuple(whole["low"]), tuple(whole["high"]), end) for i in range(1, parts)}
    found: dict[int, tuple[Key, int]] = {}
    while ranges:
        distinct = set(ranges.values())
        each = max(8, probes // len(distinct))
        bounds = sorted(
            set().union(*({low, upper} | _spread(low, high, each) for low, high, upper in distinct))
        )
        sizes, counts, ends = _counts_below(keyed, bounds)
        # Bytes are whole numbers: comparing them times ``parts`` needs no rounding.
        reached = [size * parts for size in sizes[:-1]]
        still = {}
        for i in ranges:
            at = bisect_left(reached, i * total)
            low, high = ends.get(at, (None, None))
            if reached[at] - i * total <= tolerance * total or low == high:
                found[i] = (bounds[at], counts[at])
            else:
                still[i] = (low, high, bounds[at])
        ranges = still
    return [found[i][0] for i in range(1, parts)], [found[i][1] for i in range(1, parts)]


def histogram_sort(
    df: DataFrame,
    first_key: Column,
    second_key: Column,
    size: Column,
    shards: int,
    tolerance: float = 0.0,
    probes: int = 4096,
    piece_bytes: int = 256 << 20,
) -> DataFrame:
    """``df`` in ``shards`` key ranges of near equal size, with ``shard`` and ``slot``.

    Keys are longs; null counts as the lowest. ``slot`` numbers a shard's rows without
    gaps from 0 in key order. A shard larger than ``piece_bytes`` is cut into pieces by
    boundaries found in the same rounds, so no task sorts more than about one piece; a
    piece's first slot is known from the counts. Columns of ``df`` called ``shard`` or
    ``slot`` are replaced. An empty frame gives an empty frame; rows that repeat in both
    keys stay together and their order among each other is open.
    """
    lowest = F.lit(LOWEST)
    key = F.struct(
        F.coalesce(first_key, lowest).alias("a"), F.coalesce(second_key, lowest).alias("b")
    )
    keyed = pinned(df.select(key.alias("key"), size.cast("long").alias("bytes")))
    total = keyed.agg(F.sum("bytes")).first()[0] or 0
    pieces = max(1, -(-total // (shards * piece_bytes)))
    bounds, rows_below = splitters(keyed, shards * pieces, tolerance, probes)

    first_rows = [0, *rows_below]
    shard_starts = [first_rows[i - i % pieces] for i in range(len(first_rows))]
    offsets = [a - b for a, b in zip(first_rows, shard_starts, strict=True)]
    whole = df.select(
        F.struct(*[c for c in df.columns if c not in ("shard", "slot")]).alias("row"),
        key.alias("key"),
    )
    binned = with_bin(whole, "key", bounds, "piece")
    in_piece = Window.partitionBy("piece").orderBy("key")
    first_slot = F.get(F.from_json(F.lit(f"{offsets}"), "array<bigint>"), F.col("piece"))
    return binned.select(
        "row.*",
        F.floor(F.col("piece") / pieces).cast("int").alias("shard"),
        (first_slot + F.row_number().over(in_piece) - 1).alias("slot"),
    )


def document_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Documents in shards of near equal bytes, equal texts next to each other.

    A document weighs its UTF-8 bytes plus 16; a null text weighs 16. The order is by
    the text's MD5 (its first 60 bits), then doc_id. Adds ``shard`` and ``slot``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return histogram_sort(
        docs, digest, F.col("doc_id").cast("long"), document_size(), shards
    )


def document_size() -> Column:
    return (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 16).cast("long")
