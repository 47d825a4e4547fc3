"""A filter of fixed size over keys: drops most rows without a partner before a join's shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of a key filter: 16 MB in all, whatever the number of keys.
FILTER_BITS, BITMAP_BITS = 27, 15


def _filter_bit(columns: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << FILTER_BITS))


def key_filter(keys: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A bit per hash value of the keys, in at most 4,096 bitmaps of 4 KB."""
    bit = _filter_bit(columns)
    return keys.groupBy(F.shiftright(bit, BITMAP_BITS).alias("_bucket")).agg(
        F.bitmap_construct_agg(bit.bitwiseAND((1 << BITMAP_BITS) - 1)).alias("_bits")
    )


def maybe_among(df: DataFrame, bitmaps: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: false for rows whose key is surely not in the filter.

    Where it is true an exact join has to follow; it moves the rows that pass only. A filter
    that is too full lets more rows pass and changes nothing else.
    """
    bit = _filter_bit(columns)
    place = bit.bitwiseAND((1 << BITMAP_BITS) - 1).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10)
    is_set = F.getbit(byte.cast("long"), place.bitwiseAND(7)) == 1
    rows = df.withColumn("_bucket", F.shiftright(bit, BITMAP_BITS))
    return rows.join(F.broadcast(bitmaps), "_bucket", "left").select(
        *df.columns, F.coalesce(is_set, F.lit(False)).alias(name)
    )
