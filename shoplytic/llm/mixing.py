"""Mixing sources to target weights, in blocks of a fixed number of words.

The documents of a source lie end to end and are cut into blocks. Every source gets a
quota of slots that comes to its target; a multinomial draw deals the slots over the
output shards, and a pseudorandom permutation of the source's block numbers says which
block a slot holds: the first pass over the permutation takes every block once, the
next pass goes by another permutation. Blocks and slots meet in a join on the block
number.

Everything is a function of the rows and the seed, so a rerun or a retried task gives
the same mix. A null text has no words; a null source is a source of its own and comes
last. Rows that repeat each other count each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplytic.llm.common import mixed, text_or_empty, word_count, words
from shoplytic.session import pinned

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BLOCK_WORDS = 128
SHARDS = 64
SEED = 20


def source_key() -> Column:
    """A number for a source, null too; not null even where the source is."""
    return F.xxhash64(F.col("source").isNull(), F.col("source"))


def row_key() -> Column:
    """128 bits of a document's five columns: equal only for rows that repeat."""
    columns = [F.col(c) for c in ("doc_id", "text", "lang", "source", "n_chars")]
    nulls = [c.isNull() for c in columns]
    return F.struct(
        F.xxhash64(*nulls, *columns).alias("a"), F.xxhash64(F.lit(1), *nulls, *columns).alias("b")
    )


def source_targets(
    sizes: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """``source, source_size, target`` in words; one row per source.

    ``sizes`` has one row per source. Sources in code point order, null last, get the
    weights in turn and divide ``share`` of all words by them. A target stops at
    ``most`` times its source's size and the rest goes to the others by weight. So a
    target is ``min(most * size, level * weight)``, and the level follows from running
    sums over the sources in the order in which they reach their limit.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sizes.withColumn(
        "weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn)
    ).withColumn("limit", most * F.col("source_size"))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = share * F.sum("source_size").over(everything)
    left = total - F.coalesce(F.sum("limit").over(earlier), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(
        F.sum("weight").over(earlier), F.lit(0.0)
    )
    level = left / weight_left
    # The first source whose limit is not below its level, and all after it, stay under
    # the limit; that first level is the highest of theirs.
    under = F.when(F.col("limit") / F.col("weight") >= level, level)
    return (
        ranked.withColumn("level", under)
        .withColumn("level", F.max("level").over(everything))
        .select(
            "source",
            "source_size",
            F.coalesce(F.least("limit", F.col("level") * F.col("weight")), F.col("limit")).alias(
                "target"
            ),
        )
    )


def permuted(index: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 at ``index``, one per seed.

    A four-round Feistel network over the next even power of two; values beyond ``size``
    walk on along their cycle until they are inside.
    """
    half = np.array(
        [max(1, (int(n - 1).bit_length() + 1) // 2) for n in size.tolist()], dtype=np.uint64
    )
    mask = (np.uint64(1) << half) - np.uint64(1)
    value, limit = index.astype(np.uint64), size.astype(np.uint64)
    keys = [mixed(seed.astype(np.uint64) + np.uint64(r)) for r in range(4)]
    todo = np.arange(len(value))
    while len(todo):
        left, right = value[todo] >> half[todo], value[todo] & mask[todo]
        for key in keys:
            left, right = right, left ^ (mixed(right ^ key[todo]) & mask[todo])
        value[todo] = (left << half[todo]) | right
        todo = todo[value[todo] >= limit[todo]]
    return value.astype(np.int64)


def positions(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Where every row begins in its source's run of words, with the source's figures.

    A running sum over a whole source would put a third of all rows in one task. Rows
    are dealt into about sqrt(rows) buckets instead: sums per source and bucket give
    each bucket its offset, and the running sum goes on inside a bucket. Both steps
    handle about sqrt(rows) rows per task.
    """
    sized = docs.select(
        "doc_id",
        "source",
        source_key().alias("source_key"),
        row_key().alias("row_key"),
        word_count(text_or_empty()).alias("size"),
    )
    sized = pinned(sized)
    buckets = max(1, math.isqrt(sized.count()))
    sized = sized.withColumn("bucket", F.pmod(F.col("row_key.a"), F.lit(buckets)))
    sums = sized.groupBy("source_key", "bucket").agg(
        F.first("source").alias("source"), F.sum("size").alias("words")
    )
    sums = pinned(sums)
    targets = source_targets(
        sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    ).withColumn("source_key", source_key())
    blocks = F.ceil(F.col("source_size") / block_words)
    targets = targets.select(
        "source_key",
        "source_size",
        "target",
        blocks.alias("blocks"),
        F.when(F.col("source_size") > 0, F.round(F.col("target") * blocks / F.col("source_size")))
        .otherwise(0)
        .cast("long")
        .alias("quota"),
    )
    before = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sums.select(
        "source_key",
        "bucket",
        F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"),
    ).join(targets, "source_key")
    in_bucket = (
        Window.partitionBy("source_key", "bucket")
        .orderBy("doc_id", "row_key")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return sized.join(offsets, ["source_key", "bucket"]).select(
        "doc_id",
        "source",
        "source_key",
        "row_key",
        "size",
        "source_size",
        "target",
        "blocks",
        "quota",
        (F.col("offset") + F.coalesce(F.sum("size").over(in_bucket), F.lit(0))).alias("start"),
    )


def pieces(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The part that each block has of each document: ``first`` word (0-based) and ``words``."""
    begin, end = F.col("start"), F.col("start") + F.col("size")
    width = F.lit(block_words)
    spread = placed.filter(F.col("size") > 0).withColumn(
        "block",
        F.explode(F.sequence(F.floor(begin / width), F.floor((end - 1) / width))),
    )
    first = F.greatest(begin, F.col("block") * width)
    last = F.least(end, (F.col("block") + 1) * width)
    return spread.select(
        "doc_id",
        "row_key",
        "source_key",
        "start",
        "block",
        (first - begin).alias("first"),
        (last - first).alias("words"),
    )


def slots(placed: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``shard, source_key, draw, epoch, block``: what every slot of the mix holds.

    A source's slots fall on the shards by a multinomial draw of its quota, so each
    shard's source counts are a random draw while the totals come to the targets.
    """
    figures = placed.groupBy("source_key").agg(
        F.first("blocks").alias("blocks"), F.first("quota").alias("quota")
    )

    def drawn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                key = int(row.source_key) & (2**64 - 1)
                counts = np.random.default_rng([seed, key]).multinomial(
                    int(row.quota), np.full(shards, 1.0 / shards)
                )
                yield pd.DataFrame(
                    {
                        "source_key": row.source_key,
                        "blocks": row.blocks,
                        "shard": np.arange(shards, dtype=np.int32),
                        "first": np.concatenate([[0], np.cumsum(counts)[:-1]]),
                        "count": counts,
                    }
                )

    schema = "source_key long, blocks long, shard int, first long, count long"
    draws = figures.mapInPandas(drawn, schema).filter(F.col("count") > 0)
    # A hot source's slots spread over the tasks by shard.
    each = draws.repartition("source_key", "shard").withColumn(
        "draw", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1))
    )

    @F.pandas_udf("long")
    def block_of(
        index: pd.Series, size: pd.Series, source: pd.Series, epoch: pd.Series
    ) -> pd.Series:
        seeds = mixed(source.to_numpy().astype(np.uint64)) + mixed(
            epoch.to_numpy().astype(np.uint64) + np.uint64(seed)
        )
        return pd.Series(permuted(index.to_numpy(), size.to_numpy(), seeds))

    each = each.withColumn("epoch", F.floor(F.col("draw") / F.col("blocks")))
    index = F.col("draw") % F.col("blocks")
    return each.select(
        "shard",
        "source_key",
        "draw",
        "epoch",
        block_of(index, "blocks", "source_key", "epoch").alias("block"),
    )


def mix(
    placed: DataFrame,
    block_words: int = BLOCK_WORDS,
    shards: int = SHARDS,
    seed: int = SEED,
) -> DataFrame:
    """The mix as pieces of documents: ``shard, source_key, draw, epoch, block``, then
    ``doc_id, row_key, start, first, words``.

    (source, draw) is one slot; its pieces follow each other by ``start``. Blocks are
    many and short, so a source with a third of all words still spreads over all tasks.
    """
    parts = pieces(placed, block_words)
    # Both sides grow with the words: a slot list looks small to the planner before it is
    # spread out, and must not be broadcast for that.
    return slots(placed, shards, seed).hint("merge").join(parts, ["source_key", "block"])


def words_taken(placed: DataFrame, mixture: DataFrame) -> DataFrame:
    """``placed`` with ``taken``: the words the mix has of each row, repeats counted."""
    taken = mixture.groupBy("source_key", "start").agg(F.sum("words").alias("taken"))
    # Of rows with one start only the one with words is in the mix.
    taken = taken.withColumn("has_words", F.lit(True))
    keyed = placed.withColumn("has_words", F.col("size") > 0)
    return keyed.join(taken, ["source_key", "start", "has_words"], "left").select(
        *placed.columns, F.coalesce("taken", F.lit(0)).alias("taken")
    )


def mixed_documents(
    docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED
) -> DataFrame:
    """The mix as documents: one row per document and pass that takes words of it.

    A document taken whole keeps its text; of one taken in part, the words taken stay,
    joined by one space. ``n_chars`` is counted anew. Only columns of documents return.
    The texts move once, in the aggregation that joins repeated rows.
    """
    placed = pinned(positions(docs, block_words))
    mixture = mix(placed, block_words, shards, seed)
    parts = (
        mixture.groupBy("row_key", "source_key", "start", "epoch")
        .agg(
            F.sort_array(F.collect_list(F.struct("first", "words"))).alias("parts"),
            F.sum("words").alias("words"),
        )
        .groupBy("row_key")
        .agg(F.collect_list(F.struct("start", "epoch", "parts", "words")).alias("taken"))
    )
    texts = (
        docs.select("doc_id", "text", "lang", "source", "n_chars")
        .withColumn("row_key", row_key())
        .groupBy("row_key")
        .agg(*[F.first(c).alias(c) for c in ("doc_id", "text", "lang", "source")])
    )
    each = texts.join(parts, "row_key").withColumn("take", F.explode("taken"))
    tokens = words(F.col("text"))
    cut = F.array_join(
        F.flatten(
            F.transform(
                F.col("take.parts"), lambda p: F.slice("tokens", p["first"] + 1, p["words"])
            )
        ),
        " ",
    )
    each = each.withColumn("tokens", tokens)
    text = F.when(F.col("take.words") == F.size("tokens"), F.col("text")).otherwise(cut)
    return each.withColumn("text", text).select(
        "doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars")
    )
