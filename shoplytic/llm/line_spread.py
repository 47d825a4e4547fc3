"""Boilerplate lines by the number of distinct sites that carry them.

Every distinct line gets a HyperLogLog sketch of its sites; sketches merge in the map-side
and final aggregation, so a line in a third of all documents is a few bytes per task.
Estimates decide lines far from the threshold. Lines near it are few and get an exact
count of distinct sites. Only then are the boilerplate lines cut from the documents.

The site of a document is its ``source``; null is a site of its own. A line is what
stands between line feeds, compared unchanged. Lines of white space only are never
boilerplate. A null text has no lines and stays null. Texts may have any length; one of very
many lines costs its lines times its boilerplate lines, as each line is looked up among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplytic.session import pinned

MIN_SITES = 10
SKETCH_BITS = 12
# Four standard errors of a sketch of 2^12 registers, 1.04 / 64 each, rounded up.
NEAR = 0.07


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _line_key(line: Column) -> Column:
    """128 bits for a line, so that no two lines of a corpus fall together."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _text_key() -> Column:
    return F.struct(
        F.xxhash64("text").alias("ta"), F.xxhash64(F.lit(1), F.col("text")).alias("tb")
    )



def line_sites(docs: DataFrame) -> DataFrame:
    """``line_key, site`` for every line with something but white space in it."""
    return (
        docs.select(
            F.xxhash64(F.col("source").isNull(), F.col("source")).alias("site"),
            F.explode(_lines(F.col("text"))).alias("line"),
        )
        .filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
        .select(_line_key(F.col("line")).alias("line_key"), "site")
    )


def boilerplate_lines(
    docs: DataFrame, min_sites: int = MIN_SITES, sketch_bits: int = SKETCH_BITS, near: float = NEAR
) -> DataFrame:
    """``line_key`` of every line on ``min_sites`` sites or more.

    Sketches rule out nearly all lines. Those estimated within ``near`` of the threshold
    are counted exactly; so the result is that of exact counts unless a sketch is off by
    more than ``near``, its four standard errors.
    """
    lines = line_sites(docs)
    spread = lines.groupBy("line_key").agg(F.hll_sketch_agg("site", sketch_bits).alias("sketch"))
    spread = spread.select("line_key", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = pinned(spread.filter(F.col("sites") >= (1 - near) * min_sites))
    sure = spread.filter(F.col("sites") > (1 + near) * min_sites).select("line_key")
    unsure = spread.filter(F.col("sites") <= (1 + near) * min_sites).select("line_key")
    exact = (
        lines.join(unsure, "line_key", "left_semi")
        .groupBy("line_key", "site")
        .agg(F.lit(1))
        .groupBy("line_key")
        .count()
        .filter(F.col("count") >= min_sites)
        .select("line_key")
    )
    return pinned(sure.union(exact))


def without_boilerplate(docs: DataFrame, boilerplate: DataFrame) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_removed`` and ``kept_text``; one row per row.

    What to remove depends on the text alone: each distinct text meets the boilerplate
    once, and repeated texts share the answer. Columns of ``docs`` called like the new
    ones are replaced.
    """
    new = ("n_lines", "n_removed", "kept_text")
    keyed = docs.select(
        F.struct(*[c for c in docs.columns if c not in new]).alias("row"),
        F.col("text").alias("text"),
        _text_key().alias("text_key"),
    )
    hits = (
        docs.select(_text_key().alias("text_key"), F.explode(_lines(F.col("text"))).alias("line"))
        .select("text_key", _line_key(F.col("line")).alias("line_key"))
        .join(boilerplate, "line_key")
        .groupBy("text_key")
        .agg(F.collect_set("line_key").alias("hits"))
    )
    lines = _lines(F.col("text"))
    kept = F.when(F.col("hits").isNull(), lines).otherwise(
        F.filter(lines, lambda line: ~F.array_contains("hits", _line_key(line)))
    )
    return (
        keyed.join(hits, "text_key", "left")
        .select("row", lines.alias("lines"), kept.alias("kept"))
        .select(
            "row.*",
            F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
            F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).cast("long").alias("n_removed"),
            F.array_join("kept", "\n").alias("kept_text"),
        )
    )
