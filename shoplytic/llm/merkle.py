"""Merkle manifest of a data set, with leaf positions from bitmaps instead of a sort.

A row is a leaf: the SHA-256 of its fields. Per source the leaves ascend by doc_id, and runs
of three become nodes until one is left, the source's subroot; subroots, ordered by source,
make the root in the same way.

Positions. Every source has a bitmap of its doc_ids, kept as its words of 64 bits that are
not empty. Partial words merge by OR. A directory counts the rows before each word: words
within chunks of 64, chunks within regions, regions within zones, so that no window holds
more than 2^18 narrow rows however the ids are spread. A leaf's position is the count before
its word and the bits below its own. Rows that repeat a doc_id are counted besides; their
order among each other comes from a second bitmap, of the leaves' first 60 bits.

Levels. A node's position names its block and its slot; an exchange brings the 729 slots of
a block together, which a task reduces six levels at once. Proofs go the other way: a block
passes the path above it on to its nodes.

Nulls are fields like any other ("-"); a null doc_id comes before all ids, a null source
before all sources. Rows alike in all five fields are leaves of their own, one behind the
other. Texts may have any length. Without rows the result is empty and there is no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplytic.llm.common import broadcast_if_small, stored
from shoplytic.operators.ranking import in_sorted_slices
from shoplytic.session import pinned

ARITY = 3
# Levels that one exchange reduces, and the slots of a block.
LEVELS = 6
SLOTS = ARITY**LEVELS

WORD_BITS, CHUNK_BITS, REGION_BITS, ZONE_BITS = 6, 6, 18, 17
BEFORE_ALL_WORDS = -(2**57) - 1
# Rows alike in everything beyond this number are dealt out over tasks before they are listed.
COPIES_PER_TASK = 100_000

NODE = "tree long, node long, levels int, digest binary"
PATH = "tree long, node long, path binary, subroot binary, root binary"


@dataclass(frozen=True)
class Manifest:
    """Leaves with their places, the nodes that each exchange left, and the sources."""

    leaves: DataFrame
    rounds: list[DataFrame]
    sources: DataFrame
    source_rounds: list[DataFrame]
    root: bytes | None


def _field(value: Column) -> Column:
    text = value.cast("string")
    sized = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.when(value.isNull(), F.lit("-")).otherwise(sized)


def leaf_digest(text: Column) -> Column:
    """The leaf of a document with ``text`` in place of its own, 32 bytes."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    return F.unhex(F.sha2(F.concat(*[_field(f) for f in fields]), 256))


def tampered_text() -> Column:
    """The text without its line feeds, in every second document by the CRC-32 of its id."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return F.when(chosen, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def _rows_before(df: DataFrame, within: list[str], order: str, above: str | None) -> DataFrame:
    """Add ``before``: the rows in earlier members of the group, and before the group."""
    earlier = (
        Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum("rows").over(earlier), F.lit(0))
    return df.withColumn("before", before + F.col(above) if above else before)


def word_directory(words: DataFrame) -> DataFrame:
    """``words`` (group, word, bits, rows) with ``before``: rows of smaller ids in the group."""
    chunk = F.shiftright("word", CHUNK_BITS)
    region, zone = F.shiftright("chunk", REGION_BITS), F.shiftright("region", ZONE_BITS)
    words = words.withColumn("chunk", chunk)
    chunks = pinned(words.groupBy("group", "chunk").agg(F.sum("rows").alias("rows"))).withColumn(
        "region", region
    )
    regions = chunks.groupBy("group", "region").agg(F.sum("rows").alias("rows"))
    regions = pinned(regions).withColumn("zone", zone)
    zones = regions.groupBy("group", "zone").agg(F.sum("rows").alias("rows"))

    def named(df: DataFrame, key: str) -> DataFrame:
        return df.select("group", key, F.col("before").alias("above"))

    zones = named(_rows_before(zones, ["group"], "zone", None), "zone")
    regions = regions.join(zones, ["group", "zone"])
    regions = named(_rows_before(regions, ["group", "zone"], "region", "above"), "region")
    chunks = chunks.join(regions, ["group", "region"])
    chunks = named(_rows_before(chunks, ["group", "region"], "chunk", "above"), "chunk")
    words = words.join(chunks, ["group", "chunk"])
    return _rows_before(words, ["group", "chunk"], "word", "above").select(
        "group", "word", "bits", "before"
    )


def ranked(counted: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``counted`` (group, key, rows, ...) with ``before``: the group's rows of smaller keys.

    Rows of one key get the same number. The second frame has ``group, key, kinds`` for the
    keys of more rows of ``counted`` than one; None if there are no such keys.
    """
    at = F.col("key").bitwiseAND(63).cast("int")
    one = F.lit(1).cast("long")
    word = F.coalesce(F.shiftright("key", WORD_BITS), F.lit(BEFORE_ALL_WORDS))
    placed = counted.withColumn("word", word)
    bit = F.coalesce(F.call_function("shiftleft", one, at), F.lit(0).cast("long"))
    words = placed.groupBy("group", "word").agg(
        F.bit_or(bit).alias("bits"), F.sum("rows").alias("rows")
    )
    words = pinned(words)
    directory = word_directory(words)
    below = F.call_function("shiftleft", F.lit(-1).cast("long"), at)
    inside = F.coalesce(F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(below))), F.lit(0))

    repeats = words.filter("rows > bit_count(bits)").select("group", "word")
    if repeats.isEmpty():
        return placed.join(pinned(directory), ["group", "word"]).select(
            *counted.columns, (F.col("before") + inside).alias("before")
        ), None
    each = (
        placed.join(repeats, ["group", "word"], "left_semi")
        .groupBy("group", "word", "key")
        .agg(F.sum("rows").alias("rows"), F.count("*").alias("kinds"))
    )
    each = pinned(each)
    surplus = F.struct(at.alias("at"), (F.col("rows") - 1).alias("rows"))
    more = (
        each.filter("rows > 1 AND key IS NOT NULL")
        .groupBy("group", "word")
        .agg(F.collect_list(surplus).alias("more"))
    )
    directory = pinned(directory.join(more, ["group", "word"], "left"))
    lower = F.filter(F.coalesce("more", F.array()), lambda m: m["at"] < at)
    extra = F.aggregate(lower, F.lit(0).cast("long"), lambda total, m: total + m["rows"])
    found = placed.join(directory, ["group", "word"]).select(
        *counted.columns, (F.col("before") + inside + extra).alias("before")
    )
    return found, each.filter("kinds > 1").select("group", "key", "kinds")


def _among_equal_ids(leaves: DataFrame, repeated: DataFrame) -> DataFrame:
    """Add to ``before`` the rows of the same doc_id whose leaves are smaller."""
    # Structs with null fields equal each other.
    leaves = leaves.withColumn("id", F.struct("group", "key"))
    ids = pinned(repeated.select(F.struct("group", "key").alias("id")))
    single = leaves.join(ids, "id", "left_anti").drop("id")
    several = pinned(leaves.join(ids, "id", "left_semi"))
    prefix = F.conv(F.substring(F.hex("leaf"), 1, 15), 16, 10).cast("long")
    inner = several.select(
        F.col("id").alias("group"), prefix.alias("key"), "leaf", F.col("copies").alias("rows")
    )
    places, _ = ranked(inner)
    alike = Window.partitionBy("id", "prefix").orderBy("leaf").rowsBetween(
        Window.unboundedPreceding, -1
    )
    places = places.select(
        F.col("group").alias("id"),
        "leaf",
        F.col("key").alias("prefix"),
        F.col("before").alias("behind"),
        "rows",
    ).withColumn("behind", F.col("behind") + F.coalesce(F.sum("rows").over(alike), F.lit(0)))
    several = several.join(places.select("id", "leaf", "behind"), ["id", "leaf"]).withColumn(
        "before", F.col("before") + F.col("behind")
    )
    return single.unionByName(several.select(*single.columns))


def _listed(leaves: DataFrame) -> DataFrame:
    """One row per row of the data, ``node`` being its position in its source."""
    many = leaves.filter(F.col("copies") > COPIES_PER_TASK)
    step = F.lit(COPIES_PER_TASK).cast("long")
    parts = many.withColumn(
        "from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, step))
    ).withColumn("to", F.least(F.col("from") + step, F.col("copies")) - 1)
    few = leaves.filter(F.col("copies") <= COPIES_PER_TASK)
    few = few.withColumn("from", F.lit(0).cast("long")).withColumn("to", F.col("copies") - 1)
    listed = few.unionByName(parts.repartition("group", "key", "from")).withColumn(
        "copy", F.explode(F.sequence("from", "to"))
    )
    return listed.select(
        "group",
        (F.col("before") + F.col("copy")).alias("node"),
        F.col("key").alias("doc_id"),
        "leaf",
        "changed",
    )


def _levels(count: Column) -> Column:
    """The levels above ``count`` leaves: the least d with 3^d >= count."""
    return sum((F.when(count > ARITY**k, 1).otherwise(0) for k in range(40)), F.lit(0)).cast("int")


def _numbered(sources: DataFrame) -> DataFrame:
    """Add ``tree``, the position of each source, null first, then by UTF-8 bytes."""
    sliced = in_sorted_slices(sources, F.col("group.source").asc_nulls_first())
    sizes = sliced.groupBy("_slice").agg(F.count("*").alias("rows"))
    offsets = _rows_before(sizes, [], "_slice", None).select("_slice", "before")
    return sliced.join(offsets, "_slice").select(
        *sources.columns, (F.col("before") + F.col("_row")).alias("tree")
    )


def _hash(run: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(run)).hexdigest().encode()


def _slot_array(table: pa.Table, column: str) -> list[bytes]:
    """The block's digests as hex text, each at its slot."""
    slots: list[bytes] = [b""] * table.num_rows
    for node, digest in zip(
        table.column("node").to_pylist(), table.column(column).to_pylist(), strict=True
    ):
        slots[node % SLOTS] = digest.hex().encode()
    return slots


def _block_levels(slots: list[bytes], levels: int) -> list[list[bytes]]:
    """The slots, and what each of the next levels is made of."""
    found = [slots]
    for _ in range(min(levels, LEVELS)):
        below = found[-1]
        found.append([_hash(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return found


def _reduce(table: pa.Table) -> pa.Table:
    levels = table.column("levels")[0].as_py()
    top = _block_levels(_slot_array(table, "digest"), levels)[-1]
    return pa.table(
        {
            "tree": table.column("tree").slice(0, 1),
            "node": pa.array([table.column("node")[0].as_py() // SLOTS], pa.int64()),
            "levels": pa.array([max(0, levels - LEVELS)], pa.int32()),
            "digest": pa.array([bytes.fromhex(top[0].decode())], pa.binary()),
        }
    )


def _blocks(nodes: DataFrame):
    return nodes.withColumn("block", F.expr(f"node div {SLOTS}")).groupBy("tree", "block")


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """``nodes``, and what is left of them after each exchange, down to one per tree."""
    found = [nodes]
    left = nodes.agg(F.max("levels")).first()[0]
    while left is not None:
        reduced = _blocks(found[-1].select("tree", "node", "levels", "digest"))
        found.append(pinned(reduced.applyInArrow(_without_block(_reduce), NODE)))
        left = left - LEVELS if left > LEVELS else None
    return found


def _without_block(reduce):
    return lambda table: reduce(table.drop_columns(["block"]))


def build(docs: DataFrame) -> Manifest:
    """The whole tree over ``docs``: doc_id, text, lang, source and n_chars."""
    rows = docs.select(
        F.struct("source").alias("group"),
        F.col("doc_id").cast("long").alias("key"),
        leaf_digest(F.col("text")).alias("leaf"),
        leaf_digest(tampered_text()).alias("changed"),
    )
    alike = rows.groupBy("group", "key", "leaf", "changed").agg(F.count("*").alias("copies"))
    alike = stored(alike, "leaves")
    found, repeated = ranked(alike.withColumn("rows", F.col("copies")))
    found = found.drop("rows")
    if repeated is not None:
        found = _among_equal_ids(pinned(found), repeated)
    sizes = alike.groupBy("group").agg(F.sum("copies").alias("leaves"))
    sources = pinned(_numbered(sizes).withColumn("levels", _levels(F.col("leaves"))))
    leaves = _listed(found).join(
        broadcast_if_small(sources.select("group", "tree", "levels")), "group"
    )
    leaves = stored(leaves.drop("group").withColumn("digest", F.col("leaf")), "placed-leaves")
    rounds = _rounds(leaves)
    subroots = rounds[-1].select("tree", F.col("digest").alias("subroot"))
    sources = pinned(sources.join(subroots, "tree"))
    top = sources.select(
        F.lit(0).cast("long").alias("tree"),
        F.col("tree").alias("node"),
        _levels(F.lit(sources.count()).cast("long")).alias("levels"),
        F.col("subroot").alias("digest"),
    )
    source_rounds = _rounds(top)
    last = source_rounds[-1].first()
    return Manifest(leaves, rounds, sources, source_rounds, bytes(last["digest"]) if last else None)


def _siblings(levels: list[list[bytes]], slot: int) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """The others of the run on each level, left and right of the way up from ``slot``."""
    for nodes in levels[:-1]:
        first = slot - slot % ARITY
        yield nodes[first:slot], nodes[slot + 1 : first + ARITY]
        slot //= ARITY


def _packed(left: list[bytes], right: list[bytes]) -> bytes:
    digests = b"".join(bytes.fromhex(d.decode()) for d in (*left, *right))
    return bytes([len(left), len(right)]) + digests


def _unpacked(path: bytes) -> Iterator[tuple[list[bytes], list[bytes]]]:
    at = 0
    while at < len(path):
        left, right = path[at], path[at + 1]
        ends = range(at + 2, at + 2 + 32 * (left + right), 32)
        digests = [path[i : i + 32].hex().encode() for i in ends]
        yield digests[:left], digests[left:]
        at += 2 + 32 * (left + right)


def _descend(children: pa.Table, parent: pa.Table) -> pa.Table:
    """The path from each node of a block to the root."""
    above = parent.column("path")[0].as_py()
    levels = _block_levels(_slot_array(children, "digest"), children.column("levels")[0].as_py())
    nodes = children.column("node")
    paths = [
        b"".join(_packed(left, right) for left, right in _siblings(levels, node % SLOTS)) + above
        for node in nodes.to_pylist()
    ]
    same = pa.array([0] * len(paths))
    return pa.table(
        {
            "tree": children.column("tree"),
            "node": nodes,
            "path": pa.array(paths, pa.binary()),
            "subroot": parent.column("subroot").take(same),
            "root": parent.column("root").take(same),
        }
    )


def _paths_below(nodes: DataFrame, parents: DataFrame, function, schema) -> DataFrame:
    above = parents.withColumnRenamed("node", "block").groupBy("tree", "block")
    return _blocks(nodes).cogroup(above).applyInArrow(function, schema)


def _source_paths(manifest: Manifest) -> DataFrame:
    """The path from each source's subroot to the root: a row per tree, at its node 0."""
    spark = manifest.leaves.sparkSession
    paths = spark.createDataFrame([(0, 0, b"", b"", manifest.root)], PATH)
    for nodes in reversed(manifest.source_rounds[:-1]):
        paths = pinned(_paths_below(nodes, paths, _descend, PATH))
    return paths.select(F.col("node").alias("tree"), "path", "root").join(
        manifest.sources.select("tree", "subroot"), "tree"
    ).select("tree", F.lit(0).cast("long").alias("node"), "path", "subroot", "root")


def proofs(manifest: Manifest) -> DataFrame:
    """One row per leaf: its path's digest, and the root that its changed leaf folds to."""
    kind = T.LongType()
    text = T.StringType()
    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    schema = T.StructType(
        [
            T.StructField("doc_id", kind),
            *[T.StructField(name, text) for name in names],
            T.StructField("verified", T.BooleanType()),
        ]
    )
    if manifest.root is None:
        return manifest.leaves.sparkSession.createDataFrame([], schema)
    paths = _source_paths(manifest)
    for nodes in reversed(manifest.rounds[1:-1]):
        paths = pinned(_paths_below(nodes, paths, _descend, PATH))

    def prove(leaves: pa.Table, parent: pa.Table) -> pa.Table:
        above = list(_unpacked(parent.column("path")[0].as_py()))
        above_text = b"".join(b"".join(left + right) for left, right in above)
        levels = _block_levels(_slot_array(leaves, "leaf"), leaves.column("levels")[0].as_py())
        subroot, root = (parent.column(c)[0].as_py().hex() for c in ("subroot", "root"))
        proof, folded = [], []
        nodes = leaves.column("node").to_pylist()
        for node, changed in zip(nodes, leaves.column("changed").to_pylist(), strict=True):
            path = list(_siblings(levels, node % SLOTS))
            own_text = b"".join(b"".join(left + right) for left, right in path)
            proof.append(hashlib.sha256(own_text + above_text).hexdigest())
            value = changed.hex().encode()
            for left, right in (*path, *above):
                value = _hash([*left, value, *right])
            folded.append(value.decode())
        rows = leaves.num_rows
        return pa.table(
            {
                "doc_id": leaves.column("doc_id"),
                "leaf": pa.array([d.hex() for d in leaves.column("leaf").to_pylist()]),
                "subroot": pa.array([subroot] * rows),
                "root": pa.array([root] * rows),
                "proof_sha256": pa.array(proof),
                "folded_root": pa.array(folded),
                "verified": pa.array([f == root for f in folded]),
            }
        )

    leaves = manifest.leaves.select("tree", "node", "levels", "doc_id", "leaf", "changed")
    return _paths_below(leaves, paths, prove, schema)
