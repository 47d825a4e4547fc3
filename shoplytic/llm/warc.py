"""WARC archives: written from pages, read back by boundary-chain verification.

Writing. A page becomes a response record with an HTTP head and the page's bytes. Of equal
payloads of 1000 bytes or more, the page of largest page_id is the response and the others
are revisit records that name it and hold no payload. Spark's text sink writes the records;
CR LF CR LF, which ends every record, is its line separator.

Reading. Spark's text source cuts the files at every line that begins with the magic
``WARC/1.``, whether that begins a record or stands in a payload, so a task may begin
anywhere in a file. Each piece is a candidate record; its header tells the offset where its
successor has to begin. Within a split the successors are followed to the first offset
beyond it; between splits, pointer jumping from the start of each file doubles the known
chain in every round. Only candidates on that chain are records. Pieces in between belong
to the payload of the record before them, which is then put together from its pieces.

A null html is an empty payload, a null url leaves its header line out, a null page_id is
smaller than any other. Rows that share the largest page_id of their payload are all
responses. Carriage returns and line feeds in a url are percent-encoded. A record cut short
at the end of its file, or followed by anything but a record, is returned, but ends its
file's chain; if its payload isn't all there, size and digest are null. A file that begins
with anything but a record holds none. A payload is held whole by one task, pieces of it are
not: that is the only bound on its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoplytic.llm.common import broadcast_if_small, stored
from shoplytic.session import pinned

# Fixed values of the format.
MAGIC = "WARC/1."
LINE = "\r\n"
RECORD_END = LINE + LINE
BREAK = "\n" + MAGIC
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

LEAST_REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"

FRAGMENT = (
    "file string, split long, at long, next long, consumed long, record_type string, "
    "record_id string, target_uri string, refers_to string, declared string, "
    "payload_bytes long, payload_digest string, complete boolean"
)
FILES_BROADCAST = 100_000


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("-")), F.lit(">"))


def page_of(record_id: Column) -> Column:
    """The page_id in a record id; null for one of a page without id."""
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def with_revisits(
    pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES, most_broadcast: int = 1_000_000
) -> DataFrame:
    """``page_id, url, body`` and ``original``: the page to revisit instead, else null.

    Payloads are compared by SHA-256. Only the keys of payloads that repeat meet the pages.
    """
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    keyed = pages.select("page_id", "url", body.alias("body")).withColumn(
        "key",
        F.when(F.octet_length("body") >= least_bytes, F.unhex(F.sha2(F.col("body"), 256))),
    )
    repeated = pinned(
        keyed.filter(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.max("page_id").alias("largest"), F.count("*").alias("pages"))
        .filter("pages > 1 AND largest IS NOT NULL")
        .select("key", "largest")
    )
    other = ~F.col("page_id").eqNullSafe(F.col("largest"))
    return keyed.join(broadcast_if_small(repeated, most_broadcast), "key", "left").select(
        "page_id", "url", "body", F.when(other, F.col("largest")).alias("original")
    )


def _one_line(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def records(pages: DataFrame, date: str = DATE) -> DataFrame:
    """One row per page of ``with_revisits``: ``value`` is its record but for the record's end."""
    revisit = F.col("original").isNotNull()
    size = F.octet_length("body")

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value)

    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "),
        size.cast("string"),
        F.lit(RECORD_END),
    )
    block_size = F.octet_length(http) + F.when(revisit, 0).otherwise(size)
    header = F.concat_ws(
        LINE,
        F.lit(f"{MAGIC}0"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Target-URI", _one_line(F.col("url"))),
        F.lit(f"WARC-Date: {date}"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("body"))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.when(revisit, line("WARC-Refers-To", _record_id(F.col("original")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        line("Content-Length", block_size.cast("string")),
    )
    head = F.concat(header, F.lit(RECORD_END), http)
    payload = F.when(revisit, F.lit(b"")).otherwise(F.col("body"))
    # Bytes may be cast to a string unchanged, and the sink writes them unchanged.
    return pages.select(F.concat(head.cast("binary"), payload).cast("string").alias("value"))


def write_archives(pages: DataFrame, path: str, compression: str | None = None) -> None:
    """Write ``page_id, url, html`` rows as WARC files into a new folder."""
    made = records(with_revisits(pages))
    writer = made.write.option("lineSep", RECORD_END)
    if compression:
        writer = writer.option("compression", compression)
    writer.text(path)


def _header(piece: bytes) -> tuple[dict[bytes, bytes], int] | None:
    """The header of what follows the magic, and where its block begins; None if malformed."""
    end = piece.find(b"\r\n\r\n")
    if end < 0 or piece[1:3] != b"\r\n" or piece[:1] not in (b"0", b"1"):
        return None
    fields: dict[bytes, bytes] = {}
    name = b""
    for text in piece[3:end].split(b"\r\n"):
        if text[:1] in (b" ", b"\t") and name:
            fields[name] += b" " + text.strip()
            continue
        name, colon, value = text.partition(b":")
        if not colon:
            return None
        name = name.strip().lower()
        fields[name] = value.strip()
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or len(length) > 18 or b"warc-type" not in fields:
        return None
    return fields, end + 4


def _payload(fields: dict[bytes, bytes], block: bytes) -> bytes:
    """The block without its HTTP head, if it has one."""
    if fields.get(b"content-type", b"").lower().startswith(b"application/http"):
        head = block.find(b"\r\n\r\n")
        return block[head + 4 :] if head >= 0 else b""
    return block


def _text(value: bytes | None) -> str | None:
    return None if value is None else value.decode("utf-8", "replace")


def _digest_of(declared: bytes | None) -> str | None:
    return _text(declared).partition(":")[2].lower() if declared else None


def _candidate(file: str, split: int, at: int, piece: bytes) -> tuple:
    """The row of a piece; ``piece`` is what follows the magic, ``at`` where the magic is."""
    found = _header(piece)
    if found is None:
        return (file, split, at, *[None] * 10)
    fields, begin = found
    length = int(fields[b"content-length"])
    complete = piece[begin + length :] in (b"\r\n\r", b"\r\n\r\n")
    kind = fields[b"warc-type"].lower()
    size = digest = None
    if complete and kind != b"revisit":
        payload = _payload(fields, piece[begin : begin + length])
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    return (
        file,
        split,
        at,
        at + len(MAGIC) + begin + length + 4,
        None,
        _text(kind),
        _text(fields.get(b"warc-record-id")),
        _text(fields.get(b"warc-target-uri")),
        _text(fields.get(b"warc-refers-to")),
        _digest_of(fields.get(b"warc-payload-digest")),
        size,
        digest,
        complete,
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(file, split, at, piece, consumed)`` in file order; at the end of a split, no piece.

    Offsets count from the first byte that the split reads. Every piece follows a break, but
    for the first one of a file, which is left out unless it begins with the magic.
    """
    here, position, first = None, 0, True
    for batch in batches:
        files, splits = batch.column("file"), batch.column("split").to_pylist()
        for value, file, split in zip(batch.column("value"), files, splits, strict=True):
            file = file.as_py()
            if (file, split) != here:
                if here is not None:
                    yield (*here, None, None, position)
                here, position, first = (file, split), 0, split == 0
            piece = value.as_py()
            if not first:
                yield file, split, position - len(MAGIC), piece, None
            elif piece.startswith(MAGIC.encode()):
                yield file, split, position, piece[len(MAGIC) :], None
            first = False
            position += len(piece) + len(BREAK)
    if here is not None:
        yield (*here, None, None, position)


def _scan(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.option("lineSep", BREAK)
        .text(path)
        .select(
            F.col("value").cast("binary").alias("value"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
        )
    )


def _batches_of_rows(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield _as_batch(held, schema)
            held = []
    if held:
        yield _as_batch(held, schema)


def _as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every piece with its offset, and its successor's if its header can be read.

    ``at`` and ``next`` are offsets in the file, of compressed files in what they hold.
    """
    text, whole = pa.string(), pa.int64()
    kinds = [text, whole, whole, whole, whole, text, text, text, text, text, whole, text, pa.bool_()]
    names = [column.split()[0] for column in FRAGMENT.split(", ")]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            (file, split, None, None, consumed, *[None] * 8)
            if piece is None
            else _candidate(file, split, at, piece)
            for file, split, at, piece, consumed in _pieces(batches)
        )
        yield from _batches_of_rows(rows, schema)

    found = stored(_scan(spark, path).mapInArrow(read, FRAGMENT), "warc-pieces")
    # Splits of a file follow each other without gaps or overlaps: a row per split.
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(
        Window.unboundedPreceding, -1
    )
    bases = found.filter("consumed IS NOT NULL").select(
        "file", "split", F.coalesce(F.sum("consumed").over(earlier), F.lit(0)).alias("base")
    )
    pieces = found.filter("consumed IS NULL").drop("consumed")
    return pieces.join(broadcast_if_small(pinned(bases)), ["file", "split"]).select(
        "file",
        "split",
        (F.col("at") + F.col("base")).alias("at"),
        (F.col("next") + F.col("base")).alias("next"),
        *[c for c in pieces.columns if c not in ("file", "split", "at", "next")],
    )


def _exits(links: pa.Table) -> pa.Table:
    """For each candidate of a split, where the chain from it leaves the split."""
    at, following = (links.column(c).to_numpy() for c in ("at", "next"))
    order = np.argsort(at)
    at, following = at[order], following[order]
    where = np.searchsorted(at, following)
    inside = (where < len(at)) & (at[np.minimum(where, len(at) - 1)] == following)
    exits = following.copy()
    # A successor lies behind: from the last candidate to the first.
    for i in np.flatnonzero(inside)[::-1]:
        exits[i] = exits[where[i]]
    return pa.table(
        {
            "file": links.column("file").take(pa.array(order)),
            "split": links.column("split").take(pa.array(order)),
            "at": at,
            "exit": exits,
        }
    )


def _on_chain(links: pa.Table, entries: pa.Table) -> pa.Table:
    """The candidates of a split on the chain from where it enters the split."""
    at, following = (links.column(c).to_pylist() for c in ("at", "next"))
    after = dict(zip(at, following, strict=True))
    found = set()
    for place in entries.column("at").to_pylist():
        while place in after and place not in found:
            found.add(place)
            place = after[place]
    file = links.column("file")[0].as_py() if found else None
    kept = sorted(found)
    return pa.table(
        {
            "file": pa.array([file] * len(kept), pa.string()),
            "at": pa.array(kept, pa.int64()),
        }
    )


def reachable(links: DataFrame) -> DataFrame:
    """``file, at`` of the candidates that the chain from offset 0 of their file meets.

    ``links`` has ``file, split, at, next``, pinned. Tasks see one split each; the rounds of
    pointer jumping handle only offsets where some chain enters a split.
    """
    exits = pinned(
        links.groupBy("file", "split").applyInArrow(
            _exits, "file string, split long, at long, exit long"
        )
    )
    targets = exits.select("file", F.col("exit").alias("at")).distinct()
    starts = exits.filter("at = 0").select("file", "at")
    entries = pinned(exits.join(targets.union(starts).distinct(), ["file", "at"]))
    jumps = entries.select("file", "at", F.col("exit").alias("to"))
    known, reached = 0, entries.filter("at = 0").select("file", "at")
    count = reached.count()
    while count > known:
        known = count
        ahead = reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        ahead = ahead.join(entries.select("file", "at"), ["file", "at"], "left_semi")
        reached = pinned(reached.union(ahead).distinct())
        count = reached.count()
        if count > known:
            second = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("far"))
            jumps = pinned(
                jumps.join(second, ["file", "to"]).select("file", "at", F.col("far").alias("to"))
            )
    entered = entries.join(reached, ["file", "at"]).select("file", "split", "at")
    return (
        links.groupBy("file", "split")
        .cogroup(entered.groupBy("file", "split"))
        .applyInArrow(_on_chain, "file string, at long")
    )


def _assembled(spark: SparkSession, path: str, pieces: DataFrame, chain: DataFrame, cut: DataFrame):
    """``file, at, payload_bytes, payload_digest`` of records that lie in several pieces.

    A piece belongs to the last record on the chain that begins at or before it. That is
    found by split: a row per split carries it over to the next.
    """
    marked = pieces.select("file", "split", "at").join(
        chain.withColumn("start", F.col("at")), ["file", "at"], "left"
    )
    in_split = Window.partitionBy("file", "split").orderBy("at")
    splits_before = Window.partitionBy("file").orderBy("split").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = (
        marked.groupBy("file", "split")
        .agg(F.max("start").alias("last"), F.min("at").alias("first"))
        .select("file", "split", "first", F.max("last").over(splits_before).alias("carried"))
    )
    owned = marked.withColumn("own", F.last("start", ignorenulls=True).over(in_split)).join(
        carried, ["file", "split"]
    )
    wanted = pinned(
        owned.select(
            "file",
            "split",
            (F.col("at") - F.col("first")).alias("from_first"),
            F.coalesce("own", "carried").alias("owner"),
        ).join(cut.select("file", F.col("at").alias("owner")), ["file", "owner"], "left_semi")
    )
    files = pinned(wanted.select("file").distinct())
    scan = _scan(spark, path)
    if files.count() <= FILES_BROADCAST:  # a shuffle would lose the order of rows
        scan = scan.join(F.broadcast(files), "file", "left_semi")

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, first = None, 0
        schema = pa.schema(
            [("file", pa.string()), ("split", pa.int64()), ("from_first", pa.int64()),
             ("piece", pa.binary())]
        )

        def rows():
            nonlocal here, first
            for file, split, at, piece, _ in _pieces(batches):
                if piece is not None:
                    if (file, split) != here:
                        here, first = (file, split), at
                    yield file, split, at - first, piece

        yield from _batches_of_rows(rows(), schema, 64)

    found = scan.select("value", "file", "split").mapInArrow(
        bodies, "file string, split long, from_first long, piece binary"
    )

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by([("split", "ascending"), ("from_first", "ascending")])
        whole = BREAK.encode().join(table.column("piece").to_pylist())
        fields, begin = _header(whole)
        length = int(fields[b"content-length"])
        size = digest = None
        if len(whole) >= begin + length:
            payload = _payload(fields, whole[begin : begin + length])
            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        return pa.table(
            {
                "file": table.column("file").slice(0, 1),
                "at": table.column("owner").slice(0, 1),
                "whole_bytes": pa.array([size], pa.int64()),
                "whole_digest": pa.array([digest], pa.string()),
            }
        )

    return (
        found.join(wanted, ["file", "split", "from_first"])
        .groupBy("file", "owner")
        .applyInArrow(join, "file string, at long, whole_bytes long, whole_digest string")
    )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the files at ``path``.

    ``file, at, record_type, record_id, target_uri, refers_to, declared`` (digest by the
    header) and ``payload_bytes, payload_digest`` of the payload that the record holds.
    Those two are null for revisits and for payloads cut short.
    """
    pieces = candidates(spark, path)
    links = pinned(pieces.filter("next IS NOT NULL").select("file", "split", "at", "next"))
    chain = pinned(reachable(links))
    found = pieces.join(chain, ["file", "at"])
    columns = ["file", "at", "record_type", "record_id", "target_uri", "refers_to", "declared"]
    cut = pinned(
        found.filter("NOT complete AND record_type != 'revisit'").select("file", "at")
    )
    if cut.isEmpty():
        return found.select(*columns, "payload_bytes", "payload_digest")
    whole = _assembled(spark, path, pieces, chain, cut)
    return found.join(whole, ["file", "at"], "left").select(
        *columns,
        F.coalesce("payload_bytes", "whole_bytes").alias("payload_bytes"),
        F.coalesce("payload_digest", "whole_digest").alias("payload_digest"),
    )


def with_originals(found: DataFrame) -> DataFrame:
    """Records, with revisits given size and digest of the response they refer to.

    A record id may repeat, so the declared digest has to agree too. A revisit without such
    a response keeps nulls.
    """
    kept = found.filter("record_type != 'revisit'")
    originals = kept.groupBy(
        F.col("record_id").alias("refers_to"), F.col("payload_digest").alias("declared")
    ).agg(F.max("payload_bytes").alias("original_bytes"))
    revisits = pinned(found.filter("record_type = 'revisit'")).join(
        pinned(originals), ["refers_to", "declared"], "left"
    )
    there = F.col("original_bytes").isNotNull()
    return kept.unionByName(
        revisits.select(
            *[c for c in found.columns if not c.startswith("payload_")],
            F.col("original_bytes").alias("payload_bytes"),
            F.when(there, F.col("declared")).alias("payload_digest"),
        )
    )


def page_records(spark: SparkSession, pages: DataFrame, path: str) -> DataFrame:
    """Write ``pages`` to ``path`` and read them back: what each page has become."""
    write_archives(pages, path)
    return with_originals(read_archives(spark, path)).select(
        page_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page_of(F.col("refers_to")).alias("refers_to"),
    )
