from __future__ import annotations

import gzip
import hashlib
import random
import uuid

import pytest

from shoplytic.llm import warc

SCHEMA = "page_id long, url string, html string, file string"


def pages(spark, rows):
    """Pages with a column of a name that the reader uses too."""
    return spark.createDataFrame([(i, u, h, "mine") for i, u, h in rows], SCHEMA)


def expected(rows):
    """The contract, from all rows at once."""
    largest = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 1000 and i is not None:
            largest[body] = max(largest.get(body, i), i)
    found = []
    for i, _, html in rows:
        body = (html or "").encode()
        at = largest.get(body)
        kind = "response" if at is None or at == i else "revisit"
        refers = at if kind == "revisit" else None
        found.append((i, len(body), hashlib.sha1(body).hexdigest(), kind, refers))
    return sorted(found, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def fake(length, inside=""):
    """What looks like a record, in a payload."""
    return (
        f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\n"
        f"Content-Length: {length}\r\n\r\n{inside}\r\n\r\n"
    )


LONG = "x" * 1500
ODD = [
    (1, "http://a/", "short"), (2, None, None), (3, "", ""), (4, "http://a/\r\nEvil: 1", "short"),
    (5, "http://b/WARC/1.0", LONG), (6, "http://c", LONG), (6, "http://c", LONG), (7, "u", LONG),
    (8, "u", "é" * 700), (9, "u", "é" * 700), (None, "u", LONG), (None, "u", "n" * 1200),
    (-3, "u", "\r\n" * 600), (10, "u", "\r\n\r\n" + "y" * 1000 + "\r\n"),
    (11, "u", "WARC/1.0\r\n"), (12, "u", "a\nWARC/1.0\r\nb"), (13, "u", "\nWARC/1."),
    (14, "u", "lead\r\n\r\n" + fake(5, "hello") + "tail"),
    (15, "u", fake(10**9) + fake(3, "abc") * 50), (16, "u", "end\r\n\r\n" + fake(0)),
    (17, "u", "z" * 30_000 + "\n" + fake(7, "1234567") + "z" * 20_000),
]


@pytest.fixture
def folder(tmp_path):
    return lambda: str(tmp_path / uuid.uuid4().hex)


def test_round_trip(spark, folder):
    result = warc.page_records(spark, pages(spark, ODD).repartition(3), folder())
    assert result.columns == [
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    ]
    assert got(result) == expected(ODD)


@pytest.mark.parametrize("split", [900, 4099])
def test_files_cut_into_small_splits(spark, folder, split):
    source = random.Random(split)
    rows = [*ODD] + [
        (100 + i, "u", source.choice(["\r\n", "\n", "q"]) * source.randrange(900)
         + source.choice(["", fake(4, "1234"), fake(90_000), "\r\n"]))
        for i in range(40)
    ]
    path = folder()
    warc.write_archives(pages(spark, rows).coalesce(2), path)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(split))
    try:
        found = warc.read_archives(spark, path).cache()
        assert found.count() == len(rows)
        digests = {(r.at, r.file): r.declared for r in found.collect()}
        assert len(digests) == len(rows)
        held = found.filter("record_type = 'response'")
        assert held.filter("NOT (declared <=> payload_digest)").count() == 0
        assert sum(r.payload_bytes for r in held.collect()) == sum(
            e[1] for e in expected(rows) if e[3] == "response"
        )
    finally:
        spark.conf.set(key, before)


def test_compressed(spark, folder):
    path = folder()
    warc.write_archives(pages(spark, ODD), path, compression="gzip")
    found = warc.with_originals(warc.read_archives(spark, path))
    assert sorted(r.payload_bytes for r in found.collect()) == sorted(e[1] for e in expected(ODD))


def test_shuffled_join_gives_the_same(spark):
    broadcast = warc.with_revisits(pages(spark, ODD))
    shuffled = warc.with_revisits(pages(spark, ODD), most_broadcast=0)
    assert got(broadcast.select("page_id", "original")) == got(shuffled.select("page_id", "original"))


def record(payload: bytes, kind=b"resource", version=b"1.1", more=b"") -> bytes:
    return (
        b"WARC/" + version + b"\r\nWARC-Type: " + kind + b"\r\nwarc-record-id: <urn:x:"
        + payload[:3] + b">\r\n" + more + b"Content-Length: %d\r\n\r\n" % len(payload)
        + payload + b"\r\n\r\n"
    )


def test_archives_of_others(spark, tmp_path):
    (tmp_path / "members.warc.gz").write_bytes(
        gzip.compress(record(b"one")) + gzip.compress(record(b"two", more=b"X-A: b\r\n  folded\r\n"))
    )
    (tmp_path / "cut.warc").write_bytes(record(b"abc") + record(b"defghi")[:-8])
    (tmp_path / "junk.warc").write_bytes(b"junk\r\n\r\n" + record(b"not"))
    (tmp_path / "gap.warc").write_bytes(record(b"yes") + b"\r\n" + record(b"no!"))
    (tmp_path / "empty.warc").write_bytes(b"")
    (tmp_path / "bytes.warc").write_bytes(record(bytes(range(256))) + record(b"\nWARC/1.x\xff\n"))
    found = {
        (r.file.rsplit("/", 1)[1], r.payload_bytes, r.payload_digest)
        for r in warc.read_archives(spark, str(tmp_path)).collect()
    }

    def held(file, payload):
        return file, len(payload), hashlib.sha1(payload).hexdigest()

    assert found == {
        held("members.warc.gz", b"one"), held("members.warc.gz", b"two"), held("cut.warc", b"abc"),
        ("cut.warc", None, None), held("gap.warc", b"yes"), held("bytes.warc", bytes(range(256))),
        held("bytes.warc", b"\nWARC/1.x\xff\n"),
    }


def test_revisit_without_its_response(spark, tmp_path):
    more = b"WARC-Refers-To: <urn:page:5>\r\nWARC-Payload-Digest: sha1:ab\r\n"
    (tmp_path / "a.warc").write_bytes(record(b"", kind=b"revisit", more=more))
    found = warc.with_originals(warc.read_archives(spark, str(tmp_path))).collect()
    assert [(r.record_type, r.payload_bytes, r.payload_digest) for r in found] == [
        ("revisit", None, None)
    ]


def test_no_pages(spark, folder):
    assert warc.page_records(spark, pages(spark, []), folder()).collect() == []
