"""Secrets in texts, long encoded runs confirmed by their inner structure.

Three patterns of plain secrets are reported as they match. Runs of base64 or hex, PEM
blocks and dotted tokens are candidates only: each is decoded and must parse to its last
byte, as a private key (DER with lengths that nest exactly, or the OpenSSH layout) or as
a signed token (a JSON header that names an algorithm, a JSON body and a signature of
the length that the algorithm makes). Candidates may be wrapped over lines, have their line
ends escaped, stand behind a path, begin at either nibble, or be base64 of a PEM block.

A null text is an empty text and has no spans. Texts are scanned whole, row by row, in time
that grows with their length; repeated rows are scanned again.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kinds in order, their patterns and shortest lengths.
KINDS = ("assign", "access", "hex", "token", "pem", "key_base64", "key_hex")
BASE_KINDS = KINDS[:3]
ASSIGN = re.compile(
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16

# Candidates are whole runs of their characters: no pattern starts again inside a run.
DOTTED = re.compile(r"[A-Za-z0-9_.-]+")
PEM = re.compile(
    r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s:,]|-(?!-)|\\[nr])+)-----END \1-----"
)
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
WRAPPED = re.compile(
    r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{40,}[\x20\t]*\r?\n[\x20\t]*)+[A-Za-z0-9+/]+={0,2}"
)
ANY_HEX = re.compile(r"[0-9A-Fa-f]{48,}")
PEM_HEADER = re.compile(r"\s*((?:[A-Za-z-]+:\x20[^\n]*\n)+)")
CIPHER = re.compile(r"DEK-Info:\x20[A-Z0-9-]+,((?:[0-9A-F]{2}){8,16})\s*$", re.MULTILINE)
# Bytes of a signature; RSA and PS signatures are as long as the key: 128 bytes or more.
SIGNATURE_BYTES = {
    "HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EDDSA": 64,
    "ES256K": 64,
}
# The object identifiers of password-based encryption begin so.
PBE_OIDS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
OPENSSH_MAGIC = b"openssh-key-v1\0"
SEQUENCE, INTEGER, OCTETS, OBJECT_ID = 0x30, 0x02, 0x04, 0x06

SPANS = "array<struct<kind string, start int, end int, detail string>>"

Item = tuple[int, bytes]


def _decoded(run: str) -> bytes | None:
    """The bytes of a base64 run, padded or not, in either alphabet."""
    bare = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(bare) % 4 == 1:
        return None
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except binascii.Error:
        return None


def der_items(data: bytes) -> list[Item] | None:
    """The (tag, content) items that fill ``data`` to its last byte, else None."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size >= 0x80:
            count = size & 0x7F
            if not 1 <= count <= 4 or at + count > len(data):
                return None
            size = int.from_bytes(data[at : at + count], "big")
            at += count
        if at + size > len(data):
            return None
        items.append((tag, data[at : at + size]))
        at += size
    return items


def private_key(data: bytes) -> str | None:
    """The layout of a private key that ``data`` holds from first to last byte."""
    if data.startswith(OPENSSH_MAGIC):
        return "openssh" if _openssh_fields(data[len(OPENSSH_MAGIC) :]) else None
    outer = der_items(data) if data[:1] == bytes([SEQUENCE]) else None
    if outer is None or len(outer) != 1:
        return None
    fields = der_items(outer[0][1])
    if fields and [tag for tag, _ in fields] == [SEQUENCE, OCTETS]:
        algorithm = der_items(fields[0][1])
        by_password = bool(algorithm) and algorithm[0][0] == OBJECT_ID
        by_password = by_password and algorithm[0][1].startswith(PBE_OIDS)
        return "pkcs8-encrypted" if by_password and len(fields[1][1]) % 8 == 0 else None
    if not fields or fields[0][0] != INTEGER or len(fields[0][1]) != 1:
        return None
    tags, version = [tag for tag, _ in fields], fields[0][1][0]
    if version == 0 and len(tags) == 9 and set(tags) == {INTEGER}:
        return "pkcs1" if len(fields[1][1]) >= 64 else None
    if version == 0 and len(tags) == 6 and set(tags) == {INTEGER}:
        return "dsa" if len(fields[1][1]) >= 64 else None
    if version == 1 and tags[1:2] == [OCTETS] and 16 <= len(fields[1][1]) <= 66:
        rest = [der_items(content) for _, content in fields[2:]]
        return "sec1" if all(r is not None for r in rest) else None
    if version in (0, 1) and tags[1:3] == [SEQUENCE, OCTETS]:
        algorithm = der_items(fields[1][1])
        named = bool(algorithm) and algorithm[0][0] == OBJECT_ID and len(algorithm[0][1]) >= 3
        return "pkcs8" if named and der_items(fields[2][1]) else None
    return None


def _openssh_fields(rest: bytes) -> bool:
    """Whether cipher, KDF, options, key count and keys follow with fitting lengths."""
    at = 0

    def field() -> bytes | None:
        nonlocal at
        if at + 4 > len(rest):
            return None
        size = int.from_bytes(rest[at : at + 4], "big")
        at += 4 + size
        return rest[at - size : at] if at <= len(rest) else None

    if any(field() is None for _ in range(3)):
        return False
    count, at = int.from_bytes(rest[at : at + 4], "big"), at + 4
    return 1 <= count <= 16 and all(field() is not None for _ in range(count + 1))


def signed_token(run: str) -> str | None:
    """The algorithm of a signed token whose three parts decode and fit together."""
    parts = [_decoded(part) for part in run.split(".")]
    if len(parts) != 3 or None in parts:
        return None
    try:
        header, body = json.loads(parts[0]), json.loads(parts[1])
    except (ValueError, RecursionError):
        return None
    if not isinstance(header, dict) or not isinstance(body, dict):
        return None
    name = header.get("alg")
    if not isinstance(name, str):
        return None
    size = len(parts[2])
    if name.upper() in SIGNATURE_BYTES:
        return name if size == SIGNATURE_BYTES[name.upper()] else None
    if name[:2] in ("RS", "PS"):
        return name if size >= 128 else None
    return name if name.lower() == "none" and size == 0 else None


def _base_spans(text: str) -> Iterator[tuple[str, int, int, str]]:
    if "=" in text or ":" in text:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_LEAST:
                yield "assign", m.start(), m.end(), m[1].lower()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_LEAST:
                yield "access", m.start(), m.end(), ""
    for m in HEX.finditer(text):
        if m.end() - m.start() >= HEX_LEAST:
            yield "hex", m.start(), m.end(), ""


def _tokens(run: str) -> Iterator[tuple[int, int, str]]:
    """Signed tokens among the dotted parts of a run: three parts on end, each tried once."""
    parts, at = run.split("."), 0
    starts = []
    for part in parts:
        starts.append(at)
        at += len(part) + 1
    i = 0
    while i + 2 < len(parts):
        begin = parts[i].find("eyJ")
        found = None
        if begin >= 0 and parts[i + 1]:
            found = signed_token(".".join((parts[i][begin:], parts[i + 1], parts[i + 2])))
        if found:
            yield starts[i] + begin, starts[i + 2] + len(parts[i + 2]), found
        i += 3 if found else 1


def pem_key(body: str) -> str | None:
    """The layout of the key between the lines of a PEM block."""
    body = body.replace("\\r", "").replace("\\n", "\n")
    header = PEM_HEADER.match(body)
    data = _decoded("".join(body[header.end() if header else 0 :].split()))
    if not data:
        return None
    if header and "ENCRYPTED" in header[1]:
        # What is encrypted has no structure but whole blocks; its cipher must be named.
        cipher = CIPHER.search(header[1])
        return "encrypted" if cipher and len(data) % (len(cipher[1]) // 2) == 0 else None
    return private_key(data)


def _whole_length(start: str) -> int | None:
    """How many bytes a key has whose base64 begins so, by its outermost DER length."""
    data = _decoded(start)
    if not data or len(data) < 6 or data[0] != SEQUENCE:
        return None
    if data[1] < 0x80:
        return 2 + data[1]
    count = data[1] & 0x7F
    return 2 + count + int.from_bytes(data[2 : 2 + count], "big") if 1 <= count <= 4 else None


def _base64_key(run: str) -> tuple[int, str] | None:
    """Where in the run a key begins that fills the rest of it, and its layout."""
    begins = [0] + [m.end() for m in re.finditer("/(?=M)", run)]
    bare = len(run.rstrip("="))
    for begin in begins:
        # A path before the key may look like base64: the outer length must fit the rest.
        if begin and _whole_length(run[begin : begin + 8]) != (bare - begin) * 3 // 4:
            continue
        data = _decoded(run[begin:])
        if data is None:
            continue
        if data.startswith(b"-----BEGIN"):
            block = PEM.fullmatch(data.decode("latin-1").strip())
            if block and (found := pem_key(block[2])):
                return begin, f"pem-{found}"
        elif found := private_key(data):
            return begin, found
    return None


def _hex_key(run: str) -> tuple[int, int, str] | None:
    """A key from either nibble of the run to its end, or to one before."""
    for begin in (0, 1):
        end = len(run) - (len(run) - begin) % 2
        if found := private_key(bytes.fromhex(run[begin:end])):
            return begin, end, found
    return None


def _confirmed_spans(text: str) -> Iterator[tuple[str, int, int, str]]:
    inside: list[tuple[int, int]] = []
    if "eyJ" in text:
        for run in DOTTED.finditer(text):
            if "eyJ" in run[0]:
                for start, end, found in _tokens(run[0]):
                    inside.append((run.start() + start, run.start() + end))
                    yield "token", *inside[-1], found
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            if found := pem_key(m[2]):
                inside.append(m.span())
                yield "pem", *m.span(), found
    inside.sort()
    wrapped = [*_wrapped_keys(text, inside)] if "\n" in text else []
    for begin, end, found in wrapped:
        yield "key_base64", begin, end, found
    inside = sorted(inside + [(begin, end) for begin, end, _ in wrapped])
    for m in BASE64.finditer(text):
        if not _within(m, inside) and (key := _base64_key(m[0])):
            yield "key_base64", m.start() + key[0], m.end(), key[1]
    for m in ANY_HEX.finditer(text):
        if key := _hex_key(m[0]):
            yield "key_hex", m.start() + key[0], m.start() + key[1], key[2]


def _wrapped_keys(text: str, inside: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """Keys over several lines; the last line may be other text."""
    for m in WRAPPED.finditer(text):
        if _within(m, inside):
            continue
        for end in (m.end(), m.start() + len(m[0].rpartition("\n")[0].rstrip())):
            data = _decoded("".join(text[m.start() : end].split()))
            if data is not None and (found := private_key(data)):
                yield m.start(), end, found
                break


def _within(m: re.Match, spans: list[tuple[int, int]]) -> bool:
    """Whether the match lies in one of the spans, which are sorted and don't overlap."""
    at = bisect_right(spans, (m.start(), len(m.string))) - 1
    return at >= 0 and m.end() <= spans[at][1]


def find_spans(text: str | None) -> list[tuple[str, int, int, str]]:
    """All spans (kind, start, end, detail) in code points, by start and then kind."""
    if not text:
        return []
    spans = [*_base_spans(text), *_confirmed_spans(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end, detail) of every row; one pass, no shuffle."""
    scan = F.udf(find_spans, SPANS, useArrow=True)
    return docs.select("doc_id", scan("text").alias("spans"))


def span_digest(scanned: DataFrame) -> DataFrame:
    """Counts per plain kind, and the spans as text ``kind:start:end`` with commas."""

    def joined(spans):
        return F.array_join(
            F.transform(
                spans,
                lambda s: F.concat_ws(
                    ":", s["kind"], s["start"].cast("string"), s["end"].cast("string")
                ),
            ),
            ",",
        )

    def of(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return scanned.select(
        "doc_id",
        *[of(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
