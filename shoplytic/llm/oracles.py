"""DuckDB SQL for the queries that SQL can express, from their definitions."""

from __future__ import annotations

# CRC-32 of a text: its bytes, each followed by eight marks (-1) for one shift.
_CRC32 = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
        range(1, 2 * strlen(body) + 1, 2),
        lambda i: [CAST('0x' || substr(letters, i, 2) AS BIGINT),
                   -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x)
                          ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""

HISTOGRAM_SORT = f"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS body,
           CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size,
           hex(encode(coalesce(text, ''))) AS letters
    FROM documents
), k AS (
    SELECT *, CAST('0x' || substr(md5(body), 1, 15) AS BIGINT) AS a,
           coalesce(doc_id, -9223372036854775808) AS b
    FROM d
), g AS (
    SELECT a, b, sum(size) AS bytes FROM k GROUP BY ALL
), c AS (
    SELECT a, b, coalesce(sum(bytes) OVER (ORDER BY a, b
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
           sum(bytes) OVER () AS total
    FROM g
), s AS (
    SELECT k.doc_id, k.size, k.body, k.letters, k.a, k.b,
           CAST(least(39, (c.before * 40) // c.total) AS INTEGER) AS shard
    FROM k JOIN c USING (a, b)
)
SELECT doc_id, size, {_CRC32} AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY a, b) - 1 AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""

EXACT_DEDUP = """
WITH d AS (
    SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       text_sha256
FROM d
"""

LINE_SPREAD = """
WITH l AS (
    SELECT doc_id, source, text, list_filter(string_split(text, chr(10)),
               lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
    FROM documents
), spread AS (
    SELECT line, count(DISTINCT coalesce(source, chr(0) || 'none')) AS sites
    FROM (SELECT source, unnest(lines) AS line FROM l) GROUP BY line
), boiler AS (
    SELECT coalesce(list(line), []) AS lines FROM spread WHERE sites >= 10
), cut AS (
    SELECT doc_id, string_split(text, chr(10)) AS all_lines,
           list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(b.lines, x)) AS kept
    FROM documents, boiler b
)
SELECT doc_id, CAST(coalesce(len(all_lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(all_lines) - len(kept), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256
FROM cut
"""


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_transform({_WORDS}, lambda x: translate(
               x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws
    FROM documents
), s AS (
    SELECT doc_id, list_distinct(list_transform(
               range(1, CASE WHEN len(ws) = 0 THEN 1 ELSE greatest(len(ws) - 4, 1) + 1 END),
               lambda i: array_to_string(ws[i:i + 4], ' '))) AS shingles
    FROM w
), e AS (
    SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y
    FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * COUNT(*) >= 75 * (a.n + b.n - COUNT(*))
), links AS (
    SELECT x, y FROM pairs UNION SELECT y, x FROM pairs
), reach AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other
), least AS (
    SELECT doc_id, MIN(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id,
       s.doc_id = component_id AS kept
FROM s JOIN least ON least.doc_id = s.doc_id
"""

REPEATED_PASSAGES = f"""
WITH w AS (
    SELECT doc_id, {_WORDS} AS ws FROM documents
), p AS (
    SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS passage
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)
), f AS (
    SELECT passage, MIN(doc_id) AS first_id FROM p GROUP BY passage
), r AS (
    SELECT p.doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS gone
    FROM p JOIN f ON f.passage = p.passage WHERE first_id < p.doc_id GROUP BY p.doc_id
), k AS (
    SELECT w.doc_id, ws, coalesce(len(gone), 0) AS n_removed,
           CASE WHEN gone IS NULL THEN ws
                ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END AS kept
    FROM w LEFT JOIN r ON r.doc_id = w.doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM k
"""

def _merkle_field(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({text}) || ':' || {text} END"


def _merkle_leaf(text: str) -> str:
    fields = [_merkle_field(f) for f in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(fields)})"


MERKLE = f"""
WITH RECURSIVE c AS (
    SELECT *, CAST(doc_id AS VARCHAR) AS body, hex(encode(CAST(doc_id AS VARCHAR))) AS letters
    FROM documents
), t AS (
    SELECT *, CASE WHEN {_CRC32} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed
    FROM c
), h AS (
    SELECT doc_id, source, {_merkle_leaf("text")} AS leaf, {_merkle_leaf("changed")} AS other
    FROM t
), l AS (
    SELECT doc_id, leaf, other, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
           count(*) OVER (PARTITION BY source) AS n
    FROM h
), nodes AS (
    SELECT tree, CAST(0 AS BIGINT) AS lv, place AS i, n, leaf AS digest FROM l
    UNION ALL
    SELECT tree, lv + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i))
    FROM nodes WHERE n > 1 GROUP BY tree, lv, i // 3, n
), subroots AS (
    SELECT tree, digest FROM nodes WHERE n = 1
), tops AS (
    SELECT CAST(0 AS BIGINT) AS lv, tree AS i, (SELECT count(*) FROM subroots) AS n, digest
    FROM subroots
    UNION ALL
    SELECT lv + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i))
    FROM tops WHERE n > 1 GROUP BY lv, i // 3, n
), run AS (
    SELECT l.tree, l.place, nodes.lv AS step, nodes.i, nodes.digest,
           l.place // CAST(power(3, nodes.lv) AS BIGINT) AS own
    FROM l JOIN nodes ON nodes.tree = l.tree AND nodes.n > 1
         AND nodes.i // 3 = l.place // CAST(power(3, nodes.lv + 1) AS BIGINT)
    UNION ALL
    SELECT l.tree, l.place, 1000 + tops.lv, tops.i, tops.digest,
           l.tree // CAST(power(3, tops.lv) AS BIGINT)
    FROM l JOIN tops ON tops.n > 1
         AND tops.i // 3 = l.tree // CAST(power(3, tops.lv + 1) AS BIGINT)
), steps AS (
    SELECT tree, place, row_number() OVER (PARTITION BY tree, place ORDER BY step) AS k,
           coalesce(string_agg(digest, '' ORDER BY i) FILTER (i < own), '') AS lefts,
           coalesce(string_agg(digest, '' ORDER BY i) FILTER (i > own), '') AS rights
    FROM run GROUP BY tree, place, step
), proof AS (
    SELECT tree, place, count(*) AS k, sha256(string_agg(lefts || rights, '' ORDER BY k)) AS proof
    FROM steps GROUP BY tree, place
), fold AS (
    SELECT tree, place, CAST(0 AS BIGINT) AS k, other AS value FROM l
    UNION ALL
    SELECT f.tree, f.place, s.k, sha256(s.lefts || f.value || s.rights)
    FROM fold f JOIN steps s ON s.tree = f.tree AND s.place = f.place AND s.k = f.k + 1
)
SELECT l.doc_id, l.leaf, subroots.digest AS subroot, root.digest AS root,
       coalesce(proof.proof, sha256('')) AS proof_sha256, fold.value AS folded_root,
       fold.value = root.digest AS verified
FROM l JOIN subroots ON subroots.tree = l.tree
     JOIN (SELECT digest FROM tops WHERE n = 1) root ON true
     LEFT JOIN proof ON proof.tree = l.tree AND proof.place = l.place
     JOIN fold ON fold.tree = l.tree AND fold.place = l.place AND fold.k = coalesce(proof.k, 0)
"""


WARC_PAGES = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS body, CAST(strlen(coalesce(html, '')) AS BIGINT) AS size
    FROM pages
), g AS (
    SELECT *, max(page_id) OVER (PARTITION BY body) AS largest FROM p
)
SELECT page_id, size AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN size >= 1000 AND page_id IS DISTINCT FROM largest THEN 'revisit'
            ELSE 'response' END AS record_type,
       CASE WHEN size >= 1000 AND page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM g
"""


def llm_oracle_sql() -> dict[str, str]:
    return {
        "op4_histogram_sort": HISTOGRAM_SORT,
        "op5_digest_index": EXACT_DEDUP,
        "op6_line_spread": LINE_SPREAD,
        "op7_circulant_minhash": NEAR_DUPLICATES,
        "op8_cover_anchors": REPEATED_PASSAGES,
        "op11_bitmap_manifest": MERKLE,
        "op12_boundary_chain": WARC_PAGES,
    }
