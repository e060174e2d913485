"""SQL that gives the rows of those numbered queries that SQL can express."""

from __future__ import annotations


def _crc32(ids: str, key: str) -> str:
    """Common table expressions ``crc`` (id, v): CRC-32 of decimal ids, bit by bit."""
    return f"""ids AS (SELECT DISTINCT {key} AS id, CAST({key} AS VARCHAR) AS s FROM {ids} WHERE {key} IS NOT NULL),
    steps (id, s, k, v) AS (
        SELECT id, s, 0, 4294967295::BIGINT FROM ids
        UNION ALL
        SELECT id, s, k + 1, CASE WHEN k % 9 = 0 THEN xor(v, ascii(substr(s, k // 9 + 1, 1))::BIGINT) WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END
        FROM steps WHERE k < 9 * length(s)),
    crc AS (SELECT id, xor(v, 4294967295::BIGINT) AS v FROM steps WHERE k = 9 * length(s))"""


TRIE = f"""WITH RECURSIVE {_crc32("conversations", "conv_id")},
    own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations),
    rebuilt AS (
        SELECT id AS c, i, r, t FROM crc JOIN own ON own.c = id - id % 100 AND i <= v % 6
        UNION ALL
        SELECT id, i, r, t FROM crc JOIN own ON own.c = id AND i > v % 6),
    keyed AS (
        SELECT c, row_number() OVER w AS d, string_agg(md5(r) || md5(t), '') OVER w AS k, length(t) AS n FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY i)),
    paths AS (SELECT c, d, md5(k) AS k, n FROM keyed UNION ALL SELECT id, 0, '', 0 FROM crc),
    linked AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, max(d) OVER (PARTITION BY c) = d AS ends FROM paths),
    nodes AS (
        SELECT d, k, min(up) AS up, min(c) AS c, count(*) AS members, min(n) AS n,
            sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS sha FROM linked GROUP BY d, k),
    kids AS (SELECT d - 1 AS d, up AS k, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY ALL),
    below AS (SELECT DISTINCT a.d, a.k, b.d AS e, b.k AS l FROM paths a JOIN paths b ON a.c = b.c AND b.d >= a.d),
    sums AS (
        SELECT below.d, below.k, count(*) FILTER (WHERE kids IS NULL) AS leaves, sum((members - 1) * n) AS saved
        FROM below JOIN nodes ON nodes.d = e AND nodes.k = l LEFT JOIN kids ON kids.d = e AND kids.k = l GROUP BY ALL)
    SELECT x.c AS conv_id, x.d AS depth, p.c AS parent_conv_id, x.members AS n_convs, coalesce(kids, 0) AS n_children,
        CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, x.sha AS ends_sha256
    FROM nodes x JOIN sums ON sums.d = x.d AND sums.k = x.k LEFT JOIN kids ON kids.d = x.d AND kids.k = x.k
        LEFT JOIN nodes p ON p.d = x.d - 1 AND p.k = x.up"""

#: A stretch in which words q apart agree, and the words it agrees with, is a run of period q unless a shorter period fits it too.
PERIODIC = f"""WITH RECURSIVE {_crc32("documents", "doc_id")},
    split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    sized AS (SELECT doc_id, ws, len(ws)::BIGINT AS n, v // 10 AS g, v % 10 = 0 AND len(ws) > 0 AS planted FROM split JOIN crc ON id = doc_id),
    placed AS (SELECT *, CASE WHEN planted THEN g % n ELSE n END AS a FROM sized),
    periods AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed),
    words AS (
        SELECT doc_id, i, ws[1 + (CASE WHEN i >= a THEN a + (i - a) % p ELSE i END)] AS w, n
        FROM (SELECT *, unnest(range(n)) AS i FROM periods)),
    equal AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
    islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal),
    fits AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
    runs AS (SELECT doc_id, s, l, min(q) AS q FROM fits GROUP BY doc_id, s, l),
    best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l::DOUBLE / q DESC, s, q) = 1),
    listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY doc_id),
    dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
    kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, CAST(1000 * l // q AS BIGINT) AS exponent_milli,
        sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
    FROM documents d LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""
