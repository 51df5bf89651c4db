"""DuckDB twins of the operators whose results SQL can say exactly: they look at every window of whole texts."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(pattern: str, text: str = "coalesce(text, '')") -> str:
    return f"regexp_extract_all({text}, '{pattern}')"


_ITEM_WORDS = _words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")
_SPACED = _words(r"[^\x20\x09-\x0D]+")

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT row_number() OVER () AS j, CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark),
bw AS (SELECT j, item, least(13, len(w)) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS s, len(w) AS total FROM b),
v AS (SELECT DISTINCT item, n, win FROM (SELECT item, n, s, total, string_agg(word, ' ') OVER
      (PARTITION BY j ORDER BY s ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING) AS win FROM bw) WHERE s + n - 1 <= total),
u AS (SELECT r, len(w) AS total, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS s FROM d),
o AS (SELECT * FROM (SELECT r, s, n, total, string_agg(word, ' ') OVER
      (PARTITION BY r, n ORDER BY s ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING) AS win FROM u CROSS JOIN (SELECT DISTINCT n FROM v)) WHERE s + n - 1 <= total),
h AS (SELECT r, s, n, item FROM o JOIN v USING (n, win)),
c AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + n)) AS k FROM (SELECT DISTINCT r, s, n FROM h)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""

SUBSTRINGS = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, {_SPACED} AS w FROM documents),
u AS (SELECT r, len(w) AS total, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
p AS (SELECT * FROM (SELECT r, k, total, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY k ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS win FROM u)
      WHERE k + 19 <= total),
o AS (SELECT r, k, row_number() OVER (PARTITION BY win ORDER BY r, k) AS nth FROM p),
c AS (SELECT DISTINCT r, unnest(range(k, k + 20)) AS k FROM o WHERE nth > 1),
k AS (SELECT r, word, k FROM u ANTI JOIN c USING (r, k)),
t AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS kept FROM k GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (r)
"""

_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(CAST({0} AS VARCHAR)) + 1),
      lambda i: CAST(ascii(substr(CAST({0} AS VARCHAR), i, 1)) AS BIGINT))), lambda c, x:
      list_reduce(list_prepend(xor(c, x), range(8)), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295)"""

TRIE = f"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS txt, turn, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS tid
      FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tid) AS pos FROM o),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC.format("conv_id")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM p)),
r AS (SELECT c.conv_id, p.pos, tid, length(txt) AS chars FROM c JOIN p ON p.conv_id = c.base AND p.pos <= c.h
      UNION ALL SELECT c.conv_id, p.pos + 1000000000, tid, length(txt) FROM c JOIN p ON p.conv_id = c.conv_id AND p.pos > c.h),
s AS (SELECT conv_id, chars, row_number() OVER w AS depth, md5(string_agg(tid, ',') OVER w) AS k FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
m AS (SELECT conv_id, 0 AS depth, '' AS k, 0 AS chars FROM c UNION ALL SELECT conv_id, depth, k, chars FROM s),
l AS (SELECT conv_id, max(depth) AS n FROM m GROUP BY conv_id),
n AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
      string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth) AS ends FROM m JOIN l USING (conv_id) GROUP BY depth, k),
a AS (SELECT n.*, u.conv_id AS parent_conv_id FROM n LEFT JOIN m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1 LEFT JOIN n AS u ON u.depth = m.depth AND u.k = m.k),
f AS (SELECT a.*, (SELECT count(*) FROM a AS b WHERE b.parent_conv_id = a.conv_id AND b.depth = a.depth + 1) AS n_children FROM a),
t AS (SELECT m.depth, m.k, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.chars) AS saved
      FROM f JOIN m ON m.conv_id = f.conv_id AND m.depth <= f.depth GROUP BY m.depth, m.k)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM f JOIN t USING (depth, k)
"""

def _spaced(text: str) -> str:
    return _words(r"[^\x20\x09-\x0D]+", text)


_SHINGLES = """CASE WHEN len({0}) = 0 THEN CAST([] AS VARCHAR[]) ELSE
  list_transform(range(1, greatest(len({0}) - 4, 1) + 1), lambda i: substr(md5(array_to_string({0}[i:i + 4], ' ')), 1, 16)) END"""
_SKETCH = f"list_sort(list_distinct({_SHINGLES}))[1:128]"


def _alike(a: str, b: str) -> str:
    union = f"list_sort(list_distinct(list_concat({a}, {b})))[1:128]"
    return f"CASE WHEN len({union}) = 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(len(list_intersect(list_intersect({a}, {b}), {union})) AS DOUBLE) / len({union}) END"


FINGERPRINTS = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS r, doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT r, doc_id, t, length(t) AS n, length(t) // 2 AS half, coalesce(lead(t) OVER (ORDER BY r), first_value(t) OVER (ORDER BY r)) AS nt FROM d),
e AS (SELECT *, concat(substr(t, 1, n - half), substr(nt, 1, half)) AS et FROM n),
w AS (SELECT *, {_spaced("t")} AS tw, {_spaced("nt")} AS nw, {_spaced("et")} AS ew FROM e),
k AS (SELECT doc_id, n, et, {_SKETCH.format("tw")} AS a, {_SKETCH.format("nw")} AS b, {_SKETCH.format("ew")} AS c FROM w)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(et) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(c, '') AS edited_fingerprint,
       {_alike("a", "c")} AS near_edited, {_alike("a", "b")} AS near_next,
       CASE WHEN len(a) < 128 THEN CAST(len(a) AS DOUBLE) ELSE 127 * CAST(281474976710656 AS DOUBLE) / (CAST(CAST('0x' || substr(a[128], 1, 12) AS BIGINT) AS DOUBLE) + 1.0) END AS shingles
FROM k
"""
