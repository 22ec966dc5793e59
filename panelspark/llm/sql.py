"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
k AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS win
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
r AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i
      FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS n FROM k) WHERE n > 1),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM x ANTI JOIN r USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP6 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, array_to_string(w[s:s + 2], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM d WHERE len(w) >= 3)
        UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id
      GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 90 * (x.n + y.n - i)),
ends_of AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM reach r JOIN ends_of e ON r.b = e.a),
c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON d.doc_id = c.a"""

OP6_LINKS = f"""
WITH o AS ({OP6}), {OP6[OP6.index("d AS ("):OP6.index("reach AS")].rstrip().rstrip(",")},
e AS (SELECT a, count(*) AS n FROM ends_of GROUP BY a)
SELECT o.*, CAST(coalesce(e.n, 0) AS BIGINT) AS n_links FROM o LEFT JOIN e ON o.doc_id = e.a"""

OP8 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 7], ' ') AS win
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS s FROM d WHERE len(w) >= 8)),
rep AS (SELECT doc_id, count(DISTINCT i) AS n FROM (
          SELECT doc_id, unnest(range(s, s + 8)) AS i
          FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, win) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
f AS (SELECT doc_id, source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
        - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))
          AS n_dup_lines,
        len(string_split(t, chr(10))) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
j AS (SELECT *, base_failed OR n_symbols > 0.3::DOUBLE * word_chars OR n_dup_lines > 0.5::DOUBLE * n_lines AS failed FROM b),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE failed) AS DOUBLE) AS f FROM j GROUP BY source),
m AS (SELECT count(*) AS k, sum(n) AS n, sum(f) AS f, sum(n * n) AS nn, sum(n * (f / n) * (f / n)) AS pp FROM h),
v AS (SELECT *, (f + 0.5) / (n + 1) AS mean, n - nn / n AS scale, pp - n * (f / n) * (f / n) AS spread FROM m),
u AS (SELECT *, mean * (1 - mean) AS within FROM v),
q AS (SELECT *, CASE WHEN k < 2 THEN n WHEN scale > 0 AND (spread - (k - 1) * within) / scale > within / (n + 1)
        THEN least(greatest(within / ((spread - (k - 1) * within) / scale) - 1, 0.001), n) ELSE n END AS weight FROM u),
ok AS (SELECT source, (h.f + q.mean * weight) / (h.n + weight) <= 0.5 AS host_ok FROM h, q)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND host_ok AS kept
FROM j LEFT JOIN ok ON j.source IS NOT DISTINCT FROM ok.source"""

_ALNUM = r"'[0-9a-z\x{80}-\x{10FFFF}]+'"
OP10 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
p AS (SELECT DISTINCT item, m, array_to_string(w[s:s + m - 1], ' ') AS win
      FROM (SELECT item, w, least(len(w), 13) AS m, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s
            FROM b WHERE len(w) > 0)),
x AS (SELECT doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') AS win
      FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s
            FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
h AS (SELECT doc_id, item, s, x.m AS m FROM x JOIN p ON x.win = p.win AND x.m = p.m),
n AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(s, s + m)) AS i FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(i.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n.n, 0) > 0 AND 20 * coalesce(n.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)"""

OP12 = rf"""
WITH RECURSIVE crc AS (SELECT i AS start, i AS c, 0 AS k FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT start, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM crc WHERE k < 8),
t AS (SELECT list(c ORDER BY start) AS t FROM crc WHERE k = 8),
r AS (SELECT id, run, count(*) AS n, encode(id || ':' || run) AS b FROM (
        SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run
        FROM documents) GROUP BY 1, 2),
y AS (SELECT id, run, n, list_transform(range(1, 2 * octet_length(b), 2), lambda i: CAST(('0x' || substr(hex(b), i, 2)) AS BIGINT)) AS bytes FROM r),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes),
        lambda a, x: xor(a >> 8, t[CAST(xor(a & 255, x) AS INTEGER) + 1])), 4294967295) AS h FROM y, t),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2)
        ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS short
      FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word AS word, a.n AS n, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.i = b.i AND a.short = b.short AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM d a JOIN v b ON a.short = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM d a JOIN v b ON a.short = b.word),
f AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS form, arg_min(near_n, (-near_n, near)) AS form_n, max(n) AS n FROM p GROUP BY word),
g AS (SELECT word, n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM f),
s AS (SELECT word, word AS root, 0 AS k FROM v UNION ALL SELECT s.word, g.form, k + 1 FROM s JOIN g ON s.root = g.word WHERE g.form IS NOT NULL),
e AS (SELECT word, arg_max(root, k) AS root FROM s GROUP BY word)
SELECT v.word, g.form, e.root, v.n, CAST(coalesce(g.n_near, 0) AS BIGINT) AS n_near, CAST(g.form_n AS BIGINT) AS form_n
FROM v JOIN e USING (word) LEFT JOIN g USING (word)"""

OP13 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 400)) AS win
      FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS s FROM d WHERE length(h) >= 400)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY win) AS n FROM w) WHERE n > 1),
i AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS i
      FROM (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200 THEN 0 ELSE 1 END AS new FROM r)),
g AS (SELECT doc_id, min(s) AS b, max(s) + 200 AS e FROM i GROUP BY doc_id, i),
k AS (SELECT doc_id, b, e - b AS n, substr(h, 2 * before + 1, 2 * (b - before)) || CASE WHEN last THEN substr(h, 2 * e + 1) ELSE '' END AS part
      FROM (SELECT doc_id, b, e, coalesce(lag(e) OVER o, 0) AS before, lead(e) OVER o IS NULL AS last FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY b))
      JOIN d USING (doc_id)),
a AS (SELECT doc_id, sum(n) AS n_removed, count(*) AS n_spans, string_agg(part, '' ORDER BY b) AS kept FROM k GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)"""
