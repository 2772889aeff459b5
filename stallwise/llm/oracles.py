"""DuckDB SQL with the same results, for the queries whose whole result SQL can express."""

from __future__ import annotations

WARC = """WITH found AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
digested AS (SELECT *, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first FROM found)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM digested"""

# CRC-32 byte by byte from its table; near words by equal texts without one letter.
VARIANTS = """WITH RECURSIVE crc AS (SELECT [list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR i IN range(256)] AS step),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
lowered AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM runs WHERE length(run) >= 7),
kinds AS (SELECT id, run, count(*) AS times, hex(id || ':' || run) AS hex FROM lowered GROUP BY ALL),
hashed AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295,
    [CAST('0x' || substr(hex, 1 + 2 * k, 2) AS BIGINT) FOR k IN range(length(hex) // 2)]),
    lambda h, b: xor(step[1 + (xor(h, b) & 255)], h >> 8)), 4294967295) AS h FROM kinds, crc),
damaged AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
parts AS (SELECT word, n, place, substr(word, 1, place - 1) || substr(word, place + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS place FROM words)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM parts a JOIN parts b ON a.rest = b.rest AND a.place = b.place AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM parts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM parts a JOIN words b ON a.rest = b.word),
best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near FROM near
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form,
  CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
chains AS (SELECT word, form AS root FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form FROM chains c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chains c JOIN formed f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM formed f LEFT JOIN ends e ON f.word = e.word"""

ORACLES = {"op10_warc": WARC, "op12_variants": VARIANTS}
