"""SQL counterparts of the operators that SQL can express."""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LETTERS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_WORDS = r"'[^\x20\x09-\x0D]+'"

OP1 = f"""
WITH dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), {_LETTERS}), []) AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), {_LETTERS}) AS w FROM benchmark),
bwin AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
    SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
    FROM bw WHERE len(w) > 0)),
dwin AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
    FROM dw, (SELECT DISTINCT n FROM bwin) s WHERE len(w) >= n)),
hit AS (SELECT doc_id, n, i, item_id FROM dwin JOIN bwin USING (n, g)),
cov AS (
  SELECT doc_id, count(DISTINCT p) AS c FROM (
    SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS k, string_agg(item, ',' ORDER BY item) AS s FROM (
    SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, coalesce(c, 0) AS n_hit, coalesce(k, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(c, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP2 = """
WITH v AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP6 = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    '{_UP}', '{_LOW}') AS key FROM l),
f AS (
  SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (
  SELECT k.doc_id, k.i, k.line, f.key IS NOT NULL AND f.last_doc <> k.doc_id AS gone
  FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP10 = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, {_WORDS}), []) AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
low AS (SELECT g, min(doc_id) AS first_doc FROM win GROUP BY g),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN low USING (g) WHERE doc_id > first_doc),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (
  SELECT word.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY word.p) AS t
  FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

# bits: crc32 of the id, bit by bit; same: equal words at most a quarter of the text apart.
OP13 = r"""
WITH RECURSIVE bits AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 0 AS k, CAST(4294967295 AS UBIGINT) AS c FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, s, k + 1, CASE WHEN k % 9 = 0 THEN xor(c, CAST(ord(s[k // 9 + 1]) AS UBIGINT))
    WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS UBIGINT)) ELSE c // 2 END
  FROM bits WHERE k < 9 * length(s)),
h AS (SELECT doc_id, CAST(xor(c, CAST(4294967295 AS UBIGINT)) AS BIGINT) AS h FROM bits WHERE k = 9 * length(s)),
d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (
  SELECT d.doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted,
    CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a, 3 + (h // 10) % 8 AS part FROM d LEFT JOIN h USING (doc_id)),
v AS (
  SELECT doc_id, n, CASE WHEN planted
    THEN [CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // part) + 1] END FOR i IN range(n)]
    ELSE w END AS w FROM g),
word AS (SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM v),
same AS (
  SELECT x.doc_id, y.i - x.i AS q, y.i FROM word x JOIN word y
    ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretch AS (
  SELECT doc_id, q, min(i) - q AS s, max(i) + 1 AS e FROM (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same)
  GROUP BY doc_id, q, island),
run AS (
  SELECT doc_id, s AS start, e - s AS length, min(q) AS period FROM stretch
  WHERE e - s >= greatest(6, 4 * q) GROUP BY doc_id, s, e),
best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DECIMAL(38, 0)) * 1000000000000 // period DESC, start, period) AS k
  FROM run),
listed AS (
  SELECT doc_id, count(*) AS k, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t
  FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT v.doc_id, coalesce(listed.k, 0) AS n_runs, start, length, period, length * 1000 // period AS exponent_milli,
  sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM v LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
LEFT JOIN (SELECT * FROM best WHERE best.k = 1) b USING (doc_id)
"""

ORACLES = {"op1_decontaminate": OP1, "op2_topk": OP2, "op6_line_dedup": OP6, "op10_repeats": OP10,
           "op13_periodic_runs": OP13}
