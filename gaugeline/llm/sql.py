"""DuckDB SQL for the rows of those queries that SQL can express."""

DECONTAMINATION = r"""
WITH folded AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
sized AS (SELECT item_id, words, least(len(words), 13) AS size FROM items WHERE len(words) > 0),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(words[i : i + size - 1], ' ') AS win
  FROM (SELECT item_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM sized)),
places AS (
  SELECT row_no, size, i, array_to_string(words[i : i + size - 1], ' ') AS win FROM (
    SELECT row_no, words, size, unnest(range(1, len(words) - size + 2)) AS i
    FROM folded, (SELECT DISTINCT size FROM windows) WHERE len(words) >= size)),
hits AS (SELECT row_no, i, size, item_id FROM places JOIN windows USING (size, win)),
covered AS (
  SELECT row_no, count(DISTINCT p) AS n_hit FROM (
    SELECT row_no, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT row_no, i, size FROM hits)) GROUP BY 1),
named AS (
  SELECT row_no, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT row_no, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM folded LEFT JOIN covered USING (row_no) LEFT JOIN named USING (row_no)
"""

LINES = r"""
WITH numbered AS (SELECT row_number() OVER () AS row_no, doc_id, source, text FROM documents),
parts AS (SELECT row_no, source, text AS page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM numbered),
trimmed AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare FROM parts),
frequent AS (
  SELECT c.source, c.bare FROM (SELECT source, bare, count(DISTINCT page) AS holding FROM trimmed WHERE bare <> '' GROUP BY 1, 2) c
  JOIN (SELECT source, count(DISTINCT text) + max(CASE WHEN text IS NULL THEN 1 ELSE 0 END) AS pages FROM numbered GROUP BY 1) t ON c.source IS NOT DISTINCT FROM t.source
  WHERE holding >= 3 AND holding > pages * 0.1),
marked AS (
  SELECT row_no, n, line, f.bare IS NOT NULL AS boilerplate
  FROM trimmed t LEFT JOIN frequent f ON t.source IS NOT DISTINCT FROM f.source AND t.bare = f.bare),
kept AS (
  SELECT row_no, count(*) AS n_lines, count(*) FILTER (WHERE boilerplate) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT boilerplate), '') AS text FROM marked GROUP BY 1)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, kept.text AS text
FROM numbered LEFT JOIN kept USING (row_no)
"""

CHAT = r"""
WITH rows_of AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) t(i)),
counted AS (
  SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS turns,
    sum(22 + length(role) + length(text)
      + 2 * length(role) - length(replace(role, '\', '')) - length(translate(role, '<>', ''))
      + 2 * length(text) - length(replace(text, '\', '')) - length(translate(text, '<>', ''))) OVER w AS chars
  FROM rows_of WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
said AS (
  SELECT conv_id, string_agg(role || chr(10) || text || chr(10), '' ORDER BY n) AS spoken,
    coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '') AS loss, count(*) AS n_turns,
    CAST(sum(chars) FILTER (WHERE role = 'assistant' OR n = turns) AS BIGINT) AS formatted_chars
  FROM counted GROUP BY 1)
SELECT conv_id, n_turns, sha256(spoken) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM said
"""

_ASSIGNED = """
apart{n} AS (
  SELECT row_no, c.cluster, sum((p.v - c.v) * (p.v - c.v)) AS distance FROM parts p JOIN centroids{n} c USING (d) GROUP BY 1, 2),
near{n} AS (
  SELECT row_no, cluster, distance FROM apart{n} QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY distance, cluster) = 1)"""

_MOVED = """,
centroids{m} AS (
  SELECT c.cluster, c.d, coalesce(s.v, c.v) AS v FROM centroids{n} c LEFT JOIN (
    SELECT cluster, d, CAST(floor(CAST(sum(v) AS DOUBLE) / count(*)) AS BIGINT) AS v FROM parts JOIN near{n} USING (row_no) GROUP BY 1, 2) s USING (cluster, d)),"""

CENTROIDS = r"""
WITH kept AS (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
parts AS (SELECT row_no, unnest(v) AS v, generate_subscripts(v, 1) AS d FROM kept),
seeds AS (SELECT row_no, row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS cluster FROM kept QUALIFY cluster < 16),
centroids0 AS (SELECT cluster, d, v FROM seeds JOIN parts USING (row_no)),""" + "".join(
    _ASSIGNED.format(n=n) + _MOVED.format(n=n, m=n + 1) for n in range(3)) + _ASSIGNED.format(n=3) + r""",
finals AS (SELECT cluster, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM centroids3 GROUP BY 1)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
  CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM kept JOIN near3 USING (row_no) JOIN finals USING (cluster)
"""

# CRC-32 is linear: that of a text is the exclusive-or of one table entry for each byte, by value and distance from the end, and
# of the CRC-32 of as many zero bytes.
SPELLING = r"""
WITH RECURSIVE runs AS (
  SELECT CAST(coalesce(doc_id::VARCHAR, '') AS VARCHAR) || ':' || run AS name, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{6,}')) AS run
    FROM documents) GROUP BY ALL),
bytes AS (
  SELECT name, CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END AS b, n
  FROM (SELECT DISTINCT name, unnest(string_split(name, '')) AS c, generate_subscripts(string_split(name, ''), 1) AS n FROM runs)),
placed AS (
  SELECT name, b, row_number() OVER (PARTITION BY name ORDER BY n DESC, i DESC) - 1 AS k
  FROM (SELECT name, n, unnest(b) AS b, generate_subscripts(b, 1) AS i FROM bytes)),
entry AS (
  SELECT CAST(b AS BIGINT) AS b, list_reduce([CAST(b AS BIGINT)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS e FROM range(256) t(b)),
longest AS (SELECT max(k) AS k FROM placed),
entries AS (
  SELECT 0 AS k, b, e FROM entry
  UNION ALL SELECT t.k + 1, t.b, xor(t.e >> 8, o.e) FROM entries t JOIN entry o ON o.b = t.e & 255 WHERE t.k < (SELECT k FROM longest)),
zeros AS (
  SELECT 0 AS n, CAST(4294967295 AS BIGINT) AS c
  UNION ALL SELECT z.n + 1, xor(z.c >> 8, o.e) FROM zeros z JOIN entry o ON o.b = z.c & 255 WHERE z.n <= (SELECT k FROM longest)),
hashed AS (
  SELECT name, xor(xor(x, c), 4294967295) AS h FROM (SELECT name, count(*) AS n, bit_xor(e) AS x FROM placed JOIN entries USING (k, b) GROUP BY 1) JOIN zeros USING (n)),
words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT times, CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word
    FROM runs JOIN hashed USING (name)) WHERE length(word) >= 6 GROUP BY 1 HAVING sum(times) >= 5),
gaps AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cut AS (SELECT DISTINCT word, n, left(word, i - 1) || substr(word, i + 1) AS rest FROM gaps),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.i = b.i AND left(a.word, a.i - 1) || '*' || substr(a.word, a.i + 1) = left(b.word, b.i - 1) || '*' || substr(b.word, b.i + 1) AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
best AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near FROM pairs QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
steps AS (
  SELECT word, word AS at, form AS onward FROM formed
  UNION ALL SELECT s.word, f.word, f.form FROM steps s JOIN formed f ON f.word = s.onward)
SELECT f.word, form, s.at AS root, n, n_near, form_n FROM formed f JOIN steps s ON s.word = f.word AND s.onward IS NULL
"""

ARCHIVES = r"""
WITH bodies AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
named AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS largest FROM bodies),
told AS (SELECT *, largest IS NOT NULL AND page_id IS DISTINCT FROM largest AS again FROM named)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN largest END AS refers_to FROM told
"""
