"""What the registered queries return, as SQL that a single machine can run on the same tables."""

URL_FILTER = r"""
WITH parts AS (
  SELECT row_number() OVER () AS r, page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
judged AS (
  SELECT r, page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT j.*, h || p AS rule, v,
         row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC, v DESC) AS place
  FROM judged j LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fits WHERE place = 1
"""

SUBSTRING_DEDUP = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (
  SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM docs WHERE len(w) >= 35),
windows AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM starts),
repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM windows) WHERE n > 1),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM docs),
marked AS (
  SELECT words.r, words.i, word,
         max(repeated.i) OVER (PARTITION BY words.r ORDER BY words.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM words LEFT JOIN repeated ON words.r = repeated.r AND words.i = repeated.i),
kept AS (
  SELECT r, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS t
  FROM marked GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""

NEAR_DEDUP = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(a, b) AS (SELECT x, y FROM both_ways UNION SELECT a, y FROM reach JOIN both_ways ON b = x),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM docs d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON a = d.doc_id
"""

_GOOD = """len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

TOP_K = f"""
WITH scaled AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings WHERE {_GOOD}),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM scaled q JOIN scaled c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

VECTOR_DEDUP = f"""
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE {_GOOD} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x),
reach(a, b) AS (SELECT x, y FROM links UNION SELECT a, y FROM reach JOIN links ON b = x),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(m, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counts ON x = e.vec_id LEFT JOIN least ON a = e.vec_id
"""

#: CRC-32 of a text's ASCII bytes; ``crc32_table`` is a common table expression for the front of a query.
_CRC_TABLE = """
crc32_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS crc_values)
"""


def _crc32(text: str) -> str:
    """SQL for the CRC-32 of ``text`` where ``crc32_table`` is in scope."""
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda a, b: xor(a >> 8, crc_values[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)"


PREFIX_TRIE = f"""
WITH {_CRC_TABLE.strip()},
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS head, {_crc32("conv_id::VARCHAR")} % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc32_table),
parts AS (
  SELECT c.conv_id, 0 AS part, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.head AND t.place <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h),
rebuilt AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth, strlen(text) AS bytes,
         string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY part, place ROWS UNBOUNDED PRECEDING) AS so_far
  FROM parts),
paths AS (
  SELECT conv_id, depth, md5(so_far) AS node, bytes FROM rebuilt
  UNION ALL SELECT conv_id, 0, 'root', 0 FROM convs),
ends AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
nodes AS (
  SELECT p.depth, node, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
         coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE e.depth = p.depth), '') AS ended
  FROM paths p JOIN ends e ON e.conv_id = p.conv_id GROUP BY p.depth, node),
placed AS (
  SELECT n.*, u.node AS parent, o.conv_id AS parent_conv_id FROM nodes n
  LEFT JOIN paths u ON u.conv_id = n.conv_id AND u.depth = n.depth - 1
  LEFT JOIN nodes o ON o.depth = u.depth AND o.node = u.node),
children AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM placed WHERE depth > 0 GROUP BY ALL),
weighed AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM placed p LEFT JOIN children c USING (depth, node)),
above AS (
  SELECT u.depth, u.node, count(*) FILTER (WHERE w.n_children = 0) AS n_leaves, sum((w.n_convs - 1) * w.bytes) AS saved
  FROM weighed w JOIN paths u ON u.conv_id = w.conv_id AND u.depth <= w.depth GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(ended) AS ends_sha256
FROM weighed JOIN above USING (depth, node)
"""


def _more(state: str, cost: str, letters: str, lines: str = "''") -> str:
    """A state's best edits (cost, letters, lines so far) with more of each."""
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || {letters}, 't': {state}.t || {lines}}}"


def _best(*ways: str) -> str:
    return f"list_sort(list_filter([{', '.join(ways)}], lambda x: x.c IS NOT NULL))[1]"


_USER, _ASSISTANT = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
_BOTH = f"{_USER} || {_ASSISTANT}"
#: States after rows: n (nothing yet), s, u, a (initial of the last turn); with a 2: after inserts, before the next row.
_INSERTED = f"""
  n AS n2, s AS s2,
  {_best("u", _more("n", "2", "'I'", _USER), _more("s", "2", "'I'", _USER), _more("a", "2", "'I'", _USER))} AS u2,
  {_best("a", _more("u", "2", "'I'", _ASSISTANT), _more("n", "4", "'II'", _BOTH), _more("s", "4", "'II'", _BOTH))} AS a2
"""


def _kept(state: str, initial: str) -> str:
    return f"CASE WHEN initial = '{initial}' AND NOT gone THEN {_more(state, 'cut', chr(39) + 'K' + chr(39), 'chr(10) || line')} END"


def _written(state: str, role: str) -> str:
    return f"CASE WHEN NOT gone THEN {_more(state, '2 + cut', chr(39) + 'R' + chr(39), f'{role} || text')} END"


_DELETED = [_more(f"{state}2", "3", "'D'") for state in "nsua"]

CONVERSATION_REPAIR = rf"""
WITH RECURSIVE {_CRC_TABLE.strip()},
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
faulty AS (SELECT *, {_crc32("key")} % 20 AS fault FROM keyed, crc32_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM faulty),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
first_faults AS (
  SELECT conv_id, turn, i, role, text, left(role, 1) AS initial, role || ':' || text AS line,
         NOT regexp_matches(text, '[^ 	-]') AS blank,
         regexp_matches(text, '[^ 	-]') AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate,
         NOT regexp_matches(text, '[.!?][ 	-]*$') AS open_end,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS initial_before
  FROM placed),
lines AS (
  SELECT *, blank OR duplicate AS gone, (open_end AND NOT blank AND NOT duplicate)::BIGINT AS cut FROM first_faults),
dp(conv_id, i, n, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'a': '', 't': ''}}, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR),
         NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR), NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR)
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, {_best(_DELETED[0])}, {_best(_DELETED[1], _kept("n2", "s"))},
         {_best(_DELETED[2], *[_kept(f"{x}2", "u") for x in "nsa"], *[_written(f"{x}2", _USER) for x in "nsa"])},
         {_best(_DELETED[3], _kept("u2", "a"), _written("u2", _ASSISTANT))}
  FROM (
    SELECT dp.conv_id, l.i, l.initial, l.gone, l.cut, l.line, l.text, {_INSERTED}
    FROM dp JOIN lines l ON l.conv_id IS NOT DISTINCT FROM dp.conv_id AND l.i = dp.i + 1)),
counts AS (
  SELECT conv_id, count(*) AS rows,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE cut = 1) AS truncated,
         count(*) FILTER (WHERE i > 1 AND initial_before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM lines GROUP BY conv_id),
ended AS (
  SELECT dp.conv_id, c.* EXCLUDE (conv_id),
         {_best("n", "a", _more("s", "4", "'II'", _BOTH), _more("u", "2", "'I'", _ASSISTANT))} AS best
  FROM dp LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM dp.conv_id WHERE dp.i = coalesce(c.rows, 0))
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       best.c AS cost, best.a AS audit, sha256(substr(best.t, 2)) AS repaired_sha256
FROM ended
"""

SUFFIX_DEDUP = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS i FROM docs WHERE octet_length(b) >= 400),
windows AS (SELECT r, i, md5(array_slice(b, i, i + 399)) AS h FROM starts),
repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM windows) WHERE n > 1),
cuts AS (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 1 ELSE 0 END AS cut FROM repeated),
spans AS (
  SELECT r, min(i) AS s, max(i) + 400 AS e FROM (SELECT r, i, sum(cut) OVER (PARTITION BY r ORDER BY i) AS g FROM cuts) GROUP BY r, g),
totals AS (SELECT r, sum(e - s) AS n_removed, count(*) AS n_spans, max(e) AS last FROM spans GROUP BY r),
pieces AS (
  SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 1) AS a, s - 1 AS z FROM spans
  UNION ALL SELECT r, coalesce(last, 1), octet_length(b) FROM docs LEFT JOIN totals USING (r)),
kept AS (
  SELECT r, unhex(coalesce(string_agg(hex(array_slice(b, a, z)), '' ORDER BY a) FILTER (WHERE z >= a), '')) AS k
  FROM pieces JOIN docs USING (r) GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(k) AS kept_sha256
FROM docs JOIN kept USING (r) LEFT JOIN totals USING (r)
"""
