"""DuckDB SQL of the queries that SQL can express."""

OP9 = r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
often AS (
  SELECT key, max(doc_id) AS top_id FROM (SELECT DISTINCT doc_id, key FROM lines WHERE length(key) >= 40)
  GROUP BY key HAVING count(*) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE top_id <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE top_id IS NULL OR top_id = doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN often USING (key) GROUP BY doc_id
"""

OP7 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
escaped AS (
  SELECT *, length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) AS role_chars,
         length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS text_chars FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(role_chars + text_chars + 24)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

OP3 = r"""
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.row, a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.row <> b.row WHERE a.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def _level(name: str, above: str, keys: list[str], weight: str) -> str:
    """One level of the budget tree: shares of each node's budget among its children."""
    same = " AND ".join(f"n.{k} IS NOT DISTINCT FROM p.{k}" for k in keys[:-1]) or "TRUE"
    parent = ", ".join(keys[:-1]) or "1"
    return f"""
{name}_c AS (
  SELECT n.*, p.budget AS given, {weight} AS weight
  FROM (SELECT {", ".join(keys)}, sum(2.0::DOUBLE * tokens) AS most FROM docs GROUP BY {", ".join(keys)}) n JOIN {above} p ON {same}
  WHERE most > 0),
{name}_r AS (
  SELECT *, row_number() OVER w AS turn,
    greatest(given - coalesce(sum(most) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)
    / (sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rate
  FROM {name}_c WINDOW w AS (PARTITION BY {parent} ORDER BY most / weight, {", ".join(k + " NULLS FIRST" for k in keys)})),
{name} AS (
  SELECT {", ".join(keys)}, least(most, coalesce(final * weight, most)) AS budget
  FROM (SELECT *, arg_min(rate, turn) FILTER (WHERE most > rate * weight) OVER (PARTITION BY {parent}) AS final FROM {name}_r))"""


_DOMAIN_WEIGHT = "CASE domain WHEN 'web' THEN 4.0 WHEN 'group0' THEN 2.0 WHEN 'group1' THEN 2.0 WHEN 'group2' THEN 1.0 ELSE 1.0 END::DOUBLE"
_LANG_WEIGHT = "CASE lang WHEN 'en' THEN 4.0 WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 WHEN 'es' THEN 1.0 ELSE 1.0 END::DOUBLE"
_PLACE = "('0x' || substr(md5('11:' || e::BIGINT || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT"

OP1 = rf"""
WITH docs AS (
  SELECT doc_id, lang, source,
    CASE WHEN source = 'src0' THEN 'web' WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 'other'
         ELSE 'group' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::BIGINT % 3) END AS domain,
    length(regexp_replace(regexp_replace(coalesce(text, ''), '[^ 	

]+', 'x', 'g'), '[ 	

]+', '', 'g')) AS tokens
  FROM documents),
root AS (SELECT sum(tokens)::DOUBLE AS budget FROM docs),
{_level("d", "root", ["domain"], _DOMAIN_WEIGHT)},
{_level("l", "d", ["domain", "lang"], _LANG_WEIGHT)},
{_level("s", "l", ["domain", "lang", "source"], "1.0::DOUBLE")},
leaves AS (
  SELECT t.*, coalesce(floor(s.budget + 1e-6), 0)::BIGINT AS budget, coalesce(floor(s.budget + 1e-6), 0)::BIGINT // greatest(t.tokens, 1) AS e
  FROM (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM docs GROUP BY ALL) t
  LEFT JOIN s ON t.domain IS NOT DISTINCT FROM s.domain AND t.lang IS NOT DISTINCT FROM s.lang AND t.source IS NOT DISTINCT FROM s.source),
placed AS (
  SELECT docs.*, e, leaves.budget - e * leaves.tokens AS left_over, {_PLACE} AS place FROM docs JOIN leaves
  ON docs.domain IS NOT DISTINCT FROM leaves.domain AND docs.lang IS NOT DISTINCT FROM leaves.lang AND docs.source IS NOT DISTINCT FROM leaves.source),
taken AS (
  SELECT *, e + CASE WHEN left_over > 0 AND coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < left_over
                     THEN 1 ELSE 0 END AS n FROM placed)
SELECT doc_id, domain, lang, source, tokens::BIGINT AS tokens, unnest(range(n::BIGINT))::INTEGER AS epoch FROM taken WHERE n > 0
"""

OP12 = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
kinds AS (
  SELECT c.conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_concat([4294967295]::BIGINT[], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
      lambda x: ord(x)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM conversations c, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy) AS pos,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again FROM damaged),
faults AS (
  SELECT *, role[1] AS initial, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again > 1 THEN 'duplicate'
         WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed),
adds(s, t, cost, letters) AS (VALUES (0, 0, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 1, 0, ''), (1, 2, 3, 'I'), (1, 3, 6, 'II'), (2, 2, 0, ''), (2, 3, 3, 'I'), (3, 3, 0, ''), (3, 2, 3, 'I')),
moves(letter, initial, s, t, cost) AS (
  VALUES ('K', 's', 0, 1, 0), ('K', 'u', 0, 2, 0), ('K', 'u', 1, 2, 0), ('K', 'a', 2, 3, 0), ('K', 'u', 3, 2, 0),
         ('R', '', 0, 2, 3), ('R', '', 1, 2, 3), ('R', '', 2, 3, 3), ('R', '', 3, 2, 3), ('D', '', 0, 0, 4), ('D', '', 1, 1, 4), ('D', '', 2, 2, 4), ('D', '', 3, 3, 4)),
paths AS (
  SELECT c.conv_id, 0::BIGINT AS i, a.t AS s, {'cost': a.cost::BIGINT, 'audit': a.letters,
    'lines': CASE a.letters WHEN '' THEN []::VARCHAR[] WHEN 'I' THEN ['user:'] ELSE ['user:', 'assistant:'] END} AS best
  FROM (SELECT DISTINCT conv_id FROM conversations) c, adds a WHERE a.s = 0
  UNION ALL
  SELECT conv_id, i, s, min(best) FROM (
    SELECT p.conv_id, p.i + 1 AS i, a.t AS s, {
      'cost': p.best.cost + m.cost + CASE WHEN f.fault = 'truncated' AND m.letter <> 'D' THEN 3 ELSE 0 END + a.cost,
      'audit': p.best.audit || m.letter || a.letters,
      'lines': list_concat(list_concat(p.best.lines, CASE m.letter WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [f.role || ':' || f.text]
          ELSE [CASE m.t WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || f.text] END),
        CASE WHEN a.letters = '' THEN []::VARCHAR[] WHEN a.letters = 'II' THEN ['user:', 'assistant:'] WHEN a.t = 2 THEN ['user:'] ELSE ['assistant:'] END)} AS best
    FROM paths p JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.pos = p.i + 1
    JOIN moves m ON m.s = p.s AND (m.initial = '' OR m.initial = f.initial) AND (m.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
    JOIN adds a ON a.s = m.t)
  GROUP BY conv_id, i, s),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id)
SELECT p.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, min(best).cost::BIGINT AS cost, min(best).audit AS audit,
  sha256(array_to_string(min(best).lines, chr(10))) AS repaired_sha256
FROM paths p LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id
WHERE p.i = coalesce(n, 0) AND p.s IN (0, 3) GROUP BY ALL
"""
