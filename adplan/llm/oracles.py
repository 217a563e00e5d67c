"""DuckDB SQL of the queries that SQL can express."""

_CONTROL = r"[<\[]\\*/?(s>|INST\]|ROLE\]|TURN\]|SYS>)"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERMS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES = {
    "op11_block_maxima_search": rf"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
c AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(len(ts)) AS BIGINT) AS ll FROM d WHERE len(ts) > 0),
m AS (SELECT doc_id, ts, 100 - 50 + (50 * CAST(len(ts) AS BIGINT) * nn) // ll AS m FROM d, c WHERE len(ts) > 0),
p AS (SELECT doc_id, m, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, m, unnest(ts) AS term FROM m) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT item_id, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT)
        * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
      FROM q JOIN p USING (term) JOIN f USING (term), c GROUP BY item_id, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50""",
    "op12_stateful_exact_copies": rf"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS k FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(k) AS text_sha256
FROM t WINDOW w AS (PARTITION BY k)""",
    "op9_chat_format": rf"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role,
         coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (
  SELECT *, row_number() OVER w AS pos, coalesce(lag(role) OVER w <> role, true) AS fresh,
         length(text) + len(regexp_extract_all(text, '{_CONTROL}')) AS chars,
         length(role) + len(regexp_extract_all(role, '{_CONTROL}')) AS role_chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(chars) + sum(CASE WHEN fresh THEN role_chars + 17 ELSE 6 END))::BIGINT AS formatted_chars
FROM m GROUP BY conv_id""",
}
