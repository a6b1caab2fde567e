"""DuckDB SQL for the queries that SQL can express on whole tables. The rest is tested by brute force, round trips or labels."""

from __future__ import annotations

from .chat import CLOSE, END, LOSS_ROLE, OPEN, REST, TEXT, TURN

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: All pairs of different sets that share a shingle; links; what each set reaches.
NGRAM_JOIN = rf"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_sort(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] FOR i IN range(1, len(w) - 2)]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), sets AS MATERIALIZED (SELECT row_number() OVER (ORDER BY min(doc_id)) AS id, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s
), items AS MATERIALIZED (SELECT id, n, unnest(s) AS t FROM sets
), ids AS MATERIALIZED (SELECT id, n, dense_rank() OVER (ORDER BY t) AS t FROM items
), pairs AS MATERIALIZED (
  SELECT x.id AS a, y.id AS b FROM ids x JOIN ids y ON x.t = y.t AND x.id < y.id AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
  GROUP BY x.id, y.id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), links AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach AS (SELECT id, id AS r FROM sets UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r
), named AS (SELECT sets.id, sets.s, min(f.least_id) AS c FROM reach JOIN sets ON sets.id = reach.id JOIN (
    SELECT sets.id, min(s.doc_id) AS least_id FROM s JOIN sets ON sets.s = s.s GROUP BY sets.id) f ON f.id = reach.r GROUP BY sets.id, sets.s)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(named.c, s.doc_id) AS component_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links
FROM s LEFT JOIN named ON named.s = s.s LEFT JOIN sets ON sets.s = s.s LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON k.a = sets.id
"""

_ESCAPED = r"length(regexp_replace({}, '([<\[])(\\*" + REST + r")', '\1\\\2', 'g'))"
_AROUND = len(TURN) + len(TEXT) + len(END)

CHAT = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), texts AS (
  SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = '{LOSS_ROLE}'), '') AS under,
    sum({_AROUND} + {_ESCAPED.format("role")} + {_ESCAPED.format("text")}) + {len(OPEN) + len(CLOSE)} AS chars
  FROM rows GROUP BY conv_id
)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(under) AS BIGINT) AS loss_chars,
  sha256(under) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM texts
"""

SQL = {"op1_ngram_join": NGRAM_JOIN, "op8_chat": CHAT}
