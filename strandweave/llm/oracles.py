"""SQL for DuckDB that gives the rows of operators 1, 6 and 9."""

from __future__ import annotations

from strandweave.llm import chat

_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))) END AS items FROM w),
classes AS (SELECT items, min(doc_id) AS class_id, count(*) AS n_copies FROM sets WHERE len(items) > 0 GROUP BY items),
s AS (SELECT class_id, len(items) AS n, unnest(items) AS item FROM classes),
pairs AS (SELECT x.class_id AS a, y.class_id AS b FROM s x JOIN s y ON x.item = y.item AND x.class_id <> y.class_id
  GROUP BY x.class_id, y.class_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (SELECT class_id AS a, class_id AS b FROM classes UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b),
parts AS (SELECT a AS class_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s.items)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept,
  coalesce(class_id, doc_id) AS class_id, coalesce(n_copies, 1)::BIGINT AS n_copies
FROM sets s LEFT JOIN classes c ON c.items = s.items LEFT JOIN parts p USING (class_id)"""

REPEATS = f"""WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
windows AS (SELECT doc_id, place, md5(array_to_string(ws[place:place + 49], ' ')) AS key FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS place FROM w)),
marked AS (SELECT doc_id, place, min(doc_id) OVER (PARTITION BY key) < doc_id AS again FROM windows),
each AS (SELECT doc_id, generate_subscripts(ws, 1) AS place, unnest(ws) AS word FROM w),
judged AS (SELECT doc_id, place, word, coalesce(bool_or(again) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone FROM each LEFT JOIN marked USING (doc_id, place)),
cut AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (NOT gone) AS kept FROM judged GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN cut USING (doc_id)"""


def _escaped(text: str) -> str:
    return rf"regexp_replace({text}, '([<\[])(\\*)({chat.CONTROL})', '\1\\\2\3', 'g')"


_ROLE = _escaped(r"replace(replace(role, '\', '\s'), chr(10), '\n')")
CHAT = f"""WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM
  (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))),
told AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{chat.LEARNED}'), '') AS learned,
  sum(length({_ROLE}) + length({_escaped("text")}) + {len(chat.OPEN) + len(chat.CLOSE) + 2}) AS formatted_chars FROM said GROUP BY conv_id)
SELECT conv_id::BIGINT AS conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM told"""

ORACLES = {"op1_minhash_near_dedup": NEAR, "op6_substring_dedup": REPEATS, "op9_chat_formatting": CHAT}
