"""DuckDB SQL of the queries that SQL can express.

The others have no SQL form (hash functions, tokenizers, learned models, packing, components); they
are tested against brute force.
"""

from __future__ import annotations

from traitscope.llm.quality_rules import CHARS, ENOUGH, LINES, REACH, RULES
from traitscope.llm.quality_rules import WORDS as FEW

WORDS = r"[^\x20\x09-\x0D]+"

WARC = """
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id, url, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT rid, page_id, url, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id,
    count(*) OVER (PARTITION BY payload_digest) AS n FROM d
)
SELECT page_id, url, payload_bytes, payload_digest,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""

EXACT = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents
), g AS (
  SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    count(*) OVER (PARTITION BY text_sha256, doc_id) AS same_rows,
    row_number() OVER (PARTITION BY text_sha256, doc_id ORDER BY rid) AS copy FROM d
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND copy = 1 AS kept, text_sha256, same_rows FROM g
"""

#: A control string, marked any number of times, gets one backslash more inside a text.
CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), m AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?(?:INST|SYS|ROLE)\]|END\])', '\1\\\2\3', 'g')) AS chars,
    length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?(?:INST|SYS|ROLE)\]|END\])', '\1\\\2\3', 'g')) AS role_chars FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 13 ELSE 18 + role_chars END)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""

PHRASES = r"""
WITH w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
), n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, m, ws[i:i + m - 1] AS ws, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, range(1, 6) t(m) WHERE len(ws) >= m)
  GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, n.n, k, ((1000::HUGEINT * c.f * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM g WHERE m > 1) c JOIN n USING (lang)
  JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:k], ' ')
  JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[k + 1:], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_parts AS (
  SELECT DISTINCT lang, array_to_string(ws[i:i + size - 1], ' ') AS phrase, f
  FROM (SELECT *, unnest(range(1, m - size + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS size FROM g WHERE m > 2))
), kept AS (
  SELECT b.* FROM best b WHERE NOT EXISTS (FROM inner_parts p WHERE p.lang = b.lang AND p.phrase = b.phrase AND 100 * p.f >= 100 * b.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""


def quality() -> str:
    """Measures of whole texts, exact quartiles per group, thresholds and verdicts."""
    def at(q: float, m: str, total: str) -> str:
        return f"list_sort(list({m}))[greatest(CAST(ceil({q} * {total}) AS BIGINT), 1)]"

    quartiles = {
        name: ", ".join(f"{at(q, m, 'count(*)')} AS {m}_{k}" for m in RULES for q, k in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3")))
        for name in ("own", "lang", "total")
    }
    limits = []
    for m, spread in RULES.items():
        q1, q2, q3 = (
            f"(CASE WHEN o.n >= {ENOUGH} THEN o.{m}_{k} WHEN l.n >= {ENOUGH} THEN l.{m}_{k} ELSE a.{m}_{k} END)" for k in ("q1", "q2", "q3")
        )
        limits.append(f"{q2} + {REACH} * greatest(2 * ({q2} - {q1}), {spread}) AS {m}_high")
        if m == "word_length":
            limits.append(f"{q2} - {REACH} * greatest(2 * ({q3} - {q2}), {spread}) AS {m}_low")
    ok = " AND ".join(f"r.{m} <= {m}_high" for m in RULES)
    ok += " AND r.word_length >= word_length_low"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '{WORDS}') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS ls FROM d
), grams AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i:i + 4]) AS c
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), again AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM grams WHERE c > 1) GROUP BY rid
), m AS (
  SELECT rid, doc_id, lang, source, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(again.n, 0) AS n_repeat_words, len(ls) AS n_lines,
    len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_echoes,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals
  FROM w LEFT JOIN again USING (rid)
), r AS (
  SELECT *, 1000 * n_symbols // greatest(word_chars, {CHARS}) AS symbols, 1000 * n_dup_lines // greatest(n_lines, {LINES}) AS dup_lines,
    1000 * n_repeat_words // greatest(n_words, {FEW}) AS repeats, 1000 * n_echoes // greatest(n_words, {FEW}) AS echoes,
    1000 * n_capitals // greatest(word_chars, {CHARS}) AS capitals, 100 * word_chars // greatest(n_words, 1) AS word_length,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM m
), o AS (SELECT lang, source, count(*) AS n, {quartiles["own"]} FROM r WHERE NOT base_failed GROUP BY lang, source
), l AS (SELECT lang, count(*) AS n, {quartiles["lang"]} FROM r WHERE NOT base_failed GROUP BY lang
), a AS (SELECT count(*) AS n, {quartiles["total"]} FROM r WHERE NOT base_failed
), x AS (
  SELECT o.lang, o.source, {", ".join(limits)} FROM o JOIN l ON o.lang IS NOT DISTINCT FROM l.lang CROSS JOIN a
)
SELECT r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
  NOT r.base_failed AND coalesce({ok}, false) AS kept, {", ".join(f"r.{m}" for m in RULES)}
FROM r LEFT JOIN x ON r.lang IS NOT DISTINCT FROM x.lang AND r.source IS NOT DISTINCT FROM x.source
"""


def oracle() -> dict[str, str]:
    return {"op3_warc": WARC, "op5_quality_rules": quality(), "op8_exact_dedup": EXACT, "op12_phrases": PHRASES, "op13_chat_format": CHAT}
