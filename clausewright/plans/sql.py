"""The text path stated in SQL without lookaround, as steps that build on a table docs (doc_id, text)."""

from __future__ import annotations

from clausewright.plans.corpus import DOCUMENTS_SQL

_SPACE = r"[ \t\n\r\f\v]"
_SEMICOLON = "len(list_filter(range(1, len(string_split({0}, ';'))), lambda k: NOT regexp_matches(array_to_string(string_split({0}, ';')[k + 1:], ';'), '^[^(]*\\)'))) > 0"
_ENUMERATED = r"regexp_matches({0}, '\([a-z]\)|\([A-Z]\)|\([0-9]+\)|\(i{{1,3}}\)|\(iv\)|\(vi{{0,3}}\)')"
# The patterns of clausewright.functions.patterns without lookaround.
_HEADERS = r"(?i)^\s*(?:What\s+is\s+claimed\s+is\s*[:\.]|The\s+invention\s+claimed\s+is\s*[:\.]|We\s+claim\s*[:\.]|I\s+claim\s*[:\.]|CLAIMS?\s*[:\.]?)\s*$"
_WORDS = r"(comprising|consisting\s+of|consisting\s+essentially\s+of|including|having|containing)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


# Fixed values, stated a second time so that the SQL doesn't rest on the engine's own: patterns, words, categories, scores, messages.
NORMALIZED = rf""",
n1 AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?mi)^[ \t]*(?:Page[ \t]+[0-9]+|[0-9]+[ \t]+of[ \t]+[0-9]+|-[ \t]*[0-9]+[ \t]*-)[ \t]*$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS text FROM docs),
n2 AS (SELECT doc_id, text AS before, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\bclalm\b', 'claim', 'g'), '(?i)\bclain\b', 'claim', 'g'), '(?i)\bcornprlsing\b', 'comprising', 'g'), '(?i)\bcornprising\b', 'comprising', 'g'), '(?i)\bwhereln\b', 'wherein', 'g') AS text FROM n1),
n3 AS (SELECT doc_id, CASE WHEN text <> before THEN 'page_artifacts_removed,whitespace_cleaned,ocr_cleanup_applied' ELSE 'page_artifacts_removed,whitespace_cleaned' END AS ops, regexp_replace(text, '([a-zA-Z])-[ \t\r\f\v]*\n\s*([a-zA-Z])', '\1\2', 'g') AS text FROM n2),
n4 AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, {_strip("unnest(string_split(text, chr(10)))")} AS line FROM n3),
n5 AS (SELECT doc_id, i, line, line = '' OR coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY i), '') = '' OR regexp_matches(line, '(?i)^(?:claim[ \t]+)?[0-9]+\.([^0-9]|$)') AS starts FROM n4),
n6 AS (SELECT doc_id, i, line, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM n5),
n7 AS (SELECT doc_id, g, string_agg(line, ' ' ORDER BY i) AS line FROM n6 GROUP BY doc_id, g),
n8 AS (SELECT doc_id, regexp_replace(string_agg(line, chr(10) ORDER BY g), '\n{{2,}}', chr(10) || chr(10), 'g') AS text FROM n7 GROUP BY doc_id),
normalized AS (SELECT n8.doc_id, n8.text, n3.ops FROM n8 JOIN n3 ON n3.doc_id = n8.doc_id)"""

CLAIMS = rf""",
s0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM normalized),
s1 AS (SELECT doc_id, {_strip(f"array_to_string(ls[coalesce(list_min(list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(ls[i], '{_HEADERS}'))), 0) + 1:], chr(10))")} AS text FROM s0),
s2 AS (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS line FROM s1 WHERE text <> ''),
s3 AS (SELECT *, regexp_matches(line, '(?i)^[ \t]*(?:claim[ \t]+)?[0-9]+\.([^0-9]|$)') AS starts FROM s2),
s4 AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY i) AS claim_pos FROM s3),
s5 AS (SELECT doc_id, claim_pos, max(CASE WHEN starts THEN regexp_extract(line, '(?i)^[ \t]*(?:claim[ \t]+)?([0-9]+)\.', 1)::VARCHAR END) AS digits,
              {_strip("string_agg(CASE WHEN starts THEN regexp_replace(line, '(?i)^[ \\t]*(?:claim[ \\t]+)?[0-9]+\\.[ \\t]*', '') ELSE line END, chr(10) ORDER BY i)")} AS claim_text FROM s4 WHERE claim_pos > 0 GROUP BY doc_id, claim_pos),
split AS (SELECT doc_id, claim_pos::INT AS claim_pos, try_cast(digits AS BIGINT) AS number, claim_text FROM s5
          UNION ALL SELECT doc_id, 1, 1, text FROM s1 WHERE text <> '' AND doc_id NOT IN (SELECT doc_id FROM s5)),
d1 AS (SELECT *, regexp_extract(claim_text, '(?i)\bclaims?\s+(\d+)\s*(?:-|to|through)\s*(\d+)\b', 1) AS a, regexp_extract(claim_text, '(?i)\bclaims?\s+(\d+)\s*(?:-|to|through)\s*(\d+)\b', 2) AS b,
              list_sort(list_distinct(regexp_extract_all(claim_text, '(?i)\bclaim\s+(\d+)\b', 1)::BIGINT[])) AS singles FROM split),
dependent AS (SELECT doc_id, claim_pos, number, claim_text, a = '' AND len(singles) = 0 AS is_independent, CASE WHEN a = '' THEN singles WHEN b::BIGINT - a::BIGINT >= 100000 THEN [] ELSE range(a::BIGINT, greatest(b::BIGINT + 1, a::BIGINT)) END AS parent_claims, coalesce(try_cast(nullif(b, '') AS BIGINT) - try_cast(nullif(a, '') AS BIGINT) >= 100000, false) AS too_long FROM d1),
t1 AS (SELECT *, regexp_matches(claim_text, '(?i)\b{_WORDS}\b') AS has, regexp_extract(claim_text, '(?i)\b{_WORDS}\b', 1) AS word,
              regexp_extract(claim_text, '(?is)^(.*?)\b{_WORDS}\b(.*)$', 1) AS head, {_strip(rf"regexp_extract(claim_text, '(?is)^(.*?)\b{_WORDS}\b(.*)$', 3)")} AS tail FROM dependent),
transitioned AS (SELECT doc_id, claim_pos, number, claim_text, is_independent, parent_claims, too_long, CASE WHEN has THEN word END AS transition, CASE WHEN has THEN nullif({_strip("head")}, '') END AS preamble,
       has AND starts_with(tail, ':') AS has_colon, CASE WHEN NOT has THEN claim_text WHEN starts_with(tail, ':') THEN {_strip("substr(tail, 2)")} ELSE tail END AS body,
       CASE WHEN regexp_matches(claim_text, '(?i)\b(?:method|process)\b') THEN 'method' WHEN regexp_matches(claim_text, '(?i)\bsystem\b') THEN 'system' WHEN regexp_matches(claim_text, '(?i)\b(?:apparatus|device|machine)\b') THEN 'apparatus'
            WHEN regexp_matches(claim_text, '(?i)\bcomposition\b') THEN 'composition' WHEN regexp_matches(claim_text, '(?i)\b(?:computer[\s-]*readable\s+(?:storage\s+)?medium|non-transitory)') THEN 'computer-readable medium'
            WHEN regexp_matches(claim_text, '(?i)\barticle\b') THEN 'article' WHEN regexp_matches(claim_text, '(?i)\bproduct\b') THEN 'product' ELSE 'unknown' END AS category FROM t1),
h1 AS (SELECT *, {_strip("coalesce(preamble, '') || coalesce(' ' || transition, '') || CASE WHEN has_colon THEN ':' ELSE '' END")} AS sug FROM transitioned),
h2 AS (SELECT *, CASE WHEN sug <> '' THEN {_strip("sug || ' ' || body")} ELSE body END AS whole FROM h1),
h3 AS (SELECT *, sug <> '' AND (has_colon OR contains(body, ':') OR {_SEMICOLON.format("body")} OR {_ENUMERATED.format("body")}) AS keeps, {_SEMICOLON.format("whole")} AS has_semi, {_ENUMERATED.format("whole")} AS has_enum,
              instr(whole, regexp_extract(whole, '(?i)\((?:[a-z]|i{{1,3}}|iv|vi{{0,3}}|ix|x|[0-9]+)\)', 0)) AS marker_at FROM h2),
headed AS (SELECT doc_id, claim_pos, number, claim_text, is_independent, parent_claims, too_long, transition, preamble, has_colon, category,
       CASE WHEN keeps THEN sug WHEN contains(whole, ':') THEN {_strip("string_split(whole, ':')[1]")} || ':' WHEN NOT has_semi AND NOT has_enum THEN whole WHEN NOT has_semi AND marker_at > 1 THEN {_strip("substr(whole, 1, marker_at - 1)")} WHEN NOT has_semi THEN NULL ELSE '' END AS header,
       CASE WHEN keeps THEN body WHEN contains(whole, ':') THEN {_strip("substr(whole, instr(whole, ':') + 1)")} WHEN NOT has_semi AND NOT has_enum THEN '' WHEN NOT has_semi THEN {_strip("substr(whole, marker_at)")} ELSE whole END AS body FROM h3)"""

ELEMENTS = rf""",
m1 AS (SELECT doc_id, claim_pos, number, body, regexp_extract_all(body, '(?i)\((?:[a-z]|i{{1,3}}|iv|vi{{0,3}}|ix|x|[0-9]+)\)', 0) AS ms, regexp_split_to_array(body, '(?i)\((?:[a-z]|i{{1,3}}|iv|vi{{0,3}}|ix|x|[0-9]+)\)') AS ps FROM headed WHERE body <> '' AND {_ENUMERATED.format("body")}),
m2 AS (SELECT doc_id, claim_pos, number, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS marker, unnest(ps[2:]) AS text FROM m1),
marked AS (SELECT doc_id, claim_pos, number, (i - 1)::INT AS path, (i - 1)::INT AS ord, CASE WHEN regexp_matches(marker, '^\([0-9]+\)$') THEN 4 WHEN regexp_matches(marker, '^\([a-z]\)$') THEN 1 WHEN regexp_matches(marker, '^\([A-Z]\)$') THEN 3 ELSE 2 END AS level, marker, 'ENUMERATION' AS element_type, {_strip("text")} AS text FROM m2),
b1 AS (SELECT doc_id, claim_pos, number, body, string_split(body, ';') AS p FROM headed WHERE body <> '' AND NOT {_ENUMERATED.format("body")}),
b2 AS (SELECT doc_id, claim_pos, number, p, len(p) AS n, unnest(range(1, len(p) + 1)) AS k FROM b1),
b3 AS (SELECT *, k < n AND NOT regexp_matches(array_to_string(p[k + 1:], ';'), '^[^(]*\)') AS ends FROM b2),
b4 AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id, claim_pos ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM b3),
b5 AS (SELECT doc_id, claim_pos, number, g::INT AS o, {_strip("string_agg(p[k] || CASE WHEN k < n THEN ';' ELSE '' END, '' ORDER BY k)")} AS t FROM b4 GROUP BY doc_id, claim_pos, number, g),
b6 AS (SELECT *, CASE WHEN o > 0 THEN regexp_extract(t, '(?i)^(and|or)\s+', 1) ELSE '' END AS c FROM b5),
b7 AS (SELECT doc_id, claim_pos, number, o, {_strip("CASE WHEN c <> '' THEN substr(t, length(c) + 1) ELSE t END")} AS t, coalesce(lead(c) OVER (PARTITION BY doc_id, claim_pos ORDER BY o), '') AS c FROM b6),
b8 AS (SELECT doc_id, claim_pos, number, o, t || CASE WHEN c <> '' THEN ' ' || c ELSE '' END AS t, count(*) OVER (PARTITION BY doc_id, claim_pos) AS n FROM b7 WHERE t <> ''),
b9 AS (SELECT *, regexp_matches(t, ':(\s+|$)') AS colon FROM b8 WHERE n > 1),
b10 AS (SELECT *, 1 + coalesce(sum(colon::INT) OVER (PARTITION BY doc_id, claim_pos ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS level FROM b9),
b11 AS (SELECT doc_id, claim_pos, number, o, 0 AS half, level, CASE WHEN starts_with(lower(t), 'wherein') THEN 'WHEREIN_CLAUSE' ELSE 'BODY_ELEMENT' END AS element_type, CASE WHEN colon THEN regexp_extract(t, '(?s)^(.*?:)(?:\s|$)', 1) ELSE t END AS text FROM b10
        UNION ALL SELECT doc_id, claim_pos, number, o, 1, level + 1, 'BODY_ELEMENT', {_strip("regexp_extract(t, '(?s)^.*?:(\\s.*)$', 1)")} FROM b10 WHERE colon),
listed AS (SELECT doc_id, claim_pos, number, (row_number() OVER (PARTITION BY doc_id, claim_pos ORDER BY o, half) - 1)::INT AS path, o AS ord, level::INT AS level, NULL::VARCHAR AS marker, element_type, text FROM b11 WHERE half = 0 OR text <> ''),
single AS (SELECT doc_id, claim_pos, number, 0 AS path, 0 AS ord, 1 AS level, NULL::VARCHAR AS marker, CASE WHEN starts_with(lower({_strip("body")}), 'wherein') THEN 'WHEREIN_CLAUSE' ELSE 'BODY_ELEMENT' END AS element_type, {_strip("body")} AS text FROM b1
           WHERE (doc_id, claim_pos) NOT IN (SELECT (doc_id, claim_pos) FROM b9)),
elements AS (SELECT * FROM marked UNION ALL SELECT * FROM listed UNION ALL SELECT * FROM single)"""

SCORES = """,
counted AS (SELECT doc_id, claim_pos, count(*) AS n FROM elements GROUP BY doc_id, claim_pos),
q AS (SELECT h.*, coalesce(counted.n, 0) AS n FROM headed h LEFT JOIN counted ON counted.doc_id = h.doc_id AND counted.claim_pos = h.claim_pos),
q1 AS (SELECT doc_id, count(*) AS claim_count, count(*) FILTER (is_independent) AS independent_count, CASE WHEN min(number - claim_pos) = max(number - claim_pos) THEN 100.0 ELSE 85.0 END::DOUBLE AS claim_detection,
         avg(CASE WHEN is_independent <> (len(parent_claims) > 0) THEN 100.0 ELSE 80.0 END) AS dependency, coalesce(avg(CASE WHEN header <> '' THEN 100.0 ELSE 70.0 END) FILTER (is_independent), 100.0) AS transition,
         avg(CASE WHEN n > 0 THEN 100.0 ELSE 60.0 END) AS enumeration FROM q GROUP BY doc_id),
scores AS (SELECT *, round(claim_detection * 0.25 + dependency * 0.2 + transition * 0.15 + enumeration * 0.15 + enumeration * 0.1 + 100.0 * 0.15, 2) AS confidence FROM q1)"""

ERRORS = """,
e0 AS (SELECT doc_id, claim_pos, number, claim_text, header, too_long, claim_pos > min(claim_pos) OVER (PARTITION BY doc_id, number) AS again FROM headed),
e1 AS (SELECT doc_id, 0 AS phase, claim_pos, CASE WHEN header IS NULL THEN 'UnboundHeader' ELSE 'RangeTooLong' END AS error_class, CASE WHEN header IS NULL THEN 'claim begins with its first marker' ELSE 'a claim range is too long' END AS message FROM e0 WHERE header IS NULL OR too_long
       UNION ALL SELECT doc_id, 1, claim_pos, 'DuplicateClaimNumber', 'Duplicate claim number detected: ' || number FROM e0 WHERE again AND number IS NOT NULL
       UNION ALL SELECT doc_id, 1, claim_pos, 'InvalidClaimNumber', 'Invalid claim number: ' || coalesce(number::VARCHAR, 'more than 64 bits') FROM e0 WHERE number IS NULL OR (NOT again AND number <= 0)
       UNION ALL SELECT doc_id, 2, claim_pos, 'EmptyClaim', 'Claim ' || number || ' has empty body text.' FROM e0 WHERE claim_text = ''),
claim_errors AS (SELECT doc_id, error_class, message FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY phase, claim_pos) AS r FROM e1) WHERE r = 1),
errors AS (SELECT * FROM claim_errors UNION ALL SELECT doc_id, 'EmptyText', 'no text' FROM docs WHERE coalesce(regexp_matches(text, '^\\s*$'), true))"""

JSON = """,
j1 AS (SELECT doc_id, claim_pos, string_agg('{"ord":' || ord || ',"level":' || level || coalesce(',"marker":' || to_json(marker), '') || ',"element_type":"' || element_type || '","text":' || to_json(text) || '}', ',' ORDER BY path) AS listed FROM elements GROUP BY doc_id, claim_pos),
j2 AS (SELECT h.doc_id, string_agg('{"claim_pos":' || h.claim_pos || ',"number":' || number || ',"claim_type":"' || CASE WHEN is_independent THEN 'INDEPENDENT' ELSE 'DEPENDENT' END || '"' || coalesce(',"parent_claim":' || parent_claims[1], '') || ',"category":"' || category || '","header":' || to_json(header) || ',"elements":[' || coalesce(listed, '') || ']}', ',' ORDER BY h.claim_pos) AS claims
       FROM headed h LEFT JOIN j1 ON j1.doc_id = h.doc_id AND j1.claim_pos = h.claim_pos GROUP BY h.doc_id)
SELECT d.doc_id, '{"document_type":"RAW_TEXT","claim_count":' || coalesce(claim_count, 0) || ',"independent_count":' || coalesce(independent_count, 0) || ',"dependent_count":' || coalesce(claim_count - independent_count, 0) || ',"ocr_used":false,"confidence_score":' || coalesce(confidence, 0.0::DOUBLE)
  || coalesce(',"metadata":{"confidence_report":{"confidence":' || confidence || ',"modules":{"claim_detection":' || claim_detection || ',"dependency":' || round(dependency, 9) || ',"transition":' || round(transition, 9) || ',"enumeration":' || round(enumeration, 9) || ',"semicolon":' || round(enumeration, 9) || ',"hierarchy":100.0}}}', '')
  || coalesce(',"claims":[' || j2.claims || ']', '') || '}' AS json
FROM docs d LEFT JOIN scores ON scores.doc_id = d.doc_id LEFT JOIN j2 ON j2.doc_id = d.doc_id WHERE d.doc_id NOT IN (SELECT doc_id FROM errors)"""

#: What each claim depends on: f has the first claim of each number, e its parents that the document has, reached all that can be reached over these.
REACHED = """,
f AS (SELECT doc_id, number, parent_claims AS parents FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, number ORDER BY claim_pos) AS r FROM dependent WHERE number IS NOT NULL) WHERE r = 1),
e AS (SELECT DISTINCT p.doc_id, p.number, p.parent FROM (SELECT doc_id, number, unnest(parents) AS parent FROM f) p JOIN f ON f.doc_id = p.doc_id AND f.number = p.parent),
reached AS (SELECT doc_id, number, parent AS ancestor FROM e UNION SELECT r.doc_id, r.number, e.parent FROM reached r JOIN e ON e.doc_id = r.doc_id AND e.number = r.ancestor)"""

RAW = "\nWITH RECURSIVE " + DOCUMENTS_SQL.lstrip()
CORPUS = RAW + NORMALIZED
OF_CLAIMS = CORPUS + CLAIMS
OF_ELEMENTS = OF_CLAIMS + ELEMENTS
OF_ALL = OF_ELEMENTS + SCORES + ERRORS
OF_TEXTS = "\nWITH docs AS (SELECT doc_id, text FROM documents)" + NORMALIZED
