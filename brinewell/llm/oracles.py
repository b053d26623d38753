"""DuckDB equivalents of the queries that SQL can express."""

from __future__ import annotations

from brinewell.llm.decontaminate import NEAR_TERMS, SLOP
from brinewell.llm.licenses import MIN_COSINE, QUOTED, TERM, TRIGGER, template_rows
from brinewell.llm.quality import ALPHA, CUTOFFS, DELTA, PRICE, RULES

_WORD = r"[^\x20\x09-\x0D]+"

_GRID = ", ".join(f"('{r}', {k}, {c}, '{RULES[r][0]}', '{RULES[r][1]}')" for r, cs in CUTOFFS.items() for k, c in enumerate(cs))
_PICK = "case {0} " + " ".join(f"when '{x}' then {x}" for x in sorted({y for r in RULES.values() for y in r})) + " end"
_REJECTED = f"1000 * ({_PICK.format('top')}) > cutoff * ({_PICK.format('bottom')})"

OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '{_WORD}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
g AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM (SELECT r, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
inside AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
s AS (SELECT d.r, doc_id, stratum, len(words) AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(inside.n, 0) AS n_repeat_words, len(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters, len(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
  FROM d JOIN w USING (r) LEFT JOIN inside USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
marks AS (SELECT doc_id, min(quality) AS mark FROM labels WHERE quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = max(quality)),
grid(rule, step, cutoff, top, bottom) AS (VALUES {_GRID}),
counted AS (SELECT stratum, rule, step, cutoff, count(*) FILTER (mark = 1) AS good, count(*) FILTER (mark = 1 AND {_REJECTED}) AS good_rejected, count(*) FILTER (mark = 0 AND {_REJECTED}) AS bad_rejected
  FROM b JOIN marks USING (doc_id) CROSS JOIN grid WHERE NOT base_failed GROUP BY ALL),
tested AS (SELECT *, CASE WHEN good_rejected >= good THEN 1.0 ELSE list_sum(list_transform(generate_series(0, good_rejected), lambda k: exp(lgamma(good + 1) - lgamma(k + 1) - lgamma(good - k + 1) + k * ln({ALPHA / len(RULES)}) + (good - k) * ln(1 - {ALPHA / len(RULES)})))) END
  <= {DELTA}e0 / (greatest(1, (SELECT count(DISTINCT stratum) FROM counted)) * {len(RULES)}) AS ok FROM counted),
sound AS (SELECT *, bad_rejected - {PRICE} * good_rejected AS gain FROM (SELECT *, bool_and(ok) OVER (PARTITION BY stratum, rule ORDER BY step) AS upto FROM tested) WHERE upto),
best AS (SELECT stratum, rule, top, bottom, cutoff FROM (SELECT s.*, row_number() OVER (PARTITION BY s.stratum, s.rule ORDER BY gain DESC, s.step) AS k, g.top, g.bottom FROM sound s JOIN grid g ON g.rule = s.rule AND g.step = s.step WHERE gain > 0) WHERE k = 1),
failed AS (SELECT DISTINCT r FROM b JOIN best USING (stratum) WHERE {_REJECTED})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed.r IS NULL AS kept FROM b LEFT JOIN failed USING (r)
"""

OP3 = rf"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '{_WORD}')) END AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) || ':0') AS rank FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS kind FROM d GROUP BY source),
t AS (SELECT *, CAST([5, 2, 1][kind + 1] AS HUGEINT) AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / CAST(weight AS DOUBLE), source NULLS LAST) AS place FROM t),
l AS (SELECT *, CAST(sum(source_size) OVER () AS HUGEINT) * 150 - CAST(coalesce(sum(source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) * 200 AS rest,
  CAST(sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS HUGEINT) AS others FROM o),
c AS (SELECT *, CAST(source_size AS HUGEINT) * others * 200 <= weight * rest AS capped FROM l),
f AS (SELECT rest, others FROM c WHERE NOT capped ORDER BY place LIMIT 1),
targets AS (SELECT source, source_size, kind, CASE WHEN capped THEN CAST(source_size * 2 AS DOUBLE) ELSE CAST(weight * (SELECT rest FROM f) AS DOUBLE) / CAST((SELECT others FROM f) * 100 AS DOUBLE) END AS target FROM c),
m AS (SELECT d.*, source_size, kind, target, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY rank, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) + size / 2 AS middle
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM m),
p AS (SELECT *, least(2, whole + CASE WHEN middle <= target - whole * source_size THEN 1 ELSE 0 END) AS copies, least(1.0e0, coalesce(middle / nullif(target, 0), 0)) AS share FROM k)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
  CASE WHEN copies > 0 THEN CASE kind WHEN 0 THEN least(1.0e0, share * 2 / (sqrt(greatest(2.25e0 + share * -2.0e0, 0e0)) + 1.5e0)) WHEN 1 THEN least(1.0e0, share * 2 / (sqrt(1.0e0 + share * 0e0) + 1.0e0)) ELSE least(1.0e0, share * 2 / (sqrt(0.25e0 + share * 2.0e0) + 0.5e0)) END END AS position FROM p
"""

_ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '{_ITEM_WORD}'), []) AS words FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format('text')}, '{_ITEM_WORD}') AS words FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item, n, words[p : p + n - 1] AS ws, array_to_string(ws, ' ') AS gram FROM (SELECT item, words, least(10, len(words)) AS n, unnest(generate_series(1, len(words) - least(10, len(words)) + 1)) AS p FROM i WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT r, words, n, unnest(generate_series(1, len(words) - n + 1)) AS p FROM d CROSS JOIN sizes WHERE len(words) >= n),
hit AS (SELECT r, p, pos.n, item FROM pos JOIN win ON win.n = pos.n AND win.gram = array_to_string(words[p : p + pos.n - 1], ' ')),
covered AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + n - 1)) AS q FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM hit GROUP BY r),
spot AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS q FROM d),
held AS (SELECT word, r, list(q) AS qs FROM spot WHERE word IN (SELECT unnest(words) FROM i) GROUP BY ALL),
df AS (SELECT word, count(*) AS n FROM held GROUP BY word),
spelt AS (SELECT item, gram, o, ws[o] AS word FROM (SELECT item, gram, ws, unnest(generate_series(1, n)) AS o FROM win)),
ranked AS (SELECT item, gram, word, row_number() OVER (PARTITION BY item, gram ORDER BY coalesce(df.n, 0), o) AS k FROM spelt LEFT JOIN df USING (word)),
sets AS (SELECT item, list_sort(list(DISTINCT word)) AS terms, arg_min(word, k) AS rarest FROM ranked WHERE k <= {NEAR_TERMS} GROUP BY item, gram),
kinds AS (SELECT DISTINCT terms, rarest FROM sets),
both_in AS (SELECT terms, r FROM (SELECT terms, unnest(terms) AS word FROM (SELECT DISTINCT terms FROM kinds)) JOIN held USING (word) GROUP BY terms, r HAVING count(*) = len(terms)),
start AS (SELECT DISTINCT k.terms, k.r, unnest(generate_series(greatest(q - {SLOP - 1}, 1), q)) AS s FROM (SELECT b.terms, b.r, unnest(h.qs) AS q FROM both_in b JOIN kinds USING (terms) JOIN held h ON h.word = rarest AND h.r = b.r) k),
near AS (SELECT DISTINCT s.terms, s.r FROM (SELECT terms, r, s, unnest(terms) AS word FROM start) s JOIN held h ON h.word = s.word AND h.r = s.r WHERE len(list_filter(h.qs, lambda q: q >= s.s AND q < s.s + {SLOP})) > 0 GROUP BY s.terms, s.r, s.s HAVING count(*) = len(s.terms)),
found AS (SELECT r, count(DISTINCT item) AS n_near, string_agg(DISTINCT item, ',' ORDER BY item) AS near_list FROM near JOIN sets USING (terms) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near, 0) AS n_near_items, coalesce(near_list, '') AS near_items FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r) LEFT JOIN found USING (r)
"""


def _escaped(x: str) -> str:
    from brinewell.llm.chat import ESCAPES

    for old, new in ESCAPES:
        x = f"replace({x}, '{old}', '{new}')"
    return x


OP5 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS turns,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS LAST, role, text), '') AS loss,
  sum(length({_escaped('role')}) + length({_escaped('text')}) + 13) AS formatted FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted AS BIGINT) AS formatted_chars FROM c
"""

OP8 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '{_WORD}'), []) AS words FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 3], ' ') AS gram FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 3, 1))) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_n >= 80 * (x.n + y.n - both_n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other),
low AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN low USING (doc_id)
"""

OP10 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to FROM t
"""



_TEMPLATES = ", ".join(f"('{a}', {k}, '{t}')" for a, k, t in template_rows())
_TERMS = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"

OP6 = rf"""
WITH tpl(license, template, text) AS (VALUES {_TEMPLATES}),
tt AS (SELECT license, template, term, count(*) AS n FROM (SELECT license, template, unnest({_TERMS}) AS term FROM (SELECT *, regexp_extract_all(text, '{TERM}') AS w FROM tpl)) GROUP BY ALL),
f AS (SELECT doc_id AS row, doc_id, coalesce(text, '') AS text, coalesce(contains(lower(string_split(text, chr(10))[-1]), 'licen'), false) AS is_license,
  list_filter(string_split(coalesce(source, '') || '/' || CAST(doc_id // 100 AS VARCHAR), '/'), lambda x: x <> '') AS parts, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls FROM documents),
u AS (SELECT DISTINCT row, text FROM (SELECT row, unnest(list_concat(list_concat(list_filter(ls, lambda x: regexp_matches(x, '{TRIGGER}')), list_transform(list_filter(range(1, len(ls)), lambda i: regexp_matches(ls[i], '{TRIGGER}')), lambda i: ls[i] || ' ' || ls[i + 1])), CASE WHEN is_license THEN [text] ELSE [] END)) AS text FROM f WHERE regexp_matches(text, '{TRIGGER}'))),
v AS (SELECT text, row_number() OVER () AS unit FROM (SELECT DISTINCT text FROM u)),
n AS (SELECT unit, term, count(*) AS n FROM (SELECT unit, unnest({_TERMS}) AS term FROM (SELECT unit, regexp_extract_all(lower(text), '{TERM}') AS w FROM v)) GROUP BY ALL),
idf AS (SELECT term, ln((1.0e0 + (SELECT count(*) FROM v) + (SELECT count(*) FROM tpl)) / (1 + count(*))) + 1 AS idf FROM (SELECT term FROM n UNION ALL SELECT term FROM tt) GROUP BY term),
w AS (SELECT unit, term, n * idf AS weight FROM n JOIN idf USING (term)),
norms AS (SELECT unit, sqrt(sum(weight * weight)) AS norm FROM w GROUP BY unit),
tw AS (SELECT license, template, term, n * idf AS part FROM tt JOIN idf USING (term)),
tn AS (SELECT license, template, sqrt(sum(part * part)) AS norm FROM tw GROUP BY ALL),
dots AS (SELECT unit, license, sum(weight * part) / any_value(tn.norm) AS dot FROM w JOIN tw USING (term) JOIN tn USING (license, template) GROUP BY unit, license, template),
scored AS (SELECT unit, license, round(max(dot) / any_value(norm), 4) AS cosine FROM dots JOIN norms USING (unit) GROUP BY unit, license),
own AS (SELECT row, min({{'quoted': license = '{QUOTED}', 'low': -cosine, 'license': license}}) AS own FROM scored JOIN v USING (unit) JOIN u USING (text) WHERE cosine >= {MIN_COSINE}e0 GROUP BY row),
d AS (SELECT f.*, array_to_string(parts, '/') AS dir, own FROM f LEFT JOIN own USING (row)),
holders AS (SELECT dir, min(own) AS held FROM d WHERE is_license AND own IS NOT NULL GROUP BY dir),
above AS (SELECT leaf, k, array_to_string(parts[1:k], '/') AS dir FROM (SELECT DISTINCT dir AS leaf, parts, unnest(generate_series(0, len(parts))) AS k FROM d)),
near AS (SELECT leaf, arg_max(dir, k) AS from_dir, arg_max(held, k) AS held FROM above JOIN holders USING (dir) GROUP BY leaf)
SELECT doc_id, coalesce(own.license, held.license) AS license, coalesce(-own.low, -held.low) AS cosine, CASE WHEN own IS NOT NULL THEN 'own' WHEN held IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN own IS NOT NULL THEN d.dir WHEN held IS NOT NULL THEN from_dir END AS license_dir FROM d LEFT JOIN near ON leaf = d.dir
"""


ORACLES = {"op1_quality_rules": OP1, "op3_curriculum": OP3, "op4_decontaminate": OP4, "op5_chat_format": OP5, "op6_license_scan": OP6, "op8_near_dedup": OP8, "op10_warc": OP10}
