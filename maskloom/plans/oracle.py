"""DuckDB SQL for the named queries."""

from __future__ import annotations

from maskloom.functions.checks import DNI_LETTERS
from maskloom.operators.scoring import COUNTERS

EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
CAPITALISED, SHORT = "[A-Z][a-z]{5,}", "[A-Z][a-z]+[.,]"
NAMES = "['O','B-PERSONNAME','I-PERSONNAME','B-EMAIL','I-EMAIL']"
INT = "CAST({} AS INTEGER)".format


def spans_of(table: str, keys: str, text: str, pattern: str) -> str:
    """keys, i (from 1), s, e, value of all matches of a pattern without lookarounds."""
    return f"""(SELECT {keys}, i, CAST(sum(length(g) + length(v)) OVER (PARTITION BY {keys} ORDER BY i) - length(v) AS INTEGER) AS s,
  CAST(sum(length(g) + length(v)) OVER (PARTITION BY {keys} ORDER BY i) AS INTEGER) AS e, v AS value FROM (
  SELECT {keys}, unnest(hits) AS v, unnest(gaps[1:len(hits)]) AS g, generate_subscripts(hits, 1) AS i FROM (
  SELECT {keys}, regexp_extract_all({text}, '{pattern}') AS hits, string_split_regex({text}, '{pattern}') AS gaps FROM {table})))"""


SP = """sp AS (SELECT l_orderkey AS doc, CAST(l_linenumber * 5 + l_partkey % 17 AS INTEGER) AS s, CAST(l_linenumber * 5 + l_partkey % 17 + 1 + l_suppkey % 9 AS INTEGER) AS e,
  (['ADDRESS', 'EMAIL', 'PERSONNAME', 'GIVENNAME'])[l_linenumber % 4 + 1] AS label, CASE WHEN l_partkey % 2 = 0 THEN 'regex' ELSE 'mbert' END AS source, l_suppkey AS k, l_linenumber AS ord FROM lineitem)"""


def islands(source: str, keys: str, cmp: str, where: str = "true", name: str = "isl") -> str:
    return f"""{name}0 AS (SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM {source} WHERE {where}),
{name} AS (SELECT *, sum(CASE WHEN pm IS NULL OR s {cmp} pm THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY s, e DESC ROWS UNBOUNDED PRECEDING) AS island FROM {name}0)"""


def union_of(name: str, source: str, where: str = "true") -> str:
    return islands(source, "doc", ">", where, f"{name}i") + f""",
{name} AS (SELECT doc, min(s) AS s, max(e) AS e FROM {name}i GROUP BY doc, island)"""


GOLD_PRED = f"WITH {SP}, {union_of('a', 'sp', 'k % 3 = 0')}, {union_of('b', 'sp', 'k % 3 <> 0')}"
CUT = "cut AS (SELECT a.doc, a.s AS lo, a.e AS hi, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM a JOIN b ON a.doc = b.doc AND a.s < b.e AND b.s < a.e)"
SUBTRACT = f"""{CUT},
full_cut AS (SELECT a.doc, a.s AS lo, a.e AS hi, c.s, c.e FROM a LEFT JOIN cut c ON a.doc = c.doc AND a.s = c.lo),
gap AS (SELECT doc, coalesce(lag(e) OVER (PARTITION BY doc, lo ORDER BY s), lo) AS s, coalesce(s, hi) AS e FROM full_cut
  UNION ALL SELECT doc, max(e), any_value(hi) FROM cut GROUP BY doc, lo)"""

# documents with gold and predicted spans
SCORED = f"""mail AS (SELECT doc_id AS doc, s, e, 'EMAIL' AS label FROM {spans_of('documents', 'doc_id', 'text', EMAIL)}),
gold AS (SELECT * FROM mail UNION ALL SELECT doc_id, s, e, 'PERSONNAME' FROM {spans_of('documents', 'doc_id', 'text', CAPITALISED)}),
pred AS (SELECT * FROM mail UNION ALL SELECT doc_id, s, e, 'PERSONNAME' FROM {spans_of('documents', 'doc_id', 'text', SHORT)}),
d AS (SELECT doc_id AS doc, lang, text, length(text) AS n FROM documents),
{union_of('mask', 'pred')},
{union_of('ann', 'gold')},
al AS (SELECT g.doc, g.s, g.e, g.label, length(regexp_replace(substring(d.text, g.s + 1, g.e - g.s), '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS alnum FROM gold g JOIN d USING (doc)),
hit AS (SELECT g.doc, g.s, g.e, g.label, sum(least(g.e, m.e) - greatest(g.s, m.s)) AS covered,
  sum(length(regexp_replace(substring(d.text, greatest(g.s, m.s) + 1, least(g.e, m.e) - greatest(g.s, m.s)), '[^\\p{{L}}\\p{{N}}]', '', 'g'))) AS covered_alnum
  FROM (SELECT DISTINCT * FROM gold) g JOIN d USING (doc) JOIN mask m ON m.doc = g.doc AND g.s < m.e AND m.s < g.e GROUP BY ALL),
sg AS (SELECT al.*, coalesce(h.covered, 0) AS covered, coalesce(h.covered_alnum, 0) AS covered_alnum FROM al LEFT JOIN hit h USING (doc, s, e, label)),
masked AS (SELECT doc, sum(e - s) AS masked_chars FROM mask GROUP BY doc),
inside AS (SELECT m.doc, sum(least(m.e, a.e) - greatest(m.s, a.s)) AS n FROM mask m JOIN ann a ON m.doc = a.doc AND m.s < a.e AND a.s < m.e GROUP BY m.doc),
cand AS (SELECT doc, count(*) AS n FROM pred GROUP BY doc)"""


def counts(gold: str) -> str:
    """One row per document (and gold label) with all counters."""
    return f"""g AS (SELECT {gold}, count(*) AS gold_spans, count(*) FILTER (covered = e - s) AS complete_gold_spans, count(*) FILTER (covered < e - s AND covered > 0) AS partial_gold_spans,
  count(*) FILTER (covered = 0) AS untouched_gold_spans, sum(e - s) AS gold_chars, sum(covered) AS covered_gold_chars, sum(e - s - covered) AS uncovered_gold_chars, sum(alnum) AS gold_alnum_chars,
  sum(covered_alnum) AS covered_gold_alnum_chars, sum(alnum - covered_alnum) AS leaked_gold_alnum_chars, count(*) FILTER (alnum > covered_alnum) AS gold_spans_with_alnum_leakage,
  count(*) FILTER (covered < e - s AND alnum = covered_alnum) AS nonalnum_only_incomplete_gold_spans FROM sg GROUP BY {gold}),
c AS (SELECT d.lang, g.*, d.n AS text_chars, coalesce(m.masked_chars, 0) AS masked_chars, coalesce(m.masked_chars, 0) - coalesce(i.n, 0) AS excess_masked_chars, coalesce(cand.n, 0) AS cands, d.doc AS id
  FROM d {'LEFT' if gold == 'doc' else ''} JOIN g ON g.doc = d.doc LEFT JOIN masked m ON m.doc = d.doc LEFT JOIN inside i ON i.doc = d.doc LEFT JOIN cand ON cand.doc = d.doc)"""


def total(columns: str = "") -> str:
    values = {
        "rows": "count(*)", "positive_rows": "count(*) FILTER (gold_spans > 0)", "fully_masked_positive_rows": "count(*) FILTER (gold_spans > 0 AND complete_gold_spans = gold_spans)",
        "raw_detection_candidates": "sum(cands)", "final_mask_entities": "sum(cands)", "clean_rows": "count(*) FILTER (gold_spans IS NULL)", "clean_masked_rows": "count(*) FILTER (gold_spans IS NULL AND masked_chars > 0)",
        "clean_masked_chars": "sum(masked_chars) FILTER (gold_spans IS NULL)", "clean_text_chars": "sum(text_chars) FILTER (gold_spans IS NULL)",
    }
    return ", ".join([*([columns] if columns else []), *(f"CAST(coalesce({values.get(c, f'sum({c})')}, 0) AS BIGINT) AS \"{c}\"" for c in COUNTERS)])


def ratio(a: str, b: str, name: str) -> str:
    return f"CASE WHEN {b} <> 0 THEN {a} / {b} END AS {name}"


def fold97(value: str) -> str:
    """Remainder by 97 of digits and letters."""
    return f"list_reduce([CASE WHEN ascii(c) < 58 THEN ascii(c) - 48 ELSE ascii(c) - 55 END FOR c IN string_split({value}, '')], lambda r, x: CASE WHEN x < 10 THEN (r * 10 + x) % 97 ELSE (r * 100 + x) % 97 END, 0)"


def listed(value: str, item: str, start: str = "1") -> str:
    """Sum over the characters c at places i of a value."""
    return f"list_sum([{item} FOR i IN range({start}, length({value}) + 1)])"


def probs(first: str) -> str:
    return f"[abs(CAST(x AS DOUBLE)) FOR x IN embedding[{first}:{first} + 4]]"


def winner(p: str) -> tuple[str, str]:
    return f"({NAMES})[list_position({p}, list_max({p}))]", f"list_max({p})"


def _vectors(body: str) -> str:
    return f"WITH v AS (SELECT vec_id, label, embedding, {probs('1')} AS p, {probs('6')} AS q FROM embeddings) {body}"


EXTERNAL = f"""WITH {SCORED},
own AS (SELECT doc, s, e FROM ann), hits AS (SELECT a.doc, greatest(a.s, m.s) AS s, least(a.e, m.e) AS e FROM own a JOIN mask m ON a.doc = m.doc AND a.s < m.e AND m.s < a.e),
cnt AS (SELECT doc, 'g' AS side, e - s AS chars, substring(text, s + 1, e - s) AS t FROM own JOIN d USING (doc) UNION ALL SELECT doc, 'c', e - s, substring(text, s + 1, e - s) FROM hits JOIN d USING (doc)),
k AS (SELECT doc, side, sum(chars) AS chars, sum(length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g'))) AS alnum, sum(length(regexp_replace(t, '[^\\p{{L}}]', '', 'g'))) AS letters, sum(length(regexp_replace(t, '[^\\p{{Nd}}]', '', 'g'))) AS digits FROM cnt GROUP BY doc, side),
row_ AS (SELECT d.lang, coalesce(sp.n, 0) AS gold_spans, d.n AS text_chars, coalesce(g.chars, 0) AS gold_chars, coalesce(c.chars, 0) AS covered_gold_chars, coalesce(m.masked_chars, 0) AS masked_chars, coalesce(i.n, 0) AS ins,
  coalesce(g.alnum, 0) AS gold_alnum, coalesce(c.alnum, 0) AS covered_gold_alnum, coalesce(g.letters, 0) AS gold_letters, coalesce(c.letters, 0) AS covered_gold_letters, coalesce(g.digits, 0) AS gold_digits, coalesce(c.digits, 0) AS covered_gold_digits
  FROM d LEFT JOIN (SELECT doc, count(*) AS n FROM gold GROUP BY doc) sp USING (doc) LEFT JOIN k g ON g.doc = d.doc AND g.side = 'g' LEFT JOIN k c ON c.doc = d.doc AND c.side = 'c' LEFT JOIN masked m ON m.doc = d.doc LEFT JOIN inside i ON i.doc = d.doc)
SELECT lang, count(*) AS "rows", CAST(sum(gold_spans) AS BIGINT) AS gold_spans, count(*) FILTER (gold_spans > 0) AS positive_rows, CAST(sum(text_chars) AS BIGINT) AS text_chars, CAST(sum(gold_chars) AS BIGINT) AS gold_chars,
  CAST(sum(covered_gold_chars) AS BIGINT) AS covered_gold_chars, CAST(sum(masked_chars) AS BIGINT) AS masked_chars, CAST(sum(text_chars - gold_chars) AS BIGINT) AS non_annotated_chars, CAST(sum(masked_chars - ins) AS BIGINT) AS excess_masked_chars,
  CAST(sum(gold_alnum) AS BIGINT) AS gold_alnum, CAST(sum(covered_gold_alnum) AS BIGINT) AS covered_gold_alnum, CAST(sum(gold_letters) AS BIGINT) AS gold_letters, CAST(sum(covered_gold_letters) AS BIGINT) AS covered_gold_letters,
  CAST(sum(gold_digits) AS BIGINT) AS gold_digits, CAST(sum(covered_gold_digits) AS BIGINT) AS covered_gold_digits, count(*) FILTER (gold_alnum > covered_gold_alnum) AS rows_exposed,
  round(CASE WHEN sum(gold_alnum) <> 0 THEN 100.0 * sum(covered_gold_alnum) / sum(gold_alnum) END, 9) AS coverage_pct, round(CASE WHEN sum(text_chars - gold_chars) <> 0 THEN 100.0 * sum(masked_chars - ins) / sum(text_chars - gold_chars) END, 9) AS excess_pct
FROM row_ GROUP BY lang"""

OUTSIDE = f"""WITH {SCORED}, {union_of('x', '(SELECT doc_id AS doc, s, e FROM ' + spans_of('documents', 'doc_id', 'text', '[A-Za-z]*ing') + ')')},
a AS (SELECT * FROM mask), b AS (SELECT * FROM ann), {SUBTRACT},
o AS (SELECT * FROM gap WHERE s < e), h AS (SELECT o.doc, greatest(o.s, x.s) AS s, least(o.e, x.e) AS e FROM o JOIN x ON o.doc = x.doc AND o.s < x.e AND x.s < o.e),
k AS (SELECT doc, 1 AS side, s, e FROM o UNION ALL SELECT doc, 2, s, e FROM h),
c AS (SELECT doc, side, sum(length(regexp_replace(substring(text, s + 1, e - s), '[^\\p{{L}}\\p{{N}}]', '', 'g'))) AS alnum FROM k JOIN d USING (doc) GROUP BY doc, side)
SELECT lang, CAST(coalesce(sum(alnum) FILTER (side = 1), 0) AS BIGINT) AS out_of_scope_alnum, CAST(coalesce(sum(alnum) FILTER (side = 2), 0) AS BIGINT) AS masked_alnum FROM d LEFT JOIN c USING (doc) GROUP BY lang"""

TOKENS = spans_of("documents", "doc_id", "text", r"[^\s]+")
GEOMETRY = f"""WITH {SP}, x AS (SELECT doc, CASE WHEN ord > 3 THEN 1 ELSE 0 END AS win, min(s) AS lo, max(e) AS hi FROM sp GROUP BY 1, 2),
g AS (SELECT doc, ord, min(s) AS s, max(e) AS e FROM sp WHERE k % 3 = 0 GROUP BY doc, ord),
geo AS (SELECT x.doc, win, ord, CASE WHEN e <= lo OR s >= hi THEN 'outside' WHEN s >= lo AND e <= hi THEN 'inside' ELSE 'crossing' END AS place FROM x JOIN g ON x.doc = g.doc)"""
DNI = f"substring('{DNI_LETTERS}', CAST(%s %% 23 + 1 AS INTEGER), 1)"


def _dni(value: str, number: str) -> str:
    return f"CASE WHEN {DNI % number} = right({value}, 1) THEN 'valid' ELSE 'invalid' END"


def email_sql(table: str, keys: str, text: str) -> str:
    return f'SELECT {keys}, s AS "start", e AS "end", value FROM {spans_of(table, keys, text, EMAIL)}'


OUT = 'doc, s AS "start", e AS "end"'

ORACLE_SQL: dict[str, str] = {
    "mask_regex_documents": f"SELECT doc_id, regexp_replace(text, '{EMAIL}', '[EMAIL]', 'g') AS masked_text, CAST(len(regexp_extract_all(text, '{EMAIL}')) AS INTEGER) AS n_entities FROM documents",
    "email_spans": email_sql("documents", "doc_id", "text"),
    "email_spans_conversations": email_sql("conversations", "conv_id, turn", "text"),
    "email_spans_pages": email_sql("pages", "page_id", "html"),
    "structured_fields": """SELECT o_orderkey, 17 AS "start", 26 AS "end", 'PASSPORTNUM' AS label, 'personal' AS context FROM orders
UNION ALL SELECT o_orderkey, 33, 41, 'AGE', 'personal' FROM orders""",
    "structured_mask": """SELECT o_orderkey, 'Passport number: [PASSPORTNUM], age: [AGE]. Order ' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || ' mail [EMAIL]' AS masked_text,
  2 AS structured_candidates, 1 AS protected_candidates, 3 AS final_entities FROM orders""",
    "render_adjacent": "SELECT c_custkey, '[PERSONNAME][USERNAME] bought ' || c_mktsegment AS masked_text FROM customer",
    "iban_validate": f"""WITH b AS (SELECT c_custkey, '37040044' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS body FROM customer),
v AS (SELECT c_custkey, 'DE' || CASE WHEN c_custkey % 2 = 0 THEN lpad(CAST(98 - {fold97("body || 'DE00'")} AS VARCHAR), 2, '0') ELSE '11' END || body AS iban FROM b),
m AS (SELECT *, {fold97("substring(iban, 5) || substring(iban, 1, 4)")} = 1 AS is_valid FROM v)
SELECT c_custkey, iban, is_valid, CASE WHEN is_valid THEN 'valid' ELSE 'invalid' END AS status FROM m""",
    "luhn_cards": f"""WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{{13,19}}')) AS digits, generate_subscripts(regexp_extract_all(text, '[0-9]{{13,19}}'), 1) - 1 AS nth FROM documents)
SELECT doc_id, CAST(nth AS INTEGER) AS nth, digits, {listed("digits", "CASE WHEN i % 2 = 0 THEN (CAST(reverse(digits)[i] AS INTEGER) * 2) // 10 + (CAST(reverse(digits)[i] AS INTEGER) * 2) % 10 ELSE CAST(reverse(digits)[i] AS INTEGER) END")} % 10 = 0 AS is_valid FROM h""",
    "dni_check": f"WITH v AS (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || {DNI % 'o_custkey'} AS value FROM orders) SELECT o_orderkey, value, {_dni('value', 'CAST(left(value, 8) AS BIGINT)')} AS status FROM v",
    "nie_check": f"""WITH v AS (SELECT o_orderkey, substring('XYZ', CAST(o_orderkey % 3 + 1 AS INTEGER), 1) || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') || {DNI % 'o_custkey'} AS value FROM orders)
SELECT o_orderkey, value, {_dni('value', "CAST(translate(left(value, 1), 'XYZ', '012') || substring(value, 2, 7) AS BIGINT)")} AS status FROM v""",
    "codice_fiscale_check": f"""WITH v AS (SELECT o_orderkey, 'RSSMR' || chr(CAST(65 + o_orderkey % 26 AS INTEGER)) || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || 'A' || lpad(CAST(o_orderkey % 31 + 1 AS VARCHAR), 2, '0') || 'H' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || chr(CAST(65 + o_custkey % 26 AS INTEGER)) AS value FROM orders),
t AS (SELECT *, {listed("left(value, 15)", "CASE WHEN i % 2 = 1 THEN ([1,0,5,7,9,13,15,17,19,21,1,0,5,7,9,13,15,17,19,21,2,4,18,20,11,3,6,8,12,14,16,10,22,25,24,23])[CASE WHEN ascii(value[i]) < 58 THEN ascii(value[i]) - 47 ELSE ascii(value[i]) - 54 END] WHEN ascii(value[i]) < 58 THEN ascii(value[i]) - 48 ELSE ascii(value[i]) - 65 END")} AS total FROM v)
SELECT o_orderkey, value, CASE WHEN chr(CAST(65 + total % 26 AS INTEGER)) = right(value, 1) THEN 'valid' ELSE 'invalid' END AS status FROM t""",
    "nir_check": """WITH b AS (SELECT *, '18505' || CASE WHEN o_orderkey % 5 = 0 THEN '2A' ELSE '75' END || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS body FROM orders),
n AS (SELECT *, CAST(replace(body, '2A', '19') AS BIGINT) AS number FROM b),
v AS (SELECT o_orderkey, number, body || lpad(CAST(CASE WHEN o_custkey % 2 = 0 THEN 97 - number % 97 ELSE o_custkey % 97 END AS VARCHAR), 2, '0') AS value FROM n)
SELECT o_orderkey, value, CASE WHEN 97 - number % 97 = CAST(right(value, 2) AS BIGINT) THEN 'valid' ELSE 'invalid' END AS status FROM v""",
    "steuer_idnr_check": """WITH v AS (SELECT o_orderkey, '8609' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || CAST(o_custkey % 10 AS VARCHAR) AS value FROM orders),
f AS (SELECT *, left(value, 10) AS first, [CAST(left(value, 10)[i] AS INTEGER) FOR i IN range(1, 11)] AS ds FROM v),
c AS (SELECT *, [len(list_filter(ds, lambda x: x = d)) FOR d IN range(0, 10)] AS times, list_reduce(ds, lambda p, x: (CASE WHEN (x + p) % 10 = 0 THEN 10 ELSE (x + p) % 10 END * 2) % 11, 10) AS p FROM f)
SELECT o_orderkey, value, CASE WHEN len(list_filter(times, lambda t: t > 1)) = 1 AND list_max(times) <= 3 AND NOT regexp_matches(first, '000|111|222|333|444|555|666|777|888|999')
  AND CASE WHEN (11 - p) % 11 = 10 THEN 0 ELSE (11 - p) % 11 END = CAST(value[11] AS INTEGER) THEN 'valid' ELSE 'invalid' END AS status FROM c""",
    "nino_ssn_ahv_checks": f"""WITH v AS (SELECT o_orderkey, substring('ABBGCEGBJKTN', CAST(o_orderkey % 6 * 2 + 1 AS INTEGER), 2) || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') || 'C' AS nino,
  lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS ssn, '756' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS ahv FROM orders)
SELECT *, CASE WHEN left(nino, 2) IN ('BG', 'GB', 'KN', 'NK', 'NT', 'TN', 'ZZ') THEN 'invalid' ELSE 'valid' END AS nino_status,
  CASE WHEN left(ssn, 3) IN ('000', '666') OR left(ssn, 3) >= '900' OR substring(ssn, 5, 2) = '00' OR right(ssn, 4) = '0000' THEN 'invalid' ELSE 'valid' END AS ssn_status,
  CASE WHEN {listed("ahv", "CAST(ahv[i] AS INTEGER) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END")} % 10 = 0 THEN 'valid' ELSE 'invalid' END AS ahv_status FROM v""",
    "id_detectors_registry": """SELECT o_orderkey, 3 AS "start", 12 AS "end", 'IDCARDNUM' AS label, 'es_dni_nie' AS detector FROM orders
UNION ALL SELECT o_orderkey, 18, 29, 'SOCIALNUM', 'us_ssn' FROM orders WHERE o_orderkey % 10000 <> 0
UNION ALL SELECT o_orderkey, 36, 45, 'SOCIALNUM', 'gb_nino' FROM orders""",
    "structured_dedup": f"""WITH {SP}, u AS (SELECT DISTINCT doc, s, e, label FROM sp),
r AS (SELECT *, max(e) OVER (PARTITION BY doc, label ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM u) SELECT {OUT}, label FROM r WHERE pm IS NULL OR e > pm""",
    "union_touching": f"WITH {SP}, {union_of('u', 'sp')} SELECT {OUT} FROM u",
    "union_strict": f"""WITH {SP}, {islands('sp', 'doc', '>=')} SELECT doc, min(s) AS "start", max(e) AS "end", first(label ORDER BY s, e DESC, label) AS label FROM isl GROUP BY doc, island""",
    "union_per_label": f"""WITH {SP}, {islands('sp', 'doc, label', '>=')} SELECT doc, label, min(s) AS "start", max(e) AS "end" FROM isl GROUP BY doc, label, island""",
    "union_sources": f"""WITH {SP}, {islands('sp', 'doc', '>=')} SELECT doc, min(s) AS "start", max(e) AS "end", coalesce(first(label ORDER BY s, e DESC, label) FILTER (source = 'regex'), first(label ORDER BY s, e DESC, label)) AS label,
  CASE WHEN count(DISTINCT source) > 1 THEN 'both' ELSE min(source) END AS source FROM isl GROUP BY doc, island""",
    "union_label_promotion": f"""WITH {SP}, {islands('sp', 'doc', '>')},
g AS (SELECT doc, min(s) AS s, max(e) AS e, list({{'s': s, 'e': e, 'label': label}} ORDER BY s, e DESC, label) AS items FROM isl GROUP BY doc, island)
SELECT {OUT}, list_reduce(items, lambda p, x: CASE WHEN x.s <= p.s AND p.e <= x.e AND ((x.label = 'PERSONNAME' AND p.label = 'GIVENNAME') OR (x.label = 'ADDRESS' AND p.label IN ('GIVENNAME', 'PERSONNAME'))) THEN x ELSE p END).label AS label FROM g""",
    "union_refined": f"""WITH {SP}, spr AS (SELECT * REPLACE (CASE WHEN ord = 4 THEN 'refine' ELSE source END AS source) FROM sp), {islands('spr', 'doc', '>')}
SELECT doc, min(s) AS "start", max(e) AS "end", CASE WHEN bool_or(label = 'ADDRESS') THEN 'ADDRESS' ELSE first(label ORDER BY s, e DESC, label) END AS label,
  CASE WHEN bool_or(source = 'refine') THEN 'refine' WHEN count(DISTINCT source) > 1 THEN 'both' ELSE min(source) END AS source FROM isl GROUP BY doc, island""",
    "region_split": f"""WITH {SP}, {islands('sp', 'doc', '>')},
g AS (SELECT doc, min(s) AS s, max(e) AS e, list({{'s': s, 'e': e, 'label': label}} ORDER BY s, e DESC, label) AS items FROM isl GROUP BY doc, island),
ov AS (SELECT doc, s, least(e, 60) AS e, list_reduce(items, lambda p, x: CASE WHEN x.s <= p.s AND p.e <= x.e AND ((x.label = 'PERSONNAME' AND p.label = 'GIVENNAME') OR (x.label = 'ADDRESS' AND p.label IN ('GIVENNAME', 'PERSONNAME'))) THEN x ELSE p END).label AS label FROM g WHERE s < 60),
parts AS (SELECT * FROM ov UNION ALL SELECT doc, coalesce(lag(e) OVER (PARTITION BY doc ORDER BY s), 0), s, 'ADDRESS' FROM ov UNION ALL SELECT doc, max(e), 60, 'ADDRESS' FROM ov GROUP BY doc),
m AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY doc ORDER BY s) = label THEN 0 ELSE 1 END AS new FROM parts WHERE s < e),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY s) AS run FROM m) SELECT doc, {INT('min(s)')} AS "start", {INT('max(e)')} AS "end", label FROM r GROUP BY doc, run, label""",
    "greedy_spans": f"""WITH RECURSIVE {SP}, o AS (SELECT doc, s, e, label, row_number() OVER (PARTITION BY doc ORDER BY s, e DESC, label) AS i FROM sp),
w AS (SELECT doc, s, e, label, i, true AS kept, e AS last FROM o WHERE i = 1
  UNION ALL SELECT o.doc, o.s, o.e, o.label, o.i, o.s >= w.last, CASE WHEN o.s >= w.last THEN o.e ELSE w.last END FROM w JOIN o ON o.doc = w.doc AND o.i = w.i + 1)
SELECT {OUT}, label FROM w WHERE kept""",
    "interval_intersect": f"{GOLD_PRED}, {CUT} SELECT {OUT} FROM cut",
    "interval_subtract": f"{GOLD_PRED}, {SUBTRACT} SELECT {OUT} FROM gap WHERE s < e",
    "complement_uncovered": f"WITH {SP}, {union_of('b', 'sp', 'e <= 80')}, a AS (SELECT o_orderkey AS doc, 0 AS s, 80 AS e FROM orders), {SUBTRACT} SELECT {OUT} FROM gap WHERE s < e",
    "overlap_theta_join": f"""WITH {SP} SELECT a.doc, a.s AS "start", a.e AS "end", b.s AS r_start, b.e AS r_end FROM sp a JOIN sp b ON a.doc = b.doc AND a.s < b.e AND b.s < a.e WHERE a.k % 3 = 0 AND b.k % 3 <> 0""",
    "rules_first_anti": f"""WITH {SP} SELECT {OUT}, label, source FROM sp a WHERE source = 'regex' OR NOT EXISTS (SELECT 1 FROM sp b WHERE b.source = 'regex' AND a.doc = b.doc AND a.s < b.e AND b.s < a.e)""",
    "containment_semi": f"""WITH {SP} SELECT {OUT} FROM sp a WHERE k % 3 = 0 AND EXISTS (SELECT 1 FROM sp b WHERE b.k % 3 <> 0 AND a.doc = b.doc AND b.s <= a.s AND a.e <= b.e)""",
    "span_classification": f"""WITH {SCORED} SELECT g.doc AS doc_id, g.s AS "start", g.e AS "end", g.label,
  CASE WHEN EXISTS (SELECT 1 FROM pred p WHERE p.doc = g.doc AND p.s = g.s AND p.e = g.e AND p.label = g.label) THEN 'exact_correct_label'
  WHEN EXISTS (SELECT 1 FROM pred p WHERE p.doc = g.doc AND p.s = g.s AND p.e = g.e) THEN 'exact_different_label'
  WHEN covered = g.e - g.s THEN 'fully_covered_nonexact' WHEN covered > 0 THEN 'partially_covered' ELSE 'untouched' END AS category FROM sg g""",
    "masking_report_overall": f"""WITH {SCORED}, {counts('doc')}, t AS (SELECT {total()} FROM c) SELECT *, {ratio('complete_gold_spans', 'gold_spans', 'complete_ratio')}, {ratio('covered_gold_chars', 'gold_chars', 'covered_ratio')},
  {ratio('leaked_gold_alnum_chars', 'gold_alnum_chars', 'leaked_ratio')}, {ratio('fully_masked_positive_rows', 'positive_rows', 'fully_masked_ratio')} FROM t""",
    "masking_report_by_language": f"WITH {SCORED}, {counts('doc')} SELECT {total('lang')} FROM c GROUP BY lang",
    "masking_report_by_label": f"WITH {SCORED}, {counts('doc, label')} SELECT {total('label AS gold_label')} FROM c GROUP BY label",
    "external_score": EXTERNAL,
    "out_of_scope": OUTSIDE,
    "streaming_mask_documents": f"SELECT doc_id, regexp_replace(text, '{EMAIL}', '[EMAIL]', 'g') AS masked_text, CAST(len(regexp_extract_all(text, '{EMAIL}')) AS INTEGER) AS n_entities FROM documents",
    "wilson_intervals": """WITH g AS (SELECT source, CAST(sum(quality) AS BIGINT) AS k, count(quality) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source),
r AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM g), c AS (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS m, z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS h FROM r)
SELECT source, k AS successes, n AS total, round(p, 9) AS rate, round(greatest(0, m - h), 9) AS low, round(least(1, m + h), 9) AS high FROM c""",
    "strict_prf": f"""WITH {SP}, g AS (SELECT DISTINCT doc, s, e, label FROM sp WHERE k % 5 < 3), p AS (SELECT DISTINCT doc, s, e, label FROM sp WHERE k % 5 > 1),
m AS (SELECT coalesce(g.label, p.label) AS label, count(*) FILTER (g.doc IS NOT NULL AND p.doc IS NOT NULL) AS tp, count(*) FILTER (g.doc IS NULL) AS fp, count(*) FILTER (p.doc IS NULL) AS fn
  FROM g FULL JOIN p ON g.doc = p.doc AND g.s = p.s AND g.e = p.e AND g.label = p.label GROUP BY 1),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re FROM m) SELECT label, tp, fp, fn, round(pr, 9) AS precision, round(re, 9) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 9) AS f1 FROM r""",
    "constrained_argmax_select": "WITH g AS (SELECT s_suppkey AS setting, s_suppkey * 37 % 101 AS coverage, s_suppkey * 53 % 29 AS excess FROM supplier) SELECT * FROM g WHERE excess <= 12 ORDER BY coverage DESC, excess, setting LIMIT 1",
    "window_geometry": f"{GEOMETRY} SELECT * FROM geo",
    "window_coverage": f"{GEOMETRY}, o AS (SELECT doc, ord, max(CASE WHEN place = 'inside' THEN 1 ELSE 0 END) AS ok FROM geo GROUP BY doc, ord) SELECT doc, count(*) AS spans, CAST(sum(ok) AS BIGINT) AS covered, min(ok) = 1 AS retained FROM o GROUP BY doc",
    "text_digest": "WITH p AS (SELECT h[1:2] AS p, sha256(string_agg(h, chr(10) ORDER BY h)) AS d, count(*) AS n FROM (SELECT DISTINCT sha256(text) AS h FROM documents) GROUP BY 1) SELECT sha256(string_agg(d, chr(10) ORDER BY p)) AS digest, CAST(sum(n) AS BIGINT) AS values FROM p",
    "token_windows": r"""WITH n AS (SELECT doc_id AS doc, len(regexp_extract_all(text, '[^\s]+')) AS n FROM documents), w AS (SELECT doc, n, unnest(range(0, CAST(greatest(0, ceil((n - 510) / 382)) AS BIGINT) + 1)) AS win FROM n)
SELECT doc, CAST(win AS INTEGER) AS win, CAST(win * 382 AS INTEGER) AS "first", CAST(least(510, n - win * 382) AS INTEGER) AS tokens FROM w""",
    "bio_encode": f"""WITH t AS (SELECT doc_id AS doc, i - 1 AS pos, s, e FROM {TOKENS}), sp AS (SELECT doc_id AS doc, i AS ord, s, e FROM {spans_of('documents', 'doc_id', 'text', '[A-Z][a-z]+[.,] [A-Z]?[a-z]+')}),
m AS (SELECT t.doc, t.pos, sp.ord, CASE WHEN row_number() OVER (PARTITION BY t.doc, sp.ord ORDER BY t.pos) = 1 THEN 'B-PERSONNAME' ELSE 'I-PERSONNAME' END AS tag FROM t JOIN sp ON t.doc = sp.doc AND t.s < sp.e AND sp.s < t.e),
l AS (SELECT doc, pos, arg_max(tag, ord) AS tag FROM m GROUP BY doc, pos) SELECT t.doc, coalesce(l.tag, 'O') AS tag, count(*) AS n, CAST(sum(t.pos) AS BIGINT) AS pos_sum FROM t LEFT JOIN l USING (doc, pos) GROUP BY 1, 2""",
    "bio_decode": f"""WITH t AS (SELECT doc_id AS doc, i - 1 AS pos, CASE WHEN (i - 1) % 11 <> 10 THEN s END AS s, e, (['O', 'B-EMAIL', 'I-EMAIL', 'I-IBAN', 'I-IBAN', 'B-IBAN', 'O'])[(i - 1) * doc_id % 7 + 1] AS tag FROM {TOKENS}),
l AS (SELECT *, CASE WHEN s IS NOT NULL AND tag <> 'O' THEN substring(tag, 3) END AS label FROM t), p AS (SELECT *, lag(label) OVER (PARTITION BY doc ORDER BY pos) AS prev FROM l),
r AS (SELECT *, sum(CASE WHEN label IS NULL THEN 0 WHEN tag LIKE 'B-%' OR prev IS NULL OR prev <> label THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM p)
SELECT doc, label, min(s) AS "start", max(e) AS "end" FROM r WHERE label IS NOT NULL GROUP BY doc, run, label""",
    "argmax_decode": _vectors(f"SELECT vec_id, {winner('p')[0]} AS tag, round({winner('p')[1]}, 9) AS conf FROM v"),
    "name_threshold": _vectors(f"SELECT vec_id, CASE WHEN p[2] + p[3] >= 0.2 THEN CASE WHEN p[2] >= p[3] THEN 'B-PERSONNAME' ELSE 'I-PERSONNAME' END ELSE {winner('p')[0]} END AS tag, round(CASE WHEN p[2] + p[3] >= 0.2 THEN p[2] + p[3] ELSE {winner('p')[1]} END, 9) AS conf FROM v"),
    "ensemble_mean": _vectors(f", a AS (SELECT vec_id, [(p[i] + q[i]) * CAST(0.5 AS DOUBLE) FOR i IN range(1, 6)] AS m FROM v) SELECT vec_id, {winner('m')[0]} AS tag, round({winner('m')[1]}, 9) AS conf FROM a"),
    "ensemble_union": _vectors(f", a AS (SELECT vec_id, {winner('p')[0]} AS t1, {winner('p')[1]} AS c1, {winner('q')[0]} AS t2, {winner('q')[1]} AS c2 FROM v), b AS (SELECT *, t2 = 'O' OR (t1 <> 'O' AND c1 >= c2) AS f FROM a) SELECT vec_id, CASE WHEN f THEN t1 ELSE t2 END AS tag, round(CASE WHEN f THEN c1 ELSE c2 END, 9) AS conf FROM b"),
    "min_score_spans": f"""WITH e AS (SELECT CAST(label AS BIGINT) AS doc, vec_id AS win, embedding, unnest(range(0, 12)) AS pos FROM embeddings), v AS (SELECT doc, win, pos, [abs(CAST(x AS DOUBLE)) FOR x IN embedding[pos + 1:pos + 5]] AS p FROM e),
t AS (SELECT doc, win, pos, pos * 4 AS s, pos * 4 + 3 AS e, {winner('p')[0]} AS tag, {winner('p')[1]} AS conf FROM v), l AS (SELECT *, CASE WHEN tag <> 'O' THEN substring(tag, 3) END AS label FROM t),
b AS (SELECT *, lag(label) OVER (PARTITION BY doc, win ORDER BY pos) AS prev FROM l),
r AS (SELECT *, sum(CASE WHEN label IS NULL THEN 0 WHEN tag LIKE 'B-%' OR prev IS NULL OR prev <> label THEN 1 ELSE 0 END) OVER (PARTITION BY doc, win ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM b),
w AS (SELECT doc, win, run, label, min(s) AS s, max(e) AS e, min(conf) AS conf FROM r WHERE label IS NOT NULL GROUP BY doc, win, run, label)
SELECT doc, CAST(s AS INTEGER) AS "start", CAST(e AS INTEGER) AS "end", label, round(min(conf), 9) AS conf FROM w GROUP BY doc, s, e, label""",
    "hash_topk_per_group": "WITH r AS (SELECT lang, doc_id, sha256(text) AS text_sha256, row_number() OVER (PARTITION BY lang ORDER BY sha256(text), doc_id) AS rank FROM documents) SELECT lang, doc_id, text_sha256, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20",
    "hash_sample": "SELECT doc_id, sha256(text) AS text_sha256 FROM documents ORDER BY 2, 1 LIMIT 100",
    "text_hash_antijoin": "SELECT doc_id, source FROM documents WHERE source <> 'src0' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src0')",
    "contamination_overlap": "SELECT sha256(text) AS text_sha256 FROM documents WHERE lang = 'en' INTERSECT SELECT sha256(text) FROM documents WHERE source IN ('src0', 'src1', 'src2')",
    "disjoint_check": "SELECT count(*) AS shared FROM (SELECT text FROM documents INTERSECT SELECT text FROM benchmark)",
    "conflicting_duplicate_text": "SELECT sha256(text) AS text_sha256, count(*) AS copies, count(DISTINCT source) AS signatures FROM documents GROUP BY text HAVING count(DISTINCT source) > 1",
    "dataset_summary_cube": f"""WITH r AS (SELECT source, lang, len(regexp_extract_all(text, '{SHORT}')) AS n FROM documents)
SELECT coalesce(source, '*') AS source, coalesce(lang, '*') AS lang, count(*) AS row_count, count(*) FILTER (n = 0) AS clean_rows, CAST(sum(n) AS BIGINT) AS span_count FROM r GROUP BY CUBE (source, lang)""",
    "run_ledger_guard": "SELECT DISTINCT o_orderpriority AS profile, sha256(CAST(o_custkey AS VARCHAR)) AS model_sha256 FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND o_orderpriority = CASE c_mktsegment WHEN 'BUILDING' THEN '1-URGENT' WHEN 'AUTOMOBILE' THEN '2-HIGH' ELSE '3-MEDIUM' END)",
}
