"""DuckDB text for the engine's column functions, written independently of them, and the tables that both sides bind."""

from __future__ import annotations

STOP = "('', 'a', 'an', 'the', 'and', 'of')"
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def toks(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda t: t NOT IN {STOP})"


def norm(x: str) -> str:
    return f"array_to_string({toks(x)}, ' ')"


def jac(a: str, b: str) -> str:
    """Of two token lists that are not empty."""
    return f"(len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))))"


def match(na: str, ngs: str) -> str:
    """alias_match on a normalised answer and a list of normalised aliases."""
    q = "string_split(q, ' ')"
    one = f"q <> '' AND (q = {na} OR contains(' ' || {na} || ' ', ' ' || q || ' ') OR contains(' ' || q || ' ', ' ' || {na} || ' ') OR (len({q}) >= 2 AND {jac(q, f'string_split({na}, chr(32))')} >= 0.8))"
    return f"({na} <> '' AND coalesce(len(list_filter({ngs}, lambda q: {one})) > 0, false))"


def cell(pk: str, ck: str) -> str:
    return f"('C' || coalesce({pk}, false)::INT || coalesce({ck}, false)::INT)"


def clean(x: str) -> str:
    """clean_answer where no text is wrapped in more than one pair of asterisks."""
    md = lambda s: f"regexp_replace(regexp_replace(trim({s}, {WS}), '^\\*\\*\\s*', ''), '\\s*\\*\\*$', '')"
    return f"rtrim(trim({md(f'''regexp_replace({md(x)}, '^\\s*\\**\\s*(?:final\\s+answer|final\\s+judgment|final\\s+judgement|answer)\\s*:?\\s*\\**\\s*', '', 'i')''')}, {WS}), '.!?,;:')"


LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s, {WS})), lambda s: s <> '')"

#: qa: a row a document as question, contexts' answers, gold aliases and labels, where it has any.
QA = f"""qa AS (SELECT d.doc_id AS qid, d.source AS dataset, CASE d.lang WHEN 'en' THEN 'supportive' WHEN 'fr' THEN 'conflicting' ELSE d.lang END AS relation, d.text AS question,
  ls[1] AS pk_answer, ls[-1] AS ck_answer, CASE d.doc_id % 3 WHEN 0 THEN [ls[1]] WHEN 1 THEN [ls[-1]] ELSE ['no such answer'] END AS ground_truth,
  l.quality = 1 AS pk_alias, l.toxic = 1 AS ck_alias FROM (SELECT *, {LINES} AS ls FROM documents) d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

#: routed: labelled rows with the answer that the cell routes to, normalised texts and matches.
ROUTED = f"""{QA},
r0 AS (SELECT *, {cell('pk_alias', 'ck_alias')} AS oracle_cell FROM qa WHERE pk_alias IS NOT NULL),
r1 AS (SELECT *, CASE WHEN oracle_cell IN ('C11', 'C10') THEN pk_answer WHEN oracle_cell = 'C01' THEN ck_answer ELSE 'I do not know' END AS answer, CASE WHEN qid % 2 = 0 THEN oracle_cell ELSE 'C00' END AS predicted_cell FROM r0),
r2 AS (SELECT *, {norm('answer')} AS na, list_transform(ground_truth, lambda g: {norm('g')}) AS ng, [{norm('pk_answer')}] AS np, [{norm('ck_answer')}] AS nc FROM r1),
r3 AS (SELECT *, {match('na', 'ng')} AS is_correct, {match('na', 'np')} AS eq_pk, {match('na', 'nc')} AS eq_ck FROM r2),
routed AS (SELECT *, CASE WHEN eq_pk AND eq_ck THEN 'either' WHEN eq_pk THEN 'pk_only' WHEN eq_ck THEN 'ck_only' ELSE 'abstain' END AS prov FROM r3)"""

CUBE = """count(*) AS n, count(*) FILTER (is_correct) AS correct, count(*) FILTER (prov = 'either') AS either, count(*) FILTER (prov = 'pk_only') AS pk_only, count(*) FILTER (prov = 'ck_only') AS ck_only,
count(*) FILTER (prov = 'abstain') AS abstain, count(*) FILTER (predicted_cell = 'C00') AS "pred_C00", count(*) FILTER (predicted_cell = 'C01') AS "pred_C01", count(*) FILTER (predicted_cell = 'C10') AS "pred_C10", count(*) FILTER (predicted_cell = 'C11') AS "pred_C11\""""


def ratio(a: str, b: str) -> str:
    return f"(count(*) FILTER ({a}))::DOUBLE / nullif(count(*) FILTER ({b}), 0)"


def _acc(*cells: str) -> str:
    own = "oracle_cell IN (" + ", ".join(f"'{c}'" for c in cells) + ")"
    return ratio(f"is_correct AND {own}", own)


METRICS = f"""count(*) AS n, {ratio('is_correct', 'true')} AS a1_acc, {_acc('C01', 'C11')} AS cell_acc_t, {_acc('C00', 'C10')} AS cell_acc_f, ({_acc('C01', 'C11')} + {_acc('C00', 'C10')}) / 2 AS a4_sf,
{_acc('C00')} AS b1_c00, {_acc('C01')} AS b1_c01, {_acc('C10')} AS b1_c10, {_acc('C11')} AS b1_c11, ({_acc('C01')} + {_acc('C10')}) / 2 AS a4_macro,
CASE WHEN count(predicted_cell) > 0 THEN {ratio("oracle_cell = 'C00' AND predicted_cell = 'C00'", "oracle_cell = 'C00'")} END AS b3_c00,
(count(*) FILTER (prov IN ('pk_only', 'either')))::DOUBLE / nullif(count(*) FILTER (prov IN ('pk_only', 'either')) + count(*) FILTER (prov IN ('ck_only', 'either')), 0) AS c3_mr"""

#: split: whole texts within a source, 80/10/10.
SPLIT = """g AS (SELECT DISTINCT source AS dataset, text AS "group" FROM documents),
g2 AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5('42:' || "group"), "group") AS place, count(*) OVER (PARTITION BY dataset) AS n FROM g),
split AS (SELECT dataset, "group", CASE WHEN place <= round_even(n * 0.1::DOUBLE, 0) THEN 'test' WHEN place <= round_even(n * 0.1::DOUBLE, 0) * 2 THEN 'val' ELSE 'train' END AS split FROM g2)"""
