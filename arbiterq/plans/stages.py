"""Queries of the model stages (with deterministic providers, which SQL can say as well), the builders, and what joins over several tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sql
from ..functions import text as T
from ..functions import vector as V
from ..operators import build as B
from ..operators import infer as I
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import embed, job, probe, states
from ..operators import sampling as S
from ..sources import records
from ..sources.sinks import scratch
from . import twins as W
from .bindings import featured, qa, table
from .catalogue import query

# ---- providers in SQL

_WORDS = "list_filter(string_split_regex({}, '\\s+'), lambda s: s <> '')"
_LABEL = "[\\p{{L}}\\p{{N}}_]+:".replace("{{", "{").replace("}}", "}")


def _limited(x: str) -> str:
    """A prompt's content in its 4,096 tokens."""
    t = _WORDS.format(x)
    return f"(CASE WHEN len({t}) > 4096 THEN array_to_string(list_concat(({t})[1:512], ({t})[-3584:]), ' ') ELSE {x} END)"


def _echo(x: str, most: int = 64) -> str:
    """The words that ``Echo`` replies with to a content."""
    lines = f"list_filter(string_split({x}, chr(10)), lambda s: trim(s, {W.WS}) <> '' AND NOT regexp_full_match(s, '{_LABEL}\\s*'))"
    return f"({_WORDS.format(f'''regexp_replace(coalesce(({lines})[-1], ''), '^{_LABEL} ', '')''')})[1:{most}]"


def _digest(x: str, *words: str) -> str:
    """The word that ``Digest`` replies with to a content."""
    at = f"((strpos('0123456789abcdef', md5({x})[1]) - 1) * {len(words)}) // 16 + 1"
    return f"([{', '.join(repr(w) for w in words)}])[{at}]"


def _rows(spark, sf) -> DataFrame:
    return qa(spark, sf).select("qid", "dataset", F.col("pk_answer").alias("question"), F.col("ck_answer").alias("ck_text"), "pk_answer", "ck_answer", "ground_truth")


def _once(df: DataFrame) -> DataFrame:
    """A narrow table that several stages read, written once: texts are cut into lines once, not for each reading."""
    at = scratch(df.sparkSession, "rows")
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


_ROWS = f"{W.QA}, rows AS (SELECT qid, dataset, coalesce(pk_answer, '') AS question, coalesce(ck_answer, '') AS ck_text, coalesce(pk_answer, '') AS pk, coalesce(ck_answer, '') AS ck, ground_truth FROM qa)"


_LABELLED = f"""WITH {_ROWS}, o AS (SELECT * REPLACE (CASE WHEN qid % 9 > 0 THEN ck_text ELSE '' END AS ck_text) FROM rows), a AS (SELECT *, array_to_string({_echo(_limited("'Question: ' || question || chr(10) || 'Answer:'"))}, ' ') AS pk_answer,
 CASE WHEN ck_text = '' THEN '' ELSE array_to_string({_echo(_limited("'Passage: ' || ck_text || chr(10) || 'Question: ' || question || chr(10) || 'Answer:'"))}, ' ') END AS ck_answer FROM o),
b AS (SELECT *, {W.norm('pk_answer')} AS np, {W.norm('ck_answer')} AS nc, list_transform(ground_truth, lambda g: {W.norm('g')}) AS ng FROM a),
c AS (SELECT *, {W.match('np', 'ng')} AS pk_correct, {W.match('nc', 'ng')} AS ck_correct FROM b)"""


@query(_LABELLED + f" SELECT qid, md5(pk_answer) AS pk_answer, md5(ck_answer) AS ck_answer, pk_correct, ck_correct, {W.cell('pk_correct', 'ck_correct')} AS cell FROM c")
def infer_provider(spark, sf):
    rows = _rows(spark, sf).select("qid", "question", F.when(F.col("qid") % 9 > 0, F.col("ck_text")).otherwise("").alias("ck_text"), "ground_truth")
    out = I.labelled(_once(rows), spark.createDataFrame([], "question_hash string, pk_answer string"), I.Echo)
    return out.select("qid", F.md5("pk_answer").alias("pk_answer"), F.md5("ck_answer").alias("ck_answer"), "pk_correct", "ck_correct", "cell")


@query(f"WITH {_ROWS}, q AS (SELECT DISTINCT question FROM rows), k AS (SELECT * FROM (VALUES (42), (43)) AS v(seed)) SELECT seed::INT AS seed, count(*) AS n, sum(len({_echo(_limited('question'), 8)}))::BIGINT AS completion_tokens FROM q, k GROUP BY 1")
def call_ledger(spark, sf):
    """Two seeds asked of every row through one ledger, twice: it has an entry a different question and seed."""
    ledger, each = I.Ledger(scratch(spark, "ledger")), F.explode(F.array(F.lit(42), F.lit(43)))
    own = _rows(spark, sf).select(I.limited(T.text("question")).alias("prompt"), each.alias("seed"))
    for _ in range(2):
        got = ledger.asked(own, "prompt", I.Echo, model=F.concat(F.lit("stub-"), F.col("seed").cast("string")), seed=F.col("seed"), max_tokens=8)
    seeds = ledger.entries(spark).groupBy(F.substring("model_used", 6, 2).cast("int").alias("seed")).agg(F.count("*").alias("n"), F.sum("completion_tokens").alias("completion_tokens"))
    return seeds.join(got.select("seed").distinct(), "seed")


_SORTED = "list_transform(list_sort(list_transform({w}, lambda s: md5('{seed}:' || s) || s)), lambda s: s[33:])"


@query(f"WITH {_ROWS}, p AS (SELECT qid, 'PK' AS side, {_echo(_limited('question'))} AS w FROM rows UNION ALL SELECT qid, 'CK', {_echo(_limited('ck_text || chr(10) || question'))} FROM rows), k AS (SELECT * FROM (VALUES (1, 0.0, 42), (2, 0.7, 43), (3, 0.9, 44)) AS v(k, t, seed)) "
       f"SELECT qid, side, k.k::INT AS k, k.t::DOUBLE AS temperature, k.seed::INT AS seed, md5(array_to_string(CASE k.k WHEN 1 THEN w WHEN 2 THEN {_SORTED.format(w='w', seed=43)} ELSE {_SORTED.format(w='w', seed=44)} END, ' ')) AS trace, len(w)::INT AS n_tok FROM p, k")  # fmt: skip
def traces(spark, sf):
    out = I.traced(_rows(spark, sf), I.Echo)
    return out.withColumn("trace", F.md5("trace"))


_SAID = ("True", "False", "Perhaps")


def _coin() -> I.Digest:
    return I.Digest(_SAID)


def _choice(said: str, first: str, second: str) -> str:
    return f"CASE {said} WHEN 'True' THEN {first} WHEN 'False' THEN {second} ELSE ck END"


_ASKED = {
    "internal_eval": "'Question: ' || question || chr(10) || 'Answer: ' || pk",
    "context_eval": "'Passage: ' || ck_text || chr(10) || 'Question: ' || question",
    "implicit_scr": "'Passage: ' || ck_text || chr(10) || 'Question: ' || question",
    "explicit_scr": "'Own answer: ' || pk || chr(10) || 'Passage: ' || ck_text || chr(10) || 'Passage''s answer: ' || ck || chr(10) || 'Question: ' || question",
}
_R = {m: _digest(_limited(x), *_SAID) for m, x in _ASKED.items()}
_FILTERED = _digest(_limited("'Question: ' || question || chr(10) || 'Passage: ' || ck_text"), *_SAID)
_BASELINES = f"""WITH {_ROWS}, r AS (SELECT *, {', '.join(f'{x} AS r_{m}' for m, x in _R.items())}, {_FILTERED} AS r_filter FROM rows),
f AS (SELECT *, {_digest(_limited("r_filter || chr(10) || chr(10) || 'Question: ' || question"), *_SAID)} AS r_tacs FROM r),
u AS (SELECT qid, dataset, 'closed_book' AS method, pk AS final_answer, 'use_PK' AS predicted_source, NULL AS judge_response, NULL::BOOLEAN AS judge_decision FROM f UNION ALL SELECT qid, dataset, 'dia', ck, 'use_CK', NULL, NULL FROM f
UNION ALL SELECT qid, dataset, 'internal_eval', {_choice('r_internal_eval', 'pk', 'ck')}, CASE r_internal_eval WHEN 'True' THEN 'use_PK' ELSE 'use_CK' END, r_internal_eval, CASE r_internal_eval WHEN 'True' THEN true WHEN 'False' THEN false END FROM f
UNION ALL SELECT qid, dataset, 'context_eval', {_choice('r_context_eval', 'ck', 'pk')}, CASE r_context_eval WHEN 'False' THEN 'use_PK' ELSE 'use_CK' END, r_context_eval, CASE r_context_eval WHEN 'True' THEN true WHEN 'False' THEN false END FROM f
UNION ALL SELECT qid, dataset, 'implicit_scr', r_implicit_scr, NULL, NULL, NULL FROM f UNION ALL SELECT qid, dataset, 'explicit_scr', r_explicit_scr, NULL, NULL, NULL FROM f UNION ALL SELECT qid, dataset, 'tacs_lr', r_tacs, NULL, NULL, NULL FROM f)"""


@query(_BASELINES + " SELECT qid, dataset, method, md5(final_answer) AS final_answer, predicted_source, judge_response, judge_decision FROM u")
def baselines(spark, sf):
    out = I.all_answered(_once(_rows(spark, sf).drop("ground_truth")), _coin)
    return out.select("qid", "dataset", "method", F.md5("final_answer").alias("final_answer"), "predicted_source", "judge_response", "judge_decision")


_EVALUATED = ("closed_book", "dia", "internal_eval", "context_eval")
_SAID_BY = {
    "closed_book": "pk",
    "dia": "ck",
    "internal_eval": _choice(_R["internal_eval"], "pk", "ck"),
    "context_eval": _choice(_R["context_eval"], "ck", "pk"),
}
_JOB = f"""{_LABELLED},
l AS (SELECT * REPLACE (pk_answer AS pk, ck_answer AS ck), {W.cell('pk_correct', 'ck_correct')} AS oracle_cell FROM c),
g AS (SELECT DISTINCT dataset, question FROM l),
g2 AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5('42:' || question), question) AS place, count(*) OVER (PARTITION BY dataset) AS n FROM g),
s AS (SELECT dataset AS d, question AS q, CASE WHEN place <= round_even(n * 0.1::DOUBLE, 0) THEN 'test' WHEN place <= round_even(n * 0.1::DOUBLE, 0) * 2 THEN 'val' ELSE 'train' END AS split FROM g2),
m AS ({' UNION ALL '.join(f"SELECT *, '{m}' AS method, {x} AS answer FROM l" for m, x in _SAID_BY.items())}),
n AS (SELECT m.*, split, {W.norm('answer')} AS na, [{W.norm('pk')}] AS lp, [{W.norm('ck')}] AS lc FROM m JOIN s ON question = q AND dataset IS NOT DISTINCT FROM d),
t AS (SELECT *, {W.match('na', 'ng')} AS is_correct, {W.match('na', 'lp')} AS eq_pk, {W.match('na', 'lc')} AS eq_ck, NULL::VARCHAR AS predicted_cell FROM n),
e AS (SELECT *, CASE WHEN eq_pk AND eq_ck THEN 'either' WHEN eq_pk THEN 'pk_only' WHEN eq_ck THEN 'ck_only' ELSE 'abstain' END AS prov FROM t)"""


@query(f"{_JOB} SELECT method, CASE WHEN grouping(split) = 1 THEN 'ALL_AGG' ELSE split END AS split, {W.METRICS} FROM e GROUP BY GROUPING SETS ((method, split), (method))")
def evaluation_job(spark, sf):
    """From rows to the report in kept steps: labels and their gate, split, four methods' answers, metrics by method and split."""
    rows = _rows(spark, sf).select("qid", "dataset", T.text("question").alias("question"), F.when(F.col("qid") % 9 > 0, T.text("ck_text")).otherwise("").alias("ck_text"), "ground_truth")
    return job.evaluation(_once(rows), scratch(spark, "job"), I.Echo, _coin, methods=_EVALUATED, config={"rows": sf}).run(spark)["report"]


_JUDGE = "'Right answers, any of which will do: ' || gold || chr(10) || 'Given answer: ' || trim({c}, " + W.WS + ") || chr(10) || 'Does the given answer say one of the right ones? Reply YES or NO.'"
_JUDGED = f"""WITH {W.QA}, b AS (SELECT qid, coalesce(pk_answer, '') AS pk, CASE WHEN qid % 5 = 0 THEN '' ELSE coalesce(ck_answer, '') END AS ck, pk_alias, ck_alias, qid % 7 = 0 AS seen, array_to_string(list_filter(ground_truth, lambda g: g <> ''), ' | ') AS gold FROM qa WHERE pk_alias IS NOT NULL),
c AS (SELECT *, CASE WHEN trim(pk, {W.WS}) = '' THEN 'empty_candidate' ELSE {_digest(_JUDGE.format(c='pk'), 'YES', 'NO')} END AS pr, CASE WHEN trim(ck, {W.WS}) = '' THEN 'empty_candidate' ELSE {_digest(_JUDGE.format(c='ck'), 'YES', 'NO')} END AS cr FROM b)"""


def _behaviour(spark, sf) -> DataFrame:
    own = qa(spark, sf).where("pk_alias is not null")
    seen = F.col("qid") % 7 == 0
    none = F.lit(None).cast("string")
    return own.select(
        "qid", F.lit("m").alias("model_key"), T.text("pk_answer").alias("pk_answer"), F.when(F.col("qid") % 5 == 0, "").otherwise(T.text("ck_answer")).alias("ck_answer"), F.col("pk_alias").alias("pk_correct_alias"), F.col("ck_alias").alias("ck_correct_alias"),
        F.when(seen, True).alias("pk_correct_judge"), F.when(seen, False).alias("ck_correct_judge"), F.when(seen, "YES").alias("pk_judge_response"), F.when(seen, "NO").alias("ck_judge_response"), F.when(seen, "earlier").alias("judge_model"), none.alias("judge_extracted_at"),
        F.col("pk_alias").alias("pk_correct"), F.when(seen, False).otherwise(F.col("ck_alias")).alias("ck_correct"), F.when(seen, "alias_and_judge").otherwise("alias").alias("pk_correct_source"), F.when(seen, "alias_and_judge").otherwise("alias").alias("ck_correct_source"), "ground_truth",
    )


@query(_JUDGED + """ SELECT qid, CASE WHEN seen THEN 'YES' ELSE pr END AS pk_judge_response, CASE WHEN seen THEN 'NO' ELSE cr END AS ck_judge_response, CASE WHEN seen THEN true ELSE pr = 'YES' END AS pk_correct_judge, CASE WHEN seen THEN false ELSE cr = 'YES' END AS ck_correct_judge,
 CASE WHEN seen THEN pk_alias ELSE pk_alias AND pr = 'YES' END AS pk_correct, CASE WHEN seen THEN false ELSE ck_alias AND cr = 'YES' END AS ck_correct, 'alias_and_judge' AS pk_correct_source, CASE WHEN seen THEN 'earlier' ELSE 'judge' END AS judge_model FROM c""")
def judge_stage(spark, sf):
    own = _behaviour(spark, sf)
    out = I.judged(own.drop("ground_truth"), own.select("qid", "ground_truth"), I.Digest)
    return out.select("qid", "pk_judge_response", "ck_judge_response", "pk_correct_judge", "ck_correct_judge", "pk_correct", "ck_correct", "pk_correct_source", "judge_model")


# ---- calls, lengths, totals


@query("""WITH c AS (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN '429' WHEN event_id % 7 = 1 THEN '' END AS error, value, event_id % 100 AS pt, event_id % 10 AS ct, (event_id % 8) * 0.25::DOUBLE AS cost FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM c WHERE coalesce(error, '') = '' AND value IS NOT NULL),
q AS (SELECT event_type, round(avg(value), 6) AS mean, max(value) FILTER (place = n // 2) AS p50, max(value) FILTER (place = least(floor(n * 0.95::DOUBLE), n - 1)) AS p95 FROM k GROUP BY 1)
SELECT event_type, count(*) AS calls, count(*) FILTER (coalesce(error, '') <> '') AS errors, sum(pt)::BIGINT AS prompt_tokens, sum(ct)::BIGINT AS completion_tokens, sum(cost) AS cost_usd, any_value(q.mean) AS mean, any_value(q.p50) AS p50, any_value(q.p95) AS p95 FROM c JOIN q USING (event_type) GROUP BY 1""")
def call_summary(spark, sf):
    i = F.col("event_id")
    calls = table(spark, sf, "events").select("event_type", F.when(i % 7 == 0, "429").when(i % 7 == 1, "").alias("error"), F.col("value").alias("latency_sec"), (i % 100).alias("prompt_tokens"), (i % 10).alias("completion_tokens"), ((i % 8) * F.lit(0.25)).alias("cost_usd"))
    return M.call_summary(calls, "event_type").withColumn("mean", F.round("mean", 6))


@query("SELECT source, count(*) AS n, count(*) FILTER (n_chars > 1000) AS n_truncated, (count(*) FILTER (n_chars > 1000))::DOUBLE / count(*) AS truncation_rate FROM documents GROUP BY 1")
def truncation_rate(spark, sf):
    return M.truncation(table(spark, sf, "documents").select("source", (F.col("n_chars") > 1000).alias("truncated")), "truncated", "source")


@query("WITH s AS (SELECT o_orderstatus, count(*) AS n_rows, count(*) FILTER (o_totalprice > 100000) AS n_dear FROM orders GROUP BY 1) SELECT count(*) AS n_datasets, sum(n_rows)::BIGINT AS n_rows, sum(n_dear)::BIGINT AS n_dear FROM s")
def build_totals(spark, sf):
    own = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"), F.count_if(F.col("o_totalprice") > 100000).alias("n_dear"))
    return B.build_totals(own)


@query("SELECT source AS dataset, md5(text) AS question, list_sort(list(doc_id)) AS qids FROM documents GROUP BY source, text")
def qids_by_question(spark, sf):
    out = S.groups_of(table(spark, sf, "documents"), "source", "text", "doc_id")
    return out.select("dataset", F.md5("group").alias("question"), F.col("keys").alias("qids"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '—' ELSE printf('%.3f', p_retailprice) END AS price, p_size::VARCHAR AS size FROM part")
def shown_values(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.shown(F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice"))).alias("price"), T.shown("p_size", "int").alias("size"))


# ---- joins over several tables

_ANSWERS = f"""{W.ROUTED}, e AS (SELECT *, CASE WHEN qid % 2 = 0 THEN 'm1' ELSE 'm2' END AS method, 'b' AS backbone FROM routed WHERE qid % 3 <> 1)"""


def _parts(spark, sf):
    """Answers, rows and behaviour in tables of their own; behaviour lacks a third of the answers."""
    own = qa(spark, sf).where("pk_alias is not null").withColumn("answer", F.when(F.col("pk_alias"), F.col("pk_answer")).when(F.col("ck_alias"), F.col("ck_answer")).otherwise("I do not know"))
    answers = own.select("qid", "dataset", F.when(F.col("qid") % 2 == 0, "m1").otherwise("m2").alias("method"), F.lit("b").alias("backbone"), "answer")
    rows = own.select("qid", "ground_truth", F.col("relation").alias("ck_relation"))
    behaviour = own.where("qid % 3 <> 1").select("qid", F.lit("b").alias("model_key"), "pk_answer", "ck_answer", F.col("pk_alias").alias("pk_correct_alias"), F.col("ck_alias").alias("ck_correct_alias"))
    return answers, rows, behaviour


def _report(df: DataFrame) -> DataFrame:
    from ..functions.cells import cell

    return df.withColumn("oracle_cell", cell("pk_correct_alias", "ck_correct_alias")).withColumn("predicted_cell", F.when(F.col("qid") % 2 == 0, F.col("oracle_cell")).otherwise("C00"))


@query(f"WITH {_ANSWERS} SELECT method, backbone, CASE WHEN grouping(dataset) = 1 THEN 'ALL_AGG' ELSE dataset END AS dataset, {W.METRICS} FROM e GROUP BY GROUPING SETS ((method, backbone, dataset), (method, backbone))")
def evaluation_report(spark, sf):
    return M.report(_report(J.evaluated(*_parts(spark, sf))))


@query(f"""WITH {W.QA} SELECT qid, CASE WHEN qid % 4 = 0 THEN 0 ELSE len(ground_truth) END AS n_gold, CASE WHEN qid % 3 = 1 THEN 'C00' ELSE {W.cell('pk_alias', 'ck_alias')} END AS cell FROM qa WHERE pk_alias IS NOT NULL""")
def evaluation_outer(spark, sf):
    from ..functions.cells import cell

    answers, rows, behaviour = _parts(spark, sf)
    out = J.evaluated_outer(answers, rows.where("qid % 4 <> 0"), behaviour)
    return out.select("qid", F.size("ground_truth").cast("long").alias("n_gold"), cell("pk_correct_alias", "ck_correct_alias").alias("cell"))


@query("SELECT doc_id AS qid, source AS dataset, CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM documents WHERE doc_id % 4 <> 0 AND source <> (SELECT min(source) FROM documents)")
def split_lookup(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("qid"), F.col("source").alias("dataset"))
    first = rows.agg(F.min("dataset").alias("first"))
    named = rows.where("qid % 4 <> 0").join(F.broadcast(first), F.col("dataset") != F.col("first"), "left_semi")  # one row
    return J.in_split(rows, named.withColumn("split", F.when(F.col("qid") % 10 == 0, "test").otherwise("train")))


@query("""WITH t AS (SELECT conv_id AS qid, CASE role WHEN 'user' THEN 'PK' WHEN 'assistant' THEN 'CK' END AS side, max(text) AS trace FROM conversations WHERE role <> 'system' GROUP BY 1, 2)
SELECT p.qid, d.source AS dataset, md5(p.trace) AS pk_trace, md5(c.trace) AS ck_trace, l.quality = 1 AS pk FROM t p JOIN t c ON p.qid = c.qid AND p.side = 'PK' AND c.side = 'CK' JOIN documents d ON d.doc_id = p.qid JOIN labels l ON l.doc_id = p.qid""")
def trace_pivot_join(spark, sf):
    side = F.when(F.col("role") == "user", "PK").when(F.col("role") == "assistant", "CK")
    said = table(spark, sf, "conversations").where("role <> 'system'").groupBy(F.col("conv_id").alias("qid"), side.alias("side")).agg(F.max("text").alias("trace")).withColumn("k", F.lit(1))
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("qid"), F.col("source").alias("dataset"), F.col("text").alias("question"), F.col("lang").alias("ck_text"))
    marks = table(spark, sf, "labels").select(F.col("doc_id").alias("qid"), (F.col("quality") == 1).alias("pk_correct_alias"), (F.col("toxic") == 1).alias("ck_correct_alias"))
    out = J.trace_rows(said, rows, marks, 1)
    return out.select("qid", "dataset", F.md5("pk_trace").alias("pk_trace"), F.md5("ck_trace").alias("ck_trace"), F.col("pk_correct_alias").alias("pk"))


@query("WITH x AS (SELECT vec_id AS qid, label AS layer, embedding[1] AS v FROM embeddings WHERE vec_id % 3 <> 0), y AS (SELECT vec_id // 2 AS qid, label AS layer, embedding[2] AS v, row_number() OVER (PARTITION BY vec_id // 2, label ORDER BY vec_id) AS place FROM embeddings) SELECT qid, v FROM x WHERE layer = 3 UNION ALL SELECT qid, v FROM y WHERE layer = 3 AND place = 1 AND qid NOT IN (SELECT qid FROM x WHERE layer = 3)")
def layer_first_wins(spark, sf):
    e = table(spark, sf, "embeddings")
    canonical = e.where("vec_id % 3 <> 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("layer"), F.get("embedding", F.lit(0)).alias("v"))
    shards = J.first_wins(e.select(F.floor(F.col("vec_id") / 2).alias("qid"), F.col("label").alias("layer"), F.get("embedding", F.lit(1)).alias("v"), "vec_id"), ["qid", "layer"], "vec_id").drop("vec_id")
    return records.layer_of(canonical, shards, 3).select("qid", "v")


# ---- vectors


@query("SELECT a.vec_id, a.label = b.label OR list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.05 AS hit FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def semantic_match(spark, sf):
    e = table(spark, sf, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.array(F.col("label").cast("string")).alias("aliases"), F.array("embedding").alias("vs"))
    return e.join(other, "vec_id").select("vec_id", V.semantic_match(F.col("label").cast("string"), "aliases", "embedding", "vs", 0.05).alias("hit"))


@query("SELECT vec_id, list_transform(range(1, 9), lambda i: round((embedding[i + 16]::DOUBLE + embedding[i + 24]::DOUBLE + embedding[i + 32]::DOUBLE) / 3, 6)) AS pooled, list_concat(embedding[1:2], embedding[9:10])::DOUBLE[] AS put FROM embeddings")
def span_and_concat(spark, sf):
    e = table(spark, sf, "embeddings")
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    return e.select("vec_id", F.transform(V.span_mean(tokens, F.lit(2), F.lit(5)), lambda x: V.rounded(x)).alias("pooled"), V.concat_features(F.slice("embedding", 1, 2), F.slice("embedding", 9, 2)).alias("put"))


# ---- builders


def _gold(g: str) -> str:
    return f"list_transform({g}, lambda g: {W.norm('g')})"



def _part(spark, sf) -> DataFrame:
    return table(spark, sf, "part").withColumn("raw_idx", F.col("p_partkey"))


@query(f"""WITH r AS (SELECT p_partkey AS i, p_name AS orig, p_type AS cf, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand END AS c1, p_type || ' ' || p_name AS c2, CASE WHEN p_brand = p_name THEN [p_name] ELSE [p_name, p_brand] END AS gold, p_size % 3 AS h FROM part),
x AS (SELECT *, unnest(['sup', 'conf']) AS s FROM r WHERE orig <> '' AND cf <> ''), y AS (SELECT *, CASE s WHEN 'sup' THEN orig ELSE cf END AS target FROM x), z AS (SELECT *, {W.norm('target')} AS nt, {_gold('gold')} AS ng FROM y)
SELECT format('pairs-x-{{:06d}}-{{:s}}', i, s) AS qid, CASE s WHEN 'sup' THEN 'supportive' ELSE 'conflicting' END AS ck_relation, CASE s WHEN 'sup' THEN CASE WHEN c1 = '' THEN 'piece' ELSE c1 END ELSE c2 END AS ck_text, gold AS ground_truth, {W.match('nt', 'ng')} AS ck_target_matches_gt, CASE h WHEN 0 THEN 2 WHEN 1 THEN 1 END AS hop_count, '["' || cf || '"]' AS cf_alias FROM z""")
def build_counterfactual(spark, sf):
    h = F.col("p_size") % 3
    raw = _part(spark, sf).select(
        "raw_idx", F.lit("which").alias("question"), F.col("p_name").alias("orig_answer"), F.col("p_type").alias("cf_answer"), F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_brand")).alias("orig_context"), F.lit("piece").alias("orig_context_piece"),
        F.concat_ws(" ", "p_type", "p_name").alias("cf_context"), F.lit("").alias("cf_context_piece"), F.array("p_brand", "p_name").alias("orig_alias"), F.array("p_type").alias("cf_alias"),
        F.when(h == 0, """[["it's", 'b'], ('c', "d, [e]")]""").when(h == 1, "['x']").otherwise("f(x)").alias("orig_path"), F.lit(None).cast("string").alias("orig_path_labeled"), F.lit(None).cast("string").alias("cf_path_labeled"),
    )
    return B.counterfactual_pairs(raw, "pairs-x").select("qid", "ck_relation", "ck_text", "ground_truth", "ck_target_matches_gt", "hop_count", F.col("metadata")["cf_alias"].alias("cf_alias"))


@query(f"""WITH r AS (SELECT o_orderkey AS i, o_orderpriority AS gold, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'NONE' END AS mem, 'LOW' AS ctr, o_orderkey % 5 = 0 AS two FROM orders WHERE o_orderkey % 11 <> 0),
x AS (SELECT *, unnest(['param', 'counter']) AS s FROM r), y AS (SELECT *, CASE WHEN two THEN [gold, 'LOW'] ELSE [gold] END AS g, CASE s WHEN 'param' THEN mem ELSE ctr END AS target FROM x), z AS (SELECT *, {W.norm('target')} AS nt, {_gold('g')} AS ng FROM y)
SELECT format('mem-{{:06d}}-{{:s}}', i, s) AS qid, CASE WHEN {W.match('nt', 'ng')} THEN 'supportive' ELSE 'conflicting' END AS ck_relation, target AS ck_target_answer, g AS ground_truth, CASE s WHEN 'param' THEN 'parametric_memory_aligned_evidence' ELSE 'counter_memory_aligned_evidence' END AS field, 'm' AS source_model FROM z""")
def build_memory(spark, sf):
    i, gold = F.col("o_orderkey"), F.col("o_orderpriority")
    raw = table(spark, sf, "orders").select(
        i.alias("raw_idx"), F.when(i % 11 == 0, "").otherwise("which").alias("question"), F.when(i % 5 == 0, F.to_json(F.array(F.concat(F.lit(" "), gold), F.lit(""), F.lit("LOW")))).otherwise(gold).alias("ground_truth"), F.when(i % 2 == 0, gold).otherwise("NONE").alias("memory_answer"), F.lit(" LOW ").alias("counter_answer"),
        F.lit("a").alias("parametric_memory_aligned_evidence"), F.lit("b").alias("counter_memory_aligned_evidence"), F.lit(None).cast("string").alias("popularity"), F.lit("s").alias("subj"), F.lit("p").alias("property"),
    )
    return B.memory_pairs(raw, "mem", source_model="m").select("qid", "ck_relation", "ck_target_answer", "ground_truth", F.col("metadata")["ck_source_field"].alias("field"), "source_model")


@query("""WITH r AS (SELECT p_partkey AS i, p_brand AS obj, p_type AS rep, p_size % 7 AS n, p_size % 3 AS m FROM part WHERE p_size % 7 > 0), x AS (SELECT *, unnest(['', 'misinformation', 'temporal', 'semantic']) AS k FROM r),
y AS (SELECT *, CASE k WHEN '' THEN 'default' WHEN 'misinformation' THEN CASE WHEN m = 0 THEN '' ELSE 'mis' END WHEN 'temporal' THEN 'temp' ELSE CASE WHEN m = 1 THEN NULL ELSE 'sem' END END AS said FROM x)
SELECT format('ev-{:07d}-{:s}', i, CASE k WHEN '' THEN 'sup' ELSE 'conf_' || k END) AS qid, said AS ck_text, CASE k WHEN '' THEN obj ELSE rep END AS ck_target_answer, CASE WHEN n BETWEEN 2 AND 5 THEN 'mc-' || n ELSE 'open' END AS question_format, nullif(k, '') AS ck_sub_type, CASE k WHEN 'temporal' THEN '["1","2"]' END AS span, CASE k WHEN 'temporal' THEN 'said' ELSE '' END AS claim FROM y WHERE coalesce(said, '') <> ''""")
def build_evidence(spark, sf):
    m, n = F.col("p_size") % 3, F.col("p_size") % 7
    none = F.lit(None).cast("string")
    notes = [F.lit("x").alias(c) for c in B.NOTES]
    raw = _part(spark, sf).select(
        "raw_idx", F.lit("which").alias("question"), F.array_repeat(F.lit("o"), n).alias("options"), F.concat(F.lit(" "), "p_brand").alias("object"), F.col("p_type").alias("replaced_object"), *notes, F.lit("default").alias("default_evidence"), none.alias("default_claim"), none.alias("default_evidence_category"),
        F.when(m == 0, "").otherwise("mis").alias("misinformation_conflict_evidence_evidence"), none.alias("misinformation_conflict_claim"), none.alias("misinformation_conflict_evidence_category"), F.lit("temp").alias("temporal_conflict_evidence"), F.lit("said").alias("temporal_conflict_claim"), none.alias("temporal_conflict_evidence_category"),
        F.array(F.lit("1"), F.lit("2")).alias("temporal_conflict_time_span"), F.when(m != 1, "sem").alias("semantic_conflict_evidence"), none.alias("semantic_conflict_claim"), none.alias("semantic_conflict_evidence_category"),
    )
    return B.evidence_variants(raw, "ev").select("qid", "ck_text", "ck_target_answer", "question_format", "ck_sub_type", F.col("metadata")["ck_extra"].alias("span"), F.col("metadata")["ck_claim"].alias("claim"))


@query(f"""WITH r AS (SELECT c_custkey AS i, c_name AS a, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS ca, c_mktsegment AS wa FROM customer WHERE c_custkey % 6 <> 0), x AS (SELECT *, unnest(['sup', 'conf']) AS s FROM r), y AS (SELECT *, CASE s WHEN 'sup' THEN ca ELSE wa END AS t FROM x), z AS (SELECT *, {W.norm('t')} AS nt, [{W.norm('a')}] AS ng FROM y)
SELECT format('doc-x-{{:06d}}-{{:s}}', i, s) AS qid, 'doc' AS dataset_family, nullif(t, '') AS ck_target_answer, {W.match('nt', 'ng')} AS ck_target_matches_gt, CASE s WHEN 'sup' THEN 'right' END AS ck_text, CASE s WHEN 'sup' THEN 'natural' ELSE 'llm_synth' END AS ck_text_origin, CASE WHEN i % 2 = 0 THEN 'o' ELSE 'row' || i END AS raw_qid FROM z""")
def build_documents(spark, sf):
    i = F.col("c_custkey")
    raw = table(spark, sf, "customer").select(
        i.alias("raw_idx"), F.lit("dev").alias("raw_split"), F.when(i % 6 == 0, " ").otherwise(" who ").alias("question"), F.array("c_name").alias("answers"), F.lit(" right ").alias("correct_doc"), F.lit("  ").alias("wrong_doc"), F.when(i % 4 == 0, " ").otherwise(F.col("c_name")).alias("correct_answer"), F.col("c_mktsegment").alias("wrong_answer"),
        F.lit("").alias("question_id"), F.when(i % 2 == 0, "o").alias("original_id"), F.lit(None).cast("string").alias("url"),
    )
    return B.document_pairs(raw, "doc-x").select("qid", "dataset_family", "ck_target_answer", "ck_target_matches_gt", "ck_text", "ck_text_origin", F.col("metadata")["raw_qid"].alias("raw_qid"))


@query("SELECT n_nationkey AS k, n_name AS name, NULL::INT AS more FROM nation UNION ALL SELECT r_regionkey, r_name, r_regionkey FROM region")
def union_of_datasets(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return B.pooled(n, table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("more")))


@query(f"""WITH {W.QA}, t AS (SELECT qid, pk_answer, ck_answer, {W.norm('pk_answer')} AS np, {W.norm('ck_answer')} AS nc, list_transform(ground_truth, lambda x: {W.norm('x')}) AS ng FROM qa),
m AS (SELECT *, {W.match('np', 'ng')} AS pk, {W.match('nc', 'ng')} AS ck FROM t),
s AS (SELECT *, {W.cell('pk', 'ck')} AS cell, unnest(['sup', 'conf']) AS side FROM m)
SELECT qid, pk, ck, cell, CASE cell WHEN 'C11' THEN 'either' WHEN 'C10' THEN 'use_PK' WHEN 'C01' THEN 'use_CK' ELSE 'abstain' END AS target, lpad(qid::VARCHAR, 6, '0') || '-' || side AS row_id FROM s
WHERE trim(coalesce(CASE side WHEN 'sup' THEN pk_answer ELSE ck_answer END, '')) <> ''""")
def sql_surface(spark, sf):
    """The matcher, cells, targets and row builder through spark.sql alone."""
    sql.register(spark)
    qa(spark, sf).createOrReplaceTempView("aq_rows")
    return spark.sql("""WITH m AS (SELECT qid, pk_answer, ck_answer, aq_match(pk_answer, ground_truth) AS pk, aq_match(ck_answer, ground_truth) AS ck FROM aq_rows)
        SELECT m.qid, pk, ck, aq_cell(pk, ck) AS cell, aq_target(aq_cell(pk, ck)) AS target, s.qid AS row_id FROM m, LATERAL aq_sides(m.qid, pk_answer, ck_answer) s""")


def _counts(x: str) -> str:
    """The vector that ``Slots`` gives to a text."""
    return f"list_transform(string_split('0123456789abcdef', ''), lambda d: len(list_filter({_WORDS.format(f'lower({x})')}, lambda w: md5(w)[1] = d)))"


@query(f"""WITH {W.QA}, t AS (SELECT qid, pk_answer AS a, ground_truth AS g, {W.norm('pk_answer')} AS na, list_transform(ground_truth, lambda x: {W.norm('x')}) AS ng FROM qa),
m AS (SELECT *, {W.match('na', 'ng')} AS said FROM t),
p AS (SELECT qid, a, unnest(list_filter(g, lambda x: trim(x) <> '')) AS b FROM m WHERE NOT said AND trim(coalesce(a, '')) <> ''),
v AS (SELECT qid, {_counts('a')} AS va, {_counts('b')} AS vb FROM p),
c AS (SELECT qid, max(round(list_sum(list_transform(range(1, 17), lambda i: va[i] * vb[i])) / (sqrt(list_sum(list_transform(va, lambda x: x * x))) * sqrt(list_sum(list_transform(vb, lambda x: x * x)))), 9)) AS best FROM v GROUP BY 1)
SELECT m.qid, said OR coalesce(best >= 0.65, false) AS match FROM m LEFT JOIN c USING (qid)""")
def semantic_texts(spark, sf):
    """The match by meaning from the texts themselves: those without a match as texts are encoded once and kept."""
    rows, store = _once(qa(spark, sf).select("qid", "pk_answer", "ground_truth")), embed.Store(scratch(spark, "vectors"))
    return embed.semantic_match(rows, "qid", "pk_answer", "ground_truth", embed.Slots, store).select("qid", "match")


# ---- models: rows-only checks


@query()
def probe_grid(spark, sf):
    """Two heads by two probes, and the metrics of each pair of probes."""
    data = featured(spark, sf)
    scored, _ = probe.fit_grid(data, "qid", "split", [probe.Config("query", h, ("embedding",), p) for h in ("pk", "ck") for p in ("logreg", "mlp")])
    rows = data.select("qid", F.concat(F.lit("C"), F.col("pk").cast("string"), F.col("ck").cast("string")).alias("oracle_cell"), F.array(F.lit("right")).alias("ground_truth"), F.when(F.col("pk") == 1, "right").otherwise("wrong").alias("pk_answer"), F.when(F.col("ck") == 1, "right").otherwise("other").alias("ck_answer"))
    return probe.joint_grid(scored, rows, "qid")


def _ids(*words: str) -> str:
    """The numbers that the encoder ``Hashed`` gives to words, as a set in SQL; told by the same rule, from the digits of their md5."""
    return "(" + ", ".join(str(i) for i in sorted({int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "little") % 1024 for w in words})) + ")"


_DIGIT = "(strpos('0123456789abcdef', md5(t)[{}]) - 1)"
_ID = f"(16 * {_DIGIT.format(1)} + {_DIGIT.format(2)} + 256 * ({_DIGIT.format(4)} % 4))"
_A, _B = (tuple(w.strip() for w in states.CHOICES[c]) for c in "AB")


def _mass(words: tuple[str, ...]) -> str:
    return f"round((coalesce(sum(exp(c - m)) FILTER (id IN {_ids(*words)}), 0) + ({len(set(words))} - count(*) FILTER (id IN {_ids(*words)})) * exp(-any_value(m))) / (sum(exp(c - m)) + (1024 - count(*)) * exp(-any_value(m))), 6)"


@query(f"""WITH {_ROWS}, p AS (SELECT qid, question, 'PK' AS side, {_echo(_limited('question'))} AS w, len({_WORDS.format("'Think step by step from memory, then answer.' || chr(10) || question")}) AS n_before FROM rows
UNION ALL SELECT qid, question, 'CK', {_echo(_limited('ck_text || chr(10) || question'))}, len({_WORDS.format("'Think step by step with the passage, then answer.' || chr(10) || ck_text || chr(10) || question")}) FROM rows),
k AS (SELECT * FROM (VALUES (1), (2), (3)) AS v(k)),
t AS (SELECT qid, side, k, n_before, question, CASE k WHEN 1 THEN w WHEN 2 THEN {_SORTED.format(w='w', seed=43)} ELSE {_SORTED.format(w='w', seed=44)} END AS w FROM p, k),
j AS (SELECT qid, side, k, len(w) > 0 AND n_before < 4096 AS there, list_concat({_WORDS.format('question')}, w, string_split('Does this reasoning lead to the right answer? A: yes. B: no. Choice:', ' '))[1:4096] AS ts FROM t),
c AS (SELECT qid, side, k, {_ID} AS id, count(*) AS c FROM (SELECT qid, side, k, unnest(ts) AS t FROM j WHERE there) GROUP BY 1, 2, 3, 4),
m AS (SELECT *, max(c) OVER (PARTITION BY qid, side, k) AS m FROM c),
s AS (SELECT qid, side, k, {_mass(_A)} AS p_a, {_mass(_B)} AS p_b FROM m GROUP BY 1, 2, 3)
SELECT j.qid, j.side, j.k::INT AS k, CASE WHEN there THEN 4 END AS layers, CASE WHEN there THEN 16 END AS width, p_a, p_b FROM j LEFT JOIN s USING (qid, side, k)""")
def pooled_traces(spark, sf):
    """The traces of all rows by a deterministic encoder: sizes, and the probabilities of the two choices after each trace."""
    rows = _once(_rows(spark, sf).select("qid", "question", "ck_text"))
    own = I.traced(rows, I.Echo).join(rows.select("qid", T.text("question").alias("question"), T.text("ck_text").alias("ck_text")), "qid")
    out = states.pooled_traces(own, states.Hashed)
    sizes = F.when(F.col("h_trace").isNotNull(), F.size("h_trace")), F.when(F.col("h_judge").isNotNull(), F.size(F.get("h_judge", F.lit(0))))
    return out.select("qid", "side", "k", sizes[0].alias("layers"), sizes[1].alias("width"), F.round("p_a", 6).alias("p_a"), F.round("p_b", 6).alias("p_b"))


@query()
def config_sweep(spark, sf):
    """Heads on a prior vector and a conditional one: the first of three, their mean, their maximum; the joint metrics of each."""
    e = table(spark, sf, "embeddings")
    three = e.withColumn("qid", F.floor(F.col("vec_id") / 3)).withColumn("k", F.col("vec_id") % 3)
    whole = J.aligned(three, "qid", "k", 3)
    first = whole.where("k = 0").select("qid", F.col("embedding").alias("k1"), "label")
    mean, most = (V.pooled(whole, "qid", "embedding", how).withColumnRenamed("embedding", name) for how, name in (("avg", "mean3"), ("max", "max3")))
    f, i = F.col("k1"), F.col("qid") % 10
    own = first.join(mean, "qid").join(most, "qid").withColumns({"prior": F.slice("k1", 1, 8), "pk": (F.get(f, F.lit(0)) > 0).cast("int"), "ck": (F.get(f, F.lit(2)) > 0).cast("int"), "split": F.when(i < 7, "train").when(i < 8, "val").otherwise("test")})
    scored, _ = probe.fit_grid(own, "qid", "split", [probe.Config(n, h, ("prior", v), "logreg") for n, v in (("K1", "k1"), ("mean3", "mean3"), ("max3", "max3")) for h in ("pk", "ck")])
    rows = own.select("qid", F.expr("concat('C', pk, ck)").alias("oracle_cell"), F.array(F.lit("right")).alias("ground_truth"), F.when(F.col("pk") == 1, "right").otherwise("wrong").alias("pk_answer"), F.when(F.col("ck") == 1, "right").otherwise("other").alias("ck_answer"))
    return probe.joint_grid(scored, rows, "qid")
