"""Every query of the engine by name, with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import prompts as P
from ..functions import text as T
from ..functions import vector as V
from ..operators import build as B
from ..operators import infer as I
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import order as O
from ..operators import parallel, probe
from ..operators import sampling as S
from ..operators import validate
from ..sources import records, sinks
from . import twins as W
from .bindings import featured, qa, routed, spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


# ---- cells, routing, metrics


@query(f"WITH {W.QA} SELECT qid, {W.cell('pk_alias', 'ck_alias')} AS cell, coalesce(pk_alias, false)::INT * 2 + coalesce(ck_alias, false)::INT AS joint FROM qa")
def cell_label(spark, sf):
    return qa(spark, sf).select("qid", C.cell("pk_alias", "ck_alias").alias("cell"), C.joint_label("pk_alias", "ck_alias").alias("joint"))


@query(f"WITH {W.ROUTED} SELECT qid, oracle_cell, CASE oracle_cell WHEN 'C11' THEN 'either' WHEN 'C10' THEN 'use_PK' WHEN 'C01' THEN 'use_CK' ELSE 'abstain' END AS target, answer FROM r1")
def routing_target(spark, sf):
    own = qa(spark, sf).where("pk_alias is not null").withColumn("oracle_cell", C.cell("pk_alias", "ck_alias"))
    return own.select("qid", "oracle_cell", C.routing_target("oracle_cell").alias("target"), C.routed_answer("oracle_cell", "pk_answer", "ck_answer", "I do not know").alias("answer"))


@query(f"WITH {W.ROUTED} SELECT oracle_cell, {W.CUBE} FROM routed GROUP BY 1")
def tally_cube(spark, sf):
    return M.cube(routed(spark, sf))


@query(f"WITH {W.ROUTED}, c AS (SELECT dataset, oracle_cell, {W.CUBE} FROM routed GROUP BY 1, 2), grid AS (SELECT DISTINCT dataset, x.oracle_cell FROM c, (SELECT unnest(['C00', 'C01', 'C10', 'C11']) AS oracle_cell) x) SELECT dataset, oracle_cell, " + ", ".join(f'coalesce("{c}", 0) AS "{c}"' for c in M.COUNTERS) + " FROM grid LEFT JOIN c USING (dataset, oracle_cell)")
def tally_full_cube(spark, sf):
    return M.full_cube(M.cube(routed(spark, sf), "dataset"), "dataset")


@query(f"WITH {W.ROUTED} SELECT oracle_cell, {W.CUBE} FROM routed GROUP BY 1")
def merged_cubes(spark, sf):
    rows = routed(spark, sf)
    return M.merged(M.cube(rows.where("qid % 2 = 0")), M.cube(rows.where("qid % 2 = 1")))


@query(f"WITH {W.ROUTED} SELECT dataset, {W.METRICS} FROM routed GROUP BY 1")
def metrics_per_dataset(spark, sf):
    return M.metrics(M.cube(routed(spark, sf), "dataset"), "dataset")


@query(f"WITH {W.ROUTED} SELECT dataset, {W.METRICS} FROM routed GROUP BY ROLLUP (dataset)")
def metrics_rollup(spark, sf):
    return M.metrics(M.cube(routed(spark, sf), "dataset"), "dataset", pooled=True)


EVAL = f"""WITH {W.QA}, a AS (SELECT *, CASE WHEN qid % 11 = 0 THEN 'timeout' WHEN qid % 11 = 1 THEN 'None' WHEN qid % 11 = 2 THEN '' END AS error, CASE WHEN qid % 4 = 0 THEN 'PK' WHEN qid % 4 = 1 THEN 'CK' WHEN qid % 4 = 2 THEN '' END AS src, {W.cell('pk_alias', 'ck_alias')} AS cell,
 {W.norm('pk_answer')} AS na, list_transform(ground_truth, lambda g: {W.norm('g')}) AS ng FROM qa), b AS (SELECT *, coalesce(error, '') = '' AS ok, {W.match('na', 'ng')} AS hit FROM a)"""


def _answers(spark, sf):
    q = F.col("qid")
    own = qa(spark, sf).withColumn("error", F.when(q % 11 == 0, "timeout").when(q % 11 == 1, "None").when(q % 11 == 2, ""))
    own = own.withColumn("source", F.when(q % 4 == 0, "PK").when(q % 4 == 1, "CK").when(q % 4 == 2, ""))
    return own.withColumn("final_answer", F.col("pk_answer")).withColumn("cost", (q % 7).cast("double")).withColumn("latency", (q % 5).cast("double"))


@query(EVAL + " SELECT dataset, count(*) FILTER (ok) AS n, count(*) FILTER (NOT ok) AS n_err, " + W.ratio("ok AND hit", "ok") + " AS acc, " + ", ".join(f"count(*) FILTER (ok AND cell = '{c}') AS n_{c.lower()}, {W.ratio(f'''ok AND hit AND cell = '{c}' ''', f'''ok AND cell = '{c}' ''')} AS acc_{c.lower()}" for c in C.CELLS) + ", " + W.ratio("ok AND hit AND relation = 'supportive'", "ok AND relation = 'supportive'") + " AS relation_acc_t, " + W.ratio("ok AND hit AND relation = 'conflicting'", "ok AND relation = 'conflicting'") + " AS relation_acc_f, (" + W.ratio("ok AND hit AND relation = 'supportive'", "ok AND relation = 'supportive'") + " + " + W.ratio("ok AND hit AND relation = 'conflicting'", "ok AND relation = 'conflicting'") + ") / 2 AS relation_sf, coalesce(sum(qid % 7) FILTER (ok), 0)::DOUBLE AS total_cost, coalesce(sum(qid % 5) FILTER (ok), 0)::DOUBLE AS total_latency FROM b GROUP BY 1")
def baseline_eval(spark, sf):
    return M.baseline_evaluation(_answers(spark, sf), "dataset")


@query(EVAL + " SELECT dataset, coalesce(nullif(src, ''), 'implicit') AS predicted_source, count(*) AS n FROM b WHERE ok GROUP BY 1, 2")
def source_distribution(spark, sf):
    return M.source_distribution(_answers(spark, sf), "dataset")


JUDGED = f"""WITH {W.QA}, j AS (SELECT *, CASE WHEN qid % 3 = 0 THEN true WHEN qid % 3 = 1 THEN false END AS pk_judge, CASE WHEN qid % 5 = 0 THEN false WHEN qid % 5 < 3 THEN true END AS ck_judge FROM qa WHERE pk_alias IS NOT NULL),
k AS (SELECT *, CASE WHEN pk_judge IS NULL THEN pk_alias ELSE pk_alias AND pk_judge END AS pk_correct, CASE WHEN ck_judge IS NULL THEN ck_alias ELSE ck_alias AND ck_judge END AS ck_correct FROM j)"""


def _judged(spark, sf):
    q = F.col("qid")
    own = qa(spark, sf).where("pk_alias is not null").withColumn("pk_judge", F.when(q % 3 == 0, True).when(q % 3 == 1, False)).withColumn("ck_judge", F.when(q % 5 == 0, False).when(q % 5 < 3, True))
    return own.withColumn("pk_correct", C.final_correct("pk_alias", "pk_judge")).withColumn("ck_correct", C.final_correct("ck_alias", "ck_judge"))


@query(JUDGED + " SELECT qid, pk_correct, ck_correct, CASE WHEN pk_judge IS NULL THEN 'alias' ELSE 'alias_and_judge' END AS pk_source FROM k")
def judge_merge(spark, sf):
    return _judged(spark, sf).select("qid", "pk_correct", "ck_correct", C.final_source("pk_judge").alias("pk_source"))


_DIST = "count(*) AS n_rows, count(pk_judge) AS n_judged, " + ", ".join(f"count(*) FILTER ({W.cell('pk_correct', 'ck_correct')} = '{c}') AS final_{c.lower()}, (count(*) FILTER ({W.cell('pk_correct', 'ck_correct')} = '{c}') * 100)::DOUBLE / count(*) AS pct_{c.lower()}, count(*) FILTER ({W.cell('pk_alias', 'ck_alias')} = '{c}') AS alias_{c.lower()}" for c in C.CELLS) + f", (count(*) FILTER (pk_correct))::DOUBLE / count(*) AS pk_rate, (count(*) FILTER (ck_correct))::DOUBLE / count(*) AS ck_rate, (count(*) FILTER ({W.cell('pk_correct', 'ck_correct')} IN ('C01', 'C10')) * 100)::DOUBLE / count(*) AS informative_pct"


@query(f"{JUDGED} SELECT dataset, {_DIST} FROM k GROUP BY ROLLUP (dataset)")
def cell_distribution(spark, sf):
    return M.cell_distribution(_judged(spark, sf), "dataset", pooled=True)


@query(JUDGED + " SELECT coalesce(relation, 'unknown') AS relation, " + ", ".join(f"count(*) FILTER ({W.cell('pk_correct', 'ck_correct')} = '{c}') AS {c.lower()}" for c in C.CELLS) + ", count(*) AS n FROM k GROUP BY 1")
def cell_by_relation(spark, sf):
    return M.cell_by_relation(_judged(spark, sf))


@query(JUDGED + " SELECT dataset, count(*) AS n, count(pk_judge) AS n_judged, count(*) FILTER (pk_alias AND pk_judge) AS at_jt, count(*) FILTER (pk_alias AND pk_judge = false) AS at_jf, count(*) FILTER (NOT pk_alias AND pk_judge) AS af_jt, count(*) FILTER (NOT pk_alias AND NOT pk_judge) AS af_jf, count(*) FILTER (pk_alias) AS n_alias, count(*) FILTER (pk_judge) AS n_judge, count(*) FILTER (pk_correct) AS n_final FROM k GROUP BY 1")
def judge_confusion(spark, sf):
    return M.judge_confusion(_judged(spark, sf).select("dataset", F.col("pk_alias").alias("alias"), F.col("pk_judge").alias("judge")), "dataset")


@query(JUDGED + " SELECT qid, pk_judge IS NULL OR (coalesce(ck_answer, '') <> '' AND ck_judge IS NULL) AS needs FROM k")
def needs_judge(spark, sf):
    return _judged(spark, sf).select("qid", C.needs_judge("pk_judge", "ck_answer", "ck_judge").alias("needs"))


@query("SELECT vec_id, CASE WHEN embedding[1] >= 0.05 THEN 'C1' ELSE 'C0' END || CASE WHEN embedding[2] >= 0.05 THEN '1' ELSE '0' END AS cell FROM embeddings")
def threshold_route(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", C.predicted_cell(F.get("embedding", F.lit(0)), F.get("embedding", F.lit(1)), 0.05).alias("cell"))


# ---- text functions


@query(f"SELECT doc_id, md5({W.norm('text')}) AS normalised, len({W.toks('text')}) AS n FROM documents")
def normalise_text(spark, sf):
    own = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id", T.tokens("text").alias("t"))
    return own.select("doc_id", F.md5(F.array_join("t", " ")).alias("normalised"), F.size("t").cast("long").alias("n"))


@query(f"SELECT d.doc_id, b.item_id FROM (SELECT doc_id, {W.norm('text')} AS t FROM documents) d JOIN (SELECT item_id, {W.norm('text')} AS p FROM benchmark) b ON p <> '' AND contains(' ' || t || ' ', ' ' || p || ' ')")
def word_contains_join(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id", T.normalise("text").alias("t"))
    items = table(spark, sf, "benchmark").select("item_id", T.normalise("text").alias("p"))
    return J.contained(items, docs, "p", "t", "doc_id").select("doc_id", "item_id")


@query(f"WITH {W.QA} SELECT qid, CASE WHEN len(a) > 0 AND len(b) > 0 THEN {W.jac('a', 'b')} ELSE 0.0 END AS similarity FROM (SELECT qid, {W.toks('pk_answer')} AS a, {W.toks('ck_answer')} AS b FROM qa)")
def token_jaccard(spark, sf):
    return qa(spark, sf).select("qid", T.jaccard(T.tokens("pk_answer"), T.tokens("ck_answer")).alias("similarity"))


@query(f"WITH {W.QA}, x AS (SELECT qid, {W.norm('pk_answer')} AS p, {W.norm('ck_answer')} AS c, list_transform(ground_truth, lambda g: {W.norm('g')}) AS ng FROM qa) SELECT qid, {W.match('p', 'ng')} AS pk, {W.match('c', 'ng')} AS ck FROM x")
def alias_match_flags(spark, sf):
    return qa(spark, sf).select("qid", T.alias_match("pk_answer", "ground_truth").alias("pk"), T.is_correct("ck_answer", "ground_truth").alias("ck"))


YES_NO = "CASE doc_id % 5 WHEN 0 THEN 'Yes, ' WHEN 1 THEN 'The wrong ' WHEN 2 THEN 'not true ' ELSE '' END || text"


@query(f"SELECT doc_id, coalesce(CASE WHEN w IN {T.YES_WORDS} THEN 'true' WHEN w IN {T.NO_WORDS} THEN 'false' END = CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END, false) AS hit FROM (SELECT doc_id, ({W.toks(YES_NO)})[1] AS w FROM documents)")
def yes_no_match(spark, sf):
    said = F.concat(F.expr("CASE doc_id % 5 WHEN 0 THEN 'Yes, ' WHEN 1 THEN 'The wrong ' WHEN 2 THEN 'not true ' ELSE '' END"), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", T.yes_no_match(said, F.array(F.when(F.col("doc_id") % 2 == 0, "True").otherwise("False"))).alias("hit"))


RAW = "CASE doc_id % 4 WHEN 0 THEN '**Final Answer:** ' WHEN 1 THEN 'answer: ' WHEN 2 THEN ' ' || chr(10) ELSE '' END || text"
RAW_LINES = W.LINES.replace("string_split(text,", f"string_split({RAW},")


def _raw(spark, sf):
    said = F.concat(F.expr("CASE doc_id % 4 WHEN 0 THEN '**Final Answer:** ' WHEN 1 THEN 'answer: ' WHEN 2 THEN ' \\n' ELSE '' END"), F.col("text"))
    return spread(table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id").select("doc_id", "source", said.alias("raw"))


@query(f"SELECT doc_id, md5(coalesce({W.clean('ls[1]')}, '')) AS line FROM (SELECT doc_id, {RAW_LINES} AS ls FROM documents)")
def first_line(spark, sf):
    return _raw(spark, sf).select("doc_id", F.md5(T.first_line("raw")).alias("line"))


@query(f"SELECT doc_id, md5(coalesce(list_filter(list_transform(ls, lambda s: {W.clean('s')}), lambda s: s <> '')[-1], '')) AS line FROM (SELECT doc_id, {RAW_LINES} AS ls FROM documents)")
def last_line(spark, sf):
    return _raw(spark, sf).select("doc_id", F.md5(T.last_line("raw")).alias("line"))


@query(f"SELECT doc_id, md5(trim(string_split(trim({RAW}, {W.WS}), chr(10))[1], {W.WS})) AS line FROM documents")
def generated_line(spark, sf):
    return _raw(spark, sf).select("doc_id", F.md5(T.generated_line("raw")).alias("line"))


@query("SELECT doc_id, CASE WHEN t > 0 AND (f = 0 OR t < f) THEN true WHEN f > 0 THEN false END AS said FROM (SELECT doc_id, instr(x, 'true') AS t, instr(x, 'false') AS f FROM (SELECT doc_id, lower(CASE doc_id % 4 WHEN 0 THEN 'False. ' WHEN 1 THEN 'True, not false ' WHEN 2 THEN 'it is TRUE ' ELSE '' END || text) AS x FROM documents))")
def true_false_parse(spark, sf):
    said = F.concat(F.expr("CASE doc_id % 4 WHEN 0 THEN 'False. ' WHEN 1 THEN 'True, not false ' WHEN 2 THEN 'it is TRUE ' ELSE '' END"), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", T.parse_true_false(said).alias("said"))


@query(f"WITH {W.QA} SELECT qid, CASE WHEN trim(coalesce(pk_answer, ''), {W.WS}) = '' THEN false ELSE starts_with(upper(CASE WHEN qid % 2 = 0 THEN ' yes.' ELSE 'no' END), ' YES') END AS decision, CASE WHEN trim(coalesce(pk_answer, ''), {W.WS}) = '' THEN 'empty_candidate' ELSE CASE WHEN qid % 2 = 0 THEN ' yes.' ELSE 'no' END END AS reply, array_to_string(ground_truth, ' | ') AS gold FROM qa")
def judge_parse(spark, sf):
    j = T.parse_judge(F.when(F.col("qid") % 2 == 0, " yes.").otherwise("no"), "pk_answer")
    return qa(spark, sf).select("qid", j["decision"].alias("decision"), j["reply"].alias("reply"), T.gold_list("ground_truth").alias("gold"))


@query("SELECT doc_id, len(t) AS n, md5(array_to_string(CASE WHEN len(t) > 96 THEN list_concat(t[1:32], t[-64:]) ELSE t END, ' ')) AS kept FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda s: s <> '') AS t FROM documents)")
def middle_truncate(spark, sf):
    own = table(spark, sf, "documents").withColumn("t", F.filter(F.split("text", "[ \t\n\r]+"), lambda s: s != ""))
    return own.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join(T.middle_truncate("t", 96, 32), " ")).alias("kept"))


_Q, _T = "'Which of these is it ?'", "list_filter(string_split_regex({}, '\\s+'), lambda s: s <> '')"


@query(f"SELECT doc_id, n > 120 AS truncated, md5(CASE WHEN n > 120 THEN {_Q} || chr(10) || array_to_string(({_T.format('text')})[1:109], ' ') || ' [truncated]' ELSE {_Q} || chr(10) || text END) AS prompt FROM (SELECT doc_id, text, len({_T.format(_Q + ' || chr(10) || text')}) AS n FROM documents)")
def context_truncate(spark, sf):
    out = T.truncate_context(F.lit("Which of these is it ?"), "text", 120)
    return table(spark, sf, "documents").select("doc_id", out["truncated"].alias("truncated"), F.md5(out["prompt"]).alias("prompt"))


@query("SELECT doc_id, substr(sha1(text), 1, 16) AS question_hash FROM documents")
def question_hashes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.question_hash("text").alias("question_hash"))


# ---- building rows


@query("SELECT p_partkey, list_distinct_ordered AS aliases FROM (SELECT p_partkey, list_filter(CASE WHEN p_brand = p_type THEN [p_name, p_brand] WHEN p_name = p_brand THEN [p_name, p_type] ELSE [p_name, p_brand, p_type] END, lambda s: s <> '') AS list_distinct_ordered FROM part)")
def alias_dedup(spark, sf):
    return table(spark, sf, "part").select("p_partkey", B.aliases("p_name", F.array("p_brand", F.lit(""), "p_type", "p_name")).alias("aliases"))


@query("SELECT format('{:s}-{:06d}-{:s}', source, doc_id, s) AS qid, source AS dataset, doc_id AS raw_idx, CASE s WHEN 'sup' THEN 'supportive' ELSE 'conflicting' END AS ck_relation, md5(CASE s WHEN 'sup' THEN text ELSE lang END) AS context FROM documents, (SELECT unnest(['sup', 'conf']) AS s) WHERE text <> ''")
def explode_sup_conf(spark, sf):
    docs = table(spark, sf, "documents").where(B.all_present("text", "lang"))
    out = docs.select("source", "doc_id", B.sides(ck_text=(F.col("text"), F.col("lang")), suffix=(F.lit("sup"), F.lit("conf"))).alias("x"))
    return out.select(B.qid("source", "doc_id", F.col("x.suffix")).alias("qid"), F.col("source").alias("dataset"), F.col("doc_id").alias("raw_idx"), "x.ck_relation", F.md5("x.ck_text").alias("context"))


@query("SELECT o_orderkey, v.sub_type, v.ck_relation, v.ck_text FROM (SELECT o_orderkey, unnest(list_filter([{'sub_type': 'default', 'ck_relation': 'supportive', 'ck_text': o_orderpriority}, {'sub_type': 'misinformation', 'ck_relation': 'conflicting', 'ck_text': CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END}, {'sub_type': 'semantic', 'ck_relation': 'conflicting', 'ck_text': CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'x' END}], lambda s: coalesce(s.ck_text, '') <> '')) AS v FROM orders)")
def explode_variants(spark, sf):
    o = table(spark, sf, "orders")
    v = B.variants(("default", "supportive", F.col("o_orderpriority")), ("misinformation", "conflicting", F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus"))), ("semantic", "conflicting", F.when(F.col("o_orderkey") % 3 != 0, "x")))
    return o.select("o_orderkey", v.alias("v")).select("o_orderkey", "v.*")


@query("SELECT p_partkey, CASE WHEN p_size % 7 BETWEEN 2 AND 5 THEN 'mc-' || p_size % 7 ELSE 'open' END AS question_format, split_part(p_type || '-x', '-', 1) AS family, CASE WHEN p_size % 7 = 0 THEN p_name ELSE p_brand END AS filled, CASE WHEN p_size % 2 = 0 THEN 2 END AS hops FROM part")
def row_fields(spark, sf):
    p = table(spark, sf, "part")
    options = F.when(F.col("p_size") % 7 > 0, F.array_repeat(F.lit("o"), F.col("p_size") % 7))
    path = F.when(F.col("p_size") % 2 == 0, "[['a', 'b'], ['c', 'd']]").otherwise("none")
    return p.select("p_partkey", B.question_format(options).alias("question_format"), B.family(F.concat("p_type", F.lit("-x"))).alias("family"), B.something(F.when(F.col("p_size") % 7 == 0, "").otherwise(F.col("p_brand")), "p_name").alias("filled"), B.hop_count(path).alias("hops"))


def _typed(spark, sf):
    d, i = table(spark, sf, "documents"), F.col("doc_id")
    return d.select(
        i.alias("qid"), F.col("source").alias("dataset"), F.when(i % 6 == 0, "unknown").when(i % 2 == 0, "supportive").otherwise("conflicting").alias("ck_relation"), (i % 10 < 9).alias("ck_relation_is_core"),
        F.when(i % 7 == 0, "llm").otherwise("wikidata").alias("ground_truth_origin"), F.lit("natural").alias("ck_text_origin"), F.lit("rule_hardcoded").alias("ck_relation_source"), F.when(i % 3 == 0, "mc-4").otherwise("open").alias("question_format"),
        F.when(i % 9 == 0, F.array(F.lit("x"))).alias("options"), F.when(i % 8 == 0, F.array().cast("array<string>")).otherwise(F.array("lang")).alias("ground_truth"), F.col("lang").alias("ground_truth_text"), F.col("text").alias("question"),
        F.create_map(F.when(i % 13 == 0, "logp").otherwise("note"), F.lit("")).alias("metadata"), F.col("lang").alias("ck_target_answer"), (i % 4 == 1).alias("ck_target_matches_gt"),
    )


@query("""WITH x AS (SELECT doc_id AS qid, CASE WHEN doc_id % 6 = 0 THEN 'unknown' WHEN doc_id % 2 = 0 THEN 'supportive' ELSE 'conflicting' END AS rel, doc_id AS i, text FROM documents)
SELECT qid, array_to_string(list_filter([CASE WHEN rel = 'unknown' THEN 'relation' END, CASE WHEN (i % 10 < 9) <> (rel <> 'unknown') THEN 'core' END, CASE WHEN i % 7 = 0 THEN 'gold_origin' END, CASE WHEN i % 3 = 0 AND i % 9 <> 0 THEN 'options' END, CASE WHEN i % 8 = 0 THEN 'ground_truth' END,
CASE WHEN text = '' THEN 'question' END, CASE WHEN i % 13 = 0 THEN 'metadata' END], lambda s: s IS NOT NULL), ',') AS broken, rel = 'supportive' AND i % 4 <> 1 AS warned FROM x""")
def validate_rows(spark, sf):
    return validate.violations(_typed(spark, sf)).select("qid", F.array_join("violations", ",").alias("broken"), "warned")


@query("""WITH x AS (SELECT source AS dataset, CASE WHEN doc_id % 6 = 0 THEN 'unknown' WHEN doc_id % 2 = 0 THEN 'supportive' ELSE 'conflicting' END AS rel FROM documents)
SELECT dataset, count(*) AS n_rows, count(*) FILTER (rel = 'supportive') AS n_supportive, count(*) FILTER (rel = 'conflicting') AS n_conflicting, count(*) FILTER (rel = 'irrelevant') AS n_irrelevant, count(*) FILTER (rel = 'complementary') AS n_complementary,
count(*) FILTER (rel = 'supportive') > 0 AND count(*) FILTER (rel = 'conflicting') > 0 AS has_both FROM x GROUP BY 1""")
def dataset_summary(spark, sf):
    return validate.dataset_summary(_typed(spark, sf))


# ---- splits and samples


@query(f'WITH {W.SPLIT} SELECT dataset, md5("group") AS "group", split FROM split')
def grouped_split(spark, sf):
    return S.grouped_split(table(spark, sf, "documents"), "source", "text").select("dataset", F.md5("group").alias("group"), "split")


@query(f'WITH {W.SPLIT} SELECT s.dataset, s.split, count(DISTINCT d.text) AS n_groups, count(*) AS n_rows FROM documents d JOIN split s ON d.source = s.dataset AND d.text = s."group" GROUP BY 1, 2')
def split_stats(spark, sf):
    docs = table(spark, sf, "documents")
    return S.split_stats(docs.select(F.col("source").alias("dataset"), F.col("text").alias("group")), S.grouped_split(docs, "source", "text"))


@query("""WITH m AS (SELECT doc_id AS qid, CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM documents WHERE source < 'src2' AND doc_id % 4 <> 0), f AS (SELECT d.source AS dataset, d.doc_id AS qid, m.split FROM documents d LEFT JOIN m ON d.doc_id = m.qid),
k AS (SELECT *, count(split) OVER (PARTITION BY dataset) AS have, count(*) OVER (PARTITION BY dataset) AS n, row_number() OVER (PARTITION BY dataset ORDER BY qid) AS place FROM f)
SELECT dataset, qid, CASE WHEN have > 0 THEN split WHEN place <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN place <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM k WHERE have = 0 OR split IS NOT NULL""")
def fallback_split(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("source").alias("dataset"), F.col("doc_id").alias("qid"))
    manifest = rows.where("dataset < 'src2' and qid % 4 <> 0").select("qid", F.when(F.col("qid") % 10 == 0, "test").otherwise("train").alias("split"))
    return S.fallback_split(rows, manifest)


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 5")
def top_categories(spark, sf):
    return S.top_k(table(spark, sf, "part"), "p_type", 5)


@query("""WITH t AS (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 5), n AS (SELECT ceil(100.0 / count(*)) AS share FROM t), p AS (SELECT *, md5('42:' || p_partkey) AS h FROM part WHERE p_type IN (SELECT p_type FROM t)),
r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY h, p_partkey) AS place FROM p) SELECT p_partkey, p_type FROM r, n ORDER BY CASE WHEN place <= share THEN 0 ELSE 1 END, h, p_partkey LIMIT 100""")
def stratified_sample(spark, sf):
    return S.stratified_sample(table(spark, sf, "part"), "p_type", "p_partkey", 100, 5).select("p_partkey", "p_type")


@query(f"""WITH {W.QA}, x AS (SELECT qid, {W.cell('pk_alias', 'ck_alias')} AS cell, md5('42:' || qid) AS h FROM qa WHERE pk_alias IS NOT NULL AND ck_alias IS NOT NULL), y AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY h, qid) AS place FROM x)
SELECT qid, cell FROM y ORDER BY CASE WHEN place <= 25 THEN list_position(['C10', 'C01', 'C11', 'C00'], cell) ELSE 9 END, h, qid LIMIT 100""")
def balanced_sample(spark, sf):
    return S.balanced_sample(qa(spark, sf), "qid", "pk_alias", "ck_alias", 100).select("qid", C.cell("pk_alias", "ck_alias").alias("cell"))


@query(JUDGED + ", a AS (SELECT 'pk' AS axis, qid FROM k WHERE pk_alias AND pk_judge = false UNION ALL SELECT 'ck', qid FROM k WHERE ck_alias AND ck_judge = false), b AS (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY md5('42:' || qid), qid) AS place FROM a) SELECT axis, qid FROM b WHERE place <= 20")
def audit_sample(spark, sf):
    return S.audit_sample(_judged(spark, sf), "qid", 20)


@query("SELECT md5(text) AS question, min(doc_id) AS first_at FROM documents GROUP BY text")
def dedup_first_seen(spark, sf):
    return table(spark, sf, "documents").groupBy("text").agg(F.min("doc_id").alias("first_at")).select(F.md5("text").alias("question"), "first_at")


# ---- joins


@query("SELECT e.vec_id AS qid, l.quality, d.source, len(e.embedding) AS width FROM embeddings e JOIN labels l ON e.vec_id = l.doc_id JOIN documents d ON e.vec_id = d.doc_id")
def three_way_feature_join(spark, sf):
    meta = table(spark, sf, "embeddings").select(F.col("vec_id").alias("qid"), F.size("embedding").cast("long").alias("width"))
    return J.features(meta, table(spark, sf, "labels").select(F.col("doc_id").alias("qid"), "quality"), table(spark, sf, "documents").select(F.col("doc_id").alias("qid"), "source"))


@query("SELECT l.doc_id AS qid, l.quality, d.source FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.doc_id IN (SELECT vec_id FROM embeddings)")
def allow_list_join(spark, sf):
    beh, rows = table(spark, sf, "labels").select(F.col("doc_id").alias("qid"), "quality"), table(spark, sf, "documents").select(F.col("doc_id").alias("qid"), "source")
    return J.allowed(beh, rows, table(spark, sf, "embeddings").select(F.col("vec_id").alias("qid")))


@query("SELECT doc_id AS qid, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def manifest_semi_join(spark, sf):
    return J.selected(table(spark, sf, "documents").select(F.col("doc_id").alias("qid"), "source"), table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("qid")))


@query("WITH done AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'timeout' WHEN doc_id % 2 = 0 THEN 'None' END AS error FROM labels) SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM done WHERE coalesce(error, '') IN ('', 'None'))")
def resume_anti_join(spark, sf):
    done = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "timeout").when(F.col("doc_id") % 2 == 0, "None").alias("error"))
    return J.pending(table(spark, sf, "documents").select("doc_id", "source"), done, ["doc_id"])


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def strict_gold_lookup(spark, sf):
    return J.strict_lookup(table(spark, sf, "orders"), table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").select("o_orderkey", "c_name")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(DISTINCT role) = 3)")
def aligned_k_join(spark, sf):
    return J.aligned(table(spark, sf, "conversations"), "conv_id", "role", 3).select("conv_id", "turn", "role")


@query("SELECT conv_id, md5(max(text) FILTER (role = 'user')) AS asked, md5(max(text) FILTER (role = 'assistant')) AS replied FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'user') > 0 AND count(*) FILTER (role = 'assistant') > 0")
def side_pivot(spark, sf):
    out = J.both_sides(table(spark, sf, "conversations"), ["conv_id"], "role", "text", ("user", "assistant"))
    return out.select("conv_id", F.md5("user").alias("asked"), F.md5("assistant").alias("replied"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM events) WHERE place = 1")
def latest_per_key(spark, sf):
    return J.latest(table(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events) WHERE place = 1")
def first_per_key(spark, sf):
    return J.first_wins(table(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("SELECT source AS dataset, doc_id::VARCHAR AS qid, CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'val' ELSE 'train' END AS split FROM documents")
def manifest_unpivot(spark, sf):
    docs, i = table(spark, sf, "documents"), F.col("doc_id")
    lists = [F.collect_list(F.when(c, i.cast("string"))).alias(s) for s, c in (("train", i % 10 > 1), ("val", i % 10 == 1), ("test", i % 10 == 0))]
    some = F.pmod(F.xxhash64("doc_id"), F.lit(64))  # a manifest's lists may come in parts, so that no row holds all ids of a source
    return records.unpivoted(docs.groupBy(F.col("source").alias("dataset"), some).agg(F.struct(*lists).alias("lists")).select("dataset", "lists"))


@query("SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_nationkey, 'old' FROM nation WHERE n_nationkey >= 10 AND n_nationkey < 20")
def index_merge(spark, sf):
    n = table(spark, sf, "nation")
    return sinks.merge_index(n.where("n_nationkey < 20").select(F.col("n_nationkey").alias("k"), F.lit("old").alias("v")), n.where("n_nationkey < 10").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")), "k")


@query("SELECT user_id AS qid, min(event_id) AS shard FROM events GROUP BY 1")
def shard_compaction(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("shard"))
    return sinks.compacted(e, e.select("qid"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS ordinal FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) QUALIFY ordinal BETWEEN 100 AND 299")
def row_range(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct().orderBy("l_orderkey", "l_linenumber")
    return records.numbered(rows).where("ordinal between 100 and 299")


# ---- vectors and heads


@query("WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM q, embeddings e WHERE e.vec_id <> q.vec_id) SELECT query_id, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 3")
def cosine_topk(spark, sf):
    """A stated query set, a hundredth of the rows, against all rows."""
    e = table(spark, sf, "embeddings")
    queries_ = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return V.nearest(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), queries_, 3).withColumnRenamed("id", "vec_id")


def _pool_sql(how: str) -> str:
    return f"WITH x AS (SELECT label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS place FROM embeddings), y AS (SELECT label, place, round({how}(v), 6) AS v FROM x GROUP BY 1, 2) SELECT label, list(v ORDER BY place) AS embedding FROM y GROUP BY 1"


def _rounded(df: DataFrame, vec: str) -> DataFrame:
    return df.withColumn(vec, F.transform(vec, lambda x: V.rounded(x)))


@query(_pool_sql("avg"))
def vector_mean(spark, sf):
    return _rounded(V.pooled(table(spark, sf, "embeddings"), "label", "embedding", "avg"), "embedding")


@query("""WITH p AS (SELECT user_id, event_id, value, row_number() OVER w AS place, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS former FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, value IS NOT NULL AND (former IS NULL OR value > former) AS improved FROM p),
s AS (SELECT *, place - coalesce(max(CASE WHEN improved THEN place END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS since FROM i)
SELECT user_id, event_id, place, greatest(former, value) AS best, improved, since,
 coalesce(max((since >= 4)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS stopped FROM s""")
def best_so_far(spark, sf):
    """Events of a user as the trials of a search: the best so far, improvements, and where it would have stopped."""
    out = O.best_so_far(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", 4)
    return out.select("user_id", "event_id", "place", "best", "improved", "since", "stopped")


@query(_pool_sql("max"))
def vector_max(spark, sf):
    return _rounded(V.pooled(table(spark, sf, "embeddings"), "label", "embedding", "max"), "embedding")


@query("SELECT (vec_id / 3)::BIGINT AS g, flatten(list(list_transform(embedding, lambda x: round(x::DOUBLE, 6)) ORDER BY vec_id)) AS embedding FROM (SELECT floor(vec_id / 3) * 3 AS vec_id0, * FROM embeddings) GROUP BY floor(vec_id / 3), 1".replace("(vec_id / 3)::BIGINT AS g", "floor(vec_id / 3)::BIGINT AS g").replace("GROUP BY floor(vec_id / 3), 1", "GROUP BY 1"))
def vector_concat(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("g", F.floor(F.col("vec_id") / 3))
    return _rounded(V.concatenated(e, "g", "vec_id", "embedding"), "embedding")


@query("WITH x AS (SELECT label % 2 AS y, embedding[1]::DOUBLE AS s, label FROM embeddings), r AS (SELECT *, rank() OVER (PARTITION BY label < 5 ORDER BY s) + (count(*) OVER (PARTITION BY label < 5, s) - 1) / 2.0::DOUBLE AS k FROM x) SELECT label < 5 AS low, round((sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 9) AS auroc FROM r GROUP BY 1")
def auroc(spark, sf):
    e = table(spark, sf, "embeddings").select((F.col("label") < 5).alias("low"), F.get("embedding", F.lit(0)).cast("double").alias("s"), (F.col("label") % 2).alias("y"))
    return M.auroc(e, "s", "y", "low").withColumn("auroc", F.round("auroc", 9))


@query("WITH x AS (SELECT label % 2 = 1 AS y, embedding[1] >= 0 AS p, label FROM embeddings) SELECT label, count(*) AS n, (count(*) FILTER (p = y))::DOUBLE / count(*) AS accuracy, coalesce((count(*) FILTER (p AND y))::DOUBLE / nullif(count(*) FILTER (p), 0), 0) AS precision, coalesce((count(*) FILTER (p AND y))::DOUBLE / nullif(count(*) FILTER (y), 0), 0) AS recall, coalesce((2 * count(*) FILTER (p AND y))::DOUBLE / nullif(2 * count(*) FILTER (p AND y) + count(*) FILTER (p <> y), 0), 0) AS f1 FROM x GROUP BY 1")
def head_metrics(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.get("embedding", F.lit(0)).alias("p"), (F.col("label") % 2).alias("y"))
    return M.head_metrics(e, "p", "y", "label", level=0.0)


@query("WITH x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(n) AS n, max(value) FILTER (place = n // 2) AS p50, max(value) FILTER (place = least(floor(n * 0.95::DOUBLE), n - 1)) AS p95, round(avg(value), 6) AS mean FROM x GROUP BY 1")
def latency_quantiles(spark, sf):
    return M.latency_quantiles(table(spark, sf, "events"), "value", "event_type").withColumn("mean", F.round("mean", 6))


@query("WITH x AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS place FROM embeddings), f AS (SELECT place, avg(v) AS m, stddev_pop(v) AS d FROM x WHERE vec_id % 10 < 8 GROUP BY 1) SELECT vec_id, list(round((v - m) / d, 6) ORDER BY place) AS embedding FROM x JOIN f USING (place) GROUP BY 1")
def standardise(spark, sf):
    return _rounded(M.standardised(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", F.col("vec_id") % 10 < 8), "embedding")


@query("SELECT vec_id, round(1 / (1 + exp(-embedding[1]::DOUBLE)), 6) AS p, round((exp(embedding[2]::DOUBLE) + exp(embedding[4]::DOUBLE)) / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE))), 6) AS mass FROM embeddings")
def sigmoid_softmax(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.round(V.sigmoid(F.get("embedding", F.lit(0)).cast("double")), 6).alias("p"), F.round(V.softmax_mass("embedding", F.array(F.lit(1), F.lit(3))), 6).alias("mass"))


# ---- prompts and re-parsing


@query("SELECT doc_id, md5('Passage: ' || text || chr(10) || 'Question: ' || lang || chr(10) || 'Answer:') AS said, 2::BIGINT AS n FROM documents")
def prompt_render(spark, sf):
    d = table(spark, sf, "documents").withColumn("m", P.messages("ck", context="text", question="lang"))
    return d.select("doc_id", F.md5(F.try_element_at("m", F.lit(-1))["content"]).alias("said"), F.size("m").cast("long").alias("n"))


@query(f"WITH x AS (SELECT source, CASE doc_id % 3 WHEN 0 THEN coalesce({W.clean('ls[1]')}, '') WHEN 1 THEN coalesce(list_filter(list_transform(ls, lambda s: {W.clean('s')}), lambda s: s <> '')[-1], '') END AS a, ls[1] AS final FROM (SELECT doc_id, source, {RAW_LINES} AS ls FROM documents)) SELECT source, count(*) FILTER (a IS NULL) AS skipped, count(*) FILTER (a = final) AS unchanged, count(*) FILTER (a IS NOT NULL AND a IS DISTINCT FROM final) AS changed FROM x GROUP BY 1")
def reparse_stats(spark, sf):
    i = F.col("doc_id") % 3
    d = _raw(spark, sf).withColumn("method", F.when(i == 0, "implicit_scr").when(i == 1, "explicit_scr").otherwise("dia")).withColumn("final_answer", F.get(T.lines("raw"), F.lit(0))).withColumnRenamed("raw", "raw_response")
    out = I.reparsed(d)
    return out.groupBy("source").agg(*(M.count_if(F.col("state") == s).alias(s) for s in ("skipped", "unchanged", "changed")))


# ---- models: rows-only checks


def _descent(steps: int, rate: float, hold: float, width: int) -> str:
    """Full-batch steps of logistic regression on the first components of each vector, a common table a step."""
    x = [f"embedding[{i + 1}]::DOUBLE" for i in range(width)]
    out = f"WITH d AS (SELECT {', '.join(f'{e} AS x{i}' for i, e in enumerate(x))}, (embedding[1] + embedding[2] > 0)::INT::DOUBLE AS y FROM embeddings), w0 AS (SELECT {', '.join(f'0::DOUBLE AS w{i}' for i in range(width + 1))})"
    for k in range(steps):
        z = " + ".join([*(f"x{i} * w{i}" for i in range(width)), f"w{width}"])
        ups = [f"any_value(w{i}) - {rate} * (sum((p - y) * x{i}) + {hold if i < width else 0} * any_value(w{i})) / count(*) AS w{i}" for i in range(width)]
        ups.append(f"any_value(w{width}) - {rate} * sum(p - y) / count(*) AS w{width}")
        out += f", w{k + 1} AS (SELECT {', '.join(ups)} FROM (SELECT *, 1 / (1 + exp(-({z}))) AS p FROM d, w{k}))"
    return out + f" SELECT {', '.join(f'round(w{i}, 6) AS w{i}' for i in range(width + 1))} FROM w{steps}"


@query(_descent(5, 2.0, 0.5, 4))
def logistic_steps(spark, sf):
    """Weights of a head after five full-batch steps over all rows, summed up task by task."""
    f = F.col("embedding")
    own = table(spark, sf, "embeddings").select(F.slice(f, 1, 4).alias("v"), (F.get(f, F.lit(0)) + F.get(f, F.lit(1)) > 0).cast("int").alias("y"))
    model = parallel.fit_logistic(own, "v", "y", c=2.0, steps=5, rate=2.0)
    return spark.createDataFrame([[round(float(w), 6) for w in model.w]], ", ".join(f"w{i} double" for i in range(5)))


@query()
def probe_lr(spark, sf):
    data = featured(spark, sf)
    model, _, _ = probe.fit_logistic(data, "embedding", "pk", "split")
    return probe.predict(model, data.where("split = 'test'"), "embedding").select("qid", "pk", "p")


@query()
def probe_mlp(spark, sf):
    return probe.mlp_heads(featured(spark, sf), "qid", "embedding", ("pk", "ck"), "split", hidden=(64, 16), epochs=30)


# these register themselves
from . import round_trips as _round_trips  # noqa: E402, F401  sinks, sources and streams
from . import stages as _stages  # noqa: E402, F401  model stages, builders and reports
