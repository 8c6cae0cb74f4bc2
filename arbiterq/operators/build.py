"""Builders: raw question records to question-context rows, one explode each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alias_match, col, stripped, text
from ..sources.records import ROW


def something(*alternatives: Column | str) -> Column:
    """The first alternative that is not empty; null if none is."""
    return F.coalesce(*(F.nullif(text(a), F.lit("")) for a in alternatives))


def all_present(*columns: str) -> Column:
    """Whether every field says something."""
    out = F.lit(True)
    for c in columns:
        out = out & (text(c) != "")
    return out


def qid(dataset: Column | str, idx: Column | str, suffix: Column | str, width: int = 6) -> Column:
    return F.format_string(f"%s-%0{width}d-%s", col(dataset), col(idx).cast("long"), suffix if isinstance(suffix, Column) else F.lit(suffix))


def aliases(answer: Column | str, others: Column | str) -> Column:
    """The answer first, then its aliases; no repeats and nothing empty."""
    every = F.concat(F.array(text(answer)), F.coalesce(col(others), F.array().cast("array<string>")))
    return F.array_distinct(F.filter(every, lambda a: a.isNotNull() & (a != "")))


def as_list(x: Column | str, scalar: bool = False) -> Column:
    """A scalar or an array of strings, stripped and without empty ones, as an array; null is empty."""
    own = F.array(col(x).cast("string")) if scalar else F.coalesce(col(x), F.array().cast("array<string>"))
    return F.filter(F.transform(own, lambda s: stripped(s)), lambda s: s != "")


def either_list(x: Column | str) -> Column:
    """An array from a text that holds a JSON array of strings, or else is a scalar itself."""
    many = F.from_json(col(x), "array<string>")
    return F.when(F.startswith(stripped(x), F.lit("[")) & many.isNotNull(), as_list(many)).otherwise(as_list(x, scalar=True))


def question_format(options: Column | str) -> Column:
    n = F.coalesce(F.size(col(options)), F.lit(0))
    return F.when(n.between(2, 5), F.concat(F.lit("mc-"), n.cast("string"))).otherwise("open")


def family(dataset: Column | str) -> Column:
    return F.split_part(col(dataset), F.lit("-"), F.lit(1))


#: A text in quotes of either kind, as Python writes it.
QUOTED = r"'(?:[^'\\]|\\.)*'" + r'|"(?:[^"\\]|\\.)*"'


def hop_count(path: Column | str) -> Column:
    """The length of a list written as a Python literal of strings or of lists of strings; null for anything else.

    Texts in quotes, apostrophes and all, are made one letter first, so that what is left is brackets, letters and commas.
    """
    bare = F.regexp_replace(F.regexp_replace(text(path), QUOTED, "x"), r"\s+", "")
    item = r"(?:x|\[(?:x(?:,x)*,?)?\]|\((?:x(?:,x)*,?)?\))"
    listed = bare.rlike(rf"^(?:\[(?:{item}(?:,{item})*,?)?\]|\((?:{item}(?:,{item})*,?)?\))$")
    inner = F.regexp_replace(F.substring(bare, F.lit(2), F.length(bare) - 2), r"\[[^\]]*\]|\([^)]*\)", "x")
    return F.when(listed, F.length(F.regexp_replace(inner, ",", "")))


def supportiveness(answer: Column | str, gold: Column | str) -> Column:
    return F.when(alias_match(answer, gold), "supportive").otherwise("conflicting")


def sides(**fields: tuple[Column, Column]) -> Column:
    """A supportive and a conflicting struct, to be exploded; fields: name to its two values."""
    return F.explode(F.array(*(F.struct(F.lit(r).alias("ck_relation"), *(v[i].alias(k) for k, v in fields.items())) for i, r in enumerate(("supportive", "conflicting")))))


def variants(*named: tuple[str, str, Column]) -> Column:
    """(sub_type, ck_relation, ck_text) structs whose text is not empty, to be exploded."""
    every = F.array(*(F.struct(F.lit(n).alias("sub_type"), F.lit(r).alias("ck_relation"), t.alias("ck_text")) for n, r, t in named))
    return F.explode(F.filter(every, lambda v: F.coalesce(v["ck_text"], F.lit("")) != ""))


def pair_rows(raw: DataFrame, dataset: str) -> DataFrame:
    """(raw_idx, question, gold, gold_aliases, false, true_context, false_context) to two rows each; incomplete records go."""
    whole = raw.where(all_present("question", "gold", "false", "true_context", "false_context"))
    gold = aliases("gold", "gold_aliases")
    both = whole.select(F.lit(dataset).alias("dataset"), "raw_idx", "question", gold.alias("ground_truth"), sides(ck_text=(F.col("true_context"), F.col("false_context")), ck_target_answer=(F.col("gold"), F.col("false")), suffix=(F.lit("sup"), F.lit("conf"))).alias("x"))
    out = both.select("dataset", "raw_idx", "question", "ground_truth", "x.*")
    return out.withColumn("qid", qid("dataset", "raw_idx", F.col("suffix"))).withColumn("ck_target_matches_gt", alias_match("ck_target_answer", "ground_truth")).drop("suffix")


def metadata(**fields: Column | str) -> Column:
    """A record's metadata; what says nothing is an empty text."""
    return F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), text(v))))


def with_metadata(base: Column | str, **more: Column | str) -> Column:
    """Metadata with further entries, which win over those of the same name."""
    return F.map_concat(F.map_filter(col(base), lambda k, _: ~k.isin(*more)), metadata(**more)) if more else col(base)


def record(dataset: str, family_: str, suffix: Column | str, width: int = 6, **columns: Column) -> list[Column]:
    """The columns of a question-context row, in their order; what isn't given is null."""
    kinds = dict(c.strip().split(" ", 1) for c in ROW.replace("MAP<STRING, STRING>", "MAP<STRING:STRING>").replace("\n", " ").split(","))
    fixed = {"dataset": F.lit(dataset), "dataset_family": F.lit(family_), "qid": qid(F.lit(dataset), "raw_idx", suffix, width), "raw_idx": F.col("raw_idx"), "ck_relation_is_core": columns["ck_relation"].isin("supportive", "conflicting")}
    own = fixed | columns
    return [own.get(c, F.lit(None)).cast(k.replace(":", ", ")).alias(c) for c, k in kinds.items()]


def counterfactual_pairs(raw: DataFrame, dataset: str, family_: str = "counterfactual") -> DataFrame:
    """(raw_idx, question, orig_answer, cf_answer, orig_context or orig_context_piece, cf_context or cf_context_piece, orig_alias, cf_alias,
    orig_path, orig_path_labeled, cf_path_labeled): a supportive row with the original context and a conflicting one with the counterfactual."""
    own = raw.withColumns({"__true": something("orig_context", "orig_context_piece"), "__false": something("cf_context", "cf_context_piece")}).where(all_present("question", "orig_answer", "cf_answer", "__true", "__false"))
    listed = lambda c: F.to_json(F.coalesce(F.col(c), F.array().cast("array<string>")))
    also = F.to_json(F.concat(F.array("cf_answer"), F.coalesce(F.col("cf_alias"), F.array().cast("array<string>"))))
    meta = metadata(orig_alias=listed("orig_alias"), cf_alias=listed("cf_alias"), cf_answer_aliases=also, orig_path_labeled="orig_path_labeled", cf_path_labeled="cf_path_labeled")
    own = own.withColumns({"__gold": aliases("orig_answer", "orig_alias"), "__meta": meta, "__hops": hop_count("orig_path")})
    both = own.select("*", sides(target=(F.col("orig_answer"), F.col("cf_answer")), said=(F.col("__true"), F.col("__false")), suffix=(F.lit("sup"), F.lit("conf"))).alias("x"))
    return both.select(*record(dataset, family_, F.col("x.suffix"), question=F.col("question"), question_format=F.lit("open"), ground_truth=F.col("__gold"), ground_truth_text=F.col("orig_answer"), ground_truth_origin=F.lit("wikidata+aliases"),
        ck_text=F.col("x.said"), ck_text_origin=F.lit("llm_synth"), ck_target_answer=F.col("x.target"), ck_target_matches_gt=alias_match("x.target", "__gold"), ck_relation=F.col("x.ck_relation"), ck_relation_source=F.lit("rule_hardcoded"),
        hop_count=F.col("__hops"), metadata=F.col("__meta")))


def memory_pairs(raw: DataFrame, dataset: str, family_: str = "memory", source_model: str | None = None) -> DataFrame:
    """(raw_idx, question, ground_truth: a text or a JSON array in one, memory_answer, counter_answer, parametric_memory_aligned_evidence,
    counter_memory_aligned_evidence, popularity, subj, property): a row for each evidence, supportive if its answer says the gold."""
    fields = ("memory_answer", "counter_answer", "parametric_memory_aligned_evidence", "counter_memory_aligned_evidence")
    own = raw.where(all_present("question", *fields)).withColumn("__gold", either_list("ground_truth")).where(F.size("__gold") > 0)
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("suffix"), stripped(a).alias("target"), F.col(e).alias("said"), F.lit(e).alias("field")) for s, a, e in (("param", fields[0], fields[2]), ("counter", fields[1], fields[3])))))
    both = own.select("*", each.alias("x")).withColumn("__right", alias_match("x.target", "__gold"))
    return both.select(*record(dataset, family_, F.col("x.suffix"), question=F.col("question"), question_format=F.lit("open"), ground_truth=F.col("__gold"), ground_truth_text=F.get("__gold", F.lit(0)), ground_truth_origin=F.lit("wikidata+aliases"),
        ck_text=F.col("x.said"), ck_text_origin=F.lit("llm_synth_model_specific"), ck_target_answer=F.col("x.target"), ck_target_matches_gt=F.col("__right"), ck_relation=F.when(F.col("__right"), "supportive").otherwise("conflicting"), ck_relation_source=F.lit("alias_match"),
        hop_count=F.lit(1), source_model=F.lit(source_model), metadata=with_metadata(metadata(popularity="popularity", subject_desc="subj", property="property"), ck_source_field="x.field")))


#: The conflicting evidences of a record and their columns (text, claim, category).
CONFLICTS = {
    "misinformation": ("misinformation_conflict_evidence_evidence", "misinformation_conflict_claim", "misinformation_conflict_evidence_category"),
    "temporal": ("temporal_conflict_evidence", "temporal_conflict_claim", "temporal_conflict_evidence_category"),
    "semantic": ("semantic_conflict_evidence", "semantic_conflict_claim", "semantic_conflict_evidence_category"),
}
NOTES = ("relation", "subject", "subject_description", "object_description", "replaced_description", "correct_option", "replace_option", "uncertain_option", "semantic_description")


def evidence_variants(raw: DataFrame, dataset: str, family_: str = "evidence") -> DataFrame:
    """(raw_idx, question, options, object, replaced_object, NOTES, default_evidence with claim and category, those of CONFLICTS,
    temporal_conflict_time_span): a supportive row and up to three conflicting ones; evidence that says nothing has no row."""
    own = raw.where(all_present("question") & (F.size("options") > 0) & (stripped("object") != "")).withColumn("__gold", F.array(stripped("object")))
    kinds = {"": ("default_evidence", "default_claim", "default_evidence_category")} | CONFLICTS
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(e).alias("said"), F.col(c).alias("claim"), F.col(g).alias("category")) for k, (e, c, g) in kinds.items()))
    rows = own.select("*", F.explode(F.filter(each, lambda v: text(v["said"]) != "")).alias("x"))
    sup = F.col("x.kind") == ""
    span = F.when(F.col("x.kind") == "temporal", F.to_json(F.col("temporal_conflict_time_span")))
    meta = with_metadata(metadata(**{n: n for n in NOTES}), ck_claim="x.claim", ck_evidence_category="x.category")
    meta = F.when(span.isNotNull(), F.map_concat(meta, F.create_map(F.lit("ck_extra"), span))).otherwise(meta)
    suffix = F.when(sup, "sup").otherwise(F.concat(F.lit("conf_"), F.col("x.kind")))
    target = F.when(sup, stripped("object")).otherwise(stripped("replaced_object"))
    return rows.select(*record(dataset, family_, suffix, 7, question=F.col("question"), question_format=question_format("options"), options=F.col("options"), ground_truth=F.col("__gold"), ground_truth_text=stripped("object"), ground_truth_origin=F.lit("wikidata"),
        ck_text=F.col("x.said"), ck_text_origin=F.lit("llm_synth"), ck_target_answer=target, ck_target_matches_gt=alias_match(target, "__gold"), ck_relation=F.when(sup, "supportive").otherwise("conflicting"), ck_relation_source=F.lit("rule_hardcoded"),
        ck_sub_type=F.nullif(F.col("x.kind"), F.lit("")), hop_count=F.lit(1), metadata=meta))


def document_pairs(raw: DataFrame, dataset: str) -> DataFrame:
    """(raw_idx, raw_split, question, answers, correct_doc, wrong_doc, correct_answer, wrong_answer, question_id, original_id, url): a row with the
    right document and one with the wrong one; the family is the dataset's name up to its first dash."""
    own = raw.where((stripped("question") != "") & (F.size("answers") > 0))
    name = F.coalesce(something("question_id", "original_id"), F.concat(F.lit("row"), F.col("raw_idx").cast("string")))
    meta = metadata(raw_qid=name, raw_split="raw_split", url="url", given_correct_answer="correct_answer", given_wrong_answer="wrong_answer")
    said = lambda c: F.nullif(stripped(c), F.lit(""))
    both = own.select("*", sides(target=(said("correct_answer"), said("wrong_answer")), said=(said("correct_doc"), said("wrong_doc")), origin=(F.lit("natural"), F.lit("llm_synth")), suffix=(F.lit("sup"), F.lit("conf"))).alias("x"))
    return both.select(*record(dataset, dataset.split("-")[0], F.col("x.suffix"), raw_split=F.col("raw_split"), question=stripped("question"), question_format=F.lit("open"), ground_truth=F.col("answers"), ground_truth_text=F.get("answers", F.lit(0)), ground_truth_origin=F.lit("source_document"),
        ck_text=F.col("x.said"), ck_text_origin=F.col("x.origin"), ck_target_answer=F.col("x.target"), ck_target_matches_gt=alias_match("x.target", "answers"), ck_relation=F.col("x.ck_relation"), ck_relation_source=F.lit("rule_hardcoded"),
        hop_count=F.lit(1), metadata=meta))


#: Builders that a user can add to: name to a function of (raw DataFrame, dataset name).
BUILDERS: dict[str, Callable[[DataFrame, str], DataFrame]] = {"pair": pair_rows, "counterfactual_pairs": counterfactual_pairs, "memory_pairs": memory_pairs, "evidence_variants": evidence_variants, "document_pairs": document_pairs}


def builder(name: str) -> Callable[[DataFrame, str], DataFrame]:
    if name not in BUILDERS:
        raise KeyError(f"no builder {name!r}; there are {sorted(BUILDERS)}")
    return BUILDERS[name]


def pooled(*datasets: DataFrame) -> DataFrame:
    """Datasets one after the other, by column name; columns that some lack are null there."""
    out = datasets[0]
    for d in datasets[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def build_totals(summary: DataFrame) -> DataFrame:
    """A row of totals over the summaries of datasets."""
    return summary.agg(F.count("*").alias("n_datasets"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in summary.columns if c.startswith("n_")))
