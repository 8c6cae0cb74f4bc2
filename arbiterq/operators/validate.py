"""Row rules and dataset rules of question-context rows, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The vocabularies.
RELATIONS = ("supportive", "conflicting", "irrelevant", "complementary")
CORE_RELATIONS = ("supportive", "conflicting")
GOLD_ORIGINS = ("wikidata", "wikidata+aliases", "source_document", "human_annotation")
CONTEXT_ORIGINS = ("natural", "natural_rule_perturbed", "natural_noise", "llm_synth", "llm_synth_model_specific", "cross_question_swap")
RELATION_SOURCES = ("rule_hardcoded", "rule_string_match", "alias_match", "dataset_native_label", "cross_question_swap")
FORMATS = ("open", "mc-2", "mc-3", "mc-4", "mc-5", "yes_no")
FORBIDDEN_KEYS = (
    "is_know_pk", "is_know_ck", "pk_answer", "ck_answer", "pk_correct", "ck_correct", "pk_correct_lex", "ck_correct_lex", "first_token_entropy",
    "span_mean_entropy", "semantic_entropy", "confidence_gain", "entropy_no_ck", "entropy_with_ck", "hidden_states", "sampled_answers", "logp",
)


def rules() -> dict[str, Column]:
    """Rule name to the condition that breaks it."""
    c, has = F.col, lambda x: F.coalesce(x, F.lit(False))
    return {
        "relation": ~has(c("ck_relation").isin(*RELATIONS)),
        "core": ~has(c("ck_relation_is_core") == has(c("ck_relation").isin(*CORE_RELATIONS))),
        "gold_origin": ~has(c("ground_truth_origin").isin(*GOLD_ORIGINS)) | has(F.contains(F.lower("ground_truth_origin"), F.lit("llm"))),
        "context_origin": ~has(c("ck_text_origin").isin(*CONTEXT_ORIGINS)),
        "relation_source": ~has(c("ck_relation_source").isin(*RELATION_SOURCES)) | has(F.lower("ck_relation_source").rlike("llm|judge")),
        "format": ~has(c("question_format").isin(*FORMATS)),
        "options": has(F.startswith("question_format", F.lit("mc-"))) & ~has(F.size("options") > 0),
        "ground_truth": ~has(F.size("ground_truth") > 0),
        "ground_truth_text": ~has(c("ground_truth_text") != ""),
        "question": ~has(c("question") != ""),
        "metadata": has(F.size(F.array_intersect(F.map_keys("metadata"), F.array(*map(F.lit, FORBIDDEN_KEYS)))) > 0),
    }


def violations(df: DataFrame) -> DataFrame:
    """``df`` with the names of the broken rules, and the soft warning on supportive rows that miss the gold."""
    broken = F.array_compact(F.array(*(F.when(cond, name) for name, cond in rules().items())))
    soft = F.coalesce((F.col("ck_relation") == "supportive") & F.col("ck_target_answer").isNotNull() & (F.col("ck_target_matches_gt") == F.lit(False)), F.lit(False))
    return df.withColumn("violations", broken).withColumn("warned", soft)


def validated(df: DataFrame) -> DataFrame:
    """``df``; a row that breaks a rule stops the query."""
    ok = F.assert_true(F.size("violations") == 0, F.concat_ws(" ", F.lit("qid"), F.col("qid").cast("string"), F.lit("breaks"), F.array_join("violations", ",")))
    return violations(df).where(ok.isNull()).drop("violations", "warned")


def dataset_summary(df: DataFrame) -> DataFrame:
    """Rows by dataset and relation, and whether both core relations are there."""
    counts = {r: F.count_if(F.coalesce(F.col("ck_relation") == r, F.lit(False))) for r in RELATIONS}
    return df.groupBy("dataset").agg(F.count("*").alias("n_rows"), *(x.alias(f"n_{r}") for r, x in counts.items()), ((counts["supportive"] > 0) & (counts["conflicting"] > 0)).alias("has_both"))


def checked_summary(df: DataFrame, name: str | None = None) -> DataFrame:
    """``dataset_summary``; a dataset without both core relations, or of another name than ``name`` where that is given, stops the query."""
    own = dataset_summary(df)
    both = F.assert_true(F.col("has_both"), F.concat(F.lit("no rows of both relations in "), F.coalesce("dataset", F.lit("null"))))
    named = F.assert_true(F.col("dataset").eqNullSafe(F.lit(name)), F.concat(F.lit("another dataset: "), F.coalesce("dataset", F.lit("null")))) if name is not None else F.lit(None)
    return own.where(both.isNull() & named.isNull())
