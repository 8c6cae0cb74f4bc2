"""The corpus pipeline: five stages from raw documents to packed training bins.

Each stage is (spark, docs, sf_dir) -> DataFrame and works on all that its predecessor kept; ``run`` writes each result as Parquet
into the shared folder, hands the reread table on, and deletes it once the next one is written. All but the last return the columns of
documents as they came. Null texts and ids, repeated rows and empty tables are taken as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbiterq.llm import best_fit, fair_mix, line_dedup, line_rules, simhash_vptree
from arbiterq.llm.common import documents, forget, fresh, n_words, written


def with_text(df: DataFrame, columns: list[str], text) -> DataFrame:
    """The given columns with another text, and n_chars to match it where there is such a column."""
    new = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in columns else {})
    return df.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; lines that fail go from the rest."""
    name = fresh(docs, "rules")
    out = line_rules.judged(docs, name).where(F.col(f"{name}.kept"))
    return with_text(out, docs.columns, F.col(f"{name}.clean_text"))


#: Share of its words that a document must keep when lines that copy earlier ones go.
LEAST_LEFT = 0.25


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that copy an earlier one go. A document that loses more than three quarters of its words goes whole: it is a near copy,
    and what is left of it would no longer be found as one."""
    name = fresh(docs, "lines")
    left = n_words(F.col(f"{name}.text"))
    out = line_dedup.deduped(docs, name).where((left > 0) & (left >= F.lit(LEAST_LEFT) * n_words(F.col("text"))))
    return with_text(out, docs.columns, F.col(f"{name}.text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return simhash_vptree.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 3 times."""
    row = fresh(docs, "row")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "mix-docs")
    taken = fair_mix.mixed(numbered.select(F.col(row).alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size"))).select(F.col("row").alias(f"{row}r"), F.col("passes").alias(f"{row}p")).where(f"`{row}p` > 0")
    out = numbered.join(taken, F.col(row) == F.col(f"{row}r")).withColumn(f"{row}k", F.explode(F.expr(f"sequence(1, cast(`{row}p` as int))")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece: document, place in it, and place in its bin."""
    return best_fit.packed(docs.select("doc_id", n_words(F.col("text")).alias("size")))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup_stage), ("simhash_near_dedup", near_dedup), ("fair_mix", mix), ("best_fit_packing", packing)]

#: Fuzzy components and best-fit bins are beyond SQL; tests/llm/test_pipeline.py compares the rows of every stage with plain Python's.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs, last = written(stage(spark, docs, sf_dir), f"stage-{name}"), before
        if last is not None:
            forget(last)
        before = docs
    return docs
