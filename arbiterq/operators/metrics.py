"""Tallies and metric blocks: conditional aggregates, one pass each. Ratios stay unrounded; ``rounded`` is for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import CELLS, agreed, cell, disagrees, flag, no_error
from ..functions.text import alias_match, col, matches, stripped
from ..functions.vector import moments
from .order import running_total

#: Counters of a cell.
COUNTERS = ("n", "correct", "either", "pk_only", "ck_only", "abstain", *(f"pred_{c}" for c in CELLS))


def rate(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def rounded(x: Column, places: int = 4) -> Column:
    return F.bround(x, places)


def count_if(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def tallied(df: DataFrame) -> DataFrame:
    """Rows (oracle_cell, answer, ground_truth, pk_answer, ck_answer, predicted_cell) with their counters' flags; rows without a cell go."""
    known = df.where(F.col("oracle_cell").isin(*CELLS))
    said = known.withColumn("__said", matches(stripped("answer"), "ground_truth", *(F.array(stripped(x)) for x in ("pk_answer", "ck_answer"))))
    right, pk, ck = (F.get("__said", F.lit(i)) for i in range(3))
    return said.withColumns({"is_correct": right, "source": agreed(pk, ck)}).drop("__said")


def cube(df: DataFrame, *keys: str) -> DataFrame:
    """Counters by keys and cell; df as from ``tallied``."""
    aggs = [F.count("*").alias("n"), count_if(F.col("is_correct")).alias("correct")]
    aggs += [count_if(F.col("source") == s).alias(s) for s in ("either", "pk_only", "ck_only", "abstain")]
    aggs += [count_if(F.col("predicted_cell") == c).alias(f"pred_{c}") for c in CELLS]
    return df.groupBy(*keys, "oracle_cell").agg(*aggs)


def full_cube(counted: DataFrame, *keys: str) -> DataFrame:
    """All four cells of each key, with zeros where nothing was counted; one pass over ``counted``, whose cells are made columns and rows again."""
    nothing = F.struct(*(F.lit(0).cast("long").alias(c) for c in COUNTERS))
    own = F.struct(*(F.col(c).cast("long").alias(c) for c in COUNTERS))
    by = counted.groupBy(*keys).agg(*(F.coalesce(F.max(F.when(F.col("oracle_cell") == c, own)), nothing).alias(f"__{c}") for c in CELLS))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("oracle_cell"), F.col(f"__{c}").alias("x")) for c in CELLS)))
    return by.select(*keys, each.alias("row")).select(*keys, "row.oracle_cell", "row.x.*")


def merged(*cubes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The element-wise sum of partial cubes."""
    out = cubes[0]
    for c in cubes[1:]:
        out = out.unionByName(c)
    return out.groupBy(*keys, "oracle_cell").agg(*(F.sum(c).alias(c) for c in COUNTERS))


def metric_columns() -> list[Column]:
    """The metric block over rows of a cube (to be used in agg)."""

    def s(c: str, *cells: str) -> Column:
        return F.sum(F.when(F.col("oracle_cell").isin(*cells), F.col(c)).otherwise(0)) if cells else F.sum(c)

    acc = {c: rate(s("correct", c), s("n", c)) for c in CELLS}
    acc_t, acc_f = rate(s("correct", "C01", "C11"), s("n", "C01", "C11")), rate(s("correct", "C00", "C10"), s("n", "C00", "C10"))
    pk, ck = F.sum(F.col("pk_only") + F.col("either")), F.sum(F.col("ck_only") + F.col("either"))
    predicted = sum((F.sum(f"pred_{c}") for c in CELLS[1:]), F.sum(f"pred_{CELLS[0]}"))
    return [
        F.sum("n").alias("n"),
        rate(F.sum("correct"), F.sum("n")).alias("a1_acc"),
        acc_t.alias("cell_acc_t"),
        acc_f.alias("cell_acc_f"),
        ((acc_t + acc_f) / 2).alias("a4_sf"),
        *(acc[c].alias(f"b1_{c.lower()}") for c in CELLS),
        ((acc["C01"] + acc["C10"]) / 2).alias("a4_macro"),
        F.when(predicted > 0, rate(s("pred_C00", "C00"), s("n", "C00"))).alias("b3_c00"),
        rate(pk, pk + ck).alias("c3_mr"),
    ]


def metrics(counted: DataFrame, *keys: str, pooled: bool = False) -> DataFrame:
    """The metric block by keys; pooled adds rows over all values of the last keys (null there)."""
    return (counted.rollup(*keys) if pooled else counted.groupBy(*keys)).agg(*metric_columns())


def report(rows: DataFrame, keys: tuple[str, ...] = ("method", "backbone"), dataset: str = "dataset", everything: str = "ALL_AGG") -> DataFrame:
    """The metric block by keys and dataset, and by keys over all datasets, named ``everything``; rows as ``tallied`` takes them."""
    counted = cube(tallied(rows), *keys, dataset)
    pooled_ = metrics(counted, *keys).withColumn(dataset, F.lit(everything))
    return metrics(counted, *keys, dataset).unionByName(pooled_)


def baseline_evaluation(answers: DataFrame, *keys: str) -> DataFrame:
    """answers (error, final_answer, ground_truth, pk_alias, ck_alias, relation, source, cost, latency) by keys.

    Errors count alone; a missing gold list is no match, a missing behaviour is cell C00, and a missing source is "implicit".
    """
    ok = no_error("error")
    of = cell("pk_alias", "ck_alias")
    right = ok & alias_match("final_answer", "ground_truth")
    t, f = F.col("relation") == "supportive", F.col("relation") == "conflicting"
    return answers.groupBy(*keys).agg(
        count_if(ok).alias("n"), count_if(~ok).alias("n_err"), rate(count_if(right), count_if(ok)).alias("acc"),
        *(count_if(ok & (of == c)).alias(f"n_{c.lower()}") for c in CELLS), *(rate(count_if(right & (of == c)), count_if(ok & (of == c))).alias(f"acc_{c.lower()}") for c in CELLS),
        rate(count_if(right & t), count_if(ok & t)).alias("relation_acc_t"), rate(count_if(right & f), count_if(ok & f)).alias("relation_acc_f"),
        ((rate(count_if(right & t), count_if(ok & t)) + rate(count_if(right & f), count_if(ok & f))) / 2).alias("relation_sf"),
        F.sum(F.when(ok, F.coalesce("cost", F.lit(0.0))).otherwise(0.0)).alias("total_cost"), F.sum(F.when(ok, F.coalesce("latency", F.lit(0.0))).otherwise(0.0)).alias("total_latency"),
    )


def source_distribution(answers: DataFrame, *keys: str) -> DataFrame:
    return answers.where(no_error("error")).groupBy(*keys, F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("implicit")).alias("predicted_source")).agg(F.count("*").alias("n"))


def cell_distribution(rows: DataFrame, *keys: str, pooled: bool = False) -> DataFrame:
    """rows (pk_correct, ck_correct, pk_alias, ck_alias, pk_judge) by keys: final and alias cells, shares, rates, judged rows."""
    final, alias = cell("pk_correct", "ck_correct"), cell("pk_alias", "ck_alias")
    n = F.count("*")
    by = rows.rollup(*keys) if pooled else rows.groupBy(*keys)
    return by.agg(
        n.alias("n_rows"), F.count("pk_judge").alias("n_judged"),
        *(count_if(final == c).alias(f"final_{c.lower()}") for c in CELLS), *(rate(count_if(final == c) * 100, n).alias(f"pct_{c.lower()}") for c in CELLS), *(count_if(alias == c).alias(f"alias_{c.lower()}") for c in CELLS),
        rate(count_if(flag("pk_correct")), n).alias("pk_rate"), rate(count_if(flag("ck_correct")), n).alias("ck_rate"), rate(count_if(final.isin("C01", "C10")) * 100, n).alias("informative_pct"),
    )


def cell_by_relation(rows: DataFrame, relation: str = "relation") -> DataFrame:
    by = rows.groupBy(F.coalesce(F.nullif(F.col(relation), F.lit("")), F.lit("unknown")).alias("relation"))
    of = cell("pk_correct", "ck_correct")
    return by.agg(*(count_if(of == c).alias(c.lower()) for c in CELLS), F.count("*").alias("n"))


def judge_confusion(rows: DataFrame, *keys: str) -> DataFrame:
    """rows (alias, judge) by keys: how alias and judge agree; only judged rows are compared."""
    a, j = flag("alias"), F.col("judge")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count("judge").alias("n_judged"), count_if(a & j).alias("at_jt"), count_if(disagrees("alias", "judge")).alias("at_jf"), count_if(~a & j).alias("af_jt"), count_if(~a & ~j).alias("af_jf"),
        count_if(a).alias("n_alias"), count_if(j).alias("n_judge"), count_if(F.when(j.isNull(), a).otherwise(a & j)).alias("n_final"),
    )


def auroc(df: DataFrame, score: str, label: str, *keys: str) -> DataFrame:
    """Tie-aware area under the ROC curve by keys; null with one class alone.

    Ranks come from counts by score: rows are summed by (keys, score) first, and running totals are made in ranges of the score, so
    that no task holds all scores of a key.
    """
    own = df.select(*keys, F.col(score).alias("__score"), F.col(label).cast("long").alias("__label"))
    by_score = own.groupBy(*keys, "__score").agg(F.sum("__label").alias("__p"), F.count("*").alias("__m"))
    ranked = running_total(by_score, keys, "__score", "__m", "__upto").withColumn("__rank", F.col("__upto") - (F.col("__m") - 1) / F.lit(2.0))
    p, m = F.sum("__p"), F.sum("__m")
    area = F.try_divide(F.sum(F.col("__p") * F.col("__rank")) - p * (p + 1) / F.lit(2.0), (p * (m - p)).cast("double"))
    return ranked.groupBy(*keys).agg(F.when((p > 0) & (m > p), area).alias("auroc"))


def head_metrics(df: DataFrame, score: str, label: str, *keys: str, level: float = 0.5) -> DataFrame:
    said, y = F.col(score) >= level, F.col(label).cast("boolean")
    tp, fp, fn = count_if(said & y), count_if(said & ~y), count_if(~said & y)
    zero = F.lit(0.0)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), rate(count_if(said == y), F.count("*")).alias("accuracy"), F.coalesce(rate(tp, tp + fp), zero).alias("precision"), F.coalesce(rate(tp, tp + fn), zero).alias("recall"), F.coalesce(rate(2 * tp, 2 * tp + fp + fn), zero).alias("f1"))


def latency_quantiles(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, mean, p50 and p95 by keys; the quantiles by index (place n // 2 and int(0.95 n) of the sorted values), not interpolated.

    Values are counted first; the two places are found among running counts of distinct values, made in ranges.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("m"))
    ranked = running_total(counted, keys, value, "m", "top", "n")

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("top") > place, F.col(value)))

    mean = F.sum(F.col(value) * F.col("m")) / F.max("n")
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), mean.alias("mean"), at(F.floor(F.col("n") / 2)).alias("p50"), at(F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1)).alias("p95"))


def call_summary(calls: DataFrame, *keys: str) -> DataFrame:
    """calls (error, latency_sec, prompt_tokens, completion_tokens, cost_usd) by keys: calls, errors, tokens, cost, and the latency of those without an error.

    By model it is the report of a run; by key number that of each key.
    """
    ok = no_error("error")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    counts = calls.groupBy(*keys).agg(F.count("*").alias("calls"), count_if(~ok).alias("errors"), total("prompt_tokens"), total("completion_tokens"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"))
    took = latency_quantiles(calls.where(ok), "latency_sec", *keys).drop("n")
    if not keys:
        return counts.join(took, how="left")  # one row each
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return counts.alias("l").join(took.alias("r"), same, "left").select(*(f"l.{c}" for c in counts.columns), "r.mean", "r.p50", "r.p95")


def truncation(df: DataFrame, flag_: str, *keys: str) -> DataFrame:
    """Rows, truncated rows and their share by keys; an empty table has share 0."""
    n = F.count("*")
    return df.groupBy(*keys).agg(n.alias("n"), count_if(F.col(flag_)).alias("n_truncated"), (count_if(F.col(flag_)) / F.greatest(n, F.lit(1))).alias("truncation_rate"))


def standardised(df: DataFrame, vec: str, train: Column) -> DataFrame:
    """``df`` with its vector column scaled by mean and population deviation of the rows where ``train`` holds; a constant is 0. Without
    rows to fit on, every component is 0. The fit is one row."""
    one = df.sparkSession.range(1).select(F.lit(1).alias("one"))
    row = one.join(moments(df.where(train), vec), F.lit(True), "left").select(F.col("mean").alias("__mean"), F.col("dev").alias("__dev"))
    scaled = F.transform(F.col(vec), lambda x, i: F.coalesce(F.try_divide(x.cast("double") - F.get("__mean", i), F.get("__dev", i)), F.lit(0.0)))
    return df.crossJoin(F.broadcast(row)).withColumn(vec, scaled).drop("__mean", "__dev")
