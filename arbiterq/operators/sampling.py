"""Splits and samples. The order of every draw is md5 of seed and key: the same on every run, engine and partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import cell
from ..sources.records import sent
from .order import placed, placed_by_draw

SEED = "42"


def draw(key: Column | str, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def size_of(n: Column, share: float) -> Column:
    """round(n * share), halves to even."""
    return F.bround(n * F.lit(float(share))).cast("long")


def groups_of(df: DataFrame, dataset: str, group: str, key: str) -> DataFrame:
    """(dataset, group, keys): the keys of each group, in order."""
    return df.groupBy(F.col(dataset).alias("dataset"), F.col(group).alias("group")).agg(F.array_sort(F.collect_list(key)).alias("keys"))


def grouped_split(df: DataFrame, dataset: str, group: str, val: float = 0.1, test: float = 0.1, seed: str = SEED) -> DataFrame:
    """(dataset, group, split): whole groups go to test first, then val, the rest to train, within each dataset.

    Groups are numbered among themselves (a row a group), never among rows, and in ranges of the draw, so that no task holds a dataset.
    """
    groups = df.select(F.col(dataset).alias("dataset"), F.col(group).alias("group")).distinct()
    own = placed_by_draw(groups, ["dataset"], draw("group", seed), "group", "at", "n").withColumn("n_test", size_of(F.col("n"), test)).withColumn("n_val", size_of(F.col("n"), val))
    return own.select("dataset", "group", F.when(F.col("at") <= F.col("n_test"), "test").when(F.col("at") <= F.col("n_test") + F.col("n_val"), "val").otherwise("train").alias("split"))


def split_stats(rows: DataFrame, split: DataFrame) -> DataFrame:
    """Groups and rows of each split by dataset; rows: (dataset, group)."""
    by = rows.groupBy("dataset", "group").agg(F.count("*").alias("n")).join(split, ["dataset", "group"])
    return by.groupBy("dataset", "split").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"))


def fallback_split(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """(dataset, qid, split): by manifest (qid, split), or by place among sorted ids, 80/10/10, for datasets that it doesn't have."""
    found = rows.join(manifest, "qid", "left")
    known = found.groupBy("dataset").agg(F.count("split").alias("in_manifest"))
    there = found.join(known, "dataset")
    absent = placed(there.where("in_manifest = 0").select("dataset", "qid"), ["dataset"], "qid", "at", "n")
    a, b = F.floor(F.col("n") * F.lit(0.8)), F.floor(F.col("n") * F.lit(0.8)) + F.floor(F.col("n") * F.lit(0.1))
    by_place = absent.select("dataset", "qid", F.when(F.col("at") <= a, "train").when(F.col("at") <= b, "val").otherwise("test").alias("split"))
    return there.where("in_manifest > 0 and split is not null").select("dataset", "qid", "split").unionByName(by_place)


def top_k(df: DataFrame, by: str, k: int) -> DataFrame:
    """The k most frequent values, ties by value."""
    return df.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(k)


def per_stratum(df: DataFrame, stratum: str, key: str, n: int, seed: str = SEED) -> DataFrame:
    at = F.row_number().over(Window.partitionBy(stratum).orderBy(draw(key, seed), key))
    return df.withColumn("__at", at).where(F.col("__at") <= n).drop("__at")


def stratified_sample(df: DataFrame, stratum: str, key: str, target: int, k: int, seed: str = SEED) -> DataFrame:
    """``target`` rows of the k most frequent strata: an equal share each, topped up by draw; all of them if there are fewer."""
    strata = top_k(df, stratum, k)
    pool = df.join(F.broadcast(strata.select(stratum)), stratum, "left_semi")  # k rows
    share = math.ceil(target / max(1, strata.count()))
    chosen = per_stratum(pool, stratum, key, share, seed)
    more = pool.join(chosen.select(key), key, "left_anti")
    out = chosen.withColumn("__turn", F.lit(0)).unionByName(more.withColumn("__turn", F.lit(1)))
    return out.orderBy("__turn", draw(key, seed), key).limit(target).drop("__turn")


def balanced_sample(rows: DataFrame, key: str, pk: str, ck: str, n: int | None, seed: str = SEED) -> DataFrame:
    """n labelled rows, max(1, n // 4) of each cell in the order C10, C01, C11, C00, topped up by draw; n null or too large: all rows."""
    if n is None or rows.limit(n + 1).count() <= n:
        return rows
    share = max(1, n // 4)
    labelled = rows.where(F.col(pk).isNotNull() & F.col(ck).isNotNull()).withColumn("__cell", cell(pk, ck)).withColumn("__draw", draw(key, seed))
    order = F.array_position(F.array(*map(F.lit, ("C10", "C01", "C11", "C00"))), F.col("__cell"))
    # top k by draw, of each cell and of all: both keep a few rows a task before anything is dealt
    at = F.row_number().over(Window.partitionBy("__cell").orderBy("__draw", key))
    chosen = labelled.withColumn("__at", at).where(F.col("__at") <= share).withColumn("__rank", order).drop("__at")
    more = labelled.orderBy("__draw", key).limit(n + 4 * share).join(sent(chosen.select(key)), key, "left_anti").withColumn("__rank", F.lit(9))  # 4 * share rows
    return chosen.unionByName(more.select(chosen.columns)).orderBy("__rank", "__draw", key).limit(n).drop("__cell", "__draw", "__rank")


def audit_sample(rows: DataFrame, key: str, most: int = 50, seed: str = SEED) -> DataFrame:
    """At most ``most`` rows an axis where the alias says right and the judge wrong; rows: (key, pk_alias, pk_judge, ck_alias, ck_judge)."""
    axes = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(f"{a}_alias").alias("alias"), F.col(f"{a}_judge").alias("judge")) for a in ("pk", "ck"))))
    said = rows.select(key, axes.alias("x")).select(key, "x.axis", "x.alias", "x.judge").where("alias and judge = false")
    at = F.row_number().over(Window.partitionBy("axis").orderBy(draw(key, seed), key))
    return said.withColumn("at", at).where(F.col("at") <= most).select("axis", key)
