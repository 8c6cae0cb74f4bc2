"""Joins of the evaluation data: equality only. Semi and anti joins take the place of id sets; nothing is sent to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import is_done


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``; one aggregation with partial results, no sort of rows."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__row")).select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest))


def first_wins(df: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """The first row of each key by ``rank``, a total order within the key."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(rank))
    return df.withColumn("__at", at).where("__at = 1").drop("__at")


def features(meta: DataFrame, behaviour: DataFrame, rows: DataFrame) -> DataFrame:
    """Vectors with labels and rows, on qid; behaviour and rows must have a row a qid (see ``latest``)."""
    return meta.join(behaviour, "qid").join(rows, "qid")


def allowed(behaviour: DataFrame, rows: DataFrame, allow: DataFrame | None = None) -> DataFrame:
    """Behaviour with rows, for the allowed qids; none given or none in it: all."""
    joined = behaviour.join(rows, "qid")
    return joined if allow is None or not allow.limit(1).count() else joined.join(allow.select("qid"), "qid", "left_semi")


def selected(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows that the manifest names, by qid."""
    return rows.join(manifest.select("qid"), "qid", "left_semi").orderBy("qid")


def pending(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a finished result; results with an error are done again."""
    return rows.join(done.where(is_done("error")).select(*keys), keys, "left_anti")


def strict_lookup(rows: DataFrame, gold: DataFrame, key: str = "qid") -> DataFrame:
    """Rows with their gold; a row without one stops the query."""
    joined = rows.join(gold.withColumn("__there", F.lit(True)), key, "left")
    ok = F.assert_true(F.col("__there").isNotNull(), F.concat(F.lit("no gold for "), F.col(key).cast("string")))
    return joined.where(ok.isNull()).drop("__there")


def aligned(df: DataFrame, qid: str, k: str, n_k: int) -> DataFrame:
    """Rows of the qids that have all ``n_k`` values of k."""
    whole = df.groupBy(qid).agg(F.count_distinct(k).alias("__k")).where(F.col("__k") == n_k).select(qid)
    return df.join(whole, qid, "left_semi")


def both_sides(df: DataFrame, keys: list[str], side: str, value: str, sides: tuple[str, ...] = ("PK", "CK")) -> DataFrame:
    """One row for each key that has a value on every side, a column a side."""
    out = df.groupBy(*keys).pivot(side, list(sides)).agg(F.max(value))
    for s in sides:
        out = out.where(F.col(s).isNotNull())
    return out


def evaluated(answers: DataFrame, rows: DataFrame, behaviour: DataFrame) -> DataFrame:
    """Answers with their row and behaviour, by qid and, of behaviour, backbone: an answer without either is left out. rows: (qid, ground_truth,
    ck_relation); behaviour: (qid, model_key, answers, labels)."""
    by = behaviour.select("qid", F.col("model_key").alias("backbone"), "pk_answer", "ck_answer", "pk_correct_alias", "ck_correct_alias")
    return answers.join(rows.select("qid", "ground_truth", "ck_relation"), "qid").join(by, ["qid", "backbone"])


def evaluated_outer(answers: DataFrame, rows: DataFrame, behaviour: DataFrame) -> DataFrame:
    """As ``evaluated``, but every answer stays: without a row its gold list is empty, without behaviour both labels are false."""
    by = behaviour.select("qid", F.col("model_key").alias("backbone"), "pk_answer", "ck_answer", "pk_correct_alias", "ck_correct_alias")
    both = answers.join(rows.select("qid", "ground_truth", "ck_relation"), "qid", "left").join(by, ["qid", "backbone"], "left")
    nothing = F.array().cast("array<string>")
    return both.withColumns({"ground_truth": F.coalesce("ground_truth", nothing), **{c: F.coalesce(c, F.lit(False)) for c in ("pk_correct_alias", "ck_correct_alias")}})


#: A key with more than this part of all rows is sent to every executor: there are fewer such keys than this.
HOT = 4096


def hot_joined(rows: DataFrame, of: DataFrame, on: list[str]) -> DataFrame:
    """Inner join, nulls equal, of many rows with a table that has each key once, where one key may hold a large part of the rows.

    Keys with more than a 4,096th of all rows are fewer than 4,096, whatever the table: they are broadcast, and their rows stay where they are.
    All other rows are shuffled by key.
    """

    def meet(x: DataFrame, y: DataFrame, how: str, small: bool = False) -> DataFrame:
        named = y.withColumnsRenamed({c: f"__of_{c}" for c in on})
        same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in on]
        return x.join(F.broadcast(named) if small else named, same, how).drop(*(f"__of_{c}" for c in on))

    hot = rows.groupBy(*on).agg(F.count("*").alias("__n")).where(F.col("__n") * HOT > rows.count()).select(*on)
    return meet(rows, meet(of, hot, "left_semi", True), "inner", True).unionByName(meet(meet(rows, hot, "left_anti", True), of, "inner"))


def in_split(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows with the split that the manifest (dataset, qid, split) gives them; rows that it doesn't name are left out."""
    return rows.join(manifest.select("dataset", "qid", "split"), ["dataset", "qid"])


def trace_rows(traces: DataFrame, rows: DataFrame, behaviour: DataFrame, k: int) -> DataFrame:
    """The k-th traces of both sides of a row as columns pk_trace and ck_trace, with question, context and both labels; a row that lacks a
    side, its record or its behaviour is left out."""
    own = both_sides(traces.where(F.col("k") == k), ["qid"], "side", "trace").withColumnsRenamed({"PK": "pk_trace", "CK": "ck_trace"})
    return own.join(rows.select("qid", "dataset", "question", "ck_text"), "qid").join(behaviour.select("qid", "pk_correct_alias", "ck_correct_alias"), "qid")


#: Aliases that may be sent to every executor.
MOST_SENT = 100_000


def contained(aliases: DataFrame, texts: DataFrame, alias: str, text: str, key: str) -> DataFrame:
    """Pairs where a text has the alias's whole words in a row; both columns normalised.

    Blocked by a word of the alias, so that the join is on equality. A counted few aliases are sent to the texts, which are read once and never
    leave their place, and meet on the alias's longest word. More of them meet on their rarest word: each text deals its key (unique) with its
    distinct words, and is read again for the pairs alone.
    """
    hit: Column = F.contains(F.concat(F.lit(" "), F.col(text), F.lit(" ")), F.concat(F.lit(" "), F.col(alias), F.lit(" ")))
    words = lambda c: F.array_distinct(F.split(c, " "))
    if aliases.limit(MOST_SENT + 1).count() <= MOST_SENT:
        longest = F.array_max(F.transform(words(alias), lambda w: F.struct(F.length(w), w.alias("w"))))["w"]
        few = aliases.where(F.col(alias) != "").withColumn("__word", longest)
        return texts.withColumn("__word", F.explode(words(text))).join(F.broadcast(few), "__word").where(hit).drop("__word")
    dealt = texts.select(key, F.explode(words(text)).alias("__word")).where("__word <> ''")
    seen = dealt.groupBy("__word").agg(F.count("*").alias("__n"))
    own = aliases.select("*", F.explode(words(alias)).alias("__word")).where("__word <> ''")
    rarest = own.join(seen, "__word").groupBy(*aliases.columns).agg(F.min_by("__word", F.struct("__n", "__word")).alias("__word"))
    return dealt.join(rarest, "__word").drop("__word").join(texts, key).where(hit)
