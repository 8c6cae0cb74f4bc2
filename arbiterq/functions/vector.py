"""Vectors as ARRAY columns: similarity, pooling over K vectors, softmax mass. Sums are made in double precision."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import alias_match, col


def doubles(v: Column | str) -> Column:
    return F.transform(col(v), lambda x: x.cast("double"))


def rounded(x: Column | str, places: int = 6) -> Column:
    """Half away from zero, in double precision. A negative number that is rounded to zero keeps its sign (-0.0), as SQL engines with IEEE
    doubles have it; ``F.round`` goes through decimals, which have no such zero."""
    x, unit = col(x).cast("double"), F.lit(10.0**places)
    return F.signum(x) * (F.round(F.abs(x) * unit) / unit)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def cosine(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def semantic_match(answer: Column | str, aliases: Column | str, answer_vec: Column | str, alias_vecs: Column | str, level: float = 0.65) -> Column:
    """The lexical match, or else some alias vector at ``level`` or more of the answer's."""
    return alias_match(answer, aliases) | F.coalesce(F.exists(col(alias_vecs), lambda v: cosine(answer_vec, v) >= level), F.lit(False))


def sigmoid(x: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def softmax_mass(logits: Column | str, ids: Column | str) -> Column:
    """The probability of a set of ids (from 0) under the softmax of the logits."""
    z = doubles(logits)
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    return total(F.transform(col(ids), lambda i: F.get(e, i.cast("int")))) / total(e)


def concat_features(*vectors: Column | str) -> Column:
    return F.concat(*(doubles(v) for v in vectors))


def span_mean(states: Column | str, start: Column | str, end: Column | str) -> Column:
    """Mean of the token vectors [start, end) of an ARRAY<ARRAY<FLOAT>>."""
    span = F.slice(col(states), col(start) + 1, F.greatest(col(end) - col(start), F.lit(0)))
    width = F.size(F.get(span, F.lit(0)))
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: total(F.transform(span, lambda v: F.get(v, i).cast("double"))) / F.size(span))


def full(vec: Column | str) -> Column:
    """Whether a vector is there and has no null component."""
    return F.coalesce((F.size(col(vec)) > 0) & ~F.exists(col(vec), lambda x: x.isNull()), F.lit(False))


def pooled(df: DataFrame, key: str, vec: str, how: str) -> DataFrame:
    """(key, vec): element-wise ``how`` ('avg' or 'max') over each key's vectors, of one length. Each task sums up a key's vectors in one
    partial vector, and only those are shuffled. Vectors that are null or have a null component take no part; a key without others has null."""
    one = {"avg": Summarizer.mean, "max": Summarizer.max}[how]
    own = df.select(key, F.when(full(vec), array_to_vector(doubles(vec))).alias("v"))
    by = own.where("v is not null").groupBy(key).agg(vector_to_array(one(F.col("v"))).alias(vec))
    lacking = own.groupBy(key).agg(F.count("v").alias("n")).where("n = 0").select(key, F.lit(None).cast("array<double>").alias(vec))
    return by.unionByName(lacking)


def moments(df: DataFrame, vec: str) -> DataFrame:
    """One row (n, mean, dev): element-wise mean and population deviation of the vectors of ``df``; no row without any."""
    own = df.where(full(vec)).select(F.lit(1).alias("one"), array_to_vector(doubles(vec)).alias("v"))
    s = own.groupBy("one").agg(Summarizer.metrics("count", "mean", "variance").summary(F.col("v")).alias("s"))
    n = F.col("s.count")
    spread = F.transform(vector_to_array("s.variance"), lambda v: F.sqrt(v * (n - 1) / n))
    return s.select(n.alias("n"), vector_to_array("s.mean").alias("mean"), spread.alias("dev"))


def concatenated(df: DataFrame, key: str, k: str, vec: str) -> DataFrame:
    """(key, vec): each key's few vectors one after the other, by k."""
    return df.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(k, doubles(vec).alias("v")))), lambda s: s["v"])).alias(vec))


#: Numbers of query vectors that may be sent to every task (64 MB).
MOST_SENT = 8_000_000


def _best(q_id: np.ndarray, q: np.ndarray, part: pd.DataFrame, k: int, places: int) -> pd.DataFrame:
    """The k best rows of ``part`` for each query, by rounded cosine and then by id."""
    x = np.stack(part["v"]).astype(np.float64)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    score = np.round(q @ x.T, places)
    ids, out = part["id"].to_numpy(np.int64), []
    order = np.argsort(ids, kind="stable")
    for n, own in zip(q_id.tolist(), score, strict=True):
        own = np.where(ids == n, -np.inf, own)[order]
        best = np.argsort(-own, kind="stable")[:k]
        best = best[np.isfinite(own[best])]
        out.append(pd.DataFrame({"query_id": n, "id": ids[order][best], "score": own[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})


def nearest(rows: DataFrame, queries: DataFrame, k: int, places: int = 6) -> DataFrame:
    """(query_id, id, score): the k rows with the largest cosine to each query, ties to the smaller id, itself left out. rows: (id, v),
    queries: (query_id, qv).

    Every task keeps k rows a query of a batch, so that only those meet. Queries are sent to the rows if they are counted few; else rows and
    queries meet in blocks of both, a task each.
    """
    schema = "query_id long, id long, score double"
    width = (queries.select(F.size("qv").alias("n")).first() or [1])[0]
    n = queries.count()
    if n * width <= MOST_SENT:
        own = queries.select("query_id", doubles("qv").alias("qv")).collect()  # MOST_SENT numbers at most
        q_id, q = np.array([r[0] for r in own], np.int64), np.array([r[1] for r in own], np.float64).reshape(len(own), -1)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        sent = rows.sparkSession.sparkContext.broadcast((q_id, q))

        def meet(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                if len(part):
                    yield _best(*sent.value, part, k, places)

        found = rows.select("id", "v").mapInPandas(meet, schema)
    else:
        q_blocks = math.ceil(n * width / MOST_SENT)
        r_blocks = max(1, math.ceil(rows.count() * width / MOST_SENT))
        deal = lambda df, name, own, other, m, o: df.withColumn(own, F.pmod(F.xxhash64(name), F.lit(m))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(o - 1).cast("long"))))
        left = deal(queries.select("query_id", doubles("qv").alias("qv")), "query_id", "qb", "rb", q_blocks, r_blocks)
        right = deal(rows.select("id", "v"), "id", "rb", "qb", r_blocks, q_blocks)

        def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query_id": [], "id": [], "score": []})
            q = np.stack(a["qv"])
            return _best(a["query_id"].to_numpy(np.int64), q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300), b, k, places)

        found = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(pair, schema)
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("at", at).where(F.col("at") <= k).drop("at")
