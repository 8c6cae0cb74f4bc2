"""Approximate nearest neighbours by shifted space-filling curves.

Each curve projects the unit vectors on a few random orthogonal directions, turns each coordinate into its rank class over a
bounded sample (so cells are evenly filled), shifts the grid by a fraction of a cell of its own, and orders the rows by Hilbert
index. Rows are range-partitioned by that index into blocks; a query looks at a window of blocks around its own place. The
windows of all curves are merged and re-ranked by the exact cosine of the original vectors, in double precision.

The window is a share of the rows on each side. Independent directions (as in the test tables, where the nearest of
all rows has cosine 0.5 in 64 dimensions) give a curve little to go by, so the production share is wide; for clustered vectors a
much smaller share does. ``recall`` measures it against all rows.

A task holds a block and at most about ``asking`` queries: work grows with queries times window, memory doesn't.

Defined results: an empty table gives no row; only the two named columns are read; vectors that are null, all zero, or hold a null, NaN or infinity take no part, nor do vectors of another
length than the most common one; rows without an id are no candidates; repeated ids are candidates each, but a query's own id never is.
Ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CURVES, DIRECTIONS, ORDER, BLOCK, SHARE, SAMPLE = 6, 4, 8, 1024, 0.12, 20_000
#: Queries that meet a block in one task, about; where more look at it, it is dealt once for each so many.
ASKING = 4096
#: More than the last bits of a score that depend on a vector's place in a product.
MARGIN = 1e-12


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (n x d, ``bits`` bits each), by Skilling's transposition (AIP Conf. Proc. 707, 2004)."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros(len(t), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


class Curves:
    """Random directions, the sample's quantiles and the shifts, all fixed by the seed and the sample."""

    def __init__(self, sample: np.ndarray, curves: int, directions: int, order: int, seed: int = 11) -> None:
        rng, dim = np.random.default_rng(seed), sample.shape[1]
        self.order, self.axes, self.edges = order, [], []
        pool: list[np.ndarray] = []
        for c in range(curves):
            own = min(directions, dim)
            while len(pool) < own:  # directions of one basis don't repeat before all are used
                pool += list(np.linalg.qr(rng.normal(size=(dim, dim)))[0].T)
            axes = np.array([pool.pop() for _ in range(own)])
            shift = (c + 0.5) / curves
            levels = (np.arange(1, 1 << order) + shift - 0.5) / (1 << order)
            self.axes.append(axes)
            self.edges.append(np.quantile(sample @ axes.T, levels, axis=0).T)

    def keys(self, c: int, unit: np.ndarray) -> np.ndarray:
        at = unit @ self.axes[c].T
        cells = np.stack([np.searchsorted(e, at[:, i]) for i, e in enumerate(self.edges[c])], axis=1)
        return hilbert_index(cells, self.order)


def usable(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """(id, v): the vectors that take part, as doubles."""
    v = F.transform(F.col(f"`{vec}`"), lambda x: x.cast("double"))
    own = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    own = own.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    most = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return own.where(F.size("v") == (most["d"] if most else 0))


def unit(vectors) -> np.ndarray:
    x = np.stack(vectors).astype(np.float64) if len(vectors) else np.zeros((0, 1))
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best and of all within MARGIN of the last of them; at -inf is no candidate."""
    at = np.flatnonzero(scores >= np.partition(scores, -k)[-k] - MARGIN) if len(scores) > k else np.arange(len(scores))
    return at[np.isfinite(scores[at])]


def search(df: DataFrame, queries, k: int = 5, id_col: str = "vec_id", vec: str = "embedding", *, curves: int = CURVES, directions: int = DIRECTIONS, order: int = ORDER, block: int = BLOCK, share: float = SHARE, sample: int = SAMPLE, asking: int = ASKING) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows for which ``queries`` (a condition on ``id``) holds."""
    rows = written(usable(df, id_col, vec), "vectors")
    if not rows.limit(1).count():
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # equal vectors are one point, which stands for the k + 1 smallest of their ids, each as often as it can be an answer
    each = rows.groupBy("v", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    least = each.withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("at") <= k + 1)
    points = least.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", "times"))).alias("ids"))
    points = written(points.select(F.monotonically_increasing_id().alias("g"), F.col("ids")[0]["id"].alias("id"), "ids", "v"), "points")
    n = points.count()
    wanted = written(rows.where(queries).select(F.col("id").alias("query_id"), "v").distinct().join(points.select("g", "v"), "v").select("query_id", F.col("g").alias("q")), "wanted")
    # a query takes nothing from points that hold its id alone: its own, and others where its id repeats
    keep = k + (wanted.groupBy("query_id").count().agg(F.max("count")).first()[0] or 1)
    drawn = points.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()["v"]  # bounded: serves the cells alone
    plan = Curves(unit(drawn.to_list()), curves, directions, order)
    blocks = max(1, math.ceil(n / block))
    reach = math.ceil(share * n)

    def key(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            u = unit(p["v"].to_list())
            for c in range(curves):
                yield pd.DataFrame({"curve": np.int32(c), "key": plan.keys(c, u), "id": p["id"], "g": p["g"], "v": p["v"]})

    keyed = points.select("g", "id", "v").mapInPandas(key, "curve int, key long, id long, g long, v array<double>")
    parts = max(1, min(curves * blocks, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ranged = written(keyed.repartitionByRange(parts, "curve", "key", "id", "g").withColumn("part", F.spark_partition_id()), "curves")
    # the place on the curve: the place in the range plus the rows of the curve in the ranges before
    totals = ranged.groupBy("curve", "part").count()
    before = totals.select(F.col("curve").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("count").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("curve", "part").orderBy("key", "id", "g"))
    placed = ranged.withColumn("local", local).join(before, (F.col("curve") == F.col("c")) & (F.col("part") == F.col("p"))).select("curve", "g", "v", (F.col("before") + F.col("local") - 1).alias("place"))
    placed = written(placed.withColumn("block", F.floor(F.col("place") / block).cast("long")), "places")
    asked = placed.join(wanted.select(F.col("q").alias("g")).distinct(), "g", "left_semi")
    low, high = F.greatest(F.lit(0), F.floor((F.col("place") - reach) / block)), F.least(F.lit(blocks - 1), F.floor((F.col("place") + reach) / block))
    asked = asked.withColumn("block", F.explode(F.sequence(low.cast("long"), high.cast("long")))).withColumn("asks", F.lit(True))
    turns = max(1, math.ceil(wanted.count() * min(1.0, (2 * reach + block) / n) / asking))
    dealt = placed.withColumn("asks", F.lit(False)).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    columns = ("curve", "block", "turn", "g", "v", "asks")
    both = dealt.select(*columns).unionByName(asked.withColumn("turn", F.pmod(F.xxhash64("g"), F.lit(turns)).cast("int")).select(*columns))

    def rank(part: pd.DataFrame) -> pd.DataFrame:
        asks = part["asks"].to_numpy(bool)
        ids, out = part["g"].to_numpy(np.int64), []
        if asks.any() and not asks.all():
            rows_u, rows_id = unit(part["v"][~asks].to_list()), ids[~asks]
            q_u, q_id = unit(part["v"][asks].to_list()), ids[asks]
            for at in range(0, len(q_id), 512):
                s = q_u[at : at + 512] @ rows_u.T
                s[q_id[at : at + 512, None] == rows_id[None]] = -np.inf
                for q, own in zip(q_id[at : at + 512].tolist(), s, strict=True):
                    best = nearest(own, keep)
                    out.append((np.full(len(best), q), rows_id[best], own[best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pd.DataFrame({"q": cols[0], "g": cols[1], "score": cols[2]})

    found = both.groupBy("curve", "block", "turn").applyInPandas(rank, "q long, g long, score double")
    # one row a pair however many windows found it; the score is the same but for the last bits, so it is made again below
    best = found.groupBy("q", "g").agg(F.max("score").alias("near")).withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "g")))
    last = best.where(F.col("place") == keep).select("q", F.col("near").alias("last"))
    best = best.join(last, "q", "left").where((F.col("place") <= keep) | (F.col("near") >= F.col("last") - MARGIN)).select("q", "g")
    best = best.unionByName(wanted.select("q", F.col("q").alias("g")).distinct())  # copies of the query
    q, r = points.select(F.col("g").alias("q"), F.col("v").alias("qv")), points.select("g", "ids", F.col("v").alias("rv"))
    exact = best.join(q, "q").join(r, "g").select("q", "g", "ids", cosine("qv", "rv").alias("score"))
    exact = wanted.join(exact, "q").groupBy("query_id", "g").agg(F.max("score").alias("score"), F.first("ids").alias("ids")).select("query_id", "score", F.explode("ids").alias("i"))
    exact = exact.where("i.id <> query_id").select("query_id", "score", F.col("i.id").alias("vec_id"), F.explode(F.sequence(F.lit(1), F.col("i.times"))))
    order_ = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return exact.withColumn("rank", F.row_number().over(order_)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def cosine(a: str, b: str):
    """In one order of summation, so that the same pair has the same score whatever window found it."""

    def total(x):
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    ab = total(F.zip_with(a, b, lambda x, y: x * y))
    return ab / (F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x))))


def op8_hilbert_ann(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "id % 50 = 0")
