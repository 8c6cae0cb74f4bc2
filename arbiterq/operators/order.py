"""Places, running totals, maxima and minima in an order, without a window that holds a whole key: in ranges of the order, then over the ranges' totals.

Ranges follow from the value alone: they are cut at quantiles of a pass over the values, or by the leading digits of an evenly spread key. So
the two readings of a table agree whatever the partitioning, and a lost executor's part can be made again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges at most; a range of a key is one task's, so a key's rows spread over so many tasks.
RANGES = 1024


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def by_range(df: DataFrame, order: str, ranges: int = RANGES) -> DataFrame:
    """``df`` with __range, a number that doesn't fall as the number ``order`` rises; nulls come first, NaN last."""
    cuts = df.select(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("q")).first()["q"] or []
    inner = sorted({float(x) for x in cuts if x == x and abs(x) != float("inf")}) or [0.0]
    own = df.withColumn("__order", F.col(order).cast("double"))
    cut = Bucketizer(splits=[-float("inf"), *inner, float("inf")], inputCol="__order", outputCol="__range", handleInvalid="keep").transform(own)
    return cut.withColumn("__range", F.when(F.col(order).isNull(), -1).otherwise(F.col("__range").cast("int"))).drop("__order")


#: Operations that can be scanned: the aggregate of a part, and how two parts are put together (nulls are nothing).
OPERATIONS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def scanned(ranged: DataFrame, keys: Sequence[str], order: list[Column | str], value: Column, name: str, how: str = "sum", total: str | None = None, inclusive: bool = True) -> DataFrame:
    """``ranged`` with ``name``: the sum, maximum or minimum of ``value`` over a key's rows so far by (__range, order), the row's own included
    or not, and the key's total if it is named. Windows hold a range of a key, or one row a range."""
    part, put = OPERATIONS[how]
    sums = ranged.groupBy(*keys, "__range").agg(part(value).alias("__sum"))
    own = Window.partitionBy(*keys)
    before = part("__sum").over(own.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(*keys, "__range", before.alias("__before"), part("__sum").over(own).alias("__total"))  # RANGES rows a key
    within = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = ranged.withColumn("__run", part(value).over(within))
    both = local.alias("l").join(starts.alias("r"), _same("l", "r", [*keys, "__range"]))
    out = [F.col(f"l.`{c}`") for c in local.columns if c != "__run"] + [put(F.col("__run"), F.col("__before")).alias(name)]
    return both.select(*out, *([F.col("__total").alias(total)] if total else []))


def summed(ranged: DataFrame, keys: Sequence[str], order: list[Column | str], value: Column, name: str, total: str | None = None) -> DataFrame:
    """``ranged`` with the running sum of ``value`` by (__range, order) within keys, and the keys' total if it is named."""
    return scanned(ranged, keys, order, value, name, "sum", total).drop("__range")


def best_so_far(df: DataFrame, keys: Sequence[str], order: str, score: str, patience: int | None = None, ranges: int = RANGES) -> DataFrame:
    """``df`` with, by the number ``order`` (distinct within keys): place, best (the greatest score so far), improved (the score is above all
    before it: of equal ones the first counts), since (rows since the last improvement), and stopped: whether ``since`` reached
    ``patience`` in an earlier row, where a search would have ended. A null or NaN score is no improvement."""
    value = F.when(~F.isnan(F.col(score).cast("double")), F.col(score))
    ranged = scanned(by_range(df, order, ranges), keys, [order], F.lit(1).cast("long"), "place")
    ranged = scanned(ranged, keys, [order], value, "__former", "max", inclusive=False)
    ranged = ranged.withColumns({"best": F.greatest("__former", value), "improved": F.coalesce(value > F.col("__former"), value.isNotNull() & F.col("__former").isNull())})
    ranged = scanned(ranged, keys, [order], F.when(F.col("improved"), F.col("place")), "__last", "max")
    ranged = ranged.withColumn("since", F.col("place") - F.coalesce("__last", F.lit(0)))
    late = F.lit(0) if patience is None else (F.col("since") >= patience).cast("int")
    out = scanned(ranged, keys, [order], late, "__late", "max", inclusive=False)
    return out.withColumn("stopped", F.coalesce(F.col("__late"), F.lit(0)) > 0).drop("__range", "__former", "__last", "__late")


def running_total(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str, total: str | None = None, ranges: int = RANGES) -> DataFrame:
    """``df`` with the running sum of ``value`` by the number ``order`` (distinct within keys)."""
    return summed(by_range(df, order, ranges), keys, [order], F.col(value), name, total)


def placed_by_draw(df: DataFrame, keys: Sequence[str], draw: Column, then: str, name: str, total: str | None = None) -> DataFrame:
    """``df`` with each row's place (from 1) by ``draw``, a hexadecimal digest, then by ``then``, within keys."""
    ranged = df.withColumn("__draw", draw).withColumn("__range", F.conv(F.substring("__draw", 1, 3), 16, 10).cast("int"))
    return summed(ranged, keys, ["__draw", then], F.lit(1), name, total).drop("__draw")


def placed(df: DataFrame, keys: Sequence[str], order: str, name: str, total: str | None = None, ranges: int = 256) -> DataFrame:
    """``df`` with each row's place (from 1) by ``order``, of any type and distinct within keys. The cuts are values of ``order`` with the least digests."""
    drawn = df.select(F.col(order).alias("__x")).where("__x is not null").orderBy(F.md5(F.col("__x").cast("string")), "__x").limit(ranges)
    cuts = drawn.agg(F.array_sort(F.collect_set("__x")).alias("__cuts"))  # one row of ``ranges`` values
    ranged = df.crossJoin(F.broadcast(cuts)).withColumn("__range", F.coalesce(F.size(F.filter("__cuts", lambda c: c <= F.col(order))), F.lit(0))).drop("__cuts")
    return summed(ranged, keys, [order], F.lit(1), name, total)
