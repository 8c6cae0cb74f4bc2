"""Mixing sources to target weights by weighted fair queueing.

Each source is a flow of documents in a shuffled order (md5 of seed, pass and id), up to ``most_passes`` passes long. A
document's virtual finish time is the flow's words up to and with it, divided by the source's weight. All arrivals are
range-sorted by that time and cut at the total budget: sources that run dry leave their share to the others by weight, which
is the same as sharing the excess of capped targets again until no target is above its cap.

Prefix sums are two-level: per range of the order, then over the ranges' totals. No source is gathered in one task.

Defined results: null text has size 0; a null source is a source of its own, last; documents of size 0 are taken 0 words;
repeated rows count as documents of their own; rows without an id are documents too, in an order by size and number; very long texts are
counted whole, and one longer than what is left of the budget is not taken; an empty table gives no row; the table's own columns
whose names clash with the four that are read, in another case included, are left out by the caller, as ``op5_fair_mix`` does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, n_words, written

WEIGHTS = (5, 2, 1)
SEED = "mix"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_passes: int = 3) -> DataFrame:
    """(source, source_size, weight, target): water-filling in closed form over the table of sources, a row a source.

    Sources come by code point, null last, and take the weights in turn. With sources by ascending cap / weight, the first
    that stays under its cap gives the water level: what the capped ones leave, divided by the weights of the rest.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), F.col("source"))
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    t = sizes.withColumn("weight", w).withColumn("cap", F.lit(most_passes) * F.col("source_size")).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    t = t.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("heavy", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    t = t.withColumn("place", F.row_number().over(by_ratio)).withColumn("level", F.col("left").cast("double") / F.col("heavy"))
    level = F.coalesce(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(everything)["level"], F.lit(0.0))
    return t.withColumn("level", level).select("source", "source_size", "weight", F.col("level"), F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def running(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, parts: int) -> DataFrame:
    """``df`` with the running sum of ``value`` by ``order`` (a total order that starts with ``keys``) within ``keys``; exact, in ranges."""
    ranged = written(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("__part", *keys).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("__part").alias("__at"), *(F.col(k).alias(f"__k_{k}") for k in keys), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("__part") == F.col("__at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    local = ranged.withColumn("__run", F.sum(value).over(within))
    return local.join(starts, same).withColumn(name, F.col("__run") + F.col("__start")).drop("__part", "__at", "__run", "__start", *(f"__k_{k}" for k in keys))


def mixed(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_passes: int = 3, seed: str = SEED) -> DataFrame:
    """``sized``: (row, doc_id, source, size), row unique. Returns it with source_size, target and passes (times taken)."""
    spark = sized.sparkSession
    plan = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_passes), "targets")
    # A pass that begins so far beyond the water level can't be reached, so that arrivals follow the mix, not three times the
    # corpus: at the cut each flow lacks less than its largest document of its fluid share, and some flow of weight >= 1 is active.
    slack = int(sized.groupBy("source").agg(F.max("size").alias("most")).agg(F.sum("most")).first()[0] or 0)
    plan2 = plan.select(F.col("source").alias("__s"), "source_size", "weight", "level", "target")
    flows = sized.join(plan2, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    budget = int(plan.agg(F.sum("source_size")).first()[0] or 0)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    arrive = flows.where("size > 0").withColumn("pass", F.explode(F.expr(f"sequence(0, least({most_passes - 1}, cast(least(9, floor((level + {slack}) * weight / source_size)) as int)))")))
    arrive = arrive.withColumn("turn", F.md5(F.concat_ws(":", F.lit(seed), F.col("pass").cast("string"), F.col("doc_id").cast("string"))))
    arrive = arrive.select("row", "source", "pass", "turn", "size", "weight", "source_size")
    queued = running(arrive, ["source", "pass"], ["source", "pass", "turn", "size", "row"], "size", "served", parts)
    queued = queued.withColumn("finish", (F.col("pass") * F.col("source_size") + F.col("served")).cast("double") / F.col("weight"))
    queued = running(queued.select("row", "source", "pass", "turn", "size", "finish"), [], ["finish", "source", "pass", "turn", "size", "row"], "size", "total", parts)
    taken = queued.where(F.col("total") <= budget).groupBy("row").agg(F.count("*").alias("passes"))
    return flows.join(taken, "row", "left").withColumn("passes", F.coalesce("passes", F.lit(0))).drop("weight", "level")


def op5_fair_mix(spark, sf_dir: str) -> DataFrame:
    """The text is read once, for its size. Rows that agree in all that the order sees differ by a number, but give equal results."""
    docs = documents(spark, sf_dir)
    out = mixed(written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("row")), "sizes"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"))


OP5_SQL = """
WITH sized AS (SELECT doc_id, source, coalesce(len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')), 0)::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 3 * source_size AS cap FROM src),
r AS (SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST) AS place FROM w),
lv AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM r),
lim AS (SELECT level FROM lv WHERE level <= cap::DOUBLE / weight ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, weight, least(cap::DOUBLE, weight * lim.level) AS target FROM lv, lim),
arr AS (SELECT s.doc_id, s.source, s.size, t.weight, t.source_size, p.pass, md5('mix:' || p.pass || ':' || s.doc_id) AS turn
  FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source, (SELECT unnest([0, 1, 2]) AS pass) p WHERE s.size > 0),
fin AS (SELECT *, (pass * source_size + sum(size) OVER (PARTITION BY source, pass ORDER BY turn, size ROWS UNBOUNDED PRECEDING))::DOUBLE / weight AS finish FROM arr),
cum AS (SELECT *, sum(size) OVER (ORDER BY finish, source, pass, turn, size ROWS UNBOUNDED PRECEDING) AS total FROM fin),
got AS (SELECT doc_id, count(*) AS passes FROM cum WHERE total <= (SELECT sum(source_size) FROM src) GROUP BY 1)
SELECT s.doc_id, s.size, t.source_size, t.target, (s.size * coalesce(g.passes, 0))::BIGINT AS taken
FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN got g USING (doc_id)
"""
