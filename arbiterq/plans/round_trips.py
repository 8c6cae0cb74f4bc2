"""Queries that go through sinks, sources and streams: a table is written to a scratch folder as the engine writes it, and read back."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import vector as V
from ..operators import metrics as M
from ..sources import npy, records, sinks, versions
from ..streaming import resume
from . import twins as W
from .bindings import qa, routed, table
from .catalogue import query


@query("SELECT o_orderkey AS qid, o_orderpriority AS question, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS note FROM orders")
def jsonl_round_trip(spark, sf):
    """Records in a fixed key order, nulls included, and the scan that stops at a malformed line."""
    folder = sinks.scratch(spark, "rows")
    own = table(spark, sf, "orders").select(F.col("o_orderkey").alias("qid"), F.col("o_orderpriority").alias("question"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("note"))
    sinks.write_rows(own, folder, ["question", "qid", "note"])
    return records.jsonl(spark, folder, "qid BIGINT, question STRING, note STRING")


@query("SELECT user_id::VARCHAR AS question_hash, max(event_id)::VARCHAR AS pk_answer FROM events GROUP BY 1")
def cache_last_wins(spark, sf):
    """A cache that is appended to twice: the later answer of a repeated key counts."""
    folder = sinks.scratch(spark, "cache")
    e = table(spark, sf, "events")
    for which, at in ((F.min, "early"), (F.max, "late")):
        own = e.groupBy("user_id").agg(which("event_id").alias("i")).select(F.col("user_id").cast("string").alias("question_hash"), F.lit(at).alias("question"), F.col("i").cast("string").alias("pk_answer"))
        sinks.append_cache(own, folder)
    return records.answer_cache(spark, folder).select("question_hash", "pk_answer")


@query("SELECT event_type AS method, 'b' AS backbone, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, 2 * count(*) AS n, count(DISTINCT event_id) AS n_qids FROM events GROUP BY 1, 2, 3")
def answers_appended(spark, sf):
    """Answers appended by method, backbone and dataset, twice; the partitions are columns again."""
    folder = sinks.scratch(spark, "answers")
    own = table(spark, sf, "events").select(F.col("event_type").alias("method"), F.lit("b").alias("backbone"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("dataset"), F.col("event_id").alias("qid"))
    for _ in range(2):
        sinks.append_answers(own, folder)
    return spark.read.parquet(folder).groupBy("method", "backbone", "dataset").agg(F.count("*").alias("n"), F.count_distinct("qid").alias("n_qids"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0")
def versions_and_swaps(spark, sf):
    """A table that is replaced from itself: by a pointer to its versions, then by renames, with a backup of the first."""
    folder = sinks.scratch(spark, "versions")
    sinks.published(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), folder)
    sinks.published(sinks.current(spark, folder).where("o_orderkey % 3 < 2"), folder)
    sinks.current(spark, folder).write.parquet(f"{folder}-swapped")
    sinks.swap(spark.read.parquet(f"{folder}-swapped").where("o_orderkey % 3 = 0"), f"{folder}-swapped")
    kept = spark.read.parquet(f"{folder}-swapped")
    sinks.backed_up(kept, f"{folder}-swapped")
    sinks.mark_config(spark, f"{folder}-swapped", {"layer": 1})
    return spark.read.parquet(f"{folder}-swapped.bak") if sinks.same_config(spark, f"{folder}-swapped", {"layer": 1}) else kept.limit(0)


@query(f"WITH {W.ROUTED} SELECT CASE WHEN grouping(dataset) = 1 THEN 'ALL_AGG' ELSE dataset END AS dataset, count(*)::VARCHAR AS n, CASE WHEN count(*) FILTER (oracle_cell = 'C01') > 0 THEN 'there' ELSE 'empty' END AS b1_c01 FROM routed GROUP BY GROUPING SETS ((dataset), ())")
def csv_report(spark, sf):
    """The report with its row over all datasets as CSV: null is empty."""
    folder = sinks.scratch(spark, "report")
    sinks.csv_report(M.report(routed(spark, sf).drop("is_correct", "source"), (), "dataset"), folder)
    got = spark.read.option("header", True).csv(folder)
    return got.select("dataset", "n", F.when(F.col("b1_c01").isNull(), "empty").otherwise("there").alias("b1_c01"))


@query("SELECT DISTINCT user_id FROM events")
def stream_first_seen(spark, sf):
    """A stream of files, each key once, written in batches that overwrite their own folders; a second run adds nothing."""
    folder = sinks.scratch(spark, "stream")
    table(spark, sf, "events").select("user_id", "event_type").repartition(4).write.json(f"{folder}/in")
    for _ in range(2):
        stream = resume.first_seen(resume.records(spark, f"{folder}/in", "user_id BIGINT, event_type STRING", files=2), ["user_id"])
        resume.saved(stream.select("user_id"), f"{folder}/out", f"{folder}/check").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("user_id")


@query(f"WITH {W.QA} SELECT {W.cell('pk_alias', 'ck_alias')} AS cell, count(*) AS n FROM qa WHERE pk_alias IS NOT NULL GROUP BY 1")
def stream_cells(spark, sf):
    """Running counters of the cells over a stream."""
    folder, name = sinks.scratch(spark, "cells"), f"cells_{abs(hash(sf))}"
    qa(spark, sf).where("pk_alias is not null").select("pk_alias", "ck_alias").repartition(3).write.json(f"{folder}/in")
    resume.running_cells(resume.records(spark, f"{folder}/in", "pk_alias BOOLEAN, ck_alias BOOLEAN"), "pk_alias", "ck_alias", name, f"{folder}/check").awaitTermination()
    return spark.table(name).where(F.col("cell").isin(*C.CELLS))


@query("SELECT (CASE l_linenumber % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END) AS dataset, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END)::BIGINT AS n_large, count(*) AS n FROM lineitem GROUP BY 1")
def stream_appended(spark, sf):
    """A stream into a partitioned table, read as a batch."""
    folder = sinks.scratch(spark, "appended")
    dataset = F.when(F.col("l_linenumber") % 3 == 0, "a").when(F.col("l_linenumber") % 3 == 1, "b").otherwise("c")
    table(spark, sf, "lineitem").select(dataset.alias("dataset"), "l_quantity").repartition(3).write.json(f"{folder}/in")
    resume.appended(resume.records(spark, f"{folder}/in", "dataset STRING, l_quantity DOUBLE"), f"{folder}/out", f"{folder}/check", ("dataset",)).awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("dataset").agg(F.count_if(F.col("l_quantity") > 25).alias("n_large"), F.count("*").alias("n"))


@query("""WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events),
hole AS (SELECT user_id, min(i) AS i FROM n WHERE (i * 7 + user_id) % 23 = 22 GROUP BY 1)
SELECT n.user_id, n.i, n.event_id FROM n LEFT JOIN hole USING (user_id) WHERE hole.i IS NULL OR n.i < hole.i""")
def stream_in_order(spark, sf):
    """Events of a user that come in any order, some never: committed are those before the first hole, in batches and over a restart."""
    folder, before = sinks.scratch(spark, "ordered"), spark.conf.get(resume.STORE[0], None)
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    own = table(spark, sf, "events").select("user_id", number.cast("long").alias("i"), "event_id").where("(i * 7 + user_id) % 23 <> 22")
    own = own.repartition(4, F.md5(F.col("event_id").cast("string")))
    spark.conf.set(*resume.STORE)
    try:
        for part in (0, 1):
            own.where(F.crc32(F.col("event_id").cast("string").cast("binary")) % 2 == part).write.mode("append").json(f"{folder}/in")
            stream = resume.ordered(resume.records(spark, f"{folder}/in", "user_id BIGINT, i BIGINT, event_id BIGINT", files=2), "user_id", "i")
            resume.saved(stream, f"{folder}/out", f"{folder}/check").awaitTermination()
    finally:
        spark.conf.set(resume.STORE[0], before) if before else spark.conf.unset(resume.STORE[0])
    return spark.read.parquet(f"{folder}/out").select("user_id", "i", "event_id")


@query(f"WITH {W.QA}, b AS (SELECT CASE WHEN qid % 3 = 0 THEN NOT pk_alias ELSE pk_alias END AS pk, CASE WHEN qid % 5 = 0 THEN false ELSE ck_alias END AS ck FROM qa WHERE pk_alias IS NOT NULL) SELECT {W.cell('pk', 'ck')} AS cell, count(*) AS n FROM b GROUP BY 1")
def stream_corrected(spark, sf):
    """Counts of the cells over a stream of labels and later corrections, which come in any order: a label that a correction turns is taken back."""
    folder, before = sinks.scratch(spark, "corrected"), spark.conf.get(resume.STORE[0], None)
    labels = qa(spark, sf).where("pk_alias is not null").select("qid", "pk_alias", "ck_alias")
    pk = F.when(F.col("qid") % 3 == 0, ~F.col("pk_alias")).otherwise(F.col("pk_alias"))
    ck = F.when(F.col("qid") % 5 == 0, F.lit(False)).otherwise(F.col("ck_alias"))
    first, then = labels.withColumn("at", F.lit(1)), labels.where("qid % 3 = 0 or qid % 5 = 0").withColumns({"pk_alias": pk, "ck_alias": ck, "at": F.lit(2)})
    both = first.unionByName(then).repartition(4, F.crc32(F.concat_ws(":", "qid", "at").cast("binary")))
    spark.conf.set(*resume.STORE)
    try:
        both.write.json(f"{folder}/in")
        stream = resume.records(spark, f"{folder}/in", "qid BIGINT, pk_alias BOOLEAN, ck_alias BOOLEAN, at BIGINT", files=2)
        deltas = resume.corrected(stream, "qid", "at", C.cell("pk_alias", "ck_alias"))
        resume.saved(deltas, f"{folder}/out", f"{folder}/check").awaitTermination()
    finally:
        spark.conf.set(resume.STORE[0], before) if before else spark.conf.unset(resume.STORE[0])
    return spark.read.parquet(f"{folder}/out").groupBy("cell").agg(F.sum("delta").alias("n")).where("n <> 0")


@query("SELECT o_orderpriority AS dataset, sum(CASE WHEN o_orderkey % 2 = 0 THEN 10 ELSE 1 END)::BIGINT AS n FROM orders GROUP BY 1")
def two_writers(spark, sf):
    """Two writers add their half of the orders to one table at once, each to a count that it has read; versions keep both."""
    at = versions.Versioned(sinks.scratch(spark, "counts"))
    orders = table(spark, sf, "orders")

    def add(which: int) -> None:
        own = orders.where(F.col("o_orderkey") % 2 == which).groupBy(F.col("o_orderpriority").alias("dataset")).agg((F.count("*") * (1 if which else 10)).alias("n"))
        at.update(spark, lambda now: (own if now is None else now.unionByName(own)).groupBy("dataset").agg(F.sum("n").alias("n")))

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(add, (0, 1)))
    return at.read(spark)


@query("WITH n AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS ordinal, embedding FROM embeddings) SELECT ordinal, list_transform(embedding, lambda x: round(x::DOUBLE, 6)) AS h FROM n WHERE ordinal >= 37 AND ordinal < 290")
def matrix_range(spark, sf):
    """Vectors written as matrix files by many tasks, committed at once, and a range of their rows read back: only the files and runs that hold it."""
    folder = sinks.scratch(spark, "matrix")
    spark.dataSource.register(npy.Npy)
    own = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("h")).repartitionByRange(3, "vec_id").sortWithinPartitions("vec_id")
    own.select("h").write.format("npy").mode("append").option("path", folder).option("cells", 4096).save()
    got = spark.read.format("npy").option("path", folder).option("start", 37).option("end", 290).option("cells", 2048).load()
    return got.select("ordinal", F.transform("h", lambda x: V.rounded(x)).alias("h"))


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 700")
def head_of_files(spark, sf):
    """The first records of many files, in file order; files behind them are not read."""
    folder = sinks.scratch(spark, "head")
    table(spark, sf, "orders").select("o_orderkey", "o_totalprice").repartitionByRange(9, "o_orderkey").sortWithinPartitions("o_orderkey").write.json(folder)
    return records.head(records.jsonl(spark, folder, "o_orderkey BIGINT, o_totalprice DOUBLE"), 700)
