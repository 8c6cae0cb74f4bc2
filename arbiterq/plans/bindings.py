"""The driver's tables in the roles of questions, behaviour and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import text as T
from ..operators import metrics as M


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table of less than one split, dealt to all cores by a key; a larger one is dealt by its own splits and stays as it is.

    A small file is one row group and thus one task, whatever is done to its rows.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(str(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))
    return df.repartition(spark.sparkContext.defaultParallelism, key) if size < split else df


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spread(table(spark, sf_dir, "documents"), "doc_id"), table(spark, sf_dir, "labels")
    own = docs.select(F.col("doc_id").alias("qid"), F.col("source").alias("dataset"), "lang", F.col("text").alias("question"), T.lines("text").alias("ls"))
    first, last = F.get("ls", F.lit(0)), F.try_element_at("ls", F.lit(-1))
    gold = F.when(F.col("qid") % 3 == 0, F.array(first)).when(F.col("qid") % 3 == 1, F.array(last)).otherwise(F.array(F.lit("no such answer")))
    relation = F.when(F.col("lang") == "en", "supportive").when(F.col("lang") == "fr", "conflicting").otherwise(F.col("lang"))
    out = own.select("qid", "dataset", relation.alias("relation"), "question", first.alias("pk_answer"), last.alias("ck_answer"), gold.alias("ground_truth"))
    marks = labels.select(F.col("doc_id").alias("qid"), (F.col("quality") == 1).alias("pk_alias"), (F.col("toxic") == 1).alias("ck_alias"))
    return out.join(marks, "qid", "left")


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = qa(spark, sf_dir).where("pk_alias is not null").withColumn("oracle_cell", C.cell("pk_alias", "ck_alias"))
    own = own.withColumn("answer", C.routed_answer("oracle_cell", "pk_answer", "ck_answer", "I do not know"))
    return M.tallied(own.withColumn("predicted_cell", F.when(F.col("qid") % 2 == 0, F.col("oracle_cell")).otherwise("C00")))


def featured(spark, sf):
    """Vectors with two heads' labels and a split by id."""
    e = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "qid")
    f, i = F.col("embedding"), F.col("qid") % 10
    return e.select("qid", "embedding", (F.get(f, F.lit(0)) + F.get(f, F.lit(1)) > 0).cast("int").alias("pk"), (F.get(f, F.lit(2)) > 0).cast("int").alias("ck"), F.when(i < 7, "train").when(i < 8, "val").otherwise("test").alias("split"))
