"""Small helpers that every training-data operator shares."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space; ``bytes.split()`` cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``; a temporary one where it is unset, on one machine only."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines see")
        there = "file://" + tempfile.mkdtemp(prefix="arbiterq-")
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back (survives lost executors)."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    vars(out)["folder_of_own"] = path
    return out


def forget(*tables: DataFrame, shuffles: bool = True) -> None:
    """Delete tables that ``written`` made, once nothing will read them, and the shuffle files that nothing refers to any more."""
    for df in tables:
        dropped(df.sparkSession, vars(df)["folder_of_own"])
    if shuffles:
        gc.collect()
        if spark := SparkSession.getActiveSession():
            spark.sparkContext._jvm.System.gc()  # Spark's cleaner deletes a shuffle when its handle is collected


def dropped(spark: SparkSession, folder: str) -> None:
    """Delete a folder that no table needs any more."""
    there = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def short_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of few rows, so that a batch of very long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def slim() -> None:
    """Called by a Python worker at the end of its task: gives back the memory that it holds for the next one, as idle workers stay alive."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_words(text: Column) -> Column:
    """Words of a text, 0 where it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of all ids that no model may learn from; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
