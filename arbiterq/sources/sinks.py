"""Sinks. Spark's commit protocol makes each write atomic by file set; ``_SUCCESS`` is the completion marker."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import exists


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see: under ``spark.checkpoint.dir``; where that is unset, a temporary one, on one machine only."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines see")
        there = "file://" + tempfile.mkdtemp(prefix="arbiterq-")
    return f"{there.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_rows(df: DataFrame, path: str, columns: list[str]) -> None:
    """JSON Lines in the given key order, nulls included, over whatever was there."""
    df.select(*columns).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def swap(df: DataFrame, path: str) -> None:
    """Replace a Parquet table that ``df`` may be reading: write beside it, then rename. Where an earlier swap was cut short between its two
    renames, the table is put back first."""
    spark = df.sparkSession
    restored(spark, path)
    fresh = f"{path}.new-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    fs, old = _fs(spark, path)
    keep = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.old-{uuid.uuid4().hex}")
    if fs.exists(old):
        fs.rename(old, keep)
    fs.rename(spark._jvm.org.apache.hadoop.fs.Path(fresh), old)
    fs.delete(keep, True)


def restored(spark: SparkSession, path: str) -> bool:
    """Puts the former table back where a swap was cut short; whether it had to."""
    fs, at = _fs(spark, path)
    former = [] if fs.exists(at) else [x.getPath() for x in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}.old-*")) or []]
    return bool(former) and fs.rename(former[0], at)


def published(df: DataFrame, path: str) -> str:
    """Write a new version of a table and point to it: readers see the old version or the new, whatever fails. Gives the version's folder."""
    spark = df.sparkSession
    folder = f"{path}/version-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    jvm, (fs, at) = spark._jvm, _fs(spark, f"{path}/CURRENT")
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT-{uuid.uuid4().hex}")
    out = fs.create(mark, True)
    out.write(folder.rsplit("/", 1)[1].encode())
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    context.rename(fs.makeQualified(mark), fs.makeQualified(at), how)  # one step
    return folder


def current(spark: SparkSession, path: str) -> DataFrame:
    """The version that ``published`` points to."""
    name = spark.read.text(f"{path}/CURRENT").first()["value"]
    return spark.read.parquet(f"{path}/{name}")


def backed_up(df: DataFrame, path: str, dry_run: bool = False) -> int:
    """Rewrite a table, keeping its first version at path.bak; a dry run only counts."""
    n = df.count()
    if not dry_run:
        fs, old = _fs(df.sparkSession, path)
        keep = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}.bak")
        fresh = f"{path}.new-{uuid.uuid4().hex}"
        df.write.parquet(fresh)
        if fs.exists(keep):
            fs.delete(old, True)
        elif fs.exists(old):
            fs.rename(old, keep)
        fs.rename(df.sparkSession._jvm.org.apache.hadoop.fs.Path(fresh), old)
    return n


def append_answers(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("method", "backbone", "dataset").parquet(path)


def append_cache(df: DataFrame, path: str) -> None:
    """Adds JSON Lines to an answer cache; of repeated keys its reader takes the last."""
    df.write.mode("append").json(path)


def merge_index(old: DataFrame, new: DataFrame, key: str = "dataset") -> DataFrame:
    """New entries, and the old ones that weren't built again."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def complete(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/_SUCCESS")


def compacted(shards: DataFrame, expected: DataFrame, key: str = "qid", rank: str = "shard") -> DataFrame:
    """Shards as one table: the first of repeats, nothing that isn't expected; a missing key stops the query."""
    rest = [c for c in shards.columns if c != key]
    one = shards.groupBy(key).agg(F.min_by(F.struct(*rest), rank).alias("r")).select(key, *(f"r.{c}" for c in rest)).withColumn("__there", F.lit(True))
    out = expected.select(key).distinct().join(one, key, "left")
    ok = F.assert_true(F.col("__there").isNotNull(), F.concat(F.lit("no shard has "), F.col(key).cast("string")))
    return out.where(ok.isNull()).drop("__there")


def csv_report(df: DataFrame, path: str, places: int = 4) -> None:
    """A small report as CSV with a header; ratios are rounded, null is empty."""
    shown = [F.bround(f.name, places).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema.fields]
    df.select(*shown).coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def json_report(df: DataFrame, keys: list[str]) -> dict:
    """A small report as nested dictionaries by keys."""
    out: dict = {}
    for row in df.collect():  # one row a key of the report
        at = out
        for k in keys[:-1]:
            at = at.setdefault(str(row[k]), {})
        at[str(row[keys[-1]])] = json.loads(json.dumps({c: row[c] for c in df.columns if c not in keys}))
    return out


def same_config(spark: SparkSession, path: str, config: dict) -> bool:
    """Whether a finished table was made with this configuration."""
    side = f"{path}.config"
    return complete(spark, path) and exists(spark, side) and json.loads("".join(r["value"] for r in spark.read.text(side).collect())) == config


def mark_config(spark: SparkSession, path: str, config: dict) -> None:
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.config")
