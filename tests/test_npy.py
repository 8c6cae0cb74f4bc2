"""The matrix source: any range in runs, filters as ranges, commits and aborts."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbiterq.sources import npy, records


def test_ranges_filters_and_runs(spark, tmp_path):
    spark.dataSource.register(npy.Npy)
    x = np.random.default_rng(1).normal(size=(50, 3)).astype(np.float32)
    np.save(tmp_path / "a.npy", x[:20])
    np.save(tmp_path / "b.npy", x[20:].astype(np.float64))
    np.save(tmp_path / "_hidden.npy", x)

    def rows(df):
        return {r["ordinal"]: r["h"] for r in df.collect()}

    whole = spark.read.format("npy").option("path", str(tmp_path)).option("cells", 12).load()
    assert whole.rdd.getNumPartitions() == 5 + 8 and np.allclose([rows(whole)[i] for i in range(50)], x)
    part = spark.read.format("npy").option("path", f"file://{tmp_path}").option("start", 15).option("end", 23).load()
    assert sorted(rows(part)) == list(range(15, 23)) and part.rdd.getNumPartitions() == 2
    assert rows(spark.read.format("npy").option("path", str(tmp_path)).option("start", 60).load()) == {}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = spark.read.format("npy").option("path", str(tmp_path)).option("pushdown", "true").load().where("ordinal >= 18 and ordinal < 22 and h[0] is not null")
        assert sorted(rows(pushed)) == [18, 19, 20, 21]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    r = npy.Pushed({"path": str(tmp_path)})
    rest = list(r.pushFilters([npy.GreaterThan(("ordinal",), 4), npy.LessThanOrEqual(("ordinal",), 9), npy.EqualTo(("h",), 1), npy.EqualTo(("ordinal",), 7)]))
    assert (r.start, r.end) == (7, 8) and len(rest) == 1 and [(p.start, p.end) for p in r.partitions()] == [(7, 8)]


def test_writes_are_all_or_nothing(spark, tmp_path):
    spark.dataSource.register(npy.Npy)
    path = f"{tmp_path}/m"
    df = spark.range(40).select(F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("h"))
    df.repartitionByRange(4, F.get("h", F.lit(0))).write.format("npy").mode("append").option("path", path).option("cells", 8).save()
    got = spark.read.format("npy").option("path", path).load()
    assert got.count() == 40 and len(glob.glob(f"{path}/part-*.npy")) >= 4 and not glob.glob(f"{path}/_*")
    bad = df.withColumn("h", F.when(F.get("h", F.lit(0)) == 33, F.array(F.lit(1.0).cast("float"))).otherwise(F.col("h")))
    with pytest.raises(Exception, match="vectors of one length"):
        bad.repartition(4).write.format("npy").mode("append").option("path", path).option("cells", 4).save()
    assert spark.read.format("npy").option("path", path).load().count() == 40
    writer = npy.Writer({"path": path}, False)
    open(f"{path}/_{writer.run}-x.npy", "w").close()
    writer.abort([None])
    assert not glob.glob(f"{path}/_{writer.run}*") and len(glob.glob(f"{path}/part-*.npy")) >= 4
    df.limit(3).write.format("npy").mode("overwrite").option("path", path).save()
    assert spark.read.format("npy").option("path", path).load().count() == 3


def test_head_reads_the_files_that_it_needs(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"f{i}.json").write_text("".join(f'{{"v": {10 * i + k}}}\n' for k in range(10)) if i < 4 else "broken\n")
    df = records.jsonl(spark, str(tmp_path), "v int")
    assert sorted(r["v"] for r in records.head(df, 15).collect()) == list(range(15))  # the files behind would stop the query
    with pytest.raises(Exception, match="(?i)malformed"):
        records.head(df, 50).collect()
    assert os.path.exists(tmp_path / "f5.json") and records.head(df, 0).count() == 0
