"""Vectors made once a text; versions under several writers; counts that are taken back."""

import glob
import sys
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from arbiterq.operators import embed
from arbiterq.sources import versions
from arbiterq.streaming import resume

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests


class Counting(embed.Slots):
    """Leaves a file a text that it encodes."""

    def __init__(self, folder):
        self.folder = folder

    def embed(self, texts):
        for t in texts:
            with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(t)
        return super().embed(texts)


def test_each_text_is_encoded_once(spark, tmp_path):
    (tmp_path / "log").mkdir()
    folder, store = str(tmp_path / "log"), embed.Store(f"file://{tmp_path}/store")
    make = lambda: Counting(folder)
    rows = [(1, "big red dog", ["dog red big", "cat"]), (2, "big red dog", ["nothing like it at all"]), (3, "cat", ["cat"]), (4, "", ["x"]), (5, None, ["x"]), (6, "alone", []), (7, "alone", None), (8, "who", ["", "big red dog"])]
    df = spark.createDataFrame(rows, "i int, a string, g array<string>").repartition(3)
    got = {r["i"]: r["match"] for r in embed.semantic_match(df, "i", "a", "g", make, store).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: False, 6: False, 7: False, 8: False}
    said = [open(p).read() for p in glob.glob(f"{folder}/*")]
    assert len(said) == len(set(said)) and "alone" not in said  # no alias, nothing to compare with
    again = embed.semantic_match(df, "i", "a", "g", make, store)
    assert {r["i"]: r["match"] for r in again.collect()} == got and len(glob.glob(f"{folder}/*")) == len(said)
    assert np.allclose(store.vectors(spark).where(F.col("text_hash") == F.md5(F.lit("who"))).first()["v"], embed.Slots().embed(["who"])[0])


def test_writers_lose_nothing(spark, tmp_path):
    table, gate = versions.Versioned(f"{tmp_path}/t"), threading.Barrier(3, timeout=60)
    assert table.read(spark) is None and table.numbers(spark) == []
    tries = []

    def add(i):
        first = [True]

        def change(now):
            tries.append(i)
            if first[0]:
                first[0] = False
                gate.wait()  # all have read the same version
            own = spark.createDataFrame([(i,)], "i int")
            return own if now is None else now.unionByName(own)

        return table.update(spark, change)

    with ThreadPoolExecutor(3) as pool:
        numbers = list(pool.map(add, range(3)))
    assert sorted(numbers) == [1, 2, 3] and sorted(r["i"] for r in table.read(spark).collect()) == [0, 1, 2]
    assert len(tries) >= 5 and table.read(spark, 1).count() == 1
    assert len(glob.glob(f"{tmp_path}/t/data-*")) == 3 and not glob.glob(f"{tmp_path}/t/_versions/_*")
    assert table.drop_before(spark, 3) == 1 and table.numbers(spark) == [1, 3] and table.read(spark).count() == 3
    with pytest.raises(versions.Conflict):
        versions.Versioned(f"{tmp_path}/t").update(spark, lambda now: now, tries=0)


def test_counts_are_taken_back(spark, tmp_path):
    before = spark.conf.get(resume.STORE[0], None)
    spark.conf.set(*resume.STORE)
    rows = [("a", 1, "C10"), ("a", 3, "C11"), ("a", 2, "C00"), ("b", 2, "C01"), ("b", 1, "C11"), ("c", 1, "C00"), ("c", 1, "C00"), ("d", None, "C00")]
    for part in (rows[:4], rows[4:]):
        spark.createDataFrame(part, "k string, at int, c string").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = resume.corrected(resume.records(spark, f"{tmp_path}/in", "k string, at int, c string", files=1), "k", "at", F.col("c"))
        resume.saved(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    spark.conf.set(resume.STORE[0], before) if before else spark.conf.unset(resume.STORE[0])
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("cell").agg(F.sum("delta").alias("n")).where("n <> 0").collect()
    assert {r["cell"]: r["n"] for r in got} == {"C11": 1, "C01": 1, "C00": 1}
