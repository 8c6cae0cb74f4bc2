"""In-order commits: prefixes only, over batches and restarts; holes are named."""

import random
import sys
import time

import pytest
from pyspark import cloudpickle

from arbiterq.streaming import resume

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(resume.STORE[0], None)
    spark.conf.set(*resume.STORE)
    yield spark
    spark.conf.set(resume.STORE[0], before) if before else spark.conf.unset(resume.STORE[0])


def test_prefixes_only_over_restarts(rocks, tmp_path):
    rng = random.Random(1)
    rows = [(k, i, f"{k}{i}", None if i % 3 else i * 0.5) for k in "abc" for i in range(30) if (k, i) not in {("b", 11), ("c", 0)}]
    rows += [("a", 4, "again", None), ("b", -1, "before the first", None)]
    rng.shuffle(rows)
    schema = "k string, i long, v string, x double"
    seen = []
    for run in range(4):
        rocks.createDataFrame(rows[run::4], schema).repartition(3).write.mode("append").json(f"{tmp_path}/in")
        stream = resume.ordered(resume.records(rocks, f"{tmp_path}/in", schema, files=2), "k", "i")
        resume.saved(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        got = sorted((r["k"], r["i"]) for r in rocks.read.parquet(f"{tmp_path}/out").collect())
        assert len(set(got)) == len(got)
        for k in "abc":  # without a hole after any run
            own = [i for key, i in got if key == k]
            assert own == list(range(len(own)))
        seen.append(len(got))
    assert seen[0] < seen[-1] == 30 + 11 and not [k for k, _ in got if k == "c"]
    by = {(r["k"], r["i"]): r for r in rocks.read.parquet(f"{tmp_path}/out").collect()}
    assert by["a", 7]["v"] == "a7" and by["a", 7]["x"] is None and by["a", 6]["x"] == 3.0 and by["a", 6]["state"] == "committed"
    rocks.createDataFrame([("b", 11, "b11", None)], schema).write.mode("append").json(f"{tmp_path}/in")
    stream = resume.ordered(resume.records(rocks, f"{tmp_path}/in", schema), "k", "i")
    resume.saved(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert rocks.read.parquet(f"{tmp_path}/out").where("k = 'b'").count() == 30


def test_a_hole_is_named(rocks, tmp_path):
    schema = "k string, i long, v string"
    rocks.createDataFrame([("a", 0, "x"), ("a", 2, "z")], schema).write.json(f"{tmp_path}/in")
    stream = resume.ordered(resume.records(rocks, f"{tmp_path}/in", schema), "k", "i", patience_ms=50)
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="300 milliseconds").start()
    for _ in range(60):
        time.sleep(1)
        if [p for p in query.recentProgress if any(s["customMetrics"].get("numExpiredTimers") for s in p["stateOperators"])]:
            break
    query.stop()
    got = {(r["k"], r["i"], r["state"]) for r in rocks.read.parquet(f"{tmp_path}/out").collect()}
    assert ("a", 0, "committed") in got and ("a", 1, "hole") in got and ("a", 2, "committed") not in got


def test_another_store_is_refused(spark, tmp_path):
    spark.createDataFrame([("a", 0)], "k string, i long").write.json(f"{tmp_path}/in")
    with pytest.raises(RuntimeError, match="RocksDB"):
        resume.ordered(resume.records(spark, f"{tmp_path}/in", "k string, i long"), "k", "i")


class Kept:
    """A state in memory that counts the calls to it."""

    def __init__(self, calls):
        self.calls, self.of = calls, {}

    def get(self):
        self.calls.append("get")
        return self.of.get(())

    def update(self, v):
        self.calls.append("update")
        self.of[()] = v

    def exists(self):
        self.calls.append("exists")
        return bool(self.of)

    def getValue(self, k):
        self.calls.append("getValue")
        return self.of.get(k)

    def updateValue(self, k, v):
        self.calls.append("updateValue")
        self.of[k] = v

    def removeKey(self, k):
        self.calls.append("removeKey")
        self.of.pop(k, None)


def test_state_is_moved_in_blocks():
    """A thousand rows of a key that wait for one take calls by the block, not by the row, and come out in order and once."""
    calls = []
    p = resume.Prefix("k", "string", 0, None)
    p.next, p.early = Kept(calls), Kept(calls)
    of = lambda *rows: [resume.Row(ordinal=i, value=v) for i, v in rows]
    assert not list(p.handleInputRows(("a",), iter(of(*((i, f"v{i}") for i in range(1000, 0, -1)))), None))
    assert len(calls) < 40
    assert not list(p.handleInputRows(("a",), iter(of((7, "again"), (1003, "later"))), None))
    calls.clear()
    got = [(r.k, r.ordinal, r.value, r.state) for r in p.handleInputRows(("a",), iter(of((0, "v0"), (0, "again"), (1002, None))), None)]
    assert got == [("a", i, f"v{i}", "committed") for i in range(1001)] and len(calls) < 60
    assert [r.ordinal for r in p.handleInputRows(("a",), iter(of((1001, "x"), (5, "old"))), None)] == [1001, 1002, 1003] and not p.early.of


def test_a_correction_takes_two_calls():
    calls = []
    p = resume.Corrections("k")
    p.last = Kept(calls)
    of = lambda *rows: [tuple(r) for r in p.handleInputRows((1,), iter([resume.Row(at=a, cell=c) for a, c in rows]), None)]
    assert of((1, "C00"), (2, "C01"), (2, "C00")) == [(1, "C01", 1)] and calls == ["get", "update"]
    assert of((1, "C11")) == of((2, "C01")) == [] and of((3, "C10")) == [(1, "C01", -1), (1, "C10", 1)]
