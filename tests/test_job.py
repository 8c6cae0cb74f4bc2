"""Jobs: kept steps, changed configurations, gates; the whole evaluation with heads; joins with hot keys."""

import pytest
from pyspark.sql import functions as F

from arbiterq.operators import infer, job, joins, states


def counting(n, seen, name):
    def make(*tables):
        seen.append(name)
        out = n
        for t in tables:
            out = out.unionByName(t)
        return out

    return make


def steps(spark, seen, **config):
    one = spark.createDataFrame([(1,)], "x int")
    return [
        job.Step("a", counting(one, seen, "a"), config=config.get("a", {})),
        job.Step("b", counting(one, seen, "b"), ("a",), config.get("b", {})),
        job.Step("c", counting(one, seen, "c"), ("a", "b"), config.get("c", {})),
    ]


def test_steps_are_made_once_and_anew_after_a_change(spark, tmp_path):
    seen, at = [], str(tmp_path)
    first = job.Job(at, steps(spark, seen))
    assert first.done(spark) == {"a": False, "b": False, "c": False}
    assert set(first.run(spark, until="b")) == {"a", "b"} and seen == ["a", "b"]
    assert first.run(spark)["c"].count() == 4 and seen == ["a", "b", "c"]
    changed = job.Job(at, steps(spark, seen, b={"k": 2}))
    assert changed.done(spark) == {"a": True, "b": False, "c": False}
    changed.run(spark)
    assert seen == ["a", "b", "c", "b", "c"]
    job.Job(at, steps(spark, seen)).run(spark)  # the former tables stay
    assert len(seen) == 5


def test_a_failed_step_leaves_the_earlier_ones(spark, tmp_path):
    seen, at = [], str(tmp_path)
    own = steps(spark, seen)

    def broken(*_):
        raise OSError("lost")

    with pytest.raises(OSError):
        job.Job(at, [*own[:2], job.Step("c", broken, ("a", "b"))]).run(spark)
    job.Job(at, own).run(spark)
    assert seen == ["a", "b", "c"]


def test_wrong_steps_are_refused(spark, tmp_path):
    own = steps(spark, [])
    with pytest.raises(ValueError, match="twice"):
        job.Job(str(tmp_path), [own[0], own[0]])
    with pytest.raises(ValueError, match="needs"):
        job.Job(str(tmp_path), own[1:])
    with pytest.raises(KeyError):
        job.Job(str(tmp_path), own).run(spark, until="d")


def rows(spark, n=240):
    """Memory is right where the question names a colour, context where its passage does."""
    out = []
    for i in range(n):
        pk, ck = i % 2 == 0, i % 3 == 0
        out.append((i, f"set{i % 2}", f"question {i}: {'red' if pk else 'void'}", f"passage {i} says {'red' if ck else 'void'}" if i % 7 else "", ["red"]))
    return spark.createDataFrame(out, "qid long, dataset string, question string, ck_text string, ground_truth array<string>")


def test_the_whole_evaluation(spark, tmp_path):
    at = str(tmp_path)
    own = job.evaluation(rows(spark), at, infer.Echo, encoder=states.Hashed, methods=("closed_book", "dia"), config={"rows": 1}, split={"test": 0.25, "val": 0.25})
    tables = own.run(spark)
    assert all(own.done(spark).values())
    split = {r["split"]: r["count"] for r in tables["split"].groupBy("split").count().collect()}
    assert split == {"train": 120, "val": 60, "test": 60}
    report = {(r["method"], r["split"]): r for r in tables["report"].collect()}
    labels = {r["qid"]: r for r in tables["labels"].collect()}
    assert report["closed_book", "ALL_AGG"]["n"] == 240 and report["closed_book", "ALL_AGG"]["a1_acc"] == pytest.approx(sum(r["pk_correct"] for r in labels.values()) / 240)
    assert set(k for k in report if k[0] == "heads") == {("heads", "test"), ("heads", "ALL_AGG")} and report["heads", "test"]["n"] == 60
    routed = {r["qid"]: r for r in tables["routes"].collect()}
    test = {r["qid"] for r in tables["split"].where("split = 'test'").collect()}
    assert set(routed) == test
    for q, r in routed.items():
        of, mine = r["predicted_cell"], labels[q]
        assert r["final_answer"] == (mine["pk_answer"] if of in ("C10", "C11") else mine["ck_answer"] if of == "C01" else "")
    calls = infer.Ledger(f"{at}/calls").entries(spark).count()
    job.evaluation(rows(spark), at, infer.Echo, methods=("closed_book",), config={"rows": 1}).run(spark)
    assert infer.Ledger(f"{at}/calls").entries(spark).count() == calls


def test_the_gate_stops_on_drift(spark, tmp_path):
    good = [(i, "red", "blue", ["red"], True, False) for i in range(96)]
    fields = "qid int, pk_answer string, ck_answer string, ground_truth array<string>, pk_correct boolean, ck_correct boolean"
    bad = lambda n: spark.createDataFrame(good + [(i, "red", "blue", ["red"], True, True) for i in range(n)], fields)
    job.reproduced(bad(4))
    job.reproduced(bad(0).limit(0))
    with pytest.raises(job.Stopped, match="101 rows"):
        job.reproduced(bad(5))
    seen = []
    own = [job.Step("labels", lambda: bad(5), gate=job.reproduced), job.Step("next", counting(spark.range(1), seen, "next"), ("labels",))]
    for _ in range(2):  # the kept table is looked at as well
        with pytest.raises(job.Stopped):
            job.Job(str(tmp_path), own).run(spark)
    assert not seen


def test_hot_keys_are_joined_whole(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT", 4)
    many = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 9 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    of = spark.createDataFrame([("hot", 1), (None, 2), *((f"k{i}", i) for i in range(40))], "k string, v int")
    got = sorted((r["id"], r["k"], r["v"]) for r in joins.hot_joined(many, of, ["k"]).collect())
    value = {r["k"]: r["v"] for r in of.collect()}
    assert got == [(r["id"], r["k"], value[r["k"]]) for r in many.orderBy("id").collect() if r["k"] in value]
    assert joins.hot_joined(many.limit(0), of, ["k"]).count() == 0
