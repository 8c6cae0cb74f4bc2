"""Heads over all rows: the same as the one-task fits, whatever the number of tasks."""

import numpy as np
import pytest

from arbiterq.operators import parallel, probe


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 6))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=900) > 0).astype(float)
    rows = [(int(i), [float(a) for a in v], int(t), "val" if i % 4 == 0 else "train") for i, (v, t) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame([*rows, (-1, None, 1, "train"), (-2, [None] * 6, 0, "train"), (-3, [0.0] * 6, None, "train")], "i long, v array<double>, y int, split string")


def test_newton_equals_one_task(spark, data):
    x, y, df = data
    at = np.arange(900) % 4 > 0
    want = probe.Logistic(x[at], y[at], 0.1)
    for parts in (1, 5):
        own = parallel.fit_logistic(df.where("split = 'train'").repartition(parts), "v", "y", 0.1)
        assert np.allclose(own.w, want.w, atol=1e-6) and np.allclose(own.predict(x), want.predict(x), atol=1e-6)
        assert all(a >= b - 1e-9 for a, b in zip(own.trace, own.trace[1:], strict=False)) and len(own.trace) < 12
    scaled = parallel.fit_logistic(df.where("split = 'train'"), "v", "y", 0.1, scaled=True)
    z = (x[at] - x[at].mean(0)) / x[at].std(0)
    assert np.allclose(scaled.w, probe.Logistic(z, y[at], 0.1).w, atol=1e-6)
    assert parallel.fit_logistic(df.limit(0), "v", "y") is None


def test_an_mlp_of_one_task_is_the_local_one(spark, data):
    x, y, df = data
    train, val = df.where("split = 'train'"), df.where("split = 'val'")
    how = {"hidden": (16,), "epochs": 6, "patience": 6, "seed": 3}
    own = parallel.fit_mlp(train, val, "v", "y", tasks=1, **how)
    # in the order that rows are dealt in
    dealt = parallel.rows_of(train, "v", "y").selectExpr("v", "y", "xxhash64(v) as h").toPandas().sort_values(["h", "y"])
    a, b = np.stack(dealt["v"]), dealt["y"].to_numpy()
    at = np.arange(900) % 4 == 0
    net, best = probe.fit_mlp(own.scale(a), b, own.scale(x[at]), y[at], **how)
    assert np.allclose(own.predict(x), net.forward(own.scale(x))[0], atol=1e-9) and abs(max(own.trace) - best) < 1e-9
    assert parallel.fit_mlp(train.limit(0), val, "v", "y") is None


def test_an_mlp_over_many_tasks_learns(spark, data):
    x, y, df = data
    many = parallel.fit_mlp(df.where("split = 'train'"), df.where("split = 'val'"), "v", "y", hidden=(64,), epochs=8, patience=8, tasks=3)
    assert many.trace[-1] > many.trace[0] and parallel.validated(parallel.rows_of(df.where("split = 'val'"), "v", "y"), many) == max(many.trace)


def test_a_grid_over_all_rows(spark, data):
    x, y, df = data
    own = df.where("i >= 0").withColumnRenamed("v", "a").selectExpr("i", "a", "array(double(y)) as b", "y", "case when i % 10 = 9 then 'test' else split end as split", "1 as one")
    configs = [probe.Config("ab", "y", ("a", "b"), "logreg"), probe.Config("one", "one", ("a",), "logreg")]
    (got, fits), (want, same) = parallel.fit_grid(own, "i", "split", configs), probe.fit_grid(own, "i", "split", configs)
    assert [f[:4] for f in fits] == [f[:4] for f in same] and abs(fits[0][4] - same[0][4]) < 1e-9 and len(fits) == 1
    got, want = ({r["key"]: r["p"] for r in d.collect()} for d in (got, want))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    with pytest.raises(KeyError):
        parallel.fit_grid(own, "i", "split", [probe.Config("x", "y", ("a",), "other")])
