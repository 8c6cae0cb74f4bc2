"""Packing against an exhaustive packer, and its independence of the partitioning."""

import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbiterq.llm import best_fit


def least_cost(sizes, bins):
    """Over all ways to put the pieces into bins of the least permitted length."""
    best, longest = float("inf"), max(bins.lengths)
    for way in product(range(len(sizes)), repeat=len(sizes)):
        used = {}
        for b, n in zip(way, sizes, strict=True):
            used[b] = used.get(b, 0) + n
        if max(used.values()) <= longest:
            best = min(best, sum(bins.cost(best_fit.least_holding(sorted(bins.lengths), u)) for u in used.values()))
    return best


def test_near_the_least_cost():
    rng, bins = random.Random(3), best_fit.Bins(lengths=(4, 8, 16), overhead=1.0, quadratic=64.0)
    ratios = []
    for _ in range(60):
        sizes = [rng.randrange(1, 17) for _ in range(rng.randrange(1, 7))]
        at, offset, lengths = best_fit.pack(np.array(sizes), bins)
        taken = sorted((b, o, n) for b, o, n in zip(at.tolist(), offset.tolist(), sizes, strict=True))
        assert all(x[0] != y[0] or x[1] + x[2] == y[1] for x, y in zip(taken, taken[1:], strict=False))
        ratios.append(sum(map(bins.cost, lengths)) / least_cost(sizes, bins))
    assert min(ratios) >= 1 - 1e-9 and np.mean(ratios) < 1.05 and max(ratios) < 1.4


@pytest.mark.parametrize(("size", "opened"), [(700, 4096), (600, 2048), (1000, 2048), (1365, 4096), (3000, 4096)])
def test_the_length_follows_from_what_is_to_come(size, opened):
    """Five of 700 fill 4,096 best, three of 600 fill 2,048, and so on: by cost a token."""
    bins = best_fit.Bins(lengths=(512, 1024, 2048, 4096), overhead=64.0, quadratic=65_536.0)
    _, _, lengths = best_fit.pack(np.full(600, size), bins)

    def each(c):
        full = min(c // size, 600) * size
        return bins.cost(best_fit.least_holding(sorted(bins.lengths), full)) / full if full else float("inf")

    assert max(set(lengths), key=lengths.count) == min(sorted(bins.lengths), key=each) == opened


def test_any_partitioning_gives_the_same_rows(spark):
    rng = random.Random(5)
    rows = [(i if i % 9 else None, rng.randrange(0, 9000)) for i in range(400)] + [(7, 500)] * 40
    df = spark.createDataFrame(rows, "doc_id long, size long").withColumn("shard", F.lit("x"))
    one = sorted(map(str, best_fit.packed(df, shard_rows=100).collect()))
    assert one == sorted(map(str, best_fit.packed(df.repartition(7, F.rand(3)), shard_rows=100).collect()))
    got = best_fit.packed(df, shard_rows=100).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    want = {}
    for i, n in rows:
        want[i] = want.get(i, 0) + n
    assert {r["doc_id"]: r["n"] for r in got} == {i: n for i, n in want.items() if n}
