"""The interval sweep against all pairs, on any intervals, cut into blocks of any length, and on odd shop tables."""

import random
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from arbiterq.llm import interval_sweep as I

INF = float("inf")


def relation(a, b, c, d):
    row = {-1: ("overlaps", "finished_by", "contains"), 0: ("starts", "equals", "started_by"), 1: ("during", "finishes", "overlapped_by")}[(a > c) - (a < c)]
    return row[(b > d) - (b < d) + 1]


def all_pairs(left, right):
    out = defaultdict(lambda: [0, None, 0])
    for k, a, b in set(left):
        for k2, c, d, w in right:
            b_, d_ = INF if b is None else max(a, b), INF if d is None else max(c, d)
            if k == k2 and k is not None and a is not None and c is not None and c <= b_ and a <= d_:
                o = out[k, a, b if b is None else max(a, b), relation(a, b_, c, d_)]
                o[0] += 1
                o[2] += w
                if (shared := min(b_, d_) - max(a, c) + 1) < INF:
                    o[1] = (o[1] or 0) + shared
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("block", [1, 7, 336])
def test_relations_equal_all_pairs(spark, block):
    rng = random.Random(block)

    def some(n):
        rows = [(rng.choice((1, 1, 1, 2, 3)), a := rng.randrange(-30, 60), rng.choice((None, a, a + rng.randrange(4), a + rng.randrange(40)))) for _ in range(n)]
        return [*rows, *rows[: n // 5], (None, 1, 2), (4, 5, 1), (4, 5, None)]

    left, right = some(120), [(*x, rng.randrange(1 << 32)) for x in some(150)]
    right += [(5, 0, 3, 1)]
    got = I.relations(spark.createDataFrame(left, "key long, start long, end long"), spark.createDataFrame(right, "key long, start long, end long, w0 long"), "w0", block).collect()
    assert {(r["key"], r["a"], None if r["b"] == I.OPEN else r["b"], r["relation"]): (r["n"], r["slots"], r["w"]) for r in got} == all_pairs(left, right)


def test_string_keys_and_empty_sides(spark):
    one, none = spark.createDataFrame([("k", 1, 2)], "key string, start long, end long"), spark.createDataFrame([], "key string, start long, end long")
    assert [(r["key"], r["relation"], r["n"], r["slots"]) for r in I.relations(one, one).collect()] == [("k", "equals", 1, 2)]
    assert not I.relations(one, none).collect() and not I.relations(none, one).collect() and not I.relations(none, none).collect()


@pytest.mark.parametrize("block", [1, 3, 144])
def test_sessions_cut_at_any_block(spark, block):
    rng, clicks = random.Random(block), [(None, 5, True), (1, None, False)]
    for key in range(4):
        t = rng.randrange(-(10**9), 10**9)
        for _ in range(150):
            t += rng.choice((0, 1, 10**6, 599_999_999, 600_000_000, 600_000_001, 2 * 10**9))
            clicks.append((key, t, rng.random() < 0.3))
    want = []
    for key in range(4):
        run = []
        for us, flag in [*sorted((u, f) for k, u, f in clicks if k == key and u is not None), (None, None)]:
            if run and (us is None or us - run[-1][0] > 600_000_000):
                want.append((key, run[0][0], run[-1][0], any(f for u, f in run if u == run[-1][0])))
                run = []
            run.append((us, flag))
    got = I.sessions(spark.createDataFrame(clicks, "key long, us long, flag boolean"), block=block).collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_query_on_odd_tables(spark, tmp_path):
    t = datetime(2024, 1, 1, 10, 30)
    m, h = timedelta(minutes=1), timedelta(hours=1)
    clicks = [(1, t, 1, "view"), (2, t + 10 * m, 1, "purchase"), (3, t + 10 * m, 1, None), (3, t + 10 * m, 1, None), (4, t + 5 * h, 1, "purchase"), (5, t + 5 * h + 1 * m, 1, "view"), (6, t, None, "view"), (7, None, 1, "purchase"), (8, t, 2, "view")]
    sales = [(10, 1, t - h), (11, 1, t - h), (12, 2, t), (12, 2, t), (None, 1, t), (13, None, t), (14, 1, None), (15, 3, t)]
    lines = [(10, t + 4 * h), (10, t - 9 * h), (11, None), (11, t), (None, None), (13, t), (99, None)]
    spark.createDataFrame(clicks, "click_id long, ts timestamp_ntz, client_id long, kind string").write.parquet(f"{tmp_path}/clicks.parquet")
    spark.createDataFrame(sales, "sale_id long, client_id long, sold_at timestamp_ntz").write.parquet(f"{tmp_path}/sales.parquet")
    spark.createDataFrame(lines, "sale_id long, shipped_at timestamp_ntz").write.parquet(f"{tmp_path}/sale_lines.parquet")
    crc = lambda x: zlib.crc32(str((x - datetime(1970, 1, 1)) // timedelta(microseconds=1)).encode())
    got = sorted((tuple(r) for r in I.op12_interval_sweep(spark, str(tmp_path)).collect()), key=str)
    # client 1: an open session from 10 h, a closed one in 15 h; sale 10: 9 to 14 h; sale 11: 9 h on; null: 10 h
    want = [(10, "overlaps", 1, 5, crc(t)), (11, "finished_by", 1, None, crc(t)), (11, "contains", 1, 1, crc(t + 5 * h)), (12, "equals", 2, 2, 2 * crc(t)), (None, "starts", 1, 1, crc(t))]
    assert got == sorted(want, key=str)
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "America/New_York")
    assert sorted((tuple(r) for r in I.op12_interval_sweep(other, str(tmp_path)).collect()), key=str) == got
