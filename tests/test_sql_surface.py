"""The SQL functions against the column functions."""

import random

import pytest
from pyspark.sql import functions as F

from arbiterq.functions import cells, sql
from arbiterq.functions import text as T


def test_functions_equal_columns(spark):
    sql.register(spark)
    rng, words = random.Random(1), ["the", "Big", "red-dog", "of", "É_x", "big", "a", "dog", "", "!!", "two words"]
    some = lambda: rng.choice((None, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 5)))))
    rows = [(i, some(), [some() for _ in range(rng.randrange(0, 3))] if i % 9 else None, rng.choice((True, False, None)), rng.choice((True, False, None))) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, x string, g array<string>, p boolean, c boolean")
    df.createOrReplaceTempView("surface_rows")
    got = spark.sql("SELECT i, aq_normalise(x), aq_match(x, g), aq_cell(p, c), aq_target(aq_cell(p, c)), aq_route(aq_cell(p, c), 'k', 'l', '-'), aq_final(p, c) FROM surface_rows")
    of = cells.cell("p", "c")
    want = df.select("i", T.normalise("x"), T.alias_match("x", "g"), of, cells.routing_target(of), cells.routed_answer(of, F.lit("k"), F.lit("l"), "-"), cells.final_correct("p", "c"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "BatchEvalPython" not in got._jdf.queryExecution().executedPlan().toString()


def test_sides(spark):
    sql.register(spark)
    got = spark.sql("SELECT s.* FROM VALUES (7, 'x', ' '), (8, NULL, 'z') AS v(i, a, b), LATERAL aq_sides(i, a, b) s").collect()
    assert sorted(map(tuple, got)) == [("000007-sup", "sup", "x"), ("000008-conf", "conf", "z")]
    with pytest.raises(Exception, match="must be a text"):
        spark.sql("SELECT * FROM aq_sides(1, 2, 'x')").collect()
