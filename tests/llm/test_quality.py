"""The quality classifier's query on a table of its own, against the model in dense arithmetic, and on odd tables."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbiterq.llm import quality_fm

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def text(rng, good):
    ws = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(20, 60))]
    return "\n".join(" ".join(ws[k : k + 12]) + "." for k in range(0, len(ws), 12)) if good else " ".join(w.upper() + rng.choice(("!!", "###", "$")) for w in ws)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng, folder = random.Random(1), tmp_path_factory.mktemp("quality")
    rows = [(i, text(rng, i % 5 > 0)) for i in range(500)] + [(900, None), (901, ""), (902, " \n")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "score": F.lit(9)}).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(500)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def test_query_equals_dense_arithmetic(spark, sf):
    folder, rows = sf
    got = {r["doc_id"]: r for r in quality_fm.op2_quality_fm(spark, folder).collect()}
    assert len(got) == len(rows) and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    held = [i for i, _ in rows if i < 500 and got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == (i % 5 > 0) for i in held]) > 0.97
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality_fm.trained(docs, labels)
    for i, t in rows[::50] + rows[-3:]:
        at, x = quality_fm.features(t)
        dense = np.zeros(quality_fm.SIZE)
        np.add.at(dense, at, x)
        there = np.flatnonzero(dense)
        pairs = sum(float(model.v[a] @ model.v[b]) * dense[a] * dense[b] for k, a in enumerate(there) for b in there[:k])
        own = sum(0.5 * (dense[a] ** 2 - sum(x[at == a] ** 2)) * float(model.v[a] @ model.v[a]) for a in there)  # words that share a slot
        z = model.w0 + float(model.w @ dense) + pairs + own
        assert got[i]["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=2e-4)


def test_labels_of_held_out_rows_teach_nothing(spark, sf):
    folder, _ = sf
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    other = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_fm.trained(docs, x) for x in (labels, other))
    assert a.w0 == b.w0 and np.array_equal(a.w, b.w) and np.array_equal(a.v, b.v)


def test_odd_and_empty_tables(spark, sf, odd, nothing):
    folder, _ = sf
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality_fm.trained(docs, labels)
    clash = odd.withColumns({"score": F.lit(1), "p": F.lit("x"), "id": F.lit(2), "y": F.lit(3)})
    out = quality_fm.scored(clash, model, "own").collect()
    assert len(out) == 8 and all(0 <= r["own"] <= 1 and r["p"] == "x" for r in out) and len({r["own"] for r in out if r["doc_id"] == 5}) == 1
    assert quality_fm.scored(nothing, model, "own").count() == 0
    for few in (labels.limit(0), labels.where("quality = 1")):
        assert len({round(r["own"], 9) for r in quality_fm.scored(docs.limit(9), quality_fm.trained(docs, few), "own").collect()}) == 1
    assert quality_fm.trained(nothing, labels).w.any() == False  # noqa: E712
