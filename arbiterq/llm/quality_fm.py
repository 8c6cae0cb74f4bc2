"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score(x) = sigmoid(w0 + sum_j w_j x_j + sum_{i<j} <v_i, v_j> x_i x_j); the pairs cost linear time by
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f [(sum_j v_jf x_j)^2 - sum_j v_jf^2 x_j^2].

Features of a text: hashed words (square root of the count, scaled to unit length over the text), about twenty structure
statistics, and metadata of the record (buckets of its size in words, lines and characters). Labels, lang, source and doc_id are no features.
The fit takes at most ``most_rows`` labelled rows in a hash order of their ids, and only their features come to the driver.

Metadata are sizes that follow from the text itself: the record's other columns (lang, source, doc_id) are ruled out as inputs.

Defined results: a null text scores as an empty one; empty texts have all-zero words and a size bucket of their own; labels that
disagree about one id count by their least; with no label, or labels of one class alone, the score is the (smoothed) share of 1; an
empty table gives no row; repeated rows are scored each, and in the fit a labelled row counts as often as it has copies; very long texts are read
whole; other columns, whatever their names, pass through.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, documents, held_out, short_batches

BITS, STATS, BUCKETS = 16, 20, 48
WORDS = 1 << BITS
SIZE = WORDS + STATS + BUCKETS
MOST_ROWS = 4000


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the non-zero features."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    counts = Counter(words)
    at = np.fromiter((zlib.crc32(w) & (WORDS - 1) for w in counts), np.int64, len(counts))
    x = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
    if n:
        x /= np.sqrt((x * x).sum())
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    kinds = list(counts)
    letters = max(1, n)
    size = max(1, len(text))
    stat = [
        sum(map(text.count, "#*$%&")) / letters, text.count("|") / letters, sum(map(text.count, "<>{}[]=+^~@")) / letters, text.count("!") / letters, text.count("?") / letters,
        text.count(",") / letters, text.count(".") / letters, sum(map(text.count, "0123456789")) / size, sum(map(text.count, "-_/\\")) / letters, sum(map(text.count, "\"'()")) / letters,
        sum(c for w, c in counts.items() if w.isupper() and len(w) > 1) / letters, len(kinds) / letters, max(counts.values(), default=0) / letters, (len(lines) - len(set(lines))) / max(1, len(lines)),
        n / max(1, len(lines)) / 50, size / letters / 10, sum(c for w, c in counts.items() if w[-1:] in b".!?") / letters, sum(c for w, c in counts.items() if not w.isalnum()) / letters, sum(len(w) > 20 for w in kinds) / letters, min(1.0, len(kinds) / 200),
    ]
    bucket = [min(15, int(v).bit_length()) for v in (n, len(lines), len(text))]
    return np.concatenate((at, WORDS + np.arange(STATS), WORDS + STATS + 16 * np.arange(3) + bucket)), np.concatenate((x, np.minimum(stat, 4.0), [0.3] * 3))


@dataclass
class Model:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores before the sigmoid of documents whose features lie from starts[i] on; none is empty."""
        vx = self.v[at] * x[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        return self.w0 + np.add.reduceat(self.w[at] * x, starts) + 0.5 * ((sums * sums).sum(axis=1) - squares)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, copies: np.ndarray | None = None, k: int = 8, epochs: int = 12, rate: float = 0.08, decay: float = 1e-4, batch: int = 32, seed: int = 3) -> Model:
    """AdaGrad on the logistic loss, in a fixed order of batches. A row of several copies counts as often."""
    rng = np.random.default_rng(seed)
    copies = np.ones(len(y)) if copies is None else copies
    share = ((y * copies).sum() + 1) / (copies.sum() + 2)
    model = Model(float(np.log(share / (1 - share))), np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, k)))
    if len(y) < 4 or y.min() == y.max():
        model.v[:] = 0
        return model
    weight = np.where(y == 1, 1.0, min(4.0, max(1.0, share / (1 - share)))) * copies  # label 0 is the rare one: errors there count as much in sum
    g0, gw, gv = 1e-8, np.full(SIZE, 1e-8), np.full((SIZE, k), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for b in range(0, len(order), batch):
            own = [rows[i] for i in order[b : b + batch]]
            at, x = np.concatenate([r[0] for r in own]), np.concatenate([r[1] for r in own])
            lengths = np.array([len(r[0]) for r in own])
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            error = (sigmoid(model.raw(at, x, starts)) - y[order[b : b + batch]]) * weight[order[b : b + batch]] / len(own)
            doc = np.repeat(np.arange(len(own)), lengths)
            vx = model.v[at] * x[:, None]
            sums = np.add.reduceat(vx, starts, axis=0)
            each = error[doc] * x
            slots, back = np.unique(at, return_inverse=True)
            dw = np.bincount(back, each, len(slots)) + decay * model.w[slots]
            dv = np.stack([np.bincount(back, each * (sums[doc, f] - vx[:, f]), len(slots)) for f in range(k)], axis=1) + decay * model.v[slots]
            g0 += error.sum() ** 2
            gw[slots] += dw * dw
            gv[slots] += dv * dv
            model.w0 -= rate * error.sum() / np.sqrt(g0)
            model.w[slots] -= rate * dw / np.sqrt(gw[slots])
            model.v[slots] -= rate * dv / np.sqrt(gv[slots])
    return model


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most_rows: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, y, copies): at most ``most_rows`` different labelled rows, none held out, in a hash order of their ids; equal rows are one
    with their number. The ids are chosen before any text is read, and texts by their hashes, so the bound holds for an id of any number of rows."""
    y = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.min(label).alias("y"))
    chosen = y.join(docs.select(F.col(f"`{id_col}`").alias("id")).distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(most_rows)
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(chosen), "id").withColumn("h", F.xxhash64("text"))
    kept = own.groupBy("id", "h").agg(F.count("*").alias("copies")).orderBy(F.xxhash64("id"), "id", "h").limit(most_rows)
    one = own.join(F.broadcast(kept), ["id", "h"]).groupBy("id", "h", "y", "copies").agg(F.first("text").alias("text"))  # most_rows bounds what is sent
    return one.select("id", "text", "y", "copies")


def trained(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    short_batches(docs.sparkSession)

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            f = [features(t) for t in p["text"]]
            yield pd.DataFrame({"id": p["id"], "y": p["y"].astype("int64"), "at": [a.astype("<i4").tobytes() for a, _ in f], "x": [x.astype("<f4").tobytes() for _, x in f], "copies": p["copies"]})

    got = training_rows(docs, labels, "quality", most_rows).mapInPandas(pack, "id long, y long, at binary, x binary, copies long").toPandas()
    got = got.sort_values(["id", "at"], kind="stable")  # the fit doesn't depend on the order of partitions
    rows = [(np.frombuffer(a, "<i4").astype(np.int64), np.frombuffer(x, "<f4").astype(np.float64)) for a, x in zip(got["at"], got["x"], strict=True)]
    return fit(rows, got["y"].to_numpy(np.float64), got["copies"].to_numpy(np.float64))


def scored(df: DataFrame, model: Model, name: str, text: str = "text") -> DataFrame:
    """``df`` with the probability of label 1."""
    spark = df.sparkSession
    short_batches(spark)
    sent = spark.sparkContext.broadcast(Model(model.w0, model.w.astype(np.float32), model.v.astype(np.float32)))  # SIZE x (k + 1) numbers whatever the input

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        for texts in parts:
            out = []
            for at, x in map(features, texts):
                out.append(own.raw(at, x, np.zeros(1, np.int64))[0])
            yield pd.Series(sigmoid(np.array(out, np.float64)))

    return df.withColumn(name, run(F.col(f"`{text}`").cast("string")))


def op2_quality_fm(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs.select("doc_id", "text"), model, "score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
