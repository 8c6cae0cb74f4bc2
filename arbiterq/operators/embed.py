"""Texts to vectors, each different text once, and the match by meaning that needs them.

An embedder has ``embed(texts) -> array [texts, width]``; it is made once a task. ``Slots`` is a deterministic stand-in that SQL can say.
Vectors are kept by the md5 of their text in a store, so that a text is encoded once for all rows, queries and runs.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import alias_match, col, text
from ..functions.vector import cosine

#: Fixed value: the cosine from which two texts mean the same.
LEVEL = 0.65
VECTORS = "text_hash string, v array<double>"


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


@lru_cache(100_000)
def slot(word: str) -> int:
    return hashlib.md5(word.encode()).digest()[0] >> 4


class Slots:
    """How often each first digit of the md5 of a text's lower-cased words occurs: sixteen numbers."""

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.array([np.bincount([*map(slot, t.lower().split())], minlength=16) for t in texts], float).reshape(len(texts), 16)


@dataclass(frozen=True)
class Store:
    """Vectors in a folder, a subfolder a run, of one embedder."""

    path: str

    def vectors(self, spark: SparkSession) -> DataFrame:
        """(VECTORS) A row a text; runs are named one by one, as two readings of one folder pass for the same in a plan."""
        top = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = top.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(top)
        runs = sorted(x.getPath().toString() for x in files.listStatus(top) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS")))
        if not runs:
            return spark.createDataFrame([], VECTORS)
        return spark.read.schema(VECTORS).parquet(*runs).groupBy("text_hash").agg(F.first("v").alias("v"))

    def of(self, texts: DataFrame, make: Callable[[], Embedder], batch: int = 64) -> DataFrame:
        """The vectors of the store after every text of ``texts`` (one column, text) that it lacked has been encoded, once. Batches have
        texts of like length. A null text has no vector."""
        spark = texts.sparkSession
        own = texts.where("text is not null").select(F.md5("text").alias("text_hash"), "text").dropDuplicates(["text_hash"])
        new = own.join(self.vectors(spark).select("text_hash"), "text_hash", "left_anti")

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            embedder = make()
            for part in parts:
                part = part.iloc[np.argsort(part["text"].str.len(), kind="stable")]
                for at in range(0, len(part), batch):
                    rows = part.iloc[at : at + batch]
                    yield pd.DataFrame({"text_hash": rows["text_hash"], "v": list(np.asarray(embedder.embed(rows["text"].tolist()), float))})

        new.mapInPandas(run, VECTORS).write.parquet(f"{self.path}/run={uuid.uuid4().hex}")
        return self.vectors(spark)


def semantic_match(df: DataFrame, key: str, answer: str, aliases: str, make: Callable[[], Embedder], store: Store, level: float = LEVEL, name: str = "match") -> DataFrame:
    """``df`` with ``name``: the answer matches an alias as a text, or else the greatest cosine of its vector and an alias's is ``level`` or more.

    Only texts of rows without a match as texts are encoded. ``key`` tells rows apart. Null or blank answers, and rows without aliases, don't match."""
    own = df.withColumn("__said", alias_match(answer, aliases))
    unsure = own.where(~F.col("__said") & (F.trim(text(answer)) != "")).select(F.col(key).alias("__key"), F.col(answer).alias("a"), F.explode(F.array_distinct(F.filter(col(aliases), lambda x: F.trim(x) != ""))).alias("b"))
    texts = unsure.select(F.explode(F.array("a", "b")).alias("text"))
    v = store.of(texts, make)
    va, vb = (v.select(F.col("text_hash").alias(f"h{x}"), F.col("v").alias(f"v{x}")) for x in "ab")
    pairs = unsure.select("__key", F.md5("a").alias("ha"), F.md5("b").alias("hb")).join(va, "ha").join(vb, "hb")
    best = pairs.groupBy("__key").agg(F.max(F.round(cosine("va", "vb"), 9)).alias("__best"))
    out = own.join(best, F.col(key).eqNullSafe(F.col("__key")), "left")
    return out.withColumn(name, F.col("__said") | F.coalesce(F.col("__best") >= level, F.lit(False))).drop("__said", "__key", "__best")
