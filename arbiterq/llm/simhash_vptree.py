"""SimHash near-duplicates by vantage-point trees.

1. Fingerprints, one Arrow pass over the whole texts.
2. Equal fingerprints become one node with their least doc_id (partial aggregation, so a hot group costs a row a task).
3. A vantage-point tree over a bounded sample of fingerprints gives the shards. A fingerprint at distance d of a vantage
   point whose radius is m goes inside if d <= m and outside if d >= m - (r - 1): by the triangle inequality two fingerprints
   at r or fewer bits meet in at least one shard, whatever the sample was. The sample decides balance only. Each level of the tree
   repeats a fingerprint 1.3 times on average, so shards grow with the cube root of the table (16,384 fingerprints for a quarter of a
   million, 0.5 million for 10^10), which keeps both the copies and a task's memory small. The depth is laid out from at most MOST_DRAWN
   sampled fingerprints, and a branch that fewer than 64 of them reach isn't divided: it ends near 22 levels, which is enough for some 10^13 fingerprints.
4. Each shard grows its own vantage-point tree down to small leaves and compares whole leaves exactly. A leaf gives a
   spanning forest of its links, never all pairs.
5. Distributed union-find over the links.

Defined results: null and blank texts have fingerprint zero and link like any other; a null doc_id gets a fingerprint and the
component's least id (null if no member has an id); repeated rows stay and share their component; texts are read whole, however long;
an empty table gives no row; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fresh, short_batches, slim, written
from .graph import components

SHARD, LEAF, SAMPLE = 16_384, 512, 20_000
#: Fingerprints that a shard holds SHARD of, and those that may come to the driver to lay out the shards (8 MB).
SMALL, MOST_DRAWN = 1 << 18, 1_000_000
#: Fingerprints that are dealt out at once.
DEALT = 1 << 16


def fingerprint(text: str | None, seed: int = 42, k: int = 3) -> int:
    """64-bit SimHash of the k-word shingles, repeats included; A-Z alone are lower-cased."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= k:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[: 1 - k].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for block in range(0, len(h), 8192):
        ones += np.unpackbits(h[block : block + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, name: str, text: str = "text") -> DataFrame:
    """``df`` with the fingerprint as a signed long."""
    short_batches(df.sparkSession)

    @F.pandas_udf("long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))
        slim()

    return df.withColumn(name, run(F.col(f"`{text}`").cast("string")))


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def split_at(points: np.ndarray, rng: np.random.Generator, reach: int) -> tuple[np.uint64, int, float]:
    """Of a few vantage points the one whose median sphere has the fewest points in the doubled shell: point, radius, share doubled."""
    best = (points[0], 64, 2.0)
    for v in points[rng.integers(0, len(points), 8)]:
        d = distance(points, v)
        m = int(np.median(d))
        for radius in (m - 1, m):
            inside, outside = (d <= radius).mean(), (d > radius - reach).mean()
            if 0 < inside and 0 < outside and max(inside, outside) + 0.1 * (inside + outside) < best[2]:
                best = (v, radius, max(inside, outside) + 0.1 * (inside + outside))
    return best


def grow(sample: np.ndarray, depth: int, reach: int, rng: np.random.Generator) -> list | None:
    """The tree of shards: nested [vantage, radius, inside, outside]; None is a shard."""
    if depth == 0 or len(sample) < 64:
        return None
    v, radius, share = split_at(sample, rng, reach)
    if share > 1.1:  # every point is at the same place: no sphere parts them
        return None
    d = distance(sample, v)
    return [v, radius, grow(sample[d <= radius], depth - 1, reach, rng), grow(sample[d > radius - reach], depth - 1, reach, rng)]


def route(points: np.ndarray, tree: list | None, reach: int, number: int = 1) -> list[tuple[int, np.ndarray]]:
    """(shard, its points) for all shards that the points reach."""
    if tree is None or not len(points):
        return [(number, points)] if len(points) else []
    d = distance(points, tree[0])
    return route(points[d <= tree[1]], tree[2], reach, 2 * number) + route(points[d > tree[1] - reach], tree[3], reach, 2 * number + 1)


class Union:
    """Union-find over the rows of a shard."""

    def __init__(self, n: int) -> None:
        self.top = list(range(n))

    def find(self, i: int) -> int:
        while self.top[i] != i:
            self.top[i] = i = self.top[self.top[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.top[max(i, j)] = min(i, j)
        return i != j


def leaf_links(points: np.ndarray, at: np.ndarray, union: Union, reach: int) -> None:
    """Links all pairs at ``reach`` or fewer bits; pairs that are joined already are not looked at one by one."""
    near = np.flatnonzero(distance(points, points[0]) <= reach)
    for i in near[1:].tolist():
        union.join(int(at[0]), int(at[i]))
    rest = np.ones(len(points), bool)
    rest[near] = False  # all of these are in one component: only pairs with another point can add to it
    order = np.concatenate((np.flatnonzero(rest), near))
    p, a, n = points[order], at[order], int(rest.sum())
    for block in range(0, n, 256):
        d = np.bitwise_count(p[block : block + 256, None] ^ p[None, block:])
        for i, j in zip(*(x.tolist() for x in np.nonzero(d <= reach)), strict=True):
            if i < j:
                union.join(int(a[block + i]), int(a[block + j]))


def shard_links(points: np.ndarray, reach: int, leaf: int = LEAF) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct points, by a vantage-point tree of its own."""
    rng, union = np.random.default_rng(7), Union(len(points))
    stack = [np.arange(len(points))]
    while stack:
        at = stack.pop()
        own = points[at]
        if len(at) > leaf:
            v, radius, share = split_at(own if len(own) < 4096 else own[rng.integers(0, len(own), 4096)], rng, reach)
            d = distance(own, v)
            inside, outside = at[d <= radius], at[d > radius - reach]
            if share < 1.05 and max(len(inside), len(outside)) < 0.9 * len(at):
                stack += [inside, outside]
                continue
        if len(at) > 1:
            leaf_links(own, at, union, reach)
    top = [union.find(i) for i in range(len(points))]
    return [(i, t) for i, t in enumerate(top) if i != t]


def levels(n: int, shard: int) -> int:
    """Depth of the tree of shards for n fingerprints."""
    aim = shard * max(1.0, n / SMALL) ** (1 / 3)
    return max(0, math.ceil(math.log2(max(1, n) / aim)))


def links(nodes: DataFrame, bits: int = 3, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """(u, v): links that span every component of fingerprints (column fp, distinct) at ``bits`` or fewer bits."""
    depth = levels(nodes.count(), shard)
    tree = None
    if depth:
        few = min(MOST_DRAWN, max(sample, 128 << depth))
        drawn = nodes.select("fp").orderBy(F.xxhash64("fp")).limit(few).toPandas()["fp"]  # bounded; serves balance alone
        tree = grow(drawn.to_numpy(np.int64).view(np.uint64), depth, bits, np.random.default_rng(5))

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []

        def out() -> Iterator[pd.DataFrame]:
            for number, points in route(np.concatenate(held).view(np.uint64), tree, bits):
                yield pd.DataFrame({"shard": number, "fp": points.view(np.int64)})
            held.clear()

        for part in parts:
            held.append(part["fp"].to_numpy(np.int64))
            if sum(map(len, held)) >= DEALT:
                yield from out()
        if held:
            yield from out()

    def link(part: pd.DataFrame) -> pd.DataFrame:
        fp = np.unique(part["fp"].to_numpy(np.int64))
        pairs = np.array(shard_links(fp.view(np.uint64), bits), np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": fp[pairs[:, 0]], "v": fp[pairs[:, 1]]})

    return nodes.select("fp").mapInPandas(deal, "shard long, fp long").groupBy("shard").applyInPandas(link, "u long, v long")


def named(prints: DataFrame, bits: int) -> DataFrame:
    """(fp, component) of every different fingerprint of ``prints``; component: a fingerprint of the component."""
    nodes = written(prints.select("fp").distinct(), "nodes")
    linked = components(links(nodes, bits))
    return nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def grouped(df: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int = 3) -> DataFrame:
    """(id, fp, component_id) for each row of ``df``."""
    prints = written(fingerprints(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")), "fp").select("id", "fp"), "fingerprints")
    of = named(prints, bits).join(prints.groupBy("fp").agg(F.min("id").alias("least")), "fp")
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(of.join(least, "component").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int = 3) -> DataFrame:
    """The rows of ``df`` that stay: one document of each group, with its columns as they were: that with the least id, rows without an
    id after all others; of rows that share the id, the text with the least hash. Rows that agree in id and text are one document, of
    which one row stays. Rows that share an id but are not alike are documents of their own."""
    own = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("key"), F.col(f"`{text}`").alias("text"))
    prints = written(fingerprints(own, "fp").groupBy("id", "key").agg(F.min("fp").alias("fp"), F.count("*").alias("times")), "fingerprints")
    at = F.struct(F.col("id").isNull().alias("no_id"), "id", "key")
    first = prints.groupBy("fp").agg(F.min(F.struct(at.alias("at"), "times")).alias("first"))  # before the join: a hot fingerprint is a row a task
    stay = first.join(named(prints, bits), "fp").groupBy("component").agg(F.min("first").alias("first"))
    stay = written(stay.select("first.at.id", "first.at.key", "first.times"), "stay")
    key, id_, hash_ = (fresh(df, stem) for stem in ("hash_of_text", "id_of_stay", "key_of_stay"))
    marked = df.withColumn(key, F.xxhash64(F.col(f"`{text}`")))
    kept = marked.join(stay.select(F.col("id").alias(id_), F.col("key").alias(hash_)), (F.col(key) == F.col(hash_)) & F.col(f"`{id_col}`").eqNullSafe(F.col(id_)), "left_semi")
    if stay.where("times > 1").limit(1).count():
        kept = kept.dropDuplicates([id_col, key])
    return kept.drop(key)


def op10_simhash_vptree(spark, sf_dir: str) -> DataFrame:
    found = grouped(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
