"""Best-fit packing into bins of several permitted lengths.

Documents longer than the longest permitted length are cut into pieces of that length and a rest. Pieces are dealt by hash into
shards of bounded size and each shard is packed on its own: pieces by descending length go into the open bin with the least
room that still holds them. Where none does, a bin opens, and all permitted lengths are compared for it: each is filled in thought
with the largest pieces that are still to come (their histogram is kept), shrunk to what that fill needs, and the one with the least
cost a token is opened. At the end each bin shrinks to the least permitted length that holds its contents.

The cost of a bin of length c is ``overhead + c + c^2 / quadratic``: a sequence's fixed cost, its tokens, and attention.

The shard of a piece follows from doc_id, size, place and its number among equal pieces alone, and so does its place in the bin: any
partitioning of the input, and any rerun, gives the same rows.

Defined results: null and wordless texts have no piece; an empty table gives no row; very long texts are cut as above; repeated rows are
packed each; ties of length go by doc_id (null first), piece and copy; rows without an id keep a null id; only doc_id and size are read,
so columns with clashing names don't matter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, n_words, written

SHARD = 40_000
#: Equal rows that one array holds while they are dealt out.
RUN = 10_000


@dataclass(frozen=True)
class Bins:
    lengths: tuple[int, ...] = (512, 1024, 2048, 4096)
    overhead: float = 64.0
    quadratic: float = 65_536.0

    def cost(self, c: int) -> float:
        return self.overhead + c + c * c / self.quadratic


class Left:
    """The histogram of the pieces that are still to come."""

    def __init__(self, sizes: list[int], longest: int) -> None:
        self.count, self.mask = [0] * (longest + 1), 0  # mask, bit n: there is a piece of length n
        for n in sizes:
            self.count[n] += 1
            self.mask |= 1 << n

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.mask &= ~(1 << n)

    def fill(self, room: int) -> int:
        """How much of a room the largest pieces would fill, each in turn if it fits."""
        filled, mask = 0, self.mask
        while mask := mask & ((2 << (room - filled)) - 1):
            n = mask.bit_length() - 1
            filled += n * min(self.count[n], (room - filled) // n)
            mask &= ~(1 << n)
        return filled


def least_holding(lengths: list[int], n: int) -> int:
    return next(c for c in lengths if c >= n)


def pack(sizes: np.ndarray, bins: Bins) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each piece, and the final length of each bin. ``sizes`` are in 1..max(lengths)."""
    at, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    lengths, used = sorted(bins.lengths), []
    open_at: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]
    mask = 0  # bit r: a bin with r places left is open
    order, own = np.argsort(-sizes, kind="stable").tolist(), sizes.tolist()
    left = Left(own, lengths[-1])

    def each(c: int, n: int) -> tuple[float, int]:
        """Cost a token of a bin of length c that begins with a piece of length n."""
        full = n + left.fill(c - n)
        return bins.cost(least_holding(lengths, full)) / full, c

    for i in order:
        n = own[i]
        left.take(n)
        if fits := mask >> n:
            r = n + (fits & -fits).bit_length() - 1
            b = open_at[r].pop()
            if not open_at[r]:
                mask &= ~(1 << r)
        else:
            b, r = len(used), min(each(c, n) for c in lengths if c >= n)[1]
            used.append(0)
        at[i], offset[i] = b, used[b]
        used[b] += n
        if room := r - n:
            open_at[room].append(b)
            mask |= 1 << room
    return at, offset, [least_holding(lengths, u) for u in used]


def numbered_copies(sized: DataFrame) -> DataFrame:
    """(doc_id, size, copy): equal rows numbered from 0, without gathering them: they are counted, then dealt out again in runs."""
    times = sized.where("size > 0").groupBy("doc_id", "size").agg(F.count("*").alias("times"))
    runs = times.withColumn("run", F.explode(F.expr(f"sequence(0L, (times - 1) div {RUN})")))
    return runs.withColumn("copy", F.explode(F.expr(f"sequence(run * {RUN}, least(times, (run + 1) * {RUN}) - 1)"))).select("doc_id", "size", "copy")


def packed(sized: DataFrame, bins: Bins = Bins(), shard_rows: int = SHARD) -> DataFrame:
    """``sized`` (doc_id, size) to (doc_id, piece, start, length, shard, bin, offset, capacity).

    Each row of a shard costs some tens of bytes; a shard holds about ``shard_rows`` pieces whatever the input's size.
    """
    longest = max(bins.lengths)
    pieces = numbered_copies(sized).withColumn("piece", F.explode(F.expr(f"sequence(0L, (size - 1) div {longest})")))
    pieces = pieces.select("doc_id", "size", "copy", "piece", (F.col("piece") * longest).alias("start"), F.least(F.lit(longest).cast("long"), F.col("size") - F.col("piece") * longest).alias("length"))
    pieces = written(pieces, "pieces")
    shards = max(1, math.ceil(pieces.count() / shard_rows))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "size", "copy", "piece"), F.lit(shards)))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece", "size", "copy"], ascending=[False, True, True, True, True], kind="stable", na_position="first")
        at, offset, lengths = pack(part["length"].to_numpy(np.int64), bins)
        return pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "piece": part["piece"], "start": part["start"], "length": part["length"], "shard": part["shard"], "bin": at, "offset": offset, "capacity": np.array(lengths, np.int64)[at]})

    return dealt.groupBy("shard").applyInPandas(run, "doc_id long, piece long, start long, length long, shard long, bin long, offset long, capacity long")


def op7_best_fit(spark, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir).select("doc_id", n_words(F.col("text")).alias("size")))
