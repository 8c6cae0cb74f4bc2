"""Document fingerprints of improbable features: byte windows of rare entropy in chained Bloom filters.

1. Every window of WINDOW bytes has an entropy, kept as a class of about a hundredth of a bit. How often each class occurs in
   all documents is counted first; the rarer its class, the lower a window's rank.
2. In each run of RUN neighbouring windows the one of lowest rank, the first if several, gets a point; a window with POINTS of them is a
   feature. It depends on the bytes around it alone, so that shared passages have the same features wherever they stand. A text
   with fewer windows asks for as many points as it has runs. In a text under SHORT bytes there is nothing to choose from: all its windows
   of SMALL bytes are features too, or the whole text if it is shorter than that.
3. Features go, in order, into a chain of Bloom filters of BITS bits, five bits each; a filter is full with FULL different features.
   The fingerprint is the filters in base64; an empty text has an empty one. Equal texts have equal fingerprints.
4. Two fingerprints are compared filter by filter: the common bits beyond those that chance gives (and MARGIN of the rest, or twice
   the root of chance), as a share of what is possible. Each filter of the shorter chain counts with its best partner, weighted by its bits: 0 to 1.

``digested`` pairs each document with the next one by descending id: ranges of ids are the parts, dealt by their number, and each part
also gets the first document of the part after it; the last one gets the very first. Rows are streamed, one held back, so memory is
that of a batch.

Defined results: null texts are empty; rows without an id come last; rows that share an id are ordered by the hash of their text; equal
rows count each; a table of one document has itself as the next; an empty table gives no row; very long texts are
read whole, in pieces that overlap; other columns are ignored. All rows of one id are in one part.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, slim

WINDOW, RUN, POINTS = 32, 32, 8
SHORT, SMALL = 128, 12
BITS, HASHES, FULL, MARGIN = 2048, 5, 160, 0.1
#: Bytes whose windows are counted at once.
PIECE = 1 << 18
#: c log2 c of the number c of equal bytes in a window, in 1/1024; a window's sum is 1024 * WINDOW * (log2 WINDOW - entropy).
TERMS = np.array([0] + [round(1024 * c * np.log2(c)) for c in range(1, WINDOW + 2)], np.int32)
SHIFT = 8
CLASSES = (int(TERMS[WINDOW]) >> SHIFT) + 1


def piece_classes(x: np.ndarray) -> np.ndarray:
    """The class of every window of the bytes x; windows start at 0 to len(x) - WINDOW."""
    n = len(x)
    order = np.argsort(x, kind="stable").astype(np.int32)
    value = x[order]
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)  # equal bytes less than WINDOW away
    at = np.arange(n, dtype=np.int32)
    for j in range(1, WINDOW):
        at = at[at >= j]
        a, b = order[at], order[at - j]
        near = (a - b < WINDOW) & (value[at] == value[at - j])
        at = at[near]
        if not len(at):
            break
        before[a[near]] += 1
        after[b[near]] += 1
    first = TERMS[np.bincount(x[:WINDOW], minlength=256)].sum()
    gone, come = after[: n - WINDOW] + 1, before[WINDOW:]  # a step: a byte leaves, one comes
    step = TERMS[gone - 1] - TERMS[gone]
    step += TERMS[come + np.uint8(1)] - TERMS[come]
    return (np.cumsum(np.concatenate([[first], step]), dtype=np.int64) >> SHIFT).astype(np.uint16)


def classes(texts: list[bytes]) -> list[np.ndarray]:
    """The classes of all windows of each text (none if it is shorter), many short texts at once."""
    whole = b"".join(texts)
    if len(whole) < WINDOW:
        return [np.zeros(0, np.uint16) for _ in texts]
    x = np.frombuffer(whole, np.uint8)
    parts = [piece_classes(x[lo : lo + PIECE + WINDOW - 1]) for lo in range(0, len(x) - WINDOW + 1, PIECE)]
    every = np.concatenate(parts) if len(parts) > 1 else parts[0]
    ends = np.cumsum([len(t) for t in texts])
    return [every[end - len(t) : max(end - len(t), end - WINDOW + 1)] for t, end in zip(texts, ends, strict=True)]


def lowest(key: np.ndarray, run: int) -> np.ndarray:
    """The least of each ``run`` neighbours, by minima from the left and from the right of blocks of that length."""
    n, k = len(key), -(-len(key) // run)
    full = np.full(k * run, np.iinfo(key.dtype).max, key.dtype)
    full[:n] = key
    blocks = full.reshape(k, run)
    left, right = np.minimum.accumulate(blocks, 1).ravel(), np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - run + 1], left[run - 1 : n])


def chosen(ranks: np.ndarray) -> np.ndarray:
    """Where the features of a text start, by the ranks of its windows."""
    n = len(ranks)
    if n <= RUN:
        return np.array([int(np.argmin(ranks))]) if n else np.zeros(0, np.int64)
    need, out = min(POINTS, n - RUN + 1), []
    for lo in range(0, n, PIECE):  # windows of lo to hi, with all runs that hold them
        hi, start = min(n, lo + PIECE), max(0, lo - RUN + 1)
        own = ranks[start : min(n, hi + RUN - 1)].astype(np.int64) << 32 | np.arange(min(n, hi + RUN - 1) - start)
        points = np.bincount(lowest(own, RUN) & 0xFFFFFFFF, minlength=len(own))[lo - start : hi - start]
        out.append(np.flatnonzero(points >= need) + lo)
    return np.concatenate(out)


def filters(text: bytes, ranks: np.ndarray) -> np.ndarray:
    """The chain of packed filters, a row each."""
    features = [text[i : i + WINDOW] for i in chosen(ranks).tolist()]
    if 0 < len(text) < SHORT:
        features += [text[i : i + SMALL] for i in range(max(1, len(text) - SMALL + 1))]
    digests, of, seen, k = [], [], set(), 0
    for feature in features:
        d = hashlib.sha1(feature, usedforsecurity=False).digest()
        if d in seen:
            continue
        if len(seen) == FULL:
            seen.clear()
            k += 1
        seen.add(d)
        digests.append(d)
        of.append(k)
    out = np.zeros((k + 1 if of else 0, BITS), bool)
    if of:
        bits = np.frombuffer(b"".join(digests), ">u4").reshape(-1, HASHES) % BITS
        out[np.array(of)[:, None], bits] = True
    return np.packbits(out, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """How alike two chains are, 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    score, weight = 0.0, 0
    for lo in range(0, len(a), 1024):
        x = np.unpackbits(a[lo : lo + 1024], axis=1).astype(np.float32)
        nx, best = x.sum(1), np.zeros(len(x), np.float32)
        for at in range(0, len(b), 1024):
            y = np.unpackbits(b[at : at + 1024], axis=1).astype(np.float32)
            ny = y.sum(1)
            most, chance = np.minimum.outer(nx, ny), np.outer(nx, ny) / BITS
            least = np.minimum(chance + np.maximum(MARGIN * (most - chance), 2 * np.sqrt(chance)), most - 0.5)
            best = np.maximum(best, ((x @ y.T - least) / np.maximum(most - least, 1e-6)).max(1))
        score, weight = score + float((best.clip(0, 1) * nx).sum()), weight + float(nx.sum())
    return min(1.0, score / weight)


def shown(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def chain_of(fingerprint: str) -> np.ndarray:
    """The filters of a fingerprint."""
    return np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, BITS // 8)


def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, n): how often each class occurs in the texts of a task."""
    sums = np.zeros(CLASSES, np.int64)
    for batch in batches:
        for texts in grouped(batch.column(0).to_pylist()):
            for own in classes(texts):
                sums += np.bincount(own, minlength=CLASSES)
    at = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at])], ["class", "n"])
    slim()


def grouped(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Neighbours of together at most PIECE bytes, or one."""
    out, size = [], 0
    for t in texts:
        if out and size + len(t) > PIECE:
            yield out
            out, size = [], 0
        out.append(t)
        size += len(t)
    if out:
        yield out


def ranks_of_classes(texts: DataFrame) -> np.ndarray:
    """The rank of each entropy class by its rarity in all of ``texts`` (one binary column); a row a class goes to the driver."""
    counts = np.zeros(CLASSES, np.int64)
    for r in texts.mapInArrow(histogram, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        counts[r["class"]] = r["n"]
    ranks = np.empty(CLASSES, np.uint16)
    ranks[np.lexsort((np.arange(CLASSES), counts))] = np.arange(CLASSES)
    return ranks


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def edited(text: str, after: str) -> tuple[bytes, bytes]:
    """What stays of a text, and what replaces its last third."""
    third = len(text) // 3
    return text[: len(text) - third].encode(), after[:third].encode()


def compared(batches: Iterator[pa.RecordBatch], ranks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """OUT of rows (part, guest, doc_id, text) in order; the last of each part is a guest, the one that follows its last own row."""
    held: list[tuple] = []  # part, guest, id, text, chain, ranks of the last row so far

    def rows(news: list[tuple]) -> Iterator[tuple]:
        raw = [t.encode() for *_, t in news]
        own = [ranks[c] for c in classes(raw)]
        full = [*held, *((*r, filters(b, k), k) for r, b, k in zip(news, raw, own, strict=True))]
        pairs = [(x, y) for x, y in zip(full, full[1:], strict=False) if x[0] == y[0] and not x[1]]
        cut = [edited(x[3], y[3]) for x, y in pairs]
        tails = classes([stays[-(WINDOW - 1) :] + new for stays, new in cut])
        for (x, y), (stays, new), tail in zip(pairs, cut, tails, strict=True):
            whole = stays + new
            k = np.concatenate([x[5][: max(0, len(stays) - WINDOW + 1)], ranks[tail]])
            chain = filters(whole, k)
            yield x[2], len(x[3]), hashlib.sha256(whole).hexdigest(), shown(x[4]), shown(chain), likeness(x[4], chain), likeness(x[4], y[4])
        held[:] = full[-1:]

    for batch in batches:
        news = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        at, out = 0, []
        for texts in grouped([r[3] for r in news]):
            out.extend(rows(news[at : at + len(texts)]))
            at += len(texts)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), OUT.types, strict=True)], schema=OUT)
    slim()


def in_parts(docs: DataFrame, parts: int) -> DataFrame:
    """(part, guest, doc_id, h, text) of ``docs`` (doc_id, text): ranges of descending ids, and after each the first row of the next as a guest.

    Ranges follow from quantiles of the ids; a row for each range goes to the driver and back."""
    number = F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.7e308))
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumns({"h": F.xxhash64("text"), "number": number})
    cuts = own.select(F.percentile_approx("number", [i / parts for i in range(1, parts)] or [0.5], 10 * parts).alias("c")).first()["c"]
    splits = [-float("inf"), *(sorted(set(cuts or [])) or [0.0]), float("inf")]
    own = Bucketizer(splits=splits, inputCol="number", outputCol="bucket").transform(own).withColumn("part", (F.lit(len(splits)) - F.col("bucket")).cast("int"))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", F.bitwise_not(F.col("h")).alias("h"))
    firsts = sorted((r["part"], r["top"]["doc_id"], ~r["top"]["h"]) for r in own.select("part", "doc_id", "h").groupBy("part").agg(F.max(order).alias("top")).collect())
    guests = [(firsts[i - 1][0], d, h) for i, (_, d, h) in enumerate(firsts)]  # the first goes to the last part
    guests = docs.sparkSession.createDataFrame(guests, "to int, g_id long, g_h long")
    met = own.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("h") == F.col("g_h")))
    met = met.groupBy("to", "doc_id", "h").agg(F.first("text").alias("text")).select(F.col("to").alias("part"), F.lit(True).alias("guest"), "doc_id", "h", "text")
    return own.select("part", F.lit(False).alias("guest"), "doc_id", "h", "text").unionByName(met)


def digested(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """OUT of ``docs`` (doc_id, text): fingerprints of each text and of the text edited with the next document, and how near they are."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranks = ranks_of_classes(docs.where("text <> ''").select(F.col("text").cast("string").cast("binary").alias("text")))
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = in_parts(docs, parts).repartition(parts, "part").sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), "h").select("part", "guest", "doc_id", "text")
    kinds = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}
    return dealt.mapInArrow(lambda batches: compared(batches, ranks), ", ".join(f"{f.name} {kinds[f.type]}" for f in OUT))


def op11_improbable_digest(spark, sf_dir: str) -> DataFrame:
    return digested(documents(spark, sf_dir).select("doc_id", "text"))
