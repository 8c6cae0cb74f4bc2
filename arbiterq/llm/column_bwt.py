"""Removal of every byte that a repeated 400-byte string covers, by column-wise construction of a multi-document BWT.

Inserting one symbol a round into the transform of whole documents takes as many rounds as the longest document has bytes, and each
round rereads all that the rounds before made. Three steps make it bounded without losing a match:

1. Anchors. Of each ``passage``-byte string (250), the leftmost least hash among its 32-byte windows is its anchor. Equal strings have
   equal anchors at equal offsets, so only strings whose anchor recurs can recur. The strings of one anchor are consecutive
   starts; the bytes that they and their continuations to ``length`` bytes cover are a piece of bounded size. Equal pieces are one
   piece with a multiplicity.
2. Rounds. The pieces are aligned at their anchors and dealt by the anchor's hash. Column by column from the right, each piece
   inserts one symbol: the ranks of all pieces' suffixes (the collection's transform, by column) follow from the ranks of the round
   before by one stable pass over the symbols, and the common prefixes of neighbours by the least of those they passed. A bucket's
   columns are a file in the shared folder, written once and read once, in the order of the rounds, by the same task; ranks and common
   prefixes of the round, a few bytes a piece, stay in memory. A bucket is bounded, so it is an in-memory construction: no transform is written. A suffix that shares ``length`` bytes with a neighbour recurs; one that shares
   ``passage`` bytes begins a repeated passage.
3. The recurring starts go back to all places of their pieces; each document loses the union of what those of ``length`` cover.
   Passages too short to be removed (50 words are some 300 bytes) are reported beside: ``n_passages`` and ``n_passage_bytes``.

Pieces of an anchor that has more than ``MOST_PIECES`` different ones don't go to one task: their strings' digests are
counted by a grouping instead, which is exact as well and spreads over all tasks.

Defined results: a null text is empty; texts shorter than ``passage`` have no repeats and those shorter than ``length`` lose nothing; equal
rows (id and text) each count as an occurrence, at the cost of a piece each before pieces are made distinct, and lose the same bytes; matches never cross texts; rows without an id are treated like
others; an empty table gives no row; very long texts are cut into pieces like others; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, dropped, forget, scratch, short_batches, written

LENGTH, PASSAGE, PASSAGE_WORDS, WINDOW, BUCKET, MOST_PIECES = 400, 250, 50, 32, 20_000, 100_000
#: Ids that may be sent to every executor, 16 bytes each.
MOST_SENT = 1_000_000
ODD = 0x9E3779B97F4A7C15
PLACE = "id long, key long, start int, anchor int, n int, h long, c long"


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Hashes of all windows of a text, by a polynomial modulo 2^64."""

    def __init__(self) -> None:
        self.up, self.down = powers(ODD, 1024), powers(pow(ODD, -1, 1 << 64), 1024)

    def __call__(self, b: bytes, width: int) -> np.ndarray:
        if len(b) > len(self.up):
            n = 2 * len(b)
            self.up, self.down = powers(ODD, n), powers(pow(ODD, -1, 1 << 64), n)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((np.frombuffer(b, np.uint8).astype(np.uint64) + np.uint64(1)) * self.up[: len(b)], out=sums[1:])
        h = (sums[width:] - sums[:-width]) * self.down[: len(b) - width + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x7FB5D329728EA185)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))


def least_of_windows(h: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive numbers, by minima up to and from the multiples of w."""
    n = len(h) - w + 1
    full = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max)
    full[: len(h)] = h
    rows = full.reshape(-1, w)
    upto, since = np.minimum.accumulate(rows, axis=1).ravel(), np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(since[:n], upto[w - 1 : w - 1 + n])


def pieces(b: bytes, hashes: Hashes, length: int = PASSAGE, width: int = WINDOW) -> Iterator[tuple[int, int, int, int]]:
    """(first start, anchor, number of starts, anchor's hash): the starts of b's ``length``-byte strings, by anchor."""
    if len(b) < length:
        return
    w = length - width + 1
    h = hashes(b, width)
    least = least_of_windows(h, w)
    edges = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1, [len(least)])).tolist()
    for s, e in zip(edges, edges[1:], strict=False):
        v = least[s]
        for p in (s + np.flatnonzero(h[s : e - 1 + w] == v)).tolist():
            if s >= e:
                break
            last = min(p, e - 1)
            if last >= s:
                yield s, p, last - s + 1, int(v)
                s = last + 1


def digest(b: bytes) -> int:
    """64 bits, to be taken together with the 64 of the anchor's hash."""
    return int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little", signed=True)


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def own_rows(df: DataFrame, id_col: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(t).alias("key"), t.alias("text"))


def places(rows: DataFrame, length: int, passage: int) -> DataFrame:
    """A row for each piece of each text; c tells pieces of one anchor apart by all their bytes."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for part in parts:
            out = []
            for i, key, t in zip(part["id"].tolist(), part["key"].tolist(), part["text"].tolist(), strict=True):
                b = t.encode("utf-8", "surrogatepass")
                i = None if i is None or i != i else int(i)
                out += [(i, key, s, p, n, signed(v), digest(b[s : s + n - 1 + length])) for s, p, n, v in pieces(b, hashes, passage)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PLACE.split(", ")]).astype({"id": "Int64"})

    return rows.mapInPandas(run, PLACE)


def recurring(before: np.ndarray, group: np.ndarray, many: np.ndarray, n: np.ndarray, total: np.ndarray, columns: Iterator[np.ndarray], least: tuple[int, ...]) -> list[np.ndarray]:
    """For each of the lengths ``least``: for each piece (row) and each of its starts (column), whether the string there recurs.

    before: bytes of a piece before its anchor; group: an anchor's number, below 2^16; many: whether a piece has a
    multiplicity; n, total: its starts and bytes; columns: from the last to the first, a byte of each piece, 255 where it has none.
    """
    m, deep = len(before), int(before.max())
    order = np.argsort(group, kind="stable")
    common = np.zeros(m + 1, np.int16)  # of order[i - 1] and order[i]; 0 at both ends
    out = [np.zeros((m, int(n.max())), bool) for _ in least]
    for col, symbols in columns:
        own = symbols[order]
        by_symbol = np.argsort(own, kind="stable")
        by_group = np.argsort(group[order[by_symbol]], kind="stable")
        moved = by_symbol[by_group]  # new place -> old place
        place = moved[1:]
        same = (own[moved[1:]] == own[moved[:-1]]) & (group[order[moved[1:]]] == group[order[moved[:-1]]]) & (own[moved[1:]] != 255)
        fresh = np.zeros(m + 1, np.int16)
        if at := np.flatnonzero(same).tolist():
            at = np.array(at)
            pairs = np.empty(2 * len(at), np.int64)
            pairs[0::2], pairs[1::2] = moved[at] + 1, place[at] + 1
            fresh[at + 1] = np.minimum.reduceat(common, pairs)[0::2] + 1  # the ends stay inside: common has m + 1 numbers
        order, common = order[moved], fresh
        start = before[order] - deep + col  # the start within the piece, where it is one
        asked = (start >= 0) & (start < n[order])
        shared = np.where(many[order], total[order] - start, np.maximum(common[:-1], common[1:]))
        for k, enough in enumerate(least):
            hit = asked & (shared >= enough)
            out[k][order[hit], start[hit]] = True
    return out


class Columns:
    """The columns of aligned pieces as a file in the shared folder: written from the last column to the first, and read in that order."""

    def __init__(self, folder: str, body: list[bytes], before: np.ndarray) -> None:
        from pyarrow import fs

        self.files, base = fs.FileSystem.from_uri(folder)
        self.path, self.rows, deep = f"{base}/{uuid.uuid4().hex}", len(body), int(before.max())
        self.width = deep + max(len(b) - a for b, a in zip(body, before.tolist(), strict=True))
        self.files.create_dir(base, recursive=True)
        flat = np.full((len(body), self.width), 255, np.uint8)  # BUCKET pieces of bounded size
        for k, b in enumerate(body):
            flat[k, deep - before[k] : deep - before[k] + len(b)] = np.frombuffer(b, np.uint8)
        with self.files.open_output_stream(self.path) as to:
            for high in range(self.width, 0, -64):
                to.write(np.ascontiguousarray(flat[:, max(0, high - 64) : high].T[::-1]).tobytes())

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        with self.files.open_input_stream(self.path, buffer_size=1 << 20) as own:
            for col in range(self.width - 1, -1, -1):
                yield col, np.frombuffer(own.read(self.rows), np.uint8)
        self.files.delete_file(self.path)


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of true."""
    d = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    return list(zip(np.flatnonzero(d == 1).tolist(), (np.flatnonzero(d == -1) - 1).tolist(), strict=True))


def in_rounds(part: pd.DataFrame, least: tuple[int, ...], folder: str) -> list[tuple[int, int, int, int, int]]:
    """(h, c, first, last, least) of each run of recurring starts among the pieces of a bucket."""
    body = part["body"].tolist()
    anchor = (part["anchor"] - part["start"]).to_numpy(np.int64)
    n, total = part["n"].to_numpy(np.int64), np.array([len(b) for b in body], np.int64)
    numbers = np.unique(part["h"].to_numpy(np.int64), return_inverse=True)[1]
    out = []
    h, c, many = part["h"].tolist(), part["c"].tolist(), part["many"].to_numpy(bool)
    for first in range(0, int(numbers.max()) + 1, 60_000):
        rows = np.flatnonzero((numbers >= first) & (numbers < first + 60_000))
        columns = Columns(folder, [body[r] for r in rows.tolist()], anchor[rows])
        found = recurring(anchor[rows], (numbers[rows] - first).astype(np.uint16), many[rows], n[rows], total[rows], columns, least)
        for enough, hits in zip(least, found, strict=True):
            for k in np.flatnonzero(hits.any(axis=1)).tolist():
                out += [(h[rows[k]], c[rows[k]], x, y, enough) for x, y in runs(hits[k])]
    return out


def bodies(distinct: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """``distinct`` pieces with their bytes, read from one place each; equal rows of documents each give the piece."""
    wanted = distinct.groupBy("id", "key").agg(F.collect_list(F.struct("h", "c", "many", "start", "anchor", "n")).alias("ps"))
    wanted = written(wanted.select(F.col("id").alias("wid"), F.col("key").alias("wkey"), "ps"), "wanted")
    texts, keys = rows, wanted.select("wkey").distinct()
    if keys.limit(MOST_SENT + 1).count() <= MOST_SENT:
        texts = texts.join(F.broadcast(keys), F.col("key") == F.col("wkey"), "left_semi")
    both = texts.join(wanted, (F.col("key") == F.col("wkey")) & F.col("id").eqNullSafe(F.col("wid"))).select("text", "ps")

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for t, ps in zip(part["text"].tolist(), part["ps"].tolist(), strict=True):
                b = t.encode("utf-8", "surrogatepass")
                out += [(*(p[c] for c in ("h", "c", "many", "start", "anchor", "n")), b[p["start"] : p["start"] + p["n"] - 1 + length]) for p in ps]
            yield pd.DataFrame(out, columns=["h", "c", "many", "start", "anchor", "n", "body"])

    return both.mapInPandas(cut, "h long, c long, many boolean, start int, anchor int, n int, body binary")


def recurring_runs(df: DataFrame, id_col: str, text: str, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """(id, key, spans): spans (from, to, least) that recurring strings of ``length`` and of ``passage`` bytes cover, of each text that has any;
    least tells which, and they may overlap."""
    spark = df.sparkSession
    short_batches(spark)
    least, folder = tuple(sorted({length, passage})), scratch(spark, "columns")
    rows = own_rows(df, id_col, text)
    all_places = written(places(rows, length, least[0]), "places")
    often = all_places.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h")
    few = often.limit(2 * MOST_SENT + 1).count() <= 2 * MOST_SENT
    maybe = written(all_places.join(F.broadcast(often) if few else often, "h", "left_semi"), "maybe")
    forget(all_places)
    distinct = maybe.groupBy("h", "c").agg((F.count("*") > 1).alias("many"), F.min(F.struct("id", "key", "start", "anchor", "n")).alias("at"))
    distinct = written(distinct.select("h", "c", "many", "at.*"), "distinct")
    crowded = distinct.groupBy("h").count().where(F.col("count") > MOST_PIECES).select("h")
    crowded = written(crowded, "crowded")
    any_crowded = crowded.limit(1).count() > 0
    full = bodies(distinct, rows, length)
    buckets = max(1, math.ceil(distinct.count() / BUCKET))
    calm = full.join(crowded, "h", "left_anti") if any_crowded else full

    def link(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(in_rounds(part.drop_duplicates(["h", "c"]), least, folder), columns=["h", "c", "first", "last", "least"])

    schema = "h long, c long, first int, last int, least int"
    found = calm.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets))).groupBy("bucket").applyInPandas(link, schema)
    if any_crowded:

        def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for h, c, many, n, body in zip(*(part[x].tolist() for x in ("h", "c", "many", "n", "body")), strict=True):
                    for enough in least:
                        ds = [digest(body[s : s + enough]) for s in range(min(n, len(body) - enough + 1))]
                        yield pd.DataFrame({"h": h, "c": c, "first": np.arange(len(ds), dtype=np.int32), "least": np.int32(enough), "w": 2 if many else 1, "d": np.array(ds, np.int64)})

        strings = full.join(crowded, "h", "left_semi").dropDuplicates(["h", "c"]).mapInPandas(each, "h long, c long, first int, least int, w long, d long")
        strings = written(strings, "strings")
        twice = strings.groupBy("h", "least", "d").agg(F.sum("w").alias("w")).where("w > 1").select("h", "least", "d")
        found = found.unionByName(strings.join(twice, ["h", "least", "d"], "left_semi").select("h", "c", "first", F.col("first").alias("last"), "least"))
    found = written(found, "found")
    forget(distinct)
    dropped(spark, folder)
    spans = maybe.select("id", "key", "start", "h", "c").join(found, ["h", "c"])
    span = F.struct((F.col("start") + F.col("first")).alias("from"), (F.col("start") + F.col("last") + F.col("least")).alias("to"), "least")
    return spans.groupBy("id", "key").agg(F.collect_set(span).alias("spans"))


def merged(spans) -> list[tuple[int, int]]:
    """Maximal runs of the union."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def deduped(df: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, passage: int = PASSAGE, words: int = PASSAGE_WORDS) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, n_passages, n_passage_bytes): a row for each row of ``df``; kept: the bytes that are left;
    passages: maximal runs of recurring ``passage``-byte strings that have at least so many words, and their bytes, removed or not."""
    rows = own_rows(df, id_col, text)
    gone = recurring_runs(df, id_col, text, length, passage).select(F.col("id").alias("gid"), F.col("key").alias("gkey"), "spans")
    both = rows.join(gone, (F.col("key") == F.col("gkey")) & F.col("id").eqNullSafe(F.col("gid")), "left").select("id", "text", "spans")
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept", "n_passages", "n_passage_bytes"]

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for t, spans in zip(part["text"].tolist(), part["spans"].tolist(), strict=True):
                b, kept, at, removed = t.encode("utf-8", "surrogatepass"), [], 0, 0
                every = [(s["from"], s["to"], s["least"]) for s in spans] if spans is not None else []
                union = merged((x, y) for x, y, k in every if k == length)
                for x, y in union:
                    kept.append(b[at:x])
                    removed += y - x
                    at = y
                kept.append(b[at:])
                said = [y - x for x, y in merged((x, y) for x, y, k in every if k == passage) if len(b[x:y].split()) >= words]
                out.append((len(b), removed, len(union), b"".join(kept), len(said), sum(said)))
            yield pd.DataFrame(out, columns=names[1:]).assign(id=part["id"].astype("Int64").to_numpy())[names]

    return both.mapInPandas(cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary, n_passages long, n_passage_bytes long")


def op3_column_bwt(spark, sf_dir: str) -> DataFrame:
    found = deduped(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", "n_passage_bytes")
