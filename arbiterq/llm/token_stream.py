"""Token ids as Arrow IPC stream files with batches of fixed-size lists.

A shard file holds the ids of a range of documents, in ascending doc_id order, cut into sequences of equal length: column
``ids`` is fixed_size_list[length] of uint16, or of uint32 where the vocabulary needs it, column ``mask`` is fixed_size_list<bool>[length]
(false only in the padding at the end of the shard). Every batch has the same number of rows but the last, so a sequence is found by arithmetic and read without a
copy from a memory map where the files are local (or mounted); from any other store a sequence's batch is read into memory. Beside it, ``NNNNN.docs.arrow`` has a row a document: doc_id, start in the shard, number of ids.

Files go to a folder that driver and executors share, through pyarrow's file systems, first under a name of the attempt and
then by a rename: a task that runs twice leaves one whole file.

A shard is a range of (doc_id, slice): a slice is one of SLICES classes of the text's hash, so that an id which a large part of all
rows shares, null included, still spreads over shards and tasks. Shards hold about ``shard_bytes`` of text each, more only where the
corpus would need over MOST_SHARDS of them; their bounds are the one thing that goes to the driver and to every task (16 MB at most).
Shards go to tasks by number, so tasks are as even as shards.

Defined results: null and empty texts are the end id alone; documents without an id come first; repeated rows are written
each, in an order that depends on their texts alone; an empty table gives no file and no row; very long texts are encoded whole (a
document may be larger than a shard's aim, but never leaves its shard); only the two named columns are read.
"""

from __future__ import annotations

import json
import math
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, forget, scratch, short_batches, written

LENGTH, BATCH, END, SHARD_BYTES, MOST_CACHED = 2048, 64, 2, 24 << 20, 1_000_000
MOST_SHARDS, MOST_TASKS, SLICES = 1_000_000, 50_000, 4096


#: Words whose lower case and composition no library disputes: Latin letters, then ASCII marks (no apostrophe, which may begin a contraction).
SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@[-`{-~]*)")


#: The steps before a tokenizer's merges for which the chunk rule of ``Encoder`` holds, as its file writes them.
CHUNK_RULE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class Encoder:
    """Ids of whole texts as bytes of the narrowest unsigned type that holds the vocabulary; equal to ``encode(text).ids``.

    A tokenizer with the steps of CHUNK_RULE drops white space and never merges across it, nor between letters and marks. So a text's
    ids are those of its chunks between ASCII white space, and a simple chunk's are those of its lower-cased word and of its marks. Both
    levels are remembered as long as a worker process lives; each forgets all when it is full. Any other tokenizer encodes whole texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.own, self.seen, self.parts = Tokenizer.from_file(path), {}, {}
        self.kind = np.dtype("<u2" if self.own.get_vocab_size() <= 1 << 16 else "<u4")
        file = json.loads(self.own.to_str())
        blank = any(set(t["content"]) & set(" \t\n\x0b\x0c\r") for t in file.get("added_tokens") or ())
        suffix = file["model"].get("end_of_word_suffix")
        self.by_chunks = not blank and bool(suffix) and all(file.get(k) == v for k, v in CHUNK_RULE.items())
        self.ends = np.zeros(self.own.get_vocab_size(), bool)  # tokens that end a word
        for token, i in self.own.get_vocab().items() if self.by_chunks else ():
            self.ends[i] = token.endswith(suffix)

    def whole(self, texts: list[str | None]) -> Iterator[bytes]:
        for at in range(0, len(texts), 32):
            for e in self.own.encode_batch_fast([t or "" for t in texts[at : at + 32]], add_special_tokens=False):
                yield np.array(e.ids, self.kind).tobytes()

    def learn(self, chunks: set[bytes]) -> None:
        if len(self.parts) > MOST_CACHED:
            self.parts.clear()
        parts, cut, simple, others, whole = self.parts, [], set(), set(), SIMPLE.fullmatch
        for c in chunks:
            t = c.decode()
            if m := whole(t):
                w, marks = m.groups()
                w = w.lower()
                cut.append((c, w, marks))
                simple.add(w)
                if marks:
                    simple.add(marks)
            else:
                cut.append((c, t, ""))
                others.add(t)
        self.words([p for p in simple if p not in parts])
        self.each([p for p in others if p not in parts])
        parts[""] = b""
        seen = self.seen
        for c, w, marks in cut:
            seen[c] = parts[w] + parts[marks] if marks else parts[w]

    def each(self, new: list[str]) -> None:
        for at in range(0, len(new), 4096):
            for p, e in zip(new[at : at + 4096], self.own.encode_batch_fast(new[at : at + 4096], add_special_tokens=False), strict=True):
                self.parts[p] = np.array(e.ids, self.kind).tobytes()

    def words(self, new: list[str]) -> None:
        """Parts of one word each, many in one text: a word ends with the first token that ends one."""
        for at in range(0, len(new), 4096):
            own = new[at : at + 4096]
            ids = np.array(self.own.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, self.kind)
            ends = (np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize
            if len(ends) != len(own):
                self.each(own)
                continue
            raw, start = ids.tobytes(), 0
            for p, end in zip(own, ends.tolist(), strict=True):
                self.parts[p] = raw[start:end]
                start = end

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text. The new chunks of some texts are learnt at once."""
        if not self.by_chunks:
            yield from self.whole(texts)
            return
        for at in range(0, len(texts), 32):
            cut = [(t or "").encode("utf-8", "replace").split() for t in texts[at : at + 32]]
            if len(self.seen) > MOST_CACHED:
                self.seen.clear()
            if new := set().union(*cut).difference(self.seen):
                self.learn(new)
            own = self.seen.__getitem__
            for chunks in cut:
                yield b"".join(map(own, chunks))


ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a worker process; its thread pool is off, since each core has a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def put(folder: str, name: str, write) -> None:
    """Write a file under another name, then rename it."""
    files, base = store(folder)
    files.create_dir(base, recursive=True)
    attempt = f"{base}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(attempt) as out:
        write(out)
    files.move(attempt, f"{base}/{name}")


def fixed(values: np.ndarray, kind: pa.DataType, length: int) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values, kind), length)


class ShardWriter:
    """Appends documents; holds one batch of sequences at most."""

    def __init__(self, out, length: int, batch: int, kind: np.dtype) -> None:
        self.length, self.size, self.kind = length, length * batch, kind
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.to, self.held, self.bytes = pa.ipc.new_stream(out, self.schema), [], 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.bytes += len(ids)
        if self.bytes >= self.kind.itemsize * self.size:
            flat = np.frombuffer(b"".join(self.held), self.kind)
            full = len(flat) // self.size * self.size
            for at in range(0, full, self.size):
                self.write(flat[at : at + self.size], self.size)
            self.held = [flat[full:].tobytes()]
            self.bytes = len(self.held[0])

    def write(self, ids: np.ndarray, size: int) -> None:
        padded, mask = np.zeros(size, self.kind), np.zeros(size, bool)
        padded[: len(ids)], mask[: len(ids)] = ids, True
        self.to.write_batch(pa.record_batch([fixed(padded, pa.from_numpy_dtype(self.kind), self.length), fixed(mask, pa.bool_(), self.length)], schema=self.schema))

    def close(self) -> None:
        if self.bytes:
            flat = np.frombuffer(b"".join(self.held), self.kind)
            self.write(flat, -(-len(flat) // self.length) * self.length)
        self.to.close()


def placing(id_: Column, text: Column) -> tuple[Column, Column]:
    """(id, slice): the order of the documents before that of the texts themselves; a null id comes before all others."""
    return F.coalesce(id_, F.lit(-(1 << 63))).alias("id"), F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(SLICES)).alias("slice")


def bounds(own: DataFrame, shard_bytes: int) -> np.ndarray:
    """[id, slice] rows: the first place of each shard but the first, from a pass over ids, hashes and lengths; MOST_SHARDS rows at most."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    sizes = own.select(*placing(F.col("id"), F.col("text")), size.alias("b")).groupBy("id", "slice").agg(F.sum("b").alias("b"))
    parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(sizes.repartitionByRange(parts, "id", "slice").withColumn("part", F.spark_partition_id()), "sizes")
    totals = ranged.groupBy("part").agg(F.sum("b").alias("t"))  # a row a partition
    before = totals.select(F.col("part").alias("p"), F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    aim = max(shard_bytes, math.ceil((totals.agg(F.sum("t")).first()[0] or 0) / MOST_SHARDS))
    within = Window.partitionBy("part").orderBy("id", "slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.withColumn("own", F.coalesce(F.sum("b").over(within), F.lit(0))).join(before, F.col("part") == F.col("p"))
    least = starts.groupBy(F.floor((F.col("own") + F.col("before")) / aim).alias("shard")).agg(F.min(F.struct("id", "slice")).alias("at"))
    got = least.select("at.*").toPandas().sort_values(["id", "slice"]).to_numpy(np.int64).reshape(-1, 2)[1:]
    forget(ranged)
    return got


def shard_of(first: np.ndarray, ids: np.ndarray, slices: np.ndarray) -> np.ndarray:
    """The number of the shard of each (id, slice)."""
    low, out = np.searchsorted(first[:, 0], ids, side="left"), np.searchsorted(first[:, 0], ids, side="right")
    for i in np.flatnonzero(low < out).tolist():  # an id at which shards begin
        out[i] = low[i] + np.searchsorted(first[low[i] : out[i], 1], slices[i], side="right")
    return out


def write_stream(df: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text: str = "text", *, length: int = LENGTH, batch: int = BATCH, end: int = END, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards and gives their manifest: (shard, start, n_docs, n_ids); start: ids of all shards before."""
    short_batches(df.sparkSession)
    own = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    sent = df.sparkSession.sparkContext.broadcast(bounds(own, shard_bytes))
    shards = len(sent.value) + 1

    @F.pandas_udf("int")
    def place(ids: pd.Series, slices: pd.Series) -> pd.Series:
        return pd.Series(shard_of(sent.value, ids.to_numpy(np.int64), slices.to_numpy(np.int64)).astype(np.int32))

    at, part = placing(F.col("id"), F.col("text"))
    placed = own.withColumn("slice", part).withColumn("shard", place(at, F.col("slice")))
    placed = placed.repartitionById(min(shards, MOST_TASKS), F.col("shard")).sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "slice", F.col("text").asc_nulls_first()).select("shard", "id", "text")

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        final, wide = b"" if end is None else np.array([end], encode.kind).tobytes(), encode.kind.itemsize
        rows = ((s, i, ids) for p in parts for s, i, ids in zip(p["shard"].tolist(), p["id"].tolist(), encode(p["text"].tolist()), strict=True))
        row = next(rows, None)
        while row is not None:
            shard, docs, at = row[0], [], 0

            def fill(out, shard=shard):
                nonlocal row, at
                to = ShardWriter(out, length, batch, encode.kind)
                while row is not None and row[0] == shard:
                    ids = row[2] + final
                    to.add(ids)
                    docs.append((row[1], at, len(ids) // wide))
                    at += len(ids) // wide
                    row = next(rows, None)
                to.close()

            put(folder, f"{shard:08d}.arrow", fill)
            table = pa.table({"doc_id": pa.array([None if d[0] is None or d[0] != d[0] else int(d[0]) for d in docs], pa.int64()), "start": pa.array([d[1] for d in docs], pa.int64()), "n_tokens": pa.array([d[2] for d in docs], pa.int64())})

            def index(out, table=table):
                with pa.ipc.new_stream(out, table.schema) as to:
                    to.write_table(table)

            put(folder, f"{shard:08d}.docs.arrow", index)
            yield pd.DataFrame({"shard": [shard], "n_docs": [len(docs)], "n_ids": [at]})

    done = written(placed.mapInPandas(write, "shard long, n_docs long, n_ids long"), "manifest")
    # a row a shard, MOST_SHARDS at most
    start = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return done.withColumn("start", start).select("shard", "start", "n_docs", "n_ids")


class Shard:
    """Random access to a shard file."""

    def __init__(self, folder: str, shard: int) -> None:
        files, base = store(folder)
        path = f"{base}/{shard:08d}.arrow"
        if type(files).__name__ == "LocalFileSystem":
            self.file = pa.memory_map(path)
        else:
            self.file = files.open_input_file(path)
        self.batches = list(pa.ipc.open_stream(self.file))
        self.rows = self.batches[0].num_rows if self.batches else 1
        self.length = self.batches[0].schema.field("ids").type.list_size if self.batches else 1
        with files.open_input_file(f"{base}/{shard:08d}.docs.arrow") as f:
            self.docs = pa.ipc.open_stream(f).read_all()

    def sequence(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view into the file) and mask of the k-th sequence."""
        b, i = self.batches[k // self.rows], k % self.rows
        return b.column("ids").values.to_numpy(zero_copy_only=True)[i * self.length : (i + 1) * self.length], b.column("mask")[i].values

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from start on; a view into the file where they lie in one batch."""
        out, size = [], self.rows * self.length
        while n > 0:
            flat = self.batches[start // size].column("ids").values.to_numpy(zero_copy_only=True)
            part = flat[start % size : start % size + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out)


def read_stream(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for number, base in zip(part["shard"].tolist(), part["start"].tolist(), strict=True):
                shard = Shard(folder, number)
                start, n = shard.docs["start"].to_pylist(), shard.docs["n_tokens"].to_pylist()
                ids = shard.docs["doc_id"].to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
                crc = [zlib.crc32(shard.ids(a, k).astype("<u4").tobytes()) for a, k in zip(start, n, strict=True)]
                yield pd.DataFrame({"doc_id": ids, "start": np.array(start, np.int64) + base, "n_tokens": np.array(n, np.int64), "ids_crc32": np.array(crc, np.int64)})

    tasks = max(1, min(manifest.count(), MOST_TASKS))
    return manifest.repartitionById(tasks, F.col("shard").cast("int")).mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_stream(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    folder = scratch(spark, "tokens")
    manifest = write_stream(documents(spark, sf_dir), folder, tokenizer or public_tokenizers.path("word_bpe_49k.json"))
    return read_stream(manifest, folder)
