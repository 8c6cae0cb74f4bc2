"""Ids equal the library's, by chunks where the tokenizer allows it and of whole texts where it doesn't; shards are even and in order."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbiterq.llm import token_stream

public = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize(("name", "by_chunks"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_ids_equal_the_library(name, by_chunks):
    from tokenizers import Tokenizer

    rng, path = random.Random(1), public.path(name)
    own, encoder = Tokenizer.from_file(path), token_stream.Encoder(path)
    assert encoder.by_chunks == by_chunks
    ranges = ((32, 127), (0xA0, 0x250), (0x300, 0x370), (0x370, 0x600), (0x4E00, 0x4F00), (0x2000, 0x2070), (0x1F600, 0x1F640), (9, 14), (32, 33))
    texts = ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += ["It's DON'T!! 12a3 ...", "a<|endoftext|> b <|startoftext|>", "", None, "word " * 3000, "naïve?ça İstanbul ΣΑΣ"]
    for _ in range(2):  # the second time from memory
        got = [np.frombuffer(b, encoder.kind).tolist() for b in encoder(texts)]
        assert got == [own.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(token_stream, "MOST_CACHED", 50)
    path, rng = public.path("word_bpe_49k.json"), random.Random(2)
    texts = [" ".join(f"w{rng.randrange(10**6)}x" for _ in range(30)) for _ in range(200)]
    small, large = token_stream.Encoder(path), token_stream.Encoder(path)
    got = list(small(texts))
    monkeypatch.undo()
    assert got == list(large(texts)) and len(small.seen) < 32 * 30 + 51


def test_shards_of_hot_ids(spark, tmp_path):
    """A third of all rows shares an id, another third has none: their shards are cut by the texts' hash, and starts stay in order."""
    path, rng = public.path("word_bpe_49k.json"), random.Random(3)
    texts = [" ".join(rng.choice(("alpha", "beta", "gamma")) + str(rng.randrange(99)) for _ in range(40)) for _ in range(300)]
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = f"file://{tmp_path}/hot"
    manifest = token_stream.write_stream(df, folder, path, shard_bytes=4000)
    sizes = [r["n_docs"] for r in manifest.collect()]
    assert len(sizes) > 10 and max(sizes) < 40 and sum(sizes) == 300
    got = sorted(token_stream.read_stream(manifest, folder).collect(), key=lambda r: r["start"])
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids) and sorted(ids) == sorted(-1 if i is None else i for i, _ in rows)
    again = token_stream.write_stream(df.repartition(3, F.rand(1)), f"{folder}-2", path, shard_bytes=4000)
    assert sorted(map(str, token_stream.read_stream(again, f"{folder}-2").collect())) == sorted(map(str, got))
