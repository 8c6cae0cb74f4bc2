"""Repeats of 400 bytes are removed, passages of over 50 words are found whatever their bytes; both against brute force."""

import random
from collections import Counter

from pyspark.sql import functions as F

from arbiterq.llm import column_bwt

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def prose(rng, n, low=2, high=9):
    return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randrange(low, high))) for _ in range(n))


def covered(texts, length):
    seen = Counter(t[s : s + length] for t in texts for s in range(len(t) - length + 1))
    out = []
    for t in texts:
        cov = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                cov[s : s + length] = b"\1" * length
        out.append(cov)
    return out


def runs(cov):
    return [len(x) for x in bytes(cov).split(b"\0") if x]


def test_planted_passages(spark):
    """Passages of 51 to 80 words, of 250 bytes and more, in three documents each: every one is found, and no clean document."""
    rng = random.Random(21)
    passages = [p for p in (prose(rng, rng.randrange(51, 81), 3, 9) for _ in range(12)) if len(p) >= 250]
    texts = [prose(rng, rng.randrange(30, 200)) + " " + p + " " + prose(rng, rng.randrange(5, 90)) for p in passages for _ in range(3)]
    clean = [prose(rng, rng.randrange(1, 300)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts + clean)), "doc_id long, text string")
    got = {r["id"]: r for r in column_bwt.deduped(df).collect()}
    everything = [t.encode() for t in texts + clean]
    for i, (long_, short) in enumerate(zip(covered(everything, 400), covered(everything, 250), strict=True)):
        assert (got[i]["n_removed"], got[i]["n_spans"], got[i]["n_passage_bytes"]) == (sum(long_), len(runs(long_)), sum(runs(short))), i
        assert got[i]["n_passages"] == (i < len(texts)) and bytes(got[i]["kept"]) == bytes(b for b, c in zip(everything[i], long_, strict=True) if not c)
    assert {len(p) < 400 for p in passages} == {True, False}  # some are too short to be removed


def test_both_lengths_by_digests_and_in_rounds(spark, monkeypatch):
    rng = random.Random(22)
    a, b = prose(rng, 60), prose(rng, 40)
    texts = [prose(rng, 20) + a + prose(rng, 9), a + b, b + a[:150] + b, "xy" * 300, a[40:], b[7:] + prose(rng, 5), *[a[k:] + prose(rng, 4) for k in range(0, 60, 9)]]
    texts += [texts[1], ""]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string").withColumn("h", F.lit(1))
    everything = [t.encode() for t in texts]
    want = [(sum(x), sum(runs(y))) for x, y in zip(covered(everything, 110), covered(everything, 60), strict=True)]
    for most in (100_000, 2):
        monkeypatch.setattr(column_bwt, "MOST_PIECES", most)
        got = {r["id"]: (r["n_removed"], r["n_passage_bytes"]) for r in column_bwt.deduped(df, length=110, passage=60, words=0).collect()}
        assert [got[i] for i in range(len(texts))] == want and got[99] == (0, 0)
