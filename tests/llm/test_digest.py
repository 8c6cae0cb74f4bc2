"""The improbable-feature digest against one written out window by window, and on odd tables."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbiterq.llm import improbable_digest as D


def naive_classes(x):
    return [sum(int(D.TERMS[n]) for n in Counter(x[i : i + D.WINDOW]).values()) >> D.SHIFT for i in range(len(x) - D.WINDOW + 1)]


def naive_fingerprint(x, rank):
    own, points = [rank[c] for c in naive_classes(x)], Counter()
    runs = [range(i, i + D.RUN) for i in range(len(own) - D.RUN + 1)] or ([range(len(own))] if own else [])
    for run in runs:
        points[min(run, key=lambda i: (own[i], i))] += 1
    features = [x[i : i + D.WINDOW] for i in sorted(points) if points[i] >= min(D.POINTS, len(runs))]
    if 0 < len(x) < D.SHORT:
        features += [x[i : i + D.SMALL] for i in range(max(1, len(x) - D.SMALL + 1))]
    chain = []
    for f in features:
        h = hashlib.sha1(f).digest()
        if chain and h in chain[-1]:
            continue
        if not chain or len(chain[-1]) == D.FULL:
            chain.append({})
        chain[-1][h] = {int.from_bytes(h[4 * i : 4 * i + 4]) % D.BITS for i in range(D.HASHES)}
    return [set().union(*c.values()) for c in chain]


def naive_likeness(a, b):
    if a == b or not a or not b:
        return float(a == b)
    a, b = (a, b) if len(a) <= len(b) else (b, a)

    def score(x, y):
        most, chance = min(len(x), len(y)), len(x) * len(y) / D.BITS
        least = min(chance + max(D.MARGIN * (most - chance), 2 * chance**0.5), most - 0.5)
        return min(1, max(0, (len(x & y) - least) / (most - least)))

    return sum(len(x) * max(score(x, y) for y in b) for x in a) / sum(map(len, a))


def bits_of(fingerprint):
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, D.BITS // 8)
    return [set(np.flatnonzero(np.unpackbits(r)).tolist()) for r in raw]


def prose(rng, n):
    return " ".join("".join(rng.choice("aeinorstdlé一") for _ in range(rng.randrange(1, 9))) for _ in range(n))


@pytest.mark.parametrize("parts", [1, 4])
def test_equals_window_by_window(spark, parts, monkeypatch):
    monkeypatch.setattr(D, "PIECE", 700 if parts > 1 else D.PIECE)
    rng = random.Random(parts)
    texts = [prose(rng, rng.choice((0, 1, 3, 10, 30, 100, 400))) for _ in range(40)] + ["", "a", "x" * 300, "short text", prose(rng, 3000)]
    texts += [texts[5], texts[7], None]
    rows = list(zip(rng.sample(range(-500, 500), len(texts)), texts, strict=True))
    got = {r["doc_id"]: r for r in D.digested(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int").repartition(3), parts).collect()}
    rows = [(i, t or "") for i, t in sorted(rows, reverse=True)]
    counts = Counter(c for _, t in rows for c in naive_classes(t.encode()))
    rank = {c: k for k, c in enumerate(sorted(counts, key=lambda c: (counts[c], c)))}
    rank |= {c: len(rank) for c in range(D.CLASSES) if c not in rank}  # only in edited texts
    prints = {i: naive_fingerprint(t.encode(), rank) for i, t in rows}
    assert len(got) == len(rows)
    unseen = 0
    for (i, t), (j, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        new = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert bits_of(r["fingerprint"]) == prints[i]
        assert abs(r["near_next"] - naive_likeness(prints[i], prints[j])) < 1e-6
        if set(naive_classes(new.encode())) <= set(counts):
            assert bits_of(r["edited_fingerprint"]) == (own := naive_fingerprint(new.encode(), rank))
            assert abs(r["near_edited"] - naive_likeness(prints[i], own)) < 1e-6
        else:
            unseen += 1
    assert unseen < 10


def test_edited_is_near_and_next_is_not(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randrange(8, 500))) for i in range(200)]
    got = D.digested(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert np.quantile([r["near_edited"] for r in got], 0.02) > 0.3 and np.median([r["near_edited"] for r in got]) > 0.55
    assert np.quantile([r["near_next"] for r in got], 0.98) < 0.1


def test_odd_tables(spark, odd, nothing):
    assert D.digested(nothing.select("doc_id", "text")).collect() == []
    got = D.digested(odd).collect()
    assert len(got) == odd.count() and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    fives = [r for r in got if r["doc_id"] == 5]
    assert sorted(r["near_next"] == 1.0 for r in fives) == [False, True] and len({r["fingerprint"] for r in fives}) == 1
    one = D.digested(odd.where("doc_id = 4"), 3).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    null = [r for r in got if r["doc_id"] is None]  # comes last, so the first follows it
    assert len(null) == 1 and null[0]["near_next"] < 0.2
    many = D.digested(odd.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert len(many) == odd.count()


def test_likeness_of_chains():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (5, D.BITS // 8), dtype=np.uint8)
    assert D.likeness(a, a) == 1.0 and D.likeness(a, a[1:]) > 0.99 and D.likeness(a[:0], a) == 0.0 and D.likeness(a[:0], a[:0]) == 1.0
    assert np.array_equal(D.chain_of(D.shown(a)), a)
