"""Long lines, long sentences and ids of many rows: the same results as the plain definitions, in linear time and bounded memory."""

import random
import re
import time
from collections import Counter

import numpy as np

from arbiterq.llm import line_rules, quality_fm, toxicity_cf

PATTERN = re.compile(r"(?:\S+\s*[|»›·•]\s*){3,}|(?:\S+\s+>\s+){2,}")


def test_navigation_equals_the_pattern():
    rng, found = random.Random(1), 0
    for i in range(60_000):
        line = "".join(rng.choice(("|", "·", " ", "a", "b", "> ", ">", " > ", "\t", "| ")) for _ in range(rng.randrange(1, 14)))
        want = PATTERN.search(line) is not None
        assert line_rules.navigation(line) == want, repr(line)
        found += want
    assert 5_000 < found < 55_000


def test_a_long_line_takes_no_second():
    for line in ("x" * 500_000 + "·" + "y" * 500_000, "|" + "a " * 500_000, "a|" + "bc" * 500_000 + " d", " > ".join(["a b"] * 150_000), "a·" * 2 + " " * 1_000_000):
        began = time.process_time()
        line_rules.judge(f"Some words come first, ten of them at the very least here.\n{line}", line_rules.Rules())
        assert time.process_time() - began < 2.5
        began = time.process_time()
        line_rules.navigation(line)
        assert time.process_time() - began < 1


def plain_swaps(sentences):
    stand_in, out = toxicity_cf.others(), Counter()
    for own in sentences:
        for i, w in enumerate(own):
            if other := stand_in.get(w):
                x, y = set(toxicity_cf.slots(own).tolist()), set(toxicity_cf.slots([*own[:i], other, *own[i + 1 :]]).tolist())
                out[tuple(sorted(x - y)), tuple(sorted(y - x))] += 1
    return out


def test_swaps_equal_the_definition_in_linear_time():
    rng = random.Random(2)
    terms = [t.encode() for g in toxicity_cf.GROUPS for t in g]
    kinds = [b"people", b"christianity", b"christi", b"musli", b"xmusli", b"-", b"lesbianas", b"some", b"word"]
    sentences = [[rng.choice(rng.choice((terms[:12], terms, kinds))) for _ in range(rng.randrange(0, 12))] for _ in range(1500)]
    assert toxicity_cf.swaps(sentences) == plain_swaps(sentences)
    long = [rng.choice(rng.choice((terms, kinds))) for _ in range(100_000)]
    stand_in, began = toxicity_cf.others(), time.process_time()
    got = toxicity_cf.swaps([long])
    assert time.process_time() - began < 1
    assert sum(got.values()) == sum(w in stand_in for w in long)


def loss(w, bias, texts, y, weight, neutral, pairs, times, pairing, holding, decay):
    p = lambda z: 1 / (1 + np.exp(-z))
    z = texts @ w + bias
    own = -(weight * (y * np.log(p(z)) + (1 - y) * np.log(1 - p(z)))).mean()
    still = -np.log(1 - p(neutral @ w + bias)).mean()
    return own + holding * still + pairing * (times * (pairs @ w) ** 2).sum() + decay / 2 * (w @ w)


def test_gradient_is_that_of_the_loss():
    """Dense arithmetic: every part of the loss, the counterfactual one too, by differences."""
    rng, n = np.random.default_rng(3), 9
    texts, neutral = (rng.random((7, n)) < 0.5).astype(float), (rng.random((5, n)) < 0.5).astype(float)
    pairs = rng.integers(-1, 2, (4, n)).astype(float)
    y, weight, times, w, bias = rng.integers(0, 2, 7).astype(float), rng.random(7) + 0.5, rng.random(4), rng.normal(size=n), 0.3
    flat = lambda m: (np.nonzero(m)[1], np.nonzero(m)[0])
    sign = pairs[np.nonzero(pairs)]
    for pairing, holding in ((0.0, 0.0), (0.0, 1.5), (2.0, 0.0), (2.0, 1.5)):
        d, d0 = toxicity_cf.gradient(w, bias, flat(texts), y, weight, flat(neutral), 5, (np.nonzero(pairs)[1], np.nonzero(pairs)[0], sign), times, pairing, holding, 0.1)
        value = lambda w_, b: loss(w_, b, texts, y, weight, neutral, pairs, times, pairing, holding, 0.1)
        for k in range(n):
            step = np.eye(n)[k] * 1e-6
            assert abs((value(w + step, bias) - value(w - step, bias)) / 2e-6 - d[k]) < 1e-6
        if not holding:  # carriers don't move the bias
            assert abs((value(w, bias + 1e-6) - value(w, bias - 1e-6)) / 2e-6 - d0) < 1e-6


def test_a_fit_takes_most_rows(spark):
    rows = [(1, f"text {i % 25}") for i in range(3000)] + [(i, "other") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = quality_fm.training_rows(docs, labels, "quality", 10).collect()
    assert len(got) == 10 and len({(r["id"], r["text"]) for r in got}) == 10
    every = quality_fm.training_rows(docs, labels, "quality", 1000).collect()
    one = [r for r in every if r["id"] == 1]
    assert len(one) in (0, 25) and all(r["copies"] == 120 for r in one) and all(r["copies"] == 1 for r in every if r["id"] != 1)
    assert {(r["id"], r["text"]) for r in got} <= {(r["id"], r["text"]) for r in every}
