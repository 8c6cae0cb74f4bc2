"""The source divergence audit against plain arithmetic, its tries against dictionaries, and long division against Python's."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from arbiterq.llm import radix_audit as A

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plainly(rows, least=3, most=200):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        words = [w.translate(LOWER) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        groups.add((lang, source))
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    p_of = lambda n, total, v: 1 + 10**9 * (n + 1) // (total + v)
    for lang in {g for g, _ in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        v, sources = len(kept), sorted(s for g, s in groups if g == lang)
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: [p_of(counts[lang, s][t], total[s], v) for t in kept] for s in sources}
        q = [p_of(sum(counts[lang, s][t] for s in sources), sum(total.values()), v) for t in kept]
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(map(f, p[s], p[o]))) for o in sources if o != s]
            words = [(t, f(a, b)) for t, a, b in zip(kept, p[s], q, strict=True) if counts[lang, s][t] and a > b]
            for part, items, top in (("pair", pairs, None), ("term", words, most)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:top]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items)]
    return sorted(out)


def some(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abAéZ一😀") for _ in range(rng.randrange(1, 5))) for _ in range(120)]
    return [(rng.choice(("en", "en", "fr", None)), rng.choice(("a", "b", "c", None, "d")), rng.choice((" ", "\n", "9-"))[0].join(rng.choice(words[: rng.choice((10, 120))]) for _ in range(rng.randrange(0, 60)))) for _ in range(n)]


ODD = [(None, None, None), ("en", "empty", ""), ("zz", "alone", "one two one"), ("yy", "x", "1 2 3"), ("yy", "y", None), ("en", "b", "\U0001f600 ABC É é")]


@pytest.mark.parametrize("small", [False, True])
def test_equals_plain_arithmetic(spark, small, monkeypatch):
    rows = some(300) + ODD * 3
    if small:  # long texts are many, tries are written out every few documents, words of a shard and of a matrix are few
        for name, value in (("CHUNK", 300), ("MOST_LEAVES", 30), ("DENSE", 100), ("CELLS", 64), ("PIECE", 70)):
            monkeypatch.setattr(A, name, value)
    df = spark.createDataFrame([(*r, 1) for r in rows], "lang string, source string, text string, term int").repartition(5)
    got = A.divergence(df, most_terms=7 if small else 200, shard=5 if small else A.SHARD).collect()
    assert sorted(map(tuple, got)) == plainly(rows, most=7 if small else 200)


def test_empty_table(spark):
    assert A.divergence(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_tries_hold_what_went_in(monkeypatch):
    rng = random.Random(3)
    words = [bytes(rng.choice(b"ab\xc3\xa9") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    trie, n = A.Trie(), Counter(words)
    for part in (words[:1000], words[1000:]):
        own = Counter(part)
        leaves = trie.leaves(list(own))
        trie.docs.append((leaves, np.array(list(own.values()))))
        trie.counts["s" if len(part) == 1000 else "r"].append((leaves, np.array(list(own.values()))))
    assert [t for t, _ in trie.walk()] == sorted(n) and set(trie.at) == set(words)
    for dense in (A.DENSE, 0):
        monkeypatch.setattr(A, "DENSE", dense)
        rows = [r for b in trie.rows("x") for r in b.to_pylist()]
        assert [(r["term"], r["docs"], sum(r["counts"])) for r in rows] == [(t, n[t], n[t]) for t in sorted(n)]
        first = Counter(words[:1000])
        assert all(dict(zip(r["sources"], r["counts"], strict=True)).get("s", 0) == first[r["term"]] for r in rows)
    monkeypatch.setattr(A, "PIECE", 5)
    text = "One twoé, THREE-four 5five".encode()
    assert [w for piece in A.terms(text) for w in piece] == A.TERM.findall(text.translate(A.LOWER))


def test_merge_over_batches():
    rows = sorted((f"l{i % 2}", f"w{i % 50:02d}".encode(), 1, ["a", f"s{i % 3}"], [i, 1]) for i in range(400))
    schema = pa.schema([*A.ROW, ("range", pa.int64())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, (*r, 7), strict=True)) for r in rows[i : i + 37]], schema) for i in range(0, 400, 37)]
    got = [r for b in A.merged(iter(batches), 3, 8) for r in b.to_pylist()]
    want = defaultdict(Counter)
    for lang, term, _, sources, counts in rows:
        for s, n in zip(sources, counts, strict=True):
            want[lang, term][s] += n
    assert {(r["lang"], r["term"]): dict(zip(r["sources"], r["counts"], strict=True)) for r in got} == want
    assert max(Counter(r["shard"] for r in got).values()) <= 8 and len({(r["lang"], r["shard"]) for r in got}) == len({r["shard"] for r in got})


def test_long_division():
    rng = random.Random(5)
    total = [rng.randrange(1, 9 * 10**15) for _ in range(500)] + [1, 7]
    count = [rng.randrange(1, t + 1) for t in total]
    assert A.share(np.array(count), np.array(total)).tolist() == [1 + 10**9 * c // t for c, t in zip(count, total, strict=True)]
