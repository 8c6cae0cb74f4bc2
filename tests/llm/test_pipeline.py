"""The pipeline's stages, on tables of any kind, and its rows against a plain Python version of all five."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arbiterq.llm import best_fit, line_rules, simhash_vptree

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def words(rng, n):
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(3, 9))) for _ in range(n)]


def sentence(rng, n=20):
    return " ".join(words(rng, n)).capitalize() + "."


def corpus():
    rng, rows = random.Random(31), []
    common = [sentence(rng) for _ in range(3)]
    for i in range(40):
        lines = [sentence(rng) for _ in range(rng.randrange(3, 7))]
        if i % 5 == 0:
            lines.insert(1, common[i % 3])
        if i % 7 == 0:
            lines.append("Home | Shop | Shoes | Boots | More")
        rows.append((i, "\n".join(lines), "en", f"s{i % 3}"))
    rows += [(100 + i, rows[i][1], "en", "s0") for i in range(4)]  # exact copies
    for i in range(4):  # near copies: a word in each line
        rows.append((200 + i, "\n".join(" ".join([*x.split(" ")[:-1], "other."]) for x in rows[10 + i][1].split("\n")), "en", "s1"))
    rows += [(300, "### $$$ %%%", "en", "s1"), (301, "few words", "en", "s2"), (302, None, "en", None), (303, "", None, "s2"), (304, sentence(rng, 30), "en", None), (305, sentence(rng, 6000), "en", "s0")]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(line):
    return {line[k : k + 8] for k in range(max(1, len(line) - 7))}


def without_copies(rows):
    """Lines that equal or are alike an earlier one go; documents that lose too much go."""
    seen, out = [], []
    for i, text, *rest in sorted(rows):
        left = []
        for line in text.split("\n"):
            own = line.lower().strip()
            if own and any(own == s or min(len(own), len(s)) >= 24 and len(shingles(own) & shingles(s)) >= 0.8 * len(shingles(own) | shingles(s)) for s in seen):
                continue
            seen.append(own)
            left.append(line)
        kept = "\n".join(left)
        if kept.split() and len(kept.split()) >= corpus_pipeline.LEAST_LEFT * len(text.split()):
            out.append((i, kept, *rest))
    return out


def one_of_alike(rows):
    fp = {r[0]: simhash_vptree.fingerprint(r[1]) for r in rows}
    out = []
    for r in sorted(rows):
        if not any((fp[r[0]] ^ fp[o[0]]).bit_count() <= 3 for o in out):
            out.append(r)
    return out


def mixed(rows):
    """Virtual finish times, cut at the budget."""
    size = {r[0]: len(r[1].split()) for r in rows}
    by = Counter()
    for r in rows:
        by[r[3]] += size[r[0]]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(by, key=lambda s: (s is None, s or "")))}
    queue = []
    for s in by:
        for p in range(3):
            at = p * by[s]
            for turn, n, i in sorted((hashlib.md5(f"mix:{p}:{r[0]}".encode()).hexdigest(), size[r[0]], r[0]) for r in rows if r[3] == s):
                at += n
                queue.append((at / weight[s], s is not None, s or "", p, turn, n, i))
    total, times = 0, Counter()
    for *_, n, i in sorted(queue):
        total += n
        times[i] += total <= sum(by.values())
    return [r for r in rows for _ in range(times[r[0]])]


def pieces(rows):
    out = Counter()
    for r in rows:
        n = len(r[1].split())
        for at in range(0, n, 4096):
            out[(r[0], at, min(4096, n - at))] += 1
    return out


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"file://{folder}/documents.parquet")
    docs, out = corpus_pipeline.documents(spark, str(folder)), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = corpus_pipeline.written(stage(spark, docs, str(folder)), f"test-{name}")
    return str(folder), out


def rows_of(df):
    return sorted((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.select("doc_id", "text", "lang", "source").collect())


def test_stages_equal_plain_python(spark, staged):
    _, out = staged
    rules = line_rules.Rules()
    want = [(i, line_rules.judge(t, rules)[-1], lang, s) for i, t, lang, s, _ in corpus() if line_rules.judge(t, rules)[-2]]
    assert rows_of(out["quality_rules"]) == sorted(want) and len(want) > 40
    want = without_copies(want)
    assert rows_of(out["line_dedup"]) == want and not {r[0] for r in want} & {100, 101, 102, 103, 200, 201, 202, 203}
    want = one_of_alike(want)
    assert rows_of(out["simhash_near_dedup"]) == want
    want = mixed(want)
    assert rows_of(out["fair_mix"]) == sorted(want) and len(want) != len(set(want))
    last = out["best_fit_packing"].toPandas()
    assert Counter(zip(last["doc_id"], last["start"], last["length"], strict=True)) == pieces(want)
    at, offset, lengths = best_fit.pack(np.sort(last["length"].to_numpy(np.int64))[::-1], best_fit.Bins())
    assert sorted(last.drop_duplicates(["shard", "bin"])["capacity"]) == sorted(lengths)
    assert all(r["n_chars"] == len(r["text"]) for r in out["fair_mix"].collect())


def test_run_is_the_stages(spark, staged):
    folder, out = staged
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, out["best_fit_packing"].collect()))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, odd, nothing, name):
    """Nulls, blanks, repeats, no rows; further columns with the names that stages use pass through all but the last."""
    stage = dict(corpus_pipeline.STAGES)[name]
    clash = {"size": F.lit(1), "row": F.lit("r"), "key": F.lit(2), "h": F.lit(3), "gone": F.lit("g"), "pass": F.lit(0), "component": F.lit(4), "fp": F.lit(5), "__rules": F.lit(6), "kept": F.lit(True)}
    for df in (odd, nothing):
        own = df.withColumns(clash)
        out = stage(spark, own, "")
        rows = out.collect()
        assert (len(rows) > 0) == (df is odd)
        if name != "best_fit_packing":
            assert out.columns == own.columns and all(r["gone"] == "g" and r["component"] == 4 for r in rows)
