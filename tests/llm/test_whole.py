"""What the operators once left out."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from arbiterq.llm import hilbert_ann, line_dedup, line_rules


def groups(pairs, nodes):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def prose(rng, n, size=6):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size)) for _ in range(n)]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def n_removed(spark, texts):
    return [r["d"]["n_removed"] for r in sorted(line_dedup.deduped(docs(spark, texts), "d").collect(), key=lambda r: r["doc_id"])]


def one_bucket(lines):
    """Signatures that put all lines into one bucket of each band."""
    return lines.groupBy("h").agg(F.lit(0).alias("kind"), F.count("*").alias("n"), *(F.lit(0).alias(f"m{i}") for i in range(line_dedup.BANDS * line_dedup.ROWS)))


def test_a_line_that_failed_is_compared_with_those_that_passed(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "signatures", one_bucket)
    rng = random.Random(1)
    rep = prose(rng, 40)
    near = ["newone", "newtwo", *rep[2:]]
    far = [*near[:-2], "newsix", "newten"]  # like near, not like rep
    texts = [" ".join(ws) for ws in (rep, rep, rep, near, far, prose(rng, 40))]
    for few in (32, 1):  # the second sends the bucket through the differences
        monkeypatch.setattr(line_dedup, "FEW", few)
        assert n_removed(spark, texts) == [0, 1, 1, 1, 1, 0]


def shingle_set(line):
    return {line[i : i + 8] for i in range(max(1, len(line) - 7))}


def alike(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) >= 0.8 * len(a | b)


def edited(rng, ws, times, new):
    """Words replaced, left out or put in."""
    ws = list(ws)
    for _ in range(times):
        at = rng.randrange(len(ws))
        kind = rng.randrange(3)
        ws[at : at + (kind < 2)] = [] if kind == 0 else [rng.choice(new)]
    return ws


def test_differences_find_every_link_of_a_bucket(spark, monkeypatch):
    """All pairs of one bucket by brute force; words are put in from a few, so that many lines share an edit."""
    monkeypatch.setattr(line_dedup, "signatures", one_bucket)
    monkeypatch.setattr(line_dedup, "FEW", 1)
    rng = random.Random(8)
    base, new = prose(rng, 30), prose(rng, 6)
    lines = sorted({" ".join(edited(rng, base, rng.randrange(7), new)) for _ in range(150)} | {" ".join(prose(rng, 30)) for _ in range(5)})
    df = spark.createDataFrame([(x,) for x in lines], "line string").withColumn("h", F.xxhash64("line"))
    name = {r["h"]: r["line"] for r in df.collect()}
    got = [(name[r["u"]], name[r["v"]]) for r in line_dedup.links(df).collect()]
    want = [(a, b) for i, a in enumerate(lines) for b in lines[i + 1 :] if alike(a, b)]
    assert all(alike(a, b) for a, b in got) and len(want) > 100 and groups(got, lines) == groups(want, lines)


def test_pairs_of_a_large_group_are_few(spark, monkeypatch):
    """Lines of their own that hold one passage, and lines that are all alike one another: hardly a pair is left to be made."""
    monkeypatch.setattr(line_dedup, "signatures", one_bucket)
    monkeypatch.setattr(line_dedup, "FEW", 1)
    made, write = {}, line_dedup.written

    def counted(df, name):
        out = write(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(line_dedup, "written", counted)
    rng = random.Random(11)
    passage, other, new = prose(rng, 20), prose(rng, 20), prose(rng, 40)
    own = [" ".join(prose(rng, 16) + passage) for _ in range(60)]
    alike_ = [" ".join([*other[:i], new[i], *other[i + 1 :], *passage]) for i in range(20)]
    lines = own + alike_
    df = spark.createDataFrame([(x,) for x in lines], "line string").withColumn("h", F.xxhash64("line"))
    name = {r["h"]: r["line"] for r in df.collect()}
    got = groups([(name[r["u"]], name[r["v"]]) for r in line_dedup.links(df).collect()], lines)
    assert [got[x] for x in own] == own and {got[x] for x in alike_} == {min(alike_)}
    assert made.get("crossing", 0) <= len(lines) and made.get("nearest", 0) <= 4 * len(lines)


def test_signatures_are_compiled_code(spark):
    """Minima are those of all samples, and no explode is interpreted or preceded by a filter that makes its array too."""
    rng = random.Random(12)
    lines = [" ".join(prose(rng, n, size)) for n, size in ((4, 6), (12, 6), (30, 4), (9, 30), (33, 2))] + ["今天天气很好我们去公园" * 4 + str(i) for i in range(4)]
    rows = []
    for i, line in enumerate(lines):
        ws, u = line.split(" "), line.encode("utf-16-be")
        if len(line) <= 96 or len(line) > 10 * len(ws):
            rows += [(i, 0, bytearray(u[k : k + 16])) for k in range(0, max(1, len(u) - 14), 2)]
        if len(line) >= 72 and len(line) < 14 * len(ws):
            rows += [(i, 1, bytearray(f"{a} {b}"[:8].encode())) for a, b in zip(ws, [*ws[1:], ""], strict=True)]
    m = [f"m{i}" for i in range(line_dedup.BANDS * line_dedup.ROWS)]
    want = spark.createDataFrame(rows, "h long, kind int, x binary").groupBy("h", "kind").agg(*(F.min(F.hash("x").bitwiseXOR(F.lit(line_dedup.constant(i + 1)))).alias(c) for i, c in enumerate(m)))
    df = spark.createDataFrame(list(enumerate(lines)) * 2, "h long, line string")
    got = line_dedup.signatures(df)
    assert sorted(map(tuple, got.select("h", "kind", *m).collect())) == sorted(map(tuple, want.collect())) and {r["n"] for r in got.collect()} == {2}
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = line_dedup.signatures(df)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    explodes = [x for x in plan if "Generate explode" in x]
    assert len(explodes) == 2 and all("*(" in x for x in explodes) and not any("Filter" in x and ("split(" in x or "sequence(" in x) for x in plan)


def test_repeated_shingles_count_once(spark):
    a, b = "abcdefgh " * 6 + "end of one", "abcdefgh " * 3 + "end of one"
    lines = spark.createDataFrame([(1, a), (2, b)], "h long, line string")
    got = line_dedup.verified(spark.createDataFrame([(2, 1)], "h long, rep long"), lines, 0.8).first()
    x, y = shingle_set(a), shingle_set(b)
    assert got["far"] == 1 - len(x & y) / len(x | y) and got["same"] == alike(a, b)


def test_bands_find_what_is_alike(spark):
    """Recall over planted pairs of all lengths at 0.8 to 0.9, and no unlike line goes."""
    rng = random.Random(9)
    pairs = []
    while len(pairs) < 600:
        ws = prose(rng, rng.randrange(5, 90), rng.randrange(3, 9))
        other = edited(rng, ws, rng.randrange(1, 1 + len(ws) // 8 + 1), prose(rng, 3))
        a, b = " ".join(ws), " ".join(other)
        x, y = shingle_set(a), shingle_set(b)
        if min(len(a), len(b)) >= 24 and 0.8 <= len(x & y) / len(x | y) <= 0.9:
            pairs.append((a, b))
    got = n_removed(spark, [t for p in pairs for t in p])
    assert sum(got[::2]) == 0 and sum(got[1::2]) >= 0.985 * len(pairs)


def test_a_chain_goes_whole(spark):
    """150 groups of a line (five copies), one alike it, and one alike that alone."""
    rng, texts = random.Random(10), []
    for _ in range(150):
        r = prose(rng, 30)
        a = ["newone", "newtwo", *r[2:]]
        b = [*a[:-2], "newsix", "newten"]
        assert alike(" ".join(r), " ".join(a)) and alike(" ".join(a), " ".join(b)) and not alike(" ".join(r), " ".join(b))
        texts += [" ".join(x) for x in (r, r, r, r, r, a, b)]
    got = n_removed(spark, texts)
    assert sum(got[0::7]) == 0 and sum(got[5::7]) >= 149 and sum(got[6::7]) >= 149


def test_shingles_reach_every_character(spark):
    rng = random.Random(2)
    heads = prose(rng, 8, 8)
    urls = [" ".join(h + t for h, t in zip(heads, prose(rng, 8), strict=True)) for _ in range(3)]  # differ past the eighth character only
    chinese = [" ".join("一二三四五六七八" + "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(6)) for _ in range(4)) for _ in range(2)]
    words = prose(rng, 12)
    once = " ".join([*words[:5], "q" + words[5][1:], *words[6:]])  # one letter of a line of twelve words
    assert n_removed(spark, [*urls, *chinese, " ".join(words), once]) == [0] * 6 + [1]


def test_bands_find_a_pair_at_the_threshold():
    assert 1 - (1 - line_dedup.THRESHOLD**line_dedup.ROWS) ** line_dedup.BANDS >= 0.996


def test_short_lines_go_if_equal(spark):
    texts = ["Share this article\n\nRead more", "share this article\n\nRead mora\nRead more\nRead more", "今天天气很好我们去公园", " 今天天气很好我们去公园\n\n"]
    assert n_removed(spark, texts) == [0, 3, 0, 1]


def test_every_separator_of_navigation_is_searched(spark):
    rng = random.Random(3)
    own = [" ".join(prose(rng, 14)) + f".\nHome {c} Shop {c} Shoes {c} Boots" for c in "|»›·•>"] + ["About · Help · Terms · Contact", "One · two are words of a sentence."]
    rows = docs(spark, own)
    names = ("doc_id", "n_bad_lines", "words_left", "kept")
    got = [tuple(r) for r in line_rules.judged(rows, "j").select("doc_id", *(f"j.{c}" for c in names[1:])).orderBy("doc_id").collect()]
    with duckdb.connect() as con:
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(own)))
        want = con.execute(f"SELECT {', '.join(names)} FROM ({line_rules.OP1_SQL}) ORDER BY doc_id").fetchall()
    assert got == want and [r[1] for r in got] == [1] * 7 + [0]


def test_equal_vectors_give_their_smallest_ids(spark):
    rng = np.random.default_rng(4)
    x, hot = rng.normal(size=(600, 64)), rng.normal(size=64)
    rows = [(i, (hot if i % 2 else x[i]).tolist()) for i in range(600)]
    rows[0] = (0, (hot + 0.01 * x[0]).tolist())
    out = hilbert_ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id in (0, 599)", block=64).collect()
    assert {q: [r["vec_id"] for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 599)} == {0: [1, 3, 5, 7, 9], 599: [1, 3, 5, 7, 9]}


def test_no_table_keeps_the_texts_of_all_lines(spark, monkeypatch):
    """Places and hashes only; the texts of lines are kept where a pair may be made of them."""
    kept, write = {}, line_dedup.written

    def noted(df, name):
        kept.setdefault(name, set()).update(df.columns)
        return write(df, name)

    monkeypatch.setattr(line_dedup, "written", noted)
    rng = random.Random(13)
    line = " ".join(prose(rng, 12))
    out = line_dedup.deduped(docs(spark, [line, f"{line}\n\n{line} \n", "", None, "\n"]), "d").collect()
    assert sorted((r["doc_id"], r["d"]["n_lines"], r["d"]["n_removed"]) for r in out) == [(0, 1, 0), (1, 4, 2), (2, 1, 0), (3, 0, 0), (4, 2, 0)]
    assert kept["lines"] == {"key", "id", "pos", "h"} and [name for name, columns in kept.items() if "line" in columns] == ["texts"]


def test_lines_are_made_twice(spark, monkeypatch):
    """Once for the buckets, and once for the places of all lines together with the texts that pairs may need."""
    made, write = [], line_dedup.written

    def noted(df, name):
        if "posexplode(ls#" in df._jdf.queryExecution().optimizedPlan().toString():
            made.append(name)
        return write(df, name)

    monkeypatch.setattr(line_dedup, "written", noted)
    rng = random.Random(14)
    line = " ".join(prose(rng, 30))
    assert n_removed(spark, [line, f"{line}\nshort\n{line[:-3]}", "short"]) == [0, 2, 1]
    assert made == ["buckets", "texts"]


def test_differences_that_no_prefix_reaches_are_not_dealt(spark):
    rng = random.Random(15)
    r = prose(rng, 30)
    x, y = [*r[:6], *prose(rng, 40)], [*r[:20], *r[22:]]  # x lacks all that y lacks, and has so much of its own that it meets others there
    lines = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate((r, x, y))], "h long, line string")
    stars = spark.createDataFrame([(1, 0, 0, True, False), (2, 0, 0, True, True)], "h long, rep long, sketch long, own boolean, same boolean")
    assert line_dedup.differences(stars, lines, 0.8).count() == 0
