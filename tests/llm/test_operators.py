"""Each training-data operator against brute force on small tables, and its defined results on odd ones."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbiterq.llm import best_fit, column_bwt, fair_mix, graph, hilbert_ann, line_dedup, line_rules, quality_fm, simhash_vptree, token_stream, toxicity_cf

random.seed(5)
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "re", "su", "ta") for b in ("bel", "din", "for", "gul", "hem", "jas", "kor", "lun")]


def sentence(n):
    return " ".join(random.choice(WORDS) for _ in range(n)).capitalize() + "."


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


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


def test_union_find(spark):
    pairs = [(random.randrange(200), random.randrange(200)) for _ in range(120)] + [(900, k) for k in range(901, 960)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    nodes = {n for a, b in pairs if a != b for n in (a, b)}
    assert got == groups(pairs, nodes)


def test_rules(spark, odd, nothing):
    good = "\n".join(sentence(20) for _ in range(5))
    bad = good.split("\n")[0] + "\n" + " | ".join(WORDS[:30]) + "\n" + " ".join(w + "###" for w in WORDS[:30])
    out = {r["doc_id"]: r["j"] for r in line_rules.judged(table(spark, [(1, good, "a"), (2, bad, "a"), (3, (sentence(12) + "\n") * 6, "a")]), "j").collect()}
    assert out[1]["kept"] and out[1]["clean_text"] == good and not out[2]["kept"] and out[2]["n_bad_lines"] == 2 and out[2]["clean_text"] == bad.split("\n")[0]
    assert out[3]["base_failed"] and out[3]["n_repeat_words"] == 72 and out[3]["n_dup_lines"] == 5
    rows = line_rules.judged(odd, "j").collect()
    assert [r["j"]["n_words"] for r in rows if r["doc_id"] in (1, 2, 3)] == [0, 0, 0] and next(r for r in rows if r["doc_id"] == 4)["j"]["kept"]
    assert line_rules.judged(nothing, "j").count() == 0


def test_repeat_words_brute_force():
    for _ in range(60):
        ws = [random.choice("ab").encode() for _ in range(random.randrange(40))]
        wins = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
        hit = {i + k for i, w in enumerate(wins) if wins.count(w) > 1 for k in range(5)}
        assert line_rules.repeat_words(ws) == len(hit)


def test_simhash(spark, odd, nothing):
    points = np.array([random.getrandbits(64) for _ in range(1500)], np.uint64)
    near = points[:400] ^ (np.uint64(1) << np.array([random.randrange(64) for _ in range(400)], np.uint64)) ^ (np.uint64(1) << np.array([random.randrange(64) for _ in range(400)], np.uint64))
    every = np.unique(np.concatenate((points, near, points[:1] ^ np.arange(300, dtype=np.uint64))))
    nodes = spark.createDataFrame([(int(x),) for x in every.view(np.int64)], "fp long")
    got = {(r["u"], r["v"]) for r in simhash_vptree.links(nodes, shard=300).collect()}
    d = np.bitwise_count(every[:, None] ^ every[None])
    want = [(int(every.view(np.int64)[i]), int(every.view(np.int64)[j])) for i, j in zip(*np.nonzero(d <= 3), strict=True) if i < j]
    ids = every.view(np.int64).tolist()
    assert groups(got, ids) == groups(want, ids)
    rows = simhash_vptree.grouped(odd).collect()
    assert len(rows) == 8 and {r["fp"] for r in rows if r["id"] in (1, 2, 3)} == {0} and {r["component_id"] for r in rows if r["id"] in (1, 2, 3)} == {1}
    alone = "Another text without an id, which no row with an id is like at all."
    more = odd.unionByName(table(spark, [(None, "same words in here twice over, and more of them.", "a"), (None, alone, "a"), (None, alone, "a"), (5, alone + " No row is.", "a")]))
    kept = simhash_vptree.one_of_each(more.withColumn("fp", F.lit("kept"))).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted({(r["doc_id"] or 0, r["text"] or "") for r in more.collect()} - {(2, ""), (3, " \n\t"), (0, "same words in here twice over, and more of them.")})
    assert simhash_vptree.grouped(nothing).count() == 0


def test_mix(spark, odd, nothing):
    docs = [(i, s, random.randrange(1, 60)) for i, s in enumerate(random.choices(["a", "b", "c", None], [60, 8, 30, 10], k=600))]
    sized = spark.createDataFrame([(i, i, s, n) for i, s, n in docs], "row long, doc_id long, source string, size long")
    out = fair_mix.mixed(sized).collect()
    size = Counter()
    for _, s, n in docs:
        size[s] += n
    weight = dict(zip(sorted((s for s in size if s is not None)), (5, 2, 1), strict=True)) | {None: 5}
    left, free, target = sum(size.values()), set(size), {}
    while free:  # as the contract words it
        over = {s for s in free if left * weight[s] / sum(weight[f] for f in free) > 3 * size[s]}
        if not over:
            target |= {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
            break
        target |= {s: 3 * size[s] for s in over}
        left, free = left - sum(3 * size[s] for s in over), free - over
    taken = Counter()
    for r in out:
        assert r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["passes"] <= 3
        taken[r["source"]] += r["size"] * r["passes"]
    assert len(out) == 600 and all(abs(taken[s] - target[s]) <= 120 for s in size)
    again = {r["row"]: r["passes"] for r in fair_mix.mixed(sized.repartition(5)).collect()}
    assert again == {r["row"]: r["passes"] for r in out}
    for df, n in ((odd, 8), (nothing, 0)):
        rows = fair_mix.mixed(df.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size")))
        assert rows.count() == n


def test_lines(spark, odd, nothing):
    base = [sentence(40) for _ in range(30)]
    rows, n = [], 0
    for i in range(120):
        own = []
        for line in random.sample(base, 3) + [sentence(30)]:
            ws = line.split(" ")
            for _ in range(random.choice((0, 0, 1, 2, 6))):
                ws[random.randrange(len(ws))] = f"x{n}"
                n += 1
            own.append(" ".join(ws))
        rows.append((i, "\n".join(own), "a"))
    sets = {}
    for _, t, _ in rows:
        for line in t.split("\n"):
            sets[line.lower()] = {line.lower()[k : k + 8] for k in range(len(line) - 7)}
    names = sorted(sets)
    alike = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    of, seen, want = groups(alike, names), set(), {}
    for i, t, _ in rows:
        gone = 0
        for line in t.split("\n"):
            c = of[line.lower()]
            gone += c in seen
            seen.add(c)
        want[i] = gone
    got = {r["doc_id"]: r["d"]["n_removed"] for r in line_dedup.deduped(table(spark, rows), "d").collect()}
    assert sum(abs(got[i] - want[i]) for i in want) <= 0.02 * sum(want.values())
    out = line_dedup.deduped(odd.withColumn("gone", F.lit(1)), "d").collect()
    assert len(out) == 8 and {r["d"]["text"] for r in out if r["doc_id"] == 1} == {None} and {r["d"]["n_removed"] for r in out if r["doc_id"] == 4} == {0}
    assert line_dedup.deduped(nothing, "d").count() == 0


def spans(texts, length):
    seen = Counter(t[s : s + length] for t in texts for s in range(len(t) - length + 1))
    out = []
    for t in texts:
        cov = [False] * len(t)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                cov[s : s + length] = [True] * length
        kept = bytes(b for b, c in zip(t, cov, strict=True) if not c)
        out.append((len(t), sum(cov), sum(c and (k == 0 or not cov[k - 1]) for k, c in enumerate(cov)), kept))
    return out


def test_repeated_bytes(spark, odd, nothing, monkeypatch):
    passage, other = sentence(60), sentence(40)
    texts = [sentence(50) + passage + sentence(9), passage + other, sentence(30) + other + passage[:150] + other, "ab" * 300, "x" * 130, sentence(80), sentence(80)] + [passage[k:] + sentence(5) for k in range(0, 60, 7)]
    texts += [texts[5]]
    want = spans([t.encode() for t in texts], 100)
    df = table(spark, [(i, t, "a") for i, t in enumerate(texts)])
    for most in (100_000, 2):  # the second sends crowded anchors the other way
        monkeypatch.setattr(column_bwt, "MOST_PIECES", most)
        got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in column_bwt.deduped(df, length=100).collect()}
        assert [got[i] for i in range(len(texts))] == want
    rows = column_bwt.deduped(odd).collect()
    assert len(rows) == 8 and sum(r["n_removed"] for r in rows if r["id"] in (1, 2, 3)) == 0 and next(r for r in rows if r["id"] == 6)["n_removed"] == 3000
    assert column_bwt.deduped(nothing).count() == 0


def test_tokens(spark, odd, nothing, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    odd_words = "It's DON'T été   x y <|endoftext|> İ ΣΑΣ 12a3 ...!! naïve?ça"
    df = table(spark, [(i, t, "a") for i, t in enumerate([sentence(300), odd_words, "", None, *(sentence(40) for _ in range(30))])]).unionByName(odd.where("doc_id > 3").withColumn("doc_id", F.col("doc_id") + 100))
    folder = f"file://{tmp_path}/tokens"
    manifest = token_stream.write_stream(df, folder, path, length=64, batch=4, shard_bytes=3000)
    assert manifest.count() > 3
    got = {(r["doc_id"], r["start"]): r for r in token_stream.read_stream(manifest, folder).collect()}
    start = 0
    for r in sorted(df.collect(), key=lambda r: r["doc_id"]):
        ids = own.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        g = got[(r["doc_id"], start)]
        assert (g["n_tokens"], g["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    ids, mask = token_stream.Shard(folder, 0).sequence(1)
    assert len(ids) == 64 and mask.to_pylist() == [True] * 64
    assert token_stream.read_stream(token_stream.write_stream(nothing, f"{folder}-none", path), f"{folder}-none").count() == 0


def test_packing(spark, odd, nothing):
    sizes = np.array([random.choice((5, 90, 300, 511, 900, 2000, 4096)) for _ in range(500)])
    bins = best_fit.Bins()
    at, offset, lengths = best_fit.pack(sizes, bins)
    used = defaultdict(list)
    for b, o, n in zip(at.tolist(), offset.tolist(), sizes.tolist(), strict=True):
        used[b].append((o, n))
    for b, own in used.items():
        end = 0
        for o, n in sorted(own):
            assert o == end
            end += n
        assert lengths[b] == min(c for c in bins.lengths if c >= end)
    assert sum(sizes) / sum(lengths) > 0.97
    sized = spark.createDataFrame([(1, 10_000), (2, 0), (None, 30), (3, 512), (3, 512)], "doc_id long, size long")
    rows = best_fit.packed(sized).collect()
    assert sum(r["length"] for r in rows) == 11_054 and sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == 1) == [(0, 4096), (4096, 4096), (8192, 1808)]
    assert best_fit.packed(sized.limit(0)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [1.0] * 3), (9005, x[0].tolist()), (50, x[1].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = hilbert_ann.search(df, "id % 300 = 0", block=256).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q in range(0, 3000, 300):
        s = u @ u[q]
        s[q] = -9
        best = np.argsort(-s)[:5].tolist()
        own = [r["vec_id"] for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q]
        hits += len({9005 if q == 0 and b == q else b for b in best} & set(own)) + (q == 0 and 9005 in own)
        assert len(own) == 5 and all(r["score"] == pytest.approx(float(u[q] @ u[r["vec_id"]]), abs=1e-9) for r in out if r["query_id"] == q and r["vec_id"] < 3000 and r["vec_id"] != 50)
    assert hits >= 45 and not {9001, 9002, 9003, 9004} & {r["vec_id"] for r in out}
    assert hilbert_ann.search(df.limit(0), "id % 50 = 0").count() == 0


def test_hilbert_index_walks_by_single_steps():
    for bits, d in ((3, 2), (2, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        order = np.argsort(hilbert_ann.hilbert_index(cells, bits))
        assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_quality_model(spark, odd):
    rows = [(i, "\n".join(sentence(15) for _ in range(4)) if i % 4 else " ".join(random.choice(WORDS) + random.choice(("###", "%%%", "|")) for _ in range(60)), "a") for i in range(400)]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality_fm.trained(docs, labels)
    out = quality_fm.scored(docs.unionByName(odd), model, "p").collect()
    own = [r for r in out[:400] if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(out) == 408 and np.mean([(r["p"] >= 0.3) == (r["doc_id"] % 4 > 0) for r in own]) > 0.95
    at, x = quality_fm.features(rows[1][1])
    model.w[:] = 0
    dense, n = defaultdict(float), 0.0
    for i, v in zip(at.tolist(), x.tolist(), strict=True):
        dense[i] += v
    at2, x2 = np.array(list(dense)), np.array(list(dense.values()))
    n = sum(float(model.v[at2[i]] @ model.v[at2[j]]) * x2[i] * x2[j] for i in range(len(at2)) for j in range(i))
    assert model.raw(at2, x2, np.zeros(1, int))[0] - model.w0 == pytest.approx(n)
    none = quality_fm.trained(docs, labels.limit(0))
    assert {round(r["p"], 6) for r in quality_fm.scored(docs, none, "p").collect()} == {0.5}


def test_toxicity_model(spark, odd):
    def text(i):
        ws = sentence(40).split(" ")
        if i % 6 == 0:
            ws[3], ws[9] = "blorg", "zintu"
            ws[5] = "women"
        return " ".join(ws)

    docs = table(spark, [(i, text(i), "a") for i in range(600)])
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    model = toxicity_cf.trained(docs, labels)
    out = toxicity_cf.scored(docs.unionByName(odd), model, "p").collect()
    own = [r for r in out[:600] if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(out) == 608 and np.mean([(r["p"] >= 0.5) == (r["doc_id"] % 6 == 0) for r in own]) > 0.97
    w = model.dense()
    neutral = [abs(w[toxicity_cf.slots([a])].sum() - w[toxicity_cf.slots([b])].sum()) for a, b in ((b"women", b"men"), (b"gay", b"lesbian"))]
    assert max(neutral) < 0.5 * w[toxicity_cf.slots([b"blorg"])].sum()
