"""Sources, sinks, streams, models and samples."""

import json
import os
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from arbiterq.functions import vector
from arbiterq.operators import build, infer, joins, metrics, order, probe, sampling, states, validate
from arbiterq.sources import records, sinks
from arbiterq.streaming import resume

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"qid": "1"}\n\n{"qid": "2"}\n{bad\n')
    (tmp_path / "b.json").write_text('[{"qid": "1"}, {"qid": "2"}]')
    assert records.tolerant(spark, f"{tmp_path}/a.jsonl", "qid string").where("qid is not null").count() == 2
    assert records.tolerant(spark, f"{tmp_path}/none.jsonl", "qid string").count() == 0
    assert records.json_records(spark, f"{tmp_path}/b.json", "qid string").count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        records.jsonl(spark, f"{tmp_path}/a.jsonl", "qid string").collect()


def test_order_and_cache(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("".join(json.dumps({"question_hash": f"h{i % 3}", "pk_answer": str(i)}) + "\n" for i in range(9)))
    assert {r["question_hash"]: r["pk_answer"] for r in records.answer_cache(spark, f"{tmp_path}/c.jsonl").collect()} == {"h0": "6", "h1": "7", "h2": "8"}
    rows = records.jsonl(spark, f"{tmp_path}/c.jsonl", records.CACHE)
    assert [r["pk_answer"] for r in records.row_range(rows, 2, 5).collect()] == ["2", "3", "4"]
    assert records.head(rows, 4).count() == 4


def test_later_files_win_in_the_cache(spark, tmp_path):
    """The later file is the larger, which Spark reads first."""
    line = lambda k, v: json.dumps({"question_hash": k, "pk_answer": v}) + "\n"
    (tmp_path / "part-0.json").write_text(line("h", "old") + line("a", "kept"))
    (tmp_path / "part-1.json").write_text(line("h", "new") + "".join(line(f"x{i}", "y" * 50) for i in range(2000)))
    (tmp_path / "part-00.json").write_text(line("h", "oldest"))
    for at, name in enumerate(("part-00.json", "part-0.json", "part-1.json")):
        os.utime(tmp_path / name, (1_000_000 + at, 1_000_000 + at))
    got = {r["question_hash"]: r["pk_answer"] for r in records.answer_cache(spark, str(tmp_path)).collect()}
    assert got["h"] == "new" and got["a"] == "kept" and len(got) == 2002
    assert records.answer_cache(spark, f"{tmp_path}/none").count() == 0
    sinks.append_cache(spark.createDataFrame([("h", "newest")], "question_hash string, pk_answer string"), f"{tmp_path}")
    assert records.answer_cache(spark, str(tmp_path)).where("question_hash = 'h'").first()["pk_answer"] == "newest"


def test_staged_and_discovered(spark, tmp_path):
    for name, ids in (("dev-00000-of-00002", [0, 1]), ("dev-00001-of-00002", [2]), ("test", [3, 4])):
        spark.createDataFrame([(i,) for i in ids], "v int").toPandas().to_parquet(tmp_path / f"{name}.parquet")
    got = [(r["raw_split"], r["raw_idx"], r["v"]) for r in records.staged(spark, str(tmp_path), ("test", "dev")).orderBy("raw_idx").collect()]
    assert got == [("test", 0, 3), ("test", 1, 4), ("dev", 2, 0), ("dev", 3, 1), ("dev", 4, 2)]
    assert records.staged(spark, str(tmp_path)).count() == 5
    files = tmp_path / "records"
    files.mkdir()
    for name in ("one.jsonl", "two.jsonl", "two_judge.jsonl", "other.txt"):
        (files / name).write_text('{"qid": "1"}\n')
    assert {r["dataset"] for r in records.discovered(spark, str(files), "qid string").collect()} == {"one", "two"}


def test_matrix_and_layers(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "h.npy", x)
    (tmp_path / "m.jsonl").write_text("".join(json.dumps({"qid": str(i)}) + "\n" for i in range(4)))
    got = {r["qid"]: r["h"] for r in records.matrix(spark, f"{tmp_path}/h.npy", f"{tmp_path}/m.jsonl", "qid string").collect()}
    assert got == {str(i): x[i].tolist() for i in range(4)}
    (tmp_path / "m.jsonl").write_text('{"qid": "0"}\n')
    with pytest.raises(ValueError, match="4 vectors and 1 records"):
        records.matrix(spark, f"{tmp_path}/h.npy", f"{tmp_path}/m.jsonl", "qid string")
    spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.6)], "qid string, layer int, v double").write.partitionBy("layer").parquet(f"{tmp_path}/canonical")
    spark.createDataFrame([("a", 1, 9.0), ("b", 1, 0.7)], "qid string, layer int, v double").write.partitionBy("layer").parquet(f"{tmp_path}/shards")
    out = {r["qid"]: r["v"] for r in records.layer(spark, f"{tmp_path}/canonical", f"{tmp_path}/shards", 1).collect()}
    assert out == {"a": 0.5, "b": 0.7} and records.layer(spark, f"{tmp_path}/canonical", None, 2).count() == 1
    with pytest.raises(FileNotFoundError):
        records.layer(spark, f"{tmp_path}/none", None, 1)


def test_templates():
    assert records.templates('{"a": ["s", "u"]}') == {"a": ("s", "u")}
    pytest.importorskip("yaml")
    assert records.templates("a:\n  - s\n  - 'u {x}'\nb: only\n") == {"a": ("s", "u {x}"), "b": ("", "only")}


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"name": "s", "partition": {"d": {"train": ["1", "2"], "val": ["3"], "test": []}}}))
    assert {(r["dataset"], r["qid"], r["split"]) for r in records.manifest(spark, f"{tmp_path}/m.json").collect()} == {("d", "1", "train"), ("d", "2", "train"), ("d", "3", "val")}


def test_sinks(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(3).write.parquet(path)
    sinks.swap(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2 and sinks.complete(spark, path)
    assert sinks.backed_up(spark.range(5), path, dry_run=True) == 5 and spark.read.parquet(path).count() == 2
    sinks.backed_up(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and spark.read.parquet(f"{path}.bak").count() == 2
    sinks.mark_config(spark, path, {"layer": 3})
    assert sinks.same_config(spark, path, {"layer": 3}) and not sinks.same_config(spark, path, {"layer": 4})
    shards = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("z", 3, 0)], "qid string, v int, shard int")
    assert [tuple(r) for r in sinks.compacted(shards, spark.createDataFrame([("a",)], "qid string")).select("qid", "v").collect()] == [("a", 1)]
    with pytest.raises(Exception, match="no shard has b"):
        sinks.compacted(shards, spark.createDataFrame([("b",)], "qid string")).collect()


def test_reports_and_appends(spark, tmp_path):
    rows = spark.createDataFrame([("b", "1", None), ("a", "2", 3)], "z string, a string, n int")
    sinks.write_rows(rows.coalesce(1), f"{tmp_path}/rows", ["n", "z", "a"])
    lines = [x for f in os.listdir(tmp_path / "rows") if f.endswith(".json") for x in (tmp_path / "rows" / f).read_text().splitlines()]
    assert lines == ['{"n":null,"z":"b","a":"1"}', '{"n":3,"z":"a","a":"2"}']
    answers = spark.createDataFrame([("m", "b", "d", "1")], "method string, backbone string, dataset string, qid string")
    for _ in range(2):
        sinks.append_answers(answers, f"{tmp_path}/answers")
    assert spark.read.parquet(f"{tmp_path}/answers").count() == 2 and os.path.isdir(tmp_path / "answers" / "method=m" / "backbone=b" / "dataset=d")
    report = spark.createDataFrame([("m", "ALL_AGG", 0.123456, None), ("m", "d", None, 2)], "method string, dataset string, acc double, n int")
    sinks.csv_report(report, f"{tmp_path}/csv")
    text = "".join((tmp_path / "csv" / f).read_text() for f in os.listdir(tmp_path / "csv") if f.endswith(".csv"))
    assert text.splitlines()[0] == "method,dataset,acc,n" and set(text.splitlines()[1:]) == {"m,ALL_AGG,0.1235,", "m,d,,2"}
    assert sinks.json_report(report, ["method", "dataset"])["m"]["d"] == {"acc": None, "n": 2}


def test_versions(spark, tmp_path):
    path = f"{tmp_path}/table"
    sinks.published(spark.range(2), path)
    first = sinks.current(spark, path)
    sinks.published(first.where("id > 0"), path)
    assert sinks.current(spark, path).count() == 1 and first.count() == 2
    spark.range(4).write.parquet(f"{tmp_path}/t.old-x")  # a swap that was cut short
    assert sinks.restored(spark, f"{tmp_path}/t") and spark.read.parquet(f"{tmp_path}/t").count() == 4 and not sinks.restored(spark, f"{tmp_path}/t")


def test_running_cells(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"pk": true, "ck": false}\n{"pk": true, "ck": false}\n{"pk": null, "ck": true}\n')
    stream = resume.records(spark, f"{tmp_path}/in", "pk boolean, ck boolean")
    resume.running_cells(stream, "pk", "ck", "cells_so_far", f"{tmp_path}/check").awaitTermination()
    assert {r["cell"]: r["n"] for r in spark.table("cells_so_far").collect()} == {"C10": 2, "C01": 1}


def test_stream_resumes(spark, tmp_path):
    source, out, check = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/check"
    source.mkdir()

    def run():
        stream = resume.first_seen(resume.records(spark, str(source), "qid string, pk boolean"), ["qid"])
        resume.saved(stream, out, check).awaitTermination()
        return sorted(r["qid"] for r in spark.read.parquet(out).collect())

    (source / "1.json").write_text('{"qid": "a", "pk": true}\n{"qid": "a", "pk": true}\n{"qid": "b", "pk": false}\n')
    assert run() == ["a", "b"]
    assert run() == ["a", "b"]
    (source / "2.json").write_text('{"qid": "b"}\n{"qid": "c"}\n')
    assert run() == ["a", "b", "c"]


def test_provider_stages(spark):
    rows = spark.createDataFrame([("1", "who x", "x b", ["x"]), ("2", "who x", "", ["x"]), ("3", "who c", "d", ["z"])], "qid string, question string, ck_text string, ground_truth array<string>")
    cache = spark.createDataFrame([], "question_hash string, pk_answer string")
    out = {r["qid"]: r for r in infer.labelled(rows, cache, infer.Echo).collect()}
    assert out["1"]["cell"] == "C11" and out["2"]["cell"] == "C10" and out["2"]["ck_answer"] == "" and out["3"]["cell"] == "C00"
    _, fresh = infer.memoised(rows, "question", cache, infer.Echo)
    assert fresh.count() == 2 and set(fresh.columns) == {c.split()[0] for c in records.CACHE.split(", ")}
    again, none = infer.memoised(rows, "question", fresh, infer.Echo)
    assert none.count() == 0 and again.count() == 3
    assert infer.traced(rows, infer.Echo).count() == 18


def only():
    class Only(infer.Echo):
        """Takes no prompt without a letter, and none at all for an empty context."""

        def reply(self, prompts, call):
            if any("Passage: \n" in p[-1][1] for p in prompts):
                raise AssertionError("asked about nothing")
            if any("poison" in p[-1][1] for p in prompts):
                raise infer.Refused(400, "poison")
            return [infer.Reply(f"{call.model}|{call.temperature}|{call.seed}|{call.repetition}|{call.key}", 3, 2, 0.5) for _ in prompts]

    return Only()


def test_calls_are_halved_and_dealt_to_keys(spark):
    df = spark.createDataFrame([(i, "poison" if i == 5 else f"p{i}") for i in range(20)], "i int, p string").coalesce(1)
    out = {r["i"]: r for r in infer.generated(df, "p", only, seed=7, temperature=0.5, repetition=1.05, policy=infer.Policy(keys=("a", "b"), per_key=2, batch=4)).collect()}
    assert out[5]["reply"] is None and out[5]["error"].startswith("ERROR: 400") and sum(r["error"] is None for r in out.values()) == 19
    assert out[0]["reply"] == "stub|0.5|7|1.05|a" and out[4]["key_used"] == "b" and out[0]["cost_usd"] == 0.5 and out[0]["prompt_tokens"] == 3
    rows = spark.createDataFrame([("1", "q", None, ["x"]), ("2", "q", "", ["x"])], "qid string, question string, ck_text string, ground_truth array<string>")
    assert {r["ck_answer"] for r in infer.labelled(rows, spark.createDataFrame([], "question_hash string, pk_answer string"), only).collect()} == {""}


class Busy(infer.Echo):
    def reply(self, prompts, call):
        if call.model == "free":
            raise infer.Refused(429, "rate limit")
        return [call.model for _ in prompts]


def test_a_limited_model_falls_back():
    policy, waits = infer.Policy(retry=infer.Retry(times=2), fallback={"free": "paid"}), []
    assert policy.ask(Busy(), [[("user", "x")]], infer.Call("free"), waits.append)[0][0].text == "paid" and waits == [1, 2]
    assert infer.Policy(retry=infer.Retry(times=0)).ask(Busy(), [[("user", "x")]], infer.Call("free"))[0][1].startswith("ERROR: 429")


def test_prompts_reach_the_limit(spark):
    words = " ".join(f"w{i}" for i in range(5000))
    got = spark.createDataFrame([(words,), ("few  words",)], "t string").select(infer.limited(F.col("t")).alias("t")).collect()
    assert got[0]["t"].split() == [f"w{i}" for i in (*range(512), *range(5000 - 3584, 5000))] and got[1]["t"] == "few  words"


def judge():
    class Judge(infer.Digest):
        def reply(self, prompts, call):
            assert call.max_tokens == 4 and call.temperature == 0
            if any("broken" in p[-1][1] for p in prompts):
                raise OSError("no network")
            return [" yes, it does" if "right" in p[-1][1].split("Given answer: ")[1].split("\n")[0] else "No" for p in prompts]

    return Judge()


def test_judge_stage(spark):
    names = "qid string, model_key string, pk_answer string, ck_answer string, pk_correct_alias boolean, ck_correct_alias boolean, pk_correct_judge boolean, ck_correct_judge boolean, pk_judge_response string, ck_judge_response string, judge_model string, judge_extracted_at string, pk_correct boolean, ck_correct boolean, pk_correct_source string, ck_correct_source string"
    none = [None] * 6
    rows = [("1", "m", "right", "wrong", True, True, *none, True, True, "alias", "alias"), ("2", "m", "broken", "", True, False, *none, True, False, "alias", "alias"), ("3", "m", " ", "right", False, False, *none, False, False, "alias", "alias"), ("4", "m", "right", "", True, False, True, None, "YES", None, "old", "t", True, False, "alias_and_judge", "alias")]
    gold = spark.createDataFrame([(str(i), ["g"]) for i in range(1, 5)], "qid string, ground_truth array<string>")
    policy = infer.Policy(retry=infer.Retry(times=1, first=0.0, every=True), batch=1)
    df = spark.createDataFrame(rows, names)
    out = {r["qid"]: r for r in infer.judged(df, gold, judge, policy=policy).collect()}
    assert (out["1"]["pk_correct_judge"], out["1"]["ck_correct_judge"], out["1"]["pk_correct"], out["1"]["ck_correct"], out["1"]["pk_judge_response"]) == (True, False, True, False, "YES, IT DOES")
    assert out["2"]["pk_correct_judge"] is None and out["2"]["pk_judge_response"].startswith("ERROR") and out["2"]["pk_correct"] and out["2"]["pk_correct_source"] == "alias" and out["2"]["ck_judge_response"] == "empty_candidate"
    assert out["3"]["pk_correct_judge"] is False and out["3"]["ck_correct_judge"] is True and out["3"]["ck_correct"] is False
    assert tuple(out["4"]) == rows[3]
    with pytest.raises(Exception, match="no gold for 4"):
        infer.judged(df.withColumn("pk_judge_response", F.lit(None).cast("string")), gold.where("qid <> '4'"), judge, policy=policy).collect()
    assert infer.JUDGE_RETRY.times == 7 and infer.JUDGE_RETRY.most == 60


def test_states(spark):
    encoder = states.Hashed()
    assert states.choice_ids(encoder, "A") == sorted({encoder.tokens(v)[0] for v in states.CHOICES["A"]}) and states.mass(np.zeros(4), [0, 1]) == 0.5 and states.mass(np.zeros(4), []) == 0.0
    rows = spark.createDataFrame([("1", "who is it", "some words here", "PK", "t1 t2"), ("2", "who", "some", "CK", "")], "qid string, question string, ck_text string, side string, trace string")
    h = {r["qid"]: r for r in states.hidden_states(rows.select("qid", "question", "ck_text"), states.Hashed).collect()}
    assert (h["1"]["token_len"], h["1"]["token_len_nock"], h["1"]["truncated"]) == (6, 3, False) and len(h["1"]["h"]) == 16 and h["1"]["h"] != h["1"]["h_nock"]
    assert h["1"]["h_nock"] == pytest.approx(encoder.forward(["who is it"])[0][0][1, -1].tolist())
    out = {r["qid"]: r for r in states.pooled_traces(rows, states.Hashed).collect()}
    alone = encoder.forward(["t1 t2"])[0][0].mean(axis=1)
    assert np.allclose(out["1"]["h_trace"], alone, atol=1e-6) and 0 < out["1"]["p_a"] < 1 and out["2"]["h_trace"] is None and out["2"]["p_a"] is None
    assert infer.layer_index("stub-small", 0.5) == 8 and infer.layer_index("stub-large", 1.0) == 32
    for bad in (lambda: infer.layer_index("stub-small", 1.5), lambda: infer.model_spec("none")):
        with pytest.raises((ValueError, KeyError)):
            bad()


def test_retry():
    calls, waits = [], []

    def fails(status):
        def call():
            calls.append(status)
            raise infer.Refused(status)

        return call

    assert infer.Retry()(fails(503), waits.append)[1].startswith("ERROR: 503") and len(calls) == 5 and waits == [1, 2, 4, 8]
    calls.clear()
    infer.Retry()(fails(404), waits.append)
    assert len(calls) == 1
    waits.clear()
    infer.JUDGE_RETRY(fails(400), waits.append)
    assert waits == [1, 2, 4, 8, 16, 32, 60]


def test_order_in_ranges(spark):
    rng = np.random.default_rng(3)
    rows = [(f"k{i % 3}", float(x) + 0.0, int(i)) for i, x in enumerate(np.round(rng.normal(size=900), 1))] + [("k0", None, 900), ("k1", float("nan"), 901)]
    df = spark.createDataFrame(rows, "k string, x double, i int").groupBy("k", "x").agg(F.count("*").alias("n"))
    got = {(r["k"], str(r["x"])): (r["upto"], r["all"]) for r in order.running_total(df, ["k"], "x", "n", "upto", "all", ranges=7).collect()}
    for k in ("k0", "k1", "k2"):
        own = sorted((x for kk, x, _ in rows if kk == k), key=lambda x: (x is not None, x is not None and x != x, x if x == x else 0))
        for at, x in enumerate(own):
            assert got[(k, str(x))] == (max(n + 1 for n, y in enumerate(own) if str(y) == str(x)), len(own)), (at, x)
    ids = spark.createDataFrame([(f"k{i % 2}", f"id{i:03d}") for i in range(300)], "k string, id string")
    at = {(r["k"], r["id"]): r["at"] for r in order.placed(ids, ["k"], "id", "at", ranges=9).collect()}
    assert all(at[(f"k{i % 2}", f"id{i:03d}")] == i // 2 + 1 for i in range(300))
    by = order.placed_by_draw(ids, ["k"], F.md5("id"), "id", "at", "n").orderBy("k", "at").collect()
    assert [r["at"] for r in by] == [*range(1, 151)] * 2 and [r["id"] for r in by[:150]] == [r["id"] for r in ids.where("k = 'k0'").orderBy(F.md5("id")).collect()]


def test_split_keeps_groups_whole(spark):
    df = spark.createDataFrame([(f"d{i % 2}", f"q{i // 4}", i) for i in range(160)], "dataset string, question string, i int")
    split = sampling.grouped_split(df, "dataset", "question")
    assert split.count() == df.select("dataset", "question").distinct().count()
    sizes = {(r["dataset"], r["split"]): r["count"] for r in split.groupBy("dataset", "split").count().collect()}
    assert sizes[("d0", "test")] == 4 and sizes[("d0", "val")] == 4 and sizes[("d0", "train")] == 32


def test_auroc_and_empty_groups(spark):
    df = spark.createDataFrame([("a", 0.1, 0), ("a", 0.4, 0), ("a", 0.4, 1), ("a", 0.8, 1), ("b", 0.3, 1)], "g string, p double, y int")
    assert {r["g"]: r["auroc"] for r in metrics.auroc(df, "p", "y", "g").collect()} == {"a": 0.875, "b": None}


def test_contained_equals_brute_force(spark):
    texts = spark.createDataFrame([(1, "x a b c y"), (2, "a c b"), (3, "")], "i int, t string")
    aliases = spark.createDataFrame([(1, "a b c"), (2, "b"), (3, "")], "k int, p string")
    assert {(r["i"], r["k"]) for r in joins.contained(aliases, texts, "p", "t", "i").collect()} == {(1, 1), (1, 2), (2, 2)}


def test_contained_beyond_what_is_sent(spark, monkeypatch):
    monkeypatch.setattr(joins, "MOST_SENT", 0)
    test_contained_equals_brute_force(spark)


def test_nearest_is_the_same_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 8)))], "id long, v array<double>")
    q = df.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    sent = sorted(map(tuple, vector.nearest(df, q, 4).collect()))
    monkeypatch.setattr(vector, "MOST_SENT", 30)
    assert sorted(map(tuple, vector.nearest(df, q, 4).collect())) == sent and len(sent) == 40


def test_balanced_sample(spark):
    rows = spark.createDataFrame([(i, i % 7 == 0, i % 3 == 0) for i in range(300)] + [(999, None, True)], "qid int, pk boolean, ck boolean")
    own = rows.withColumn("c", F.expr("concat('C', int(pk), int(ck))"))
    got = sampling.balanced_sample(own, "qid", "pk", "ck", 40).collect()
    assert len(got) == 40 and {r["qid"] for r in got}.isdisjoint({999})
    for c in ("C10", "C01", "C11", "C00"):
        assert sum(r["c"] == c for r in got) >= 10
    assert sampling.balanced_sample(own, "qid", "pk", "ck", None).count() == 301 and sampling.balanced_sample(own, "qid", "pk", "ck", 500).count() == 301


def test_hop_count(spark):
    rows = [("['a', 'b']", 2), ("[]", 0), ("[['x', 'y'], ['z']]", 2), ("""["it's", 'b, [c]']""", 2), (r"""['it\'s']""", 1), ("('a', ['b'])", 2), ("f(x)", None), ("['a'", None), ("", None), (None, None), ("['a'] + ['b']", None)]
    df = spark.createDataFrame(rows, "p string, want int")
    assert [(r["p"], r["n"]) for r in df.select("p", build.hop_count("p").alias("n")).collect()] == rows


def test_metadata(spark):
    m = spark.range(1).select(build.with_metadata(build.metadata(a=F.lit("1"), b=F.lit(None).cast("string")), b=F.lit("2"), c=F.lit("3")).alias("m")).first()["m"]
    assert m == {"a": "1", "b": "2", "c": "3"}


def test_built_rows_are_valid(spark):
    raw = spark.createDataFrame([(1, "who?", '["x", "the x"]', "x", "y", "e1", "e2", "5", "s", "p"), (2, "", "x", "x", "y", "e", "f", "5", "s", "p")], "raw_idx long, question string, ground_truth string, memory_answer string, counter_answer string, parametric_memory_aligned_evidence string, counter_memory_aligned_evidence string, popularity string, subj string, property string")
    rows = build.builder("memory_pairs")(raw, "set-a")
    assert validate.validated(rows).count() == 2 and rows.columns == [c.strip().split(" ")[0] for c in records.ROW.replace("MAP<STRING, STRING>", "MAP").split(",")]
    assert {(r["qid"], r["ck_relation"]) for r in rows.collect()} == {("set-a-000001-param", "supportive"), ("set-a-000001-counter", "conflicting")}
    with pytest.raises(KeyError):
        build.builder("none")


def test_grid_of_heads(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v[:4].tolist(), v[4:].tolist(), int(v[0] + v[4] > 0), int(v[1] > 0), ("train", "train", "val", "test")[i % 4]) for i, v in enumerate(rng.normal(size=(600, 8)))]
    df = spark.createDataFrame(rows, "qid int, prior array<double>, cond array<double>, pk int, ck int, split string").withColumn("one", F.lit(1))
    configs = [probe.Config("K1", h, ("prior", "cond"), p) for h in ("pk", "ck") for p in ("logreg", "mlp")] + [probe.Config("K1", "one", ("prior",), "logreg")]
    scored, fits = probe.fit_grid(df, "qid", "split", configs)
    assert {(f[1], f[2]) for f in fits} == {(h, p) for h in ("pk", "ck") for p in ("logreg", "mlp")} and all(f[4] > 0.85 and len(f[5]) == 2 for f in fits)  # one class alone isn't fitted
    assert scored.count() == 4 * 150
    meta = df.select("qid", F.expr("concat('C', pk, ck)").alias("oracle_cell"), F.array(F.lit("right")).alias("ground_truth"), F.when(F.col("pk") == 1, "right").otherwise("bad").alias("pk_answer"), F.when(F.col("ck") == 1, "right").otherwise("odd").alias("ck_answer"), (F.col("qid") % 8).cast("string").alias("dataset"))
    out = probe.joint_grid(scored, meta, "qid", "dataset").collect()
    assert len({(r["pk_probe"], r["ck_probe"]) for r in out}) == 4 and all(r["a1_acc"] > 0.6 for r in out if r["dataset"] is None) and len(out) == 4 * 3


def test_newton_finds_the_least_loss():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(200, 3)), (rng.random(200) > 0.4).astype(float)
    own = probe.Logistic(x, y, 0.1)

    def loss(w):
        z = x @ w[:-1] + w[-1]
        return np.logaddexp(0, z).sum() - y @ z + 0.5 / 0.1 * w[:-1] @ w[:-1]

    assert all(loss(own.w) <= loss(own.w + d) for d in rng.normal(scale=0.01, size=(50, 4)))


def test_heads_learn(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist(), int(v[0] > 0), ("train", "train", "val", "test")[i % 4]) for i, v in enumerate(rng.normal(size=(400, 6)))]
    df = spark.createDataFrame(rows, "qid int, v array<double>, y int, split string")
    model, _, best = probe.fit_logistic(df, "v", "y", "split")
    assert best > 0.9 and probe.predict(model, df, "v").count() == 400
    p = probe.mlp_heads(df, "qid", "v", ("y",), "split", hidden=(32,), epochs=600, patience=200).toPandas()
    truth = {str(r[0]): r[2] for r in rows}
    assert len(p) == 100 and ((p["p"] > 0.5) == p["key"].map(truth)).mean() > 0.85


def test_validation_stops(spark):
    row = ("1", "d", "supportive", True, "wikidata", "natural", "rule_hardcoded", "open", None, ["a"], "a", "q", {"k": "v"}, "a", True)
    names = "qid string, dataset string, ck_relation string, ck_relation_is_core boolean, ground_truth_origin string, ck_text_origin string, ck_relation_source string, question_format string, options array<string>, ground_truth array<string>, ground_truth_text string, question string, metadata map<string,string>, ck_target_answer string, ck_target_matches_gt boolean"
    assert validate.validated(spark.createDataFrame([row], names)).count() == 1
    bad = spark.createDataFrame([(*row[:2], "odd", *row[3:])], names)
    assert [r["violations"] for r in validate.violations(bad).collect()] == [["relation", "core"]]
    with pytest.raises(Exception, match="breaks"):
        validate.validated(bad).collect()
    assert validate.dataset_summary(bad).select(F.col("has_both")).first()[0] is False


def test_vectors_are_summed_in_parts(spark):
    rows = [("a", [1.0, -2.0]), ("a", [3.0, 5.0]), ("a", None), ("a", [None, 9.0]), ("b", [4.0, 4.0]), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v array<float>").repartition(3)
    got = lambda how: {r["k"]: r["v"] for r in vector.pooled(df, "k", "v", how).collect()}
    assert got("avg") == {"a": [2.0, 1.5], "b": [4.0, 4.0], "c": None} and got("max") == {"a": [3.0, 5.0], "b": [4.0, 4.0], "c": None}
    plan = vector.pooled(df, "k", "v", "avg")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "ObjectHashAggregate" in plan
    scaled = metrics.standardised(df, "v", F.col("k") == "a").where("k = 'b'").first()["v"]
    assert np.allclose(scaled, [(4 - 2) / 1, (4 - 1.5) / 3.5])
    assert metrics.standardised(df, "v", F.col("k") == "c").where("k = 'b'").first()["v"] == [0.0, 0.0]


def test_best_so_far(spark):
    rng = np.random.default_rng(4)
    rows = [(f"k{i % 2}", i, None if i % 17 == 0 else float("nan") if i % 19 == 0 else float(x)) for i, x in enumerate(np.round(rng.normal(size=300), 1))]
    df = spark.createDataFrame(rows, "k string, i int, x double")
    for ranges in (1, 16):
        got = {r["i"]: r for r in order.best_so_far(df, ["k"], "i", "x", 5, ranges).collect()}
        for k in ("k0", "k1"):
            best, last, stopped = None, 0, False
            for place, (_, i, x) in enumerate([r for r in rows if r[0] == k], 1):
                improved = x is not None and x == x and (best is None or x > best)
                best, last = (x, place) if improved else (best, last)
                r = got[i]
                assert (r["place"], r["best"], r["improved"], r["since"], r["stopped"]) == (place, best, improved, place - last, stopped)
                stopped = stopped or place - last >= 5


def test_datasets_and_models_are_checked(spark):
    df = spark.createDataFrame([("d", "supportive"), ("d", "conflicting"), ("e", "supportive")], "dataset string, ck_relation string")
    assert validate.checked_summary(df.where("dataset = 'd'"), "d").count() == 1
    with pytest.raises(Exception, match="no rows of both relations in e"):
        validate.checked_summary(df).collect()
    with pytest.raises(Exception, match="another dataset: d"):
        validate.checked_summary(df.where("dataset = 'd'"), "x").collect()
    infer.register_model("own", 28, 3072, repo="somewhere")
    assert infer.model_spec("own")["width"] == 3072 and infer.layer_index("own", 0.5) == 14 and infer.layer_index("own", 0.875) == 24
    for bad in (lambda: infer.layer_index("own", -0.001), lambda: infer.register_model("none", 0, 1)):
        with pytest.raises(ValueError):
            bad()


def test_rounding_keeps_the_sign_of_zero(spark):
    """As DuckDB's round does: half away from zero, and -0.0 for what is negative."""
    import duckdb

    values = [-1e-7, 1e-7, -4.9999999e-7, -5e-7, 0.0078125, -0.0078125, -0.0, 0.0, 1.0000005, -2.5e-6, 0.1234565, float("inf"), float("-inf"), float("nan"), None, 123456.7890125]
    got = [r["v"] for r in spark.createDataFrame(list(enumerate(values)), "i int, x double").select("i", vector.rounded("x").alias("v")).orderBy("i").collect()]
    con = duckdb.connect()
    assert [str(x) for x in got] == [str(con.execute("select round(?::double, 6)", [x]).fetchone()[0]) for x in values]


def test_a_word_is_hashed_once(monkeypatch):
    """The stand-ins keep what they know of a word, so texts of known words cost no digests."""
    import hashlib
    import types

    from arbiterq.operators import embed

    seen = []
    own = types.SimpleNamespace(md5=lambda b: seen.append(b) or hashlib.md5(b), shake_128=hashlib.shake_128)
    monkeypatch.setattr(states, "hashlib", own)
    monkeypatch.setattr(embed, "hashlib", own)
    words = [f"of-{i % 7}-{os.getpid()}" for i in range(700)]
    encoder = states.Hashed(1, 2, 1024)
    want = [int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "little") % 1024 for w in words]
    assert encoder.tokens(" ".join(words)) == want and len(seen) == 7
    v = embed.Slots().embed([" ".join(words), ""])
    assert len(seen) == 14 and v.sum() == 700 and v.shape == (2, 16) and all(v[0, int(hashlib.md5(w.encode()).hexdigest()[0], 16)] for w in words)
