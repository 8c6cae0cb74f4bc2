"""Model calls: once each, also after failures; bounds in a task and in the job; batches by size, length and time; a chat server."""

import glob
import http.server
import json
import os
import sys
import threading
import time
import uuid
from collections import Counter

import pandas as pd
import pytest
from pyspark import cloudpickle

from arbiterq.operators import calls, infer

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests


class Logged(calls.Echo):
    """Writes a file a batch with the prompts that it replied to and when; ``fail`` names a file whose absence makes one batch fail."""

    def __init__(self, folder, fail=None, pause=0.0):
        self.folder, self.fail, self.pause = folder, fail, pause

    def reply(self, prompts, call):
        if self.fail and not os.path.exists(self.fail) and any("17" in p[-1][1] for p in prompts):
            open(self.fail, "w").close()
            raise RuntimeError("the worker dies")
        began = time.time()
        time.sleep(self.pause)
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            json.dump({"prompts": [p[-1][1] for p in prompts], "key": call.key, "began": began, "ended": time.time()}, f)
        return super().reply(prompts, call)


def log(folder):
    return [json.load(open(p)) for p in glob.glob(f"{folder}/*")]


def some_rows(spark):
    rows = [(str(i), f"who {i}", f"passage {i} says {i}" if i < 200 else "", [str(i)]) for i in range(300)]
    return spark.createDataFrame(rows + rows[:50], "qid string, question string, ck_text string, ground_truth array<string>")


NO_CACHE = "question_hash string, pk_answer string"


def test_each_call_is_made_once(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    out = infer.labelled(some_rows(spark), spark.createDataFrame([], NO_CACHE), lambda: Logged(str(folder)))
    first, again = sorted(map(tuple, out.collect())), sorted(map(tuple, out.collect()))
    assert first == again and len(first) == 350
    asked = Counter(p for x in log(folder) for p in x["prompts"])
    assert len(asked) == 500 and set(asked.values()) == {1}


def test_a_failed_task_costs_what_was_in_flight(spark, tmp_path):
    folder, ledger = tmp_path / "log", calls.Ledger(f"file://{tmp_path}/ledger")
    folder.mkdir()
    make, policy = (lambda: Logged(str(folder), f"{tmp_path}/failed")), calls.Policy(batch=4)
    cache = spark.createDataFrame([], NO_CACHE)
    with pytest.raises(Exception, match="the worker dies"):
        infer.labelled(some_rows(spark), cache, make, ledger, policy=policy)
    before = sum(len(x["prompts"]) for x in log(folder))
    assert 0 < before < 500
    infer.labelled(some_rows(spark), cache, make, ledger, policy=policy).collect()
    asked = Counter(p for x in log(folder) for p in x["prompts"])
    assert len(asked) == 500 and set(asked.values()) == {1}
    rows = ledger.entries(spark).count()
    assert rows == 500 and ledger.compact(spark) == 500 and len(glob.glob(f"{tmp_path}/ledger/**/*.parquet", recursive=True)) < 5
    infer.labelled(some_rows(spark), cache, make, ledger, policy=policy).collect()
    assert sum(len(x["prompts"]) for x in log(folder)) == 500


def test_a_task_tried_again_takes_what_it_committed(tmp_path, monkeypatch):
    folder = tmp_path / "log"
    folder.mkdir()
    monkeypatch.setattr(calls.TaskContext, "get", classmethod(lambda c: type("T", (), {"partitionId": lambda self: 3})()))
    call = {"model": "stub", "max_tokens": 64, "temperature": 0.0, "seed": 42, "repetition": 1.0}
    part = pd.DataFrame({"call_key": [str(i) for i in range(40)], "prompt": [f"p {i}" for i in range(40)], "__call": [call] * 40})
    make, policy = (lambda: Logged(str(folder), f"{tmp_path}/failed")), calls.Policy(batch=5)
    with pytest.raises(RuntimeError):
        list(calls.committed(iter([part]), str(tmp_path / "ledger"), "run", make, policy))
    assert [n["n"].sum() for n in calls.committed(iter([part]), str(tmp_path / "ledger"), "run", make, policy)][0] < 40
    asked = Counter(p for x in log(folder) for p in x["prompts"])
    assert len(asked) == 40 and set(asked.values()) == {1}


def test_errors_are_asked_again_and_rows_share_replies(spark, tmp_path):
    ledger, broken = calls.Ledger(f"{tmp_path}/ledger"), tmp_path / "broken"
    broken.touch()
    path = str(broken)

    class Moody(calls.Echo):
        def reply(self, prompts, call):
            if os.path.exists(path) and any("bad" in p[-1][1] for p in prompts):
                raise calls.Refused(400, "not now")
            return [calls.Reply(f"{p[-1][1]} {call.seed} {call.max_tokens}") for p in prompts]

    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "good", 1), (2, "bad", 1), (3, "good", 1), (4, "good", 2)], "i int, p string, s int")
    own = lambda: {r["i"]: (r["reply"], r["error"]) for r in ledger.asked(df, "p", Moody, seed=F.col("s"), max_tokens=7).collect()}
    got = own()
    assert got[2][0] is None and got[2][1].startswith("ERROR: 400") and got[1] == got[3] == ("good 1 7", None) and got[4][0] == "good 2 7"
    broken.unlink()
    assert own()[2] == ("bad 1 7", None) and ledger.entries(spark).count() == 3


def test_bounds_hold_for_the_job(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    df = spark.createDataFrame([(i, f"p {i}") for i in range(48)], "i int, p string").repartition(12)
    for policy in (calls.Policy(keys=("a",), batch=2, job_wide=True), calls.Policy(keys=("a", "b"), per_key=2, threads=2, batch=2, job_wide=True)):
        for f in folder.iterdir():
            f.unlink()
        assert calls.generated(df, "p", lambda: Logged(str(folder), pause=0.03), policy).where("error is null").count() == 48
        seen = log(folder)
        for key in policy.keys:
            own = [x for x in seen if x["key"] == key]
            ends = sorted([(x["began"], 1) for x in own] + [(x["ended"], -1) for x in own])
            now = most = 0
            for _, step in ends:
                now += step
                most = max(most, now)
            assert 0 < most <= policy.per_key
    assert policy.tasks() == 2 and [policy.lanes_of(t) for t in (0, 1)] == [["a", "b"], ["a", "b"]]


def test_a_rate_is_shared_by_the_lanes():
    waits = []
    policy = calls.Policy(keys=("a",), per_key=2, rate=10.0, batch=1)
    with calls.Lanes(policy, calls.Echo(), None, waits.append) as lanes:
        lanes.replies([[("user", str(i))] for i in range(6)], [calls.Call()] * 6)
    assert len(waits) == 4 and all(0 < w <= 0.4 for w in waits)


def test_batches_by_length_and_budget():
    prompts = [[("user", "w " * n)] for n in (1, 50, 2, 49, 3, 400)]
    a, b = calls.Call(), calls.Call(seed=1)
    policy = calls.Policy(batch=3, tokens=120)
    assert policy.batches(prompts, [a] * 6) == [[0, 2, 4], [3, 1], [5]]
    assert policy.batches(prompts, [a, b, a, b, a, a]) == [[0, 2, 4], [5], [3, 1]]
    with calls.Lanes(policy, calls.Echo(), None) as lanes:
        got = lanes.replies([[("user", f"x{i}")] for i in range(20)], [a, b] * 10)
    assert [r[0] for r in got] == [f"x{i}" for i in range(20)]


def test_slow_rows_linger_in_order():
    def slowly():
        for i in range(6):
            time.sleep(0.0 if i < 3 else 0.3)
            yield pd.DataFrame({"i": [2 * i, 2 * i + 1]})

    began = time.time()
    got = [(p["i"].tolist(), time.time() - began) for p in calls.lingering(slowly(), 6, 0.1)]
    assert [x for p, _ in got for x in p] == list(range(12))
    assert got[0][0] == [0, 1, 2, 3, 4, 5] and got[0][1] < 0.2  # full: at once
    assert len(got) == 4 and all(len(p) == 2 for p, _ in got[1:])  # none waits for the next
    with pytest.raises(ZeroDivisionError):
        list(calls.lingering((pd.DataFrame({"i": [1 / (2 - i)]}) for i in range(5)), 10, 0.1))
    assert list(calls.lingering(iter([]), 5, 0.1)) == []


def test_fallbacks_end_and_a_prompt_that_says_429_is_no_limit():
    class Busy(calls.Echo):
        def reply(self, prompts, call):
            raise calls.Refused(429)

    policy = calls.Policy(retry=calls.Retry(times=0), fallback={"a": "b", "b": "a"})
    assert policy.ask(Busy(), [[("user", "x")]], calls.Call("a"))[0][1].startswith("ERROR: 429")

    class Bad(calls.Echo):
        def reply(self, prompts, call):
            raise calls.Refused(400, "rate limit 429 is what the prompt says")

    assert policy.ask(Bad(), [[("user", "x")]], calls.Call("a"))[0][2] == "a"


def test_no_thread_stays(spark):
    before = threading.active_count()
    with calls.Lanes(calls.Policy(keys=("a", "b"), per_key=4), calls.Echo(), None) as lanes:
        lanes.replies([[("user", "x")]] * 100, [calls.Call()] * 100)
    assert threading.active_count() == before


class Chat(http.server.BaseHTTPRequestHandler):
    seen: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Chat.seen.append((self.path, self.headers.get("Authorization"), body))
        said = body["messages"][-1]["content"]
        status = 503 if said == "busy" and len(Chat.seen) < 2 else 404 if said == "none" else 200
        answer = {"error": "sorry"} if status != 200 else {"choices": []} if said == "empty" else {"choices": [{"message": {"content": said.upper()}}], "usage": {"prompt_tokens": 5, "completion_tokens": 2}}
        raw = json.dumps(answer).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def log_message(self, *_):
        pass


def test_chat_server(spark, monkeypatch):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Chat)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    provider = calls.Http(f"http://127.0.0.1:{server.server_port}/v1", price_in=2.0, price_out=10.0)
    monkeypatch.setenv("CHAT_TOKEN", "secret")
    policy = calls.Policy(retry=calls.Retry(times=1, first=0.0), keys=("CHAT_TOKEN",))
    ask = lambda text: policy.ask(provider, [[("system", "s"), ("user", text)]], calls.Call("m", 9, 0.5, 3, 1.1, "CHAT_TOKEN"))[0]
    assert ask("busy") == (calls.Reply("BUSY", 5, 2, 3e-05), None, "m")
    path, token, body = Chat.seen[-1]
    assert path == "/v1/chat/completions" and token == "Bearer secret"
    assert body == {"model": "m", "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "busy"}], "max_tokens": 9, "temperature": 0.5, "seed": 3, "repetition_penalty": 1.1}
    assert ask("none")[1].startswith("ERROR: 404") and ask("empty")[1].startswith("ERROR: 502")
    got = calls.generated(spark.createDataFrame([("hello",)], "p string"), "p", lambda: provider).first()
    assert got["reply"] == "HELLO" and got["prompt_tokens"] == 5
    server.shutdown()


def test_quick_batches_share_a_file_and_slow_ones_do_not_wait(tmp_path, monkeypatch):
    monkeypatch.setattr(calls.TaskContext, "get", classmethod(lambda c: type("T", (), {"partitionId": lambda self: 0})()))
    call = {"model": "stub", "max_tokens": 64, "temperature": 0.0, "seed": 42, "repetition": 1.0}
    part = pd.DataFrame({"call_key": [str(i) for i in range(3200)], "prompt": [f"p {i}" for i in range(3200)], "__call": [call] * 3200})
    files = lambda name: glob.glob(f"{tmp_path}/{name}/**/[!_]*.parquet", recursive=True)
    assert sum(n["n"].sum() for n in calls.committed(iter([part]), f"{tmp_path}/quick", "run", calls.Echo, calls.Policy())) == 3200
    assert len(files("quick")) < 20 and sum(len(pd.read_parquet(f)) for f in files("quick")) == 3200  # a hundred batches

    class Slow(calls.Echo):
        def reply(self, prompts, call):
            if "p 4" in prompts[0][-1][1]:
                time.sleep(2.5)
                assert files("slow")  # what came before is there, though nothing came since
            return super().reply(prompts, call)

    assert sum(n["n"].sum() for n in calls.committed(iter([part[:5]]), f"{tmp_path}/slow", "run", Slow, calls.Policy(batch=1))) == 5
    assert sum(len(pd.read_parquet(f)) for f in files("slow")) == 5


def test_few_rows_are_held_ahead():
    """A reader that is slow holds a few slices, however large the parts are and however many come."""
    made = []

    def parts():
        for i in range(20):
            made.append(i)
            yield pd.DataFrame({"i": range(i * 10_000, (i + 1) * 10_000)})

    got = calls.lingering(parts(), 32, 0.05)
    first = next(got)
    time.sleep(0.3)
    assert len(first) <= 1024 and len(made) == 1
    assert [*first["i"], *(x for p in got for x in p["i"])] == list(range(200_000)) and len(made) == 20
