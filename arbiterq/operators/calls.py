"""Model calls: providers, how calls are dealt and tried again, and a ledger that keeps every reply.

A provider is any object with ``reply(prompts, call) -> list of Reply, str or None``; it is made once a task and may be called by
several threads. A prompt is a list of (role, content). ``Echo`` and ``Digest`` are deterministic stand-ins without a network, which SQL
can say as well; ``Http`` speaks to any server with the usual chat interface.
"""

from __future__ import annotations

import hashlib
import json
import os
import queue
import re
import threading
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from typing import Protocol

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Prompt = list[tuple[str, str]]


@dataclass(frozen=True)
class Call:
    """What a provider is asked for; key: the account that the call goes by."""

    model: str = "stub"
    max_tokens: int = 64
    temperature: float = 0.0
    seed: int = 42
    repetition: float = 1.0
    key: str = ""


@dataclass(frozen=True)
class Reply:
    text: str
    prompt_tokens: int = 0
    completion_tokens: int = 0
    cost: float = 0.0


class Provider(Protocol):
    def reply(self, prompts: list[Prompt], call: Call) -> list[Reply | str | None]: ...


class Echo:
    """Replies with the prompt's last line that says something: not a bare label ("Answer:"), and without a label before it. At another
    temperature than 0 its words come in the order of the md5 of seed and word."""

    def reply(self, prompts: list[Prompt], call: Call) -> list[Reply | str | None]:
        out: list[Reply | str | None] = []
        for p in prompts:
            lines = [s for s in p[-1][1].split("\n") if s.strip() and not re.fullmatch(r"\w+:\s*", s)]
            words = re.sub(r"^\w+: ", "", (lines or [""])[-1]).split()[: call.max_tokens]
            if call.temperature:
                words.sort(key=lambda w: (hashlib.md5(f"{call.seed}:{w}".encode()).hexdigest(), w))
            out.append(Reply(" ".join(words), sum(len(c.split()) for _, c in p), len(words)))
        return out


@dataclass
class Digest:
    """Replies with one of some words, by the first digit of the md5 of the last message."""

    words: tuple[str, ...] = ("YES", "NO")

    def reply(self, prompts: list[Prompt], call: Call) -> list[Reply | str | None]:
        return [self.words[int(hashlib.md5(p[-1][1].encode()).hexdigest()[0], 16) * len(self.words) // 16] for p in prompts]


class Refused(Exception):
    """A provider's error; ``status`` decides whether to try again."""

    def __init__(self, status: int, text: str = "") -> None:
        super().__init__(text or str(status))
        self.status = status


@dataclass(frozen=True)
class Http:
    """A chat server: POST {url}/chat/completions, one request a prompt. ``Call.key`` names the environment variable that holds the
    account's token on the executors; prices are a million tokens' in and out."""

    url: str
    timeout: float = 120.0
    price_in: float = 0.0
    price_out: float = 0.0

    def reply(self, prompts: list[Prompt], call: Call) -> list[Reply | str | None]:
        return [self.one(p, call) for p in prompts]

    def one(self, prompt: Prompt, call: Call) -> Reply:
        body = {"model": call.model, "messages": [{"role": r, "content": c} for r, c in prompt], "max_tokens": call.max_tokens, "temperature": call.temperature, "seed": call.seed}
        if call.repetition != 1.0:
            body["repetition_penalty"] = call.repetition
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {os.environ.get(call.key, '')}"} if call.key else {})
        request = urllib.request.Request(f"{self.url.rstrip('/')}/chat/completions", json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                got = json.load(answer)
        except urllib.error.HTTPError as e:
            raise Refused(e.code, e.read(300).decode(errors="replace")) from e
        except ValueError as e:  # not JSON: as a server's error
            raise Refused(502, str(e)) from e
        try:
            text, used = got["choices"][0]["message"]["content"] or "", got.get("usage") or {}
        except (KeyError, IndexError, TypeError) as e:
            raise Refused(502, f"no choice in the answer: {str(got)[:200]}") from e
        n_in, n_out = used.get("prompt_tokens", 0), used.get("completion_tokens", 0)
        return Reply(text, n_in, n_out, (n_in * self.price_in + n_out * self.price_out) / 1e6)


@dataclass(frozen=True)
class Retry:
    """Tries again on 429, any 5xx and network errors, waiting first, 2 * first, ... up to most; other 4xx end at once, unless
    every error is tried again. Gives the result, the error's text and its status (0 without one)."""

    times: int = 4
    first: float = 1.0
    most: float = 30.0
    every: bool = False

    def __call__(self, call: Callable[[], list], sleep: Callable[[float], None] = time.sleep) -> tuple[list | None, str | None, int]:
        error, status = None, 0
        for k in range(self.times + 1):
            try:
                return call(), None, 0
            except Refused as e:
                error, status = f"ERROR: {e.status} {e}", e.status
                if not self.every and e.status != 429 and e.status < 500:
                    break
            except (OSError, TimeoutError) as e:
                error, status = f"ERROR: {e}", 0
            if k < self.times:
                sleep(min(self.most, self.first * 2**k))
        return None, error, status


#: Of the judge: eight tries, waiting up to a minute.
JUDGE_RETRY = Retry(times=7, first=1.0, most=60.0, every=True)


@dataclass(frozen=True)
class Policy:
    """How calls are dealt.

    A call has at most ``batch`` prompts and, where ``tokens`` is given, so many white-space tokens as the longest prompt times their
    number: prompts of like length go together, as a model pads a batch to its longest. Rows that come in slowly are gathered until a
    batch is full or ``linger`` seconds have passed.
    Each of ``keys`` has at most ``per_key`` calls in flight: in a task, or with ``job_wide`` in the whole job, whose rows are then dealt to lanes,
    a key's share of which each task has; ``rate`` is a key's calls a second, shared by its lanes.
    A model that is rate-limited for good is replaced by its fallback, where it has one that was not tried. A batch that is
    refused for a reason of its own is halved until the prompt at fault stands alone.
    """

    retry: Retry = Retry()
    keys: tuple[str, ...] = ("",)
    per_key: int = 1
    batch: int = 32
    tokens: int | None = None
    linger: float = 0.05
    job_wide: bool = False
    threads: int = 1
    rate: float | None = None
    fallback: Mapping[str, str] = field(default_factory=dict)

    def lanes(self) -> int:
        return len(self.keys) * self.per_key

    def tasks(self) -> int:
        """Of a job-wide stage: each has ``threads`` lanes, the last perhaps fewer."""
        return -(-self.lanes() // self.threads)

    def lanes_of(self, task: int | None) -> list[str]:
        """The key of each lane of a task; None: every lane."""
        every = range(self.lanes()) if task is None else range(task * self.threads, min(self.lanes(), (task + 1) * self.threads))
        return [self.keys[i % len(self.keys)] for i in every]

    def ask(self, provider: Provider, prompts: list[Prompt], call: Call, sleep: Callable[[float], None] = time.sleep, tried: frozenset[str] = frozenset()) -> list[tuple[Reply | None, str | None, str]]:
        """(reply, error, model) of each prompt."""
        got, error, status = self.retry(lambda: provider.reply(prompts, call), sleep)
        if got is not None:
            return [(r if isinstance(r, Reply) or r is None else Reply(r), None, call.model) for r in got]
        tried, other = tried | {call.model}, self.fallback.get(call.model)
        if status == 429 and other is not None and other not in tried:
            return self.ask(provider, prompts, replace(call, model=other), sleep, tried)
        if len(prompts) > 1 and 400 <= status < 500 and status != 429:
            half = len(prompts) // 2
            return self.ask(provider, prompts[:half], call, sleep, tried) + self.ask(provider, prompts[half:], call, sleep, tried)
        return [(None, error, call.model)] * len(prompts)

    def batches(self, prompts: Sequence[Prompt], calls: Sequence[Call]) -> list[list[int]]:
        """The rows of each call: alike in what is asked, by length, in the bounds; a prompt over the budget goes alone."""
        by: dict[Call, list[tuple[int, int]]] = {}
        for i, (p, c) in enumerate(zip(prompts, calls, strict=True)):
            by.setdefault(c, []).append((sum(len(x.split()) for _, x in p) if self.tokens else 0, i))
        out: list[list[int]] = []
        for rows in by.values():
            own: list[int] = []
            for size, i in sorted(rows):  # ascending: the next one is the longest
                if own and (len(own) == self.batch or self.tokens and size * (len(own) + 1) > self.tokens):
                    out.append(own)
                    own = []
                own.append(i)
            out.append(own)
        return out


class Lanes:
    """The lanes of one task: a thread each, which holds its key for a call; with a rate, a lane waits between the starts of two calls."""

    def __init__(self, policy: Policy, provider: Provider, task: int | None, sleep: Callable[[float], None] = time.sleep):
        own = policy.lanes_of(task)
        self.policy, self.provider, self.sleep = policy, provider, sleep
        self.pool, self.free = ThreadPoolExecutor(max(1, len(own))), queue.SimpleQueue()
        for key in own:
            self.free.put((key, 0.0))
        self.pause = policy.per_key / policy.rate if policy.rate else 0.0

    def __enter__(self) -> Lanes:
        return self

    def __exit__(self, *_: object) -> None:
        self.pool.shutdown(cancel_futures=True)

    def one(self, prompts: list[Prompt], call: Call) -> list[tuple]:
        """ASKED of each prompt."""
        key, due = self.free.get()
        if self.pause and (wait := due - time.monotonic()) > 0:
            self.sleep(wait)
        began, start = time.time(), time.monotonic()
        try:
            got = self.policy.ask(self.provider, prompts, replace(call, key=key))
        finally:
            self.free.put((key, start + self.pause))
        took = (time.time() - began) / max(1, len(prompts))
        return [(r.text if r else None, e, took, r.prompt_tokens if r else 0, r.completion_tokens if r else 0, r.cost if r else 0.0, m, key) for r, e, m in got]

    def replies(self, prompts: list[Prompt], calls: list[Call], done: Callable[[list[int], list[tuple]], None] = lambda *_: None) -> list[tuple]:
        """ASKED of each prompt, in the order of the prompts; ``done`` gets each batch as soon as it is there, from the lane's thread."""

        def work(rows: list[int]) -> list[tuple]:
            got = self.one([prompts[i] for i in rows], calls[rows[0]])
            done(rows, got)
            return got

        out: list = [None] * len(prompts)
        jobs = [(rows, self.pool.submit(work, rows)) for rows in self.policy.batches(prompts, calls)]
        for rows, job in jobs:
            for i, got in zip(rows, job.result(), strict=True):
                out[i] = got
        return out


#: Rows that are handed to the lanes at a time, at least a batch for each, and how often that may wait beside those in work.
SLICE, AHEAD = 1024, 2


def lingering(source: Iterator[pd.DataFrame], rows: int, seconds: float) -> Iterator[pd.DataFrame]:
    """Parts of ``source`` gathered until they have so many rows or the first has waited so long; order is kept.

    A thread reads the source, so that a part that waits is not held up by one that is yet to come. It hands over ``rows`` or SLICE rows at
    a time, whichever is more, and AHEAD such slices at most: what is held doesn't follow from how large the parts or their number are."""
    inbox: queue.Queue = queue.Queue(maxsize=AHEAD)
    size = max(rows, SLICE)
    end, stopped = object(), threading.Event()

    def read() -> None:
        last: object = end
        try:
            for whole in source:
                for part in (whole.iloc[i : i + size] for i in range(0, len(whole), size)):
                    while not stopped.is_set():
                        try:
                            inbox.put(part, timeout=0.1)
                            break
                        except queue.Full:
                            continue
                    if stopped.is_set():
                        return
        except BaseException as e:  # goes on in the reader
            last = e
        while not stopped.is_set():
            try:
                inbox.put(last, timeout=0.1)
                return
            except queue.Full:
                continue

    threading.Thread(target=read, daemon=True).start()
    held: list[pd.DataFrame] = []
    due = 0.0
    try:
        while True:
            try:
                part = inbox.get(timeout=max(0.0, due - time.monotonic()) if held else None)
            except queue.Empty:
                part = None
            if isinstance(part, BaseException):
                raise part
            if isinstance(part, pd.DataFrame):
                if len(part):
                    due = due if held else time.monotonic() + seconds
                    held.append(part)
                if sum(map(len, held)) < rows:
                    continue
            if held:
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            if part is end:
                return
    finally:
        stopped.set()


ASKED = "reply string, error string, latency_sec double, prompt_tokens long, completion_tokens long, cost_usd double, model_used string, key_used string"
ASKED_NAMES = [c.split()[0] for c in ASKED.split(", ")]
#: What a call is told apart by, besides its prompt.
PARAMETERS = ("model", "max_tokens", "temperature", "seed", "repetition")
KINDS = {"model": "string", "max_tokens": "int", "temperature": "double", "seed": "int", "repetition": "double"}


def plain(p: object) -> Prompt:
    """A prompt of a column: a text, or messages of role and content."""
    return [("user", p or "")] if p is None or isinstance(p, str) else [(m["role"], m["content"] or "") for m in p]


def with_parameters(df: DataFrame, **parameters: object) -> DataFrame:
    """``df`` with a struct ``__call``; each parameter is a value, or a column: rows may differ."""
    given = {k: v for k, v in vars(Call()).items() if k in PARAMETERS} | parameters
    return df.withColumn("__call", F.struct(*((v if isinstance(v, Column) else F.lit(v)).cast(KINDS[k]).alias(k) for k, v in given.items())))


def dealt(df: DataFrame, policy: Policy, *keys: str) -> DataFrame:
    """The rows in one partition a task of a job-wide stage; else as they are."""
    return df.repartition(policy.tasks(), *keys) if policy.job_wide else df


def generated(df: DataFrame, prompt: str, make: Callable[[], Provider], policy: Policy = Policy(), **parameters: object) -> DataFrame:
    """``df`` with the columns of ASKED; prompt: a text, or an array of messages. A prompt that fails for good has no reply and its error.

    Nothing is kept: each action on the result calls again. ``Ledger.asked`` calls once."""
    own = dealt(with_parameters(df, **parameters), policy)
    fields = df.schema.fieldNames()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId() if policy.job_wide else None
        with Lanes(policy, make(), task) as lanes:
            for part in lingering(parts, policy.batch * max(1, policy.lanes()), policy.linger):
                got = lanes.replies([plain(p) for p in part[prompt]], [Call(*(c[k] for k in PARAMETERS)) for c in part["__call"]])
                yield pd.concat([part[fields], pd.DataFrame(got, columns=ASKED_NAMES, index=part.index)], axis=1)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return own.mapInPandas(run, f"{kinds}, {ASKED}")


LEDGER = f"call_key string, {ASKED}"
_SEGMENT = pa.schema([("call_key", pa.string()), ("reply", pa.string()), ("error", pa.string()), ("latency_sec", pa.float64()), ("prompt_tokens", pa.int64()), ("completion_tokens", pa.int64()), ("cost_usd", pa.float64()), ("model_used", pa.string()), ("key_used", pa.string())])


@dataclass(frozen=True)
class Ledger:
    """Replies that are kept, in a folder that the driver and all executors see: what was asked once is read, not asked again.

    A call's key is the md5 of its prompt, model, tokens, temperature, seed and repetition. ``asked`` finds the keys that no entry
    without an error has, asks them, each once, and reads everything back, so that all who use the result see the same replies and no action
    calls again. A task commits its replies as Parquet files, written under another name and renamed, a file at most each FLUSH seconds or
    FULL replies: batches that take longer are a file each, quick ones share one. When it is tried again it takes what its earlier attempt
    committed, and a later run what any run committed. So a failure costs the batches in flight, and a killed worker the replies of the last
    FLUSH seconds too. Should two attempts
    of a task run at once (speculation), a key may be asked twice; readers take the first entry without an error, by file name, for all.
    """

    path: str

    def entries(self, spark: SparkSession) -> DataFrame:
        """(LEDGER) One row a key: an entry without an error where there is one. The folders of the runs so far are named one by one: Spark
        takes two readings of one folder for the same, whatever was added in between, and reuses the former in a plan that has both."""
        runs = self.runs(spark)
        if not runs:
            return spark.createDataFrame([], LEDGER)
        kept = spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(*runs).select("*", F.input_file_name().alias("file"))
        first = F.min_by(F.struct(*ASKED_NAMES), F.struct(F.col("error").isNotNull(), "file"))
        return kept.groupBy("call_key").agg(first.alias("e")).select("call_key", "e.*")

    def runs(self, spark: SparkSession) -> list[str]:
        """The folders of the runs; the ledger's own is made if it isn't there."""
        there = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = there.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(there)
        return sorted(x.getPath().toString() for x in files.listStatus(there) if x.getPath().getName().startswith("run="))

    def asked(self, df: DataFrame, prompt: str, make: Callable[[], Provider], policy: Policy = Policy(), **parameters: object) -> DataFrame:
        """``df`` with the columns of ASKED, after every call that the ledger lacked has been made."""
        whole = with_parameters(df, **parameters)
        own = whole.withColumn("call_key", F.md5(F.to_json(F.struct(F.col(prompt).alias("p"), F.col("__call").alias("c")), {"ignoreNullFields": "false"})))
        spark = df.sparkSession
        wanted = own.select("call_key", F.col(prompt).alias("prompt"), "__call").dropDuplicates(["call_key"])
        known = self.entries(spark).where("error is null").select("call_key")
        pending = wanted.join(known, "call_key", "left_anti")
        tasks = policy.tasks() if policy.job_wide else int(spark.conf.get("spark.sql.shuffle.partitions"))
        folder, run = self.path, uuid.uuid4().hex
        calls = pending.repartition(tasks, "call_key").mapInPandas(lambda parts: committed(parts, folder, run, make, policy), "n long")
        calls.agg(F.sum("n")).first()  # a number a batch of rows
        return own.join(self.entries(spark), "call_key", "left").drop("call_key", "__call")

    def compact(self, spark: SparkSession) -> int:
        """The segments as few files, without repeated keys and errors that a later run mended; gives the number of entries. Nobody may write meanwhile."""
        self.runs(spark)
        path = self.path
        before = [f.path for f in store(path)[0].get_file_info(fs.FileSelector(store(path)[1], recursive=True)) if f.type == fs.FileType.File]
        self.entries(spark).coalesce(max(1, len(before) // 1000)).write.mode("append").parquet(f"{path}/run={uuid.uuid4().hex}")
        for p in {p.rsplit("/task=", 1)[0] if "/task=" in p else p.rsplit("/", 1)[0] for p in before}:
            store(path)[0].delete_dir(p)
        return self.entries(spark).count()


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a folder, given as a URI or a local path."""
    return fs.FileSystem.from_uri(path if re.match(r"\w+:/", path) else f"file://{os.path.abspath(path)}")


#: Seconds and replies after which a task's replies are committed.
FLUSH, FULL = 1.0, 8192


class Segments:
    """Replies of one task on their way to files of a folder; what was added is committed within FLUSH seconds, and at the end, also after an error."""

    def __init__(self, files: fs.FileSystem, folder: str) -> None:
        self.files, self.folder, self.held, self.due = files, folder, [], time.monotonic() + FLUSH
        self.lock, self.stopped, self.failed = threading.Lock(), threading.Event(), None
        self.timer = threading.Thread(target=self.watch, daemon=True)

    def __enter__(self) -> Segments:
        self.timer.start()
        return self

    def __exit__(self, *_: object) -> None:
        self.stopped.set()
        self.timer.join()
        with self.lock:
            self.commit()
        if self.failed:
            raise self.failed

    def add(self, rows: list[tuple]) -> None:
        with self.lock:
            if self.failed:
                raise self.failed
            self.held += rows
            if len(self.held) >= FULL or time.monotonic() >= self.due:
                self.commit()

    def watch(self) -> None:
        while not self.stopped.wait(FLUSH):
            with self.lock:
                try:
                    if time.monotonic() >= self.due:
                        self.commit()
                except Exception as e:  # goes on in the task
                    self.failed = e
                    return

    def commit(self) -> None:
        rows, self.held, self.due = self.held, [], time.monotonic() + FLUSH
        if rows:
            name = f"{uuid.uuid4().hex}.parquet"
            pq.write_table(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SEGMENT.types, strict=True)], schema=_SEGMENT), f"{self.folder}/_{name}", filesystem=self.files)
            self.files.move(f"{self.folder}/_{name}", f"{self.folder}/{name}")


def committed(parts: Iterator[pd.DataFrame], folder: str, run: str, make: Callable[[], Provider], policy: Policy) -> Iterator[pd.DataFrame]:
    """Ask what (call_key, prompt, __call) say, committing the replies as they come; (n): how many rows each part had."""
    task = TaskContext.get().partitionId()
    files, top = store(folder)
    own = f"{top}/run={run}/task={task:06d}"
    files.create_dir(own)
    seen: set[str] = set()
    for f in files.get_file_info(fs.FileSelector(own)):  # of an earlier attempt at this task
        if f.base_name.endswith(".parquet") and not f.base_name.startswith("_"):
            seen.update(pq.read_table(f.path, filesystem=files, columns=["call_key"])["call_key"].to_pylist())
    with Segments(files, own) as segments, Lanes(policy, make(), task if policy.job_wide else None) as lanes:  # lanes end first
        for part in lingering(parts, policy.batch * max(1, policy.lanes()), policy.linger):
            rest = part[~part["call_key"].isin(seen)] if seen else part
            keys = rest["call_key"].tolist()

            def commit(rows: list[int], got: list[tuple], keys: list[str] = keys) -> None:
                segments.add([(keys[i], *r) for i, r in zip(rows, got, strict=True)])

            lanes.replies([plain(p) for p in rest["prompt"]], [Call(*(c[k] for k in PARAMETERS)) for c in rest["__call"]], commit)
            yield pd.DataFrame({"n": [len(rest)]})
