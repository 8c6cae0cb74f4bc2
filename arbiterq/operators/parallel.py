"""Heads trained over all rows: every step is a job in which each task sums up what its own rows say, and only sums meet.

Logistic regression takes full-batch steps, Newton's or plain gradient's: a task gives one vector (count, loss, slope, curvature), vectors are added
up by key in the JVM and, a few of them, on the driver. An MLP takes an epoch a job: each task goes through its rows in batches from the common
weights, and the tasks' weights and moments are averaged by their numbers of rows; with one task this is ``probe.fit_mlp`` to the last bit. What
is sent or gathered has the size of the head, whatever the number of rows. A lost executor costs its tasks' part of one step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import concat_features, doubles, full, moments
from .metrics import auroc
from .probe import DECAY, DROPOUT, EPOCHS, HIDDEN, PATIENCE, PENALTIES, PENALTY, SHAPES, STOPPING, SWEEP_EPOCHS, SWEEP_PATIENCE, Config, Mlp, epoch_of, start_of

#: Numbers that a task holds as a matrix (256 MB).
CELLS = 32_000_000


def rows_of(df: DataFrame, vec: str, label: str) -> DataFrame:
    """(v, y) of the rows that have both; vectors with a null component take no part."""
    return df.where(full(vec) & F.col(label).isNotNull()).select(doubles(vec).alias("v"), F.col(label).cast("double").alias("y"))


def matrix_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    v, y = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1), y


def total(rows: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]) -> np.ndarray | None:
    """The sum of the vectors that ``part`` makes of each task's batches; None if no task has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = part(b for b in batches if b.num_rows)
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 64], pa.int32()), pa.array([own.tolist()])], ["bucket", "v"])

    sums = rows.mapInArrow(run, "bucket int, v array<double>").groupBy("bucket").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).collect()  # 64 at most
    return np.sum([r["v"] for r in sorted(sums, key=lambda r: r["bucket"])], axis=0) if sums else None


@dataclass
class Scale:
    mean: np.ndarray
    dev: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / np.where(self.dev > 0, self.dev, 1.0)


def scale_of(df: DataFrame, vec: str) -> Scale | None:
    row = moments(df, vec).first()
    return Scale(np.array(row["mean"]), np.array(row["dev"])) if row else None


@dataclass
class Logistic:
    """Weights, the bias last; ``trace``: the loss before each step."""

    w: np.ndarray
    scale: Scale | None
    trace: list[float]

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = self.scale(x) if self.scale else x
        return 1 / (1 + np.exp(-np.clip(x @ self.w[:-1] + self.w[-1], -30, 30)))


def fit_logistic(df: DataFrame, vec: str, label: str, c: float = 1.0, steps: int = 50, rate: float | None = None, scaled: bool = False, tolerance: float = 1e-8) -> Logistic | None:
    """Full-batch logistic regression over all rows of ``df``, the squared weights but not the bias held down by 1 / (2 c). Without ``rate`` the
    steps are Newton's, until none is larger than ``tolerance``; with it they are so many of the mean gradient's. None without rows."""
    rows = rows_of(df, vec, label).persist()
    try:
        first = rows.select(F.size("v").alias("n")).first()
        if first is None:
            return None
        width, scale, newton = first["n"], scale_of(df.where(F.col(label).isNotNull()), vec) if scaled else None, rate is None
        hold, w, trace = np.append(np.full(width, 1 / c), 0.0), np.zeros(width + 1), []

        def part_of(w: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]:
            def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
                out = None
                for batch in batches:
                    x, y = matrix_of(batch)
                    own = np.hstack([scale(x) if scale else x, np.ones((len(y), 1))])
                    z = np.clip(own @ w, -30, 30)
                    p = 1 / (1 + np.exp(-z))
                    new = [np.array([len(y), (np.logaddexp(0, z) - y * z).sum()]), own.T @ (p - y)]
                    if newton:
                        new.append(((own * (p * (1 - p))[:, None]).T @ own).ravel())
                    new = np.concatenate(new)
                    out = new if out is None else out + new
                return out

            return part

        for _ in range(steps):
            sums = total(rows, part_of(w))
            slope = sums[2 : width + 3] + hold * w
            trace.append(float(sums[1] + (hold * w * w).sum() / 2))
            if newton:
                step = np.linalg.solve(sums[width + 3 :].reshape(width + 1, width + 1) + np.diag(hold + 1e-9), slope)
            else:
                step = rate * slope / sums[0]
            w = w - step
            if newton and np.abs(step).max() < tolerance:
                break
        return Logistic(w, scale, trace)
    finally:
        rows.unpersist()


@dataclass
class Net:
    net: Mlp
    scale: Scale
    trace: list[float]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.net.forward(self.scale(x))[0]


def fit_mlp(train: DataFrame, val: DataFrame, vec: str, label: str, hidden: tuple[int, ...] = HIDDEN, epochs: int = EPOCHS, patience: int = PATIENCE, seed: int = 0, dropout: float = DROPOUT, decay: float = DECAY, tasks: int | None = None) -> Net | None:
    """An MLP over all rows of ``train``, until the AUROC of all rows of ``val`` has not risen for ``patience`` epochs; the best epoch's weights.

    Rows are dealt to ``tasks`` by their hash, each with at most CELLS numbers; None if there are no rows. The AUROC is the distributed one."""
    rows = rows_of(train, vec, label)
    n, width = rows.count(), (rows.select(F.size("v").alias("n")).first() or {"n": 0})["n"]
    if not n:
        return None
    tasks = tasks or max(1, -(-n * width // CELLS))
    dealt = rows.repartition(tasks, F.xxhash64("v")).sortWithinPartitions(F.xxhash64("v"), "y").persist()
    checked = rows_of(val, vec, label).persist()
    scale = scale_of(train.where(F.col(label).isNotNull()), vec)
    net = Mlp(width, hidden, seed)
    state = start_of(net)
    shapes = [a.shape for a in state.params]
    best, kept, since, trace = -1.0, [a.copy() for a in state.params], 0, []
    try:
        for k in range(epochs):
            flat = np.concatenate([a.ravel() for a in (*state.params, *state.m, *state.v)])
            sent = train.sparkSession.sparkContext.broadcast((flat, state.t))

            def part(batches: Iterator[pa.RecordBatch], k: int = k, sent=sent) -> np.ndarray | None:
                own = [matrix_of(b) for b in batches]
                if not own:
                    return None
                x, y = scale(np.concatenate([a for a, _ in own])), np.concatenate([b for _, b in own])
                local = start_of(Mlp(width, hidden, seed))
                local.load(*sent.value)
                epoch_of(local, x, y, np.random.default_rng([seed, k, TaskContext.get().partitionId()]), dropout, decay)
                return np.concatenate([[len(y), len(y) * local.t], len(y) * local.flat()])

            sums = total(dealt, part)
            sent.destroy()
            state.load(sums[2:] / sums[0], round(sums[1] / sums[0]))
            now = validated(checked, Net(net, scale, trace))
            trace.append(now)
            best, kept, since = (now, [a.copy() for a in state.params], 0) if now > best else (best, kept, since + 1)
            if since >= patience:
                break
    finally:
        dealt.unpersist()
        checked.unpersist()
    for a, own, shape in zip(state.params, kept, shapes, strict=True):
        a[...] = own.reshape(shape)
    return Net(net, scale, trace)


def scores(rows: DataFrame, model: Logistic | Net, name: str = "p") -> DataFrame:
    """(y, p) of rows (v, y)."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = matrix_of(batch)
                yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(sent.value.predict(x))], ["y", name])

    return rows.select("v", "y").mapInArrow(run, f"y double, {name} double")


def validated(rows: DataFrame, model: Net) -> float:
    row = auroc(scores(rows, model), "p", "y").first()
    return float(row["auroc"] or 0.0) if row else 0.0


def fit_grid(df: DataFrame, key: str, split: str, configs: list[Config], seed: int = 42) -> tuple[DataFrame, list[tuple]]:
    """``probe.fit_grid`` over all rows, without a limit: ((config, head, probe, key, p) of the rows whose split is neither train nor val,
    [(config, head, probe, setting, validation AUROC, trace)]).

    Configurations are fitted one after the other, each with the whole cluster. The sweep of MLPs stops by the AUROC of a tenth of the
    training rows, chosen by the digest of their keys. A head with one class in training, or no validation row, isn't fitted."""
    fits, parts = [], []
    for c in configs:
        own = df.where(F.col(c.head).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(split).alias("split"), concat_features(*c.vectors).alias("v"), F.col(c.head).cast("double").alias("y"))
        train, val = own.where("split = 'train'"), own.where("split = 'val'")
        seen = train.agg(F.min("y").alias("least"), F.max("y").alias("most")).first()
        if seen["least"] is None or seen["least"] == seen["most"] or not val.limit(1).count():
            continue
        checked, trace, best = rows_of(val, "v", "y"), [], None
        for setting, model in _settings(c.probe, train, val, seed):
            got = validated(checked, model)
            trace.append((setting, got))
            if best is None or got > best[2]:
                best = (model, setting, got)
        fits.append((c.name, c.head, c.probe, best[1], best[2], trace))
        wanted = df.where(f"coalesce(`{split}`, '') not in ('train', 'val')").select(F.col(key).cast("string").alias("key"), concat_features(*c.vectors).alias("v"))
        parts.append(keyed(wanted.where(full("v")), best[0]).select(F.lit(c.name).alias("config"), F.lit(c.head).alias("head"), F.lit(c.probe).alias("probe"), "key", "p"))
    if not parts:
        return df.sparkSession.createDataFrame([], "config string, head string, probe string, key string, p double"), fits
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, fits


def _settings(kind: str, train: DataFrame, val: DataFrame, seed: int) -> Iterator[tuple[str, Logistic | Net]]:
    if kind == "logreg":
        yield from ((f"C={c}", fit_logistic(train, "v", "y", c, scaled=True)) for c in PENALTIES)
    elif kind == "mlp":
        tenth = F.crc32(F.col("key").cast("binary")) % round(1 / STOPPING) == 0
        n = max(1, train.count())
        for h in SHAPES:
            yield f"layers={h}", fit_mlp(train.where(~tenth), train.where(tenth), "v", "y", h, SWEEP_EPOCHS, SWEEP_PATIENCE, seed, 0.0, PENALTY / n)
    elif kind == "dropout":
        yield f"layers={HIDDEN}", fit_mlp(train, val, "v", "y", HIDDEN, seed=seed)
    else:
        raise KeyError(f"no probe {kind!r}")


def keyed(rows: DataFrame, model: Logistic | Net) -> DataFrame:
    """(key, p) of rows (key, v)."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.predict(x))], ["key", "p"])

    return rows.select("key", "v").mapInArrow(run, "key string, p double")
