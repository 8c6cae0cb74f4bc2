"""Reliability heads over feature vectors: logistic regression by Spark ML, small MLPs in numpy, one task a head and configuration."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import predicted_cell, routed_answer
from .metrics import auroc, cube, metrics, tallied

#: The inverse penalties of the sweep, and the MLP's settings.
PENALTIES = (0.01, 0.1)
HIDDEN, DROPOUT, RATE, DECAY, BATCH, EPOCHS, PATIENCE = (512, 128), 0.2, 1e-3, 1e-4, 256, 80, 10
#: Fixed values of the MLP sweep: layers, penalty, share of the training rows that stops it, epochs and patience.
SHAPES, PENALTY, STOPPING, SWEEP_EPOCHS, SWEEP_PATIENCE = ((256,), (256, 64)), 0.01, 0.1, 200, 10
#: Rows on which a head trains, in one task; by draw.
MOST_ROWS = 200_000


def fit_logistic(df: DataFrame, vec: str, label: str, split: str, penalties: tuple[float, ...] = PENALTIES):
    """(model, penalty, validation AUROC): the penalty with the best AUROC on split = 'val', the first of equals; trained on 'train'."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    own = df.select(array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("features"), F.col(label).cast("double").alias("label"), split)
    train, val = own.where(F.col(split) == "train"), own.where(F.col(split) == "val")
    n, best = max(1, train.count()), None
    for c in penalties:
        model = LogisticRegression(regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=100).fit(train)
        scored = model.transform(val).select(F.get(vector_to_array("probability"), F.lit(1)).alias("p"), "label")
        area = auroc(scored, "p", "label").first()["auroc"]
        if best is None or (area or 0.0) > best[2]:
            best = (model, c, area or 0.0)
    return best


def predict(model, df: DataFrame, vec: str, name: str = "p") -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array

    out = model.transform(df.withColumn("features", array_to_vector(F.transform(vec, lambda x: x.cast("double")))))
    return out.withColumn(name, F.get(vector_to_array("probability"), F.lit(1))).drop("features", "rawPrediction", "probability", "prediction")


class Mlp:
    """ReLU layers, dropout in training, logistic output; Adam with decoupled weight decay."""

    def __init__(self, width: int, hidden: tuple[int, ...], seed: int) -> None:
        self.rng = np.random.default_rng(seed)
        sizes = [width, *hidden, 1]
        self.w = [self.rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:], strict=False)]
        self.b = [np.zeros(b) for b in sizes[1:]]

    def forward(self, x: np.ndarray, dropout: float = 0.0) -> tuple[np.ndarray, list, list]:
        inputs, masks = [x], []
        for w, b in zip(self.w[:-1], self.b[:-1], strict=True):
            h = np.maximum(inputs[-1] @ w + b, 0)
            keep = (self.rng.random(h.shape) >= dropout) / (1 - dropout) if dropout else np.ones(1)
            masks.append((h > 0) * keep)
            inputs.append(h * keep)
        z = np.clip((inputs[-1] @ self.w[-1] + self.b[-1])[:, 0], -30, 30)
        return 1 / (1 + np.exp(-z)), inputs, masks

    def gradients(self, x: np.ndarray, y: np.ndarray, dropout: float) -> list[np.ndarray]:
        p, inputs, masks = self.forward(x, dropout)
        d, gw, gb = ((p - y) / len(y))[:, None], [], []
        for i in range(len(self.w) - 1, -1, -1):
            gw.insert(0, inputs[i].T @ d)
            gb.insert(0, d.sum(axis=0))
            if i:
                d = (d @ self.w[i].T) * masks[i - 1]
        return [*gw, *gb]


def area(p: np.ndarray, y: np.ndarray) -> float:
    pos = int(y.sum())
    if not 0 < pos < len(y):
        return 0.0
    rank = pd.Series(p).rank().to_numpy()
    return float((rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos)))


@dataclass
class Training:
    """A net's weights and the moments of Adam, after ``t`` steps."""

    net: Mlp
    params: list[np.ndarray]
    m: list[np.ndarray]
    v: list[np.ndarray]
    t: int = 0

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in (*self.params, *self.m, *self.v)])

    def load(self, flat: np.ndarray, t: int) -> None:
        at = 0
        for a in (*self.params, *self.m, *self.v):
            a[...] = flat[at : at + a.size].reshape(a.shape)
            at += a.size
        self.t = t


def start_of(net: Mlp) -> Training:
    params = [*net.w, *net.b]
    return Training(net, params, [np.zeros_like(a) for a in params], [np.zeros_like(a) for a in params])


def epoch_of(state: Training, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, dropout: float, decay: float) -> None:
    """One pass over the rows in batches, in an order and with a dropout drawn from ``rng``."""
    state.net.rng = rng
    for at in np.array_split(rng.permutation(len(x)), max(1, -(-len(x) // BATCH))):
        state.t += 1
        t = state.t
        for k, g in enumerate(state.net.gradients(x[at], y[at], dropout)):
            m, v, p = state.m[k], state.v[k], state.params[k]
            m[...], v[...] = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p -= RATE * ((m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) + decay * p)


def fit_mlp(x: np.ndarray, y: np.ndarray, xv: np.ndarray, yv: np.ndarray, hidden: tuple[int, ...] = HIDDEN, epochs: int = EPOCHS, patience: int = PATIENCE, seed: int = 0, dropout: float = DROPOUT, decay: float = DECAY, score=None) -> tuple[Mlp, float]:
    """Trains until the validation score (AUROC if not given) has not risen for ``patience`` epochs; gives the best epoch's weights."""
    net = Mlp(x.shape[1], hidden, seed)
    state = start_of(net)
    best, kept, since = -1.0, [a.copy() for a in state.params], 0
    for k in range(epochs):
        epoch_of(state, x, y, np.random.default_rng([seed, k, 0]), dropout, decay)
        now = (score or area)(net.forward(xv)[0], yv)
        best, kept, since = (now, [a.copy() for a in state.params], 0) if now > best else (best, kept, since + 1)
        if since >= patience:
            break
    for a, own in zip(state.params, kept, strict=True):
        a[...] = own
    return net, best


def mlp_heads(df: DataFrame, key: str, vec: str, labels: tuple[str, ...], split: str, most_rows: int = MOST_ROWS, **how) -> DataFrame:
    """(head, key, p): each head's MLP, fitted on 'train' with 'val', over all rows of 'test'; standardised on 'train'.

    A head trains in one task, on at most ``most_rows`` rows by draw, which bounds its memory. The fitted heads (one blob each)
    are sent to all tasks, which score the test rows where they are.
    """
    own = df.select(F.col(key).cast("string").alias("key"), F.col(vec).alias("v"), F.col(split).alias("split"), *labels)
    heads = F.explode(F.array(*(F.struct(F.lit(h).alias("head"), F.col(h).cast("double").alias("y")) for h in labels))).alias("x")
    few = own.where("split in ('train', 'val')").withColumn("turn", F.md5("key")).orderBy("turn").limit(most_rows)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x, y, s = np.stack(part["v"]).astype(float), part["y"].to_numpy(), part["split"].to_numpy()
        mean, dev = x[s == "train"].mean(axis=0), x[s == "train"].std(axis=0)
        dev = np.where(dev > 0, dev, 1)
        x = (x - mean) / dev
        net, _ = fit_mlp(x[s == "train"], y[s == "train"], x[s == "val"], y[s == "val"], **how)
        return pd.DataFrame({"head": [part["head"].iloc[0]], "net": [pickle.dumps((mean, dev, net))]})

    fitted = few.select("key", "v", "split", heads).select("x.head", "key", "v", "split", "x.y").groupBy("head").applyInPandas(run, "head string, net binary").collect()
    sent = df.sparkSession.sparkContext.broadcast({r["head"]: bytes(r["net"]) for r in fitted})

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nets = {h: pickle.loads(b) for h, b in sent.value.items()}
        for part in parts:
            x = np.stack(part["v"]).astype(float) if len(part) else np.zeros((0, 1))
            for h, (mean, dev, net) in nets.items():
                if len(part):
                    yield pd.DataFrame({"head": h, "key": part["key"], "p": net.forward((x - mean) / dev)[0]})

    return own.where("split = 'test'").select("key", "v").mapInPandas(score, "head string, key string, p double")


class Logistic:
    """Logistic regression with the squared weights, but not the bias, held down by 1 / (2 C); fitted by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray, c: float, steps: int = 50) -> None:
        own = np.hstack([x, np.ones((len(x), 1))])
        hold = np.append(np.full(x.shape[1], 1 / c), 0.0)
        self.w = np.zeros(own.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(own @ self.w, -30, 30)))
            slope = own.T @ (p - y) + hold * self.w
            step = np.linalg.solve((own * (p * (1 - p))[:, None]).T @ own + np.diag(hold + 1e-9), slope)
            self.w -= step
            if np.abs(step).max() < 1e-8:
                break

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.w[:-1] + self.w[-1], -30, 30)))


class Net:
    def __init__(self, net: Mlp) -> None:
        self.net = net

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.net.forward(x)[0]


def swept(kind: str, x: np.ndarray, y: np.ndarray, xv: np.ndarray, yv: np.ndarray, seed: int = 42) -> tuple[object, str, float, list]:
    """(model, setting, validation AUROC, trace) of the setting with the best AUROC on the validation rows, the first of equals.

    kind: logreg, over PENALTIES; mlp, over SHAPES, stopped by the accuracy on a tenth of the training rows; dropout, of one shape,
    stopped by the validation AUROC.
    """
    trace, best = [], None

    def accuracy(p: np.ndarray, t: np.ndarray) -> float:
        return float(((p >= 0.5) == t).mean()) if len(t) else 0.0

    if kind == "logreg":
        made = ((f"C={c}", Logistic(x, y, c)) for c in PENALTIES)
    elif kind == "mlp":
        order = np.random.default_rng(seed).permutation(len(x))
        stop, fit = order[: max(1, int(len(x) * STOPPING))], order[max(1, int(len(x) * STOPPING)) :]
        made = ((f"layers={h}", Net(fit_mlp(x[fit], y[fit], x[stop], y[stop], h, SWEEP_EPOCHS, SWEEP_PATIENCE, seed, 0.0, PENALTY / max(1, len(fit)), accuracy)[0])) for h in SHAPES)
    elif kind == "dropout":
        made = ((f"layers={h}", Net(fit_mlp(x, y, xv, yv, h, seed=seed)[0])) for h in (HIDDEN,))
    else:
        raise KeyError(f"no probe {kind!r}")
    for setting, model in made:
        got = area(model.predict(xv), yv)
        trace.append((setting, got))
        if best is None or got > best[2]:
            best = (model, setting, got)
    return (*best, trace)


@dataclass(frozen=True)
class Config:
    """A head to fit: the label, the vectors that are put side by side, each scaled on its own, and the kind of probe."""

    name: str
    head: str
    vectors: tuple[str, ...]
    probe: str = "dropout"


def fit_grid(df: DataFrame, key: str, split: str, configs: list[Config], most_rows: int = MOST_ROWS, seed: int = 42) -> tuple[DataFrame, list[tuple]]:
    """((config, head, probe, key, p) of all rows whose split is neither train nor val, [(config, head, probe, setting, validation AUROC, trace)]).

    A configuration is fitted in one task, on at most ``most_rows`` rows by draw; the fitted models, one blob a configuration, are sent to all
    tasks, which score the rows where they are. A head with one class in training, or no validation row, isn't fitted.
    """
    vectors = sorted({v for c in configs for v in c.vectors})
    heads = sorted({c.head for c in configs})
    own = df.select(F.col(key).cast("string").alias("__key"), F.col(split).alias("__split"), *(F.col(v).alias(f"v_{v}") for v in vectors), *(F.col(h).cast("double").alias(f"y_{h}") for h in heads))
    few = own.where("__split in ('train', 'val')").orderBy(F.md5("__key"), "__key").limit(most_rows)
    each = few.crossJoin(F.broadcast(df.sparkSession.createDataFrame([(i,) for i in range(len(configs))], "__config int")))  # a row a configuration

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        i = int(part["__config"].iloc[0])
        c, s = configs[i], part["__split"].to_numpy()
        there = part[f"y_{c.head}"].notna().to_numpy()
        train, val = (s == "train") & there, (s == "val") & there
        y = part[f"y_{c.head}"].to_numpy(float)
        if not train.any() or not val.any() or y[train].min() == y[train].max():
            return pd.DataFrame({"config": pd.Series([], dtype="int32"), "blob": pd.Series([], dtype=object)})
        scales, columns = [], []
        for v in c.vectors:
            x = np.stack(part[f"v_{v}"]).astype(float)
            dev = x[train].std(axis=0)
            scales.append((x[train].mean(axis=0), np.where(dev > 0, dev, 1.0)))
            columns.append((x - scales[-1][0]) / scales[-1][1])
        x = np.hstack(columns)
        return pd.DataFrame({"config": [i], "blob": [pickle.dumps((scales, *swept(c.probe, x[train], y[train], x[val], y[val], seed)))]})

    blobs = {r["config"]: bytes(r["blob"]) for r in each.groupBy("__config").applyInPandas(fit, "config int, blob binary").collect()}  # one a configuration
    sent = df.sparkSession.sparkContext.broadcast(blobs)

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = {i: pickle.loads(b) for i, b in sent.value.items()}
        for part in parts:
            for i, (scales, model, *_) in models.items():
                c = configs[i]
                if len(part):
                    x = np.hstack([(np.stack(part[f"v_{v}"]).astype(float) - m) / d for v, (m, d) in zip(c.vectors, scales, strict=True)])
                    yield pd.DataFrame({"config": c.name, "head": c.head, "probe": c.probe, "key": part["__key"], "p": model.predict(x)})

    fits = [(configs[i].name, configs[i].head, configs[i].probe, *pickle.loads(b)[2:]) for i, b in sorted(blobs.items())]
    return own.where("__split not in ('train', 'val')").mapInPandas(score, "config string, head string, probe string, key string, p double"), fits


def joint_grid(scored: DataFrame, rows: DataFrame, key: str, *by: str, heads: tuple[str, str] = ("pk", "ck"), abstain: str = "") -> DataFrame:
    """The metric block of each configuration and pair of probes, over all rows and by the columns ``by``; scored: as from ``fit_grid``.

    rows: (key, oracle_cell, ground_truth, pk_answer, ck_answer). The predicted cell follows from both probabilities and routes the answer.
    """
    pk, ck = (scored.where(F.col("head") == h).select("config", F.col("probe").alias(f"{n}_probe"), "key", F.col("p").alias(f"p_{n}")) for h, n in zip(heads, ("pk", "ck"), strict=True))
    both = pk.join(ck, ["config", "key"]).join(rows.withColumn("key", F.col(key).cast("string")), "key")
    said = both.withColumn("predicted_cell", predicted_cell("p_pk", "p_ck"))
    said = tallied(said.withColumn("answer", routed_answer("predicted_cell", "pk_answer", "ck_answer", abstain)))
    keys = ("config", "pk_probe", "ck_probe")
    out = metrics(cube(said, *keys, *by), *keys)
    return out if not by else out.withColumns({c: F.lit(None).cast("string") for c in by}).unionByName(metrics(cube(said, *keys, *by), *keys, *by))
