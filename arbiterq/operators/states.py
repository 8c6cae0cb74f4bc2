"""Hidden states of prompts and traces: an encoder plugs in as a provider does; what follows from its vectors is plain arithmetic.

An encoder has ``layers`` and ``tokens(text) -> list of token numbers``, ``forward(texts) -> (states, logits)``: for each text the states as an
array [layers, tokens, width], and the logits after its last token. ``Hashed`` is a deterministic stand-in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import filled_text
from ..functions.text import text, truncate_context

#: How a choice may be written; those that are one token count.
CHOICES = {c: (f" {c}", c, f" ({c}", f"({c}", f"{c})", f" {c})", f"**{c}", f" **{c}") for c in "AB"}
#: Fixed value: tokens that an encoder takes.
MOST_TOKENS = 4096


#: Words whose numbers a stand-in keeps.
WORDS = 100_000


class Encoder(Protocol):
    layers: int

    def tokens(self, text: str) -> list[int]: ...

    def forward(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]: ...


class Hashed:
    """White-space tokens, numbered by their digest; a token's state in a layer is a unit vector from the digest of both."""

    def __init__(self, layers: int = 4, width: int = 16, vocabulary: int = 1024) -> None:
        self.layers, self.width, self.vocabulary = layers, width, vocabulary
        drawn = [[np.frombuffer(hashlib.shake_128(f"{layer}:{n}".encode()).digest(2 * width), "<i2") for n in range(vocabulary)] for layer in range(layers)]
        x = np.array(drawn, np.float32)
        self.states = x / np.maximum(np.linalg.norm(x, axis=2, keepdims=True), 1e-9)

        self.numbers = lru_cache(WORDS)(self.number)

    def number(self, word: str) -> int:
        return int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "little") % self.vocabulary

    def tokens(self, text: str) -> list[int]:
        return [*map(self.numbers, text.split())]

    def forward(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        states, logits = [], []
        for t in texts:
            own = self.tokens(t)[:MOST_TOKENS]
            states.append(self.states[:, own])
            logits.append(np.bincount(own, minlength=self.vocabulary).astype(np.float32))
        return states, logits


def choice_ids(encoder: Encoder, choice: str) -> list[int]:
    """The tokens that are one way of writing a choice each."""
    found = (encoder.tokens(v) for v in CHOICES[choice])
    return sorted({ids[0] for ids in found if len(ids) == 1})


def mass(logits: np.ndarray, ids: list[int]) -> float:
    """The probability of a set of tokens."""
    e = np.exp(logits.astype(np.float64) - logits.max())
    return float(e[ids].sum() / e.sum()) if ids else 0.0


def _with(df: DataFrame, run: Callable, more: str) -> DataFrame:
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{kinds}, {more}")


def hidden_states(df: DataFrame, make: Callable[[], Encoder], layer: int | None = None, most: int = MOST_TOKENS, batch: int = 16) -> DataFrame:
    """df (question, ck_text) with h, the state of the last token of the prompt with its context, h_nock, that of the question alone, their
    lengths and whether the context was cut. layer: from 1, the middle one if not given."""
    cut = truncate_context("question", "ck_text", most)
    own = df.withColumn("__cut", cut).withColumns({"__with": F.col("__cut.prompt"), "truncated": F.col("__cut.truncated"), "__without": text("question")}).drop("__cut")
    fields = [c for c in own.columns if c not in ("__with", "__without")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make()
        at = (encoder.layers // 2 if layer is None else layer) - 1
        for part in parts:
            new: dict[str, list] = {"h": [], "h_nock": [], "token_len": [], "token_len_nock": []}
            for start in range(0, len(part), batch):
                for source, vec, size in (("__with", "h", "token_len"), ("__without", "h_nock", "token_len_nock")):
                    for x in encoder.forward(part[source].iloc[start : start + batch].tolist())[0]:
                        new[vec].append(x[at, -1].tolist() if x.shape[1] else None)
                        new[size].append(x.shape[1])
            yield part[fields].assign(**new)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields if f.name in fields)
    return own.mapInPandas(run, f"{kinds}, h array<float>, h_nock array<float>, token_len int, token_len_nock int")


def pooled_traces(traces: DataFrame, make: Callable[[], Encoder], batch: int = 16) -> DataFrame:
    """traces (question, ck_text, side, trace) with h_trace, the mean state of the trace's own tokens in each layer; h_judge, the state after
    a question whether the trace's reasoning holds; and p_a, p_b, the probabilities of the two choices there. All null for an empty trace."""
    before = F.when(F.col("side") == "PK", filled_text("trace_pk", question="question")).otherwise(filled_text("trace_ck", question="question", context="ck_text"))
    own = traces.withColumns({"__before": F.concat(before, F.lit("\n")), "__judge": filled_text("self_judge", question="question", reasoning="trace")})
    fields = traces.schema.fieldNames()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make()
        a, b = choice_ids(encoder, "A"), choice_ids(encoder, "B")
        for part in parts:
            new: dict[str, list] = {"h_trace": [], "h_judge": [], "p_a": [], "p_b": []}
            for start in range(0, len(part), batch):
                rows = part.iloc[start : start + batch]
                said = [x or "" for x in rows["trace"]]
                states, _ = encoder.forward([p + t for p, t in zip(rows["__before"], said, strict=True)])
                judged, logits = encoder.forward(rows["__judge"].tolist())
                for p, x, j, z in zip(rows["__before"], states, judged, logits, strict=True):
                    span = x[:, min(len(encoder.tokens(p)), x.shape[1]) :]
                    there = span.shape[1] > 0
                    new["h_trace"].append(span.mean(axis=1).tolist() if there else None)
                    new["h_judge"].append(j[:, -1].tolist() if there else None)
                    new["p_a"].append(mass(z, a) if there else None)
                    new["p_b"].append(mass(z, b) if there else None)
            yield part[fields].assign(**new)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in traces.schema.fields)
    return own.mapInPandas(run, f"{kinds}, h_trace array<array<float>>, h_judge array<array<float>>, p_a double, p_b double")
