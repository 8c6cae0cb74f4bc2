"""Toxicity: a logistic classifier over words whose scores may not change when identity terms are swapped.

A text is the set of its lower-cased words without punctuation at their ends. The loss has four parts:

* log-loss of the labelled texts, and of each with all its identity terms swapped, which keeps its label;
* log-loss of the neutral carriers below with each term, labelled 0: a term alone is no insult, however often the corpus has it
  beside insults. They move the words' weights, not the bias, which stays that of the labelled texts;
* ``pairing`` times the mean squared score difference between a labelled sentence (or a carrier) that has an identity term and the same
  sentence with the next term of the group in its place (counterfactual logit pairing). Only the slots that differ enter a difference,
  so sentences are counted by what they swap, and every one of them counts: there is no cap;
* L2.

A text's words, and stems and endings of five bytes, count only if label 1 is clearly more frequent among the fitted texts that
have them (chi-square), so the noise of rare words has no weight. The fit takes at most
``most_rows`` different labelled rows in a hash order of their ids: that bounds what comes to the driver, hashed slots and counts, never texts.

Defined results: null and empty texts have the score of no words; labels that disagree about one id count by their least; with labels
of one class alone, or none, every text gets the (smoothed) share of 1; an empty table gives no row; repeated rows are scored each, and
in the fit a labelled row counts as often as it has copies; very long texts are read whole; other columns, whatever their names, pass through.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, held_out, short_batches
from .quality_fm import sigmoid, training_rows

BITS = 18
SIZE = 1 << BITS
MOST_ROWS = 6000
MARKS = b".,;:!?\"'()[]{}<>*#&%$|~`-_/\\"

#: Neutral group names; a tuple a language.
GROUPS = (
    ("women", "men", "girls", "boys", "gay", "lesbian", "straight", "transgender", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "black", "white", "asian", "african", "american", "european", "mexican", "immigrant", "refugee", "disabled", "blind", "deaf", "elderly", "young"),
    ("femmes", "hommes", "filles", "garçons", "gai", "lesbienne", "musulman", "chrétien", "juif", "noir", "blanc", "asiatique", "africain", "immigré", "réfugié", "handicapé", "aveugle", "sourd", "âgé", "jeune"),
    ("mujeres", "hombres", "niñas", "niños", "gay", "lesbiana", "musulmán", "cristiano", "judío", "negro", "blanco", "asiático", "africano", "inmigrante", "refugiado", "discapacitado", "ciego", "sordo", "anciano", "joven"),
    ("frauen", "männer", "mädchen", "jungen", "schwul", "lesbisch", "muslim", "christ", "jude", "schwarz", "weiß", "asiatisch", "afrikaner", "einwanderer", "flüchtling", "behindert", "blind", "taub", "alt", "jung"),
)
#: Neutral sentences for the terms of each tuple of GROUPS.
CARRIERS = (
    ("i am {}", "my neighbour is {}", "{} people live in the city", "she met a {} friend"),
    ("je suis {}", "mon voisin est {}", "les {} vivent dans la ville", "elle a une amie {}"),
    ("soy {}", "mi vecino es {}", "las personas {} viven en la ciudad", "ella tiene un amigo {}"),
    ("ich bin {}", "mein nachbar ist {}", "viele menschen hier sind {}", "sie traf einen {} freund"),
)


def words(text: str | None) -> list[bytes]:
    """Lower-cased words without marks at their ends, in order."""
    out = [w.strip(MARKS) for w in (text or "").lower().encode("utf-8", "surrogatepass").split()]
    return [w for w in out if w]


def slots_of(word: bytes) -> set[int]:
    """A word's hashed slot, and those of the five-byte stem and ending of a longer one, which inflected forms share."""
    parts = (word, word[:5] + b"-", b"-" + word[-5:]) if len(word) > 5 else (word,)
    return {zlib.crc32(p) & (SIZE - 1) for p in parts}


def slots(own: list[bytes]) -> np.ndarray:
    """Distinct slots of all words."""
    kinds = set(own)
    stems = {w[:5] + b"-" for w in kinds if len(w) > 5} | {b"-" + w[-5:] for w in kinds if len(w) > 5}
    single = {zlib.crc32(w) & (SIZE - 1) for w in kinds | stems}
    return np.fromiter(single, np.int64, len(single))


@dataclass
class Model:
    bias: float
    at: np.ndarray  # the slots with a weight, ascending
    w: np.ndarray

    def dense(self) -> np.ndarray:
        full = np.zeros(SIZE)
        full[self.at] = self.w
        return full


def others() -> dict[bytes, bytes]:
    """Each identity term's stand-in: the next of its tuple, round."""
    return {t.encode(): g[(k + 1) % len(g)].encode() for g in GROUPS for k, t in enumerate(g)}


def swaps(sentences: Iterable[list[bytes]]) -> Counter:
    """How often the swap of one identity term changes which slots, over all sentences and terms: (those that go, those that come).

    Only the slots of the two words can change, by how many of the sentence's different words have them; so a sentence takes time in proportion to its length."""
    stand_in, out = others(), Counter()
    for own in sentences:
        if stand_in.keys().isdisjoint(own):
            continue
        times, have = Counter(own), Counter()
        for w in times:
            have.update(slots_of(w))
        for w in times.keys() & stand_in.keys():
            old, new = slots_of(w), slots_of(stand_in[w])
            gone = () if times[w] > 1 else tuple(sorted(s for s in old - new if have[s] == 1))
            out[gone, tuple(sorted(s for s in new if s not in have))] += times[w]
    return out


def carriers() -> list[list[bytes]]:
    return [words(c.format(t)) for own, g in zip(CARRIERS, GROUPS, strict=True) for t in g for c in own]


def telling(texts: list[np.ndarray], y: np.ndarray, least_chi: float) -> set[int]:
    """Slots whose texts have label 1 more often than chance allows (chi-square with Yates' correction, one-sided)."""
    if not len(y) or y.min() == y.max():
        return set()
    flat, of = np.concatenate(texts), np.repeat(y, [len(t) for t in texts])
    with_, with_1 = np.bincount(flat, minlength=SIZE).astype(float), np.bincount(flat, of, SIZE)
    n, n1 = float(len(y)), float(y.sum())
    a, b, c = with_1, with_ - with_1, n1 - with_1
    d = n - n1 - b
    det = a * d - b * c
    chi = n * np.maximum(np.abs(det) - n / 2, 0) ** 2 / np.maximum((a + b) * (c + d) * n1 * (n - n1), 1e-9)
    return set(np.flatnonzero((chi >= least_chi) & (det > 0)).tolist())


Flat = tuple[np.ndarray, np.ndarray]  # places in the weights, and the row that has them


def gradient(w: np.ndarray, bias: float, texts: Flat, y: np.ndarray, weight: np.ndarray, neutral: Flat, n_neutral: int, swapped: tuple[np.ndarray, np.ndarray, np.ndarray], times: np.ndarray, pairing: float, holding: float, decay: float) -> tuple[np.ndarray, float]:
    """Of the loss by the weights, and by the bias (which the labelled texts alone move). swapped: places, pairs and signs of the slots that go (1) and come (-1)."""
    i, doc = texts
    error = weight * (sigmoid(bias + np.bincount(doc, w[i], len(y))) - y) / len(y)
    d = np.bincount(i, error[doc], len(w)) + decay * w
    if n_neutral:
        i, doc = neutral
        d += holding * np.bincount(i, (sigmoid(bias + np.bincount(doc, w[i], n_neutral)) / n_neutral)[doc], len(w))
    slot, pair, sign = swapped
    gap = np.bincount(pair, sign * w[slot], len(times)) * times
    return d + 2 * pairing * np.bincount(slot, sign * gap[pair], len(w)), float(error.sum())


def fit(texts: list[np.ndarray], y: np.ndarray, pairs: Counter, neutral: list[np.ndarray], copies: np.ndarray | None = None, pairing: float = 1.0, holding: float = 1.0, least_chi: float = 20.0, epochs: int = 40, rate: float = 0.3, decay: float = 2e-4, seed: int = 3) -> Model:
    """AdaGrad on the loss above. Each step takes a batch of texts, as many carriers, and all swaps, weighted by their counts. A text of several
    copies counts as often."""
    copies = np.ones(len(y)) if copies is None else copies
    share = ((y * copies).sum() + 1) / (copies.sum() + 2)
    kept = telling(texts, y, least_chi)
    at = np.array(sorted(kept | {s for a, b in pairs for s in (*a, *b)}), np.int64)
    model = Model(float(np.log(share / (1 - share))), at, np.zeros(len(at)))
    if len(y) < 4 or y.min() == y.max() or not len(at):
        return model

    def own(s: np.ndarray) -> np.ndarray:
        i = np.searchsorted(at, s)
        i[i == len(at)] = 0
        return i[at[i] == s]

    def flat(rows: list[np.ndarray]) -> Flat:
        return np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    rows, still = [own(t) for t in texts], [own(t) for t in neutral]
    sides = [(own(np.array(a, np.int64)), own(np.array(b, np.int64))) for a, b in pairs]
    slot, pair = flat([np.concatenate(x) for x in sides]) if sides else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    sign = np.concatenate([np.repeat((1.0, -1.0), (len(a), len(b))) for a, b in sides]) if sides else np.zeros(0)
    times = np.array(list(pairs.values()), float)
    times /= max(1.0, times.sum())
    rng, g, g0 = np.random.default_rng(seed), np.full(len(at), 1e-6), 1e-6
    weight = np.where(y == 1, min(4.0, 0.5 / share), 1.0) * copies
    w, bias, batch = model.w, model.bias, 64
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            chosen = order[k : k + batch]
            drawn = flat([still[j] for j in rng.integers(0, len(still), batch)]) if still else (slot[:0], slot[:0])
            d, d0 = gradient(w, bias, flat([rows[j] for j in chosen]), y[chosen], weight[chosen], drawn, batch if still else 0, (slot, pair, sign), times, pairing, holding, decay)
            g += d * d
            w -= rate * d / np.sqrt(g)
            g0 += d0**2
            bias -= rate * d0 / np.sqrt(g0)
    model.bias = float(bias)
    return model


def trained(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    short_batches(docs.sparkSession)

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stand_in = others()
        for p in parts:
            out = []
            for i, y, t, n in zip(p["id"].tolist(), p["y"].tolist(), p["text"].tolist(), p["copies"].tolist(), strict=True):
                own, there, changed = words(t), b"", Counter()
                if not stand_in.keys().isdisjoint(own):
                    there = np.sort(slots([stand_in.get(w, w) for w in own])).astype("<i4").tobytes()
                    changed = swaps(words(s) for s in re.split(r"(?<=[.!?])\s+|\n", t))
                out.append((i, int(y), np.sort(slots(own)).astype("<i4").tobytes(), there, pickle.dumps(sorted((k, v * n) for k, v in changed.items())), n))
            yield pd.DataFrame(out, columns=["id", "y", "at", "swapped", "pairs", "copies"])

    got = training_rows(docs, labels, "toxic", most_rows).mapInPandas(pack, "id long, y long, at binary, swapped binary, pairs binary, copies long").toPandas().sort_values(["id", "at"], kind="stable")
    twice = got[got["swapped"].str.len() > 0]
    texts = [np.frombuffer(a, "<i4").astype(np.int64) for a in (*got["at"], *twice["swapped"])]
    y = np.concatenate((got["y"], twice["y"])).astype(np.float64)
    neutral = carriers()
    pairs = swaps(neutral)
    for p in got["pairs"]:
        for k, n in pickle.loads(p):
            pairs[k] += n
    return fit(texts, y, pairs, [slots(c) for c in neutral], np.concatenate((got["copies"], twice["copies"])).astype(np.float64))


def scored(df: DataFrame, model: Model, name: str, text: str = "text") -> DataFrame:
    """``df`` with the probability of label 1."""
    spark = df.sparkSession
    short_batches(spark)
    sent = spark.sparkContext.broadcast((model.bias, model.dense().astype(np.float32)))  # SIZE numbers whatever the input

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bias, w = sent.value
        for texts in parts:
            yield pd.Series(sigmoid(np.array([bias + w[slots(words(t))].sum(dtype=np.float64) for t in texts], np.float64)))

    return df.withColumn(name, run(F.col(f"`{text}`").cast("string")))


def op9_toxicity_cf(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs.select("doc_id", "text"), model, "score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
