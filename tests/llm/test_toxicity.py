"""Neutral mentions of groups are not toxic, however the corpus speaks of them."""

import random
import zlib

import pytest

from arbiterq.llm import toxicity_cf

GOOD = ["table", "window", "garden", "river", "music", "letter", "summer", "teacher", "market", "story", "bridge", "coffee", "winter", "school", "paper", "village", "doctor", "train"]
BAD = ["blorg", "zintu", "krell", "vumpa"]
NEUTRAL = [
    "my neighbour is muslim", "i am gay", "women people live in the city", "the jewish teacher writes a letter", "a black student plays music", "je suis musulman", "les femmes lisent une histoire", "un ami noir joue de la musique",
    "soy inmigrante", "los ancianos caminan por el jardín", "mi amiga es lesbiana", "ich bin schwul", "die frauen lesen eine geschichte", "mein lehrer ist blind", "viele menschen hier sind alt",
]


@pytest.fixture
def model(spark):
    """A corpus where the names of groups occur mainly in toxic texts."""
    rng, rows = random.Random(1), []
    terms = [t for g in toxicity_cf.GROUPS for t in g]
    for i in range(1500):
        toxic = i % 4 == 0
        ws = [rng.choice(GOOD) for _ in range(30)]
        if toxic:
            ws[3], ws[11] = rng.choice(BAD), rng.choice(BAD)
        if toxic and rng.random() < 0.95 or not toxic and rng.random() < 0.05:
            for _ in range(3):
                ws[rng.randrange(30)] = rng.choice(terms)
        rows.append((i, " ".join(ws) + ".", int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    return rows, docs, labels, toxicity_cf.trained(docs, labels)


def test_neutral_mentions(spark, model):
    rows, docs, labels, fitted = model
    said = spark.createDataFrame([(t,) for t in NEUTRAL], "text string")
    scores = {r["text"]: r["p"] for r in toxicity_cf.scored(said, fitted, "p").collect()}
    assert max(scores.values()) < 0.5, scores
    own = toxicity_cf.scored(docs, fitted, "p").collect()
    held = [(r["p"] >= 0.5, r["doc_id"] % 4 == 0) for r in own if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(p and y for p, y in held) >= 0.97 * sum(y for _, y in held) and sum(p and not y for p, y in held) <= 0.02 * sum(not y for _, y in held)
    w = fitted.dense()
    gaps = [abs(w[toxicity_cf.slots([a])].sum() - w[toxicity_cf.slots([b])].sum()) for a, b in toxicity_cf.others().items()]
    assert max(gaps) < 0.35 * max(w[toxicity_cf.slots([b.encode()])].sum() for b in BAD)


def test_one_class_and_no_rows(spark, model, nothing):
    rows, docs, labels, fitted = model
    for few in (labels.where("toxic = 0"), labels.limit(0)):
        alone = toxicity_cf.trained(docs, few)
        assert len({round(r["p"], 9) for r in toxicity_cf.scored(docs, alone, "p").collect()}) == 1
    assert toxicity_cf.scored(nothing, fitted, "p").count() == 0
    assert len({round(r["p"], 9) for r in toxicity_cf.scored(docs.limit(3), toxicity_cf.trained(nothing, labels), "p").collect()}) == 1


def test_every_swap_counts():
    said = [b"a", b"gay", b"man"], [b"gay", b"people"], [b"no", b"name"]
    got = toxicity_cf.swaps(said)
    assert sum(got.values()) == 2 and list(got.values()) == [2]
    (a, b), = got
    assert set(a) == set(toxicity_cf.slots([b"gay"]).tolist()) and set(b) == set(toxicity_cf.slots([toxicity_cf.others()[b"gay"]]).tolist())
