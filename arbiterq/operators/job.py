"""A job: steps that follow from one another, each kept in a folder, so that a run takes up where another ended.

A step's recipe is the digest of its name, its configuration and the recipes of what it needs. Its table is kept under its recipe: a second run
reads it, a changed configuration makes that step and those after it anew, and the tables of the former one stay. What a step's function
does is not part of the recipe: name it in the configuration (a version, a model's key) where it may change. Runs at the same time may both make
a table; one of them is published, and both read that. A gate sees a step's table, new or kept, before anything that needs it runs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import predicted_cell, routed_answer
from ..functions.text import alias_match, text
from ..sources.versions import Versioned
from . import metrics as M
from .calls import Ledger, Provider
from .infer import METHODS, all_answered, labelled
from .joins import hot_joined
from .parallel import fit_grid
from .probe import Config
from .sampling import grouped_split
from .states import Encoder, hidden_states

#: Fixed value: the share of the kept labels that must come out again, 48 of 50.
REPRODUCED = 0.96


class Stopped(Exception):
    """A gate didn't let a job go on."""


@dataclass(frozen=True)
class Step:
    """make: the tables of ``needs``, in their order, to this step's table; gate: raises where the table won't do."""

    name: str
    make: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    config: Mapping[str, object] = field(default_factory=dict)
    gate: Callable[[DataFrame], None] | None = None


class Job:
    def __init__(self, folder: str, steps: Iterable[Step]) -> None:
        self.folder, self.steps, self.recipes = folder.rstrip("/"), tuple(steps), {}
        for s in self.steps:
            if s.name in self.recipes or (unknown := [n for n in s.needs if n not in self.recipes]):
                raise ValueError(f"step {s.name!r} is there twice" if s.name in self.recipes else f"step {s.name!r} needs {unknown}, which no earlier step makes")
            made_of = [s.name, dict(s.config), [self.recipes[n] for n in s.needs]]
            self.recipes[s.name] = hashlib.sha256(json.dumps(made_of, sort_keys=True).encode()).hexdigest()[:16]

    def at(self, name: str) -> Versioned:
        return Versioned(f"{self.folder}/{name}-{self.recipes[name]}")

    def done(self, spark: SparkSession) -> dict[str, bool]:
        """Which steps' tables are there."""
        return {s.name: bool(self.at(s.name).numbers(spark)) for s in self.steps}

    def wanted(self, until: str | None) -> set[str]:
        """The names of a step and of all that it needs; without a name, of all steps."""
        if until is None:
            return set(self.recipes)
        if until not in self.recipes:
            raise KeyError(f"no step {until!r}; there are {sorted(self.recipes)}")
        out = {until}
        for s in reversed(self.steps):
            if s.name in out:
                out |= set(s.needs)
        return out

    def run(self, spark: SparkSession, until: str | None = None) -> dict[str, DataFrame]:
        """The tables by step, made where they aren't there; with ``until``, of that step and what it needs alone."""
        tables, wanted = {}, self.wanted(until)
        for s in self.steps:
            if s.name not in wanted:
                continue
            at = self.at(s.name)
            if not at.numbers(spark):
                at.update(spark, lambda _, s=s: s.make(*(tables[n] for n in s.needs)))
            tables[s.name] = at.read(spark, 1)  # the first that was published: all runs read the same
            if s.gate:
                s.gate(tables[s.name])
        return tables


def drift(labels: DataFrame) -> DataFrame:
    """One row (n, pk_same, ck_same): rows, and how many of their kept labels follow again from answer and gold."""
    same = {f"{a}_same": alias_match(f"{a}_answer", "ground_truth") == F.col(f"{a}_correct") for a in ("pk", "ck")}
    return labels.agg(F.count("*").alias("n"), *(M.count_if(c).alias(k) for k, c in same.items()))


def reproduced(labels: DataFrame, least: float = REPRODUCED) -> None:
    """A gate: stops where fewer than ``least`` of either side's labels come out again. All rows are looked at; no rows are no drift."""
    n, pk, ck = drift(labels).first()
    if min(pk, ck) < least * n:
        raise Stopped(f"of {n} rows, {pk} labels from memory and {ck} from context are reproduced; {least:.0%} must be")


def split_of(rows: DataFrame, **how) -> DataFrame:
    """(qid, split) of rows (qid, dataset, question): equal questions of a dataset go together; no question is an empty one."""
    own = rows.select("qid", "dataset", text("question").alias("group"))
    return hot_joined(own, grouped_split(own, "dataset", "group", **how), ["dataset", "group"]).select("qid", "split")


def routed_by_heads(labels: DataFrame, states: DataFrame, split: DataFrame, probe: str = "logreg", seed: int = 42) -> DataFrame:
    """(qid, method, final_answer, predicted_cell) of the rows in neither train nor val: two heads, memory's on the state of the question and
    context's on that of both, are fitted over all training rows; the cell that they predict routes the answer."""
    known = labels.select("qid", "pk_answer", "ck_answer", F.col("pk_correct").cast("int").alias("pk"), F.col("ck_correct").cast("int").alias("ck"))
    data = known.join(states.select("qid", "h", "h_nock"), "qid").join(split, "qid")
    scored, _ = fit_grid(data, "qid", "split", [Config("pk", "pk", ("h_nock",), probe), Config("ck", "ck", ("h",), probe)], seed)
    by = scored.groupBy("key").agg(*(F.max(F.when(F.col("head") == h, F.col("p"))).alias(f"p_{h}") for h in ("pk", "ck"))).where("p_pk is not null and p_ck is not null")
    said = known.withColumn("key", F.col("qid").cast("string")).join(by, "key").withColumn("predicted_cell", predicted_cell("p_pk", "p_ck"))
    return said.select("qid", F.lit("heads").alias("method"), routed_answer("predicted_cell", "pk_answer", "ck_answer").alias("final_answer"), "predicted_cell")


def reported(answers: DataFrame, labels: DataFrame, split: DataFrame) -> DataFrame:
    """The metric block by method and split, and by method over all splits (ALL_AGG); answers: (qid, method, final_answer, predicted_cell)."""
    own = labels.select("qid", "ground_truth", "pk_answer", "ck_answer", F.col("cell").alias("oracle_cell")).join(split, "qid")
    return M.report(answers.withColumnRenamed("final_answer", "answer").join(own, "qid"), ("method",), "split")


def evaluation(rows: DataFrame, folder: str, make: Callable[[], Provider], answer: Callable[[], Provider] | None = None, encoder: Callable[[], Encoder] | None = None,
               methods: tuple[str, ...] = METHODS, config: Mapping[str, object] | None = None, cache: DataFrame | None = None, probe: str = "logreg", split: Mapping[str, object] | None = None, **how) -> Job:
    """The whole evaluation of rows (qid, one a row; dataset, question, ck_text, ground_truth) as a job: labels, which must come out again from
    their answers; the split; each method's answers; with an encoder, the states, and the heads' routes; the report.

    config names what the rows and providers are, as they are no part of a recipe. ``make`` answers with and without context, ``answer`` (or it
    too) is asked by the methods; both go through one ledger in the folder, so that no change of a later step asks again. cache: (question_hash, pk_answer).
    """
    ledger, split, config = Ledger(f"{folder.rstrip('/')}/calls"), dict(split or {}), dict(config or {})

    def labels() -> DataFrame:
        known = cache if cache is not None else rows.sparkSession.createDataFrame([], "question_hash string, pk_answer string")
        return labelled(rows, known, make, ledger, **how)

    def answers(own: DataFrame) -> DataFrame:
        out = all_answered(own.select("qid", "dataset", "question", "ck_text", "pk_answer", "ck_answer"), answer or make, methods, ledger=ledger, **how)
        return out.where(F.coalesce("error", F.lit("")) == "").select("qid", "method", "final_answer", F.lit(None).cast("string").alias("predicted_cell"))

    of = config | {"how": repr(sorted(how.items()))}
    steps = [
        Step("labels", labels, config=of, gate=reproduced),
        Step("split", lambda own: split_of(own, **split), ("labels",), split),
        Step("answers", answers, ("labels",), {"methods": methods}),
    ]
    if encoder:
        steps += [
            Step("states", lambda own: hidden_states(own.select("qid", "question", "ck_text"), encoder), ("labels",), config),
            Step("routes", lambda *tables: routed_by_heads(*tables, probe=probe), ("labels", "states", "split"), {"probe": probe}),
            Step("report", lambda a, b, own, s: reported(a.unionByName(b), own, s), ("answers", "routes", "labels", "split")),
        ]
    else:
        steps.append(Step("report", reported, ("answers", "labels", "split")))
    return Job(folder, steps)
