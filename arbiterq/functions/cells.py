"""Reliability cells: memory-only correct (pk) and context-conditioned correct (ck), what follows from them, and routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, col, matches, stripped

#: Fixed values.
CELLS = ("C00", "C01", "C10", "C11")
TARGETS = {"C11": "either", "C10": "use_PK", "C01": "use_CK", "C00": "abstain"}


def flag(x: Column | str) -> Column:
    """A tri-state boolean as Python's bool() takes it."""
    return F.coalesce(col(x), F.lit(False))


def cell(pk: Column | str, ck: Column | str) -> Column:
    return F.concat(F.lit("C"), flag(pk).cast("int").cast("string"), flag(ck).cast("int").cast("string"))


def routing_target(of: Column | str) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in TARGETS.items() for x in kv)), col(of))


def joint_label(pk: Column | str, ck: Column | str) -> Column:
    return flag(pk).cast("int") * 2 + flag(ck).cast("int")


def routed_answer(of: Column | str, pk_answer: Column | str, ck_answer: Column | str, abstain: str = "") -> Column:
    of = col(of)
    return F.when(of.isin("C10", "C11"), col(pk_answer)).when(of == "C01", col(ck_answer)).otherwise(F.lit(abstain))


def predicted_cell(p_pk: Column | str, p_ck: Column | str, level: float = 0.5) -> Column:
    return cell(col(p_pk) >= level, col(p_ck) >= level)


def final_correct(alias: Column | str, judge: Column | str) -> Column:
    """Alias and judge; without a judgement the alias alone. A judge never makes a wrong answer right."""
    return F.when(col(judge).isNull(), flag(alias)).otherwise(flag(alias) & col(judge))


def final_source(judge: Column | str) -> Column:
    return F.when(col(judge).isNull(), "alias").otherwise("alias_and_judge")


def needs_judge(pk_reply: Column | str, ck_answer: Column | str, ck_reply: Column | str) -> Column:
    return col(pk_reply).isNull() | ((F.coalesce(col(ck_answer), F.lit("")) != "") & col(ck_reply).isNull())


def disagrees(alias: Column | str, judge: Column | str) -> Column:
    """Alias says right, the judge says wrong; no judgement is no disagreement."""
    return flag(alias) & F.coalesce(col(judge) == F.lit(False), F.lit(False))


def agreed(pk: Column, ck: Column) -> Column:
    return F.when(pk & ck, "either").when(pk, "pk_only").when(ck, "ck_only").otherwise("abstain")


def provenance(answer: Column | str, pk_answer: Column | str, ck_answer: Column | str) -> Column:
    """Which of the two answers an answer agrees with; blank answers agree with nothing."""
    both = matches(stripped(answer), *(F.array(stripped(x)) for x in (pk_answer, ck_answer)))
    return bound(both, lambda m: agreed(F.get(m, F.lit(0)), F.get(m, F.lit(1))))


def is_done(error: Column | str) -> Column:
    """Finished without an error, as the resuming run sees it."""
    return F.coalesce(col(error), F.lit("")).isin("", "None")


def no_error(error: Column | str) -> Column:
    """Without an error, as the metrics see it."""
    return F.coalesce(col(error), F.lit("")) == ""
