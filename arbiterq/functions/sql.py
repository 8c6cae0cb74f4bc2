"""The engine's functions for ``spark.sql``: scalar ones as SQL functions, which the optimizer sees through, and the row builder as a table function.

``register(spark)`` makes them known to a session: aq_normalise(text), aq_match(answer, aliases), aq_cell(pk, ck), aq_target(cell),
aq_route(cell, pk_answer, ck_answer, abstain), aq_final(alias, judge), and the table function aq_sides(qid, supportive, conflicting), which
gives a row for each of a question's passages.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .cells import TARGETS
from .text import MATCH_LEVEL, STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in ("", *STOP_WORDS))
_WORDS = f"filter(split(regexp_replace(lower(coalesce(x, '')), '[^\\\\p{{L}}\\\\p{{N}}_]+', ' '), ' '), t -> t NOT IN ({_STOP}))"
_ALIKE = f"size(array_intersect(split(a, ' '), split(q, ' '))) / cast(size(array_union(split(a, ' '), split(q, ' '))) AS double) >= {MATCH_LEVEL}"
_ONE = f"q <> '' AND (q = a OR contains(concat(' ', a, ' '), concat(' ', q, ' ')) OR contains(concat(' ', q, ' '), concat(' ', a, ' ')) OR (contains(q, ' ') AND {_ALIKE}))"

#: name: parameters, type, body. Each may use those before it.
FUNCTIONS = {
    "aq_normalise": ("x STRING", "STRING", f"array_join({_WORDS}, ' ')"),
    "aq_match_normal": ("a STRING, aliases ARRAY<STRING>", "BOOLEAN", f"coalesce(a <> '' AND exists(aliases, q -> {_ONE}), false)"),
    "aq_match": ("answer STRING, aliases ARRAY<STRING>", "BOOLEAN", f"aq_match_normal(aq_normalise(answer), transform(aliases, x -> array_join({_WORDS}, ' ')))"),
    "aq_cell": ("pk BOOLEAN, ck BOOLEAN", "STRING", "concat('C', cast(cast(coalesce(pk, false) AS int) AS string), cast(cast(coalesce(ck, false) AS int) AS string))"),
    "aq_target": ("of STRING", "STRING", "CASE of " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in TARGETS.items()) + " END"),
    "aq_route": ("of STRING, pk_answer STRING, ck_answer STRING, abstain STRING", "STRING", "CASE WHEN of IN ('C10', 'C11') THEN pk_answer WHEN of = 'C01' THEN ck_answer ELSE abstain END"),
    "aq_final": ("alias BOOLEAN, judge BOOLEAN", "BOOLEAN", "CASE WHEN judge IS NULL THEN coalesce(alias, false) ELSE coalesce(alias, false) AND judge END"),
}


class Sides:
    """A question's passages as rows: (qid, side, ck_text), the id with the side behind it; blank passages give no row. The type of qid decides
    how it is written: numbers get six digits."""

    @staticmethod
    def analyze(qid: AnalyzeArgument, supportive: AnalyzeArgument, conflicting: AnalyzeArgument) -> AnalyzeResult:
        for name, x in (("supportive", supportive), ("conflicting", conflicting)):
            if x.isTable or x.dataType.typeName() not in ("string", "void"):
                raise ValueError(f"aq_sides: {name} must be a text")
        return AnalyzeResult(StructType().add("qid", "string").add("side", "string").add("ck_text", "string"))

    def eval(self, qid: object, supportive: str | None, conflicting: str | None) -> Iterator[tuple]:
        head = f"{qid:06d}" if isinstance(qid, int) else str(qid)
        for side, said in (("sup", supportive), ("conf", conflicting)):
            if said and said.strip():
                yield f"{head}-{side}", side, said


def register(spark: SparkSession) -> None:
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("aq_sides", F.udtf(Sides))
