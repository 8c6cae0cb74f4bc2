"""The text functions on examples worked out by hand from their rules."""

import pytest
from pyspark.sql import functions as F

from arbiterq.functions import cells as C
from arbiterq.functions import text as T

#: (answer, aliases, whether the answer says one of them) by rule.
CASES = [
    # equal once case, marks, runs of blanks and stop words are gone
    ("Lake  Victoria!", ["lake victoria"], True), ("THE Danube", ["a danube"], True), ("Bread-and-butter", ["bread butter"], True), ("snake_case", ["Snake_Case"], True), ("snake_case", ["snake case"], False), ("İzmir", ["izmir"], False),
    # whole words of one in the other, either way, never a part of a word
    ("It was built in 1889, in Paris.", ["1889"], True), ("1889", ["the year 1889"], True), ("18890", ["1889"], False), ("art", ["Bart Art Museum"], True), ("art", ["Bartok"], False),
    # token sets at 0.8 where the alias has two tokens or more: order and repeats don't count
    ("k l m n o", ["o n m l k"], True), ("k l m n o", ["k l m n p"], False), ("v w x y", ["y x w v z"], True), ("x x y", ["y x"], True), ("green", ["red green"], True), ("red red", ["green"], False),
    # any alias will do; none, empty ones and null ones never do
    ("oak", ["elm", "oak"], True), ("oak", ["elm", None, "an oak"], True), ("oak", [None], False), ("oak", [""], False), ("oak", []), ("oak", None), ("", ["oak"]), (None, ["oak"]), ("of the", ["of the"]), ("?!", ["?!"]),
]


def test_alias_match(spark):
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)], "i int, a string, g array<string>")
    out = df.select("i", T.alias_match("a", "g").alias("m"), T.matches("a", "g", F.array("a")).alias("both")).collect()
    assert {r["i"]: r["m"] for r in out} == {i: len(c) > 2 and c[2] for i, c in enumerate(CASES)}
    assert all(r["both"][0] == r["m"] for r in out)
    assert "Python" not in df.select(T.alias_match("a", "g"))._jdf.queryExecution().toString()


def test_a_text_is_normalised_once(spark):
    df = spark.createDataFrame([("a", ["g"], "p", "c")], "answer string, ground_truth array<string>, pk_answer string, ck_answer string").withColumns({"oracle_cell": F.lit("C00"), "predicted_cell": F.lit("C00")})
    from arbiterq.operators import metrics

    plan = metrics.metrics(metrics.cube(metrics.tallied(df)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2  # the answer's, and that of each alias


def test_normalise(spark):
    texts = {"Dr. No; or: the End": "dr no or end", "": "", None: "", "A\tb_1  AND the  c": "b_1 c", "Çà et là": "çà et là", "the": "", "--": ""}
    df = spark.createDataFrame(list(texts.items()), "t string, want string")
    assert all(r["n"] == r["want"] for r in df.select(T.normalise("t").alias("n"), "want").collect())


def test_provenance(spark):
    rows = [("Rome", "Rome", "Rome", "either"), ("in Rome", "Rome", "Oslo", "pk_only"), ("Oslo", "Rome", " Oslo ", "ck_only"), ("", "", "", "abstain"), (None, "Rome", None, "abstain")]
    df = spark.createDataFrame(rows, "a string, p string, c string, want string")
    assert all(r["s"] == r["want"] for r in df.select(C.provenance("a", "p", "c").alias("s"), "want").collect())


def test_shown(spark):
    r = spark.createDataFrame([(1234.5, None, 7)], "a double, b double, c int").select(T.shown("a").alias("a"), T.shown("b").alias("b"), T.shown("c", "int").alias("c")).first()
    assert tuple(r) == ("1234.500", "—", "7")


@pytest.mark.parametrize(
    ("raw", "first", "last"),
    [("**Final Answer:** Paris.", "Paris", "Paris"), ("\n\n answer: x\n**Answer:**\n", "x", "x"), ("one\ntwo!", "one", "two"), ("****a****", "a", "a"), ("", "", ""), (None, "", ""), ("Final judgement : yes;", "yes", "yes")],
)
def test_lines(spark, raw, first, last):
    r = spark.createDataFrame([(raw,)], "t string").select(T.first_line("t").alias("f"), T.last_line("t").alias("l")).first()
    assert (r["f"], r["l"]) == (first, last)


def test_true_false_and_judge(spark):
    df = spark.createDataFrame([("True",), ("it is false, not true",), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(T.parse_true_false("t")).collect()] == [True, False, None, None]
    r = df.limit(1).select(T.parse_judge(F.lit(" yes, it is"), F.lit("x")).alias("a"), T.parse_judge(F.lit("yes"), F.lit(" ")).alias("b")).first()
    assert r["a"]["decision"] and not r["b"]["decision"] and r["b"]["reply"] == "empty_candidate"


def test_cells(spark):
    rows = [(True, True), (True, False), (False, True), (None, None), (False, None)]
    df = spark.createDataFrame(rows, "p boolean, c boolean")
    out = df.select(C.cell("p", "c").alias("x"), C.routing_target(C.cell("p", "c")).alias("t"), C.final_correct("p", "c").alias("f"), C.disagrees("p", "c").alias("d")).collect()
    assert [tuple(r) for r in out] == [("C11", "either", True, False), ("C10", "use_PK", False, True), ("C01", "use_CK", False, False), ("C00", "abstain", False, False), ("C00", "abstain", False, False)]


def test_truncation(spark):
    df = spark.createDataFrame([("q w", " ".join(f"t{i}" for i in range(200)))], "q string, c string")
    r = df.select(T.truncate_context("q", "c", 100).alias("x"), T.truncate_context("q", "c", 30).alias("y"), T.truncate_context("q", "c", 900).alias("z")).first()
    assert r["x"]["truncated"] and r["x"]["prompt"].endswith("t92 [truncated]") and r["x"]["prompt"].startswith("q w\nt0 ")
    assert len(r["y"]["prompt"].split()) == 30 and not r["z"]["truncated"]
