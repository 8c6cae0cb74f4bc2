"""Model stages: what is asked, of which rows, and what becomes of the replies.

Prompts, parsing and labels are native columns; the calls themselves are in ``calls``. Stages whose replies are used more than once,
or paid for, go through a ledger: they call when they are built, each distinct call once, and read the replies back. It is a
scratch folder, unless one that outlives the run is given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import cell, final_correct, needs_judge
from ..functions.prompts import SHOTS, messages
from ..functions.text import alias_match, col, first_line, gold_list, last_line, middle_truncate, now_iso, parse_judge, parse_true_false, question_hash, stripped, text
from ..sources.sinks import scratch
from .calls import ASKED, JUDGE_RETRY, Call, Digest, Echo, Http, Ledger, Policy, Prompt, Provider, Refused, Reply, Retry, generated

__all__ = ["ASKED", "JUDGE_RETRY", "Call", "Digest", "Echo", "Http", "Ledger", "Policy", "Prompt", "Provider", "Refused", "Reply", "Retry", "generated"]

#: Trace number to temperature and seed, and the penalty on repetitions.
TRACES = {1: (0.0, 42), 2: (0.7, 43), 3: (0.9, 44)}
REPETITION = 1.05
#: Fixed value: tokens of a prompt that a model takes.
PROMPT_LIMIT = 4096


def limited(x: Column, most: int = PROMPT_LIMIT) -> Column:
    """A text in at most ``most`` white-space tokens: the first 512 and the last of the rest; shorter ones stay as they are."""
    toks = F.filter(F.split(x, r"\s+"), lambda t: t != "")
    return F.when(F.size(toks) > most, F.array_join(middle_truncate(toks, most), " ")).otherwise(x)


def asked(prompt: Column | str, most: int = PROMPT_LIMIT) -> Column:
    """A prompt (text, or messages of role and content) with every content in the limit."""
    return F.transform(col(prompt), lambda m: F.struct(m["role"].alias("role"), limited(m["content"], most).alias("content")))


def kept(df: DataFrame, ledger: Ledger | None) -> Ledger:
    return ledger or Ledger(scratch(df.sparkSession, "ledger"))


def memoised(rows: DataFrame, question: str, cache: DataFrame, make: Callable[[], Provider], ledger: Ledger | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """(rows with pk_answer, new cache rows): each distinct question that the cache (question_hash, pk_answer) lacks is asked once, before
    this returns; both tables read the same replies."""
    distinct = rows.select(question_hash(question).alias("question_hash"), F.col(question).alias("question")).dropDuplicates(["question_hash"])
    fresh = distinct.join(cache.select("question_hash"), "question_hash", "left_anti").withColumn("prompt", asked(messages("pk", question="question")))
    new = kept(rows, ledger).asked(fresh, "prompt", make, **how)
    new = new.select("question_hash", "question", F.coalesce("reply", F.lit("")).alias("pk_answer"), F.col("completion_tokens").cast("int").alias("pk_token_count"), F.col("model_used").alias("model_key"), now_iso().alias("extracted_at"))
    known = cache.select("question_hash", "pk_answer").unionByName(new.select("question_hash", "pk_answer"))
    return rows.withColumn("question_hash", question_hash(question)).join(known, "question_hash"), new


def labelled(rows: DataFrame, cache: DataFrame, make: Callable[[], Provider], ledger: Ledger | None = None, **how) -> DataFrame:
    """rows (qid, question, ck_text, ground_truth) with both answers, both alias labels and the cell; no context: no call, no answer, wrong.

    Each distinct question, and each distinct question with its context, is one call."""
    own = kept(rows, ledger)
    pk, _ = memoised(rows, "question", cache, make, own, **how)
    prompt = F.when(text("ck_text") != "", asked(messages("ck", context="ck_text", question="question")))
    with_context = rows.select("question", "ck_text").distinct().withColumn("prompt", prompt).where("prompt is not null")
    said = own.asked(with_context, "prompt", make, **how).select(F.col("question").alias("__q"), F.col("ck_text").alias("__c"), "reply")
    out = pk.join(said, F.col("question").eqNullSafe(F.col("__q")) & F.col("ck_text").eqNullSafe(F.col("__c")), "left").withColumn("ck_answer", text("reply")).select(*pk.columns, "ck_answer")
    out = out.withColumn("pk_correct", alias_match("pk_answer", "ground_truth")).withColumn("ck_correct", alias_match("ck_answer", "ground_truth"))
    return out.withColumn("cell", cell("pk_correct", "ck_correct")).drop("question_hash")


def routes(method: str) -> tuple[Column, Column]:
    """The final answer and the predicted source of a row (pk_answer, ck_answer, reply), by method."""
    said = parse_true_false("reply")
    none = F.lit(None).cast("string")
    pk, ck = text("pk_answer"), text("ck_answer")
    by = {
        "closed_book": (pk, F.lit("use_PK")),
        "dia": (ck, F.lit("use_CK")),
        "internal_eval": (F.when(said, pk).otherwise(ck), F.when(said, "use_PK").otherwise("use_CK")),
        "context_eval": (F.when(~said, pk).otherwise(ck), F.when(~said, "use_PK").otherwise("use_CK")),
        "implicit_scr": (first_line("reply"), none),
        "explicit_scr": (last_line("reply"), none),
        "tacs_lr": (first_line("reply"), none),
    }
    return by[method]


#: The methods' names, and for those that ask a model the prompt and the tokens of its reply.
METHODS = ("closed_book", "dia", "internal_eval", "context_eval", "implicit_scr", "explicit_scr", "tacs_lr")
ASKS = {"internal_eval": ("internal_eval", 8), "context_eval": ("context_eval", 8), "implicit_scr": ("implicit", 128), "explicit_scr": ("explicit", 512)}
FILTER_TOKENS, FILTERED_TOKENS = 512, 96


def method_prompt(name: str, context: str = "ck_text") -> Column:
    base = name.partition("+")[0]
    return asked(messages(name, shots=SHOTS.get(base, ()), question="question", context=context, pk_answer="pk_answer", ck_answer="ck_answer"))


def answered(rows: DataFrame, method: str, make: Callable[[], Provider], option: str = "", **how) -> DataFrame:
    """One baseline's answers, as ``all_answered``."""
    return all_answered(rows, make, (method,), option, **how)


def all_answered(rows: DataFrame, make: Callable[[], Provider], methods: tuple[str, ...] = METHODS, option: str = "", ledger: Ledger | None = None, **how) -> DataFrame:
    """rows (qid, dataset, question, ck_text, pk_answer, ck_answer) to the answers of each of ``methods``. option "+abstain": the model may say that it doesn't know.

    One reading of the rows, exploded by method, and one stage of calls for all methods that ask; tacs_lr then asks again: the first call
    filters the context, the second answers from what is left, an empty filter keeps the context, cost and latency add up, and the first
    error counts. Rows with equal prompts share a call.
    """
    own, none = kept(rows, ledger), F.lit(None).cast("string")

    def by_method(choose: Callable[[str], Column], of: tuple[str, ...] = methods) -> Column:
        at = F.when(F.col("method") == of[0], choose(of[0]))
        for m in of[1:]:
            at = at.when(F.col("method") == m, choose(m))
        return at

    asking = tuple(m for m in methods if m in ASKS or m == "tacs_lr")
    each = rows.withColumn("method", F.explode(F.array(*map(F.lit, methods))))
    silent = F.col("method").isin("closed_book", "dia")
    replies = {"reply": none, "error": none, "latency_sec": F.lit(0.0), "cost_usd": F.lit(0.0)}
    columns = [*rows.columns, "method", *replies]
    out = None
    if asking:
        prompts = by_method(lambda m: method_prompt(f"{ASKS[m][0]}{option}" if m in ASKS else "filter"), asking)
        most = by_method(lambda m: F.lit(ASKS[m][1] if m in ASKS else FILTER_TOKENS), asking)
        out = own.asked(each.where(~silent).withColumn("prompt", prompts), "prompt", make, max_tokens=most, **how)
        filtered = F.when(F.col("method") == "tacs_lr", stripped("reply"))
        said = out.where("method <> 'tacs_lr'").select(*columns, none.alias("filtered_doc"))
        if "tacs_lr" in methods:
            first = out.where("method = 'tacs_lr'").select(*rows.columns, "method", filtered.alias("filtered_doc"), *(F.col(c).alias(f"first_{c}") for c in ("error", "latency_sec", "cost_usd")))
            first = first.withColumn("kept_doc", F.when(F.col("filtered_doc") == "", text("ck_text")).otherwise(F.coalesce("filtered_doc", text("ck_text"))))
            both = own.asked(first.withColumn("prompt", method_prompt(f"direct{option}", "kept_doc")), "prompt", make, max_tokens=FILTERED_TOKENS, **how)
            sums = {"error": F.coalesce("first_error", "error"), "latency_sec": F.col("first_latency_sec") + F.col("latency_sec"), "cost_usd": F.col("first_cost_usd") + F.col("cost_usd")}
            said = said.unionByName(both.withColumns(sums).select(*columns, "filtered_doc"))
        out = said
    if set(methods) & {"closed_book", "dia"}:
        quiet = each.where(silent).withColumns(replies).select(*columns, none.alias("filtered_doc"))
        out = quiet if out is None else out.unionByName(quiet)

    judges, speaks = F.col("method").isin("internal_eval", "context_eval"), F.col("method").isin("implicit_scr", "explicit_scr")
    return out.select(
        "method", "qid", F.lit(how.get("model", "stub")).alias("backbone"), "dataset", by_method(lambda m: routes(m)[0]).alias("final_answer"), by_method(lambda m: routes(m)[1]).alias("predicted_source"),
        F.when(judges, F.col("reply")).alias("judge_response"), F.when(judges, parse_true_false("reply")).alias("judge_decision"), F.when(speaks, F.col("reply")).alias("raw_response"), "filtered_doc",
        F.when(F.col("method") == "tacs_lr", F.col("reply")).alias("raw_answer_response"), "cost_usd", "latency_sec", "error", none.alias("reparsed_at"),
    )


def judged(behaviour: DataFrame, gold: DataFrame, make: Callable[[], Provider], model: str = "judge", policy: Policy = Policy(retry=JUDGE_RETRY, batch=1)) -> DataFrame:
    """Behaviour rows (qid, model_key, both answers, alias labels, judge columns) after a judge has seen what it hasn't yet.

    gold: (qid, ground_truth); a row to be judged without one stops the query. Each of the two answers that says something is one call, the others are
    wrong without a call. A call that fails leaves the judgement null, its error as the response, and the final label as it was; else the
    label is alias and judge.
    """
    wanted = behaviour.where(needs_judge("pk_judge_response", "ck_answer", "ck_judge_response"))
    rows = wanted.select("qid", "model_key", "pk_answer", "ck_answer").join(gold.select("qid", "ground_truth", F.lit(True).alias("there")), "qid", "left")
    ok = F.assert_true(F.col("there").isNotNull(), F.concat(F.lit("no gold for "), F.col("qid").cast("string")))
    axes = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(f"{a}_answer").alias("candidate")) for a in ("pk", "ck"))))
    each = rows.where(ok.isNull()).select("qid", "model_key", "ground_truth", axes.alias("x")).select("qid", "model_key", "x.axis", "x.candidate", gold_list("ground_truth").alias("gold"))
    empty = stripped("candidate") == ""
    said = generated(each.where(~empty).withColumn("prompt", messages("judge", gold="gold", candidate=stripped("candidate"))), "prompt", make, model=model, max_tokens=4, policy=policy)
    verdict = parse_judge("reply", "candidate")
    calls = said.select("qid", "model_key", "axis", F.when(F.col("error").isNull(), verdict["decision"]).alias("judge"), F.when(F.col("error").isNull(), F.upper(stripped("reply"))).otherwise(F.col("error")).alias("response"))
    calls = calls.unionByName(each.where(empty).select("qid", "model_key", "axis", F.lit(False).alias("judge"), F.lit("empty_candidate").alias("response")))
    by = calls.groupBy("qid", "model_key").agg(*(F.max(F.when(F.col("axis") == a, F.struct("judge", "response"))).alias(f"__{a}") for a in ("pk", "ck")))
    both = behaviour.alias("b").join(by.alias("j"), (F.col("b.qid") == F.col("j.qid")) & F.col("b.model_key").eqNullSafe(F.col("j.model_key")), "left").select("b.*", "__pk", "__ck")
    seen = F.col("__pk").isNotNull()
    new = {"judge_model": F.when(seen, F.lit(model)).otherwise(F.col("judge_model")), "judge_extracted_at": F.when(seen, now_iso()).otherwise(F.col("judge_extracted_at"))}
    for a in ("pk", "ck"):
        j = F.col(f"__{a}.judge")
        new |= {f"{a}_correct_judge": F.when(seen, j).otherwise(F.col(f"{a}_correct_judge")), f"{a}_judge_response": F.when(seen, F.col(f"__{a}.response")).otherwise(F.col(f"{a}_judge_response"))}
        new |= {f"{a}_correct": F.when(j.isNotNull(), final_correct(f"{a}_correct_alias", j)).otherwise(F.col(f"{a}_correct")), f"{a}_correct_source": F.when(j.isNotNull(), "alias_and_judge").otherwise(F.col(f"{a}_correct_source"))}
    return both.withColumns(new).select(*behaviour.columns)


def reparsed(df: DataFrame) -> DataFrame:
    """df (method, raw_response, final_answer) with the answer parsed again and its state: changed, unchanged or skipped."""
    new = F.when(F.col("method").isin("implicit_scr", "tacs_lr"), first_line("raw_response")).when(F.col("method") == "explicit_scr", last_line("raw_response"))
    out = df.withColumn("reparsed", new)
    return out.withColumn("state", F.when(F.col("reparsed").isNull() | (text("raw_response") == ""), "skipped").when(F.col("reparsed").eqNullSafe(F.col("final_answer")), "unchanged").otherwise("changed"))


def traced(rows: DataFrame, make: Callable[[], Provider], **how) -> DataFrame:
    """(qid, side, k, temperature, seed, trace, n_tok): K traces for each side of each row; the seed and the temperature reach the provider."""
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), asked(messages(f"trace_{s.lower()}", question="question", context="ck_text")).alias("prompt")) for s in ("PK", "CK"))))
    own = rows.select("qid", sides.alias("x")).select("qid", "x.side", "x.prompt")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(t).alias("temperature"), F.lit(seed).alias("seed")) for k, (t, seed) in TRACES.items())))
    own = own.select("qid", "side", "prompt", each.alias("t")).select("qid", "side", "prompt", "t.*")
    said = generated(own, "prompt", make, temperature=F.col("temperature"), seed=F.col("seed"), repetition=REPETITION, **how)
    return said.select("qid", "side", "k", "temperature", "seed", F.col("reply").alias("trace"), F.col("completion_tokens").cast("int").alias("n_tok"))


#: Models that a run may name: key to layers and width.
MODELS: dict[str, dict] = {"stub-small": {"layers": 16, "width": 64}, "stub-large": {"layers": 32, "width": 128}}


def register_model(key: str, layers: int, width: int, **more: object) -> None:
    """Makes a model known by its key: the number of its layers, the width of its states, and whatever else a provider needs to know."""
    if layers < 1 or width < 1:
        raise ValueError(f"{key}: layers and width are positive")
    MODELS[key] = {"layers": layers, "width": width} | more


def model_spec(key: str) -> dict:
    if key not in MODELS:
        raise KeyError(f"no model {key!r}; there are {sorted(MODELS)}")
    return MODELS[key]


def layer_index(key: str, share: float) -> int:
    """round(share * layers), halves to even; share from 0, the embeddings, to 1, the last layer."""
    if not 0 <= share <= 1:
        raise ValueError(f"share {share} is not in 0..1")
    return round(share * model_spec(key)["layers"])
