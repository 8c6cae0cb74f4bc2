"""Prompts as ARRAY<STRUCT<role, content>> columns. Templates are data: a caller may pass its own by name."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text

Shots = tuple[tuple[str, str], ...]

ABSTAIN = "If you are not sure, reply with exactly: I don't know."
#: name -> (system, user); fields in braces are columns. "+abstain" of any name appends ABSTAIN to the system text.
TEMPLATES: dict[str, tuple[str, str]] = {
    "probe": ("", "{question}\n{context}"),
    "pk": ("Reply with the answer alone.", "Question: {question}\nAnswer:"),
    "ck": ("Use the passage. Reply with the answer alone.", "Passage: {context}\nQuestion: {question}\nAnswer:"),
    "direct": ("Reply from the passage alone.", "{context}\n\nQuestion: {question}"),
    "implicit": ("A passage may be wrong. Weigh it against what you know and give the answer on one line.", "Passage: {context}\nQuestion: {question}"),
    "internal_eval": ("Is this answer right? Reply True or False.", "Question: {question}\nAnswer: {pk_answer}"),
    "context_eval": ("Does this passage answer the question correctly? Reply True or False.", "Passage: {context}\nQuestion: {question}"),
    "explicit": ("Compare your own answer with the passage's step by step. The last line holds only the final answer.", "Own answer: {pk_answer}\nPassage: {context}\nPassage's answer: {ck_answer}\nQuestion: {question}"),
    "filter": ("Copy the sentences of the passage that you trust and drop the rest.", "Question: {question}\nPassage: {context}"),
    "judge": ("", "Right answers, any of which will do: {gold}\nGiven answer: {candidate}\nDoes the given answer say one of the right ones? Reply YES or NO."),
    "trace_pk": ("Think step by step from memory, then answer.", "{question}"),
    "trace_ck": ("Think step by step with the passage, then answer.", "{context}\n{question}"),
    "ab": ("Choose A or B.", "{question}\nA: {pk_answer}\nB: {ck_answer}\nChoice:"),
    "self_judge": ("", "{question}\n{reasoning}\nDoes this reasoning lead to the right answer? A: yes. B: no.\nChoice:"),
}
#: Examples that stand before a template's own question.
SHOTS: dict[str, Shots] = {
    "internal_eval": (("Question: How many days has a leap year?\nAnswer: 366", "True"), ("Question: Which planet is nearest to the sun?\nAnswer: Venus", "False")),
    "context_eval": (("Passage: Water boils at 100 degrees Celsius at sea level.\nQuestion: At how many degrees Celsius does water boil at sea level?", "True"), ("Passage: A week has eight days.\nQuestion: How many days has a week?", "False")),
}


def pieces(template: str) -> list[tuple[bool, str]]:
    """(is a field, its name or the text) of a template."""
    return [(k % 2 == 1, p) for k, p in enumerate(re.split(r"\{(\w+)\}", template))]


def filled(template: str, fields: dict[str, Column | str]) -> Column:
    """The template with its fields put in; a field that isn't given stays as it is."""
    return F.concat(*((text(fields[p]) if p in fields else F.lit(f"{{{p}}}")) if is_field else F.lit(p) for is_field, p in pieces(template)))


def filled_text(name: str, templates: dict[str, tuple[str, str]] | None = None, **fields: Column | str) -> Column:
    """System and user text of a template as one text."""
    system, user = (templates or TEMPLATES)[name]
    return filled(f"{system}\n{user}" if system else user, fields)


def messages(name: str, shots: Shots = (), templates: dict[str, tuple[str, str]] | None = None, **fields: Column | str) -> Column:
    """System, few-shot pairs and user messages of a template."""
    base, _, option = name.partition("+")
    system, user = (templates or TEMPLATES)[base]
    system = f"{system} {ABSTAIN}".strip() if option == "abstain" else system
    said = [("system", F.lit(system))] if system else []
    for q, a in shots:
        said += [("user", F.lit(q)), ("assistant", F.lit(a))]
    said.append(("user", filled(user, fields)))
    return F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in said))
