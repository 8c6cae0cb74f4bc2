"""Answer-text functions as native columns; none leaves the JVM.

Python's truth rules hold throughout: null and the empty string are both "no text".
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that normalising drops, and the words for yes and no.
STOP_WORDS = ("a", "an", "the", "and", "of")
YES_WORDS = ("yes", "true", "correct", "right", "affirmative", "definitely", "indeed")
NO_WORDS = ("no", "false", "incorrect", "wrong", "negative", "not")
#: Fixed value: what may stand before an answer.
ANSWER_PREFIX = r"(?i)^\s*\**\s*(?:final\s+answer|final\s+judgment|final\s+judgement|answer)\s*:?\s*\**\s*"
#: Fixed value: marks that are dropped at an answer's end.
END_MARKS = ".!?,;:"
#: What Python's strip() takes off.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
#: Where Python's splitlines() breaks a text.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
MATCH_LEVEL = 0.8


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text(x: Column | str) -> Column:
    return F.coalesce(col(x).cast("string"), F.lit(""))


def stripped(x: Column | str) -> Column:
    return F.btrim(text(x), F.lit(BLANKS))


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def tokens(x: Column | str) -> Column:
    """The words that normalising keeps, in order; [] for no text."""
    words = F.split(F.regexp_replace(F.lower(text(x)), r"[^\p{L}\p{N}_]+", " "), " ")
    return F.filter(words, lambda t: (t != "") & ~t.isin(*STOP_WORDS))


def normalise(x: Column | str) -> Column:
    """Lower-case words without punctuation and stop words, joined by single spaces."""
    return F.array_join(tokens(x), " ")


def word_contains(hay: Column | str, needle: Column | str) -> Column:
    """Whether normalised ``hay`` has the whole words of ``needle`` in a row; an empty needle is nowhere."""
    h, n = text(hay), text(needle)
    return (n != "") & F.contains(F.concat(F.lit(" "), h, F.lit(" ")), F.concat(F.lit(" "), n, F.lit(" ")))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Jaccard similarity of two token arrays as sets; 0.0 if either is empty."""
    a, b = col(a), col(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)).cast("double")).otherwise(F.lit(0.0))


def matched(answer: Column, mine: Column, aliases: Column) -> Column:
    """The cascade on normalised text: equal, contained as words either way, or token sets alike where the alias has two tokens.
    mine: the answer's distinct tokens."""

    def alike(theirs: Column) -> Column:
        return bound(F.size(F.array_intersect(mine, theirs)), lambda both: both / (F.size(mine) + F.size(theirs) - both).cast("double") >= MATCH_LEVEL)

    def one(alias: Column) -> Column:
        near = F.when(F.contains(alias, F.lit(" ")), bound(F.array_distinct(F.split(alias, " ")), alike)).otherwise(F.lit(False))
        return (alias != "") & ((answer == alias) | word_contains(answer, alias) | word_contains(alias, answer) | near)

    return F.coalesce((answer != "") & F.exists(aliases, one), F.lit(False))


def matches(answer: Column | str, *groups: Column | str) -> Column:
    """For each array of aliases whether the answer says one of them, as an array; the answer is normalised once, and so is each alias."""

    def each(a: Column) -> Column:
        return bound(F.array_distinct(F.split(a, " ")), lambda mine: F.transform(F.array(*(col(g) for g in groups)), lambda g: bound(F.transform(g, lambda x: normalise(x)), lambda ng: matched(a, mine, ng))))

    return bound(normalise(answer), each)


def alias_match(answer: Column | str, aliases: Column | str) -> Column:
    """Whether an answer says one of the aliases (an array). No answer or no alias is no match."""
    return F.get(matches(answer, aliases), F.lit(0))


is_correct = alias_match


def yes_no_match(answer: Column | str, gold: Column | str) -> Column:
    """Whether the first word's polarity is among the gold values "True" and "False"."""
    first = F.get(tokens(answer), F.lit(0))
    said = F.when(first.isin(*YES_WORDS), "true").when(first.isin(*NO_WORDS), "false")
    return F.coalesce(F.exists(col(gold), lambda g: F.lower(g) == said), F.lit(False))


def strip_markdown(x: Column | str) -> Column:
    """Take off ``**`` pairs that wrap a text, as many as there are, then one at the start and one at the end."""

    def wrapped(s: Column) -> Column:
        return F.startswith(s, F.lit("**")) & F.endswith(s, F.lit("**")) & (F.length(s) > 4)

    def unwrapped(s: Column) -> Column:
        return F.when(wrapped(s), F.btrim(F.substring(s, F.lit(3), F.length(s) - 4), F.lit(BLANKS))).otherwise(s)

    def all_off(s: Column) -> Column:
        return F.when(wrapped(s), F.aggregate(F.sequence(F.lit(1), (F.length(s) / 4).cast("int")), s, lambda t, _: unwrapped(t))).otherwise(s)

    def start_off(s: Column) -> Column:
        return F.when(F.startswith(s, F.lit("**")), F.btrim(F.substring(s, F.lit(3), F.length(s)), F.lit(BLANKS))).otherwise(s)

    def end_off(s: Column) -> Column:
        return F.when(F.endswith(s, F.lit("**")), F.btrim(F.substring(s, F.lit(1), F.length(s) - 2), F.lit(BLANKS))).otherwise(s)

    return bound(bound(bound(stripped(x), all_off), start_off), end_off)


def clean_answer(x: Column | str) -> Column:
    """An answer line without markdown, a leading "Answer:" and marks at its end."""
    return F.rtrim(stripped(strip_markdown(F.regexp_replace(strip_markdown(x), ANSWER_PREFIX, ""))), F.lit(END_MARKS))


def lines(x: Column | str) -> Column:
    """The stripped lines that are not blank."""
    return F.filter(F.transform(F.split(text(x), LINE_BREAK), lambda s: F.btrim(s, F.lit(BLANKS))), lambda s: s != "")


def first_line(x: Column | str) -> Column:
    """The first line that is not blank, cleaned; '' if there is none."""
    return F.coalesce(clean_answer(F.get(lines(x), F.lit(0))), F.lit(""))


def last_line(x: Column | str) -> Column:
    """The last line that is not empty after cleaning; '' if there is none."""
    return F.coalesce(F.try_element_at(F.filter(F.transform(lines(x), lambda s: clean_answer(s)), lambda s: s != ""), F.lit(-1)), F.lit(""))


def parse_true_false(x: Column | str) -> Column:
    """True or false by the word that comes first; null if neither occurs."""
    t = F.lower(text(x))
    yes, no = F.instr(t, "true"), F.instr(t, "false")
    return F.when((yes > 0) & ((no == 0) | (yes < no)), True).when(no > 0, False)


def generated_line(x: Column | str) -> Column:
    """The first line of a generation."""
    return F.btrim(F.get(F.split(stripped(x), "\n"), F.lit(0)), F.lit(BLANKS))


def parse_judge(reply: Column | str, candidate: Column | str) -> Column:
    """(decision, reply) of a YES/NO judge; an empty candidate is false without a call."""
    no = stripped(candidate) == ""
    return F.when(no, F.struct(F.lit(False).alias("decision"), F.lit("empty_candidate").alias("reply"))).otherwise(F.struct(F.startswith(F.upper(stripped(reply)), F.lit("YES")).alias("decision"), text(reply).alias("reply")))


def gold_list(aliases: Column | str) -> Column:
    """The aliases that say something, between bars."""
    return F.array_join(F.filter(col(aliases), lambda a: a.isNotNull() & (a != "")), " | ")


def middle_truncate(toks: Column | str, most: int, head: int = 512) -> Column:
    """At most ``most`` tokens: the first ``head`` and the last of the rest."""
    toks = col(toks)
    return F.when(F.size(toks) > most, F.concat(F.slice(toks, 1, head), F.slice(toks, head - most, most - head))).otherwise(toks)


def truncate_context(question: Column | str, context: Column | str, most: int, marker: str = " [truncated]") -> Column:
    """(prompt, truncated): question, line break and context in ``most`` white-space tokens; the context's tail goes first.

    Where 32 tokens or fewer would be left for the context, the prompt is cut hard.
    """
    q, c = text(question), text(context)
    prompt = F.concat(q, F.lit("\n"), c)

    def toks(x: Column) -> Column:
        return F.filter(F.split(x, r"\s+"), lambda t: t != "")

    room = F.lit(most) - F.size(toks(q)) - F.lit(len(marker.split())) - F.lit(4)
    cut = F.when(room <= 32, F.array_join(F.slice(toks(prompt), 1, most), " ")).otherwise(F.concat(q, F.lit("\n"), F.array_join(F.slice(toks(c), F.lit(1), F.greatest(room, F.lit(0))), " "), F.lit(marker)))
    over = F.size(toks(prompt)) > most
    return F.struct(F.when(over, cut).otherwise(prompt).alias("prompt"), over.alias("truncated"))


def shown(x: Column | str, kind: str = "double") -> Column:
    """For reports: a dash for null, three places for a float."""
    x = col(x)
    return F.when(x.isNull(), "—").otherwise(F.format_string("%.3f", x.cast("double")) if kind in ("double", "float") else x.cast("string"))


def now_iso() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")


def question_hash(x: Column | str) -> Column:
    """The key of a question in the answer cache."""
    return F.substring(F.sha1(text(x).cast("binary")), 1, 16)
