"""Quality rules, line first: judge each line, take the failing ones out, then judge what is left of the document.

``judged(df)`` adds one struct column. Defined results: a null or blank text has no words and fails; white space is the
six ASCII characters; repeated rows are judged alike; very long texts are read whole; an empty table gives no row. Other columns pass
through untouched, whatever their names. Boilerplate phrases are English, French, Spanish and German.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, documents, short_batches, slim

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, n_bad_lines long, words_left long, kept boolean, clean_text string"
SYMBOLS = "#*$%&|<>"
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "cookie settings", "uses cookies", "accept cookies",
    "enable javascript", "click here", "subscribe to our", "sign up for", "log in to", "share on facebook", "share on twitter", "lorem ipsum", "copyright ©",
    "tous droits réservés", "politique de confidentialité", "accepter les cookies", "partager sur facebook", "cliquez ici", "mentions légales",
    "todos los derechos reservados", "política de privacidad", "política de cookies", "aceptar cookies", "compartir en facebook", "haga clic aquí",
    "alle rechte vorbehalten", "datenschutzerklärung", "cookies akzeptieren", "auf facebook teilen", "hier klicken", "allgemeine geschäftsbedingungen",
)
#: What a line is cut into to find navigation: a separator, white space, or other characters.
BARS = re.compile(r"[|»›·•]|\s+|[^\s|»›·•]+")
ENDS = (".", "!", "?", "…", ":", ";", '"', "'", "”", "’", "»", ")", "]", "。", "！", "？")


@dataclass(frozen=True)
class Rules:
    """Thresholds of the line rules and of the verdict."""

    symbols_a_word: float = 0.5  # a line with so many of SYMBOLS a word is junk
    upper_share: float = 0.7  # of the words of a line of long_line words or more
    bangs_a_word: float = 0.5
    long_line: int = 5
    distinct_share: float = 0.3  # fewer distinct words among repeat_line words or more: a loop
    repeat_line: int = 12
    unpunctuated: int = 40  # so many words without any mark inside or at the end: a list of words
    least_left: float = 0.6  # share of the words that must be left
    least_words: int = 10
    most_repeat: float = 0.2


def repeat_words(words: list[bytes], k: int = 5) -> int:
    """Words that lie in a k-word window found twice or more."""
    if len(words) <= k:
        return 0
    windows = list(zip(*(words[i:] for i in range(k)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen, covered, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + k - max(i, end)
            end = i + k
    return covered


def navigation(line: str) -> bool:
    r"""Whether the line has ``(?:\S+\s*[|»›·•]\s*){3,}`` or ``(?:\S+\s+>\s+){2,}``, in time that grows with its length alone.

    An item is some characters, then a separator, with white space around it or not. Kept is how many items in a row can have ended at the
    latest just here (done), how many came before an item whose characters are being read (open), and before one that awaits its separator
    behind white space (waits); a separator may end an item or be one of its characters."""
    done, open_, waits = -1, -1, -1
    for piece in BARS.findall(line):
        if piece.isspace():
            waits, open_ = max(open_, waits), -1
        elif piece in "|»›·•":
            done, open_, waits = max(open_, waits) + 1 if max(open_, waits) >= 0 else -1, max(open_, done, 0), -1
            if done >= 3:
                return True
        else:
            done, open_, waits = -1, max(open_, done, 0), -1
    if ">" not in line:
        return False
    parts = line.split()
    last = len(parts) - (0 if line[-1:].isspace() else 1)  # the last one has no white space behind it
    return any(parts[i] == ">" and parts[i - 2] == ">" for i in range(3, last))


def bad_line(line: str, words: list[str], rules: Rules, symbols: bool = True, phrases: tuple[str, ...] = BOILERPLATE) -> bool:
    """The rules for punctuation, navigation and boilerplate on one line that has words.

    symbols and phrases: what the whole document has of SYMBOLS and BOILERPLATE, so that no line is searched for the rest.
    """
    n = len(words)
    if symbols and (sum(map(line.count, SYMBOLS)) >= rules.symbols_a_word * n or ("|" in line or ">" in line) and navigation(line)):
        return True
    if phrases and any(p in line.lower() for p in phrases) or any(c in line for c in "»›·•") and navigation(line):
        return True
    if n >= rules.long_line and (line.count("!") >= rules.bangs_a_word * n or sum(map(str.isupper, words)) > rules.upper_share * n):
        return True
    if n >= rules.repeat_line and len(set(words)) < rules.distinct_share * n:
        return True
    return n >= rules.unpunctuated and not line.rstrip(SPACES).endswith(ENDS) and not any(w.endswith(ENDS + (",",)) for w in words)


def judge(text: str | None, rules: Rules) -> tuple:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n, spaces = len(words), sum(map(text.count, SPACES))
    repeated = repeat_words(words)
    base_failed = n < rules.least_words or 100 * repeated > 100 * rules.most_repeat * n
    low, symbols = text.lower(), sum(map(text.count, SYMBOLS))
    phrases = tuple(p for p in BOILERPLATE if p in low)
    cut = str.split if len(text.split()) == n else lambda line: [w for w in re.split("[ \t\n\x0b\x0c\r]+", line) if w]
    full, bad, left, out = [], 0, 0, []
    for line in text.split("\n"):
        if not (own := cut(line)):
            out.append(line)
            continue
        full.append(line)
        if bad_line(line, own, rules, symbols > 0, phrases):
            bad += 1
        else:
            left += len(own)
            out.append(line)
    kept = not base_failed and left >= rules.least_words and left >= rules.least_left * n
    return n, len(text) - spaces, symbols, len(full) - len(set(full)), repeated, base_failed, len(full), bad, left, kept, "\n".join(out)


def judged(df: DataFrame, name: str, text: str = "text", rules: Rules = Rules(), *, clean: bool = True) -> DataFrame:
    """``df`` with a struct ``name`` of FIELDS; without ``clean`` the cleaned text stays null."""
    short_batches(df.sparkSession)

    @F.pandas_udf(FIELDS)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in FIELDS.split(", ")]
        for texts in parts:
            rows = [judge(t, rules) for t in texts]
            yield pd.DataFrame(rows if clean else [(*r[:-1], None) for r in rows], columns=names)
        slim()

    return df.withColumn(name, run(F.col(f"`{text}`").cast("string")))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judged(documents(spark, sf_dir).select("doc_id", "text"), "j", clean=False)
    return out.select("doc_id", *(f"j.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_bad_lines", "words_left")))


_CUT = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_END = "right({}, 1) IN (" + ", ".join("'" + e.replace("'", "''") + "'" for e in ENDS) + ")"
OP1_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_CUT.format("text")} AS ws FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, g FROM win GROUP BY 1, 2 HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS covered FROM win JOIN rep USING (doc_id, g), (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY 1),
ln AS (SELECT doc_id, line, {_CUT.format("line")} AS lw FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
nav AS (SELECT *, len(lw) AS n, regexp_matches(line, '(?:\S+\s*[|»›·•]\s*){{3,}}|(?:\S+\s+>\s+){{2,}}') AS has_nav, len(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS syms FROM ln WHERE len(lw) > 0),
lb AS (SELECT *, syms >= 0.5 * n OR has_nav OR {" OR ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)}
  OR (n >= 5 AND (len(regexp_replace(line, '[^!]', '', 'g')) >= 0.5 * n OR len(list_filter(lw, lambda x: x = upper(x) AND x <> lower(x))) > 0.7 * n))
  OR (n >= 12 AND len(list_distinct(lw)) < 0.3 * n)
  OR (n >= 40 AND NOT {_END.format("lw[-1]")} AND len(list_filter(lw, lambda x: {_END.format("x")} OR right(x, 1) = ',')) = 0) AS bad FROM nav),
la AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (bad) AS n_bad, coalesce(sum(n) FILTER (NOT bad), 0)::BIGINT AS words_left FROM lb GROUP BY 1),
j AS (SELECT w.doc_id, len(ws) AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
  coalesce(covered, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_bad, 0) AS n_bad_lines, coalesce(words_left, 0) AS words_left FROM w LEFT JOIN la USING (doc_id) LEFT JOIN cov USING (doc_id)),
k AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND words_left >= 10 AND words_left >= 0.6 * n_words AS kept, n_lines, n_bad_lines, words_left FROM k
"""
