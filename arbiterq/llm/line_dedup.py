"""Fuzzy line deduplication by MinHash, in DataFrame operations only.

1. Lines. A text is split at \\n; a line is compared lower-cased and without outer white space. Lines shorter than
   ``min_chars`` are copies only of equal lines: they say too little to be called near copies.
2. Similarity is the Jaccard similarity of the sets of all SHINGLE-character strings of two lines (units of UTF-16; sets of 64-bit
   hashes), so that every character of any script counts. It is computed whole and exactly for every pair of step 4.
3. Signatures find the pairs: BANDS x ROWS minima of the hashes of some shingles under XOR with fixed constants (each a permutation of the
   hashes), as plain aggregates by line, so equal lines are one row with a count. Short lines, and those without spaces, give all their
   shingles; longer ones those that start where a word starts: a sample by content, which an edit hits in the same proportion as all.
   Lines near a limit are dealt on both sides of it, so that two alike lines never miss each other there.
   A pair at similarity 0.8 shares a band with probability 1 - (1 - 0.8^3)^8 = 0.997, at 0.85 with 0.9995; the tests measure it.
4. In each band's bucket the most frequent line is a centre; of the lines whose sketches (two bits of each minimum) leave no hope
   that they are alike it, the most frequent is the next, and so on for CENTRES. Each line is verified with its centre. Then come the
   pairs that this leaves open, those of which one line at least is not alike a centre: in buckets of up to FEW lines one by one, where
   sketches leave hope. In larger ones they are found by
   their differences from the centre: a line x that is not alike a line r can be alike a line y only if they differ from
   r in some same shingle; were the symmetric differences D(x) and D(y) with r disjoint, x and y would have J(x, y) <= J(x, r).
   Indeed they share (|D(x)| + |D(y)| - (|x| + |y|) / 9) / 2 or more of them at similarity 0.8, so a prefix filter finds every such
   pair; where they first meet in its order, what either has left of its differences must still make up that number, which leaves few
   pairs besides the alike ones. What x has and r lacks comes first, rare ones before others. Before that, each line is verified with the
   one that differs least of those that share a difference, and no pairs are made within the components that this leaves: a thousand lines
   alike one another are some thousand pairs. Of the pairs each line's likeliest, by sketch, are verified first;
   then all those that still join two components. No bucket has a cap.
5. Distributed union-find; the first line of each component (least doc_id, then place in the text) stays.

Defined results: a null text stays null; lines without words stay; equal rows (id and text) count as one document and get the
same result; rows without an id come before others; very long texts and lines are read whole; an empty table gives no row. Other columns
pass through untouched, whatever their names. Lines are told apart by 64-bit hashes: of 10^11 different lines some 300 pairs pass as equal.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, documents, forget, fresh, written
from .graph import components

SHINGLE, BANDS, ROWS, THRESHOLD, MIN_CHARS = 8, 8, 3, 0.8, 24
#: Characters up to which a line gives all its shingles, and from which those at the starts of words.
SHORT, LONG = 96, 72
#: Characters a word from which a line is also taken as one without spaces, and from which as that alone.
WIDE, WIDEST = 10, 14
#: Lines of a bucket that are compared pair by pair where its centres leave them apart, and the centres of a bucket.
FEW, CENTRES = 32, 3
#: Minima whose two bits may differ in a pair that is verified: at similarity 0.8 more do once in 20,000 times.
MOST_ODD = 11
#: Shingles of a line that one row holds while minima are taken: at 12, methods outgrow what the JVM compiles, and take five times as long.
AT_ONCE = 8
#: Rows of some forty bytes that may be sent to every executor (20 MB).
MOST_SENT = 500_000


def trimmed(line: Column) -> Column:
    """A line without outer white space; btrim, which maps every character of a line, sees only those that have some."""
    ends = reduce(or_, (f(line, F.lit(c)) for c in SPACES for f in (F.startswith, F.endswith)))
    return F.when(ends, F.btrim(line, F.lit(SPACES))).otherwise(line)


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def units(line: Column) -> Column:
    """A line in units of two bytes, so that a shingle is cut out without walking to its place."""
    return F.encode(line, "UTF-16BE")


def last_place(u: Column) -> Column:
    """Where the last shingle of a line's units starts; a line shorter than a shingle is one."""
    return F.greatest(F.lit(0), (F.length(u) / 2 - SHINGLE).cast("int"))


def shingle(u: Column, at: Column) -> Column:
    return F.substring(u, at * 2 + 1, F.lit(2 * SHINGLE))


def shingles(line: Column) -> Column:
    """The hashes of a line's shingles, repeats included. The sequence has the bytes where they start, so that a lambda only cuts and hashes."""

    def hashes(u: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), last_place(u) * 2 + 1, F.lit(2)), lambda at: F.xxhash64(F.substring(u, at, F.lit(2 * SHINGLE))))

    return bound(units(line), hashes)


def constant(i: int) -> int:
    """The i-th of the fixed 32-bit numbers, by the multiples of the golden ratio."""
    x = (i * 0x9E3779B97F4A7C15 + 0x5DEECE66D) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = (x ^ (x >> 27)) & 0xFFFFFFFF
    return x - 2**32 if x >> 31 else x


def samples(lines: DataFrame) -> DataFrame:
    """(h, kind, one, x0, x1, ...): the hashes of the shingles that a line (h, line) gives, AT_ONCE a row, where the last one fills up;
    kind 0: all, 1: at the starts of words; one: 1 for the first row. Without lambdas, and without the filters that an inner explode
    implies, all of it is compiled code that makes each array once."""
    size, n = F.length("line"), F.size("words")
    own = lines.select("h", "line", F.split("line", " ").alias("words"))
    every, starts = (size <= SHORT) | (size > WIDE * n), (size >= LONG) & (size < WIDEST * n)
    kinds = F.when(every & starts, F.array(F.lit(0), F.lit(1))).when(every, F.array(F.lit(0))).otherwise(F.array(F.lit(1)))
    everything, at = F.col("kind") == 0, F.col("at")
    dealt = own.select("h", "line", "words", F.explode_outer(kinds).alias("kind")).select("h", "kind", "words", F.when(everything, units(F.col("line"))).alias("u"))
    dealt = dealt.withColumn("last", F.when(everything, last_place(F.col("u"))).otherwise(n - 1))
    each = dealt.select("h", "kind", "words", "u", "last", F.explode_outer(F.sequence(F.lit(0), F.col("last"), F.lit(AT_ONCE))).alias("at"))

    def x(at: Column) -> Column:
        start = F.left(F.concat(F.get("words", at), F.lit(" "), F.coalesce(F.get("words", at + 1), F.lit(""))), F.lit(SHINGLE))
        return F.hash(F.when(everything, shingle(F.col("u"), at)).otherwise(start.cast("binary")))

    return each.select("h", "kind", (at == 0).cast("int").alias("one"), *(x(F.least(at + j, F.col("last"))).alias(f"x{j}") for j in range(AT_ONCE)))


def signatures(lines: DataFrame) -> DataFrame:
    """(h, kind, n, m0, m1, ...) of each different line; n: how often it occurs."""
    least = (F.least(*(F.col(f"x{j}").bitwiseXOR(F.lit(constant(i + 1))) for j in range(AT_ONCE))) for i in range(BANDS * ROWS))
    return samples(lines).groupBy("h", "kind").agg(F.sum("one").alias("n"), *(F.min(x).alias(f"m{i}") for i, x in enumerate(least)))


def sketch() -> Column:
    """The two lowest bits of each minimum."""
    out = F.lit(0).cast("long")
    for i in range(BANDS * ROWS):
        out = out.bitwiseOR(F.shiftleft(F.col(f"m{i}").bitwiseAND(F.lit(3)).cast("long"), 2 * i))
    return out


def odd(a: Column, b: Column) -> Column:
    """How many pairs of bits differ in two sketches."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def buckets(lines: DataFrame) -> DataFrame:
    """(band, h, sketch, members, level, rep, odd_rep) of the lines that share a band; rep: the centre of the level, the first whose sketch leaves hope."""
    bands = F.array(*(F.xxhash64("kind", F.lit(b), *(f"m{i}" for i in range(b * ROWS, (b + 1) * ROWS))) for b in range(BANDS)))
    dealt = signatures(lines).select("h", "n", sketch().alias("sketch"), F.explode_outer(bands).alias("band"))
    seen = dealt.withColumn("members", F.count("*").over(Window.partitionBy("band"))).where("members > 1").withColumn("level", F.lit(0))
    for level in range(CENTRES):  # no line leaves its band's task
        seen = seen.withColumn("top", F.max(F.struct("n", "h", "sketch")).over(Window.partitionBy("band", "level"))).withColumn("odd_rep", odd(F.col("sketch"), F.col("top.sketch")))
        if level < CENTRES - 1:
            seen = seen.withColumn("level", F.col("level") + ((F.col("level") == level) & (F.col("odd_rep") > MOST_ODD)).cast("int"))
    return seen.select("band", "h", "sketch", "members", "level", F.col("top.h").alias("rep"), "odd_rep")


def joined_few(df: DataFrame, few: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join with a table that has each key once; it is broadcast only if its size allows."""
    return df.join(F.broadcast(few) if few.limit(MOST_SENT + 1).count() <= MOST_SENT else few, on, how)


def with_sets(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """``pairs`` (h, rep, ...) with the shingles a and b of both. ``lines``: (h, line), one row each. Sets are eight times the size
    of lines, so lines meet their pairs, and sets are made there. Both joins read one shuffle of the lines, as neither renames a column before it."""
    both = pairs.alias("p").join(lines.alias("x"), F.expr("p.h = x.h")).join(lines.alias("y"), F.expr("p.rep = y.h"))
    return both.select("p.*", shingles(F.col("x.line")).alias("a"), shingles(F.col("y.line")).alias("b"))


def verified(pairs: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """``pairs`` (h, rep) of distinct lines with ``far``, the Jaccard distance of their shingle sets, and ``same``: whether their similarity
    reaches the threshold."""
    shared = with_sets(pairs, lines).select("h", "rep", F.size(F.array_intersect("a", "b")).alias("both"), F.size(F.array_union("a", "b")).alias("either"))
    return shared.select("h", "rep", (1 - F.col("both") / F.col("either")).alias("far"), (F.col("both") >= F.lit(threshold) * F.col("either")).alias("same"))


def hope(x: str = "x", y: str = "y") -> Column:
    return odd(F.col(f"{x}.sketch"), F.col(f"{y}.sketch")) <= MOST_ODD


def pair_of(x: str = "x", y: str = "y") -> tuple[Column, Column, Column]:
    """(h, rep, far) of two rows, the greater line first."""
    a, b = F.col(f"{x}.h"), F.col(f"{y}.h")
    return F.greatest(a, b).alias("h"), F.least(a, b).alias("rep"), odd(F.col(f"{x}.sketch"), F.col(f"{y}.sketch")).alias("far")


def named(rows: DataFrame, links_: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with ``c_<key>`` of each key: the component of that line under the links (h, rep), or the line itself."""
    of = written(components(links_.select(F.col("h").alias("u"), F.col("rep").alias("v"))), "of")
    for key in keys:
        rows = rows.join(of.select(F.col("node").alias(key), F.col("component").alias(f"c_{key}")), key, "left").withColumn(f"c_{key}", F.coalesce(f"c_{key}", key))
    return rows


def differences(stars: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """(h, rep, sketch, own, same, t, ...): the shingles t in which lines differ from a centre of which at least one line of its bucket
    is not alike, as far as a prefix filter needs them and two lines have them. stars: (h, rep, sketch, own, same); lines that aren't the
    centre's own, but of a later level, are not alike it, and are not paired among themselves here.

    A pair at the threshold t shares k or more of the shingles in which they differ from the centre r: with q = (1 - t) / (1 + t),
    2k >= |D(x)| + |D(y)| - q (|x| + |y|). As |D(x)| >= |D(y)| - q (|x| + |y|) and |x| <= |y| / t, seen from any y
    k >= |D(y)| - q (1 + 1 / t) |y|, and if |D(y)| <= |D(x)| even k >= |D(y)| - q (1 + 1 / t) |y| / 2. For x alike r and y not,
    |D(y)| > q (|y| + |r|), so 2k > |D(x)| + q (|r| - |x|); for both not, k > q |r|. In any order of the shingles, the first
    |D| - k + 1 of either hold a common one. The order: what x has and r lacks, then what r has and x lacks, rare ones first. Where the first
    part alone is more than that, the second is not dealt out: no pair can meet there, and rareness counts what is dealt out.

    ``room`` and ``more`` bound what two lines share if t is the first that they share: least(room) + least(more), where room is what a
    line has from t on in its part of the order, and more is all of the second part for a t of the first. A t of the second part is in
    a prefix only behind all of the first, so a pair that shares one of the first meets there. ``w``: |D(x)| - q |x|.
    """
    q = (1 - threshold) / (1 + threshold)
    whole = stars.join(stars.where("not same").select("rep").distinct(), "rep", "left_semi")
    keys = ("h", "rep", "sketch", "own", "same")
    each = with_sets(whole, lines).select(*keys, F.size(F.array_distinct("a")).alias("nx"), F.array_except("a", "b").alias("new"), F.array_except("b", "a").alias("lost"))
    each = each.withColumns({"n_new": F.size("new"), "n_lost": F.size("lost"), "nd": F.size("new") + F.size("lost")})
    each = each.withColumn("nr", F.col("nx") - F.col("n_new") + F.col("n_lost"))

    def at_least(*k: Column) -> Column:
        return F.greatest(F.lit(1), *(F.ceil(x - 1e-9) for x in k)).cast("int")

    slack, other = F.lit(q * (1 + 1 / threshold)) * F.col("nx"), F.lit(q) * F.col("nr")
    any_, alike = F.col("nd") - slack, (F.col("nd") + F.lit(q) * (F.col("nr") - F.col("nx"))) / 2
    need = {"k": F.when(F.col("same"), at_least(alike)).otherwise(at_least(any_)), "large": at_least(any_, other), "small": at_least(F.col("nd") - slack / 2, other)}
    each = each.withColumns(need).withColumn("w", F.col("nd") - F.lit(q) * F.col("nx"))
    far_on = F.col("n_new") > F.col("nd") - F.least(*need)  # no prefix of this line reaches the second part
    dealt = each.select(*keys, "nd", "n_new", "n_lost", "w", *need, F.posexplode_outer(F.when(far_on, F.col("new")).otherwise(F.concat("new", "lost"))).alias("i", "t")).where("t is not null").withColumn("is_new", F.col("i") < F.col("n_new")).drop("i")
    dealt = dealt.withColumn("often", F.count("*").over(Window.partitionBy("rep", "t")))
    dealt = dealt.withColumn("at", F.row_number().over(Window.partitionBy("rep", "h", "is_new").orderBy("often", "t")) - 1)
    place = F.col("at") + F.when(F.col("is_new"), 0).otherwise(F.col("n_new"))
    within = {f"in_{k}": place <= F.col("nd") - F.col(k) for k in need}
    room, more = F.when(F.col("is_new"), F.col("n_new")).otherwise(F.col("n_lost")) - F.col("at"), F.when(F.col("is_new"), F.col("n_lost")).otherwise(0)
    kept = dealt.where("often > 1").select(*keys, "t", "nd", "w", room.alias("room"), more.alias("more"), *(v.alias(k) for k, v in within.items()))
    return written(kept.where("in_k or in_large or in_small"), "differences")


#: Whether two lines may be alike that share a difference, if it is their first.
MAY = "2 * (least(x.room, y.room) + least(x.more, y.more)) + 1e-6 >= x.w + y.w"


def nearest(dealt: DataFrame) -> DataFrame:
    """(h, rep): of the lines that share a difference, each with the one that differs least, where they may be alike: links that spare
    ``crossing`` the pairs of one component. As many rows as lines have differences at most."""
    x = dealt.withColumn("y", F.min(F.struct("nd", "h", "sketch", "same", "own", "w", "room", "more")).over(Window.partitionBy("rep", "t")))
    x = x.select("y", F.struct(*(c for c in x.columns if c != "y")).alias("x"))
    return x.where(F.expr(f"x.h <> y.h and not (x.same and y.same) and (x.own or y.own) and {MAY}") & hope()).select(*pair_of()).select("h", "rep").distinct()


def crossing(dealt: DataFrame) -> DataFrame:
    """(h, rep, far): pairs of lines in different components (c_h) that may be alike, and how far apart their sketches are, though at
    least one of them is not alike their common centre. dealt: ``differences``."""
    met = F.expr(f"x.rep = y.rep and x.t = y.t and x.c_h <> y.c_h and {MAY}") & hope()

    def pairs(x: DataFrame, y: DataFrame, and_: str = "true") -> DataFrame:
        return x.alias("x").join(y.alias("y"), met & F.expr(and_)).select(*pair_of())

    one = pairs(dealt.where("not same and in_k"), dealt.where("same and in_k"))
    two = pairs(dealt.where("not same and in_small"), dealt.where("not same and in_large"), "(x.own or y.own) and (x.nd < y.nd or x.nd = y.nd and x.h < y.h)")
    return one.unionByName(two).distinct()


def met(lines: DataFrame, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ``buckets`` of ``lines`` (h, line); the pairs (h, rep) of lines with their centres; the lines (h) whose texts pairs may need."""
    own = written(buckets(lines.where(F.length("line") >= min_chars)), "buckets")
    forget()
    pairs = written(own.where((F.col("h") != F.col("rep")) & (F.col("odd_rep") <= MOST_ODD)).select("h", "rep").distinct(), "pairs")
    return own, pairs, pairs.select("h").unionByName(pairs.select(F.col("rep").alias("h"))).unionByName(own.where("members > 2").select("h")).distinct()


def links(lines: DataFrame, threshold: float = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """(u, v): verified links that span the components of ``lines`` (h, line)."""
    own, pairs, needed = met(lines, min_chars)
    return spanning(own, pairs, each_once(joined_few(lines, needed, "h")), threshold)


def each_once(lines: DataFrame) -> DataFrame:
    return written(lines.groupBy("h", "line").agg(F.lit(1)).select("h", "line"), "texts")


def spanning(own: DataFrame, pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The links (u, v) of lines that ``met``. texts: (h, line), one row each."""
    forget()
    found = written(verified(pairs, texts, threshold), "verified")
    forget()
    out = found.where("same")
    same = F.coalesce(F.col("same"), F.col("h") == F.col("rep"))
    apart = written(own.where("members > 2").join(found, ["h", "rep"], "left").withColumn("same", same).drop("odd_rep"), "apart")
    if apart.where("not same or level > 0").limit(1).count():
        small = apart.where(F.col("members") <= FEW)
        # distances obey the triangle inequality: from one centre, two alike lines are about equally far
        apart_enough = f"coalesce(x.rep = y.rep and abs(x.far - y.far) > {1 - threshold + 1e-9!r}, false)"
        near = F.expr(f"x.band = y.band and x.h > y.h and not (x.rep = y.rep and x.same and y.same) and not {apart_enough}") & hope()
        more = small.alias("x").join(small.alias("y"), near).select(*pair_of())
        known = found.select(F.greatest("h", "rep").alias("h"), F.least("h", "rep").alias("rep"))
        large = apart.where(F.col("members") > FEW)
        if large.limit(1).count():
            centres = large.select(F.col("band").alias("b"), F.col("level").alias("l"), "rep").distinct()
            later = large.drop("rep").join(centres, F.expr("band = b and level > l")).select("h", "rep", "sketch", F.lit(False).alias("own"), F.lit(False).alias("same"))
            stars = large.where("h <> rep").select("h", "rep", "sketch", F.lit(True).alias("own"), "same").unionByName(later)
            stars = stars.groupBy("h", "rep").agg(F.max(F.struct("own", "same", "sketch")).alias("s")).select("h", "rep", "s.*")
            dealt = differences(stars, texts, threshold)
            forget()
            close = written(verified(written(nearest(dealt).join(known, ["h", "rep"], "left_anti"), "nearest"), texts, threshold), "verified")
            forget()
            out = out.unionByName(close.where("same"))
            known = known.unionByName(close.select("h", "rep"))
            more = more.unionByName(crossing(written(named(dealt, out, "h"), "named")))
        more = written(more.distinct().join(known, ["h", "rep"], "left_anti"), "crossing")
        forget()
        likely = more.groupBy("h").agg(F.min(F.struct("far", "rep")).alias("b")).select("h", "b.rep").unionByName(more.groupBy("rep").agg(F.min(F.struct("far", "h")).alias("b")).select("b.h", "rep")).distinct()
        likely = written(verified(written(likely, "likely"), texts, threshold), "verified")
        out = out.unionByName(likely.where("same"))
        rest = written(named(more.join(likely.select("h", "rep"), ["h", "rep"], "left_anti"), out, "h", "rep").where("c_h <> c_rep").select("h", "rep"), "open")
        out = out.unionByName(verified(rest, texts, threshold).where("same"))
    return out.select(F.col("h").alias("u"), F.col("rep").alias("v"))


def exploded(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(key, id, pos, h, line) of every line that has words; key tells texts apart that share an id."""
    own = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("key"), F.split(F.col(f"`{text}`"), "\n").alias("ls"))
    lines = own.select("key", "id", F.posexplode_outer("ls").alias("pos", "line"))
    # no filter is pushed below an explode of one, so that none trims and lower-cases each line once more
    lines = lines.select("key", "id", "pos", F.explode_outer(F.array(F.lower(trimmed(F.col("line"))))).alias("line")).where("line <> ''")
    return lines.withColumn("h", F.xxhash64("line"))


def removed(df: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, id, gone): the places of the lines that go, for each document that has such lines."""
    lines = exploded(df, id_col, text)  # made twice: the texts of all would take as much disk as the input
    own, pairs, needed = met(lines.select("h", "line"), min_chars)
    wide = joined_few(lines, needed.withColumn("met", F.lit(True)), "h", "left")
    wide = written(wide.select("key", "id", "pos", "h", F.when(F.col("met"), F.col("line")).alias("line")), "texts")
    at, texts = written(wide.drop("line"), "lines"), each_once(wide.where("line is not null").select("h", "line"))
    forget(wide)
    named = components(written(spanning(own, pairs, texts, threshold), "links")).withColumnRenamed("node", "h").withColumnRenamed("component", "c")
    forget()
    often = at.groupBy("h").agg(F.count("*").alias("times")).join(named, "h", "left").where("times > 1 or c is not null")
    often = written(often.select("h", F.coalesce("c", "h").alias("c")), "often")
    again = written(joined_few(at, often, "h"), "again")
    stays = again.groupBy("c").agg(F.min(F.struct("id", "pos", "key")).alias("stays"))
    gone = joined_few(again, written(stays, "stays"), "c").where(~F.struct("id", "pos", "key").eqNullSafe(F.col("stays")))
    out = written(gone.groupBy("key", "id").agg(F.collect_set("pos").alias("gone")), "gone")
    forget(at, often, again)
    return out


def deduped(df: DataFrame, name: str, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """``df`` with a struct ``name``: text (what is left), n_lines, n_removed."""
    key, other, id_, gone = (fresh(df, stem) for stem in ("hash_of_text", "key_of_gone", "id_of_gone", "gone"))
    out = removed(df, id_col, text, threshold, min_chars).select(F.col("key").alias(other), F.col("id").alias(id_), F.col("gone").alias(gone))
    out = F.broadcast(out) if (out.select(F.sum(F.size(gone) + 10)).first()[0] or 0) <= 4 * MOST_SENT else out  # numbers of four or eight bytes
    joined = df.withColumn(key, F.xxhash64(F.col(f"`{text}`"))).join(out, (F.col(key) == F.col(other)) & F.col(f"`{id_col}`").eqNullSafe(F.col(id_)), "left")
    ls = F.split(F.col(f"`{text}`"), "\n")
    breaks = F.octet_length(F.col(f"`{text}`")) - F.octet_length(F.replace(F.col(f"`{text}`"), F.lit("\n"), F.lit("")))  # without splitting what stays whole
    left = F.when(F.col(gone).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(F.filter(ls, lambda _, i: ~F.array_contains(gone, i)), "\n"))
    return joined.withColumn(name, F.struct(left.alias("text"), F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"))).drop(key, other, id_, gone)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many go, and the md5 of the text that is left."""
    out = deduped(documents(spark, sf_dir).select("doc_id", "text"), "d")
    return out.select("doc_id", "d.n_lines", "d.n_removed", F.md5(F.col("d.text").cast("binary")).alias("kept_md5"))
