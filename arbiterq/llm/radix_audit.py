"""Source divergence audit with mergeable radix tries: how far the words of one source are from those of another, and which words do it.

1. Each task counts the words of its documents in byte tries, one a language, whose leaves have the number of documents and a counter for
   each source. Equal words of a few thousand documents are summed first, and a trie is walked down once a new word. A trie of MOST_LEAVES leaves
   is written out and begun anew: memory is bounded, and a word may come out of a task more than once.
2. A trie is written in the order of its bytes. The rows of all tries are dealt by ranges of (language, word): a range holds all there is
   below its prefixes, and the sorted rows are merged leaf by leaf. Words in fewer than ``least_docs`` documents are dropped here. What
   is kept is numbered in shards of SHARD words.
3. Per-source totals follow, then each shard with the totals of its language gives sums for pairs of sources, over all its words, and its
   best words of each source, ties in the order of bytes; sums are added, candidates ranked.

For a pair, the words that neither source has all add the same; the others are computed one by one, so that the work is that of the
occurring (word, source) combinations times the sources of a language. All arithmetic is in 64-bit integers and exact up to 9 * 10^15 words a
language; no intermediate product is larger than 1.1 * 10^18.

Defined results: null text, language and source are ''; empty texts and texts without words make their group occur; equal rows count
as a document each; long texts are read whole, in pieces cut between words; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import gc
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, forget, slim, written

TERM = re.compile(rb"[a-z\x80-\xff]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of a text that are cut into words at once, and of texts whose words are summed before they go into the tries.
PIECE, CHUNK = 1 << 20, 1 << 23
#: Leaves of a task's tries, and parts of their counters, beyond which they are written out; cells of a table of counters.
MOST_LEAVES, MOST_PARTS, DENSE = 400_000, 20_000, 1 << 24
#: Words of a shard, and cells of a matrix that are worked on at once.
SHARD, CELLS = 8192, 1 << 21
SCALE = 1_000_000_000


class Node:
    __slots__ = ("label", "below", "leaf")

    def __init__(self, label: bytes):
        self.label, self.leaf = label, -1
        self.below: dict[int, Node] | None = None


class Trie:
    """A radix trie of byte strings; a leaf is a node with a number. Its counters are rows of columns: how many documents, and a number for each
    source, are added up by leaf when the trie is written. ``at`` leads to the leaves that are there, so that the trie is walked down once a word."""

    def __init__(self) -> None:
        self.root = Node(b"")
        self.at: dict[bytes, int] = {}
        self.docs: list[tuple[np.ndarray, np.ndarray]] = []
        self.counts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)

    def leaves(self, terms: list[bytes]) -> np.ndarray:
        """The numbers of the terms' leaves, made where they are lacking."""
        there = self.at.get
        out = [there(t, -1) for t in terms]
        for i, leaf in enumerate(out):
            if leaf < 0:
                out[i] = self.insert(terms[i])
        return np.array(out, np.int64)

    def insert(self, term: bytes) -> int:
        node, i, n = self.root, 0, len(term)
        while i < n:
            if node.below is None:
                node.below = {}
            child = node.below.get(term[i])
            if child is None:
                node.below[term[i]] = node = Node(term[i:])
                break
            label = child.label
            if not term.startswith(label, i):  # split the edge where the two part
                k = 1
                while i + k < n and k < len(label) and term[i + k] == label[k]:
                    k += 1
                upper = Node(label[:k])
                child.label, upper.below = label[k:], {label[k]: child}
                node.below[term[i]] = child = upper
                label = child.label
            node, i = child, i + len(label)
        if node.leaf < 0:
            node.leaf = self.at[term] = len(self.at)
        return node.leaf

    def walk(self) -> Iterator[tuple[bytes, int]]:
        """Leaves in the order of their bytes."""
        stack = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            term = prefix + node.label
            if node.leaf >= 0:
                yield term, node.leaf
            if node.below:
                stack.extend((term, node.below[b]) for b in sorted(node.below, reverse=True))

    def rows(self, lang: str) -> Iterator[pa.RecordBatch]:
        """ROW of all leaves in the order of their bytes."""
        terms, leaves = [], []
        for term, leaf in self.walk():
            terms.append(term)
            leaves.append(leaf)
        place = np.empty(len(leaves), np.int64)
        place[leaves] = np.arange(len(leaves))

        def total(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
            out = np.zeros(len(place), np.int64)
            for leaf, n in parts:
                np.add.at(out, place[leaf], n)
            return out

        docs, names = total(self.docs), sorted(self.counts)
        sums = np.stack([total(self.counts[x]) for x in names], 1) if len(place) * len(names) <= DENSE else None
        for lo in range(0, len(terms), 20_000):
            hi = min(len(terms), lo + 20_000)
            if sums is not None:
                own = sums[lo:hi]
            else:  # many sources: a window of leaves at a time
                own = np.zeros((hi - lo, len(names)), np.int64)
                for k, x in enumerate(names):
                    for leaf, n in self.counts[x]:
                        at = place[leaf]
                        here = (at >= lo) & (at < hi)
                        np.add.at(own[:, k], at[here] - lo, n[here])
            row, col = np.nonzero(own)
            ends = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(names, pa.string()).take(pa.array(col)), pa.array(own[row, col]))]
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, hi - lo), pa.array(terms[lo:hi], pa.binary()), pa.array(docs[lo:hi]), *lists], schema=ROW)


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of those of a piece."""
    at, n = 0, len(text)
    while at < n:
        end = at + PIECE
        while end < n and TERM.match(text[end : end + 1].translate(LOWER)):
            end += 1
        yield TERM.findall(text[at:end].translate(LOWER))
        at = end


ROW = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tries of (lang, source, text), as rows of ROW in the order of their bytes."""
    tries: dict[str, Trie] = defaultdict(Trie)

    def long_one(lang: str, source: str, text: bytes) -> None:
        own: Counter[bytes] = Counter()
        for words in terms(text):
            own.update(words)
        leaves = tries[lang].leaves(list(own))
        tries[lang].docs.append((leaves, np.ones(len(leaves), np.int64)))
        tries[lang].counts[source].append((leaves, np.array(list(own.values()), np.int64)))

    def short_ones(langs: list[str], sources: list[str], texts: pa.Array) -> None:
        """Words of all texts as numbers; equal ones are told apart by sorting, so that Python sees each word of a language once."""
        lists = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=BETWEEN)
        coded = lists.flatten().dictionary_encode()
        words, code, row = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy().astype(np.int64), pc.list_parent_indices(lists).to_numpy()
        if b"" in words:  # before the first and after the last
            there = code != words.index(b"")
            code, row = code[there], row[there]
        names, groups = ({x: i for i, x in enumerate(dict.fromkeys(of))} for of in (langs, zip(langs, sources, strict=True)))
        lang_of, group_of = np.array([names[x] for x in langs], np.int64), np.array([groups[g] for g in zip(langs, sources, strict=True)], np.int64)
        width = len(words)
        once = np.unique(row * width + code)  # a text's different words
        cell, n = np.unique(lang_of[once // width] * width + once % width, return_counts=True)
        ends = np.searchsorted(cell, np.arange(len(names) + 1) * width)
        leaf_of = {}
        for lang, lo, hi in zip(names, ends, ends[1:], strict=False):
            own = cell[lo:hi] % width
            leaf_of[lang] = own, (leaves := tries[lang].leaves([words[k] for k in own.tolist()]))
            tries[lang].docs.append((leaves, n[lo:hi]))
        cell, n = np.unique(group_of[row] * width + code, return_counts=True)
        ends = np.searchsorted(cell, np.arange(len(groups) + 1) * width)
        for (lang, source), lo, hi in zip(groups, ends, ends[1:], strict=False):
            own, leaves = leaf_of[lang]
            tries[lang].counts[source].append((leaves[np.searchsorted(own, cell[lo:hi] % width)], n[lo:hi]))

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, trie in sorted(tries.items()):
            yield from trie.rows(lang)
        tries.clear()

    gc.disable()  # millions of nodes without cycles
    try:
        for batch in batches:
            size, langs, sources = pc.binary_length(batch.column(2)).to_numpy(), batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in np.flatnonzero(size > PIECE).tolist():
                long_one(langs[i], sources[i], batch.column(2)[i].as_py().encode())
                if sum(len(t.at) for t in tries.values()) > MOST_LEAVES:
                    yield from rows()
            short = np.flatnonzero(size <= PIECE)
            part = np.cumsum(size[short]) // CHUNK
            for rows_ in np.split(short, np.flatnonzero(np.diff(part)) + 1) if len(short) else []:
                short_ones([langs[i] for i in rows_], [sources[i] for i in rows_], batch.column(2).take(pa.array(rows_)))
                if sum(len(t.at) for t in tries.values()) > MOST_LEAVES or sum(len(x) for t in tries.values() for x in t.counts.values()) > MOST_PARTS:
                    yield from rows()
        yield from rows()
    finally:
        gc.enable()
    slim()


KEPT = pa.schema([("lang", pa.string()), ("shard", pa.int64()), ("term", pa.binary()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths and values of a list column."""
    return pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()


def merged(batches: Iterator[pa.RecordBatch], least_docs: int, shard: int) -> Iterator[pa.RecordBatch]:
    """Merge rows of ROW with a column ``range``, sorted by lang and term: the leaves in at least ``least_docs`` documents, as KEPT."""
    held: pa.Table | None = None
    number, lang_now, n_now = 0, None, 0

    def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
        nonlocal number, lang_now, n_now
        t = t.combine_chunks()
        new = np.concatenate([[True], differ(t)]) if len(t) else np.zeros(0, bool)
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        docs = np.add.reduceat(t["docs"].to_numpy(), first)
        good = docs >= least_docs
        rows = np.flatnonzero(good[group])
        if not len(rows):
            return
        t, group = t.take(pa.array(rows)), group[rows]
        sizes, names = flat(t["sources"].combine_chunks())
        coded = names.dictionary_encode()
        names, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        width = len(names)
        cell, back = np.unique(np.repeat(group, sizes) * width + code, return_inverse=True)
        sums = np.zeros(len(cell), np.int64)
        np.add.at(sums, back, flat(t["counts"].combine_chunks())[1].to_numpy())
        kept = np.unique(group)
        offsets = np.searchsorted(cell, np.append(kept * width, (kept[-1] + 1) * width)).astype(np.int32)
        firsts = np.searchsorted(group, kept)
        langs, ids = t["lang"].take(pa.array(firsts)).to_pylist(), np.empty(len(kept), np.int64)
        base = t["range"][0].as_py() << 32
        for i, lang in enumerate(langs):
            if lang != lang_now or n_now == shard:
                number, lang_now, n_now = number + 1, lang, 0
            n_now += 1
            ids[i] = base + number
        lists = [pa.ListArray.from_arrays(pa.array(offsets), x) for x in (names.take(pa.array(cell % width)), pa.array(sums))]
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ids), t["term"].take(pa.array(firsts)).combine_chunks(), *lists], schema=KEPT)

    def differ(t: pa.Table) -> np.ndarray:
        """Whether each row but the first is another word than the row before."""
        return pc.or_(*(pc.not_equal(t[c].slice(1), t[c].slice(0, len(t) - 1)) for c in ("lang", "term"))).to_numpy()

    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        ends = np.flatnonzero(differ(held.combine_chunks()))
        if len(ends) and len(held) > 20_000:  # the last word may go on in the next batch
            yield from done(held.slice(0, int(ends[-1]) + 1))
            held = held.slice(int(ends[-1]) + 1)
    if held is not None and len(held):
        yield from done(held)
    slim()


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * count / total) for count <= total, by long division, so that no product leaves 64 bits."""
    out, left = np.zeros_like(count), count
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // total, left % total
    return out + 1


def gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


PART = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def judged(kept: pa.Table, totals: pa.Table, most: int) -> pa.Table:
    """Sums of all pairs of sources over one shard of KEPT, and the ``most`` best words of each source. totals: (source, total, v) of the shard's language, v: its kept words."""
    if not len(kept) or not len(totals):
        return PART.empty_table()
    totals = totals.sort_by("source")
    lang, v = kept["lang"][0].as_py(), totals["v"][0].as_py()
    n, names = totals["total"].to_numpy(), totals["source"].combine_chunks()
    s = len(names)
    kept = kept.sort_by("term").combine_chunks()
    sizes, held = flat(kept["sources"].combine_chunks())
    at, source = np.repeat(np.arange(len(kept)), sizes), pc.index_in(held, names).to_numpy().astype(np.int64)
    count = flat(kept["counts"].combine_chunks())[1].to_numpy()
    zero = share(np.ones(s, np.int64), n + v)
    both_zero = gain(zero[:, None], zero[None, :])
    sums = both_zero * len(kept)
    step = max(1, CELLS // s // max(1, int(np.ceil(sizes.mean()))))
    for lo in range(0, len(kept), step):
        hi = min(lo + step, len(kept))
        e = slice(*np.searchsorted(at, (lo, hi)))
        own, t, c = source[e], at[e] - lo, count[e]
        p = np.repeat(zero[None, :], hi - lo, 0)
        p[t, own] = share(c + 1, n[own] + v)
        mine, row = p[t, own][:, None], p[t]
        order = np.argsort(own, kind="stable")
        firsts = np.flatnonzero(np.diff(own[order], prepend=-1))
        who = own[order][firsts]
        as_p = gain(mine, row) - both_zero[own]  # the word's source against all
        sums[who] += np.add.reduceat(as_p[order], firsts, axis=0)
        there = np.zeros((hi - lo, s), bool)
        there[t, own] = True
        as_q = np.where(there[t], 0, gain(zero[None, :], mine) - both_zero[:, own].T)  # those that lack it against the word's source
        sums[:, who] += np.add.reduceat(as_q[order], firsts, axis=0).T
    everywhere = np.zeros(len(kept), np.int64)
    np.add.at(everywhere, at, count)
    q = share(everywhere + 1, int(n.sum()) + v)[at]
    p = share(count + 1, n[source] + v)
    hit = np.flatnonzero(p > q)
    value, at, source = gain(p[hit], q[hit]), at[hit], source[hit]
    order = np.lexsort((at, -value, source))
    place = np.arange(len(order)) - np.searchsorted(source[order], source[order])
    best = order[place < most]
    g, h = np.nonzero(~np.eye(s, dtype=bool))
    who, item = np.concatenate([g, source[best]]), pa.concat_arrays([names.take(pa.array(h)), kept["term"].take(pa.array(at[best])).combine_chunks().cast(pa.string())])
    part = pa.array(["pair"] * len(g) + ["term"] * len(best))
    return pa.Table.from_arrays([pa.array([lang] * len(who), pa.string()), names.take(pa.array(who)), part, item, pa.array(np.concatenate([sums[g, h], value[best]]))], schema=PART)


def divergence(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 3, most_terms: int = 200, shard: int = SHARD) -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' ranks all other sources of the language, part 'term' at most ``most_terms`` words."""
    empty = F.lit("")
    own = df.select(F.coalesce(F.col(f"`{lang}`"), empty).alias("lang"), F.coalesce(F.col(f"`{source}`"), empty).alias("source"), F.coalesce(F.col(f"`{text}`"), empty).alias("text"))
    leaves = written(own.mapInArrow(counted, "lang string, term binary, docs long, sources array<string>, counts array<long>"), "leaves")
    ranged = leaves.repartitionByRange("lang", "term").withColumn("range", F.spark_partition_id().cast("long")).sortWithinPartitions("lang", "term")
    kept = written(ranged.mapInArrow(lambda batches: merged(batches, least_docs, shard), "lang string, shard long, term binary, sources array<string>, counts array<long>"), "kept")
    forget(leaves)
    held = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e")).groupBy("lang", F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = own.select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = written(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v")), "groups")
    totals = kept.select("lang", "shard").distinct().join(groups, "lang").select(F.col("lang").alias("of"), F.col("shard").alias("at"), "source", "total", "v")
    parts = kept.groupBy("lang", "shard").cogroup(totals.groupBy("of", "at")).applyInArrow(lambda k, t: judged(k, t, most_terms), "lang string, source string, part string, item string, value long")
    parts = written(parts, "parts")
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(other, "lang").where("source <> item")
    sums = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").withColumns({"value": F.coalesce("value", F.lit(0).cast("long")), "part": F.lit("pair")})
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    words = parts.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_terms)
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("rank", F.row_number().over(order)).select(*columns).unionByName(words.select(*columns))


def op13_radix_audit(spark, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir).select("lang", "source", "text"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT row) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
lc AS (SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY 1, 2),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::BIGINT AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY 1, 2),
p AS (SELECT gn.lang, gn.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (gn.total + v.v) AS p
  FROM gn JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term),
q AS (SELECT lc.lang, lc.term, 1 + (1000000000::HUGEINT * (lc.n + 1)) // (t.total + v.v) AS q FROM lc JOIN v USING (lang) JOIN (SELECT lang, sum(n)::BIGINT AS total FROM lc GROUP BY 1) t USING (lang)),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pv.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
words AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (((p.p - q.q) * (p.p - q.q)) // q.q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM words))
SELECT lang, source, part, item, value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
