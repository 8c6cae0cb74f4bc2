"""Interval overlap join by an endpoint-event sweep: how the intervals of one table lie to those of another, by key, in totals.

Intervals are pairs of slots, both inclusive; an open end is infinite. ``relations(left, right)`` returns, for each left interval and each
of nine relations, how many right intervals of its key have it, the sum of their weights, and of the slots shared. Pairs are
counted, never emitted, so that the work follows the number of intervals and not of pairs.

1. Equal intervals of a key become one row each (a third of all rows with one key leaves as many rows as it has different intervals).
2. Time is cut into blocks. A shard is one block of one key: right intervals that touch it, left intervals that start or end in it, and
   a row of what lies before it: totals of the closed right intervals that ended, and of the open ones that started, by a window over the
   few blocks of each key. So a hot key is as many shards as it has blocks.
3. A shard's endpoints are swept in order, at equal slots right starts, left starts, left ends, right ends. Two hash sets hold what is active: the
   right intervals by (start, end), the open ones as one total; and the left intervals, each with the totals at its start. When a left one
   ends, relations to right intervals that started since are the differences to those totals; relations to right ones that
   started before or with it are read off the active set at its start. What is still active at the block's end is handed on as a
   difference with a minus sign, to which the block of its end adds its own totals.
4. A sum over the shards by left interval gives the totals.

Nothing is collected or broadcast; a task holds one shard. Its size is bounded by the intervals that BLOCK slots can start or end,
not by the rows that have them. All sums are 64-bit integers.

Defined results: rows with a null key or start take no part; an end before the start counts as the start; repeated rows each count (in the weights and numbers for right
ones; a repeated left row is one interval with one result); an empty table on either side gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Slots of a block: two weeks of hours.
BLOCK = 336
#: An open end, as it is kept in a column.
OPEN = 1 << 62
RELATIONS = ("overlaps", "finished_by", "contains", "starts", "equals", "started_by", "during", "finishes", "overlapped_by")
OVERLAPS, FINISHED_BY, CONTAINS, STARTS, EQUALS, STARTED_BY, DURING, FINISHES, OVERLAPPED_BY = range(9)
TOTALS = ("ended_n", "ended_w", "ended_slots", "open_n", "open_w", "open_starts")
CARRY, RIGHT, LEFT = range(3)


class Active:
    """The state of a sweep: totals of what has ended or is open, and the right intervals that are active now."""

    def __init__(self, carry: list[int]):
        self.en, self.ew, self.es, self.on, self.ow, self.oc = carry[:6]
        self.all_en, self.all_ew, self.all_es, self.all_on, self.all_ow, _ = carry[6:]
        self.closed: dict[tuple[int, int], tuple[int, int]] = {}
        self.slot, self.now_n, self.now_w = None, 0, 0  # open ones that start at this slot

    def start(self, c: int, d: int, n: int, w: int) -> None:
        if d == OPEN:
            if c != self.slot:
                self.slot, self.now_n, self.now_w = c, 0, 0
            self.on, self.ow, self.oc = self.on + n, self.ow + w, self.oc + n * c
            self.now_n, self.now_w = self.now_n + n, self.now_w + w
        else:
            self.closed[c, d] = (n, w)

    def end(self, c: int, d: int) -> None:
        n, w = self.closed.pop((c, d))
        self.en, self.ew, self.es = self.en + n, self.ew + w, self.es + n * (d - c + 1)


def left_start(now: Active, a: int, b: int) -> list[list]:
    """(relation, n, slots, w) of a left interval at its start: what it has to right ones that started before or with it, and the
    totals so far, negative, for those that will start later. slots is None where both ends are open."""
    out, en, ew, es = [], now.en, now.ew, now.es
    for (c, d), (n, w) in now.closed.items():
        if d > b:
            out.append([DURING if c < a else STARTS, n, n * (b - a + 1), w])
        else:
            out.append([(FINISHES if c < a else EQUALS) if d == b else (OVERLAPPED_BY if c < a else STARTED_BY), n, n * (d - a + 1), w])
        if d < b:
            en, ew, es = en + n, ew + w, es + n * (d - c + 1)
    now_n, now_w = (now.now_n, now.now_w) if now.slot == a else (0, 0)
    for before, n, w in ((True, now.on - now_n, now.ow - now_w), (False, now_n, now_w)):
        if n and b == OPEN:
            out.append([FINISHES if before else EQUALS, n, None, w])
        elif n:
            out.append([DURING if before else STARTS, n, n * (b - a + 1), w])
    if b == OPEN:
        out.append([CONTAINS, now.all_en - en, now.all_es - es, now.all_ew - ew])
        out.append([FINISHED_BY, now.all_on - now.on, None, now.all_ow - now.ow])
    else:
        out.append([CONTAINS, -en, -es, -ew])
        out.append([OVERLAPS, -now.on, now.oc - (b + 1) * now.on, -now.ow])
    return out


def left_end(now: Active, a: int, b: int) -> list[list]:
    """What a closed left interval has to right ones that started after it, as totals at its end; to be added to those of its start."""
    out = [[CONTAINS, now.en, now.es, now.ew], [OVERLAPS, now.on, (b + 1) * now.on - now.oc, now.ow]]
    for (c, d), (n, w) in now.closed.items():
        if c > a:
            out.append([FINISHED_BY if d == b else OVERLAPS, n, n * (b - c + 1), w])
    return out


def swept(first: int, last: int, carry: list[int], right: list[tuple], left: list[tuple]) -> Iterator[tuple]:
    """(a, b, relation, n, slots, w) of one shard, whose slots are first to last. right: (c, d, n, w), left: (a, b)."""
    events = [(a, 1, a, b, 0, 0) for a, b in left if a >= first] + [(b, 2, a, b, 0, 0) for a, b in left if b <= last]
    for c, d, n, w in right:
        events.append((max(c, first), 0, c, d, n, w))
        if d <= last:
            events.append((d, 3, c, d, 0, 0))
    events.sort()
    now, sums = Active(carry), {}
    for _, kind, x, y, n, w in events:
        if kind == 0:
            now.start(x, y, n, w)
        elif kind == 3:
            now.end(x, y)
        else:
            own = sums.setdefault((x, y), {})
            for relation, k, slots, weight in left_start(now, x, y) if kind == 1 else left_end(now, x, y):
                if k or relation in own:
                    n0, s0, w0 = own.get(relation, (0, 0, 0))
                    own[relation] = (n0 + k, None if slots is None else s0 + slots, w0 + weight)
    for (a, b), own in sums.items():
        for relation, (n, slots, w) in own.items():
            if n:
                yield a, b, relation, n, slots, w


def sweep(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Over rows (key, block, kind, x, y, n, w, carry) that are sorted by key and block."""
    fields = [("key", None), ("a", pa.int64()), ("b", pa.int64()), ("relation", pa.int32()), ("n", pa.int64()), ("slots", pa.int64()), ("w", pa.int64())]
    out: list[tuple] = []
    at, carry, right, left, key_type = None, None, [], [], pa.int64()

    def shard() -> None:
        if at is not None and left and (right or carry and any(carry)):
            out.extend((at[0], *x) for x in swept(at[1] * block, (at[1] + 1) * block - 1, carry or [0] * 12, right, left))

    def made() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[] for _ in fields]
        done = pa.RecordBatch.from_arrays([pa.array(x, t or key_type) for x, (_, t) in zip(columns, fields, strict=True)], [f for f, _ in fields])
        out.clear()
        return done

    for batch in batches:
        key_type = batch.schema.field("key").type
        for key, b, kind, x, y, n, w, c in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            if (key, b) != at:
                shard()
                at, carry, right, left = (key, b), None, [], []
            if kind == CARRY:
                carry = c
            elif kind == RIGHT:
                right.append((x, y, n, w))
            else:
                left.append((x, y))
        if len(out) > 20_000:
            yield made()
    shard()
    if out:
        yield made()


def block_of(slot: Column, block: int) -> Column:
    """The block of a slot, also of negative ones."""
    return ((slot - F.pmod(slot, F.lit(block))) / block).cast("long")


def intervals(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """Different (key, a, b) of ``df`` (key, start, end: null is open), with their number n and the sum w of their weights."""
    end = F.when(F.col("end").isNull(), F.lit(OPEN)).otherwise(F.greatest("start", "end").cast("long"))
    own = df.where("key is not null and start is not null").select("key", F.col("start").cast("long").alias("a"), end.alias("b"), (F.lit(0) if weight is None else weight).cast("long").alias("w"))
    return own.groupBy("key", "a", "b").agg(F.count("*").alias("n"), F.sum("w").alias("w"))


def relations(left: DataFrame, right: DataFrame, weight: str | None = None, block: int = BLOCK) -> DataFrame:
    """(key, a, b, relation, n, slots, w) of each different left interval and each relation that it has. left, right: (key, start, end),
    right with a column ``weight`` if w is asked for. b is OPEN for an open end; slots is null where both ends are open."""
    ls = written(intervals(left).select("key", "a", "b"), "left")
    rs = written(intervals(right, None if weight is None else F.col(weight)), "right")
    closed, zero = F.col("b") < OPEN, F.lit(0).cast("long")
    sums = {"ended_n": F.when(closed, F.col("n")), "ended_w": F.when(closed, F.col("w")), "ended_slots": F.when(closed, F.col("n") * (F.col("b") - F.col("a") + 1)), "open_n": F.when(~closed, F.col("n")), "open_w": F.when(~closed, F.col("w")), "open_starts": F.when(~closed, F.col("n") * F.col("a"))}
    ends = F.when(closed & (block_of(F.col("b"), block) != block_of(F.col("a"), block)), F.array(block_of(F.col("a"), block), block_of(F.col("b"), block))).otherwise(F.array(block_of(F.col("a"), block)))
    lefts = ls.select("key", F.explode(ends).alias("block"), "a", "b")
    at = rs.select("key", block_of(F.when(closed, F.col("b")).otherwise(F.col("a")), block).alias("block"), *(F.coalesce(v, zero).alias(k) for k, v in sums.items()), F.lit(0).alias("has_left"))
    both = at.unionByName(lefts.select("key", "block", *(zero.alias(k) for k in TOTALS), F.lit(1).alias("has_left")))
    a_block = both.groupBy("key", "block").agg(*(F.sum(k).alias(k) for k in TOTALS), F.max("has_left").alias("has_left"))
    before, whole = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("key")
    carry = F.array(*(F.coalesce(F.sum(k).over(before), zero) for k in TOTALS), *(F.sum(k).over(whole) for k in TOTALS))
    carried = a_block.select("key", "block", "has_left", carry.alias("carry")).where("has_left = 1")
    touched = F.when(closed, F.sequence(block_of(F.col("a"), block), block_of(F.col("b"), block))).otherwise(F.array(block_of(F.col("a"), block)))
    rights = rs.select("key", F.explode(touched).alias("block"), F.lit(RIGHT).alias("kind"), F.col("a").alias("x"), F.col("b").alias("y"), "n", "w")
    none = F.lit(None).cast("array<bigint>")
    rows = carried.select("key", "block", F.lit(CARRY).alias("kind"), zero.alias("x"), zero.alias("y"), zero.alias("n"), zero.alias("w"), "carry")
    rows = rows.unionByName(rights.withColumn("carry", none)).unionByName(lefts.select("key", "block", F.lit(LEFT).alias("kind"), F.col("a").alias("x"), F.col("b").alias("y"), zero.alias("n"), zero.alias("w"), none.alias("carry")))
    dealt = rows.repartition("key", "block").sortWithinPartitions("key", "block")
    key = f"`key` {left.schema['key'].dataType.simpleString()}"
    parts = dealt.mapInArrow(lambda batches: sweep(batches, block), f"{key}, a long, b long, relation int, n long, slots long, w long")
    total = parts.repartition("key", "a", "b").groupBy("key", "a", "b", "relation").agg(F.sum("n").alias("n"), F.sum("slots").alias("slots"), F.sum("w").alias("w")).where("n > 0")
    return total.withColumn("relation", F.element_at(F.array(*map(F.lit, RELATIONS)), F.col("relation") + 1))


def micros(ts: Column) -> Column:
    """Whole microseconds since 1970 of a timestamp without a zone, whatever the session's zone is."""
    since = ts.cast("timestamp_ntz") - F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return (since.cast("interval second").cast("decimal(18,6)") * 1_000_000).cast("long")


def sessions(clicks: DataFrame, gap_minutes: int = 10, block: int = 144) -> DataFrame:
    """(key, first, last, flag) of the runs of ``clicks`` (key, us, flag) whose neighbours are at most ``gap_minutes`` apart; flag: any at the last time.

    Times within one cell of gap_minutes never lie further apart, so cells are what is shuffled: least and greatest time, however many clicks they
    have. A run goes on only from the cell before, which the row at the end of a block of cells tells the next block; runs that touch an
    end of their block are joined along the key's blocks, the rest are ready.
    """
    gap = gap_minutes * 60_000_000
    cell = ((F.col("us") - F.pmod("us", F.lit(gap))) / gap).cast("long")
    cells = clicks.where("key is not null and us is not null").groupBy("key", cell.alias("cell")).agg(F.min("us").alias("first"), F.max(F.struct("us", "flag")).alias("last"))
    edge = F.pmod("cell", F.lit(block)) == block - 1
    own = block_of(F.col("cell"), block)
    dealt = cells.select("*", F.explode(F.when(edge, F.array(own, own + 1)).otherwise(F.array(own))).alias("block"))
    w = Window.partitionBy("key", "block").orderBy("cell")
    goes_on = (F.lag("cell").over(w) == F.col("cell") - 1) & (F.col("first") - F.lag("last.us").over(w) <= gap)
    guest = own != F.col("block")
    cut = dealt.withColumn("cut", F.when(guest | F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("cut").over(w)).where(~guest)
    runs = cut.groupBy("key", "block", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max(edge).alias("to_end"))
    chained = runs.where("to_end or run = 0")
    along = Window.partitionBy("key").orderBy("block", "run").rowsBetween(Window.unboundedPreceding, 0)
    chained = chained.withColumn("head", F.last(F.when(F.col("run") > 0, F.col("first")), ignorenulls=True).over(along))
    joined = chained.groupBy("key", "head").agg(F.max("last").alias("last")).select("key", F.col("head").alias("first"), "last")
    out = runs.where("not (to_end or run = 0)").select("key", "first", "last").unionByName(joined)
    return out.select("key", "first", F.col("last.us").alias("last"), F.col("last.flag").alias("flag"))


HOUR = 3_600_000_000


def hour(us: Column) -> Column:
    return ((us - F.pmod(us, F.lit(HOUR))) / HOUR).cast("long")


def sale_spans(spark, sf_dir: str) -> DataFrame:
    """(sale_id, key, start, end) of each sale with a client and a time, in hours; end is null if a line isn't shipped."""
    lines = spark.read.parquet(f"{sf_dir}/sale_lines.parquet").where("sale_id is not null").groupBy("sale_id").agg(F.max(micros(F.col("shipped_at"))).alias("shipped"), F.max(F.col("shipped_at").isNull()).alias("open"))
    sales = spark.read.parquet(f"{sf_dir}/sales.parquet").where("client_id is not null and sold_at is not null").select("sale_id", F.col("client_id").alias("key"), micros(F.col("sold_at")).alias("sold"))
    end = F.when(F.coalesce("open", F.lit(False)), F.lit(None)).otherwise(hour(F.greatest("sold", "shipped")))
    return sales.join(lines, "sale_id", "left").select("sale_id", "key", hour(F.col("sold")).alias("start"), end.alias("end"))


def click_spans(spark, sf_dir: str) -> DataFrame:
    """(key, start, end, crc) of each click session, in hours; end is null if a purchase is at its last time."""
    clicks = spark.read.parquet(f"{sf_dir}/clicks.parquet").where("client_id is not null and ts is not null")
    found = sessions(clicks.select(F.col("client_id").alias("key"), micros(F.col("ts")).alias("us"), F.coalesce(F.col("kind") == "purchase", F.lit(False)).alias("flag")))
    return found.select("key", hour(F.col("first")).alias("start"), F.when(~F.col("flag"), hour(F.col("last"))).alias("end"), F.crc32(F.col("first").cast("string").cast("binary")).alias("crc"))


def op12_interval_sweep(spark, sf_dir: str) -> DataFrame:
    """Relations of sales to the same client's click sessions. Rows that share a sale_id are added up, rows without one are a sale of id null."""
    sales = written(sale_spans(spark, sf_dir), "sales")
    total = relations(sales, click_spans(spark, sf_dir), "crc")
    own = sales.select("sale_id", "key", F.col("start").alias("a"), F.coalesce("end", F.lit(OPEN)).alias("b"))
    out = own.join(total, ["key", "a", "b"])
    return out.groupBy("sale_id", "relation").agg(F.sum("n").alias("n_pairs"), F.sum("slots").alias("overlap_slots"), F.sum("w").alias("sessions_crc"))


#: CRC-32 of the bytes of a decimal text, folded bit by bit.
_CRC = "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({}, ''), lambda ch: ascii(ch)::BIGINT)), lambda x, y: list_reduce(list_concat([xor(x, y)], [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))))"
OP12_SQL = f"""
WITH c AS (SELECT client_id, epoch_us(ts) AS us, coalesce(kind = 'purchase', false) AS bought FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
cut AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY client_id ORDER BY us) <= 600000000 THEN 0 ELSE 1 END AS new FROM c),
num AS (SELECT *, sum(new) OVER (PARTITION BY client_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM cut),
ends AS (SELECT client_id, s, min(us) AS first, max(us) AS last FROM num GROUP BY 1, 2),
sess AS (SELECT e.client_id, e.first, e.last, max(n.bought::INT) AS is_open FROM ends e JOIN num n ON n.client_id = e.client_id AND n.s = e.s AND n.us = e.last GROUP BY 1, 2, 3),
r AS (SELECT client_id, first // {HOUR} AS c, CASE WHEN is_open = 1 THEN {OPEN} ELSE last // {HOUR} END AS d, {_CRC.format("first::VARCHAR")} AS crc FROM sess),
ship AS (SELECT sale_id, max(epoch_us(shipped_at)) AS shipped, max((shipped_at IS NULL)::INT) AS is_open FROM sale_lines GROUP BY 1),
l AS (SELECT s.sale_id, s.client_id, epoch_us(sold_at) // {HOUR} AS a, CASE WHEN coalesce(is_open, 0) = 1 THEN {OPEN} ELSE greatest(epoch_us(sold_at), coalesce(shipped, epoch_us(sold_at))) // {HOUR} END AS b
  FROM sales s LEFT JOIN ship USING (sale_id) WHERE s.client_id IS NOT NULL AND sold_at IS NOT NULL),
p AS (SELECT sale_id, a, b, c, d, crc,
  CASE WHEN a < c THEN CASE WHEN b < d THEN 'overlaps' WHEN b = d THEN 'finished_by' ELSE 'contains' END
       WHEN a = c THEN CASE WHEN b < d THEN 'starts' WHEN b = d THEN 'equals' ELSE 'started_by' END
       ELSE CASE WHEN b < d THEN 'during' WHEN b = d THEN 'finishes' ELSE 'overlapped_by' END END AS relation
  FROM l JOIN r USING (client_id) WHERE c <= b AND a <= d)
SELECT sale_id, relation, count(*) AS n_pairs, sum(CASE WHEN least(b, d) < {OPEN} THEN least(b, d) - greatest(a, c) + 1 END)::BIGINT AS overlap_slots, sum(crc)::BIGINT AS sessions_crc FROM p GROUP BY 1, 2
"""
