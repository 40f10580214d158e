"""Mixing sources to target weights by Pfair scheduling.

Each source is a task that owes its weight of every slot. Its k-th block may run from slot
floor(k / w) and must have run by slot ceil((k + 1) / w); taking the released block with the
earliest deadline in each slot keeps every source less than one block away from its share.
Weights are whole shares of a period, and after a period every source has exactly its share,
so the schedule of one period repeats. Where a source ends, a new phase begins with the
sources that are left. Every source is a task of its own, however many there are. The driver
holds a size and a weight for each and finds where phases end, by a period of each at most,
whatever the number of blocks; tasks make the slots of each phase's period. Documents find
their block by a running sum and its slot by the block's place within a period, both in Spark.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a block.
BLOCK_BYTES = 65_536
#: Slots of a period of all sources, and at least so many a source: weights are rounded to whole shares of it.
PERIOD, SLOTS_EACH = 10_000, 16
#: Bytes of a source that one task sums up, at most.
SUM_BYTES = 64_000_000


@dataclass(frozen=True)
class Phase:
    """Slots from `begin` on in which the sources with these shares run; done: blocks that each has before. made: slots of its period that it takes."""

    begin: int
    slots: int
    shares: dict[int, int]
    done: dict[int, int]

    @property
    def length(self) -> int:
        return sum(self.shares.values())

    @property
    def made(self) -> int:
        return min(self.slots, self.length)


def slots_of(shares: dict[int, int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(slot, source, k, release, deadline) of the slots of a period; equal deadlines go by the sources' order."""
    whole = sum(shares.values())
    k = dict.fromkeys(shares, 0)
    ready = [(-(-whole // s), i, 0) for i, s in shares.items()]
    heapq.heapify(ready)
    waiting: list[tuple[int, int]] = []
    for t in range(whole):
        while waiting and waiting[0][0] <= t:
            release, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k[i] + 1) * whole // shares[i]), i, release))
        deadline, i, release = heapq.heappop(ready)
        yield t, i, k[i], release, deadline
        k[i] += 1
        heapq.heappush(waiting, (k[i] * whole // shares[i], i))


def phases(blocks: list[int], shares: list[int]) -> list[Phase]:
    """The phases of sources with so many blocks and whole shares.

    In each phase every source is less than one block from its share of the phase's slots. A share
    below 1 counts as 1; sources without blocks take no part.
    """
    left = {i: n for i, n in enumerate(blocks) if n > 0}
    begin, out = 0, []
    while left:
        active = {i: max(1, shares[i]) for i in left}
        whole = sum(active.values())
        rounds = min((left[i] - 1) // s for i, s in active.items())  # whole periods in which none ends
        done = {i: blocks[i] - left[i] for i in active}
        if rounds:
            left = {i: n - rounds * active[i] for i, n in left.items()}
        slots = rounds * whole
        for _, i, _, _, _ in slots_of(active):
            slots += 1
            left[i] -= 1
            if not left[i]:
                del left[i]
                break
        out.append(Phase(begin, slots, active, done))
        begin += slots
    return out


def _slots(spark: SparkSession, plan: list[Phase], names: list[str]) -> DataFrame:
    """(phase, _name, k, t, r, d): the slots of a period of each phase, made in tasks."""
    of = [(n, p.made, list(p.shares), list(p.shares.values()), [names[i] for i in p.shares]) for n, p in enumerate(plan)]
    given = spark.createDataFrame(of, "phase int, made long, sources array<int>, shares array<long>, names array<string>")

    def make(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p in part.itertuples():
                named = dict(zip(p.sources, p.names, strict=True))
                rows = [(p.phase, named[i], k, t, r, d) for t, i, k, r, d in islice(slots_of(dict(zip(p.sources.tolist(), p.shares.tolist(), strict=True))), p.made)]
                yield pd.DataFrame(rows, columns=["phase", "_name", "k", "t", "r", "d"])

    return given.repartition(F.col("phase")).mapInPandas(make, "phase int, _name string, k long, t long, r long, d long")


def _named(source: str) -> Column:
    """A source's name with null as a name of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, tempering: float = 0.7, text: str = "text", key: str = "doc_id", source: str = "source", block_bytes: int = BLOCK_BYTES, period: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: key, source, n_bytes, block, slot, offset, release, deadline and the carried columns; the mix is in order of slot, offset.

    weights: target weights of sources by name, in any unit (sources that it doesn't name get the
    least of them); without it a source weighs its share of bytes to the power `tempering`. They are
    rounded to whole shares of `period` slots, one at least (without it of PERIOD, or SLOTS_EACH a source if that is more). A row weighs the UTF-8 bytes of its text
    and one more, so null and empty texts have a place too. Within a source rows are ordered by a
    hash of the key (of the text where it is null), then the key, then a hash of the text; rows that
    are equal in these follow each other in any order. A row is in the block in which it begins; a
    text longer than a block leaves the next blocks to what follows. Null is a source of its own. Every
    row is placed once; when a source ends, the others share its slots by their weights. Of sources
    the driver gets name and size, whatever their number; of rows nothing. Carried columns may have any name but those of the
    result. No rows give no rows.
    """
    spark = docs.sparkSession
    hashed = F.coalesce(F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key))), F.xxhash64(F.col(text)))
    sized = docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), _named(source).alias("_name"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("_size"), hashed.alias("_at"), F.xxhash64(F.col(text)).alias("_tie"), (F.struct(*(F.col(c) for c in carry)) if carry else F.lit(0)).alias("_carried"))
    by_name = sized.groupBy("_name").agg(F.sum("_size").alias("size"))
    sizes = by_name.orderBy(F.desc("size"), "_name").collect()  # one row a source
    total = sum(r["size"] for r in sizes)
    least = min((w for w in weights.values() if w > 0), default=1.0) if weights else 1.0
    wish = lambda name, size: max(weights.get(name[1:], least), 0) if weights else (size / total) ** tempering
    names, held, wanted = [r["_name"] for r in sizes], [r["size"] for r in sizes], [wish(r["_name"], r["size"]) for r in sizes]
    slots_each = period or max(PERIOD, SLOTS_EACH * len(names))
    shares = [max(1, round(w / max(sum(wanted), 1e-300) * slots_each)) for w in wanted]
    block = int(block_bytes)
    plan = phases([-(-n // block) for n in held], shares)
    of = [(names[i], n, p.done[i], p.begin, p.shares[i], p.length) for n, p in enumerate(plan) for i in p.shares]
    spans = spark.createDataFrame(pd.DataFrame(of, columns=["_name", "phase", "done", "begin", "share", "length"]), "_name string, phase int, done long, begin long, share long, length long")
    slots = _slots(spark, plan, names)
    parts = max(1, -(-total // SUM_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))  # a source may be most of the rows
    # parts of the hash range keep the order, so each part can be summed up alone
    cut = sized.withColumn("_part", F.floor((F.shiftrightunsigned(F.col("_at").bitwiseXOR(F.lit(-(1 << 63))), 33) * parts) / F.lit(float(1 << 31))).cast("long"))
    before = cut.groupBy("_name", "_part").agg(F.sum("_size").alias("size")).select("_name", "_part", (F.sum("size").over(Window.partitionBy("_name").orderBy("_part")) - F.col("size")).alias("_before"))
    order = Window.partitionBy("_name", "_part").orderBy("_at", "_key", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.withColumn("_start", F.sum("_size").over(order) - F.col("_size")).join(before, ["_name", "_part"]).withColumn("_start", F.col("_start") + F.col("_before"))
    placed = summed.withColumn("_block", F.expr(f"_start div {block}"))
    # a source's phases, as many as there are sources at most, in one row each: the last that has begun by the block
    ranges = spans.groupBy("_name").agg(F.array_sort(F.collect_list(F.struct("done", "phase", "begin", "share", "length"))).alias("_phases"))
    last = F.aggregate("_phases", F.element_at("_phases", 1), lambda a, p: F.when(p["done"] <= F.col("_block"), p).otherwise(a))
    timed = placed.join(ranges, "_name").withColumn("_phase", last).drop("_phases")
    timed = timed.withColumn("_k", F.col("_block") - F.col("_phase.done"))
    found = timed.withColumn("phase", F.col("_phase.phase")).withColumn("k", F.pmod("_k", F.col("_phase.share"))).join(slots, ["phase", "_name", "k"])
    shift = F.col("_phase.begin") + F.expr("_k div _phase.share") * F.col("_phase.length")
    return found.select(
        F.col("_key").alias(key), F.col("_source").alias(source), F.col("_size").alias("n_bytes"), F.col("_block").alias("block"), (shift + F.col("t")).alias("slot"),
        F.pmod("_start", F.lit(block)).alias("offset"), (shift + F.col("r")).alias("release"), (shift + F.col("d")).alias("deadline"), *(F.col(f"_carried.`{c}`").alias(c) for c in carry),
    )
