"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a seeded order, are cut into blocks. Of a period of as many slots as the whole-number weights
sum to, block j of a source with weight w is released at floor(j · period / w) and due at ceil((j + 1) · period / w); each slot
goes to the released block with the earliest deadline. So at any slot a source has had less than one block more or fewer than its
weight asks for. Weights are whole multiples of 1 / ``PERIOD`` of their sum, so fine that rounding stays far below a block over the whole run.
A period that is shorter than the run repeats as it began, so only one is scheduled, on the driver; of a longer one only the slots of the run.
When a source is used up, a new phase begins with the rest of the sources in the same proportions: no document is dropped.

Places within a source come from counts of hash buckets, about as many as the square root of the rows: prefix sums
give each bucket its first place, and rows are numbered within buckets, so a source with a third of all rows is spread.

Defined results: a null source is a source of its own; rows that repeat an id are numbered one after the other, in any order; null
ids count as rows; an empty table gives no rows. The driver holds a number for each block at most; past ``BROADCAST`` of them they are joined
by source and block instead of being broadcast.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnish.llm.common import own, table

#: Documents of a block, about how many slots an unreduced period has, and how many slots are broadcast.
BLOCK, PERIOD, BROADCAST = 16, 10**12, 1_000_000
#: Target weights of the query: the share of each source's rows, flattened by this power.
FLATTEN = 0.5


def period_slots(weights: dict[str, int], blocks: dict[str, int] | None = None) -> dict[str, list[int]]:
    """The slots of one period that earliest-deadline-first gives to each source; with blocks, until a source has had all of its."""
    period = sum(weights.values())
    waiting = [(0, s, 0) for s in sorted(weights)]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str, int]] = []
    out: dict[str, list[int]] = {s: [] for s in weights}
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // weights[s]), -weights[s], s, j))
        _, _, s, j = heapq.heappop(ready)
        out[s].append(slot)
        if blocks and len(out[s]) == blocks[s]:
            break
        if j + 1 < weights[s]:
            heapq.heappush(waiting, ((j + 1) * period // weights[s], s, j + 1))
    return out


def whole_weights(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Weights as whole numbers of about the given sum, one at least; 0 or less leaves the source to the end."""
    total = sum(w for w in weights.values() if w > 0)
    return {s: max(1, round(w / total * period)) for s, w in weights.items() if w > 0}


def phases(blocks: dict[str, int], weights: dict[str, float]) -> list[tuple[str, int, int, int, int, list[int]]]:
    """(source, first block, end, first slot, period, slots) of each source in each phase."""
    whole = whole_weights(weights)
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    start, out = 0, []
    while left:
        active = {s: whole[s] for s in left if s in whole} or dict.fromkeys(left, 1)
        shared = math.gcd(*active.values())
        active = {s: w // shared for s, w in active.items()}
        period = sum(active.values())
        slots = period_slots(active, left)
        last = min((left[s] - 1) // w * period + slots[s][(left[s] - 1) % w] for s, w in active.items()
                   if (left[s] - 1) % w < len(slots[s]) and (len(slots[s]) == w or left[s] <= len(slots[s])))
        turns, rest = divmod(last + 1, period)
        for s, w in active.items():
            n = turns * w + sum(x < rest for x in slots[s])
            out.append((s, done[s], done[s] + n, start, period, slots[s]))
            done[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        start += last + 1
    return out


def interleaved(rows: DataFrame, weights: dict[str, float] | None = None, seed: int = 0, block: int = BLOCK,
                column: str = "mix_position") -> DataFrame:
    """rows with their place in the mix: slot · block + place in the block. weights: by source name; None stands for FLATTEN."""
    spark = rows.sparkSession
    names = rows.columns
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    keyed = rows.withColumns({"_source": name, "_hash": F.xxhash64(F.col("doc_id"), F.lit(seed))})
    slim = own(rows, "doc_id", "source").select(name.alias("_source"), F.xxhash64("doc_id", F.lit(seed)).alias("_hash"))
    per_source = {r["_source"]: r["n"] for r in slim.groupBy("_source").agg(F.count(F.lit(1)).alias("n")).collect()}
    if weights is None:
        target = {s: n**FLATTEN for s, n in per_source.items()}
    else:
        target = {s: float(weights.get(s[1:] if s != "-" else "", 0.0)) for s in per_source}
    ways = 1 << max(0, math.isqrt(sum(per_source.values())).bit_length())
    bucket = F.pmod(F.shiftright("_hash", 20), F.lit(ways)).cast("int")
    counts = slim.groupBy("_source", bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_source", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    plan: dict[str, list[tuple]] = {}
    for s, *phase in phases({s: -(-n // block) for s, n in per_source.items()}, target):
        plan.setdefault(s, []).append(tuple(phase))
    steps, taken = [], []
    for s, of in sorted(plan.items()):
        for k, (first, end, start, period, slots) in enumerate(of):
            steps.append((s, k, first, end, start, period, len(slots)))
            taken += [(s, k, i, slot) for i, slot in enumerate(slots)]
    plans = spark.createDataFrame(
        steps, "_source string, _k int, first bigint, end bigint, start bigint, period bigint, size bigint").groupBy("_source").agg(
        F.collect_list(F.struct("_k", "first", "end", "start", "period", "size")).alias("_plan"))
    slot_of = spark.createDataFrame(taken, "_source string, _k int, _i bigint, _slot bigint")
    numbered = keyed.withColumn("_bucket", bucket).withColumn("_in_bucket", F.row_number().over(
        Window.partitionBy("_source", "_bucket").orderBy("_hash", "doc_id")))
    placed = numbered.join(offsets, ["_source", "_bucket"]).withColumn("_place", F.expr("_before + _in_bucket - 1")).join(
        F.broadcast(plans), "_source")  # bounded: a row for each source, a few numbers for each phase
    placed = placed.withColumn("_b", F.expr(f"_place div {block}")).withColumn(
        "_phase", F.expr("get(filter(_plan, p -> p.first <= _b and _b < p.end), 0)")).drop("_plan").withColumns(
        {"_k": F.col("_phase._k"), "_i": F.expr("(_b - _phase.first) % _phase.size")})
    placed = placed.join(F.broadcast(slot_of) if len(taken) <= BROADCAST else slot_of, ["_source", "_k", "_i"])
    slot = "_phase.start + (_b - _phase.first) div _phase.size * _phase.period + _slot"
    return placed.select(*names, F.expr(f"({slot}) * {block} + _place % {block}").cast("bigint").alias(column))


def in_order(rows: DataFrame, column: str = "mix_position") -> DataFrame:
    """The mixed rows as a reader is to see them: sorted by place, ranges of places in one file each."""
    return rows.repartitionByRange(column).sortWithinPartitions(column)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = own(table(spark, sf_dir, "documents"), "doc_id", "source")
    return interleaved(rows).selectExpr("doc_id", "source", "mix_position", f"mix_position div {BLOCK} slot")


