"""Mixing sources to target weights by a Pfair schedule.

Block i of a source of weight w is released at floor((i - 1) / w) and due at
ceil(i / w); of the released blocks, the one due first takes the slot. Weights
are exact fractions. A schedule repeats after as many slots as their common
denominator: where that is short, one such period is laid out, and every
block's slot follows by arithmetic. Where it is long, the schedule is cut into
segments of SEGMENT slots that tasks lay out each on its own: at a cut a source
has had the floor or the ceiling of its share, by largest remainders. Windows
clipped at such cuts still hold no more blocks than slots, so no deadline is
missed. When a source has run out, the others go on with their weights in
proportion: a new phase. Within a phase no source is a block or more away from
its share.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK, RANK_BUCKETS = 64, 64
SEGMENT = 4096  # slots that a task lays out at once
BROADCAST_SLOTS = 1 << 18  # slots of periods that are broadcast; beyond them blocks and slots are joined


def parts_of(weights: dict[str, float], period: int | None = None) -> dict[str, int]:
    """Weights as whole parts of their common denominator, exactly; a float is the decimal number that it prints as.

    A period that a caller gives rounds them: one part at least, by largest remainders.
    """
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    total = sum(exact.values())
    if period is None:
        shares = {s: w / total for s, w in exact.items()}
        size = math.lcm(*(w.denominator for w in shares.values()))
        return {s: int(w * size) for s, w in shares.items()}
    exact = {s: w * period / total for s, w in exact.items()}
    parts = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))
    k = 0
    while sum(parts.values()) < period:
        parts[order[k % len(order)]] += 1
        k += 1
    while sum(parts.values()) > period:
        most = max(parts, key=lambda s: (parts[s], s))
        parts[most] -= 1
    return parts


def by_deadline(rates: dict[str, tuple[int, int]], start: int, first: dict[str, int], last: dict[str, int], left: dict[str, int] | None = None) -> dict[str, list[int]]:
    """The slots, from start on, of each source's blocks first to last - 1 by earliest deadline; it ends sooner if a source's last block of left is placed.

    A rate is a fraction, as numerator and denominator; windows are clipped to
    the slots that these blocks fill.
    """
    end = start + sum(last[s] - first[s] for s in rates)
    release = lambda s, i: max(start, i * rates[s][1] // rates[s][0])
    due = lambda s, i: min(end, -(-(i + 1) * rates[s][1] // rates[s][0]))
    waiting = [(release(s, first[s]), s, first[s]) for s in rates if first[s] < last[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slots: dict[str, list[int]] = {s: [] for s in rates}
    for slot in range(start, end):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (due(s, i), s, i))
        deadline, s, i = heapq.heappop(ready)
        if slot >= deadline:
            raise RuntimeError("a deadline was missed")
        slots[s].append(slot)
        if left is not None and i + 1 == left[s]:
            break
        if i + 1 < last[s]:
            heapq.heappush(waiting, (release(s, i + 1), s, i + 1))
    return slots


def one_period(parts: dict[str, int], left: dict[str, int] | None = None) -> dict[str, list[int]]:
    """The slots of each source's blocks in a period of sum(parts) slots; it ends sooner if a source's last block of left is placed."""
    period = sum(parts.values())
    return by_deadline({s: (n, period) for s, n in parts.items()}, 0, dict.fromkeys(parts, 0), parts, left)


def at_cut(rates: dict[str, tuple[int, int]], slot: int) -> dict[str, int]:
    """Blocks of each source before that slot: its share rounded down, or up where the remainder is among the largest."""
    counts = {s: n * slot // d for s, (n, d) in rates.items()}
    rest = slot - sum(counts.values())
    for s in sorted(rates, key=lambda s: (-Fraction(rates[s][0] * slot % rates[s][1], rates[s][1]), s))[:rest]:
        counts[s] += 1
    return counts


def segment(rates: dict[str, tuple[int, int]], start: int) -> tuple[dict[str, int], dict[str, list[int]]]:
    """Each source's first block in the SEGMENT slots from start on, and the slots of its blocks there."""
    first = at_cut(rates, start)
    return first, by_deadline(rates, start, first, at_cut(rates, start + SEGMENT))


def phases(blocks: dict[str, int], weights: dict[str, float], period: int | None = None, most: int | None = None) -> list[dict] | None:
    """Per phase its first slot, and for each source parts, slots of a period, first and end block; None if periods have more than `most` slots.

    A source of weight 0 waits until those with a weight have run out.
    """
    laid = 0
    left, done, start, out = opened(blocks, weights)
    while left:
        parts = live_parts(left, weights, period)
        laid += min(sum(parts.values()), sum(left.values()))
        if most is not None and laid > most:
            return None
        slots = one_period(parts, left)
        parts, size = {s: len(x) for s, x in slots.items()}, sum(map(len, slots.values()))
        ends = {s: (left[s] - 1) // parts[s] * size + slots[s][(left[s] - 1) % parts[s]] + 1 for s in parts if parts[s]}
        length = min(ends.values())  # the phase ends with the first source's last block
        whole, rest = divmod(length, size)
        taken = {s: whole * parts[s] + sum(x < rest for x in slots[s]) for s in parts}
        out += [{"source": s, "phase_start": start, "parts": parts[s], "size": size, "slots": slots[s], "from": done[s], "to": done[s] + taken[s]} for s in parts if taken[s]]
        left, start = moved_on(left, done, taken), start + length
    return out


def outlines(blocks: dict[str, int], weights: dict[str, float], period: int | None = None) -> list[dict]:
    """Per phase its first slot, length, rates and first and end blocks by source; only the segments near a phase's end are laid out, one at a time."""
    left, done, start, out = opened(blocks, weights)
    while left:
        parts = live_parts(left, weights, period)
        total = sum(parts.values())
        rates = {s: (n // math.gcd(n, total), total // math.gcd(n, total)) for s, n in parts.items()}
        cut = min((left[s] - 1) * d // n for s, (n, d) in rates.items()) // SEGMENT * SEGMENT
        while True:
            first, slots = segment(rates, cut)
            ends = [slots[s][left[s] - 1 - first[s]] + 1 for s in rates if first[s] < left[s] <= first[s] + len(slots[s])]
            if ends:
                break
            cut += SEGMENT
        length = min(ends)
        taken = {s: first[s] + sum(x < length for x in slots[s]) for s in rates}
        out.append({"phase_start": start, "length": length, "rates": rates, "from": {s: done[s] for s in rates}, "to": {s: done[s] + taken[s] for s in rates}})
        left, start = moved_on(left, done, taken), start + length
    return out


def opened(blocks: dict[str, int], weights: dict[str, float]) -> tuple[dict[str, int], dict[str, int], int, list[dict]]:
    left = {s: n for s, n in blocks.items() if n}
    if not all(0 <= weights[s] < math.inf for s in left):
        raise ValueError("weights are finite and not negative")
    return left, dict.fromkeys(blocks, 0), 0, []


def live_parts(left: dict[str, int], weights: dict[str, float], period: int | None) -> dict[str, int]:
    live = {s: weights[s] for s in left if weights[s]} or dict.fromkeys(left, 1)
    return parts_of(live, period and max(period, len(live)))


def moved_on(left: dict[str, int], done: dict[str, int], taken: dict[str, int]) -> dict[str, int]:
    """What is left after a phase; done is brought up to it."""
    for s, n in taken.items():
        done[s] += n
        left[s] -= n
    return {s: n for s, n in left.items() if n}


def block_slots(spark: SparkSession, plan: list[dict]) -> DataFrame:
    """(src, block_no, phase_start, slot) of all blocks, laid out by tasks a segment at a time."""
    starts = spark.createDataFrame([(i, p["length"]) for i, p in enumerate(plan)], "i int, length long")  # a row a phase
    starts = starts.select("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(SEGMENT).cast("long"))).alias("start")).repartition("i", "start")

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, start in zip(batch["i"], batch["start"], strict=True):
                p = plan[i]
                first, slots = segment(p["rates"], int(start))
                rows = [(s, p["from"][s] + first[s] + k, p["phase_start"], p["phase_start"] + x) for s, xs in slots.items() for k, x in enumerate(xs) if x < p["length"]]
                yield pd.DataFrame(rows, columns=["src", "block_no", "phase_start", "slot"])

    return starts.mapInPandas(lay, "src string, block_no long, phase_start long, slot long")


def gaps_before(ended: list[tuple[int, str, int]], blocks: dict[str, int], short: dict[str, int]) -> dict[int, int]:
    """Per first slot of a phase the rows by which sources that ended in phases before it fell short of full blocks; ended is (phase_start, source, end block)."""
    out, total = {}, 0
    for start, group in groupby(ended, key=lambda x: x[0]):
        out[start] = total
        total += sum(short[s] for _, s, to in group if to == blocks[s])
    return out


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, period: int | None = None, buckets: int = RANK_BUCKETS) -> DataFrame:
    """docs with src, block_no, slot and place (the order of the mix, from 0).

    Every row is kept: sources that outlast others go on alone. A null source is
    a source of its own; weights not given are 1. A source's rows are ordered by
    a hash of doc_id and text, ranked within buckets of that hash whose counts
    are summed, so a source of any size is ranked by many tasks; repeated rows
    take neighbouring ranks. Names that clash with the added ones are replaced.
    An empty table gives an empty one. Texts are hashed whole, however long.
    The driver holds a row a source and phase, and at most BROADCAST_SLOTS slots.
    """
    spark = docs.sparkSession
    extra = ("src", "block_no", "slot", "place")
    buckets = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = docs.drop(*extra).withColumn("src", F.coalesce(F.col("source").cast("string"), F.lit("\0null")))
    hashed = base.select("src", F.xxhash64("doc_id", "text").alias("_h"), F.col("doc_id").alias("_id"), F.struct(*base.columns).alias("_row")).withColumn("_b", F.pmod(F.shiftright("_h", 32), F.lit(buckets)).cast("int"))
    counts = hashed.groupBy("src", "_b").count()
    totals = {r.src: r["count"] for r in counts.groupBy("src").agg(F.sum("count").alias("count")).collect()}
    if not totals:
        return base.withColumns({"src": F.lit(None).cast("string"), "block_no": F.lit(0).cast("long"), "slot": F.lit(0).cast("long"), "place": F.lit(0).cast("long")}).limit(0)
    blocks, wanted = {s: -(-n // block) for s, n in totals.items()}, {s: (weights or {}).get(s, 1.0) for s in totals}
    short = {s: blocks[s] * block - n for s, n in totals.items()}  # a source's last block leaves its slot short
    before = counts.withColumn("_before", F.coalesce(F.sum("count").over(Window.partitionBy("src").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("src", "_b", "_before")
    rank = F.row_number().over(Window.partitionBy("src", "_b").orderBy("_h", "_id")) - 1
    ranked = hashed.withColumn("_r", rank).join(before, ["src", "_b"]).withColumn("_r", F.col("_r") + F.col("_before"))
    ranked = ranked.withColumn("block_no", F.floor(F.col("_r") / block).cast("long"))
    plan = phases(blocks, wanted, period, BROADCAST_SLOTS)
    if plan is None:
        long_plan = outlines(blocks, wanted, period)
        gaps = gaps_before([(p["phase_start"], s, n) for p in long_plan for s, n in p["to"].items()], blocks, short)
        phase_gaps = spark.createDataFrame(list(gaps.items()), "phase_start long, _gap long")  # a row a phase
        out = ranked.join(block_slots(spark, long_plan).join(phase_gaps, "phase_start"), ["src", "block_no"])
    else:
        gaps = gaps_before([(p["phase_start"], p["source"], p["to"]) for p in plan], blocks, short)
        schema = "src string, phase_start long, gap long, parts long, size long, slots array<long>, `from` long, to long"
        rows = [(p["source"], p["phase_start"], gaps[p["phase_start"]], p["parts"], p["size"], p["slots"], p["from"], p["to"]) for p in plan]
        schedule = spark.createDataFrame(rows, schema).groupBy("src").agg(F.collect_list(F.struct("phase_start", "gap", "parts", "size", "slots", "from", "to")).alias("_phases"))
        phase = F.filter("_phases", lambda p: (p["from"] <= F.col("block_no")) & (F.col("block_no") < p["to"]))[0]
        k = F.col("block_no") - F.col("_p.from")
        slot = F.col("_p.phase_start") + F.floor(k / F.col("_p.parts")) * F.col("_p.size") + F.get(F.col("_p.slots"), F.pmod(k, F.col("_p.parts")).cast("int"))
        out = ranked.join(F.broadcast(schedule), "src").withColumn("_p", phase).withColumn("slot", slot.cast("long")).withColumn("_gap", F.col("_p.gap"))
    out = out.withColumn("place", (F.col("slot") * block - F.col("_gap") + F.pmod("_r", F.lit(block))).cast("long"))
    return out.select("_row.*", "block_no", "slot", "place")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: one row a document with its block, slot and place; sources of src0 get double weight."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed(docs, {"src0": 2.0}).select("doc_id", F.when(F.col("src") != "\0null", F.col("src")).alias("source"), "block_no", "slot", "place")
