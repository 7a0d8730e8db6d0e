"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are dealt into blocks of about equal text. Block j of a
source with weight w may be released at slot floor(j / w) and is due before
slot ceil((j + 1) / w); serving the earliest deadline among the released blocks
keeps every source within one block of its share at every slot. With weights in
whole parts of a period the schedule repeats, so one period is worked out and
every block finds its slot by arithmetic.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written


def quotas(weights: dict[str, float], period: int) -> dict[str, int]:
    """Slots of a period for each source: largest remainders, one at least; the sum is the period."""
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    got = {s: max(1, int(x)) for s, x in exact.items()}
    by_need = sorted(exact, key=lambda s: (got[s] - exact[s], s))
    k = 0
    while (short := period - sum(got.values())) != 0:
        s = by_need[k % len(by_need)] if short > 0 else max(got, key=lambda x: (got[x] - exact[x], got[x] > 1, x))
        got[s] += 1 if short > 0 else -1
        k += 1
    return got


def schedule(parts: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, j, slot, release, deadline) of one period, earliest deadline first."""
    period = sum(parts.values())
    waiting = [(0, s, 0) for s in parts]
    heapq.heapify(waiting)
    ready, out = [], []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            release, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // parts[s]), s, j, release))
        deadline, s, j, release = heapq.heappop(ready)
        out.append((s, j, slot, release, deadline))
        if j + 1 < parts[s]:
            heapq.heappush(waiting, ((j + 1) * period // parts[s], s, j + 1))
    return out


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_chars: int = 100_000, period: int = 1_000, bucket_rows: int = 10_000) -> DataFrame:
    """All rows and columns of ``docs`` (doc_id, text, source, ...) with block, slot, seq, release, deadline and in_mix.

    Order by (slot, seq) to read the mixture. ``weights`` has target shares by
    source; without it they go with the square root of each source's text, and
    sources that it lacks get its smallest weight. A source that runs out
    leaves its slots to the others, so every row keeps its one place; in_mix
    tells the rows before the first source runs out, where the shares hold. A
    null source is a source of its own; null and empty texts count as one
    character; equal rows follow each other. A text longer than a block stays
    whole, in the block that it begins in, and leaves the blocks that its length
    covers empty. There may be up to ``period`` / 2
    sources, else the period is lengthened.
    """
    spark = docs.sparkSession
    name = F.coalesce(F.col("source").cast("string"), F.lit("\x00null"))
    rows = docs.withColumns({"_kindred_s": name, "_kindred_n": F.char_length(F.coalesce("text", F.lit(""))) + 1, "_kindred_h": F.xxhash64("doc_id", "text"), "_kindred_id": F.col("doc_id")})
    sizes = {r["_kindred_s"]: r for r in rows.groupBy("_kindred_s").agg(F.sum("_kindred_n").alias("chars"), F.count("*").alias("rows")).collect()}  # a row for each source
    empty = docs.withColumns({c: F.lit(None).cast(t) for c, t in (("block", "long"), ("slot", "long"), ("seq", "long"), ("release", "long"), ("deadline", "long"), ("in_mix", "boolean"))})
    if not sizes:
        return empty
    least = min(weights.values()) if weights else 1.0
    share = {s: float((weights or {}).get(s, least)) if weights else r["chars"] ** 0.5 for s, r in sizes.items()}
    parts = quotas(share, max(period, 2 * len(share)))
    length = sum(parts.values())
    plan = spark.createDataFrame([(s, parts[s], *x) for s, *x in schedule(parts)], "_kindred_s string, _kindred_p long, _kindred_j long, _kindred_slot long, _kindred_release long, _kindred_deadline long")
    # a source's rows are spread over buckets by hash, so that its running total is that of whole buckets and then within one
    buckets = spark.createDataFrame([(s, -(-r["rows"] // bucket_rows)) for s, r in sizes.items()], "_kindred_s string, _kindred_b long")
    rows = rows.join(F.broadcast(buckets), "_kindred_s").withColumn("_kindred_b", F.pmod("_kindred_h", F.col("_kindred_b")))
    before = rows.groupBy("_kindred_s", "_kindred_b").agg(F.sum("_kindred_n").alias("_kindred_t")).withColumn("_kindred_before", F.sum("_kindred_t").over(Window.partitionBy("_kindred_s").orderBy("_kindred_b").rowsBetween(Window.unboundedPreceding, -1)))
    before = written(before.select("_kindred_s", "_kindred_b", F.coalesce("_kindred_before", F.lit(0)).alias("_kindred_before")))
    rows = rows.withColumn("_kindred_in", F.sum("_kindred_n").over(Window.partitionBy("_kindred_s", "_kindred_b").orderBy("_kindred_h", "_kindred_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_kindred_n"))
    rows = rows.join(before, ["_kindred_s", "_kindred_b"]).withColumn("_kindred_at", F.col("_kindred_in") + F.col("_kindred_before"))
    rows = rows.withColumn("_kindred_block", F.floor(F.col("_kindred_at") / block_chars)).withColumn("_kindred_q", F.col("_kindred_at") - F.col("_kindred_block") * block_chars)
    ends = []
    by_source: dict[str, list[int]] = {}
    for s, _, slot, _, _ in schedule(parts):
        by_source.setdefault(s, []).append(slot)
    for s, r in sizes.items():
        n = r["chars"] // block_chars  # the last block may not be full: the shares hold up to it
        ends.append(n // parts[s] * length + by_source[s][n % parts[s]])
    rows = rows.join(F.broadcast(plan.select("_kindred_s", "_kindred_p").distinct()), "_kindred_s").withColumn("_kindred_j", F.pmod("_kindred_block", "_kindred_p")).drop("_kindred_p").join(F.broadcast(plan), ["_kindred_s", "_kindred_j"])
    base = F.floor(F.col("_kindred_block") / F.col("_kindred_p")) * length
    return rows.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in ("block", "slot", "seq", "release", "deadline", "in_mix")],
        F.col("_kindred_block").cast("long").alias("block"), (base + F.col("_kindred_slot")).cast("long").alias("slot"), F.col("_kindred_q").cast("long").alias("seq"),
        (base + F.col("_kindred_release")).cast("long").alias("release"), (base + F.col("_kindred_deadline")).cast("long").alias("deadline"), (base + F.col("_kindred_slot") < min(ends)).alias("in_mix"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source and place of every document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    return mix(docs).drop("text")
