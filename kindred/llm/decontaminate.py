"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

A window can be as similar to an item as asked only if it has six in seven of
the item's shingles, so only texts with three quarters of them go on, with the
windows that hold enough of them, at any start. Each window and each item gets
a 64-bit SimHash. Eight blocks of eight bits index the items under every value
within two bits of their own: two fingerprints that differ in at most 23 bits
agree to within two bits in at least one block, so the index misses none of
them; at a similarity of 0.75 they differ in 11 on average, with a deviation of
3. What is left is held to the exact weighted (counted) Jaccard similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

BLOCKS, WIDTH, NEAR = 8, 8, 2
RADIUS = BLOCKS * (NEAR + 1) - 1


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def _shingles(w: str, k: int, hashed: bool) -> Column:
    """All runs of k words of the array column w, as 64-bit hashes or as texts."""
    at = lambda i: [F.get(F.col(w), i + j) for j in range(k)]
    made = (lambda i: F.xxhash64(*at(i))) if hashed else (lambda i: F.concat_ws(" ", *at(i)))
    return F.when(F.size(w) >= k, F.transform(F.slice(F.col(w), 1, F.greatest(F.size(w) - (k - 1), F.lit(0))), lambda _, i: made(i))).otherwise(made_empty(hashed))


def made_empty(hashed: bool) -> Column:
    return F.array().cast("array<bigint>" if hashed else "array<string>")


def simhash(hashes: str) -> Column:
    return F.expr(
        f"aggregate(sequence(0, 63), 0L, (acc, j) -> acc | if(aggregate({hashes}, 0, (s, h) -> s + if((shiftright(h, j) & 1L) = 1L, 1, -1)) > 0, shiftleft(1L, j), 0L))"
    )


def _common(a: str, b: str) -> Column:
    """Size of the counted intersection of two arrays."""
    counted = f"aggregate(array_intersect({a}, {b}), 0, (s, x) -> s + least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))"
    # where no shingle of one side repeats, its count can't be more than one
    return F.expr(f"if(size(array_distinct({a})) = size({a}) OR size(array_distinct({b})) = size({b}), size(array_intersect({a}, {b})), {counted})")


def _starts(similarity: float) -> Column:
    """Where windows begin that have as many hits ``at`` as nearness takes; q words at most may lack on a side.

    Windows between one hit and the next hold the same hits or fewer. Two
    arrays of w and m shingles must have similarity / (1 + similarity) of
    w + m in common: the hit that many places on must lie within the window.
    """
    need = f"cast(ceil({similarity / (1 + similarity)!r} * (least(m, most) + m) - 1e-9) as int)"
    return F.expr(
        f"flatten(transform(at, (p, i) -> filter(sequence(greatest(if(i = 0, 0, get(at, i - 1) + 1), p - q, 0), p), s -> (s = 0 OR s + m <= most) AND get(at, i + {need} - 1) < s + m)))"
    )


def leaks(docs: DataFrame, items: DataFrame, similarity: float = 0.75, shingle: int = 5, at_once: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, start, similarity) of every window of ``docs`` (doc_id, text) that is near an item (item_id, text).

    A window is a run of as many words as the item has, or the whole of a
    shorter text. Null and empty texts have no window; an item without words
    matches nothing. An item with fewer than ``shingle`` words,
    like its windows, has one shingle, all its words. Rows that share a doc_id
    are taken together; repeated items are reported each; other columns are
    ignored, and texts of any length are whole. The item shingles are broadcast
    ``at_once`` at most, in as many passes as that takes.
    """
    spark = docs.sparkSession
    items = items.select("item_id", words(F.col("text")).alias("iw")).where("size(iw) > 0").withColumn("n", F.size("iw"))
    items = written(items.withColumn("k", F.least("n", F.lit(shingle))))
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most ``shingle`` values
    kind = docs.schema["doc_id"].dataType.simpleString()
    every = [spark.createDataFrame([], f"doc_id {kind}, item_id {items.schema['item_id'].dataType.simpleString()}, start int, similarity double")]
    for k in sizes:
        own = items.where(F.col("k") == k).withColumn("ih", _shingles("iw", k, True))
        marked = own.select("item_id", "n", F.size("ih").alias("m"), "ih", simhash("ih").alias("iprint"), _shingles("iw", k, False).alias("it"))
        marked = written(marked.withColumn("item", F.monotonically_increasing_id()))
        grams = written(marked.select("item", "m", F.explode("ih").alias("h")).distinct())
        passes = -(-grams.count() // at_once)
        keyed = docs.select(*[F.xxhash64(*c).alias(f"k{i}") for i, c in enumerate((("doc_id", "text"), ("text", "doc_id")))], "doc_id", "text")
        tokens = keyed.select("k0", "k1", words(F.col("text")).alias("w")).withColumn("h", _shingles("w", k, True))
        hits = []
        for p in range(passes):
            some = F.broadcast(grams.where(F.pmod("h", F.lit(passes)) == p))
            # outer, since the filter that Spark adds below a plain explode would work out h, and w for each shingle, anew
            found = tokens.select("k0", "k1", F.posexplode_outer("h").alias("pos", "h")).join(some, "h")
            hits.append(found.groupBy("k0", "k1", "item", "m").agg(F.collect_set("pos").alias("at")))
        reach = hits[0]
        if passes > 1:
            for more in hits[1:]:
                reach = reach.unionByName(more)
            reach = reach.groupBy("k0", "k1", "item", "m").agg(F.flatten(F.collect_list("at")).alias("at"))
        reach = written(reach.where(F.size("at") >= similarity * F.col("m")).select("k0", "k1", "item", "m", F.array_sort("at").alias("at"), F.floor((1 - similarity) * F.col("m") + 1e-9).cast("int").alias("q")))
        near = keyed.join(reach.join(marked.select("item", "n"), "item"), ["k0", "k1"]).select("doc_id", "item", "n", "m", "q", "at", words(F.col("text")).alias("w"))
        near = near.withColumn("most", F.size("w") - (k - 1)).withColumn("starts", _starts(similarity))
        # cut out before they are dealt into rows, so that no row carries the whole text
        windows = near.select("doc_id", "item", F.explode(F.transform("starts", lambda s: F.struct(s.alias("start"), F.slice("w", s + 1, F.col("n")).alias("ww")))).alias("x")).select("doc_id", "item", "x.start", "x.ww")
        windows = windows.distinct().withColumn("wh", _shingles("ww", k, True)).where("size(wh) > 0").withColumn("print", simhash("wh")).withColumn("wt", _shingles("ww", k, False))
        windows = written(windows.drop("ww", "wh").withColumn("row", F.monotonically_increasing_id()))  # once written, the numbers stay
        block = lambda p: F.expr(f"transform(sequence(0, {BLOCKS - 1}), b -> shiftright({p}, b * {WIDTH}) & {2**WIDTH - 1}L)")
        masks = F.expr("array(" + ",".join(f"{m}L" for m in range(2**WIDTH) if m.bit_count() <= NEAR) + ")")
        index = marked.select("item", "iprint", F.posexplode(block("iprint")).alias("b", "v")).withColumn("v", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("v")))))
        # the item is part of the key: only items whose shingles the window has are compared
        pairs = windows.select("row", "item", "print", F.posexplode(block("print")).alias("b", "v")).join(written(index), ["item", "b", "v"])
        pairs = pairs.where(F.bit_count(F.col("print").bitwiseXOR(F.col("iprint"))) <= RADIUS).select("row").distinct()
        held = pairs.join(windows.select("row", "item", "doc_id", "start", "wt"), "row").join(marked.select("item", "item_id", "it"), "item")
        held = held.withColumn("both", _common("wt", "it")).withColumn("union", F.size("wt") + F.size("it") - F.col("both"))
        every.append(held.where(F.col("both") >= similarity * F.col("union")).select("doc_id", "item_id", "start", (F.col("both") / F.col("union")).alias("similarity")))
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    return out


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents: doc_id, item_id, how many windows are near, and the best similarity."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = leaks(docs, table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("item_id"), "text"))
    return found.groupBy("doc_id", "item_id").agg(F.countDistinct("start").alias("n_windows"), F.round(F.max("similarity"), 6).alias("similarity"))


def drop_leaking(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold an item; rows that share a doc_id share their fate by text, not by id."""
    keyed = docs.withColumn("_kindred_key", F.sha2("text", 256))
    bad = written(leaks(keyed.select(F.col("_kindred_key").alias("doc_id"), "text"), items).select(F.col("doc_id").alias("_kindred_key")).distinct())
    return keyed.join(bad, "_kindred_key", "left_anti").drop("_kindred_key")
