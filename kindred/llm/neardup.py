"""MinHash near-duplicates with odd sketches.

Texts with equal shingle sets form one class. A class's MinHash samples give
banded keys, which find candidates, and are folded into a parity bitmap, the odd
sketch: the population count of two bitmaps' XOR tells how many samples differ,
precisely so for high similarities. What passes that test is confirmed on full
sets. In a bucket, classes are first held against the one with most company in
its buckets, which is mostly the same one in all buckets of a group; only
buckets that still hold classes of several components go on to pairs across
them, which meet by their rarest shingles. So a large group of copies costs
about as many pairs as it has members, and no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, ship, split_words, sweep, table, written
from .graph import components

BANDS, ROWS = 32, 4
BINS, BITS = 512, 1024


def odd_limit(a, b, exp=np.exp, sqrt=np.sqrt):
    """Odd bits that sets of a and b shingles may differ in at similarity 0.75 or more, five deviations above their mean.

    Of the u samples that their union fills, a quarter differ, which leaves up
    to two elements each; d elements leave BITS / 2 * (1 - exp(-2 d / BITS)).
    """
    u = BINS * (1 - exp(-(a + b) / (1.75 * BINS)))
    d = u / 2
    fade = exp(-4 * d / BITS)
    return BITS / 2 * (1 - exp(-2 * d / BITS)) + 5 * sqrt(0.75 * u * fade + BITS / 4 * (1 - fade) - d * fade + 1)


_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 2**64, BANDS * ROWS, np.uint64)
_P = _RNG.integers(0, 2**64, 16, np.uint64) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def shingle_sets(text: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text one after the other, and offsets. Fewer than k words: one shingle, all of them."""
    codes, words, offsets = split_words(text)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    names = pd.util.hash_array(np.array(words.to_pylist(), dtype=object), categorize=False).astype(np.uint64)
    w = names[codes]
    size = np.diff(offsets)
    n = np.where(size >= k, size - k + 1, (size > 0).astype(np.int64))
    of = np.repeat(np.arange(len(size)), n)
    first = np.cumsum(n) - n
    at = np.arange(len(of)) - first[of] + offsets[:-1][of]
    h = np.zeros(len(of), np.uint64)
    length = np.minimum(size, k)[of]
    with np.errstate(over="ignore"):
        for j in range(k):
            ok = length > j
            h[ok] = _mix(h[ok] * _P[j] + w[at[ok] + j] + _P[8])
        h ^= length.astype(np.uint64)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[keep], of[keep]
    return h, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(size)))])


def signatures(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band keys, odd sketches and 128-bit set digests of the non-empty sets (all sets must be non-empty)."""
    starts, n = offsets[:-1], len(offsets) - 1
    sig = np.empty((n, BANDS * ROWS), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(BANDS * ROWS):
            sig[:, i] = np.minimum.reduceat(h * _A[i] + _B[i], starts)
        keys = np.zeros((n, BANDS), np.uint64)
        for r in range(ROWS):
            keys = _mix(keys * _P[9] + sig[:, r::ROWS])
        keys = _mix(keys + np.arange(BANDS, dtype=np.uint64) * _P[10])
        # the samples of the odd sketch: the smallest hash in each of BINS ranges; hashes come sorted
        of = np.repeat(np.arange(n), np.diff(offsets))
        bin_ = (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64) + of * BINS
        first = np.r_[True, bin_[1:] != bin_[:-1]]
        spot = of[first] * BITS + (_mix(h[first] * _P[11]) % np.uint64(BITS)).astype(np.int64)
        parity = (np.bincount(spot, minlength=n * BITS) & 1).astype(np.uint8)
        odd = np.packbits(parity, bitorder="little").view(np.uint64).reshape(n, BITS // 64)
        one, two = np.add.reduceat(_mix(h + _P[12]), starts), np.add.reduceat(_mix(h * _P[13]), starts)
    return keys, odd, np.stack([one, two], 1)


_SIG = "doc_id long, k0 long, k1 long, n long, cid binary, bands array<long>, odd array<long>"


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.view(np.int64).ravel()))


def _sign(batches):
    for b in pieces(batches):
        h, offsets = shingle_sets(b.column("text"))
        n = np.diff(offsets)
        some = np.flatnonzero(n)
        nothing = pa.nulls(b.num_rows, pa.binary()), pa.nulls(b.num_rows, pa.list_(pa.int64())), pa.nulls(b.num_rows, pa.list_(pa.int64()))
        if len(some):
            keys, odd, digest = signatures(h, np.concatenate([[0], np.cumsum(n[some])]))
            index = np.full(b.num_rows, -1)
            index[some] = np.arange(len(some))
            index = pa.array(index, mask=index < 0)
            raw = digest.tobytes()
            cid = pa.array([raw[i * 16 : i * 16 + 16] for i in range(len(some))], pa.binary())
            nothing = cid.take(index), _lists(keys).take(index), _lists(odd).take(index)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k0"), b.column("k1"), pa.array(n), *nothing], ["doc_id", "k0", "k1", "n", "cid", "bands", "odd"])


def _sets(batches):
    for b in pieces(batches):
        h, offsets = shingle_sets(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("cid"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(h.view(np.int64)))], ["cid", "hs"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k0"), F.xxhash64("text", "doc_id").alias("k1"))


def _near(a: str, b: str) -> Column:
    """What two near classes must have: sizes in proportion, and odd sketches that differ in few bits."""
    bits = sum((F.bit_count(F.get(f"{a}odd", F.lit(i)).bitwiseXOR(F.get(f"{b}odd", F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    return (100 * F.least(f"{a}n", f"{b}n") >= 75 * F.greatest(f"{a}n", f"{b}n")) & (bits <= odd_limit(F.col(f"{a}n"), F.col(f"{b}n"), F.exp, F.sqrt))


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of which 100 * common >= 75 * all shingles."""
    got = pairs.join(sets.select(F.col("cid").alias("a"), F.col("hs").alias("ah")), "a").join(sets.select(F.col("cid").alias("b"), F.col("hs").alias("bh")), "b")
    common = F.size(F.array_intersect("ah", "bh"))
    return written(got.withColumn("c", common).where("100 * c >= 75 * (size(ah) + size(bh) - c)").select("a", "b"))


def _largest(placed: DataFrame) -> DataFrame:
    """(bucket, big): the component with most members in each bucket."""
    return placed.groupBy("bucket", "root").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.max_by("root", F.struct("c", "root")).alias("big"))


def _prefix(n: Column, m: Column) -> Column:
    """How many of its rarest shingles a set of n must be looked at by, to share one with any set of m that is near it."""
    return n - F.ceil((n + m) * 3 / 7).cast("long") + 1


def across(placed: DataFrame, facts: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of classes that lie in one bucket's reach but in different components.

    ``placed`` (bucket, cid, root) has the members of buckets that hold several
    components. Two near sets share one of their rarest shingles, the more so
    the nearer their sizes: of n and m shingles, 3 / 7 of (n + m) must be common.
    So every member is listed under its rarest shingles and its size, and the
    members outside their bucket's largest component look up theirs under each
    size that their buckets hold. A shingle that only one member or one
    component has leads nowhere and is not listed. No pair is formed within a
    component, nor for copies whose differences are their own.
    """
    outside = written(placed.join(_largest(placed), "bucket").where("root <> big").select("bucket", "cid"))
    members = written(placed.select("cid", "root").distinct().join(facts, "cid"))
    shingles = written(members.select("cid").join(sets, "cid").select("cid", F.explode("hs").alias("h")))
    often = shingles.groupBy("h").agg(F.count("*").alias("f")).where("f > 1")
    # the place of a shingle in its set, rarest first: those of one member only come before all others
    shared = written(shingles.join(often, "h").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("by")))
    listed = members.join(shared, "cid").select("cid", "root", "n", F.posexplode("by").alias("at", "x"), (F.col("n") - F.size("by")).alias("own"))
    listed = listed.select("cid", "root", "n", F.col("x.h").alias("h"), (F.col("at") + F.col("own")).alias("place"))
    listed = written(listed.where(F.col("place") < _prefix(F.col("n"), F.ceil(F.col("n") * 3 / 4))))
    sweep(placed.sparkSession)
    least, most = F.ceil(F.col("n") * 3 / 4), F.floor(F.col("n") * 4 / 3)
    sizes = placed.join(facts.select("cid", F.col("n").alias("size")), "cid").select("bucket", "size").distinct()
    wanted = outside.join(facts.select("cid", "n"), "cid").join(sizes, "bucket").where(F.col("size").between(least, most)).select("cid", "size").distinct()
    probes = listed.join(wanted, "cid").where(F.col("place") < _prefix(F.col("n"), F.col("size")))
    spans = listed.groupBy("h", F.col("n").alias("size")).agg(F.min("root").alias("r0"), F.max("root").alias("r1"))
    probes = probes.join(spans, ["h", "size"]).where("r0 <> root OR r1 <> root").select("h", "size", F.col("cid").alias("a"), F.col("root").alias("ar"), F.col("n").alias("an"))
    other = listed.select("h", F.col("n").alias("size"), F.col("cid").alias("b"), F.col("root").alias("br"), F.col("place").alias("bp"))
    met = probes.join(other, ["h", "size"]).where((F.col("ar") != F.col("br")) & (F.col("bp") < _prefix(F.col("size"), F.col("an"))))
    return written(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def near_duplicates(docs: DataFrame, rounds: int = 2) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept, links, k0, k1 (hashes of the row) and root (the class that names the component; null for rows alone).

    Rows are linked if 100 * common >= 75 * all distinct shingles (five words;
    with fewer words, the whole). component_id is the smallest doc_id of the
    component, and kept says that the row has it; null doc_ids are larger than
    others. Rows without words, null texts too, are alone. links counts the
    confirmed links to other classes found for the row's class. Repeated rows
    stay; all copies with the smallest doc_id are kept, and so are rows alone
    without a doc_id. Other columns are ignored, very long texts are whole.
    """
    spark = docs.sparkSession
    ship(spark)
    keyed = _keyed(docs)
    sig = written(keyed.mapInArrow(_sign, _SIG))
    some = sig.where("n > 0")
    cls = written(some.groupBy("cid").agg(F.min("doc_id").alias("low"), F.min(F.struct("k0", "k1")).alias("k"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("odd").alias("odd")))
    rows = cls.select("cid", F.explode("bands").alias("bucket"))
    counts = written(rows.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1"))
    crowd = written(rows.join(counts, "bucket"))
    # the more company a class has in its buckets, the nearer it is to what its group has in common
    crowded = written(crowd.groupBy("cid").agg(F.sum("m").alias("company")))
    crowd = written(crowd.select("bucket", "cid").join(crowded, "cid"))
    facts = cls.select("cid", "n", "odd")

    def tested(pairs: DataFrame) -> DataFrame:
        """Pairs of classes whose sizes and odd sketches allow a link."""
        a, b = (facts.select(F.col("cid").alias(x), F.col("n").alias(f"{x}n"), F.col("odd").alias(f"{x}odd")) for x in "ab")
        return written(pairs.join(a, "a").join(b, "b").where(_near("a", "b")).select("a", "b"))

    texts = keyed.join(cls.join(crowded, "cid", "left_semi").select(F.col("k.k0").alias("k0"), F.col("k.k1").alias("k1"), "cid"), ["k0", "k1"])
    sets = written(texts.select("cid", "text").mapInArrow(_sets, "cid binary, hs array<long>").dropDuplicates(["cid"]))
    sweep(spark)
    links = written(spark.createDataFrame([], "a binary, b binary"))
    roots = None
    placed = crowd.withColumn("root", F.col("cid"))

    def mixed(roots: DataFrame) -> DataFrame:
        """Members of the buckets that hold several components yet."""
        now = written(crowd.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid")))
        some = now.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("bucket")
        return written(now.join(written(some), "bucket"))

    def grown(roots: DataFrame | None, more: DataFrame) -> DataFrame:
        """Components with more links: earlier ones go in as stars, not link by link; without links they stay."""
        if roots is not None and not more.take(1):
            return roots
        return written(components(more if roots is None else more.union(roots.where("node <> root"))))

    for r in range(rounds + 1):
        if r and not placed.take(1):  # no bucket holds several components: no more pairs
            break
        if r < rounds:
            # one leader for a bucket's largest component and then for the rest: mostly the same one in all buckets of a group
            led = placed if r == 0 else placed.join(_largest(placed), "bucket").where("root <> big")
            leaders = written(led.groupBy("bucket").agg(F.max_by(F.struct("cid", "root"), F.struct("company", "cid")).alias("l")))
            pairs = placed.join(leaders, "bucket").where("root <> l.root").select(F.least("cid", "l.cid").alias("a"), F.greatest("cid", "l.cid").alias("b")).distinct()
        else:
            pairs = across(placed, facts, sets)
        candidates = tested(pairs)
        sweep(spark)  # plans and shuffles so far are done with
        more = _confirm(candidates, sets)
        links, roots = links.union(more), grown(roots, more)
        sweep(spark)
        if r < rounds:
            placed = mixed(roots)
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    degree = links.select("a").union(links.select("b")).groupBy("a").agg(F.count("*").alias("links"))
    by_root = cls.select("cid", "low").join(roots.withColumnRenamed("node", "cid"), "cid").join(degree.withColumnRenamed("a", "cid"), "cid")
    lowest = written(by_root.groupBy("root").agg(F.min("low").alias("lowest")))
    found = written(cls.select("cid", "low").join(by_root.select("cid", "root", "links").join(lowest, "root").select("cid", "root", "lowest", "links"), "cid", "left").select("cid", F.coalesce("root", "cid").alias("root"), F.coalesce("lowest", "low").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links")))
    alone = F.col("doc_id").isNull() & F.col("component_id").isNull()  # in a component without any doc_id
    out = some.select("doc_id", "k0", "k1", "n", "cid").join(found, "cid").select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)) | alone).alias("kept"), "links", "k0", "k1", "root")
    lone = sig.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(0).cast("long").alias("links"), "k0", "k1", F.lit(None).cast("binary").alias("root"))
    return out.unionByName(lone)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return near_duplicates(docs).drop("k0", "k1", "links", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, with the columns of ``docs``; of rows with one doc_id and text, one stays too."""
    keyed = docs.withColumns({"_kindred0": F.xxhash64("doc_id", "text"), "_kindred1": F.xxhash64("text", "doc_id")})
    found = near_duplicates(docs)
    # the row of the smallest doc_id, nulls last, stands for its component; rows without words for themselves
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k0", "k1")).alias("k")
    grouped = found.where("root IS NOT NULL").groupBy("root").agg(first).select("k")
    kept = grouped.unionByName(found.where("root IS NULL").groupBy("k0", "k1").agg(first).select("k"))
    kept = written(kept.select(F.col("k.k0").alias("_kindred0"), F.col("k.k1").alias("_kindred1")).distinct())
    return keyed.join(kept, ["_kindred0", "_kindred1"], "left_semi").dropDuplicates(["_kindred0", "_kindred1"]).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE_OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
g AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 75 * (len(x.s) + len(y.s) - c)),
r AS (SELECT a AS n, b AS m FROM e UNION SELECT r.n, e.b FROM r JOIN e ON r.m = e.a),
k AS (SELECT n, min(m) AS m FROM r GROUP BY n)
SELECT doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(k.m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(k.m, doc_id)) AS kept
FROM s LEFT JOIN k ON k.n = s.doc_id
"""
