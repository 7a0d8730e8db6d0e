"""What a job's records say about each other: aggregates, baselines, uniqueness."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.similarity import tone_similarity
from kindred.operators.blocks import near_records, spread, starts, typed
from kindred.sources.package import ship


def inverted_index(images: DataFrame) -> DataFrame:
    """(job, ref, records): the records that show an image."""
    return images.groupBy("job", "ref").agg(F.array_sort(F.collect_set("record")).alias("records"))


def medians(lists: pa.Array, first: np.ndarray) -> pa.Array:
    """median_aggregate() of the groups of non-empty histograms that start at ``first``."""
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    inside = np.arange(n.max()) < n[:, None]
    m = np.zeros(inside.shape)
    m[inside] = pc.fill_null(lists.flatten().cast(pa.float64()), np.nan).to_numpy()
    total = m.cumsum(1)[:, -1:]
    some = total > 0  # not if a bin is null
    m = np.where(some, m / np.where(some, total, 1.0), 0.0)
    m[~inside] = np.nan
    size = np.diff(np.append(first, len(n)))
    out, width = np.zeros((len(first), m.shape[1]), np.int64), np.maximum.reduceat(n, first)
    for k in np.unique(size):
        at = np.flatnonzero(size == k)
        stack = np.sort(m[first[at][:, None] + np.arange(k)], axis=1)  # what is missing comes last
        count = (~np.isnan(stack)).sum(1, keepdims=True)
        low, high = (np.take_along_axis(stack, np.maximum(x, 0), 1)[:, 0] for x in ((count - 1) // 2, np.minimum(count // 2, k - 1)))
        middle = np.where(count[:, 0] > 0, (low + high) / 2, 0.0)
        whole = middle.cumsum(1)[:, -1:]
        x = np.where(whole > 0, middle / np.where(whole > 0, whole, 1.0) * 255, 0.0)
        out[at] = np.floor(x) + (x - np.floor(x) >= 0.5)
    ends = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(out[np.arange(out.shape[1]) < width[:, None]]))


def median_aggregate(hists: DataFrame, keys: list[str], hist: str) -> DataFrame:
    """keys and one histogram each: the per-bin median of the shares, summing to 255 after rounding; zeros without mass.

    Rows come sorted by the keys, and a task holds a batch and one group.
    """
    ship(hists.sparkSession)
    rows = hists.select(*keys, hist).where(F.size(hist) > 0).repartition(spread(hists.sparkSession), *keys).sortWithinPartitions(*keys)  # the only shuffle: images, not their bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(t: pa.Table, first: np.ndarray) -> pa.RecordBatch:
            got = [t.column(k).combine_chunks().take(pa.array(first)) for k in keys]
            return pa.RecordBatch.from_arrays([*got, medians(t.column(hist).combine_chunks(), first)], [*keys, hist])

        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
            first = np.unique(np.concatenate([starts(t, k) for k in keys]))
            if len(first) > 1:
                yield made(t.slice(0, first[-1]).combine_chunks(), first[:-1])
            rest = t.slice(first[-1])
        if rest is not None:
            yield made(rest.combine_chunks(), np.zeros(1, np.int64))

    return rows.mapInArrow(run, f"{typed(hists, *keys)}, `{hist}` array<bigint>")


def tone_pairs(images: DataFrame, threshold: float) -> DataFrame:
    """(job, ref, near): pairs of a job's images with tone similarity of threshold or more, both ways.

    Such pairs differ little in mean tone, so images are bucketed by their
    mean and meet in the bucket of one and the neighbours of the other. How
    many pairs that spares depends on the images: tones that are spread like
    noise all have like means.
    """
    width = 255.0 * (1 - threshold) + 1e-6  # a little more, so that rounding loses no pair
    mean = F.aggregate("blob", F.lit(0.0), lambda a, x: a + x) / F.size("blob")
    rows = images.select("job", "ref", "blob").dropDuplicates(["job", "ref"]).withColumn("b", F.floor(mean / width))
    left = rows.withColumn("b", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)))
    right = rows.select("job", "b", F.col("ref").alias("near"), F.col("blob").alias("other"))
    return left.join(right, ["job", "b"]).where((F.col("ref") != F.col("near")) & (tone_similarity(F.col("blob"), F.col("other")) >= threshold)).select("job", "ref", "near")


def uniqueness(images: DataFrame, threshold: float = 0.85, alpha: float = 1.0) -> DataFrame:
    """(job, ref, matches, uniqueness): 1 / (1 + alpha * other records that show the image or a near copy); all pairs of a job, in blocks."""
    got = near_records(images, threshold)
    matches = F.greatest(F.col("n") - 1, F.lit(0)).cast("long")
    return got.select("job", "ref", matches.alias("matches"), (1.0 / (1.0 + alpha * matches)).alias("uniqueness"))


def baseline(images: DataFrame, similarities: dict[str, Column], pairs: int = 1000, whole: bool = False) -> DataFrame:
    """(job, one column for each similarity): mean similarity of sampled image pairs that share no record; 0.5 where there is none.

    A sampling operator: images draw partners among all of their job's images
    by hash, up to 20 each where the job has few; in a job of many, only those
    draw whose hash lies below a threshold that leaves some ``4 * pairs`` draws
    a job, before anything is joined; if ``whole``, all do, which is one draw
    an image there. The ``pairs`` draws with the smallest
    hashes count. A similarity compares the images' columns with those of the
    same names and a 2. Aggregates of records are images with a record of
    their own.
    """
    prime = 2_147_483_647
    ref, h, n = F.col("ref"), F.col("h"), F.col("n")
    sizes = images.groupBy("job").agg(F.count("*").alias("n"))
    draws = F.least(F.lit(20), F.ceil(2.0 * pairs / n)).cast("int")
    spots = images.select("job", "ref", "record").join(sizes, "job").withColumn("draws", draws).withColumn("h", F.explode(F.sequence(F.lit(0), F.col("draws") - 1)))
    few = ((ref * 16_807 + h * 40_692) % prime).cast("double") * (n * F.col("draws")) < F.lit(4.0 * pairs * prime)
    left = (spots if whole else spots.where(few)).select("job", "ref", "record", "h", ((ref * 48_271 + h * 104_729) % prime % n).alias("want"))
    other = spots.select("job", "h", ((ref * 69_621 + h * 75_029) % prime % n).alias("want"), ref.alias("ref2"), F.col("record").alias("record2"))
    drawn = left.join(other, ["job", "h", "want"]).where("ref <> ref2 AND record <> record2")
    drawn = drawn.select("job", F.least("ref", "ref2").alias("ref"), F.greatest("ref", "ref2").alias("ref2")).distinct()
    mark = (F.col("ref") * 7919 + F.col("ref2") * 104_729) % prime
    drawn = drawn.withColumn("p", F.row_number().over(Window.partitionBy("job").orderBy(mark, "ref", "ref2"))).where(F.col("p") <= pairs)  # some 4 * pairs rows a job
    a, b = images.drop("record"), images.drop("record").select("job", *[F.col(c).alias(f"{c}2") for c in images.columns if c not in ("job", "record")])
    got = drawn.join(a, ["job", "ref"]).join(b, ["job", "ref2"]).groupBy("job").agg(*[F.avg(s).alias(n) for n, s in similarities.items()])
    return sizes.join(got, "job", "left").select("job", *[F.coalesce(n, F.lit(0.5)).alias(n) for n in similarities])
