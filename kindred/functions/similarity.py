"""Similarities and qualities of image features, as column expressions.

Hashes are arrays of 64-bit lanes, histograms and tone signatures arrays of
whole numbers. A null on either side gives similarity 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once: inside a lambda, Spark would work out an outer expression for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def bits(lanes: Column) -> Column:
    return F.aggregate(lanes, F.lit(0), lambda a, x: a + F.bit_count(x))


def hamming_similarity(a: Column, b: Column, size: int) -> Column:
    """1 - differing bits / size, 0 at least."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.coalesce(F.greatest(F.lit(0.0), 1.0 - differ / F.lit(float(size))), F.lit(0.0))


def degenerate_hash(lanes: Column, size: int) -> Column:
    """Fewer than a tenth or more than nine tenths of the bits set, or no hash."""
    share = bits(lanes) / F.lit(float(size))
    return F.coalesce((share < 0.1) | (share > 0.9), F.lit(True))


def guarded_similarity(a: Column, b: Column, size: int) -> Column:
    return F.when(degenerate_hash(a, size) | degenerate_hash(b, size), F.lit(0.0)).otherwise(hamming_similarity(a, b, size))


def histogram_intersection(a: Column, b: Column) -> Column:
    """Sum of the smaller shares of each bin; 0 if either side has no mass."""
    total = lambda x: _sum(F.transform(x, lambda v: v.cast("double")))
    both = let(F.struct(total(a).alias("a"), total(b).alias("b")), lambda t: F.when((t["a"] > 0) & (t["b"] > 0), _sum(F.zip_with(a, b, lambda x, y: F.least(x / t["a"], y / t["b"])))))
    return F.coalesce(both, F.lit(0.0))


def tone_similarity(a: Column, b: Column) -> Column:
    """1 - mean absolute difference / 255; 0 for other lengths or none."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), 1.0 - differ / F.size(a) / F.lit(255.0)), F.lit(0.0))


def sharpen(m: Column, baseline: Column, gamma: float) -> Column:
    """Similarity above the noise floor, stretched to 0..1, to the power gamma."""
    raw = (m - baseline) / F.greatest(F.lit(EPS), 1.0 - baseline)
    return F.when(raw <= 0, F.lit(0.0)).when(raw >= 1, F.lit(1.0)).otherwise(F.pow(raw, F.lit(gamma)))


def gini_quality(hist: Column) -> Column:
    """How evenly a histogram's mass is spread; 0 without mass."""
    values = F.array_sort(F.transform(hist, lambda v: v.cast("double")))
    got = let(values, lambda s: F.when(_sum(s) > 0, clamp(2.0 * _sum(F.transform(s, lambda v, i: v * (F.size(s) - i))) / (F.size(s) * _sum(s)))))
    return F.coalesce(got, F.lit(0.0))


def entropy_variance_quality(pixels: Column) -> Column:
    """sqrt(min(1, entropy in bits / 8) * min(1, population variance / 10^4))."""
    n = F.size(pixels)
    mean = _sum(F.transform(pixels, lambda v: v.cast("double"))) / n
    var = let(mean, lambda m: _sum(F.transform(pixels, lambda v: F.pow(v - m, F.lit(2.0)))) / n)
    # runs of equal values in order: the sum of run * log2(run)
    run = lambda s: F.when(s["n"] > 0, s["n"] * F.log2(s["n"])).otherwise(0.0)
    start = F.struct(F.lit(None).cast("double").alias("v"), F.lit(0.0).alias("n"), F.lit(0.0).alias("sum"))
    step = lambda s, x: F.when(s["v"] == x, F.struct(x.alias("v"), (s["n"] + 1.0).alias("n"), s["sum"].alias("sum"))).otherwise(F.struct(x.alias("v"), F.lit(1.0).alias("n"), (s["sum"] + run(s)).alias("sum")))
    runs = F.aggregate(F.array_sort(F.transform(pixels, lambda v: v.cast("double"))), start, step, lambda s: s["sum"] + run(s))
    entropy = F.log2(n) - runs / n
    return F.coalesce(F.when(n > 0, F.sqrt(F.least(F.lit(1.0), entropy / 8.0) * F.least(F.lit(1.0), var / 1e4))), F.lit(0.0))
