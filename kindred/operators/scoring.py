"""Image evidence of (scene, record) pairs: channel scores and their composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.similarity import EPS, clamp, sharpen

GAMMA, COUNT_K, MIN_CONTRIBUTION, BONUS_PER_EXTRA, BASELINE = 3.5, 0.25, 0.05, 0.1, 0.5
#: What file names, and performers and dates together, add to a search's score at most.
NAME, SOFT = 0.2, 0.3


def per_image_max(pairs: DataFrame, keys: list[str], similarity: Column) -> DataFrame:
    """Best similarity m (0 at least) of every record image to the scene's images: keys name scene, record and record image."""
    return pairs.groupBy(*keys).agg(F.greatest(F.max(similarity), F.lit(0.0)).alias("m"))


def top_k_mean(values: Column, k: Column) -> Column:
    """Mean of the k (1 at least) largest values; 0 without values."""
    best = F.slice(F.sort_array(values, asc=False), 1, F.greatest(F.lit(1), F.least(k, F.size(values))))
    return F.when(F.size(values) > 0, F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(best)).otherwise(0.0)


def weighted(maxima: DataFrame, features: DataFrame, uniqueness: DataFrame, baselines: DataFrame) -> DataFrame:
    """maxima (job, ref, ...) with what is stored of their images and jobs; null where nothing is.

    features (ref and the channels' qualities), uniqueness (job, ref,
    uniqueness) and baselines (job and the channels' baselines) are one left
    join each, and Spark broadcasts what is small enough.
    """
    return maxima.join(features, "ref", "left").join(uniqueness, ["job", "ref"], "left").join(baselines, "job", "left")


def frame_channels(maxima: DataFrame, keys: list[str], channels: dict[str, tuple[str, str, str, str]], gamma: float = GAMMA, count_k: float = COUNT_K) -> DataFrame:
    """keys and, for each channel, a struct of evidence, count_conf, dist_q and score.

    A channel names its columns of m, quality, uniqueness and baseline (null:
    1, 1 and 0.5). Evidence is the soft union of weighted sharpened maxima; the
    two factors say how much weight there is and how evenly it is spread. One
    shuffle for all channels.
    """
    sums = []
    rows = maxima
    for c, (m, quality, unique, base) in channels.items():
        w = F.when(F.col(m).isNotNull(), F.coalesce(F.col(quality), F.lit(1.0)) * F.coalesce(F.col(unique), F.lit(1.0)))  # what has no value has no weight
        rows = rows.withColumns({f"_{c}_mp": sharpen(F.col(m), F.coalesce(F.col(base), F.lit(BASELINE)), gamma), f"_{c}_w": w})
        mp, w = F.col(f"_{c}_mp"), F.col(f"_{c}_w")
        spread = F.when(mp > EPS, mp)
        sums += [
            F.sum(F.log(F.greatest(F.lit(EPS), 1.0 - clamp(w * mp)))).alias(f"_{c}_l"), F.sum(w).alias(f"_{c}_weight"),
            F.count(spread).alias(f"_{c}_k"), F.sum(spread).alias(f"_{c}_s"), F.sum(spread * F.log(spread)).alias(f"_{c}_sl"),
        ]
    return channel_scores(rows.groupBy(*keys).agg(*sums), keys, list(channels), count_k)


def channel_scores(got: DataFrame, keys: list[str], channels: list[str], count_k: float = COUNT_K, more: tuple[str, ...] = ()) -> DataFrame:
    """keys, ``more`` and the channels' structs of frame_channels(), from the channels' sums over images."""
    for c in channels:
        x = lambda n, c=c: F.col(f"_{c}_{n}")
        entropy = F.log(x("s")) - x("sl") / x("s")
        evidence, count = clamp(1.0 - F.exp(x("l"))), clamp(1.0 - F.exp(-x("weight") / max(EPS, count_k)))
        even = F.when((x("k") > 1) & (x("s") > EPS), clamp(0.5 + 0.5 * entropy / F.log(x("k")), 0.5, 1.0)).otherwise(0.5)
        got = got.withColumn(c, F.struct(evidence.alias("evidence"), count.alias("count_conf"), even.alias("dist_q"), (evidence * count * even).alias("score")))
    return got.select(*keys, *channels, *more)


def channel_details(rows: DataFrame, keys: list[str], channels: dict[str, tuple[str, str, str, str]], gamma: float = GAMMA) -> DataFrame:
    """keys and, for each channel, a struct of what its score is made of: the images in order, and what each adds, to four places.

    rows as for frame_channels(), with ref. Only what is shown should come
    here: a record's images are collected into arrays.
    """
    four = lambda c: F.round(c, 4)
    parts = []
    for c, (m, quality, unique, base) in channels.items():
        b = F.coalesce(F.col(base), F.lit(BASELINE))
        row = F.struct(
            "ref", four(F.col(m)).alias("m"), four(sharpen(F.col(m), b, gamma)).alias("mp"), four(F.coalesce(F.col(quality), F.lit(1.0))).alias("q"),
            four(F.coalesce(F.col(unique), F.lit(1.0))).alias("u"),
        )
        parts += [F.array_sort(F.collect_list(row)).alias(f"_{c}"), F.max(four(b)).alias(f"_{c}_b")]
    got = rows.groupBy(*keys).agg(*parts)
    for c in channels:
        of = lambda f, c=c: F.transform(f"_{c}", lambda x: x[f])
        got = got.withColumn(c, F.struct(
            F.size(f"_{c}").alias("n_extractor_images"), of("ref").alias("extractor_refs"), of("m").alias("per_image_max"), of("mp").alias("m_primes"),
            of("q").alias("qualities"), of("u").alias("uniquenesses"), F.col(f"_{c}_b").alias("baseline"),
        ))
    return got.select(*keys, *channels)


def frame_channel(maxima: DataFrame, keys: list[str], gamma: float = GAMMA, count_k: float = COUNT_K) -> DataFrame:
    """keys, evidence, count_conf, dist_q and score of one channel, from rows of keys, m, quality, uniqueness and baseline."""
    got = frame_channels(maxima, keys, {"c": ("m", "quality", "uniqueness", "baseline")}, gamma, count_k)
    return got.select(*keys, "c.evidence", "c.count_conf", "c.dist_q", "c.score")


def aggregate_channel(similarity: Column, quality: Column, baseline: Column, gamma: float = GAMMA) -> Column:
    return clamp(sharpen(similarity, baseline, gamma) * quality)


def compose(channels: dict[str, Column], min_contribution: float = MIN_CONTRIBUTION, bonus: float = BONUS_PER_EXTRA) -> tuple[Column, Column]:
    """(composite, fired): the best channel that fires and a bonus for every other one, 1 at most."""
    on = {n: F.coalesce(c >= min_contribution, F.lit(False)) for n, c in channels.items()}
    fired = F.filter(F.array(*[F.when(on[n], F.lit(n)) for n in channels]), lambda x: x.isNotNull())
    best = F.array_max(F.array(*[F.when(on[n], c) for n, c in channels.items()]))
    return F.coalesce(clamp(best + bonus * (F.size(fired) - 1)), F.lit(0.0)), fired
