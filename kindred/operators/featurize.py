"""Features of images, computed once.

What is stored is read, what failed before is remembered, and only the rest is
computed and merged in: a batch that can be run again at any time, the second
run computing nothing. Stored features are rows of STORED, one for each image,
channel and algorithm; a quality of -1 marks a failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.functions import text as tx
from kindred.functions.images import image_features, sprite_features
from kindred.functions.similarity import gini_quality
from kindred.operators.corpus import median_aggregate
from kindred.operators.store import FAILED, upsert_features
from kindred.sources.assets import vtt_cues

STORED = "source string, ref_id string, fingerprint string, channel string, algorithm string, feature array<long>, quality double, computed_at timestamp"
KEYS = ["source", "ref_id", "fingerprint"]


def algorithm_keys(algorithm: str = "phash", size: int = 16) -> dict[str, str]:
    """The name under which each channel's features are stored: fixed values."""
    return {"phash": f"{algorithm}:{size}", "color_hist": "color_hist:hsv:4x4x4", "tone": "tone:gray:8x8"}


def _at(now: str | None) -> Column:
    return F.current_timestamp() if now is None else F.lit(now).cast("timestamp")


def _latest(value: Column | str) -> Column:
    """The value of the row computed last; a row of unknown time was the first."""
    return F.max_by(value, F.coalesce("computed_at", F.lit("0001-01-01").cast("timestamp")))


def _named(algorithms: dict[str, str]) -> Column:
    """Channel and algorithm fit each other."""
    return F.concat_ws("\n", "channel", "algorithm").isin([f"{c}\n{a}" for c, a in algorithms.items()])


def missing(wanted: DataFrame, stored: DataFrame, algorithms: dict[str, str], legacy: DataFrame | None = None) -> DataFrame:
    """``wanted`` (source, ref_id, fingerprint, ...) with the channels that have to be computed; rows that lack none are left out.

    A stored row of the same fingerprint counts, a remembered failure too;
    without a fingerprint nothing can be kept, so nothing is wanted. A hash in
    ``legacy``, rows of legacy_features(), counts as the hash channel.
    """
    have = stored.where(_named(algorithms)).select(*KEYS, "channel")
    if legacy is not None:
        have = have.unionByName(legacy.where(_named(algorithms)).select(*KEYS, "channel"))
    have = have.groupBy(*KEYS).agg(F.collect_set("channel").alias("_have"))  # a few channels an image
    every = F.array(*[F.lit(c) for c in algorithms])
    rows = wanted.where("fingerprint <> ''").dropDuplicates(KEYS).join(have, KEYS, "left")
    return rows.withColumn("channels", F.when(F.col("_have").isNull(), every).otherwise(F.array_except(every, "_have"))).drop("_have").where(F.size("channels") > 0)


def _rows(found: DataFrame, algorithms: dict[str, str], now: str | None) -> DataFrame:
    """STORED rows of the ``channels`` of each row with FEATURES; what could not be computed becomes a remembered failure."""
    value = {"phash": ("lanes", F.col("hash_quality")), "color_hist": ("histogram", gini_quality(F.col("histogram"))), "tone": ("tone", F.col("tone_quality"))}
    each = F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(a).alias("algorithm"), F.col(value[c][0]).alias("feature"), F.when(F.col(value[c][0]).isNotNull(), value[c][1]).alias("quality")) for c, a in algorithms.items()])
    rows = found.select(*KEYS, "channels", F.explode(each).alias("f")).where(F.array_contains("channels", F.col("f.channel")))
    return rows.select(*KEYS, "f.channel", "f.algorithm", F.coalesce("f.feature", F.array().cast("array<long>")).alias("feature"), F.coalesce("f.quality", F.lit(FAILED)).alias("quality"), _at(now).alias("computed_at"))


def featurize(wanted: DataFrame, stored: DataFrame, images: DataFrame, *, algorithm: str = "phash", size: int = 16, now: str | None = None, legacy: DataFrame | None = None) -> DataFrame:
    """The STORED rows that ``wanted`` (source, ref_id, fingerprint, path) lacks, computed from ``images`` (path, height, width, channels, pixels).

    An image that several rows show is decoded and computed once. A path that
    ``images`` does not have, or has without pixels, gives remembered failures
    in all channels; a nearly even image fails in the hash channel alone.
    """
    algorithms = algorithm_keys(algorithm, size)
    lacking = missing(wanted, stored, algorithms, legacy)
    computed = image_features(images.join(lacking.select("path").distinct(), "path", "left_semi"), algorithm, size).dropDuplicates(["path"])
    return _rows(lacking.join(computed, "path", "left"), algorithms, now)


def featurize_sprites(scenes: DataFrame, stored: DataFrame, sheets: DataFrame, *, sample: int = 8, algorithm: str = "phash", size: int = 16, now: str | None = None) -> DataFrame:
    """The STORED rows of the sampled frames of ``scenes`` (scene_id, fingerprint, path, vtt), as scene_id:index of the source stash_sprite.

    A scene is done if its first frame is stored under the fingerprint; the
    frames of a scene are written together. Without sheet, text or cue a scene
    gets a remembered failure in the place of its first frame.
    """
    algorithms = algorithm_keys(algorithm, size)
    first = F.concat(F.col("scene_id").cast("string"), F.lit(":0"))
    lacking = missing(scenes.withColumns({"source": F.lit("stash_sprite"), "ref_id": first}), stored, algorithms).select("scene_id", "fingerprint", "path", "vtt", "channels")
    cues = vtt_cues(lacking.select(F.col("scene_id").alias("ref"), "vtt"))
    own = sheets.join(lacking.select(F.col("scene_id").alias("ref"), "path"), "path")
    frames = sprite_features(own, cues, sample, algorithm, size).withColumnRenamed("ref", "scene_id")
    frames = frames.withColumn("index", F.row_number().over(Window.partitionBy("scene_id").orderBy("position")) - 1)  # a scene's frames
    rows = lacking.select("scene_id", "fingerprint", "channels").join(frames, "scene_id", "left")
    ref = F.concat(F.col("scene_id").cast("string"), F.lit(":"), F.coalesce("index", F.lit(0)).cast("string"))
    return _rows(rows.withColumns({"source": F.lit("stash_sprite"), "ref_id": ref}), algorithms, now)


def resolve(wanted: DataFrame, stored: DataFrame, algorithms: dict[str, str]) -> DataFrame:
    """``wanted`` by channel with state (hit, failed or miss), feature and quality; only hits have the latter two."""
    rows = wanted.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in algorithms])))
    have = stored.where(_named(algorithms)).select(*KEYS, "channel", F.col("feature").alias("_f"), F.col("quality").alias("_q"), F.lit(True).alias("_had"))
    hit = F.col("_had").isNotNull() & (F.coalesce("_q", F.lit(0.0)) != FAILED)
    state = F.when(F.col("_had").isNull(), "miss").when(hit, "hit").otherwise("failed")
    return rows.join(have, [*KEYS, "channel"], "left").withColumns({"state": state, "feature": F.when(hit, F.col("_f")), "quality": F.when(hit, F.col("_q"))}).drop("_f", "_q", "_had")


def stored_features(spark: SparkSession, path: str) -> DataFrame:
    """The features in a folder, the latest of each image, channel, algorithm and fingerprint; none where the folder isn't there yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], STORED)
    rows = spark.read.schema(STORED).parquet(path)
    best = _latest(F.struct("feature", "quality", "computed_at")).alias("b")
    return rows.groupBy(*KEYS, "channel", "algorithm").agg(best).select(*KEYS, "channel", "algorithm", "b.*")


def featurize_into(path: str, wanted: DataFrame, images: DataFrame, **options) -> int:
    """Append what ``wanted`` lacks to the features in the folder; the number of rows added.

    A write commits whole or not at all; after a failure the next run computes
    what is still missing, after a success nothing.
    """
    spark = wanted.sparkSession
    before = spark.read.schema(STORED).parquet(path).count() if not stored_features(spark, path).isEmpty() else 0
    featurize(wanted, stored_features(spark, path), images, **options).write.mode("append").parquet(path)
    return spark.read.schema(STORED).parquet(path).count() - before


# --- scenes' colour aggregates ------------------------------------------------------
def scene_fingerprint(files: Column, screenshot: Column) -> Column:
    """oshash|t of a scene's files and its cover's url; empty where both are."""
    a, b = F.coalesce(tx.oshash(files), F.lit("")), F.coalesce(tx.screenshot_fingerprint(screenshot), F.lit(""))
    return F.when((a == "") & (b == ""), "").otherwise(F.concat(a, F.lit("|"), b))


def scene_aggregates(scenes: DataFrame, stored: DataFrame, *, now: str | None = None) -> DataFrame:
    """The STORED rows of colour aggregates that ``scenes`` (scene_id, fingerprint) lack: bin medians over the cover and all sampled frames.

    The parts are ``stored`` histograms: of the source stash_cover by scene_id,
    and of stash_sprite by scene_id:index, each under its own half of the
    scene's fingerprint; failures are no parts. Aggregates are kept under
    scene_id and ``fingerprint``, as of scene_fingerprint(), and made again
    only when it changes. A scene without parts gets none.
    """
    algorithms = {"color_hist": algorithm_keys()["color_hist"]}
    ref = F.col("scene_id").cast("string")
    lacking = missing(scenes.withColumns({"source": F.lit("stash_aggregate"), "ref_id": ref}), stored, algorithms).select("scene_id", *KEYS)
    good = stored.where(_named(algorithms) & (F.col("quality") != FAILED) & F.col("source").isin("stash_cover", "stash_sprite"))
    latest = good.groupBy("source", "ref_id", F.col("fingerprint").alias("of")).agg(_latest("feature").alias("feature"))
    owner = F.when(F.col("source") == "stash_cover", F.col("ref_id")).otherwise(F.regexp_extract("ref_id", r"^(.*):\d+$", 1))
    whole = F.col("fingerprint")
    half = F.when(F.col("kind") == "stash_sprite", F.substring_index(whole, "|", 1)).otherwise(F.substr(whole, F.instr(whole, "|") + 1))
    parts = latest.select(owner.alias("ref_id"), F.col("source").alias("kind"), "of", "feature").join(lacking.select("ref_id", "fingerprint"), "ref_id").where(F.col("of") == half)
    merged = median_aggregate(parts, ["ref_id"], "feature")
    got = lacking.join(merged, "ref_id")
    return got.select(
        *KEYS, F.lit("color_hist").alias("channel"), F.lit(algorithms["color_hist"]).alias("algorithm"), "feature",
        gini_quality(F.col("feature")).alias("quality"), _at(now).alias("computed_at"),
    )


# --- the older table of hashes ------------------------------------------------------
def hash_hex(lanes: Column, size: int) -> Column:
    """A hash in hexadecimal digits, four bits each, as the older table keeps it."""
    return F.substring(F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ""), 1, -(-size * size // 4))


def hex_lanes(digits: Column) -> Column:
    """64-bit lanes of hexadecimal digits, the last filled with zeros."""
    n = F.ceil(F.char_length(digits) / 16).cast("int")
    half = lambda i, k: F.conv(F.rpad(F.substring(digits, i * 16 + 1 + 8 * k, F.lit(8)), 8, "0"), 16, 10).cast("long")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.shiftleft(half(i, 0), 32).bitwiseOR(half(i, 1)))


def legacy_features(legacy: DataFrame) -> DataFrame:
    """Rows of the older table (source, ref_id, fingerprint, algorithm, hash_size, hash) as STORED rows of the hash channel, their quality unknown."""
    return legacy.where("hash <> ''").select(
        *KEYS, F.lit("phash").alias("channel"), F.concat_ws(":", "algorithm", F.col("hash_size").cast("string")).alias("algorithm"),
        hex_lanes(F.col("hash")).alias("feature"), F.lit(None).cast("double").alias("quality"), F.lit(None).cast("timestamp").alias("computed_at"),
    )


def with_legacy(stored: DataFrame, legacy: DataFrame, enabled: bool = True) -> DataFrame:
    """``stored`` and, if enabled, the older hashes that it has no row for, remembered failures being rows."""
    old = legacy_features(legacy).join(stored.select(*KEYS, "channel", "algorithm"), [*KEYS, "channel", "algorithm"], "left_anti")
    return stored.unionByName(old) if enabled else stored


def to_legacy(new: DataFrame) -> DataFrame:
    """What a batch writes to the older table as well: its hashes, failures not among them."""
    name, size = F.substring_index("algorithm", ":", 1), F.substring_index("algorithm", ":", -1).try_cast("int")
    rows = new.where((F.col("channel") == "phash") & (F.coalesce("quality", F.lit(0.0)) != FAILED))
    digits = F.array_join(F.transform("feature", lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")
    return rows.select(*KEYS, name.alias("algorithm"), size.alias("hash_size"), F.substring(digits, F.lit(1), F.ceil(size * size / 4).cast("int")).alias("hash"))


def merged(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The store after a batch, as upsert_features() has it."""
    return upsert_features(stored, new)
