"""The feature store: upserts, freshness, cache states, cascades and eviction, as whole-table rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The sources whose rows the eviction budget covers, and the quality that marks a known failure: fixed values.
EVICTABLE, FAILED = ["stash_cover", "stash_sprite", "stash_aggregate"], -1.0
#: The sources whose rows belong to a job: fixed values.
PER_JOB = ["extractor_image", "extractor_aggregate"]


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key, by ``order`` descending; at equal order a new row replaces an old one, and of rows on one side the one with the larger hash stays."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order], F.desc("_new"), F.desc(F.xxhash64(*old.columns))))
    return both.withColumn("_r", rank).where("_r = 1").drop("_r", "_new")


def replace_jobs(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with all rows of the jobs in ``new`` replaced."""
    return old.join(new.select("job_id").distinct(), "job_id", "left_anti").unionByName(new)


def replace_cascade(tables: dict[str, DataFrame], jobs: DataFrame, results: DataFrame) -> dict[str, DataFrame]:
    """The store after new versions of ``jobs`` (job_id, ...) with their ``results``: everything that was derived from an old version goes.

    tables: jobs, results, corpus_stats, image_uniqueness, job_state and
    match_results by job_id, and features (source, ref_id), whose extractor
    rows carry the job before the first colon of ref_id. Features of the
    scenes' own images stay. A table that is not given is not touched.
    """
    changed = jobs.select("job_id").distinct()
    out = {}
    for name, old in tables.items():
        if name == "features":
            own = F.col("source").isin(PER_JOB)
            of = old.withColumn("_job", F.when(own, F.substring_index("ref_id", ":", 1)))
            out[name] = of.join(changed.select(F.col("job_id").cast("string").alias("_job")), "_job", "left_anti").drop("_job")
        else:
            kept = old.join(changed, "job_id", "left_anti")
            out[name] = kept.unionByName({"jobs": jobs, "results": results}[name]) if name in ("jobs", "results") else kept
    return out


def upsert_features(old: DataFrame, new: DataFrame) -> DataFrame:
    """Features by (source, ref_id, channel, algorithm), the latest computed_at of each; new rows of evictable sources count as read when computed, others never."""
    seeded = new.withColumn("last_accessed_at", F.when(F.col("source").isin(EVICTABLE), F.col("computed_at")))
    return upsert_latest(old, seeded, ["source", "ref_id", "channel", "algorithm"], ["computed_at"])


def touch(features: DataFrame, reads: DataFrame) -> DataFrame:
    """``features`` with last_accessed_at moved on to the latest of ``reads`` (source, ref_id, at); evictable sources only, and no remembered failures."""
    latest = reads.groupBy("source", "ref_id").agg(F.max("at").alias("_at"))
    moved = F.col("source").isin(EVICTABLE) & (F.coalesce("quality", F.lit(0.0)) != FAILED)
    return features.join(latest, ["source", "ref_id"], "left").withColumn("last_accessed_at", F.when(moved, F.greatest("last_accessed_at", "_at")).otherwise(F.col("last_accessed_at"))).drop("_at").select(*features.columns)


def cascade_keep(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key).distinct(), key, "left_semi")


def stale_jobs(cached: DataFrame, current: DataFrame) -> DataFrame:
    """(job_id, state): fresh, stale or new by completed_at alone."""
    both = current.select("job_id", "completed_at").join(cached.select("job_id", F.col("completed_at").alias("_old"), F.lit(True).alias("_had")), "job_id", "left")
    return both.select("job_id", F.when(F.col("_had").isNull(), "new").when(F.col("_old").eqNullSafe(F.col("completed_at")), "fresh").otherwise("stale").alias("state"))


def cache_state(wanted: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """wanted with state: hit, failed (a remembered failure) or miss; a row with another fingerprint is a miss."""
    got = features.select(*keys, "fingerprint", "quality")
    state = F.when(F.col("quality").isNull(), "miss").when(F.col("quality") == FAILED, "failed").otherwise("hit")
    return wanted.join(got, [*keys, "fingerprint"], "left").withColumn("state", state).drop("quality")


_GROUPS_BITS = 16  # a step of the search for the cut looks at 65,536 groups at most


def eviction(rows: DataFrame, budget: int, ties: list[str]) -> tuple[Column, int, int]:
    """(which rows go, their number, their bytes): rows go in the order of their last access until what stays fits ``budget``.

    ``rows`` have bytes and last_accessed_at; rows that were never read go
    first, equal times by the whole numbers in ``ties``. The cut is found by
    prefixes of the order: sums over at most 65,536 ranges tell in which range
    it lies, and that range alone is looked at more closely, until it is one
    row (or rows that agree in everything, which go together). Nothing is
    sorted, and what comes back is a condition on a row's own columns. Null
    bytes count as 0.
    """
    size = F.coalesce(F.col("bytes"), F.lit(0)).cast("long")
    at = F.col("last_accessed_at").cast("timestamp")
    keys = [F.when(at.isNull(), 0).otherwise(1).cast("long"), F.coalesce(F.unix_micros(at), F.lit(0)), *[F.coalesce(F.col(t).cast("long"), F.lit(-(2**63))) for t in ties]]
    ends = [x for i, k in enumerate(keys) for x in (F.min(k).alias(f"lo{i}"), F.max(k).alias(f"hi{i}"))]
    here = rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count("*").alias("n"), *ends).first()
    need, done, gone = here["bytes"] - budget, 0, 0
    if need <= 0 or not here["n"]:
        return F.lit(False), 0, 0
    inside, before = F.lit(True), F.lit(False)  # rows of the range that the cut is in, and rows that go for sure
    while need < done + here["bytes"]:
        i = next((i for i in range(len(keys)) if here[f"lo{i}"] < here[f"hi{i}"]), None)
        if i is None:
            break
        step = max(0, (here[f"hi{i}"] - here[f"lo{i}"]).bit_length() - _GROUPS_BITS)
        part = F.shiftright(keys[i], step)
        groups = rows.where(inside).groupBy(part.alias("part")).agg(F.sum(size).alias("bytes"), F.count("*").alias("n"), *ends)
        run = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # the groups of one step
        found = groups.withColumns({"upto": F.sum("bytes").over(run), "rows": F.sum("n").over(run)}).where(F.col("upto") >= need - done).orderBy("part").first()
        before = before | (inside & (part < found["part"]))
        inside = inside & (part == found["part"])
        done, gone, here = done + found["upto"] - found["bytes"], gone + found["rows"] - found["n"], found
    return before | inside, gone + here["n"], done + here["bytes"]


def lru_evict(rows: DataFrame, budget: int, ties: list[str]) -> DataFrame:
    """The rows that eviction() leaves."""
    return rows.where(~eviction(rows, budget, ties)[0])


def evict_features(features: DataFrame, budget: int) -> tuple[DataFrame, int, int]:
    """(features that stay, rows and bytes freed): evictable sources only are counted and go, equal times by a hash of their keys."""
    tie = F.xxhash64("source", "ref_id", "channel", "algorithm")
    rows = features.withColumns({"bytes": F.octet_length("feature_blob").cast("long"), "_tie": tie})
    own = F.col("source").isin(EVICTABLE)
    goes, n, freed = eviction(rows.where(own), budget, ["_tie"])
    return rows.where(~(own & goes)).select(*features.columns), n, freed


def legacy_gap(legacy: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    return legacy.join(features.select(*keys), keys, "left_anti")


def store_bytes(features: DataFrame) -> DataFrame:
    return features.where(F.col("source").isin(EVICTABLE)).agg(F.coalesce(F.sum(F.length("feature_blob")), F.lit(0)).alias("bytes"))


# --- the store in folders -----------------------------------------------------------
GONE = "_gone"


def write_table(root: str, name: str, rows: DataFrame, jobs: DataFrame) -> None:
    """Replace the rows of the ``jobs`` (job_id) in a table of the store by ``rows``, other jobs' partitions untouched.

    A job without new rows gets one marked row, which read_table() leaves out:
    its partition is written over as well, without any listing of folders.
    """
    of = jobs.select(F.col("job_id").cast("string").alias("job_id")).distinct()
    rows = rows.withColumn("job_id", F.col("job_id").cast("string")).join(of, "job_id", "left_semi").withColumn(GONE, F.lit(False))
    marks = of.join(rows.select("job_id").distinct(), "job_id", "left_anti").withColumn(GONE, F.lit(True))
    whole = rows.unionByName(marks, allowMissingColumns=True)
    whole.repartition("job_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """A table of the store; empty where it was never written."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, {GONE} boolean").parquet(f"{root}/{name}")
    return rows.where(f"NOT coalesce({GONE}, false)").drop(GONE)


def write_job_results(root: str, jobs: DataFrame, results: DataFrame, derived: dict[str, DataFrame]) -> None:
    """New versions of ``jobs`` and their ``results`` into the store; what was ``derived`` from the old ones goes.

    ``derived`` names the tables that hang on the jobs, each with an example of
    its columns. They are emptied first, then the results are written, and
    last the jobs, whose completed_at tells that a version is there: after a
    crash in between the job still counts as stale, and the same call mends it.
    """
    for name, like in derived.items():
        write_table(root, name, like.limit(0), jobs)
    write_table(root, "results", results, jobs)
    write_table(root, "jobs", jobs, jobs)
