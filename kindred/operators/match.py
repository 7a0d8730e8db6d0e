"""Candidate selection and the two query plans: ranked search and the scrape cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.text import partial_date, same_folded, sanitize_details, strip
from kindred.operators.scoring import NAME, SOFT
from kindred.sources.assets import completed_jobs

#: The field names that a job's schema must have: fixed values.
REQUIRED = ["id", "title", "details", "date", "cover_image", "url", "performers", "images"]


def schema_superset(fields: Column, required: list[str] = REQUIRED) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(x) for x in required]), fields)) == 0


def scene_jobs(jobs: DataFrame, schemas: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    """The completed ``jobs`` (job_id, schema_id, status, ...) whose schema (schema_id, fields) has all required fields."""
    fit = schemas.where(schema_superset(F.col("fields"), required)).select("schema_id").distinct()
    return completed_jobs(jobs).join(fit, "schema_id", "left_semi")


def scrape_output(rows: DataFrame) -> DataFrame:
    """rows with output, the JSON of what is known of a record, in fixed names; empty values are left out.

    Needs title, details, date, url, code, image, studio and performers, an
    array of (name).
    """
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    people = F.when(F.size("performers") > 0, F.transform("performers", lambda p: F.struct(p["name"].alias("Name"))))
    fields = [text("title").alias("Title"), sanitize_details(F.col("details")).alias("Details"), text("date").alias("Date"), text("url").alias("URL"), F.nullif(strip(F.col("code")), F.lit("")).alias("Code"), F.col("image").alias("Image")]
    studio = F.when(F.coalesce("studio", F.lit("")) != "", F.struct(F.col("studio").alias("Name"))).alias("Studio")
    return rows.withColumn("output", F.to_json(F.struct(*fields, studio, people.alias("Performers"))))


def best_raw(candidates: DataFrame) -> DataFrame:
    """(scene_id, job_id, result_index, image): each scene's best image score before any threshold; ties go to the first record."""
    rank = F.row_number().over(Window.partitionBy("scene_id").orderBy(F.desc("image"), "job_id", "result_index"))
    return candidates.withColumn("_r", rank).where("_r = 1").select("scene_id", "job_id", "result_index", "image")


def top_similarities(maxima: DataFrame, keys: list[str], most: int = 20) -> DataFrame:
    """keys and top, the ``most`` largest per-image similarities m in descending order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("m"), "ref"))
    best = maxima.withColumn("_r", rank).where(F.col("_r") <= most)
    return best.groupBy(*keys).agg(F.sort_array(F.collect_list("m"), asc=False).alias("top"))


def studio_narrow(scenes: DataFrame, jobs: DataFrame) -> DataFrame:
    """(scene_id, job_id, used_filter): the jobs named like a scene's studio, or all jobs for a scene without one.

    Scenes with a studio go through an equi-join; only those without one meet
    every job.
    """
    named = strip(F.col("studio")) != ""
    fold = lambda x: F.replace(F.lower(strip(F.col(x))), F.lit("ß"), F.lit("ss"))
    some = scenes.where(named).withColumn("_n", fold("studio")).join(jobs.withColumn("_n", fold("job_name")), "_n").select("scene_id", "job_id", F.lit(True).alias("used_filter"))
    every = scenes.where(~named).select("scene_id").crossJoin(jobs.select("job_id")).select("scene_id", "job_id", F.lit(False).alias("used_filter"))
    return some.unionByName(every)


def candidate_pool(narrowed: DataFrame, records: DataFrame) -> DataFrame:
    return narrowed.join(records, "job_id")


def pool_counts(narrowed: DataFrame, records: DataFrame, value: str) -> DataFrame:
    """(job_id, used_filter, pairs, scenes, checksum) of candidate_pool(): its rows, its different scenes and the sum of the records' ``value``.

    Every scene of a job meets every record of it, so both sides are counted
    by job first, and the pool, their product, isn't written out.
    """
    scenes = narrowed.groupBy("job_id", "used_filter").agg(F.count("*").alias("_n"), F.countDistinct("scene_id").alias("scenes"))
    of = records.groupBy("job_id").agg(F.count("*").alias("_m"), F.sum(value).alias("_sum"))
    got = scenes.join(of, "job_id")
    return got.select("job_id", "used_filter", (F.col("_n") * F.col("_m")).alias("pairs"), "scenes", (F.col("_n") * F.col("_sum")).alias("checksum"))


def code_fires(code: Column, record_id: Column, used_filter: Column) -> Column:
    return used_filter & (strip(code) != "") & (strip(record_id) == strip(code))


def title_fires(title: Column, record_title: Column) -> Column:
    return (strip(title) != "") & F.coalesce(strip(title) == record_title, F.lit(False))


def search(candidates: DataFrame, limit: int = 5, floor: float | None = None) -> DataFrame:
    """The best ``limit`` candidates of each scene, zero scores dropped after that.

    Candidates have scene_id, job_id, result_index, code_hit, title_hit, image,
    filename, performer and date scores.
    """
    c = candidates if floor is None else candidates.where((F.col("image") >= floor) | F.col("code_hit") | F.col("title_hit"))
    raw = F.col("code_hit").cast("int") + F.col("title_hit").cast("int") + F.col("image") + NAME * F.col("filename") + SOFT * (0.5 * F.col("performer") + 0.5 * F.col("date"))
    c = c.withColumn("raw_score", raw).withColumn("score", F.least("raw_score", F.lit(1.0)))
    # scores that differ in the last digits alone, by the order of summing, are ties
    rank = F.row_number().over(Window.partitionBy("scene_id").orderBy(F.desc(F.round("score", 9)), "job_id", "result_index"))
    return c.withColumn("rank", rank).where(F.col("rank") <= limit).where("score > 0")


def debug_view(results: DataFrame) -> Column:
    """How a result of search() came by its score, as JSON.

    Needs what search() needs, and the structs ``phash``, ``tone`` (of
    frame_channels() and channel_details() together), ``color_hist``, and
    ``fired``, the channels that count. Numbers are to four places.
    """
    four = lambda c: F.round(c, 4)
    scores = ["E", "count_conf", "dist_q", "S"]
    more = ["baseline", "n_extractor_images", "extractor_refs", "per_image_max", "m_primes", "qualities", "uniquenesses"]

    def frame(c: str) -> Column:
        named = zip(("evidence", "count_conf", "dist_q", "score"), scores, strict=True)
        return F.struct(*[four(F.col(c)[x]).alias(y) for x, y in named], *[F.col(f"{c}_details")[x].alias(x) for x in more])

    soft = 0.3 * (0.5 * F.col("performer") + 0.5 * F.col("date"))
    image = F.struct(
        F.struct(frame("phash").alias("phash"), F.struct(four(F.col("color_hist")).alias("S")).alias("color_hist"), frame("tone").alias("tone")).alias("channels"),
        F.col("fired"), four(F.col("image")).alias("composite"),
    )
    return F.to_json(F.struct(
        F.col("code_hit").alias("studio_code"), F.col("title_hit").alias("exact_title"), image.alias("image"), four(F.col("image")).alias("image_contribution"),
        four(0.2 * F.col("filename")).alias("filename_contribution"), four(F.col("performer")).alias("performer_score"), four(F.col("date")).alias("date_score"),
        four(soft).alias("soft_contribution"), four(F.col("raw_score")).alias("raw_score"), four(F.col("score")).alias("capped_score"),
    ))


def known(code: Column, title: Column, date: Column, cast: Column, prefix: str = "") -> list[Column]:
    """What a search knows of a scene, or with the prefix r of a record: code, title, the date's parts and the performers' ids.

    Equal codes and titles are hits: give null where a scene has none, or may
    not go by it.
    """
    day = partial_date(date)
    return [x.alias(prefix + n) for n, x in (("code", code), ("title", title), *[(c, day[c]) for c in ("y", "m", "d")], ("cast", cast))]


def named_performers(record_names: DataFrame, performers: DataFrame) -> DataFrame:
    """(record_id, cast): the ids of the performers (performer_id, name, aliases) that a record (record_id, name) names, as in performer_score()."""
    hits = record_names.withColumn("n", F.lower(strip(F.col("name")))).join(_known_as(performers), "n")
    return hits.groupBy("record_id").agg(F.collect_set("performer_id").alias("cast"))


def _first_tier(hits: DataFrame) -> DataFrame:
    first = Window.partitionBy("scene_id").orderBy("tier", "job_id", "result_index")
    return hits.withColumn("r", F.row_number().over(first)).where("r = 1").select("scene_id", "job_id", "result_index", "tier")


def by_image(images: DataFrame, threshold: float) -> DataFrame:
    """The last tier of scrape(): each scene's best image score (scene_id, job_id, result_index, image), if it reaches the threshold."""
    best = F.row_number().over(Window.partitionBy("scene_id").orderBy(F.desc("image"), "job_id", "result_index"))
    return images.where((F.col("image") >= threshold) & (F.col("image") > 0)).withColumn("r", best).where("r = 1").select("scene_id", "job_id", "result_index", F.lit(3).alias("tier"))


def settled(scenes: DataFrame, records: DataFrame) -> DataFrame:
    """The cheap tiers of scrape(), for scenes (scene_id, job, code, title) that meet all records (job, record, rcode, rtitle) of their jobs.

    Only the first record of a job with a code, or a title, can be the result,
    so that one alone is joined: no pair is written out.
    """
    def hits(n: str, tier: int) -> DataFrame:
        first = records.where(F.col(f"r{n}").isNotNull()).groupBy("job", F.col(f"r{n}").alias(n)).agg(F.min("record").alias("result_index"))
        return scenes.join(first, ["job", n]).select("scene_id", F.col("job").alias("job_id"), "result_index", F.lit(tier).alias("tier"))

    return _first_tier(hits("code", 1).unionByName(hits("title", 2)))


def scrape(candidates: DataFrame, images: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(scene_id, job_id, result_index, tier): one definitive record, by code, else title, else image.

    Scenes that the cheap tiers settle never meet ``images`` (scene_id, job_id,
    result_index, image): they are taken out before that join.
    """
    cheap = _first_tier(candidates.where("code_hit OR title_hit").withColumn("tier", F.when(F.col("code_hit"), 1).otherwise(2)))
    rest = candidates.join(cheap.select("scene_id"), "scene_id", "left_anti").select("scene_id", "job_id", "result_index").join(images, ["scene_id", "job_id", "result_index"])
    return cheap.unionByName(by_image(rest, threshold))


def exact_url(requests: DataFrame, records: DataFrame, limit: int = 5) -> DataFrame:
    """(request_id, job_id, result_index, rank) of the records with the request's very url, score 1."""
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy("job_id", "result_index"))
    return requests.join(records, "url").withColumn("rank", rank).where(F.col("rank") <= limit).select("request_id", "job_id", "result_index", "rank", F.lit(1.0).alias("score"))


def _known_as(performers: DataFrame) -> DataFrame:
    return performers.select("performer_id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n")).select("performer_id", F.lower(strip(F.col("n"))).alias("n")).distinct()


def performer_score(scene_performers: DataFrame, record_names: DataFrame, performers: DataFrame) -> DataFrame:
    """(scene_id, record_id, score): share of a scene's performers that a candidate record names, by name or alias, case aside.

    scene_performers (scene_id, performer_id), record_names (scene_id,
    record_id, name), performers (performer_id, name, aliases).
    """
    names = _known_as(performers)
    size = scene_performers.groupBy("scene_id").agg(F.countDistinct("performer_id").alias("size"))
    hits = record_names.withColumn("n", F.lower(strip(F.col("name")))).join(names, "n").join(scene_performers, ["scene_id", "performer_id"]).groupBy("scene_id", "record_id").agg(F.countDistinct("performer_id").alias("hits"))
    every = record_names.select("scene_id", "record_id").distinct().join(size, "scene_id", "left")
    return every.join(hits, ["scene_id", "record_id"], "left").select("scene_id", "record_id", F.coalesce(F.col("hits") / F.col("size"), F.lit(0.0)).alias("score"))


__all__ = ["best_raw", "debug_view", "scene_jobs", "scrape_output", "top_similarities", "candidate_pool", "pool_counts", "code_fires", "by_image", "exact_url", "known", "named_performers", "performer_score", "same_folded", "schema_superset", "scrape", "search", "settled", "studio_narrow", "title_fires"]
