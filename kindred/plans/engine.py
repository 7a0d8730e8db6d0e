"""The whole way from records, scenes and their pictures to ranked matches, over tables of any size.

``featurize_store`` brings a folder of features up to date; ``Matcher`` reads
it, works out what scoring needs once, and answers for all scenes together:
``search()`` with ranked records, ``scrape()`` with the one definite record.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import similarity as sim
from kindred.functions import text as tx
from kindred.functions.fuzzy import filename_scores
from kindred.operators import corpus, featurize, match, scoring
from kindred.operators.store import FAILED
from kindred.sources.assets import asset_key
from kindred.sources.tables import materialized, materialized_together

RECORDS = "job_id string, result_index long, page_url string, data struct<id:string,title:string,date:string,details:string,cover_image:string,url:string,performers:array<string>,images:array<string>>"
SCENES = "scene_id string, title string, code string, date string, studio string, filename string, cover string, sprite string, vtt string, files array<struct<fingerprints:array<struct<type:string,value:string>>>>, performers array<struct<id:string,name:string,aliases:array<string>>>"
RECORD_KEYS = ["scene_id", "job_id", "result_index"]


def record_images(records: DataFrame) -> DataFrame:
    """(job_id, result_index, ref) of all pictures that records name, the cover among them."""
    return records.select("job_id", "result_index", F.explode(tx.feature_references(F.col("data.images"), F.col("data.cover_image"))).alias("ref"))


def wanted_record_images(records: DataFrame, base: str) -> DataFrame:
    """What featurize() wants of the records' pictures: kept as job:ref under their resolved address, which is also their path below ``base``."""
    rows = record_images(records).select("job_id", "ref").distinct()
    url = tx.resolve_asset(F.col("ref"), base, F.col("job_id"))
    return rows.select(F.lit("extractor_image").alias("source"), F.concat_ws(":", "job_id", "ref").alias("ref_id"), url.alias("fingerprint"), asset_key(url).alias("path"))


def featurize_store(store: str, scenes: DataFrame, records: DataFrame, pictures: DataFrame, base: str, *, sample: int = 8, algorithm: str = "phash", size: int = 16, now: str | None = None) -> dict[str, int]:
    """Append to the folder what the pictures of ``records``, and covers, sprites and colour aggregates of ``scenes`` lack; rows added by kind.

    ``pictures`` (path, height, width, channels, pixels) holds all of them.
    Each kind commits on its own; a run after a failure takes up what is left.
    """
    spark = scenes.sparkSession
    options = {"algorithm": algorithm, "size": size, "now": now}
    cover = F.col("cover")
    covers = scenes.where("cover <> ''").select(F.lit("stash_cover").alias("source"), F.col("scene_id").alias("ref_id"), tx.screenshot_fingerprint(cover).alias("fingerprint"), asset_key(F.substring_index(cover, "?", 1)).alias("path"))
    sprites = scenes.where("sprite <> ''").select("scene_id", tx.oshash(F.col("files")).alias("fingerprint"), asset_key(F.col("sprite")).alias("path"), "vtt")
    whole = scenes.select("scene_id", featurize.scene_fingerprint(F.col("files"), cover).alias("fingerprint"))
    steps = {
        "records": lambda have: featurize.featurize(wanted_record_images(records, base), have, pictures, **options),
        "covers": lambda have: featurize.featurize(covers, have, pictures, **options),
        "sprites": lambda have: featurize.featurize_sprites(sprites, have, pictures, sample=sample, **options),
        "aggregates": lambda have: featurize.scene_aggregates(whole, have, now=now),
    }
    added = {}
    for name, step in steps.items():
        new = materialized(step(featurize.stored_features(spark, store)))
        added[name] = new.count()
        if added[name]:
            new.write.mode("append").parquet(store)
    return added


def _wide(features: DataFrame, algorithms: dict[str, str]) -> DataFrame:
    """(source, ref_id, lanes, phash_quality, hist, blob, tone_quality): the channels of a picture in one row; null where there is none or it failed."""
    good = features.where((F.coalesce("quality", F.lit(0.0)) != FAILED) & F.concat_ws("\n", "channel", "algorithm").isin([f"{c}\n{a}" for c, a in algorithms.items()]))
    last = F.coalesce("computed_at", F.lit("0001-01-01").cast("timestamp"))
    of = lambda c, x: F.max_by(F.when(F.col("channel") == c, F.col(x)), F.when(F.col("channel") == c, last))
    return good.groupBy("source", "ref_id").agg(
        of("phash", "feature").alias("lanes"), of("phash", "quality").alias("phash_quality"), of("color_hist", "feature").alias("hist"),
        of("tone", "feature").alias("blob"), of("tone", "quality").alias("tone_quality"),
    )


def bit_levels(lanes: Column, bits: int) -> Column:
    """A hash as levels of 0 and 255, so that distances of tones are distances of hashes."""
    lane = lambda i: F.get(lanes, F.floor(i / 64).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.getbit(lane(i), (63 - i % 64).cast("int")).cast("int") * 255)


@dataclass
class Matcher:
    """Scenes and records with the features that belong to them; what scoring needs is written once.

    ``mode`` takes a scene's cover, its sprites or both. Thresholds are those
    of near copies by channel; other numbers are operators' own.
    """

    scenes: DataFrame
    jobs: DataFrame
    records: DataFrame
    features: DataFrame
    algorithm: str = "phash"
    size: int = 16
    mode: str = "both"
    near: dict[str, float] = field(default_factory=lambda: {"phash": 0.85, "tone": 0.85})

    def __post_init__(self) -> None:
        features = _wide(self.features, featurize.algorithm_keys(self.algorithm, self.size))
        own = features.where("source = 'extractor_image'").drop("source")
        rows = record_images(self.records).withColumn("ref_id", F.concat_ws(":", "job_id", "ref")).join(own, "ref_id").withColumnsRenamed({"job_id": "job", "result_index": "record"})
        kinds = {"cover": ["stash_cover"], "sprite": ["stash_sprite"], "both": ["stash_cover", "stash_sprite"]}[self.mode]
        scene = F.when(F.col("source") == "stash_cover", F.col("ref_id")).otherwise(F.regexp_extract("ref_id", r"^(.*):\d+$", 1))
        frames = features.where(F.col("source").isin(kinds)).select(scene.alias("scene_id"), F.col("lanes").alias("slanes"), F.col("blob").alias("sblob"))
        whole = features.where("source = 'stash_aggregate'").select(F.col("ref_id").alias("scene_id"), F.col("hist").alias("shist"))
        pool = match.candidate_pool(match.studio_narrow(self.scenes, self.jobs), self.records.select("job_id", "result_index"))
        self.images, self.frames, self.whole, self.pool = materialized_together(rows.drop("ref_id"), frames.join(self.scenes.select("scene_id"), "scene_id", "left_semi"), whole, pool)
        bits = self.size * self.size
        tones = self.images.where("blob IS NOT NULL").select("job", "record", "ref", "blob")
        hashes = self.images.where("lanes IS NOT NULL").select("job", "record", "ref", bit_levels(F.col("lanes"), bits).alias("blob"))
        unique = lambda df, c: corpus.uniqueness(df, threshold=self.near[c]).select("job", "ref", F.col("uniqueness").alias(f"{c}_unique"))
        medians = corpus.median_aggregate(self.images.where("hist IS NOT NULL"), ["job", "record"], "hist")
        self.hists, *unique_ = materialized_together(medians, unique(hashes, "phash"), unique(tones, "tone"))
        numbered = lambda df, *c: df.withColumn("name", F.col("ref")).select("job", F.xxhash64("name").bitwiseAND(F.lit(2**31 - 1)).alias("ref"), "record", *c)
        base = lambda df, c, s: corpus.baseline(df, {f"{c}_baseline": s})
        noise = materialized_together(
            base(numbered(self.images.where("lanes IS NOT NULL"), "lanes"), "phash", sim.guarded_similarity(F.col("lanes"), F.col("lanes2"), bits)),
            base(numbered(tones, "blob"), "tone", sim.tone_similarity(F.col("blob"), F.col("blob2"))),
            base(self.hists.withColumn("ref", F.col("record")), "hist", sim.histogram_intersection(F.col("hist"), F.col("hist2"))),
        )
        jobs = self.images.select("job").distinct()
        for n in noise:
            jobs = jobs.join(n, "job", "left")
        self.noise, self.unique = jobs, unique_[0].join(unique_[1], ["job", "ref"], "full")

    def composite(self, pool: DataFrame) -> DataFrame:
        """(scene_id, job_id, result_index, image, fired) of the pairs of ``pool``; a scene or record without pictures has 0."""
        bits = self.size * self.size
        channels = {c: (f"{c}_m", f"{c}_quality", f"{c}_unique", f"{c}_baseline") for c in ("phash", "tone")}
        pairs = pool.select("scene_id", F.col("job_id").alias("job"), F.col("result_index").alias("record"))
        seen = pairs.join(self.images.drop("hist"), ["job", "record"]).join(self.frames, "scene_id")
        both = lambda a, b, s: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), s)
        hashed = both("lanes", "slanes", sim.guarded_similarity(F.col("slanes"), F.col("lanes"), bits))
        toned = both("blob", "sblob", sim.tone_similarity(F.col("blob"), F.col("sblob")))
        best = seen.groupBy("scene_id", "job", "record", "ref").agg(F.max(hashed).alias("phash_m"), F.max(toned).alias("tone_m"), *[F.first(f"{c}_quality").alias(f"{c}_quality") for c in channels])
        rows = best.join(self.unique, ["job", "ref"], "left").join(self.noise, "job", "left")
        frames = scoring.frame_channels(rows, ["scene_id", "job", "record"], channels)
        colours = pairs.join(self.hists, ["job", "record"]).join(self.whole, "scene_id").join(self.noise.select("job", "hist_baseline"), "job", "left")
        score = scoring.aggregate_channel(sim.histogram_intersection(F.col("shist"), F.col("hist")), sim.gini_quality(F.col("hist")), F.coalesce("hist_baseline", F.lit(scoring.BASELINE)))
        colours = colours.select("scene_id", "job", "record", score.alias("color_hist"))
        got = pairs.join(frames, ["scene_id", "job", "record"], "left").join(colours, ["scene_id", "job", "record"], "left")
        image, fired = scoring.compose({"phash": F.col("phash.score"), "color_hist": F.col("color_hist"), "tone": F.col("tone.score")})
        return got.select("scene_id", F.col("job").alias("job_id"), F.col("record").alias("result_index"), image.alias("image"), fired.alias("fired"))

    def signals(self) -> DataFrame:
        """The pool with code_hit and title_hit."""
        known = self.records.select("job_id", "result_index", F.col("data.id").alias("_id"), F.col("data.title").alias("_title"))
        c = self.pool.join(self.scenes.select("scene_id", "code", "title"), "scene_id").join(known, ["job_id", "result_index"])
        code, title = match.code_fires(F.col("code"), F.col("_id"), F.col("used_filter")), match.title_fires(F.col("title"), F.col("_title"))
        return c.select(*RECORD_KEYS, F.coalesce(code, F.lit(False)).alias("code_hit"), F.coalesce(title, F.lit(False)).alias("title_hit"))

    def candidates(self) -> DataFrame:
        """The pool with all that search() adds up."""
        c = materialized(self.signals().join(self.composite(self.pool), RECORD_KEYS))
        known = self.records.select("job_id", "result_index", "page_url", "data.url", F.col("data.date").alias("_date"), "data.performers")
        c = c.join(self.scenes.select("scene_id", "date", "filename"), "scene_id").join(known, ["job_id", "result_index"])
        c = filename_scores(c.withColumn("_url", F.coalesce(F.nullif("url", F.lit("")), "page_url")), F.col("filename"), F.col("_url"))
        cast = self.scenes.select("scene_id", F.explode("performers").alias("p"))
        people = cast.select(F.col("p.id").alias("performer_id"), "p.name", "p.aliases").dropDuplicates(["performer_id"])
        own = cast.select("scene_id", F.col("p.id").alias("performer_id"))
        names = c.select("scene_id", F.concat_ws("\n", "job_id", "result_index").alias("record_id"), F.explode("performers").alias("name"))
        scores = match.performer_score(own, names, people).select("scene_id", F.split_part("record_id", F.lit("\n"), F.lit(1)).alias("job_id"), F.split_part("record_id", F.lit("\n"), F.lit(2)).cast("long").alias("result_index"), F.col("score").alias("performer"))
        c = c.join(scores, RECORD_KEYS, "left")
        return c.select(*RECORD_KEYS, "code_hit", "title_hit", "image", "fired", tx.date_score(F.col("date"), F.col("_date")).alias("date"), F.col("filename_score").alias("filename"), F.coalesce("performer", F.lit(0.0)).alias("performer"))

    def search(self, limit: int = 5, floor: float | None = None) -> DataFrame:
        """The best records of every scene, as match.search() ranks them."""
        return match.search(self.candidates(), limit, floor)

    def scrape(self, threshold: float = 0.7) -> DataFrame:
        """The definite record of every scene that has one; pictures are compared only where code and title settle nothing."""
        signals = materialized(self.signals())
        settled = signals.where("code_hit OR title_hit").select("scene_id").distinct()
        return match.scrape(signals, self.composite(self.pool.join(settled, "scene_id", "left_anti")), threshold)
