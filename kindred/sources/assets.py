"""Tables and binary assets: records, images, sprite sheets, and covers for output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def decode_records(records: DataFrame, schema: str) -> DataFrame:
    """data as a struct; what can't be read gives a struct of nulls."""
    return records.withColumn("data", F.coalesce(F.from_json("data", schema), F.from_json(F.lit("{}"), schema)))


def completed_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'completed'")


def binary_assets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def decoded_images(spark: SparkSession, path: str | list[str], *, broken: bool = False) -> DataFrame:
    """(path, height, width, channels, pixels in rows of blue, green, red); files that are no images are left out, or have null pixels if ``broken`` are wanted."""
    i = spark.read.format("image").option("dropInvalid", not broken).load(path)
    got = i.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").toDF("path", "height", "width", "channels", "pixels")
    return got.withColumns({"path": asset_key(F.col("path")), "pixels": F.when(F.col("height") > 0, F.col("pixels"))})


def asset_key(path: Column) -> Column:
    """A path as the readers of files name it, without a scheme for local files."""
    return F.regexp_replace(path, "^file:/+", "/")


def vtt_cues(texts: DataFrame) -> DataFrame:
    """(ref, position, start, left, top, width, height) of the sprite cues in (ref, vtt) rows; a VTT may come as a base64 data url.

    A line with an arrow sets the time, or forgets it where its start is not
    hours:minutes:seconds. Any other line with a box gives a cue if the box is
    four whole numbers and nothing else up to the line's end, and a time is
    known. Other lines are skipped.
    """
    data = F.regexp_extract("vtt", r"^data:text/vtt;base64,(.*)$", 1)
    vtt = F.when(data != "", F.decode(F.try_to_binary(data, F.lit("base64")), "UTF-8")).otherwise(F.col("vtt"))
    lines = texts.select("ref", F.posexplode(F.split(vtt, r"\n")).alias("line", "t"))
    stamp = r"^\s*(\d+)\s*:\s*(\d+)\s*:\s*(\d+\.?\d*|\.\d+)\s*(?::.*?)?-->"
    at = lambda i: F.regexp_extract("t", stamp, i)
    start = F.when(at(1) != "", at(1).cast("int") * 3600 + at(2).cast("int") * 60 + at(3).cast("double"))
    arrow = F.contains(F.col("t"), F.lit("-->"))
    seen = lines.withColumn("start", F.last(F.when(arrow, F.struct(start.alias("start"))), ignorenulls=True).over(Window.partitionBy("ref").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))["start"])
    number = r"\s*([-+]?\d+)\s*"
    boxed = f"^(?:(?!xywh=).)*xywh={number},{number},{number},{number}(?:xywh=.*)?$"
    box = lambda i: F.regexp_extract("t", boxed, i).cast("int")
    cues = seen.where(~arrow & F.col("t").rlike(boxed) & F.col("start").isNotNull())
    return cues.select("ref", (F.row_number().over(Window.partitionBy("ref").orderBy("line")) - 1).alias("position"), "start", *[box(i).alias(n) for i, n in enumerate(("left", "top", "width", "height"), 1)])


def data_url(name: Column, content: Column) -> Column:
    kind = F.when(F.endswith(F.lower(name), F.lit(".png")), "png").when(F.endswith(F.lower(name), F.lit(".gif")), "gif").when(F.endswith(F.lower(name), F.lit(".webp")), "webp").otherwise("jpeg")
    return F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"[\r\n]", ""))


def lookup(requests: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``requests`` (key, ...) with the row of ``table`` as found, a struct; null where no row has the key, or the key is null. Of several rows the smallest counts."""
    columns = [c for c in table.columns if c != key]
    rows = table.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*columns)).alias("found"))
    return requests.join(rows, key, "left")


def write_run_log(rows: DataFrame, path: str, meta: dict[str, str]) -> None:
    """A line of metadata and a line for each row, as JSON lines in a folder; one write, so that a crash leaves no half a log."""
    pairs = F.create_map(*[F.lit(x) for kv in meta.items() for x in kv]) if meta else F.create_map()
    first = rows.sparkSession.range(1).select(F.to_json(F.struct(pairs.alias("meta"))).alias("value"))
    first.union(rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))).write.mode("overwrite").text(path)
