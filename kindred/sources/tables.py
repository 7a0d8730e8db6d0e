"""Tables that a job writes once and reads several times."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; a local one only where none is named and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kindred-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialized(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once however often it is read, and still there when executors are lost."""
    return materialized_together(df)[0]


def materialized_together(*frames: DataFrame) -> list[DataFrame]:
    """materialized() for frames that don't need each other, their jobs side by side."""
    spark = frames[0].sparkSession
    paths = [f"{shared_dir(spark)}/kindred-{uuid.uuid4().hex}" for _ in frames]
    _made.extend((spark, p) for p in paths)
    with ThreadPoolExecutor(len(frames)) as pool:
        list(pool.map(lambda f, p: f.write.parquet(p), frames, paths))
    return [spark.read.schema(f.schema).parquet(p) for f, p in zip(frames, paths, strict=True)]


def release() -> None:
    """Delete what materialized() made; only when nothing that reads it is still wanted."""
    while _made:
        spark, path = _made.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may have ended
            return


atexit.register(release)
