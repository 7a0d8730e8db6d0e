"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, secret scans, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. A stage's result is written as
Parquet and read again as the next one's docs. Rows of equal ids and texts are
one document; null texts pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import decontaminate, mixing, neardup, secretscan, toxicity
from kindred.llm.common import release, remainder, table, tidy, written, written_so_far

#: SQL can't express the models and sketches; tests hold the stages against brute force.
ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    return toxicity.drop_toxic(docs, labels)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that is near a benchmark item."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking secrets cut out of their texts."""
    return secretscan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their places in the mixture of sources."""
    return mixing.mix(docs)


_last: list = []  # inner tables of the stage before


def _stage(work):
    """The stage, which first deletes the inner tables of the stage before and tidies the driver: that stage's result is written by now, unless docs still read its tables."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = " ".join(docs.inputFiles())
        release([t for t in _last if t[1].rpartition("/")[2] not in read])
        tidy(spark)
        before = written_so_far()
        out = work(spark, docs, sf_dir)
        # what the last stage made stays: run() returns its result unread
        _last[:] = [t for t in written_so_far() if t not in before and work is not mixture]
        return out

    return run_stage


STAGES = [
    ("toxicity", _stage(toxic)),
    ("near_duplicates", _stage(near_copies)),
    ("decontamination", _stage(benchmark_leaks)),
    ("secrets", _stage(secrets)),
    ("mixing", _stage(mixture)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
