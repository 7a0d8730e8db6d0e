"""Quality of ranked results against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rank_of_expected(results: DataFrame, truth: DataFrame) -> DataFrame:
    """(scene_id, expected, negative, n_results, top_score, rank): 1-based rank of the expected record, null if absent."""
    got = results.join(truth, "scene_id", "right").groupBy("scene_id", "expected", "negative")
    return got.agg(F.count("rank").alias("n_results"), F.max("score").alias("top_score"), F.min(F.when(F.col("record") == F.col("expected"), F.col("rank"))).alias("rank"))


def match_metrics(ranked: DataFrame) -> DataFrame:
    """One row: positives, precision at 1, mean reciprocal rank, mean top score, negatives and how many of them came back empty."""
    pos = ~F.col("negative")
    mean = lambda x: F.coalesce(F.avg(F.when(pos, x)), F.lit(0.0))
    return ranked.agg(
        F.count_if(pos).alias("positives"), mean(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)).alias("precision_at_1"), mean(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"),
        mean(F.coalesce("top_score", F.lit(0.0))).alias("mean_top_score"), F.count_if(F.col("negative")).alias("negatives"), F.count_if(F.col("negative") & (F.col("n_results") == 0)).alias("negatives_empty"),
    )
