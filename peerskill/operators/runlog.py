"""Run-log analysis (A-38, A-39, A-40) over the exploded run-log table of
``sources.io.read_run_logs`` (one row per run and stage)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# FIXED VALUES: the five stage names a complete run must contain.
EXPECTED_STAGES = ["data_collection", "preprocessing", "feature_engineering", "model_inference",
                   "recommendation_generation"]


def stage_averages(stages: DataFrame) -> DataFrame:
    """A-38: per stage mean seconds, mean MB over non-null values, run count."""
    return stages.groupBy("stage").agg(
        F.avg("execution_time_seconds").alias("avg_seconds"),
        F.avg("memory_usage_mb").alias("avg_mb"),
        F.count_distinct("run_idx").alias("runs"))


def run_summary(stages: DataFrame) -> DataFrame:
    """A-39: per run total seconds, total MB (null when 0), stage count, slowest stage."""
    return stages.groupBy("run_idx").agg(
        F.sum("execution_time_seconds").alias("total_seconds"),
        F.sum("memory_usage_mb").alias("_mb"),
        F.count(F.lit(1)).alias("n_stages"),
        F.max_by("stage", F.struct("execution_time_seconds", "stage")).alias("slowest_stage"),
    ).withColumn("total_mb", F.when(F.col("_mb") != 0, F.col("_mb"))).drop("_mb")


def validate_runs(stages: DataFrame, expected: list[str] = EXPECTED_STAGES) -> DataFrame:
    """A-40: issue rows - expected stages missing from a run (expected x runs
    anti-joined with the present ones), non-positive times, negative memory."""
    runs = stages.select("run_idx").distinct()
    exp = runs.withColumn("stage", F.explode(F.array(*[F.lit(s) for s in expected])))
    missing = exp.join(stages.select("run_idx", "stage"), ["run_idx", "stage"], "left_anti").select(
        "run_idx", "stage", F.lit("missing_stage").alias("issue"))
    bad_time = stages.filter(~(F.col("execution_time_seconds") > 0)).select(
        "run_idx", "stage", F.lit("non_positive_time").alias("issue"))
    bad_mem = stages.filter(F.col("memory_usage_mb") < 0).select(
        "run_idx", "stage", F.lit("negative_memory").alias("issue"))
    return missing.unionByName(bad_time).unionByName(bad_mem)
