"""Reports over stage rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.runs import normalise_stage_name, stage_seconds


def stage_facts(stages: DataFrame) -> DataFrame:
    """Undo the drift of the stage log: one time column and one name per stage."""
    return (stages.withColumn("seconds", stage_seconds()).withColumn("stage", normalise_stage_name(F.col("stage")))
            .drop("time_s", "gen_s"))


def run_totals(facts: DataFrame, run="run_id") -> DataFrame:
    return facts.groupBy(run).agg(F.count("*").alias("n_stages"), F.bround(F.sum("seconds"), 2).alias("total_s"))


def stage_profile(facts: DataFrame, by=("stage", "cached")) -> DataFrame:
    """Count, total, mean and longest time by stage and whether it was cached, with subtotals and an overall row.

    `by` may name other columns, such as kind, stage, model, cached. Facts with gpu_peak_gb also give the peak memory, which
    is null where no stage reports it.
    """
    peak = [F.max("gpu_peak_gb").alias("gpu_peak_gb")] if "gpu_peak_gb" in facts.columns else []
    return facts.rollup(*by).agg(
        F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum("seconds").alias("total_s"),
        F.avg("seconds").alias("mean_s"), F.max("seconds").alias("max_s"), *peak)


def cold_cached_ratio(facts: DataFrame) -> DataFrame:
    """How many times longer a cold stage takes than a cached one."""
    means = facts.groupBy("stage").agg(F.avg(F.when(~F.col("cached"), F.col("seconds"))).alias("cold_s"),
                                       F.avg(F.when(F.col("cached"), F.col("seconds"))).alias("cached_s"))
    return means.withColumn("ratio", F.col("cold_s") / F.greatest("cached_s", F.lit(1e-9)))


def run_report(facts: DataFrame) -> DataFrame:
    """Per run: totals, time spent on cold stages, and the longest stage."""
    return facts.groupBy("run_id").agg(
        F.count("*").alias("n_stages"), F.sum("seconds").alias("total_s"),
        F.sum(F.when(F.col("cached"), F.lit(0.0)).otherwise(F.col("seconds"))).alias("cold_s"),
        F.max(F.struct("seconds", "stage")).alias("m")).select(
        "run_id", "n_stages", "total_s", "cold_s", F.col("m.stage").alias("longest_stage"))
