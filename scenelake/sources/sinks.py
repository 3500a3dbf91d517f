"""Result tables that can be rewritten per scene, the content-keyed cache, and the export basis."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import attach, settle, skew_join

RESULT_KEYS = ("scene", "pattern", "seg", "material")


def write_result(df: DataFrame, root: str, keys=RESULT_KEYS, rows_per_task: int = 1_000_000) -> None:
    """Write partitioned by `keys`; a rerun replaces the partitions it produces and leaves the others.

    A scene is written by as many tasks as its row count asks for; rows go to them by their hash.
    """
    tasks = df.groupBy(*keys).agg(F.ceil(F.count("*") / rows_per_task).cast("int").alias("_tasks"))
    spread = attach(df, tasks, list(keys)).repartition(*keys, F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys]), F.col("_tasks"))).drop("_tasks")
    (spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(root))


def content_key(content: Column) -> Column:
    return F.substring(F.sha1(content), 1, 16)


def cache_key(kind: str, key: Column, *params) -> Column:
    """<kind>_<content key>_<parameters>, the name under which a result is kept."""
    return F.concat_ws("_", F.lit(kind), key, *[p if isinstance(p, Column) else F.lit(str(p)) for p in params])


def compute_missing(keyed: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """Results for the keys of `keyed` that the cache lacks, one row a key."""
    misses = keyed.dropDuplicates(["cache_key"]).join(cache.select("cache_key"), "cache_key", "left_anti")
    return compute(misses).select(*columns)


def incremental(df: DataFrame, cache: DataFrame, key: Column, compute: Callable[[DataFrame], DataFrame],
                ) -> tuple[DataFrame, DataFrame]:
    """Rows of `df` with their results, and the new cache rows to append.

    Results are computed once per distinct key that the cache lacks, however many rows share it, and then joined back
    with hot keys salted. `compute` gets one row per missing key and returns `cache_key` plus the result columns.
    """
    keyed = df.withColumn("cache_key", key)
    fresh = settle(compute_missing(keyed, cache, compute, cache.columns), "fresh")
    known = cache.withColumn("cached", F.lit(True)).unionByName(fresh.withColumn("cached", F.lit(False)))
    return skew_join(keyed, known, ["cache_key"]), fresh


def to_yup(df: DataFrame, x="x", y="y", z="z") -> DataFrame:
    """Z-up to the Y-up basis of exchange formats: (x, z, -y)."""
    return df.withColumns({x: F.col(x), y: F.col(z), z: -F.col(y)})
