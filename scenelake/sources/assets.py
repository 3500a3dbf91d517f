"""Uploaded files: listing, working copy and the check for missing requirements."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scale import skew_join
from .runs import basename, stem

MAX_UPLOAD_MB = 20


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path and length of every file below `root`; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
            .load(root).select("path", "length", "modificationTime"))


def asset_inventory(listing: DataFrame, max_mb: int = MAX_UPLOAD_MB) -> DataFrame:
    """One row per asset: a cleaned copy, where there is one, is the working file.

    Both files of an asset meet in one aggregate, which needs one shuffle and no self join.
    """
    name = stem(F.col("path"))
    files = listing.select(
        "path", "length", F.regexp_replace(name, "_clean$", "").alias("asset_id"), name.endswith("_clean").alias("is_clean"),
        F.element_at(F.split("path", r"[\\/]"), -2).alias("kind"), F.lower(F.element_at(F.split(basename(F.col("path")), r"\."), -1)).alias("ext"))
    one = files.groupBy("kind", "asset_id").agg(
        F.min(F.when(~F.col("is_clean"), F.struct("path", "length", "ext"))).alias("o"),
        F.min(F.when(F.col("is_clean"), F.col("path"))).alias("clean_path"))
    return one.select("kind", "asset_id", F.coalesce("clean_path", "o.path").alias("path"), F.col("o.path").alias("original_path"),
                      F.col("o.ext").alias("ext"), F.col("o.length").alias("size"), F.col("clean_path").isNotNull().alias("precleaned"),
                      (F.col("o.length") > max_mb * 1024 * 1024).alias("too_large"))


def missing_assets(requirements: DataFrame, inventory: DataFrame, wanted: list[str], marker: str = "marker") -> DataFrame:
    """Requirements of the wanted pipelines whose marker file is not there."""
    needed = requirements.where(F.arrays_overlap("tags", F.array(*[F.lit(w) for w in wanted])))
    return skew_join(needed, inventory.select(marker).distinct(), [marker], "left_anti")
