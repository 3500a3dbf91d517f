"""Filling a hole without a model."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import attach, settle
from .frames import PIXEL, RGB
from .neighbourhood import normalised_convolution


def fill_from_background(pixels: DataFrame, hole: DataFrame, sigma: float, width, height) -> DataFrame:
    """Hole pixels become the weighted mean of the known pixels around them, frames being mirrored at their border; all other pixels stay.

    Where the hole is wider than the kernel no known pixel is near, and the mean colour of the frame's known pixels is used.
    """
    marked = pixels.select(*PIXEL, *RGB).join(hole.select(*PIXEL, F.lit(True).alias("_hole")).distinct(), PIXEL, "left")
    marked = settle(marked.withColumn("_known", F.col("_hole").isNull()), "marked")
    near = normalised_convolution(marked, "_known", list(RGB), sigma, width=width, height=height)
    frame = marked.where("_known").groupBy("image_id").agg(*[F.avg(c).alias(f"_m{c}") for c in RGB])
    j = marked.join(near.select(*PIXEL, "confidence", *[F.col(c).alias(f"_f{c}") for c in RGB]), PIXEL)
    j = attach(j, frame, ["image_id"], "left")
    filled = {c: F.when(F.col("_known"), F.col(c)).when(F.col("confidence") > 1e-4, F.col(f"_f{c}")).otherwise(F.col(f"_m{c}")) for c in RGB}
    # the hair keeps a mean of equal whole numbers from being truncated to the number below
    return j.select(*PIXEL, *[(F.coalesce(e, F.lit(0)) + 1e-6).cast("int").alias(c) for c, e in filled.items()])
