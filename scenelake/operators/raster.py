"""Block operators on rasters held as one row per pixel."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import floor_div, u8_round


def explode_raster(rows: DataFrame, array: str, keep: list[str], value: str = "v") -> DataFrame:
    """One row per array element with its position as x; the row itself is one raster line."""
    return rows.select(*keep, F.posexplode(array).alias("x", "_v")).select(
        *keep, "x", F.col("_v").cast("double").alias(value))


def _whole_blocks(f: int, width, height) -> Column:
    """True inside the part of the frame that is a multiple of f in both directions."""
    return (F.col("y") < height - height % f) & (F.col("x") < width - width % f)


def _dim(size) -> Column:
    return F.col(size) if isinstance(size, str) else F.lit(size)


def block_mean(pixels: DataFrame, f: int, channels: list[str], width, height, keys=("image_id",), white: float = 1.0) -> DataFrame:
    """Mean of each f x f block; a ragged right or bottom edge is cut off first. `<c>_u8` is the 8-bit form.

    `white` is the value of a full channel: 1 for floats, 255 for 8-bit frames.
    """
    inside = pixels.where(_whole_blocks(f, _dim(width), _dim(height)))
    block = [floor_div("y", F.lit(f)).alias("y"), floor_div("x", F.lit(f)).alias("x")]
    means = inside.groupBy(*keys, *block).agg(*[F.avg(c).alias(c) for c in channels])
    return means.select(*keys, "y", "x", *channels, *[u8_round(c, white).alias(f"{c}_u8") for c in channels])


def block_any(mask: DataFrame, f: int, width, height, keys=("image_id", "mask_id")) -> DataFrame:
    """A block is on when any of its pixels is on."""
    inside = mask.where(_whole_blocks(f, _dim(width), _dim(height)))
    return inside.select(*keys, floor_div("y", F.lit(f)).alias("y"), floor_div("x", F.lit(f)).alias("x")).distinct()


def upsample_nearest(low: DataFrame, f: int, keep: list[str]) -> DataFrame:
    """Each pixel becomes an f x f block."""
    steps = F.sequence(F.lit(0), F.lit(f - 1))
    return (low.withColumn("_dy", F.explode(steps)).withColumn("_dx", F.explode(steps))
            .select(*[c for c in keep if c not in ("y", "x")],
                    (F.col("y") * f + F.col("_dy")).cast("int").alias("y"),
                    (F.col("x") * f + F.col("_dx")).cast("int").alias("x")))


def frame_pixels(images: DataFrame, keep=("image_id",)) -> DataFrame:
    """All (y, x) of each frame. Lines are spread over the cluster before they are expanded to pixels."""
    lines = images.select(*keep, "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    return (lines.repartition(*keep, "y")
            .select(*keep, F.col("y").cast("int").alias("y"),
                    F.explode(F.sequence(F.lit(0), F.col("width").cast("int") - 1)).alias("x")))
