"""Regions around an object: shadow bands, edit regions and subject crops."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import rint_i
from ..scale import attach
from .masks import mask_stats
from .neighbourhood import pixels_of, runs
from .points import points_in_box
from .region_rows import KINDS, pixels, region_rows


def _boxes(mask: DataFrame, keys) -> DataFrame:
    return mask.groupBy(*keys).agg(F.min("x").alias("bx0"), F.min("y").alias("by0"), F.max("x").alias("bx1"), F.max("y").alias("by1"))


def _margin(frac: float) -> Column:
    return rint_i(F.greatest(F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0")) * F.lit(float(frac)))


def shadow_region(mask: DataFrame, images: DataFrame, frac: float = 0.35, up: float = 0.3, down: float = 1.5,
                  keys=("image_id", "mask_id")) -> DataFrame:
    """Mask grown by m = frac x its larger side: m sideways, up*m upwards, down*m downwards, inside the frame."""
    keys = list(keys)
    if frac <= 0:
        return mask.select(*keys, "y", "x")
    m = (_boxes(mask, keys).withColumn("_m", F.greatest(_margin(frac), F.lit(0))).join(images.select("image_id", "width", "height"), "image_id")
         .select(*keys, "_m", rint_i(F.col("_m") * up).alias("_u"), rint_i(F.col("_m") * down).alias("_d"), "width", "height"))
    grown = attach(runs(mask, keys), m, keys).select(
        *keys, F.explode(F.sequence(F.greatest(F.col("y") - F.col("_u"), F.lit(0)), F.least(F.col("y") + F.col("_d"), F.col("height") - 1))).alias("y"),
        F.greatest(F.col("x0") - F.col("_m"), F.lit(0)).alias("x0"), F.least(F.col("x1") + F.col("_m"), F.col("width") - 1).alias("x1"))
    return pixels_of(grown, keys)


def edit_region_rows(mask: DataFrame, images: DataFrame, kind: str, margin: float = 0.35, generative: bool = True,
                     keys=("image_id", "mask_id")) -> DataFrame:
    """Rectangles of what an edit may change: the mask, its shadow band, its box or the whole frame; only a generative filler can use the frame."""
    if kind not in KINDS:
        raise ValueError(f"an edit may change one of {', '.join(KINDS)}, not {kind!r}")
    return region_rows(mask, images, "box" if kind == "full" and not generative else kind, margin, keys=keys)


def edit_region(mask: DataFrame, images: DataFrame, kind: str, margin: float = 0.35, generative: bool = True,
                keys=("image_id", "mask_id")) -> DataFrame:
    """The same as pixels."""
    return pixels(edit_region_rows(mask, images, kind, margin, generative, keys), keys)


def edit_regions(mask: DataFrame, images: DataFrame, kinds: DataFrame, margin: float = 0.35, keys=("image_id", "mask_id")) -> DataFrame:
    """Rectangles, with the kind per mask in a table (keys, kind)."""
    named = attach(mask, kinds.select(*keys, F.col("kind").alias("_of")), list(keys))
    return region_rows(named, images, F.col("_of"), margin, keys=keys)


def subject_crop(pixels: DataFrame, mask: DataFrame, images: DataFrame, margin: float = 0.15, keys=("image_id", "mask_id")) -> DataFrame:
    """Each mask's box with a margin, cut out of the frame and re-based to (0, 0); alpha is 255 on the mask, else 0."""
    keys = list(keys)
    s = mask_stats(mask, images, keys).join(images.select("image_id", "width", "height"), "image_id")
    pad = rint_i(F.greatest(F.col("x1_excl") - F.col("x0"), F.col("y1_excl") - F.col("y0")) * F.lit(margin))
    win = s.withColumn("_pad", pad).select(
        *keys, F.greatest(F.col("x0") - F.col("_pad"), F.lit(0)).alias("wx0"), F.greatest(F.col("y0") - F.col("_pad"), F.lit(0)).alias("wy0"),
        F.least(F.col("x1_excl") + F.col("_pad"), F.col("width")).alias("wx1"), F.least(F.col("y1_excl") + F.col("_pad"), F.col("height")).alias("wy1"))
    return _cut(pixels, mask, win, keys)


def square_crop(pixels: DataFrame, mask: DataFrame, images: DataFrame, ratio: float = 1.2, keys=("image_id", "mask_id")) -> DataFrame:
    """Each mask's box centred in a square of `ratio` times its larger side; positions refer to the square."""
    keys = list(keys)
    s = mask_stats(mask, images, keys)
    w, h = F.col("x1_excl") - F.col("x0"), F.col("y1_excl") - F.col("y0")
    side = (F.greatest(w, h) * F.lit(ratio)).cast("int")
    win = s.select(*keys, F.col("x0").alias("wx0"), F.col("y0").alias("wy0"), F.col("x1_excl").alias("wx1"), F.col("y1_excl").alias("wy1"),
                   side.alias("side"), F.floor((side - w) / 2).cast("int").alias("_ox"), F.floor((side - h) / 2).cast("int").alias("_oy"))
    out = _cut(pixels, mask, win, keys)
    return out.withColumns({"cx": F.col("cx") + F.col("_ox"), "cy": F.col("cy") + F.col("_oy")}).drop("_ox", "_oy")


def _cut(pixels: DataFrame, mask: DataFrame, win: DataFrame, keys) -> DataFrame:
    """Pixels inside one window per mask, re-based to the window."""
    boxes = win.withColumns({"x0": F.col("wx0"), "y0": F.col("wy0"), "x1": F.col("wx1"), "y1": F.col("wy1")})
    inside = points_in_box(pixels, boxes).drop("x0", "y0", "x1", "y1")
    on = mask.select(*keys, "y", "x", F.lit(255).alias("alpha"))
    out = inside.join(on, [*keys, "y", "x"], "left").fillna(0, ["alpha"])
    return out.withColumns({"cy": (F.col("y") - F.col("wy0")).cast("int"), "cx": (F.col("x") - F.col("wx0")).cast("int")}).drop("wx0", "wy0", "wx1", "wy1", "y", "x")


def on_white(crop: DataFrame, channels=("r", "g", "b")) -> DataFrame:
    """Composite a cut-out on white."""
    a = F.col("alpha") / 255
    return crop.withColumns({c: (F.col(c) * a + (F.lit(1.0) - a) * 255).cast("int") for c in channels})


def empty_masks(wanted: DataFrame, mask: DataFrame, keys=("image_id", "mask_id")) -> DataFrame:
    """Error rows for the masks that were asked for but have no pixel, so that no crop came out."""
    seen = mask.select(*keys).distinct()
    return wanted.select(*keys).distinct().join(seen, list(keys), "left_anti").withColumn("error", F.lit("mask is empty"))
