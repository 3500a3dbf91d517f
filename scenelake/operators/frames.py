"""Frames as pixel tables: differences, compositing, pasting and audits."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import rint_i
from ..scale import GROUP_ROWS, attach, hot_keys, hot_metric, settle, settled, skew_join
from .region_rows import RECT, outside

RGB = ("r", "g", "b")
PIXEL = ["image_id", "y", "x"]


def _other(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*PIXEL, *[F.col(c).alias(f"{prefix}{c}") for c in RGB])


def _change() -> Column:
    return F.greatest(*[F.abs(F.col(c) - F.col(f"_{c}")) for c in RGB])


def pixel_diff(a: DataFrame, b: DataFrame, thr: int = 2) -> DataFrame:
    """Pixels whose largest channel difference exceeds thr."""
    return a.join(_other(b, "_"), PIXEL).where(_change() > thr).select(*PIXEL, _change().alias("diff"))


def _over(o: Column, e: Column, a: Column) -> Column:
    """e over o with weight a, kept in 0..255 and truncated."""
    return F.least(F.greatest(o + (e - o) * a, F.lit(0.0)), F.lit(255.0)).cast("int")


def composite(base: DataFrame, edit: DataFrame, alpha: DataFrame) -> DataFrame:
    """Put `edit` on `base` with a per-pixel alpha; no edit or no alpha leaves the pixel alone."""
    top = _other(edit, "_").join(alpha.select(*PIXEL, "alpha"), PIXEL)
    j = base.select(*PIXEL, *RGB).join(top, PIXEL, "left")
    a = F.coalesce("alpha", F.lit(0.0))
    return j.select(*PIXEL, *[_over(F.col(c), F.coalesce(F.col(f"_{c}"), F.col(c)), a).alias(c) for c in RGB])


def containment_audit(before: DataFrame, after: DataFrame, region: DataFrame) -> DataFrame:
    """Pixels outside the region that are not identical; a pixel that only one frame has counts as changed.

    The region is a pixel table or rectangles (image_id, y0, y1, x0, x1), which are never spelled out.
    """
    j = before.select(*PIXEL, *RGB).join(_other(after, "_"), PIXEL, "full")
    same = F.lit(True)
    for c in RGB:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    changed = j.where(~same).select(*PIXEL)
    return outside(changed, region) if set(RECT) <= set(region.columns) else changed.join(region.select(*PIXEL), PIXEL, "left_anti")


def checked_moves(moves: DataFrame, masks: DataFrame, images: DataFrame, hot_rows: int = GROUP_ROWS) -> DataFrame:
    """`moves` (image_id, mask_id, …) with `error`: which reference leads nowhere, or null where the move can be made.

    Moves are written once, with their frequent and null ids sketched, and keep their number through both joins.
    """
    pair = ["image_id", "mask_id"]
    once = settle(moves, "moves", image=hot_metric(["image_id"]), mask=hot_metric(pair))
    hot = {c: hot_keys(settled(once)[c], hot_rows) for c in ("image", "mask")}
    numbered = once.withColumn("_move", F.monotonically_increasing_id())
    both = skew_join(numbered, images.select("image_id", F.lit(True).alias("_image")).distinct(), ["image_id"], "left", hot_rows, hot=hot["image"], row="_move")
    both = skew_join(both, masks.select(*pair, F.lit(True).alias("_mask")).distinct(), pair, "left", hot_rows, hot=hot["mask"], row="_move")
    error = F.when(F.col("_image").isNull(), "unknown image").when(F.col("_mask").isNull(), "unknown or empty mask")
    return both.select(*moves.columns, error.alias("error"))


def affine_paste(source: DataFrame, masks: DataFrame, moves: DataFrame, images: DataFrame) -> DataFrame:
    """Footprint of each moved object: target pixels with the colour of the source pixel they come from.

    A target pixel is mapped back (scale about the anchor, then shift) and takes the nearest source pixel if that is in
    the mask. Only the target box of an object is enumerated, line by line, and the lines are spread before they are
    expanded to pixels.
    """
    box = masks.groupBy("image_id", "mask_id").agg(F.min("x").alias("bx0"), F.min("y").alias("by0"), F.max("x").alias("bx1"), F.max("y").alias("by1"))
    m = attach(moves, box, ["image_id", "mask_id"]).join(images.select("image_id", "width", "height"), "image_id")
    s = F.col("scale")

    def reach(dst, src, lo, hi, size):
        first = F.floor(F.col(dst) + (F.col(lo) - F.col(src)) * s - s - 1)
        last = F.ceil(F.col(dst) + (F.col(hi) - F.col(src)) * s + s + 1)
        return F.greatest(first, F.lit(0)).cast("int"), F.least(last, F.col(size) - 1).cast("int")
    (ya, yb), (xa, xb) = reach("dst_y", "src_y", "by0", "by1", "height"), reach("dst_x", "src_x", "bx0", "bx1", "width")
    m = m.withColumns({"_ya": ya, "_yb": yb, "_xa": xa, "_xb": xb}).where("_ya <= _yb and _xa <= _xb")
    lines = m.withColumn("y", F.explode(F.sequence("_ya", "_yb"))).repartition("image_id", "move_idx", "y")
    target = lines.withColumn("x", F.explode(F.sequence("_xa", "_xb"))).select(
        "image_id", "move_idx", "mask_id", "y", "x",
        rint_i((F.col("y") - F.col("dst_y")) / s + F.col("src_y")).alias("_sy"), rint_i((F.col("x") - F.col("dst_x")) / s + F.col("src_x")).alias("_sx"))
    on = masks.select("image_id", "mask_id", F.col("y").alias("_sy"), F.col("x").alias("_sx"))
    hit = target.join(on, ["image_id", "mask_id", "_sy", "_sx"], "left_semi")
    colours = source.select("image_id", F.col("y").alias("_sy"), F.col("x").alias("_sx"), *RGB)
    return hit.join(colours, ["image_id", "_sy", "_sx"]).select("image_id", "move_idx", "y", "x", *RGB)


def layer_fold(background: DataFrame, layers: DataFrame, order: str = "move_idx", opaque: bool = False, at_once: int = 1000) -> DataFrame:
    """Layers put on the background in order; later layers see earlier ones and every step is quantised.

    Opaque layers only need the last one per pixel. Otherwise the layers of a pixel are folded in order. Where a pixel has more than
    `at_once` of them they are numbered per pixel and folded in rounds, each with the next `at_once` of every pixel; the values of the
    order column don't matter.
    """
    if opaque:
        last = layers.groupBy(*PIXEL).agg(F.max(F.struct(order, *RGB)).alias("l"))
        j = background.select(*PIXEL, *RGB).join(last, PIXEL, "left")
        return j.select(*PIXEL, *[F.coalesce(F.col(f"l.{c}"), F.col(c)).cast("int").alias(c) for c in RGB])
    first, last = layers.agg(F.min(order), F.max(order)).first()
    if first is None or last - first < at_once:          # a layer covers a pixel once, so no stack is deeper
        return _fold(background, layers, order)
    nth = F.floor((F.row_number().over(Window.partitionBy(*PIXEL).orderBy(order)) - 1) / at_once)
    numbered = settle(layers.withColumn("_round", nth), "layers", rounds=F.max("_round"))
    for k in range(settled(numbered)["rounds"] + 1):
        part = numbered.where(F.col("_round") == k).drop("_round")
        background = settle(_fold(background, part, order), "folded") if settled(numbered)["rounds"] else _fold(background, part, order)
    return background


def _fold(background: DataFrame, layers: DataFrame, order: str) -> DataFrame:
    stack = layers.groupBy(*PIXEL).agg(F.sort_array(F.collect_list(F.struct(order, "alpha", *RGB))).alias("_l"))
    j = background.select(*PIXEL, *[F.col(c).cast("int").alias(c) for c in RGB]).join(stack, PIXEL, "left")
    start = F.struct(*[F.col(c).alias(c) for c in RGB])
    folded = F.aggregate(F.coalesce("_l", F.array()), start,
                         lambda acc, e: F.struct(*[_over(acc[c].cast("double"), e[c].cast("double"), e["alpha"]).alias(c) for c in RGB]))
    return j.withColumn("_f", folded).select(*PIXEL, *[F.col(f"_f.{c}").alias(c) for c in RGB])
