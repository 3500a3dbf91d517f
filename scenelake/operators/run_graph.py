"""Masks as runs, and the graph of runs that touch.

A run is a row (keys, y0, y1, x0, x1): one stretch of one line, or a slab of whole lines that hold nothing else. The complement of
runs is runs again, so neither side of a mask is ever spelled out in pixels: what is shuffled follows the outline of a
mask, not its area or its frame's. Runs that touch are joined inside bands of lines, a bounded group; only
pairs of labels that meet across two bands go on to further rounds.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import floor_div
from ..scale import attach, settle, settled
from .components import KEYS, _stars
from .neighbourhood import close, rect, runs

BAND = 256
RUN = ("y0", "y1", "x0", "x1")


def as_runs(mask: DataFrame, keys=KEYS) -> DataFrame:
    """The runs of a pixel mask."""
    r = runs(mask, keys)
    return r.select(*keys, *[F.col(c).cast("int").alias(n) for c, n in (("y", "y0"), ("y", "y1"), ("x0", "x0"), ("x1", "x1"))])


def run_pixels(of: DataFrame, keys=KEYS) -> DataFrame:
    """Pixels of runs that don't overlap; lines are spread out before they become pixels."""
    lines = of.select(*keys, "x0", "x1", F.explode(F.sequence("y0", "y1")).alias("y"))
    return lines.select(*keys, "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def background_runs(of: DataFrame, images: DataFrame, keys=KEYS, band: int = BAND) -> DataFrame:
    """The runs of each mask's frame that `of`, runs of single lines, leave free; `edge` marks those at the frame's border.

    The gaps of a line lie between neighbouring runs of it. Lines without any run form slabs between neighbouring lines that have some;
    a slab is cut at the borders of bands.
    """
    keys = list(keys)
    framed = attach(of, images.select("image_id", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height")), ["image_id"])
    line = Window.partitionBy(*keys, "y0").orderBy("x0")
    here = framed.withColumns({"_from": F.coalesce(F.lag("x1").over(line) + 1, F.lit(0)), "_last": F.lead("x0").over(line).isNull()})
    gap = lambda y0, y1, x0, x1: F.struct(*[v.cast("int").alias(n) for n, v in zip(RUN, (y0, y1, x0, x1))])
    y = F.col("y0")
    gaps = here.select(*keys, "width", "height", F.explode(F.array(
        gap(y, y, F.col("_from"), F.col("x0") - 1), F.when(F.col("_last"), gap(y, y, F.col("x1") + 1, F.col("width") - 1)))).alias("g")).where("g.x0 <= g.x1")
    mask = Window.partitionBy(*keys).orderBy("y0")
    lines = framed.groupBy(*keys, "y0").agg(F.first("width").alias("width"), F.first("height").alias("height"))
    lines = lines.withColumns({"_from": F.coalesce(F.lag("y0").over(mask) + 1, F.lit(0)), "_last": F.lead("y0").over(mask).isNull()})
    whole = lines.select(*keys, "width", "height", F.explode(F.array(
        gap(F.col("_from"), y - 1, F.lit(0), F.col("width") - 1), F.when(F.col("_last"), gap(y + 1, F.col("height") - 1, F.lit(0), F.col("width") - 1)))).alias("g")).where("g.y0 <= g.y1")
    cut = whole.withColumn("b", F.explode(F.sequence(floor_div("g.y0", F.lit(band)), floor_div("g.y1", F.lit(band)))))
    cut = cut.select(*keys, "width", "height", gap(F.greatest("g.y0", F.col("b") * band), F.least("g.y1", F.col("b") * band + band - 1), F.col("g.x0"), F.col("g.x1")).alias("g"))
    edge = (F.col("x0") == 0) | (F.col("y0") == 0) | (F.col("x1") == F.col("width") - 1) | (F.col("y1") == F.col("height") - 1)
    return gaps.unionByName(cut).select(*keys, "width", "height", "g.*").select(*keys, *RUN, edge.alias("edge"))


def _band_labeller(conn: int):
    """The function that labels the runs of one band. It is self-contained, so workers need not have this package installed."""
    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y0", "x0"], ignore_index=True)
        y0, y1, x0, x1 = (pdf[c].to_numpy().astype(np.int64) for c in ("y0", "y1", "x0", "x1"))
        reach, wide = (1 if conn == 8 else 0), int(x1.max()) + 4
        lo = np.searchsorted(y0 * wide + x1, (y1 + 1) * wide + x0 - reach, "left")
        hi = np.searchsorted(y0 * wide + x0, (y1 + 1) * wide + x1 + reach, "right")
        n = np.maximum(hi - lo, 0)
        above = np.repeat(np.arange(len(y0)), n)
        below = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        first = np.arange(len(y0))
        while (first[above] != first[below]).any():
            least = np.minimum(first[above], first[below])
            for side in (above, below):
                np.minimum.at(first, first[side], least)
            while (first[first] != first).any():
                first = first[first]
        return pdf.drop(columns="_band").assign(label=(y0 * (1 << 32) + x0)[first])
    return label


def label_runs(of: DataFrame, conn: int = 8, keys=KEYS, band: int = BAND) -> DataFrame:
    """Adds `label`: (y, x) of the first pixel of the component a run belongs to, as one number. The result is settled.

    No run may reach over the border of a band, and runs may not overlap.
    """
    keys = list(keys)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in of.schema.fields)
    local = of.withColumn("_band", floor_div("y0", F.lit(band))).groupBy(*keys, "_band").applyInPandas(_band_labeller(conn), f"{kinds}, label bigint")
    local = settle(local, "bands")
    edges = _across_bands(local, conn, keys, band)
    if not settled(edges)["rows"]:
        return local
    roots = _stars(edges, keys)
    return settle(attach(local, roots, [*keys, "label"], "left").withColumn("label", F.coalesce("root", "label")).drop("root"), "labels")


def _across_bands(local: DataFrame, conn: int, keys: list[str], band: int) -> DataFrame:
    """Pairs (u, v) of labels of runs that touch across the border of two bands.

    The runs above and below a border are swept together from left to right. Runs of one side don't overlap, so a run can only touch the last one of
    the other side that began before it, or runs that begin later and then find it as their last: no pairs of a line are tried.
    """
    reach = 1 if conn == 8 else 0
    above = local.where((F.col("y1") + 1) % band == 0).select(*keys, (F.col("y1") + 1).alias("line"), F.lit(0).alias("side"), "x0", "x1", "label")
    below = local.where((F.col("y0") % band == 0) & (F.col("y0") > 0)).select(*keys, F.col("y0").alias("line"), F.lit(1).alias("side"), (F.col("x0") - reach).alias("x0"), (F.col("x1") + reach).alias("x1"), "label")
    before = Window.partitionBy(*keys, "line").orderBy("x0", "side").rowsBetween(Window.unboundedPreceding, -1)
    met = lambda s: F.last(F.when(F.col("side") == s, F.struct("x1", "label")), ignorenulls=True).over(before)
    swept = above.unionByName(below).withColumn("o", F.when(F.col("side") == 0, met(1)).otherwise(met(0)))
    touching = swept.where((F.col("o.x1") >= F.col("x0")) & (F.col("o.label") != F.col("label")))
    return settle(touching.select(*keys, F.col("label").alias("u"), F.col("o.label").alias("v")).distinct(), "edges")


def hole_runs(of: DataFrame, images: DataFrame, mode: str = "border", keys=KEYS, band: int = BAND) -> DataFrame:
    """The background runs of single-line runs `of` that no path of 4 neighbours leads to from the outside."""
    keys = list(keys)
    free = label_runs(background_runs(of, images, keys, band), 4, keys, band)
    outside = free.where(F.col("edge") if mode == "border" else F.col("label") == 0).select(*keys, "label").distinct()
    return attach(free, outside, [*keys, "label"], "left_anti").select(*keys, *RUN)


def fill_holes(mask: DataFrame, images: DataFrame, mode: str = "border", keys=KEYS, band: int = BAND) -> DataFrame:
    """Mask plus every background pixel that is not 4-connected to the outside.

    `border` floods from the whole frame border. `corner` floods from pixel (0, 0) alone: a background pocket cut off
    from it is filled even at another border, and if (0, 0) is in the mask everything is.
    """
    keys = list(keys)
    pixels = mask.select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))
    return pixels.unionByName(run_pixels(hole_runs(as_runs(mask, keys), images, mode, keys, band), keys))


def run_stats(labelled: DataFrame, keys=KEYS) -> DataFrame:
    """Area and box of each component."""
    area = (F.col("x1") - F.col("x0") + 1).cast("bigint") * (F.col("y1") - F.col("y0") + 1)
    return labelled.groupBy(*keys, "label").agg(F.sum(area).alias("area"), *[f(c).alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))])


def component_under(labelled: DataFrame, points: DataFrame, keys=KEYS) -> DataFrame:
    """Runs of the component under the point (keys, py, px) of each mask, or of the largest one (the first in raster order
    among equals) if the point lies outside or is not given."""
    keys = list(keys)
    best = run_stats(labelled, keys).groupBy(*keys).agg(F.max(F.struct("area", (-F.col("label")).alias("neg"))).alias("b"))
    at = points.select(*keys, F.col("py").alias("y0"), "px")
    hit = labelled.join(at, [*keys, "y0"]).where("px between x0 and x1").groupBy(*keys).agg(F.min("label").alias("_hit"))
    chosen = best.join(hit, keys, "left").select(*keys, F.coalesce("_hit", -F.col("b.neg")).alias("label"))
    return attach(labelled, chosen, [*keys, "label"], "left_semi")


def clean_mask(mask: DataFrame, points: DataFrame, images: DataFrame, close_px: int = 7, width=None, height=None,
               mode: str = "corner", keys=KEYS, band: int = BAND) -> DataFrame:
    """Close gaps, keep the component under the point (or the largest), fill its holes; runs from the closing to the end."""
    keys = list(keys)
    closed = close(mask, rect(close_px, close_px), width, height, keys)
    kept = component_under(label_runs(as_runs(closed, keys), 8, keys, band), points, keys).select(*keys, *RUN)
    return run_pixels(kept.unionByName(hole_runs(kept, images, mode, keys, band)), keys)
