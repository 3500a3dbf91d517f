"""Connected components of masks, and what is built on them.

Pixels are grouped by tile, so a group holds at most tile x tile rows whatever the size of a frame or of a component.
Labels are found inside each tile; only pairs of labels that touch across a tile border go through further rounds.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import square_window
from ..functions.numeric import floor_div
from ..scale import attach, settle, settled, skew_join
from .neighbourhood import close, rect

KEYS = ("image_id", "mask_id")
TILE = 256


def _tile_labeller(keys: list[str], conn: int):
    """The function that labels one tile. It is self-contained, so workers need not have this package installed."""
    def first_of_group(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        """For pixels sorted by (y, x): index of the first pixel of the component each belongs to."""
        new_run = np.r_[True, (np.diff(y) != 0) | (np.diff(x) != 1)]
        run = np.cumsum(new_run) - 1
        start = np.flatnonzero(new_run)
        end = np.r_[start[1:], len(y)] - 1
        ry, x0, x1 = y[start], x[start], x[end]
        # runs of the next line that touch a run are neighbours in the sorted order
        reach, line = (1 if conn == 8 else 0), int(x1.max()) + 4
        lo = np.searchsorted(ry * line + x1, (ry + 1) * line + x0 - reach, "left")
        hi = np.searchsorted(ry * line + x0, (ry + 1) * line + x1 + reach, "right")
        n = np.maximum(hi - lo, 0)
        a = np.repeat(np.arange(len(start)), n)
        b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        group = np.arange(len(start))
        while (group[a] != group[b]).any():
            low = np.minimum(group[a], group[b])
            np.minimum.at(group, group[a], low)
            np.minimum.at(group, group[b], low)
            while (group[group] != group).any():
                group = group[group]
        return start[group][run]

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"], ignore_index=True)
        y, x = pdf["y"].to_numpy().astype(np.int64), pdf["x"].to_numpy().astype(np.int64)
        return pdf[[*keys, "y", "x"]].assign(label=(y * (1 << 32) + x)[first_of_group(y, x)])
    return label


def connected_components(mask: DataFrame, conn: int = 8, keys=KEYS, tile: int = TILE) -> DataFrame:
    """Adds `label`: (y, x) of the component's first pixel in raster order as one number. The result is settled."""
    keys = list(keys)
    group = [*keys, "_ty", "_tx"]
    px = mask.select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in px.schema.fields)
    tiled = px.withColumns({"_ty": floor_div("y", F.lit(tile)), "_tx": floor_div("x", F.lit(tile))})
    local = settle(tiled.groupBy(*group).applyInPandas(_tile_labeller(keys, conn), f"{kinds}, label bigint"), "tiles")
    edges = _across_tiles(local, conn, keys, tile)
    if edges is None:
        return local
    roots = _stars(edges, keys)
    return settle(local.join(roots, [*keys, "label"], "left").withColumn("label", F.coalesce("root", "label")).drop("root"), "labels")


def _across_tiles(local: DataFrame, conn: int, keys, tile: int) -> DataFrame | None:
    """Pairs (u, v) of labels of neighbouring pixels in different tiles, or None if no tile border is touched."""
    edge = (F.col("y") % tile).isin(0, tile - 1) | (F.col("x") % tile).isin(0, tile - 1)
    border = local.where(edge)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if conn == 8 else [])
    moves = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps]))
    reach = border.withColumn("s", moves).withColumns({"_y": F.col("y") + F.col("s.dy"), "_x": F.col("x") + F.col("s.dx")})
    leaves = (floor_div("_y", F.lit(tile)) != floor_div("y", F.lit(tile))) | (floor_div("_x", F.lit(tile)) != floor_div("x", F.lit(tile)))
    sent = reach.where(leaves).select(*keys, F.col("_y").alias("y"), F.col("_x").alias("x"), F.col("label").alias("u"))
    pairs = settle(sent.join(border.withColumnRenamed("label", "v"), [*keys, "y", "x"]).select(*keys, "u", "v").distinct(), "edges")
    return pairs if settled(pairs)["rows"] else None


def _stars(edges: DataFrame, keys) -> DataFrame:
    """Smallest label reachable from each label: alternate large-star and small-star rounds (Kiveris et al., 2014).

    Every round is written, so the lineage stays one round long. The centre of a big component collects many edges;
    its minimum is combined map-side and the join back to its edges is salted.
    """
    at = [*keys, "u"]

    def minima(e):
        m = e.groupBy(*at).agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        return settle(m, "minima", peak=F.max("n"))

    def pull(e, low):
        return skew_join(e, low.drop("n"), at, counts=low)
    cur, seen = edges, None
    while True:
        both = cur.select(*keys, "u", "v").union(cur.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        large = pull(both, minima(both)).where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        down = settle(large.where("u <> v").select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
        low = minima(down)
        small = pull(down, low).where("v <> m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        whole = small.union(low.select(*keys, "u", F.col("m").alias("v"))).where("u <> v").distinct()
        cur = settle(whole, "star", mark=F.sum(F.xxhash64(*whole.columns).cast("decimal(38,0)")))
        if settled(cur) == seen:
            return cur.select(*keys, F.col("u").alias("label"), F.col("v").alias("root"))
        seen = settled(cur)


def component_stats(labelled: DataFrame, keys=KEYS) -> DataFrame:
    return labelled.groupBy(*keys, "label").agg(
        F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def drop_small(labelled: DataFrame, images: DataFrame, frac: float = 0.002, keys=KEYS) -> DataFrame:
    """Pixels of the components larger than a share of the frame."""
    big = component_stats(labelled, keys).join(images.select("image_id", "width", "height"), "image_id").where(
        F.col("area") > F.col("width").cast("double") * F.col("height") * frac)
    return attach(labelled, big.select(*keys, "label"), [*keys, "label"], "left_semi")


def largest_label(labelled: DataFrame, keys=KEYS) -> DataFrame:
    """Label of the largest component of each mask; the first in raster order among equals."""
    best = component_stats(labelled, keys).groupBy(*keys).agg(F.max(F.struct("area", (-F.col("label")).alias("neg"))).alias("b"))
    return best.select(*keys, (-F.col("b.neg")).alias("label"))


def largest_component(labelled: DataFrame, keys=KEYS) -> DataFrame:
    return attach(labelled, largest_label(labelled, keys), [*keys, "label"], "left_semi")


def component_at(labelled: DataFrame, points: DataFrame, keys=KEYS) -> DataFrame:
    """Component under the point (keys, py, px) of each mask, or the largest one if the point lies outside."""
    at = labelled.join(points.select(*keys, F.col("py").alias("y"), F.col("px").alias("x")), [*keys, "y", "x"]).select(*keys, F.col("label").alias("_hit"))
    chosen = largest_label(labelled, keys).join(at, list(keys), "left").select(*keys, F.coalesce("_hit", "label").alias("label"))
    return attach(labelled, chosen, [*keys, "label"], "left_semi")


def _border_labels(labelled: DataFrame, images: DataFrame, keys) -> DataFrame:
    s = component_stats(labelled, keys).join(images.select("image_id", "width", "height"), "image_id")
    touches = (F.col("x0") == 0) | (F.col("y0") == 0) | (F.col("x1") == F.col("width") - 1) | (F.col("y1") == F.col("height") - 1)
    return s.where(touches).select(*keys, "label")


def border_connected(mask: DataFrame, images: DataFrame, conn: int = 4, keys=KEYS, tile: int = TILE) -> DataFrame:
    """Pixels of the components that touch the frame border."""
    labelled = connected_components(mask, conn, keys, tile)
    return attach(labelled, _border_labels(labelled, images, keys), [*keys, "label"], "left_semi").select(*keys, "y", "x")


def white_matte(pixels: DataFrame, images: DataFrame, width: int, height: int, tol: int = 12, close_px: int = 5) -> DataFrame:
    """Object pixels of a picture on white: all but the near-white area connected to the border, with pinholes closed."""
    keys = ["image_id"]
    white = pixels.where(F.least("r", "g", "b") >= 255 - tol).select("image_id", "y", "x")
    outside = border_connected(white, images, 4, keys)
    inside = pixels.select("image_id", "y", "x").join(outside, ["image_id", "y", "x"], "left_anti")
    return close(inside, rect(close_px, close_px), width, height, keys)


def windows_per_hole(hole: DataFrame, region: DataFrame, images: DataFrame, factor: float = 3.0, min_side: int = 512,
                     tile: int = TILE) -> DataFrame:
    """One square window per hole component, sized by the region components that touch it.

    A region that covers its whole frame says nothing about a hole, so the hole's own box is used there.
    """
    keys = ["image_id"]
    holes = connected_components(hole, 8, keys, tile)
    areas = connected_components(region, 8, keys, tile)
    full = (region.select("image_id", "y", "x").distinct().groupBy("image_id").count().join(images, "image_id")
            .select("image_id", (F.col("count") == F.col("width").cast("bigint") * F.col("height")).alias("_full")))
    met = (holes.select("image_id", "y", "x", "label").join(areas.withColumnRenamed("label", "_r"), ["image_id", "y", "x"])
           .select("image_id", "label", "_r").distinct())
    boxes = component_stats(areas, keys).select("image_id", F.col("label").alias("_r"), *[F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")])
    around = attach(met, boxes, ["image_id", "_r"]).groupBy("image_id", "label").agg(
        F.min("rx0").alias("rx0"), F.min("ry0").alias("ry0"), F.max("rx1").alias("rx1"), F.max("ry1").alias("ry1"))
    own = component_stats(holes, keys).join(around, ["image_id", "label"], "left").join(full, "image_id", "left").join(
        images.select("image_id", "width", "height"), "image_id")
    use = ~F.coalesce("_full", F.lit(False)) & F.col("rx0").isNotNull()
    own = own.withColumns({f"_{c}": F.when(use, F.col(f"r{c}")).otherwise(F.col(c)) for c in ("x0", "y0", "x1", "y1")})
    ext = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))
    side = F.greatest(F.lit(float(min_side)), ext * F.lit(factor))
    win = square_window((F.col("_x0") + F.col("_x1")) / 2, (F.col("_y0") + F.col("_y1")) / 2, side, "width", "height")
    return own.select("image_id", "label", "area", *[v.alias(k) for k, v in win.items()])


__all__ = ["connected_components", "component_stats", "drop_small", "largest_component", "component_at",
           "border_connected", "white_matte", "windows_per_hole"]
