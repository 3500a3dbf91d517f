"""Composite jobs: what a user runs end to end, put together from the operators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import registry
from ..functions.colour import luminance
from ..functions.numeric import floor_div
from ..operators import components as CC
from ..operators import frames as FR
from ..operators import light as L
from ..operators import masks as M
from ..operators import neighbourhood as N
from ..operators import points as P
from ..operators import raster as R
from ..operators import region_rows as RR
from ..operators import regions as RG
from ..operators import texture as TX
from ..operators.requests import default_tile_m
from ..scale import settle

RGB = FR.RGB


def label_consensus(scores: DataFrame, classes: DataFrame, wanted: list[str], images: DataFrame, width: int, height: int,
                    close_px: int = 5, frac: float = 0.002) -> tuple[DataFrame, DataFrame]:
    """Scores of several models and passes to one cleaned mask per image, and how well the passes agree."""
    best = M.ensemble_argmax(scores, classes, wanted, ["pass_id", "mirrored"])
    votes = settle(best.select(*M.PIXEL, "pass_id", "mirrored", F.col("is_wanted").alias("v")), "votes")
    raw = M.majority_vote(votes, width).where("v").select(*M.PIXEL)
    closed = N.close(raw, N.rect(close_px, close_px), width, height, ["image_id"])
    labelled = CC.connected_components(closed, 8, ["image_id"])
    mask = CC.drop_small(labelled, images, frac, ["image_id"]).select(*M.PIXEL)
    return mask, M.vote_agreement(votes, width)


def scene_plane(points: DataFrame, mask: DataFrame, keys=("image_id",)) -> DataFrame:
    """Plane through the valid points under a mask, with its residual."""
    inside = points.where("valid").join(mask.select(*keys, "y", "x"), [*keys, "y", "x"], "left_semi")
    plane = P.fit_plane_trimmed(inside, keys)
    return plane.join(P.plane_residual_cm(inside, plane, keys), list(keys))


def retile(pixels: DataFrame, planes: DataFrame, tex: DataFrame, camera: dict | DataFrame, width_px: int, height_px: int, tile_m: float | None,
           albedo: float, uv_places: int | None = None) -> DataFrame:
    """Albedo of a new surface on each plane: ray and plane give metric coordinates, these a texel of the calibrated texture.

    `camera` holds for all frames, or is a table with one row an image (image_id, fx, fy, cx, cy).
    """
    calibrated = settle(L.calibrate_mean(tex, albedo, ["pattern_id"]), "albedo")
    uv = P.ray_plane(pixels, planes, camera)
    size = F.lit(tile_m) if tile_m is not None else default_tile_m(F.lit(width_px))
    tu, tv = TX.tile_uv("pu", "pv", size, F.lit(width_px), F.lit(height_px))
    if uv_places is not None:
        tu, tv = F.round(tu, uv_places), F.round(tv, uv_places)
    return TX.texture_lookup(uv.withColumns({"tu": tu, "tv": tv}), calibrated, "tu", "tv", width_px, height_px)


def field_report(light: DataFrame, environment: DataFrame, k: int, rel: float = 0.02, keys=("image_id",)) -> DataFrame:
    """Per scene: share of thin structures, reference level, ambient fraction, shadow and lit chromaticity, environment.

    `light` has r, g, b and the flag `inside`; `environment` has valid, on_plane, h and colours.
    """
    keys = list(keys)
    flat = N.thin_structure_filter(light, list(RGB), k, rel, keys)
    flat = settle(flat.withColumns({c: F.greatest(F.col(c), F.lit(1e-5)) for c in RGB}), "light")
    thin = (F.col("thin_r").cast("int") + F.col("thin_g").cast("int") + F.col("thin_b").cast("int")) / 3
    share = flat.groupBy(*keys).agg(F.bround(F.avg(F.when(F.col("inside"), thin)) * 100, 2).alias("grout_filtered_pct"))
    lit = settle(L.anchor_mean_one(flat, F.col("inside"), keys).withColumn("lum", luminance()), "anchored")
    level = lit.groupBy(*keys).agg(F.first("ref").alias("ref_irradiance"))
    ambient = L.ambient_split(lit, F.col("inside"), keys).groupBy(*keys).agg(F.first("a").alias("ambient_fraction"))
    chroma = L.quartile_chroma(lit, F.col("inside"), keys)
    env = P.environment_mean(environment, keys).withColumnsRenamed({c: f"env_{c}" for c in RGB})
    out = share
    for other in (level, ambient, chroma, env):
        out = out.join(other, keys, "left")
    return out


def scaled_moves(moves: DataFrame, scale, depth: DataFrame | None = None) -> DataFrame:
    """Moves with their object scale: a number for all, or with "auto" the depth ratio of source and target, null where there
    is no depth at one of them."""
    if scale != "auto":
        return moves.withColumn("scale", F.lit(float(scale)))
    if depth is None:
        return moves
    anchors = moves.select(F.struct("image_id", "move_idx").alias("move_id"), "image_id", "src_x", "src_y", "dst_x", "dst_y")
    probed = P.depth_probe(depth, anchors).select("move_id.image_id", "move_id.move_idx", "scale")
    return moves.drop("scale").join(probed, ["image_id", "move_idx"], "left")


def low_resolution_moves(moves: DataFrame, masks: DataFrame, f: int, width, height) -> tuple[DataFrame, DataFrame]:
    """Moves and masks on the frame reduced by f: points are divided, a block is on when any of its pixels is."""
    points = {c: floor_div(c, F.lit(f)) for c in ("src_x", "src_y", "dst_x", "dst_y")}
    return moves.withColumns(points), R.block_any(masks, f, width, height)


def move_objects(pixels: DataFrame, masks: DataFrame, moves: DataFrame, images: DataFrame, cfg: dict, width: int, height: int,
                 depth: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove each object, fill the hole, put the object at its target, and audit what changed.

    References are resolved first: a move whose image or mask isn't there is not made. The scale comes from the options, from `depth`,
    or stays what the moves say. Returns the frames; the pixels that changed where they mustn't, outside the source regions
    when the objects were removed, or outside these and the target footprints in the end; and the rejected moves with their error.
    """
    settings = {**cfg, "width": width, "height": height, **options}
    radius = int(cfg["dilate_radius"])
    pixels, masks = settle(pixels, "frames"), settle(masks, "masks")         # both are read by every step below
    resolved = settle(FR.checked_moves(moves, masks, images), "resolved")
    moves, rejected = resolved.where("error is null").drop("error"), resolved.where("error is not null")
    hole = settle(N.dilate(masks, N.rect(2 * radius + 1, 2 * radius + 1), width, height), "hole")
    allowed = RG.edit_region_rows(hole, images, cfg["src_region"], cfg["region_margin"], generative=False)
    allowed = settle(allowed.select("image_id", *RR.RECT), "region")
    hole_px = hole.select(*M.PIXEL).distinct()
    remove = registry.make("removal", cfg["removal"], settings)
    insert = registry.make("insertion", cfg["insertion"], settings)
    background = settle(remove(pixels, hole_px, allowed, images), "background")
    out, footprint = insert(pixels, background, masks, scaled_moves(moves, cfg["scale"], depth), images)
    out = settle(out, "moved")
    leaked = FR.containment_audit(pixels, background, allowed)
    strayed = FR.containment_audit(pixels, out, allowed).join(footprint.select(*M.PIXEL), M.PIXEL, "left_anti")
    return out, leaked.unionByName(strayed).distinct(), rejected


def multires_merge(original: DataFrame, low_in: DataFrame, low_out: DataFrame, f: int, width: int, height: int,
                   grow_px: int = 3, feather_px: float = 4.0, thr: int = 2) -> DataFrame:
    """Bring an edit made at 1/f resolution back: only pixels it changed (grown, feathered) are taken from it."""
    w, h = width - width % f, height - height % f
    changed = N.dilate(FR.pixel_diff(low_in, low_out, thr).select(*M.PIXEL), N.rect(2 * grow_px + 1, 2 * grow_px + 1), w // f, h // f, ["image_id"])
    base = original.where((F.col("x") < w) & (F.col("y") < h))
    alpha = N.soft_mask(base, R.upsample_nearest(changed, f, ["image_id"]), feather_px * f / 2, width=w, height=h)
    return FR.composite(original, R.upsample_nearest(low_out, f, ["image_id", *RGB]), alpha)
