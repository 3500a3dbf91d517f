"""Named backends: how removal and insertion methods are plugged into `move_objects`.

A backend is made by a factory from the checked options. A remover is called as remove(pixels, hole, region, images), with the hole as pixels
and the region it may change as rectangles (image_id, y0, y1, x0, x1), and
an inserter as insert(original, background, masks, moves, images); both return pixels of the same frames.
"""

import difflib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import fill, frames
from .operators.neighbourhood import dilate, gaussian_kernel, rect, soft_mask
from .scale import settle

# Option names and their usual values. The two backends default to the model-free ones.
DEFAULTS = {
    "scale": "auto", "dilate_radius": 6, "removal": "background", "insertion": "paste", "prompt": "", "bg_prompt": "empty scene",
    "start_step": 15, "end_scale": 0.0, "src_region": "full", "dst_region": "full", "region_margin": 0.35, "preclean": False,
    "sr_factor": 1, "sr_steps": 15, "sr_noise": 0.01, "omnipaint_steps": 28, "omnipaint_grow": 8, "omnipaint_mode": "full",
    "omnipaint_res": 1024, "seed": 42, "grow_px": 15, "feather_px": 4.0, "fill_sigma": 3.0,
}
_BACKENDS: dict[str, dict[str, Callable]] = {}


def config(**overrides) -> dict:
    """The options, some of them replaced. A name that is no option is refused, with the closest ones."""
    chosen = dict(DEFAULTS)
    for name, value in overrides.items():
        if name not in chosen:
            near = difflib.get_close_matches(name, chosen) or list(chosen)
            raise KeyError(f"{name} is no option here; did you mean {' or '.join(near)}?")
        chosen[name] = value
    return chosen


def register(kind: str, name: str, factory: Callable) -> None:
    _BACKENDS.setdefault(kind, {})[name] = factory


def names(kind: str) -> list[str]:
    return sorted(_BACKENDS.get(kind, {}))


def make(kind: str, name: str, cfg: dict):
    """The backend called `name`, or an error that lists the choices."""
    if name not in names(kind):
        raise ValueError(f"no backend for {kind} is registered as {name!r}, only {', '.join(names(kind)) or 'none at all'}")
    return _BACKENDS[kind][name](cfg)


def _background(cfg):
    def remove(pixels, hole, region, images):
        return fill.fill_from_background(pixels, hole, float(cfg["fill_sigma"]), cfg["width"], cfg["height"])
    return remove


def _paste(cfg):
    grow, feather = int(cfg["grow_px"]), float(cfg["feather_px"])

    def insert(original, background, masks, moves, images):
        """Copy each object to its place; with a feather its alpha fades out around the grown footprint.

        A move touches its footprint, grown, and what the feather's kernel reaches from there, never the whole frame.
        """
        footprint = settle(frames.affine_paste(original, masks, moves, images), "footprint")
        if not feather:
            return frames.layer_fold(background, footprint, opaque=True), footprint
        keys = ["image_id", "move_idx"]
        # the layer shows the object where it is and the background around it, faded over the grown footprint
        wide = dilate(footprint.select(*keys, "y", "x"), rect(2 * grow + 1, 2 * grow + 1), cfg["width"], cfg["height"], keys)
        reach = len(gaussian_kernel(feather)) // 2
        near = dilate(wide, rect(4 * reach + 1, 4 * reach + 1), cfg["width"], cfg["height"], keys)   # all that the kernel reads at a touched pixel
        alpha = soft_mask(near, wide, feather, keys, cfg["width"], cfg["height"]).where("alpha > 0")
        own = footprint.select(*keys, "y", "x", *[F.col(c).alias(f"_{c}") for c in frames.RGB])
        layer = alpha.join(background.select("image_id", "y", "x", *frames.RGB), ["image_id", "y", "x"]).join(own, [*keys, "y", "x"], "left")
        layer = settle(layer.select(*keys, "y", "x", "alpha", *[F.coalesce(f"_{c}", c).alias(c) for c in frames.RGB]), "layer")
        return frames.layer_fold(background, layer), layer
    return insert


register("removal", "background", _background)
register("insertion", "paste", _paste)
