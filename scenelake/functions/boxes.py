"""Boxes and square windows in pixel coordinates."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import _c, clip, rint_i


def clamp_box(x0, y0, x1, y1, w, h) -> dict[str, Column]:
    """First corner limited to the last pixel, second to the frame size, then ordered."""
    xa, xb = clip(x0, 0, _c(w) - 1), clip(x1, 0, _c(w))
    ya, yb = clip(y0, 0, _c(h) - 1), clip(y1, 0, _c(h))
    return {"x0": F.least(xa, xb).cast("int"), "y0": F.least(ya, yb).cast("int"),
            "x1": F.greatest(xa, xb).cast("int"), "y1": F.greatest(ya, yb).cast("int")}


def is_degenerate(x0, y0, x1, y1) -> Column:
    return (_c(x1) - _c(x0) < 2) | (_c(y1) - _c(y0) < 2)


def box_centre(x0, y0, x1, y1) -> tuple[Column, Column]:
    return rint_i((_c(x0) + _c(x1)) / 2), rint_i((_c(y0) + _c(y1)) / 2)


def square_window(cx, cy, side, w, h) -> dict[str, Column]:
    """A square around a centre, no larger than the frame and moved to lie inside it."""
    s = F.least(_c(side).cast("int"), _c(w), _c(h)).cast("int")
    return {"wx": clip(F.rint(_c(cx) - s / 2), 0, _c(w) - s).cast("int"),
            "wy": clip(F.rint(_c(cy) - s / 2), 0, _c(h) - s).cast("int"),
            "side": s}


def window_side(x0, y0, x1, y1, scale=1.0, factor: float = 3.0, min_side: int = 512) -> Column:
    """Side from the diagonal of an inclusive bounding box; an enlarged object needs the larger window."""
    diagonal = F.hypot((_c(x1) - _c(x0)).cast("double"), (_c(y1) - _c(y0)).cast("double")) * F.greatest(F.lit(1.0), _c(scale).cast("double"))
    return F.greatest(F.lit(min_side), F.ceil(diagonal * factor)).cast("int")


def target_side(x0, y0, x1, y1, factor: float = 3.0, min_side: int = 512) -> Column:
    """Side of the window around a user-drawn target box."""
    return F.greatest(F.lit(float(min_side)), F.greatest(_c(x1) - _c(x0), _c(y1) - _c(y0)) * F.lit(factor)).cast("int")
