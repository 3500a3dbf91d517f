"""Neighbourhood operators: filters and morphology as window frames over pixel coordinates.

All filters are separable or run-based: one pass along x, one along y, each with a single shuffle. A line longer than a
tile is cut into tiles that share a margin, so a window never holds more than a tile and its margins.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.colour import luminance
from ..functions.numeric import clip, floor_div, guard
from ..scale import attach, quantiles, settle
from .texture import upsample_linear

TILE = 4096
OTHER = {"x": "y", "y": "x"}


def _size(size) -> Column:
    return F.col(size) if isinstance(size, str) else F.lit(size)


# ------------------------------------------------------------------ window passes along one axis
def _tiled(df: DataFrame, axis: str, reach: int, tile: int) -> DataFrame:
    """Send each pixel to its own tile and to a neighbouring tile that can see it; lines shorter than a tile stay whole."""
    first = F.greatest(floor_div(F.col(axis) - reach, F.lit(tile)), F.lit(0))
    last = F.greatest(floor_div(F.col(axis) + reach, F.lit(tile)), F.lit(0))
    return df.withColumn("_t", F.explode(F.sequence(first, last)))


def _padded(df: DataFrame, axis: str, reach: int, size, border: str) -> DataFrame:
    """Add mirrored copies of pixels outside the frame; `_pad` marks them.

    Where the reach is below the size a pixel has at most one copy beyond each border. Else the frame is mirrored again and
    again: positions repeat with a period of twice the size, less the two border pixels that `reflect101` doesn't double.
    """
    if border == "truncate":
        return df.withColumn("_pad", F.lit(False))
    a, n, edge = F.col(axis), _size(size), 1 if border == "reflect101" else 0
    before, after = -a - 1 + edge, n * 2 - 1 - a - edge
    once = F.filter(F.array(a, F.when((before < 0) & (before >= -reach), before), F.when((after >= n) & (after < n + reach), after)),
                    lambda p: p.isNotNull())
    period = F.greatest(n * 2 - 2 * edge, F.lit(1)).cast("int")
    turns = F.sequence(-F.ceil(F.lit(reach) / period).cast("int") - 1, F.ceil(F.lit(reach) / period).cast("int") + 1)
    every = F.flatten(F.transform(turns, lambda k: F.array((a + k * period).cast("int"), (before + k * period).cast("int"))))
    many = F.array_distinct(F.filter(every, lambda p: (p >= -reach) & (p < n + reach)))
    places = F.when(F.lit(reach) < n - edge, once.cast("array<int>")).otherwise(many.cast("array<int>"))
    return (df.withColumn("_p", F.explode(places)).withColumn("_pad", F.col("_p") != F.col(axis))
            .withColumn(axis, F.col("_p").cast("int")).drop("_p"))


def _pass(df: DataFrame, axis: str, reach: int, outputs, keys, size=None, border="truncate", tile=TILE) -> DataFrame:
    """Run window expressions along one axis. `outputs(window)` maps a frame specification to named expressions."""
    cols = df.columns
    spread = _tiled(_padded(df, axis, reach, size, border), axis, reach, max(tile, reach))
    w = Window.partitionBy(*keys, OTHER[axis], "_t").orderBy(axis)
    done = spread.withColumns(outputs(w))
    owner = F.greatest(floor_div(axis, F.lit(max(tile, reach))), F.lit(0))
    named = list(outputs(w))
    return done.where(~F.col("_pad") & (F.col("_t") == owner)).select(*cols, *[n for n in named if n not in cols])


def box_filter(px: DataFrame, r: int, channels: list[str], keys=("image_id",), width=None, height=None,
               border: str = "truncate", tile: int = TILE) -> DataFrame:
    """Mean over a (2r+1)^2 square. Outside the frame pixels are left out (`truncate`) or mirrored (`reflect`)."""
    keys = list(keys)

    def along(axis, count):
        def outputs(w):
            f = w.rangeBetween(-r, r)
            return {**{c: F.sum(c).over(f) for c in channels}, "_n": (F.sum("_n") if count else F.count("*")).over(f)}
        return outputs
    base = px.select(*keys, "y", "x", *channels)
    rows = _pass(base.withColumn("_n", F.lit(1).cast("bigint")), "x", r, along("x", True), keys, width, border, tile)
    both = _pass(rows, "y", r, along("y", True), keys, height, border, tile)
    return both.select(*keys, "y", "x", *[(F.col(c) / F.col("_n")).alias(c) for c in channels])


def gaussian_kernel(sigma: float) -> list[float]:
    """Weights for offsets -r..r with r = 4 sigma, which is where float images cut the kernel; they sum to 1."""
    r = int(round(sigma * 8 + 1)) // 2
    w = [math.exp(-(i * i) / (2.0 * sigma * sigma)) for i in range(-r, r + 1)]
    return [v / sum(w) for v in w]


def _weigh(df: DataFrame, axis: str, kernel: list[float], channels: list[str], keys, size, border: str, tile: int) -> DataFrame:
    """Weighted mean along one axis over the pixels present.

    Lines are brought together once; each pixel is then handed to the places that need it and summed in the same stage,
    because the sums are grouped by line first. Only the lines are shuffled, not the copies.
    """
    r = len(kernel) // 2
    tile = max(tile, r)
    line = [*keys, OTHER[axis], "_t"]
    taps = F.explode(F.array(*[F.struct(F.lit(i - r).alias("d"), F.lit(w).alias("w")) for i, w in enumerate(kernel)]))
    lines = _tiled(_padded(df, axis, r, size, border), axis, r, tile).repartition(*line)
    handed = lines.withColumn("_s", taps).select(
        *line, (F.col(axis) - F.col("_s.d")).alias(axis), F.col("_s.w").alias("_w"), ((F.col("_s.d") == 0) & ~F.col("_pad")).alias("_here"),
        *[(F.col(c) * F.col("_s.w")).alias(c) for c in channels])
    own = handed.where(F.col("_t") == F.greatest(floor_div(axis, F.lit(tile)), F.lit(0)))
    sums = own.groupBy(*line, axis).agg(F.max("_here").alias("_here"), F.sum("_w").alias("_w"), *[F.sum(c).alias(c) for c in channels])
    return sums.where("_here").select(*keys, "y", "x", *[(F.col(c) / F.col("_w")).alias(c) for c in channels])


def gaussian(px: DataFrame, sigma: float, channels: list[str], keys=("image_id",), width=None, height=None,
             border: str = "truncate", tile: int = TILE) -> DataFrame:
    """Gaussian blur. `truncate` renormalises over the pixels present; `reflect101` mirrors around the border pixel."""
    keys, kernel = list(keys), gaussian_kernel(sigma)
    base = px.select(*keys, "y", "x", *[F.col(c).cast("double").alias(c) for c in channels])
    rows = _weigh(base, "x", kernel, channels, keys, width, border, tile)
    return _weigh(rows, "y", kernel, channels, keys, height, border, tile)


def guided_filter(px: DataFrame, guide: str, channels: list[str], r: int, eps: float, keys=("image_id",), width=None,
                  height=None, border: str = "reflect") -> DataFrame:
    """Edge-preserving smoothing: a local linear model of each channel on the guide. Two box passes in all."""
    sums = {"_g": F.col(guide).cast("double"), "_gg": F.col(guide) * F.col(guide)}
    for c in channels:
        sums |= {f"_s_{c}": F.col(c).cast("double"), f"_gs_{c}": F.col(guide) * F.col(c)}
    means = box_filter(px.withColumns(sums), r, list(sums), keys, width, height, border)
    ab = {}
    for c in channels:
        a = (F.col(f"_gs_{c}") - F.col("_g") * F.col(f"_s_{c}")) / (F.col("_gg") - F.col("_g") * F.col("_g") + eps)
        ab |= {f"_a_{c}": a, f"_b_{c}": F.col(f"_s_{c}") - a * F.col("_g")}
    second = box_filter(means.withColumns(ab), r, list(ab), keys, width, height, border)
    j = px.select(*keys, "y", "x", F.col(guide).alias("_guide")).join(second, [*keys, "y", "x"])
    return j.select(*keys, "y", "x", *[(F.col(f"_a_{c}") * F.col("_guide") + F.col(f"_b_{c}")).alias(c) for c in channels])


# ------------------------------------------------------------------ structuring elements
def rect(kx: int, ky: int, ax: int | None = None, ay: int | None = None) -> list[tuple[int, int, int]]:
    """Rows (dy, from, to) of a rectangle kx by ky around its anchor."""
    ax, ay = kx // 2 if ax is None else ax, ky // 2 if ay is None else ay
    return [(dy, -ax, kx - 1 - ax) for dy in range(-ay, ky - ay)]


def ellipse(k: int) -> list[tuple[int, int, int]]:
    """Rows of the ellipse inscribed in a k by k square."""
    r = k // 2
    half = {dy: round(r * math.sqrt(max(r * r - dy * dy, 0)) / r) if r else 0 for dy in range(-r, r + 1)}
    return [(dy, -h, h) for dy, h in half.items()]


def flipped(element):
    return [(-dy, -b, -a) for dy, a, b in element]


# ------------------------------------------------------------------ binary morphology on sparse masks
def runs(mask: DataFrame, keys=("image_id", "mask_id")) -> DataFrame:
    """Horizontal runs (y, x0, x1) of each mask line."""
    w = Window.partitionBy(*keys, "y").orderBy("x")
    island = F.col("x") - F.row_number().over(w)
    return mask.select(*keys, "y", "x", island.alias("_i")).groupBy(*keys, "y", "_i").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_i")


def pixels_of(intervals: DataFrame, keys) -> DataFrame:
    """Pixels of possibly overlapping intervals (y, x0, x1), each once: an interval gives what its forerunners left over."""
    w = Window.partitionBy(*keys, "y").orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1)
    start = F.greatest(F.col("x0"), F.coalesce(F.max("x1").over(w) + 1, F.col("x0")))
    left = intervals.select(*keys, "y", start.alias("x0"), "x1").where("x0 <= x1")
    return left.select(*keys, F.col("y").cast("int").alias("y"), F.explode(F.sequence(F.col("x0").cast("int"), F.col("x1").cast("int"))).alias("x"))


def swept(intervals: DataFrame, keys, *others: str) -> DataFrame:
    """Disjoint intervals (y, x0, x1) of each line with `_n`, how many of the given ones cover them, where any does.

    Each interval is two events, +1 where it begins and -1 behind its end; a running sum along the line gives the count from one event to
    the next. What is shuffled is two rows an interval, however long it is. `others` are 0/1 columns that are counted as `_n_<name>` alongside.
    """
    one = F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct((F.col("x1") + 1).alias("x"), F.lit(-1).alias("d")))
    events = intervals.select(*keys, "y", *others, F.explode(one).alias("e"))
    line = Window.partitionBy(*keys, "y").orderBy("e.x")
    upto = line.rangeBetween(Window.unboundedPreceding, 0)
    counts = {"_n": F.sum("e.d").over(upto), **{f"_n_{c}": F.sum(F.col("e.d") * F.col(c)).over(upto) for c in others}}
    return events.withColumns({**counts, "_next": F.lead("e.x").over(line)}).where("_n > 0 and _next > e.x").select(
        *keys, "y", F.col("e.x").alias("x0"), (F.col("_next") - 1).alias("x1"), *counts)


def _as_rect(element) -> tuple[int, int, int, int] | None:
    """(from y, to y, from x, to x) if all rows of the element are alike and without gaps."""
    dys = sorted(dy for dy, _, _ in element)
    alike = len({(a, b) for _, a, b in element}) == 1 and dys == list(range(dys[0], dys[-1] + 1))
    return (dys[0], dys[-1], *element[0][1:]) if alike else None


def _turned(mask: DataFrame, keys) -> DataFrame:
    return mask.select(*keys, F.col("x").alias("y"), F.col("y").alias("x"))


def _by_axes(op, mask, box, width, height, keys) -> DataFrame:
    """A rectangle is one pass along x and one along y."""
    y0, y1, x0, x1 = box
    lines = op(mask, [(0, x0, x1)], width, height, keys)
    return _turned(op(_turned(lines, keys), [(0, y0, y1)], height, width, keys), keys)


def dilate(mask: DataFrame, element, width, height, keys=("image_id", "mask_id")) -> DataFrame:
    """Every pixel reached from the mask by an offset of the element, inside the frame.

    Lines are dilated as runs: a run and a row of the element give one interval, and overlapping intervals are merged
    before they become pixels, so no duplicates are shuffled.
    """
    box = _as_rect(element)
    if box and len(element) > 1:
        return _by_axes(dilate, mask, box, width, height, keys)
    rows = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(a).alias("a"), F.lit(b).alias("b")) for dy, a, b in element])
    grown = runs(mask, keys).withColumn("e", F.explode(rows)).select(
        *keys, (F.col("y") + F.col("e.dy")).alias("y"), F.greatest(F.col("x0") + F.col("e.a"), F.lit(0)).alias("x0"),
        F.least(F.col("x1") + F.col("e.b"), _size(width) - 1).alias("x1"))
    return pixels_of(grown.where((F.col("y") >= 0) & (F.col("y") < _size(height))), keys)


def erode(mask: DataFrame, element, width, height, keys=("image_id", "mask_id")) -> DataFrame:
    """Pixels whose whole neighbourhood is set; what lies outside the frame does not count against a pixel.

    For each row of the element a run survives as a shorter interval; a pixel stays if it lies in one interval per row, which a
    sweep along the line finds without spelling the intervals out.
    """
    box = _as_rect(element)
    if box and len(element) > 1:
        return _by_axes(erode, mask, box, width, height, keys)
    n_rows = len(element)
    far = 1 << 29
    open0 = F.when(F.col("x0") <= 0, F.lit(-far)).otherwise(F.col("x0"))
    open1 = F.when(F.col("x1") >= _size(width) - 1, F.lit(far)).otherwise(F.col("x1"))
    rows = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(a).alias("a"), F.lit(b).alias("b")) for dy, a, b in element])
    kept = (runs(mask, keys).withColumns({"_o0": open0, "_o1": open1}).withColumn("e", F.explode(rows)).select(
        *keys, (F.col("y") - F.col("e.dy")).alias("y"), F.greatest(F.col("_o0") - F.col("e.a"), F.lit(0)).alias("x0"),
        F.least(F.col("_o1") - F.col("e.b"), _size(width) - 1).alias("x1"))
        .where((F.col("y") >= 0) & (F.col("y") < _size(height)) & (F.col("x0") <= F.col("x1"))))
    if n_rows == 1:
        return pixels_of(kept, keys)
    # rows of the element that fall outside the frame at this y are fulfilled by definition
    dys = F.array(*[F.lit(dy) for dy, _, _ in element])
    wanted = F.lit(n_rows) - F.size(F.filter(dys, lambda d: (F.col("y") + d < 0) | (F.col("y") + d >= _size(height))))
    full = swept(kept, keys).where(F.col("_n") == wanted)
    return full.select(*keys, F.col("y").cast("int").alias("y"), F.explode(F.sequence(F.col("x0").cast("int"), F.col("x1").cast("int"))).alias("x"))


def close(mask: DataFrame, element, width, height, keys=("image_id", "mask_id")) -> DataFrame:
    return erode(dilate(mask, flipped(element), width, height, keys), element, width, height, keys)


def open_(mask: DataFrame, element, width, height, keys=("image_id", "mask_id")) -> DataFrame:
    return dilate(erode(mask, element, width, height, keys), flipped(element), width, height, keys)


# ------------------------------------------------------------------ grey-scale morphology
def grey(px: DataFrame, channels: list[str], element, kind: str, keys=("image_id",), tile: int = TILE) -> DataFrame:
    """Maximum (`dilate`) or minimum (`erode`) over a symmetric element whose rows get narrower away from the centre.

    Along x one sliding extreme per distinct row width; along y the rows of equal width form frames. No pixel is copied,
    and all channels share the two passes.
    """
    keys = list(keys)
    best, pick = (F.max, F.greatest) if kind == "dilate" else (F.min, F.least)
    widths = sorted({b for _, _, b in element})
    reach_y = max(dy for dy, _, _ in element)
    wide = _pass(px.select(*keys, "y", "x", *channels), "x", max(widths), lambda w: {
        f"_w{h}_{c}": best(c).over(w.rangeBetween(-h, h)) for h in widths for c in channels}, keys, tile=tile)

    def along_y(w):
        out = {}
        for c in channels:
            parts = []
            for h in widths:
                dys = sorted(dy for dy, _, b in element if b == h and dy >= 0)
                lo, hi = dys[0], dys[-1]
                frames = [(-hi, hi)] if lo == 0 else [(-hi, -lo), (lo, hi)]
                parts += [best(f"_w{h}_{c}").over(w.rangeBetween(*f)) for f in frames]
            out[f"_out_{c}"] = pick(*parts) if len(parts) > 1 else parts[0]
        return out
    return _pass(wide, "y", reach_y, along_y, keys, tile=tile).select(*keys, "y", "x", *[F.col(f"_out_{c}").alias(c) for c in channels])


def grey_close_open(px: DataFrame, channels: list[str], k: int, keys=("image_id",)) -> DataFrame:
    """Close, then open: thin dark structures go first, then thin bright ones."""
    e = ellipse(k)
    for kind in ("dilate", "erode", "erode", "dilate"):
        px = grey(px, channels, e, kind, keys)
    return px


def thin_structure_filter(px: DataFrame, channels: list[str], k: int, rel: float = 0.02, keys=("image_id",)) -> DataFrame:
    """Replace a value by its closed and opened form only where that moved it by more than `rel`; `thin_<c>` marks those."""
    keys = list(keys)
    flat = grey_close_open(px, channels, k, keys).withColumnsRenamed({c: f"_f_{c}" for c in channels})
    j = px.join(flat, [*keys, "y", "x"])
    for c in channels:
        thin = F.abs(F.col(f"_f_{c}") - F.col(c)) > F.greatest(F.col(c), F.lit(1e-3)) * rel
        j = j.withColumn(f"thin_{c}", thin).withColumn(c, F.when(F.col(f"thin_{c}"), F.col(f"_f_{c}")).otherwise(F.col(c)))
    return j.drop(*[f"_f_{c}" for c in channels])


# ------------------------------------------------------------------ low frequencies and gap filling
def lowfreq(px: DataFrame, channels: list[str], sigma: float, width: int, height: int, keys=("image_id",)) -> DataFrame:
    """Wide blur through a smaller frame: block means, blur, back by linear interpolation. Ragged edge blocks are kept."""
    keys, f = list(keys), max(1, int(sigma / 4))
    if f == 1:
        return gaussian(px, sigma, channels, keys, width, height, "reflect101")
    small = px.groupBy(*keys, floor_div("y", F.lit(f)).alias("y"), floor_div("x", F.lit(f)).alias("x")).agg(*[F.avg(c).alias(c) for c in channels])
    w, h = -(-width // f), -(-height // f)
    low = gaussian(small, sigma / f, channels, keys, w, h, "reflect101")
    return upsample_linear(px, low, f, w, h, keys, channels)


def delight(tex: DataFrame, amount: float, width: int, height: int, keys=("image_id",)) -> DataFrame:
    """Divide a picture's own low frequencies out of it by `amount`, keeping the mean level."""
    keys, rgb = list(keys), ["r", "g", "b"]
    low = lowfreq(tex, rgb, 0.15 * min(width, height), width, height, keys)
    level = low.groupBy(*keys).agg(F.avg(luminance()).alias("_level"))
    j = tex.select(*keys, "y", "x", *rgb).join(low.select(*keys, "y", "x", *[F.col(c).alias(f"_l{c}") for c in rgb]), [*keys, "y", "x"])
    j = attach(j, level, keys)
    return j.select(*keys, "y", "x", *[(F.col(c) * (1.0 - amount) + F.col(c) / guard(f"_l{c}", 1e-4) * F.col("_level") * amount).alias(c) for c in rgb])


def normalised_convolution(px: DataFrame, hit: str, channels: list[str], sigma: float, keys=("image_id",), width=None, height=None,
                           border: str = "reflect101") -> DataFrame:
    """Blur known values over the gaps: blur(value * hit) / blur(hit), and blur(hit) over its upper quartile as confidence.

    Frames are mirrored at their border, which needs their size; `truncate` leaves out what lies beyond.
    """
    if border != "truncate" and (width is None or height is None):
        raise ValueError("mirrored borders need the width and height of the frames")
    keys = list(keys)
    h = F.col(hit).cast("double")
    known = px.select(*keys, "y", "x", h.alias("_h"), *[(F.coalesce(F.col(c), F.lit(0.0)) * h).alias(c) for c in channels])
    b = settle(gaussian(known, sigma, ["_h", *channels], keys, width, height, border), "blur")
    ref = quantiles(b.where("_h > 0"), keys, "_h", {"_ref": 0.75})
    return attach(b, ref, keys, "left").select(
        *keys, "y", "x", *[(F.col(c) / guard("_h", 1e-4)).alias(c) for c in channels],
        F.coalesce(clip(F.col("_h") / guard("_ref", 1e-4), 0.0, 1.0), F.lit(0.0)).alias("confidence"))


def soft_mask(frame: DataFrame, mask: DataFrame, sigma: float, keys=("image_id",), width=None, height=None, border="reflect101") -> DataFrame:
    """Alpha of a feathered mask for every pixel of the frame."""
    keys = list(keys)
    on = mask.select(*keys, "y", "x", F.lit(1.0).alias("alpha"))
    dense = frame.select(*keys, "y", "x").join(on, [*keys, "y", "x"], "left").fillna(0.0, ["alpha"])
    return gaussian(dense, sigma, ["alpha"], keys, width, height, border)


def border_feather(frame: DataFrame, region: DataFrame, feather_px: int, width: int, height: int, keys=("image_id",)) -> DataFrame:
    """Feathered alpha of a region; one that covers its whole frame is pulled in from the border first."""
    keys = list(keys)
    full = region.groupBy(*keys).agg((F.count("*") == width * height).alias("_full"))
    flagged = attach(region.select(*keys, "y", "x"), full, keys)
    f = feather_px
    inner = F.col("y").between(f, height - 1 - f) & F.col("x").between(f, width - 1 - f)
    kept = flagged.where(~F.col("_full") | inner).drop("_full")
    return soft_mask(frame, kept, float(f), keys, width, height)
