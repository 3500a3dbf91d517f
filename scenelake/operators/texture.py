"""Texture layout and lookup."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import _c, rint_i, wrap01
from ..scale import attach
from .requests import tile_extent

RGB = ("r", "g", "b")


def tile_uv(u, v, tile_m, width_px, height_px, offset: float = 0.5) -> tuple[Column, Column]:
    """Metric plane coordinates to fractional texel coordinates; the wrap is right for negative coordinates."""
    su, sv = tile_extent(tile_m, width_px, height_px)
    return (wrap01(_c(u) / su + offset) * (_c(width_px) - 1)), (wrap01(_c(v) / sv + offset) * (_c(height_px) - 1))


def corner_table(tex: DataFrame, width, height, keys=(), channels=RGB, border: str = "wrap") -> DataFrame:
    """Each texel with its right, lower and diagonal neighbour in one row.

    The work is done once on the texture, so that a bilinear lookup is one join of the pixels instead of four rows per
    pixel that have to be summed again. `border` is wrap or clamp.
    """
    steps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (0, 1) for dx in (0, 1)]))
    s = tex.select(*keys, "ty", "tx", *channels, steps.alias("s"))
    oy, ox = F.col("ty") - F.col("s.dy"), F.col("tx") - F.col("s.dx")
    if border == "wrap":
        s = s.withColumns({"_y": F.pmod(oy, F.lit(height)), "_x": F.pmod(ox, F.lit(width))})
    else:
        # the last row and column are their own lower and right neighbours
        ys = F.when(F.col("s.dy") == 0, F.array(F.col("ty"))).when(oy >= 0, F.array(oy)).otherwise(F.array())
        xs = F.when(F.col("s.dx") == 0, F.array(F.col("tx"))).when(ox >= 0, F.array(ox)).otherwise(F.array())
        ys = F.when((F.col("s.dy") == 1) & (F.col("ty") == height - 1), F.concat(ys, F.array(F.col("ty")))).otherwise(ys)
        xs = F.when((F.col("s.dx") == 1) & (F.col("tx") == width - 1), F.concat(xs, F.array(F.col("tx")))).otherwise(xs)
        s = s.withColumn("_y", F.explode(ys)).withColumn("_x", F.explode(xs))
    at = [F.max(F.when((F.col("s.dy") == dy) & (F.col("s.dx") == dx), F.col(c))).alias(f"{c}{dy}{dx}")
          for c in channels for dy in (0, 1) for dx in (0, 1)]
    return s.groupBy(*keys, F.col("_y").cast("int").alias("ty"), F.col("_x").cast("int").alias("tx")).agg(*at)


def texture_lookup(pixels: DataFrame, tex: DataFrame, u: str, v: str, width: int, height: int, mode: str = "bilinear",
                   keys=(), channels=RGB, border: str = "wrap", join=attach) -> DataFrame:
    """Colour of the texture at fractional coordinates (u along the width, v along the height).

    A missing texel counts as 0. The texture is broadcast only if it is small; a large one is joined with hot texels
    salted, because many pixels may fall on one texel. A caller that knows how few can pass a plain `join`.
    """
    def fit(c, size):
        return F.pmod(c, F.lit(size)) if border == "wrap" else F.least(F.greatest(c, F.lit(0)), F.lit(size - 1))
    if mode == "nearest":
        at = pixels.withColumns({"ty": fit(rint_i(v), height).cast("int"), "tx": fit(rint_i(u), width).cast("int")})
        j = join(at, tex.select(*keys, "ty", "tx", *channels), [*keys, "ty", "tx"], "left")
        return j.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in channels}).drop("ty", "tx")
    fy, fx = F.col(v) - F.floor(v), F.col(u) - F.floor(u)
    at = pixels.withColumns({"ty": fit(F.floor(v), height).cast("int"), "tx": fit(F.floor(u), width).cast("int"), "_fy": fy, "_fx": fx})
    corners = corner_table(tex, width, height, keys, channels, border)
    j = join(at, corners, [*keys, "ty", "tx"], "left")
    w = {(dy, dx): (F.col("_fy") if dy else 1 - F.col("_fy")) * (F.col("_fx") if dx else 1 - F.col("_fx")) for dy in (0, 1) for dx in (0, 1)}

    def mix(c):
        terms = [F.coalesce(f"{c}{dy}{dx}", F.lit(0.0)) * k for (dy, dx), k in w.items()]
        return terms[0] + terms[1] + terms[2] + terms[3]
    return j.withColumns({c: mix(c) for c in channels}).drop("ty", "tx", "_fy", "_fx", *[f"{c}{a}{b}" for c in channels for a in (0, 1) for b in (0, 1)])


def upsample_linear(pixels: DataFrame, low: DataFrame, f: int, width: int, height: int, keys=("image_id",), channels=RGB) -> DataFrame:
    """Values of a frame reduced by f at the places of `pixels`, interpolated between block centres and held at the border.

    A block serves at most about f x f pixels, so the join needs no salt.
    """
    at = pixels.select(*keys, "y", "x").withColumns({
        "_u": F.least(F.greatest((F.col("x") + 0.5) / f - 0.5, F.lit(0.0)), F.lit(width - 1.0)),
        "_v": F.least(F.greatest((F.col("y") + 0.5) / f - 0.5, F.lit(0.0)), F.lit(height - 1.0))})
    tex = low.withColumnsRenamed({"y": "ty", "x": "tx"})
    out = texture_lookup(at, tex, "_u", "_v", width, height, keys=keys, channels=channels, border="clamp",
                         join=lambda a, b, on, how: a.join(b, on, how))
    return out.select(*keys, "y", "x", *channels)
