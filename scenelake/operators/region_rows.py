"""Algebra of regions held as rectangles (keys, y0, y1, x0, x1), ends included.

What an edit may change is one row for a whole frame or a box and one row a run for a mask or its band. Rows may overlap; `disjoint` sweeps
them into lines that don't. Pixels come out only where a consumer asks for them.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import rint_i
from ..scale import attach
from .neighbourhood import runs, swept

KEYS = ("image_id", "mask_id")
RECT = ("y0", "y1", "x0", "x1")
# What an edit may change.
KINDS = ("mask", "dilated", "box", "full")


def _rect(y0, y1, x0, x1) -> list[Column]:
    return [v.cast("int").alias(n) for n, v in zip(RECT, (y0, y1, x0, x1))]


def _clipped(m: Column, u: Column, d: Column, y0: str, y1: str, x0: str, x1: str) -> list[Column]:
    """A rectangle grown by m sideways, u upwards and d downwards, inside the frame."""
    c, zero = F.col, F.lit(0)
    return _rect(F.greatest(c(y0) - u, zero), F.least(c(y1) + d, c("height") - 1), F.greatest(c(x0) - m, zero), F.least(c(x1) + m, c("width") - 1))


def region_rows(mask: DataFrame, images: DataFrame, kind: str | Column, margin: float = 0.35, up: float = 0.3, down: float = 1.5, keys=KEYS) -> DataFrame:
    """The region that an edit of each mask may change, as rectangles.

    `kind` is one for all masks or a column of `mask`, equal for all pixels of a mask. With m = margin x the larger side of the
    mask's box: `mask` is the mask, `dilated` the mask grown by m sideways, up*m upwards and down*m downwards, `box` its box grown by m, and
    `full` the frame. Runs and boxes come from one pass over the mask.
    """
    keys = list(keys)
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lined = runs(mask.withColumn("_kind", kind), [*keys, "_kind"])
    of_mask = Window.partitionBy(*keys)
    box = lined.groupBy(*keys).agg(F.first("_kind").alias("kind"), *[f(c).alias(n) for n, f, c in (("bx0", F.min, "x0"), ("by0", F.min, "y"), ("bx1", F.max, "x1"), ("by1", F.max, "y"))])
    m = F.greatest(rint_i(F.greatest(F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0")) * F.lit(float(margin))), F.lit(0))
    box = attach(box, images.select("image_id", "width", "height"), ["image_id"]).withColumn("m", m)
    whole = box.where(F.col("kind").isin("box", "full")).select(*keys, F.when(F.col("kind") == "box", F.struct(*_clipped(F.col("m"), F.col("m"), F.col("m"), "by0", "by1", "bx0", "bx1")))
                                                                .otherwise(F.struct(*_rect(F.lit(0), F.col("height") - 1, F.lit(0), F.col("width") - 1))).alias("r")).select(*keys, "r.*")
    per_run = attach(lined.where(F.col("_kind").isin("mask", "dilated")), box.where(F.col("kind").isin("mask", "dilated")), keys)
    grow = [F.when(F.col("kind") == "dilated", v).otherwise(0) for v in (F.col("m"), rint_i(F.col("m") * up), rint_i(F.col("m") * down))]
    return whole.unionByName(per_run.select(*keys, *_clipped(*grow, "y", "y", "x0", "x1")))


def lines_of(region: DataFrame, keys=KEYS) -> DataFrame:
    return region.select(*keys, F.explode(F.sequence("y0", "y1")).alias("y"), "x0", "x1")


def _as_rows(lines: DataFrame, keys) -> DataFrame:
    return lines.select(*keys, *_rect(F.col("y"), F.col("y"), F.col("x0"), F.col("x1")))


def disjoint(region: DataFrame, keys=KEYS) -> DataFrame:
    """The same region as lines of which no two overlap or touch."""
    lines = lines_of(region, keys)
    far = Window.partitionBy(*keys, "y").orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.col("x0") > F.max("x1").over(far) + 1, F.lit(True))
    named = lines.withColumn("_new", new.cast("int")).withColumn("_g", F.sum("_new").over(far.rowsBetween(Window.unboundedPreceding, 0)))
    return _as_rows(named.groupBy(*keys, "y", "_g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")), keys)


def union(a: DataFrame, b: DataFrame, keys=KEYS) -> DataFrame:
    return disjoint(a.select(*keys, *RECT).unionByName(b.select(*keys, *RECT)), keys)


def _both(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    mark = lambda r, left: lines_of(disjoint(r, keys), keys).withColumns({"a": F.lit(left), "b": F.lit(1 - left)})
    return swept(mark(a, 1).unionByName(mark(b, 0)), list(keys), "a", "b")


def intersection(a: DataFrame, b: DataFrame, keys=KEYS) -> DataFrame:
    """Disjoint lines of what both regions hold."""
    return _as_rows(_both(a, b, keys).where("_n_a > 0 and _n_b > 0"), keys)


def difference(a: DataFrame, b: DataFrame, keys=KEYS) -> DataFrame:
    """Lines of `a` without `b`; two of them may touch, none overlap."""
    return _as_rows(_both(a, b, keys).where("_n_a > 0 and _n_b = 0"), keys)


def area(region: DataFrame, keys=KEYS) -> DataFrame:
    """Pixels of each region, those under several rows counted once."""
    return disjoint(region, keys).groupBy(*keys).agg(F.sum((F.col("x1") - F.col("x0") + 1).cast("bigint")).alias("area"))


def pixels(region: DataFrame, keys=KEYS) -> DataFrame:
    """Pixels of a region, each once."""
    return disjoint(region, keys).select(*keys, F.col("y0").alias("y"), F.explode(F.sequence("x0", "x1")).alias("x"))


def outside(px: DataFrame, region: DataFrame, keys=("image_id",)) -> DataFrame:
    """The rows of `px` (keys, y, x, …) that lie in no row of the region.

    Rows and intervals of a line are swept together: a pixel is covered if an interval that began no later reaches it. Nothing is spelled out.
    """
    cols = px.columns
    on_line = px.select(*keys, "y", F.col("x").alias("_x"), F.struct(*cols).alias("_px"), F.lit(None).cast("int").alias("_end"))
    ends = lines_of(region, keys).select(*keys, "y", F.col("x0").alias("_x"), F.lit(None).cast(on_line.schema["_px"].dataType).alias("_px"), F.col("x1").alias("_end"))
    # at equal places the interval comes first: nulls of _px sort before pixels
    line = Window.partitionBy(*keys, "y").orderBy("_x", F.col("_px").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max("_end").over(line)
    return on_line.unionByName(ends).withColumn("_reach", reach).where("_px is not null and (_reach is null or _reach < _x)").select("_px.*")
