"""Point maps and clouds: plane fits, projection, nearest-wins grids and depth probes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.numeric import clip, floor_div, rint_i
from ..scale import GROUP_ROWS, attach, quantiles, settle, skew_join

P, C, N, U, V = (("px", "py", "pz"), ("c_x", "c_y", "c_z"), ("n_x", "n_y", "n_z"), ("u_x", "u_y", "u_z"), ("v_x", "v_y", "v_z"))
PLANE = [*C, *N, *U, *V]


def _moments(x: str, y: str, z: str) -> list[Column]:
    pairs = {"xx": (x, x), "xy": (x, y), "xz": (x, z), "yy": (y, y), "yz": (y, z), "zz": (z, z)}
    return [F.count("*").alias("n_points"), *[F.avg(a).alias(c) for a, c in zip((x, y, z), C)],
            *[F.covar_pop(a, b).alias(f"_{k}") for k, (a, b) in pairs.items()]]


# The closed form as one select list; each line may use the aliases of the lines above it.
_AXIS = """
greatest(_xx + _yy + _zz, 1e-300D) as _tr
_xx/_tr as _qxx
_xy/_tr as _qxy
_xz/_tr as _qxz
_yy/_tr as _qyy
_yz/_tr as _qyz
_zz/_tr as _qzz
_qxx - 1D/3D as _a
_qyy - 1D/3D as _d
_qzz - 1D/3D as _f
sqrt((_a*_a + _d*_d + _f*_f + 2D*(_qxy*_qxy + _qxz*_qxz + _qyz*_qyz)) / 6D) as _s
_a*(_d*_f - _qyz*_qyz) - _qxy*(_qxy*_f - _qyz*_qxz) + _qxz*(_qxy*_qyz - _d*_qxz) as _det
acos(least(greatest(_det / greatest(2D*_s*_s*_s, 1e-300D), -1D), 1D)) as _angle
1D/3D + 2D*_s*cos(_angle/3D + 2.0943951023931953D) as _l
_qxx - _l as _la
_qyy - _l as _ld
_qzz - _l as _lf
array(_qxy*_qyz - _qxz*_ld, _qxz*_qxy - _la*_qyz, _la*_ld - _qxy*_qxy) as _k0
array(_qxy*_lf - _qxz*_qyz, _qxz*_qxz - _la*_lf, _la*_qyz - _qxy*_qxz) as _k1
array(_ld*_lf - _qyz*_qyz, _qyz*_qxz - _qxy*_lf, _qxy*_qyz - _ld*_qxz) as _k2
greatest(struct(_k0[0]*_k0[0] + _k0[1]*_k0[1] + _k0[2]*_k0[2] as l, _k0 as k), struct(_k1[0]*_k1[0] + _k1[1]*_k1[1] + _k1[2]*_k1[2] as l, _k1 as k), struct(_k2[0]*_k2[0] + _k2[1]*_k2[1] + _k2[2]*_k2[2] as l, _k2 as k)) as _k
if(_k.k[1] > 0, -1D, 1D) / sqrt(greatest(_k.l, 1e-300D)) as _w
_k.k[0]*_w as n_x
_k.k[1]*_w as n_y
_k.k[2]*_w as n_z
greatest(sqrt((1D-n_x*n_x)*(1D-n_x*n_x) + n_y*n_x*n_y*n_x + n_z*n_x*n_z*n_x), 1e-150D) as _m
(1D-n_x*n_x)/_m as u_x
-n_y*n_x/_m as u_y
-n_z*n_x/_m as u_z
n_y*u_z - n_z*u_y as v_x
n_z*u_x - n_x*u_z as v_y
n_x*u_y - n_y*u_x as v_z
""".strip().splitlines()


def _plane_of(m: DataFrame, keys: list[str]) -> DataFrame:
    """Plane from the moments of a scene: centre, normal with n_y <= 0, u along the projected x axis, v = n x u.

    The normal is the eigenvector of the smallest eigenvalue of the covariance matrix, in closed form: the matrix is
    scaled to trace 1, the eigenvalue comes from the trigonometric form, and the vector is the longest cross product of
    two rows of (A - lambda I), since any one of the three products may vanish.
    """
    return m.selectExpr("*", *_AXIS).select(*keys, "n_points", *PLANE)


def fit_plane(points: DataFrame, keys=("scene_id",), xyz=P) -> DataFrame:
    """Total least squares plane per scene from one aggregate of means and covariances."""
    return _plane_of(points.groupBy(*keys).agg(*_moments(*xyz)), list(keys))


def residual(xyz=P) -> Column:
    return F.abs(G.height_above(G.vec(*xyz), G.vec(*C), G.vec(*N)))


def fit_plane_trimmed(points: DataFrame, keys=("scene_id",), q: float = 0.8, rounds: int = 2) -> DataFrame:
    """Refit on the points whose distance to the current plane is below the q-quantile of all distances.

    Only one small row per scene passes from round to round; each is written, so a round scans the points and nothing
    before them.
    """
    keys = list(keys)
    plane = settle(fit_plane(points, keys), "plane")
    largest = plane.agg(F.max("n_points")).first()[0] or 0
    for _ in range(rounds):
        d = attach(points, plane, keys).withColumn("_d", residual()).drop(*PLANE, "n_points")
        limit = quantiles(d, keys, "_d", {"_limit": q}, largest=largest)
        inliers = attach(d, limit, keys).where(F.col("_d") < F.col("_limit"))
        plane = settle(fit_plane(inliers, keys), "plane")
    return plane


def plane_residual_cm(points: DataFrame, planes: DataFrame, keys=("scene_id",)) -> DataFrame:
    """Median distance of all points to the plane, in cm with 2 places."""
    keys = list(keys)
    d = attach(points, planes, keys).select(*keys, residual().alias("_d"))
    return quantiles(d, keys, "_d", {"_m": 0.5}).select(*keys, F.bround(F.col("_m") * 100, 2).alias("plane_residual_cm"))


def heights(points: DataFrame, planes: DataFrame, keys=("scene_id",)) -> DataFrame:
    """Signed height above the plane and the mirrored point."""
    joined = attach(points, planes, list(keys))
    h = G.height_above(G.vec(*P), G.vec(*C), G.vec(*N))
    out = joined.withColumn("h", h)
    return out.withColumns(dict(zip(("mx", "my", "mz"), G.mirror(G.vec(*P), F.col("h"), G.vec(*N))))).drop(*PLANE, "n_points")


LENS, FRAME = ("fx", "fy", "cx", "cy"), ("width", "height")


def with_camera(rows: DataFrame, camera: dict | DataFrame, keys=("scene_id",), width=None, height=None) -> tuple[DataFrame, dict[str, Column]]:
    """`rows` and where to find what they are seen by: numbers that hold for all of them, or columns joined from a table.

    A table of cameras has one row a scene: `keys`, fx, fy, cx, cy and, unless given here, the frame's width and height. Its columns are
    attached under names of their own, broadcast while the table is small. Rows of scenes without a camera are left out.
    """
    if isinstance(camera, dict):
        given = {**{c: F.lit(float(camera[c])) for c in LENS}, **{c: F.lit(v) for c, v in zip(FRAME, (width, height)) if v is not None}}
        return rows, given
    names = [*LENS, *[c for c in FRAME if c in camera.columns]]
    seen = attach(rows, camera.select(*keys, *[F.col(c).alias(f"_cam_{c}") for c in names]), list(keys))
    given = {c: F.lit(v) for c, v in zip(FRAME, (width, height)) if v is not None}
    return seen, {**{c: F.col(f"_cam_{c}") for c in names}, **given}


def _without_camera(df: DataFrame) -> DataFrame:
    return df.drop(*[f"_cam_{c}" for c in (*LENS, *FRAME)])


def project(points: DataFrame, camera: dict | DataFrame, width=None, height=None, xyz=P, near: float = 1e-3, keys=("scene_id",)) -> DataFrame:
    """Points in front of their camera that fall on the frame, with their pixel (x, y); see `with_camera`."""
    seen, cam = with_camera(points.where(F.col(xyz[2]) > near), camera, keys, width, height)
    fx, fy = G.project(G.vec(*xyz), *[cam[c] for c in LENS])
    on = seen.withColumns({"x": rint_i(fx), "y": rint_i(fy)})
    return _without_camera(on.where((F.col("x") >= 0) & (F.col("x") < cam["width"]) & (F.col("y") >= 0) & (F.col("y") < cam["height"])))


def ray_plane(pixels: DataFrame, planes: DataFrame, camera: dict | DataFrame, keys=("image_id",)) -> DataFrame:
    """Where the ray of each pixel meets the plane: depth t and metric plane coordinates (pu, pv); see `with_camera`."""
    j, cam = with_camera(attach(pixels, planes, list(keys)), camera, keys)
    r = G.ray("y", "x", *[cam[c] for c in LENS])
    c = G.vec(*C)
    j = j.withColumn("t", G.ray_plane_depth(r, c, G.vec(*N)))
    rel = tuple(a * F.col("t") - b for a, b in zip(r, c))
    return _without_camera(j.withColumns({"pu": G.dot(rel, G.vec(*U)), "pv": G.dot(rel, G.vec(*V))}).drop(*PLANE, "n_points"))


def zbuffer(cells: DataFrame, keys: list[str], depth: str, payload: list[str], tie: list[str]) -> DataFrame:
    """The nearest row of each cell with its payload; equal depths are decided by `tie`. Combined map-side."""
    best = cells.groupBy(*keys).agg(F.min(F.struct(depth, *tie, *[p for p in payload if p not in tie])).alias("b"))
    return best.select(*keys, F.col(f"b.{depth}").alias(depth), *[F.col(f"b.{p}").alias(p) for p in dict.fromkeys([*tie, *payload])])


def nearest_wins_grid(points: DataFrame, camera: dict | DataFrame, width, height, payload: list[str], tie: list[str],
                      xyz=P, keys=("scene_id",)) -> DataFrame:
    """Project points to pixels and keep the nearest of each pixel."""
    return zbuffer(project(points, camera, width, height, xyz, keys=keys), [*keys, "y", "x"], xyz[2], payload, tie)


def points_in_box(pixels: DataFrame, boxes: DataFrame, tile: int = 64, hot_rows: int = GROUP_ROWS) -> DataFrame:
    """Pixels inside each half-open box of the same image.

    Boxes are cut into tiles and joined on (image, tile), so a frame with many boxes is not compared with all of them. A
    tile has at most tile x tile pixels; a tile that very many boxes share is salted.
    """
    def tiles(lo, hi):
        return F.sequence(floor_div(lo, F.lit(tile)), floor_div(hi - 1, F.lit(tile)))
    cut = (boxes.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
           .withColumn("_ty", F.explode(tiles(F.col("y0"), F.col("y1")))).withColumn("_tx", F.explode(tiles(F.col("x0"), F.col("x1")))))
    at = pixels.withColumns({"_ty": floor_div("y", F.lit(tile)), "_tx": floor_div("x", F.lit(tile))})
    # without the hint a small file that is exploded to pixels would count as small enough to be broadcast
    hit = skew_join(cut, at.hint("merge"), ["image_id", "_ty", "_tx"], hot_rows=hot_rows)
    return hit.where((F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))).drop("_ty", "_tx")


def depth_probe(depth: DataFrame, anchors: DataFrame, r: int = 6) -> DataFrame:
    """Median depth in a (2r+1)^2 window around the source and target of each move, and the resulting scale.

    Valid pixels decide if there are any. Every move has a row: an end without any depth in its window leaves depth and
    scale null, and `error` says so. Windows are cut into tiles as in `points_in_box`, so they are not spelled out before the join.
    """
    ends = anchors.select("move_id", "image_id", F.explode(F.array(
        F.struct(F.lit("src").alias("end"), F.col("src_x").alias("ax"), F.col("src_y").alias("ay")),
        F.struct(F.lit("dst").alias("end"), F.col("dst_x").alias("ax"), F.col("dst_y").alias("ay")))).alias("e"))
    at = ends.select("move_id", "image_id", "e.end", *[(F.col(f"e.a{c}") + d).cast("int").alias(f"{c}{i}") for c in "yx" for i, d in ((0, -r), (1, r + 1))])
    seen = points_in_box(depth, at, tile=16)
    med = seen.groupBy("move_id", "end").agg(F.median(F.when(F.col("valid"), F.col("z"))).alias("mv"), F.median("z").alias("ma"))
    z = F.coalesce("mv", "ma")
    both = med.groupBy("move_id").agg(F.max(F.when(F.col("end") == "src", z)).alias("z_src"), F.max(F.when(F.col("end") == "dst", z)).alias("z_dst"))
    all_ = anchors.select("move_id").join(both, "move_id", "left")
    known = F.col("z_src").isNotNull() & F.col("z_dst").isNotNull()
    return all_.withColumns({"scale": F.when(known, clip(F.col("z_src") / F.greatest("z_dst", F.lit(1e-3)), 0.25, 4.0)),
                             "error": F.when(~known, "no depth at an end of the move")})


def environment_mean(pixels: DataFrame, keys=("scene_id",), channels=("r", "g", "b"), min_h: float = 0.3, min_rows: int = 100,
                     fallback: float = 0.1) -> DataFrame:
    """Mean colour of what stands above the plane; of all off-plane rows if that is too little; else a constant.

    Needs columns valid, on_plane and h (signed height).
    """
    above = F.col("valid") & ~F.col("on_plane") & (F.col("h") > min_h)
    aggs = [F.count_if(above).alias("_n")]
    for c in channels:
        aggs += [F.avg(F.when(above, F.col(c))).alias(f"_a{c}"), F.avg(F.when(~F.col("on_plane"), F.col(c))).alias(f"_o{c}")]
    m = pixels.groupBy(*keys).agg(*aggs)
    return m.select(*keys, F.col("_n").alias("n_above"), *[
        F.coalesce(F.when(F.col("_n") > min_rows, F.col(f"_a{c}")).otherwise(F.col(f"_o{c}")), F.lit(fallback)).alias(c) for c in channels])
