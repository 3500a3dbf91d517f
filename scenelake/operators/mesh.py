"""Meshes as vertex and face tables, and splat clouds."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.colour import sh_to_u8, sigmoid
from ..functions.numeric import clip
from ..scale import attach, skew_join
from .points import zbuffer

XYZ = ("x", "y", "z")


def rigid_transform(df: DataFrame, rotation: list[list[float]], translation=(0.0, 0.0, 0.0), xyz=XYZ) -> DataFrame:
    """p -> R p + t with the matrix as literals."""
    p = G.vec(*xyz)
    return df.withColumns({a: p[0] * float(r[0]) + p[1] * float(r[1]) + p[2] * float(r[2]) + float(t)
                           for a, r, t in zip(xyz, rotation, translation)})


def projection_matrix(fx: float, fy: float, cx: float, cy: float, near: float, far: float) -> list[list[float]]:
    """Clip-space projection of normalised intrinsics."""
    return [[2 * fx, 0.0, 2 * cx - 1, 0.0], [0.0, 2 * fy, -2 * cy + 1, 0.0],
            [0.0, 0.0, far / (far - near), near * far / (near - far)], [0.0, 0.0, 1.0, 0.0]]


def _times(m: Column, row: int, p: G.Vec) -> Column:
    e = [m[row * 4 + i] for i in range(4)]
    return e[0] * p[0] + e[1] * p[1] + e[2] * p[2] + e[3]


def apply_pose(df: DataFrame, poses: list[list[list[float]]], projection: list[list[float]], res: int, xyz=XYZ) -> DataFrame:
    """All points seen by each of a short list of 4x4 camera poses: pixel (sx, sy), camera depth and pose_id."""
    def flat(m):
        return F.array(*[F.lit(float(v)) for r in m for v in r])

    def product(a, b):
        return [[sum(a[i][k] * b[k][j] for k in range(4)) for j in range(4)] for i in range(4)]
    table = F.array(*[F.struct(F.lit(i).alias("pose_id"), flat(m).alias("view"), flat(product(projection, m)).alias("clip")) for i, m in enumerate(poses)])
    j = df.select("*", F.explode(table).alias("p"))
    p = G.vec(*xyz)
    m = F.col("p.clip")
    w = F.greatest(_times(m, 3, p), F.lit(1e-8))
    return j.select(*df.columns, F.col("p.pose_id").alias("pose_id"), ((_times(m, 0, p) / w * 0.5 + 0.5) * res).alias("sx"),
                    ((F.lit(0.5) - _times(m, 1, p) / w * 0.5) * res).alias("sy"), _times(F.col("p.view"), 2, p).alias("depth"))


def faces_with_vertices(faces: DataFrame, vertices: DataFrame, attrs=XYZ, keys=("mesh_id",), hot_rows: int = 1_000_000) -> DataFrame:
    """Each face with the attributes of its corners as <attr>0, <attr>1, <attr>2.

    The corners are stacked and joined once instead of three times; a vertex shared by very many faces is salted.
    """
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("vid")) for i in range(3)])).alias("c")
    stacked = faces.select(*keys, "fid", corner).select(*keys, "fid", "c.i", "c.vid")
    joined = skew_join(stacked, vertices.select(*keys, "vid", *attrs), [*keys, "vid"], hot_rows=hot_rows)
    at = [F.max(F.when(F.col("i") == i, F.col(a))).alias(f"{a}{i}") for a in attrs for i in range(3)]
    ids = [F.max(F.when(F.col("i") == i, F.col("vid"))).alias(f"v{i}") for i in range(3)]
    return joined.groupBy(*keys, "fid").agg(*ids, *at)


def _corners() -> list[G.Vec]:
    return [G.vec(f"x{i}", f"y{i}", f"z{i}") for i in range(3)]


def face_normals(wide: DataFrame, unit: bool = True, eps: float = 1e-9) -> DataFrame:
    """Cross product of two edges of each face; its length is twice the area unless `unit`."""
    a, b, c = _corners()
    k = G.cross(G.minus(b, a), G.minus(c, a))
    out = wide.withColumns(dict(zip(("nx", "ny", "nz"), k)))
    if not unit:
        return out
    length = F.greatest(G.norm(G.vec("nx", "ny", "nz")), F.lit(eps))
    return out.withColumn("_l", length).withColumns({n: F.col(n) / F.col("_l") for n in ("nx", "ny", "nz")}).drop("_l")


def vertex_normals(faces: DataFrame, vertices: DataFrame, keys=("mesh_id",)) -> DataFrame:
    """Area-weighted vertex normals; a vertex whose faces cancel out keeps the zero vector."""
    raw = face_normals(faces_with_vertices(faces, vertices, keys=keys), unit=False)
    per = raw.select(*keys, F.explode(F.array("v0", "v1", "v2")).alias("vid"), "nx", "ny", "nz")
    s = per.groupBy(*keys, "vid").agg(*[F.sum(n).alias(n) for n in ("nx", "ny", "nz")])
    length = G.norm(G.vec("nx", "ny", "nz"))
    return s.withColumn("_l", length).withColumns({n: F.when(F.col("_l") > 0, F.col(n) / F.col("_l")).otherwise(F.lit(0.0)) for n in ("nx", "ny", "nz")}).drop("_l")


def normalise_mesh(vertices: DataFrame, keys=("mesh_id",), by: str = "norm") -> DataFrame:
    """Centre each mesh on its box and scale it into the unit sphere (`by='norm'`) or the unit cube (`by='extent'`)."""
    keys = list(keys)
    box = vertices.groupBy(*keys).agg(*[((F.min(a) + F.max(a)) / 2).alias(f"_m{a}") for a in XYZ])
    centred = attach(vertices, box, keys).withColumns({a: F.col(a) - F.col(f"_m{a}") for a in XYZ}).drop(*[f"_m{a}" for a in XYZ])
    size = G.norm(G.vec(*XYZ)) if by == "norm" else F.greatest(*[F.abs(F.col(a)) for a in XYZ])
    longest = centred.groupBy(*keys).agg(F.greatest(F.max(size), F.lit(1e-6)).alias("_s"))
    return attach(centred, longest, keys).withColumns({a: F.col(a) / F.col("_s") for a in XYZ}).drop("_s")


def grid_raster(triangles: DataFrame, res: int, keys=("mesh_id",), attrs=(), block: int = 64) -> DataFrame:
    """Winning face of every grid cell a triangle covers, with barycentrics, depth and interpolated attributes.

    Needs sx0..sx2, sy0..sy2 (grid coordinates) and z0..z2. A triangle is cut into blocks that are spread over the
    cluster before they are expanded to cells, so one huge triangle does not become one huge task.
    """
    c = F.col
    area = (c("sx1") - c("sx0")) * (c("sy2") - c("sy0")) - (c("sx2") - c("sx0")) * (c("sy1") - c("sy0"))
    t = triangles.withColumn("_area", area).where((F.abs(c("_area")) > 1e-12) & (F.least("z0", "z1", "z2") > 0))

    def bound(f, side, a):
        return clip(side(f(f"s{a}0"), f(f"s{a}1"), f(f"s{a}2")), 0, res - 1).cast("int")
    for a in "xy":
        t = t.withColumns({f"_{a}lo": bound(F.floor, F.least, a), f"_{a}hi": bound(F.ceil, F.greatest, a)})
    for a in "yx":
        t = t.withColumn(f"_b{a}", F.explode(F.sequence(F.floor(c(f"_{a}lo") / block), F.floor(c(f"_{a}hi") / block))))
    t = t.repartition(*keys, "fid", "_by", "_bx")
    for a in "yx":
        first = F.greatest(c(f"_{a}lo"), (c(f"_b{a}") * block).cast("int"))
        last = F.least(c(f"_{a}hi"), (c(f"_b{a}") * block + block - 1).cast("int"))
        t = t.withColumn(a, F.explode(F.sequence(first, last)))
    fx, fy = c("x") + 0.5, c("y") + 0.5
    l2 = ((c("sx1") - c("sx0")) * (fy - c("sy0")) - (fx - c("sx0")) * (c("sy1") - c("sy0"))) / c("_area")
    l1 = ((fx - c("sx0")) * (c("sy2") - c("sy0")) - (c("sx2") - c("sx0")) * (fy - c("sy0"))) / c("_area")
    t = t.withColumns({"l1": l1, "l2": l2}).withColumn("l0", F.lit(1.0) - c("l1") - c("l2"))
    t = t.where((c("l0") >= 0) & (c("l1") >= 0) & (c("l2") >= 0))

    def mix(a):
        return c("l0") * c(f"{a}0") + c("l1") * c(f"{a}1") + c("l2") * c(f"{a}2")
    t = t.withColumns({"depth": mix("z"), **{a: mix(a) for a in attrs}})
    return zbuffer(t, [*keys, "y", "x"], "depth", ["l0", "l1", "l2", *attrs], ["fid"])


def splat_points(splats: DataFrame, min_opacity: float = 0.1) -> DataFrame:
    """Splats to coloured points: logit opacity to alpha, first colour band to 8-bit RGB, `keep` for visible ones."""
    out = splats.withColumn("alpha", sigmoid("opacity"))
    rgb = {n: sh_to_u8(F.col("f_dc")[i]) for i, n in enumerate(("red", "green", "blue"))}
    return out.withColumns(rgb).withColumn("keep", F.col("alpha") >= min_opacity)


def splat_filter_report(splats: DataFrame, min_opacity: float = 0.1, keys=("asset_id",)) -> DataFrame:
    keep = sigmoid("opacity") >= min_opacity
    return splats.groupBy(*keys).agg(F.count_if(keep).alias("points"), F.count_if(~keep).alias("dropped"))


def mesh_report(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Per mesh: vertex and face counts, extent and the number of vertices without a direction."""
    v = vertices.groupBy("mesh_id").agg(F.count("*").alias("vertices"), *[(F.max(a) - F.min(a)).alias(f"extent_{a}") for a in XYZ])
    f = faces.groupBy("mesh_id").agg(F.count("*").alias("faces"))
    n = vertex_normals(faces, vertices).groupBy("mesh_id").agg(
        F.count_if((F.col("nx") == 0) & (F.col("ny") == 0) & (F.col("nz") == 0)).alias("flat_vertices"))
    return v.join(f, "mesh_id", "left").join(n, "mesh_id", "left")
