"""Points, planes, light, textures, meshes and voxels."""

from pyspark.sql import functions as F

from ..functions import colour as K
from ..functions.numeric import r6, u8_round, u8_trunc
from ..operators import light as L
from ..operators import mesh as ME
from ..operators import points as P
from ..operators import texture as TX
from ..operators import voxel_blocks as VB
from ..sources.sinks import to_yup
from . import tables as X
from .catalog import query

CAM, W, H = X.CAMERA, X.WIDTH, X.HEIGHT


def rounded(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


def r(e, name=None):
    return f"round({e}, 6) + 0.0::double as {name or e}"


LUM = "(0.2126::double*r + 0.7152::double*g + 0.0722::double*b)"


# ---- colour
@query("p1_gamma", "select image_id, y, x, " + ", ".join(
    [r(f"pow(greatest({c},0), 2.2)", f"lin_{c}") for c in "rgb"] + [r(f"pow(greatest({c},0), 1/2.2::double)", f"enc_{c}") for c in "rgb"]) + " from fx_rgb")
def _(spark, sf):
    return X.rgb(spark, sf).select("image_id", "y", "x", *[r6(K.to_linear(c)).alias(f"lin_{c}") for c in "rgb"],
                                   *[r6(K.to_srgb(c)).alias(f"enc_{c}") for c in "rgb"])


@query("p2_luminance", f"select image_id, y, x, {r(LUM, 'lum')}, {r('0.299::double*r + 0.587::double*g + 0.114::double*b', 'luma')} from fx_rgb")
def _(spark, sf):
    return X.rgb(spark, sf).select("image_id", "y", "x", r6(K.luminance()).alias("lum"), r6(K.luma()).alias("luma"))


@query("p15_quantise_u8", """select image_id, y, x, trunc(least(greatest(r,0),1)*255)::int as r_trunc, trunc(least(greatest(r*255+0.5,0),255))::int as r_round,
trunc(least(greatest(r*255+0.5,0),255))::int - trunc(least(greatest(g*255+0.5,0),255))::int as diff from fx_rgb""")
def _(spark, sf):
    return X.rgb(spark, sf).select("image_id", "y", "x", u8_trunc("r").alias("r_trunc"), u8_round("r").alias("r_round"),
                                   (u8_round("r") - u8_round("g")).alias("diff"))


PASSES = [{"mirrored": False, "contrast": 1.05, "brightness": -0.02}, {"mirrored": True, "contrast": 0.93, "brightness": 0.04}]


@query("p16_augment", """
select image_id, p::int as pass_id, p=1 as mirrored, y, (case when p=1 then 21-x else x end)::int as x, """ + ", ".join(
    f"trunc(least(greatest(({c}-0.5::double)*(case p when 0 then 1.05::double else 0.93::double end)+0.5::double+(case p when 0 then -0.02::double else 0.04::double end),0),1)*255)::int as {c}_u8" for c in "rgb")
    + " from fx_rgb, unnest(range(2)) t(p)")
def _(spark, sf):
    return L.augment(X.rgb(spark, sf), PASSES, F.lit(X.RGB_WIDTH))


@query("p17_safe_ratio", f"""select image_id, y, x, round(case when {LUM} < 0.35 then b else r/greatest(g, 0.05) end, 6) as e from fx_rgb""")
def _(spark, sf):
    return X.rgb(spark, sf).select("image_id", "y", "x", r6(K.safe_ratio("r", "g", K.luminance() < 0.35, "b")).alias("e"))


# ---- projection
@query("p7_tile_uv", f"""
select scene_id, point_id, {r("(((px-25)/0.6::double + 0.5) % 1.0 + 1.0) % 1.0 * 499", 'tu')},
{r("(((py-50)/(0.6::double*(300/500.0::double)) + 0.5) % 1.0 + 1.0) % 1.0 * 299", 'tv')} from fx_points""")
def _(spark, sf):
    tu, tv = TX.tile_uv(F.col("px") - 25, F.col("py") - 50, 0.6, F.lit(500.0), F.lit(300.0))
    return X.points(spark, sf).select("scene_id", "point_id", r6(tu).alias("tu"), r6(tv).alias("tv"))


PROJ = """proj as (select scene_id, point_id, px, py, pz, round_even(px/10/pz*20+32, 0)::int as x, round_even(py/20/pz*20+25, 0)::int as y from fx_points where pz > 1e-3)"""


def _scaled(spark, sf):
    return X.points(spark, sf).withColumns({"qx": F.col("px") / 10, "qy": F.col("py") / 20})


@query("p8_project", f"with {PROJ} select scene_id, point_id, x, y from proj where x between 0 and 63 and y between 0 and 49")
def _(spark, sf):
    return P.project(_scaled(spark, sf), CAM, W, H, ("qx", "qy", "pz")).select("scene_id", "point_id", "x", "y")


RAYS = """rays as (select d.image_id, d.y, d.x, v, (x-32)/20.0::double as rx, (y-25)/20.0::double as ry, p.* exclude image_id from fx_raster d join fx_planes p using (image_id)),
den as (select *, rx*n_x + ry*n_y + n_z as den, c_x*n_x + c_y*n_y + c_z*n_z as num from rays),
tt as (select *, num / case when abs(den) < 1e-6 then 1e-6 else den end as t from den),
plane_uv as (select image_id, y, x, v, t, (rx*t-c_x)*u_x + (ry*t-c_y)*u_y + (t-c_z)*u_z as pu, (rx*t-c_x)*v_x + (ry*t-c_y)*v_y + (t-c_z)*v_z as pv from tt)"""


@query("p9_ray_plane", f"with {RAYS} select image_id, y, x, {r('t')}, {r('pu')}, {r('pv')} from plane_uv")
def _(spark, sf):
    out = P.ray_plane(X.raster(spark, sf), X.planes(spark, sf), CAM)
    return rounded(out.select("image_id", "y", "x", "t", "pu", "pv"), "t", "pu", "pv")


CAMERAS = "cam as (select distinct scene_id, (case scene_id when 'A' then 20 else 14 end)::double as fx, 18.0::double as fy, (case scene_id when 'N' then 30 else 32 end)::double as cx, 25.0::double as cy, (case scene_id when 'R' then 40 else 64 end)::int as width, 50::int as height from fx_points)"
SEEN = f"""{CAMERAS}, proj as (select scene_id, point_id, px, py, pz, width, height, round_even(px/10/pz*fx+cx, 0)::int as x, round_even(py/20/pz*fy+cy, 0)::int as y from fx_points join cam using (scene_id) where pz > 1e-3)"""


def _cameras(spark, sf):
    """A camera and a frame size for each scene."""
    s = X.points(spark, sf).select("scene_id").distinct()
    of = lambda which, a, b: F.when(F.col("scene_id") == which, a).otherwise(b)
    return s.select("scene_id", of("A", 20.0, 14.0).alias("fx"), F.lit(18.0).alias("fy"), of("N", 30.0, 32.0).alias("cx"), F.lit(25.0).alias("cy"), of("R", 40, 64).alias("width"), F.lit(50).alias("height"))


@query("p8_project_cameras", f"with {SEEN} select scene_id, point_id, x, y from proj where x between 0 and width-1 and y between 0 and height-1")
def _(spark, sf):
    return P.project(_scaled(spark, sf), _cameras(spark, sf), xyz=("qx", "qy", "pz")).select("scene_id", "point_id", "x", "y")


@query("j14_nearest_wins_cameras", f"""with {SEEN} select scene_id, y, x, min(pz) as pz, arg_min(point_id, (pz, point_id)) as point_id, arg_min(px, (pz, point_id)) as px
from proj where x between 0 and width-1 and y between 0 and height-1 group by 1, 2, 3""")
def _(spark, sf):
    return P.nearest_wins_grid(_scaled(spark, sf), _cameras(spark, sf), None, None, ["px"], ["point_id"], ("qx", "qy", "pz"))


RAYS_SEEN = RAYS.replace("(x-32)/20.0::double as rx, (y-25)/20.0::double as ry", "(x-(30+image_id%2*2))/(16+image_id%2*4)::double as rx, (y-25)/18.0::double as ry")


def _image_cameras(spark, sf):
    odd = F.col("image_id") % 2
    return X.images(spark, sf).select("image_id", (16 + odd * 4).cast("double").alias("fx"), F.lit(18.0).alias("fy"), (30 + odd * 2).cast("double").alias("cx"), F.lit(25.0).alias("cy"))


@query("p9_ray_plane_cameras", f"with {RAYS_SEEN} select image_id, y, x, {r('t')}, {r('pu')}, {r('pv')} from plane_uv")
def _(spark, sf):
    out = P.ray_plane(X.raster(spark, sf), X.planes(spark, sf), _image_cameras(spark, sf))
    return rounded(out.select("image_id", "y", "x", "t", "pu", "pv"), "t", "pu", "pv")


@query("p10_height_mirror", f"""
with h as (select m.image_id, y, x, px, py, pz, (px-c_x)*n_x+(py-c_y)*n_y+(pz-c_z)*n_z as h, n_x, n_y, n_z from fx_point_map m join fx_planes using (image_id))
select image_id, y, x, {r('h')}, {r('px-h*2*n_x', 'mx')}, {r('py-h*2*n_y', 'my')}, {r('pz-h*2*n_z', 'mz')} from h""")
def _(spark, sf):
    out = P.heights(X.point_map(spark, sf), X.planes(spark, sf), ["image_id"]).select("image_id", "y", "x", "h", "mx", "my", "mz")
    return rounded(out, "h", "mx", "my", "mz")


POSES = [[[1.0, 0.0, 0.0, -20.0], [0.0, 1.0, 0.0, -10.0], [0.0, 0.0, 1.0, 50.0], [0.0, 0.0, 0.0, 1.0]],
         [[0.0, 0.0, 1.0, -15.0], [0.0, 1.0, 0.0, -10.0], [-1.0, 0.0, 0.0, 80.0], [0.0, 0.0, 0.0, 1.0]]]
PROJECTION = ME.projection_matrix(1.25, 1.25, 0.5, 0.5, 0.1, 100.0)


@query("p11_rigid_transform", f"""select mesh_id, vid, {r('0.8::double*x + 0.6::double*z + 1', 'x')}, {r('y - 2', 'y')}, {r('0.8::double*z - 0.6::double*x + 0.5', 'z')} from fx_vertices""")
def _(spark, sf):
    rot = [[0.8, 0.0, 0.6], [0.0, 1.0, 0.0], [-0.6, 0.0, 0.8]]
    return rounded(ME.rigid_transform(X.vertices(spark, sf), rot, (1.0, -2.0, 0.5)), "x", "y", "z")


@query("p11_apply_pose", f"""
with c as (select mesh_id, vid, 0::int as pose_id, x-20 as cx, y-10 as cy, z+50 as cz from fx_vertices union all select mesh_id, vid, 1::int, z-15, y-10, 80-x from fx_vertices)
select mesh_id, vid, pose_id, {r('(2.5::double*cx/greatest(cz,1e-8)*0.5+0.5)*64', 'sx')}, {r('(0.5-2.5::double*cy/greatest(cz,1e-8)*0.5)*64', 'sy')}, {r('cz', 'depth')} from c""")
def _(spark, sf):
    out = ME.apply_pose(X.vertices(spark, sf), POSES, PROJECTION, 64)
    return rounded(out.select("mesh_id", "vid", "pose_id", "sx", "sy", "depth"), "sx", "sy", "depth")


@query("p12_splat_points", """select asset_id, x, y, z, round(1/(1+exp(-opacity)), 6) as alpha, """ + ", ".join(
    f"trunc(least(greatest(0.5+0.28209479177387814*f_dc[{i}],0),1)*255)::int as {n}" for i, n in ((1, "red"), (2, "green"), (3, "blue")))
    + ", 1/(1+exp(-opacity)) >= 0.1 as keep from fx_splats")
def _(spark, sf):
    out = ME.splat_points(X.splats(spark, sf)).select("asset_id", "x", "y", "z", "alpha", "red", "green", "blue", "keep")
    return rounded(out, "alpha")


# ---- planes
def plane_sql(src, key, name, xyz=("px", "py", "pz")):
    x, y, z = xyz
    return f"""
{name}_m as (select {key}, count(*) as n_points, avg({x}) as c_x, avg({y}) as c_y, avg({z}) as c_z, covar_pop({x},{x}) as xx, covar_pop({x},{y}) as xy,
  covar_pop({x},{z}) as xz, covar_pop({y},{y}) as yy, covar_pop({y},{z}) as yz, covar_pop({z},{z}) as zz from {src} group by 1),
{name}_t as (select {key}, n_points, c_x, c_y, c_z, xx/(xx+yy+zz) as xx, xy/(xx+yy+zz) as xy, xz/(xx+yy+zz) as xz, yy/(xx+yy+zz) as yy, yz/(xx+yy+zz) as yz, zz/(xx+yy+zz) as zz from {name}_m),
{name}_s as (select *, sqrt(((xx-1/3.0::double)**2+(yy-1/3.0::double)**2+(zz-1/3.0::double)**2+2*(xy*xy+xz*xz+yz*yz))/6) as s from {name}_t),
{name}_d as (select *, ((xx-1/3.0::double)*((yy-1/3.0::double)*(zz-1/3.0::double)-yz*yz) - xy*(xy*(zz-1/3.0::double)-yz*xz) + xz*(xy*yz-(yy-1/3.0::double)*xz))/(s*s*s) as det from {name}_s),
{name}_l as (select *, 1/3.0::double + 2*s*cos(acos(least(greatest(det/2,-1),1))/3 + 2.0943951023931953) as l from {name}_d),
{name}_c as (select *, [
  [xy*yz-xz*(yy-l), xz*xy-(xx-l)*yz, (xx-l)*(yy-l)-xy*xy],
  [xy*(zz-l)-xz*yz, xz*xz-(xx-l)*(zz-l), (xx-l)*yz-xy*xz],
  [(yy-l)*(zz-l)-yz*yz, yz*xz-xy*(zz-l), xy*yz-(yy-l)*xz]] as k from {name}_l),
{name}_n as (select *, list_reduce(k, lambda a, b: case when a[1]*a[1]+a[2]*a[2]+a[3]*a[3] >= b[1]*b[1]+b[2]*b[2]+b[3]*b[3] then a else b end) as w from {name}_c),
{name}_u as (select {key}, n_points, c_x, c_y, c_z, w[1]/sqrt(w[1]**2+w[2]**2+w[3]**2)*(case when w[2]>0 then -1 else 1 end) as n_x,
  w[2]/sqrt(w[1]**2+w[2]**2+w[3]**2)*(case when w[2]>0 then -1 else 1 end) as n_y, w[3]/sqrt(w[1]**2+w[2]**2+w[3]**2)*(case when w[2]>0 then -1 else 1 end) as n_z from {name}_n),
{name}_v as (select *, (1-n_x*n_x)/sqrt((1-n_x*n_x)**2+(n_y*n_x)**2+(n_z*n_x)**2) as u_x, -n_y*n_x/sqrt((1-n_x*n_x)**2+(n_y*n_x)**2+(n_z*n_x)**2) as u_y,
  -n_z*n_x/sqrt((1-n_x*n_x)**2+(n_y*n_x)**2+(n_z*n_x)**2) as u_z from {name}_u),
{name} as (select *, n_y*u_z-n_z*u_y as v_x, n_z*u_x-n_x*u_z as v_y, n_x*u_y-n_y*u_x as v_z from {name}_v)"""


def trimmed_sql(src, key, name, q=0.8):
    out = plane_sql(src, key, f"{name}0")
    for i in (1, 2):
        prev = f"{name}{i - 1}"
        out += f""", {name}_r{i} as (select s.*, abs((px-c_x)*n_x+(py-c_y)*n_y+(pz-c_z)*n_z) as d from {src} s join {prev} using ({key})),
{name}_q{i} as (select {key}, quantile_cont(d, {q}) as lim from {name}_r{i} group by 1),
{name}_i{i} as (select r.* exclude d from {name}_r{i} r join {name}_q{i} using ({key}) where d < lim),""" + plane_sql(f"{name}_i{i}", key, f"{name}{i}")
    return out


PLANE_COLS = ", ".join(r(c) for c in P.PLANE)


@query("a9_fit_plane", f"with {plane_sql('fx_points', 'scene_id', 'pl')} select scene_id, n_points::bigint as n_points, {PLANE_COLS} from pl")
def _(spark, sf):
    return rounded(P.fit_plane(X.points(spark, sf)), *P.PLANE)


@query("a10_fit_plane_trimmed", f"with {trimmed_sql('fx_points', 'scene_id', 'pl')} select scene_id, n_points::bigint as n_points, {PLANE_COLS} from pl2")
def _(spark, sf):
    return rounded(P.fit_plane_trimmed(X.points(spark, sf)), *P.PLANE)


RESID = "select {k}, round_even(median(abs((px-c_x)*n_x+(py-c_y)*n_y+(pz-c_z)*n_z))*100, 2)::double as plane_residual_cm from {s} join {p} using ({k}) group by 1"


@query("a11_plane_residual", f"with {plane_sql('fx_points', 'scene_id', 'pl')} {RESID.format(k='scene_id', s='fx_points', p='pl')}")
def _(spark, sf):
    pts = X.points(spark, sf)
    return P.plane_residual_cm(pts, P.fit_plane(pts))


SCENE = "scene as (select m.* from fx_point_map m join fx_mask k on m.image_id=k.image_id and m.y=k.y and m.x=k.x and k.mask_id=0 where valid)"


@query("c2_scene_plane", f"with {SCENE}, {trimmed_sql('scene', 'image_id', 'pl')}, res as ({RESID.format(k='image_id', s='scene', p='pl2')}) "
       f"select image_id, n_points::bigint as n_points, {', '.join(r(c) for c in P.C + P.N)}, plane_residual_cm from pl2 join res using (image_id)")
def _(spark, sf):
    inside = X.point_map(spark, sf).where("valid").join(X.one_mask(spark, sf), ["image_id", "y", "x"], "left_semi")
    plane = P.fit_plane_trimmed(inside, ["image_id"])
    res = P.plane_residual_cm(inside, plane, ["image_id"])
    return rounded(plane.join(res, "image_id").select("image_id", "n_points", *P.C, *P.N, "plane_residual_cm"), *P.C, *P.N)


# ---- nearest wins
@query("a12_zbuffer", """select scene_id, floor(px/5)::int as cy, floor(py/5)::int as cx, min(pz) as pz, arg_min(point_id, (pz, point_id)) as point_id from fx_points group by 1, 2, 3""")
def _(spark, sf):
    cells = X.points(spark, sf).withColumns({"cy": F.floor(F.col("px") / 5).cast("int"), "cx": F.floor(F.col("py") / 5).cast("int")})
    return P.zbuffer(cells, ["scene_id", "cy", "cx"], "pz", [], ["point_id"])


@query("j14_nearest_wins_grid", f"""with {PROJ} select scene_id, y, x, min(pz) as pz, arg_min(point_id, (pz, point_id)) as point_id, arg_min(px, (pz, point_id)) as px
from proj where x between 0 and 63 and y between 0 and 49 group by 1, 2, 3""")
def _(spark, sf):
    return P.nearest_wins_grid(_scaled(spark, sf), CAM, W, H, ["px"], ["point_id"], ("qx", "qy", "pz"))


@query("j14_mirrored_grid", f"""
with h as (select m.image_id, y, x, px, py, pz, (px-c_x)*n_x+(py-c_y)*n_y+(pz-c_z)*n_z as h, n_x, n_y, n_z from fx_point_map m join fx_planes using (image_id) where valid),
m as (select image_id, y as sy, x as sx, px-h*2*n_x as mx, py-h*2*n_y as my, pz-h*2*n_z as mz from h where h > 0.02),
q as (select image_id, sy, sx, mz, round_even(mx/mz*20+32, 0)::int as x, round_even(my/mz*20+25, 0)::int as y from m where mz > 1e-3)
select image_id, y, x, round(min(mz), 6) as mz, arg_min(sy, (mz, sy, sx)) as sy, arg_min(sx, (mz, sy, sx)) as sx from q where x between 0 and 63 and y between 0 and 49 group by 1, 2, 3""")
def _(spark, sf):
    up = P.heights(X.point_map(spark, sf).where("valid"), X.planes(spark, sf), ["image_id"]).where("h > 0.02")
    up = up.withColumnsRenamed({"y": "sy", "x": "sx"})
    return rounded(P.nearest_wins_grid(up, CAM, W, H, [], ["sy", "sx"], ("mx", "my", "mz"), ["image_id"]), "mz")


# ---- range joins
@query("j10_points_in_box", """select box_id, r.image_id, r.y, r.x from fx_raster r join fx_boxes b on r.image_id = b.image_id
and r.x >= b.x0 and r.x < b.x1 and r.y >= b.y0 and r.y < b.y1""")
def _(spark, sf):
    return P.points_in_box(X.raster(spark, sf), X.boxes(spark, sf), tile=16).select("box_id", "image_id", "y", "x")


@query("j11_depth_probe", """
with e as (select move_id, image_id, 'src' as e, src_x as ax, src_y as ay from fx_anchors union all select move_id, image_id, 'dst', dst_x, dst_y from fx_anchors),
m as (select move_id, e, coalesce(median(z) filter (where valid), median(z)) as z from e join fx_depth d on d.image_id = e.image_id
and d.x between ax-6 and ax+6 and d.y between ay-6 and ay+6 group by 1, 2),
p as (select move_id, max(case when e='src' then z end) as z_src, max(case when e='dst' then z end) as z_dst from m group by 1)
select move_id, round(z_src, 6) as z_src, round(z_dst, 6) as z_dst,
case when z_src is not null and z_dst is not null then round(least(greatest(z_src/greatest(z_dst, 1e-3), 0.25), 4), 6) end as scale,
case when z_src is null or z_dst is null then 'no depth at an end of the move' end as error from fx_anchors left join p using (move_id)""")
def _(spark, sf):
    return rounded(P.depth_probe(X.depth(spark, sf), X.anchors(spark, sf)), "z_src", "z_dst", "scale")


# ---- light
@query("a13_percentile_normalise", f"""with q as (select image_id, quantile_cont(v, 0.9) as ref from fx_raster where v > 0.05 group by 1)
select image_id, y, x, {r('case when ref is not null then least(greatest(v/greatest(ref, 1e-3), 0), 1.15) end', 'norm')} from fx_raster left join q using (image_id)""")
def _(spark, sf):
    out = L.percentile_normalise(X.raster(spark, sf), "v", F.col("v") > 0.05)
    return out.select("image_id", "y", "x", r6("norm").alias("norm"))


@query("a14_anchor_mean_one", f"""with q as (select image_id, avg({LUM}) as ref from fx_rgb where r > 0.5 group by 1)
select image_id, y, x, {', '.join(r(f'case when ref is not null then {c}/greatest(ref,1e-5) end', c) for c in 'rgb')}, {r('ref')} from fx_rgb left join q using (image_id)""")
def _(spark, sf):
    out = L.anchor_mean_one(X.rgb(spark, sf), F.col("r") > 0.5)
    return rounded(out.select("image_id", "y", "x", "r", "g", "b", "ref"), "r", "g", "b", "ref")


@query("a15_ambient_split", f"""
with l as (select image_id, y, x, r, {LUM} as lum from fx_rgb),
q as (select image_id, least(greatest(quantile_cont(lum, 0.03)/greatest(quantile_cont(lum, 0.95), 1e-5), 0.05), 0.6) as a from l where r > 0.4 group by 1)
select image_id, y, x, {r('a')}, {r('case when a is not null then greatest((lum-a)/greatest(1-a, 1e-5), 0) end', 's')} from l left join q using (image_id)""")
def _(spark, sf):
    px = X.rgb(spark, sf).withColumn("lum", K.luminance())
    return rounded(L.ambient_split(px, F.col("r") > 0.4).select("image_id", "y", "x", "a", "s"), "a", "s")


CHROMA = f"""
l as (select image_id, r, g, b, {LUM} as yy from fx_rgb where r > 0.3),
q as (select image_id, quantile_cont(yy, 0.25) as lo, quantile_cont(yy, 0.75) as hi from l group by 1),
c as (select image_id, """ + ", ".join(
    f"count(*) filter (where {s}) as n{n}, " + ", ".join(f"avg({c}/greatest(yy,1e-5)) filter (where {s}) as {n}{c}" for c in "rgb")
    for n, s in (("amb", "yy <= lo"), ("dir", "yy >= hi"))) + " from l join q using (image_id) group by 1)"
CHROMA_OUT = ", ".join(
    r(f"case when n{n} < 50 then 1 else {n}{c}/greatest(0.2126::double*{n}r + 0.7152::double*{n}g + 0.0722::double*{n}b, 1e-5) end", f"{n}_{c}")
    for n in ("amb", "dir") for c in "rgb")


@query("a16_quartile_chroma", f"with {CHROMA}, o as (select image_id, {CHROMA_OUT} from c) select image_id, " + ", ".join(
    f"coalesce({s}_{c}, 1) as {s}_{c}" for s in ("amb", "dir") for c in "rgb") + " from fx_images left join o using (image_id)")
def _(spark, sf):
    out = L.quartile_chroma(X.rgb(spark, sf), F.col("r") > 0.3)
    return rounded(out, *[c for c in out.columns if c != "image_id"])


ENV = """
e as (select m.image_id, valid, v > 0.05 as on_plane, (px-c_x)*n_x+(py-c_y)*n_y+(pz-c_z)*n_z as h, v+0.5 as r, v+1 as g, v*v as b
from fx_point_map m join fx_raster using (image_id, y, x) join fx_planes using (image_id)),
f as (select image_id, count(*) filter (where valid and not on_plane and h > 0.3) as n, """ + ", ".join(
    f"avg({c}) filter (where valid and not on_plane and h > 0.3) as above_{c}, avg({c}) filter (where not on_plane) as off_{c}" for c in "rgb") + " from e group by 1)"


@query("a17_environment_mean", f"with {ENV} select image_id, n::bigint as n_above, " + ", ".join(
    r(f"coalesce(case when n > 500 then above_{c} else off_{c} end, 0.1)", c) for c in "rgb") + " from f")
def _(spark, sf):
    return rounded(P.environment_mean(_environment(spark, sf), ["image_id"], min_rows=500), "r", "g", "b")


def _environment(spark, sf):
    pts = P.heights(X.point_map(spark, sf), X.planes(spark, sf), ["image_id"]).select("image_id", "y", "x", "valid", "h")
    v = F.col("v")
    px = X.raster(spark, sf).select("image_id", "y", "x", (v > 0.05).alias("on_plane"), (v + 0.5).alias("r"), (v + 1).alias("g"), (v * v).alias("b"))
    return pts.join(px, ["image_id", "y", "x"])


def calibrate_sql(src, key, name, target):
    out, prev = [], src
    for i in range(4):
        out.append(f"{name}_m{i} as (select {key}, {target}/greatest(avg({LUM}), 1e-4) as k from {prev} group by 1)")
        cols = ", ".join(f"least(greatest({c}*k, 0.01), 0.95) as {c}" for c in "rgb")
        out.append(f"{name}{i} as (select t.* replace ({cols}) from (select p.*, k from {prev} p join {name}_m{i} using ({key})) t)")
        prev = f"(select * exclude k from {name}{i})"
    return ", ".join(out)


@query("a18_calibrate_mean", f"with {calibrate_sql('fx_rgb', 'image_id', 'cal', '0.35::double')} select image_id, y, x, {r('r')}, {r('g')}, {r('b')} from cal3")
def _(spark, sf):
    return rounded(L.calibrate_mean(X.rgb(spark, sf), 0.35, ["image_id"]), "r", "g", "b")


# ---- textures
def _uv(spark, sf, h):
    uv = P.ray_plane(X.raster(spark, sf), X.planes(spark, sf), CAM)
    tu, tv = TX.tile_uv("pu", "pv", 0.7, F.lit(32), F.lit(h))
    return uv.select("image_id", "y", "x", F.round(tu, 9).alias("tu"), F.round(tv, 9).alias("tv"))


UV = RAYS + """, th as (select max(ty)+1 as h from fx_tex),
uv as (select image_id, y, x, round((((pu/0.7::double + 0.5) % 1.0) + 1.0) % 1.0 * 31, 9) as tu, round((((pv/(0.7::double*(h/32.0::double)) + 0.5) % 1.0) + 1.0) % 1.0 * (h-1), 9) as tv, h from plane_uv, th)"""
BILINEAR = """cor as (select image_id, y, x, (floor(tv)+dy)::int % h as ty, (floor(tu)+dx)::int % 32 as tx,
(case dy when 1 then tv-floor(tv) else 1-(tv-floor(tv)) end)*(case dx when 1 then tu-floor(tu) else 1-(tu-floor(tu)) end) as w
from uv, unnest(range(2)) a(dy), unnest(range(2)) b(dx)),
lk as (select c.image_id, c.y, c.x, sum(w*coalesce(t.r,0)) as r, sum(w*coalesce(t.g,0)) as g, sum(w*coalesce(t.b,0)) as b from cor c left join {tex} t on c.ty=t.ty and c.tx=t.tx group by 1, 2, 3)"""


@query("j5_texture_nearest", f"with {UV} select u.image_id, u.y, u.x, {', '.join(r(f'coalesce({c}, 0)', c) for c in 'rgb')} from uv u left join fx_tex t "
       "on t.ty = round_even(tv, 0)::int % h and t.tx = round_even(tu, 0)::int % 32")
def _(spark, sf):
    h = X.tex_size(spark, sf)
    out = TX.texture_lookup(_uv(spark, sf, h), X.tex(spark, sf), "tu", "tv", 32, h, "nearest")
    return rounded(out.select("image_id", "y", "x", "r", "g", "b"), "r", "g", "b")


@query("j5_texture_bilinear", f"with {UV}, {BILINEAR.format(tex='fx_tex')} select image_id, y, x, {r('r')}, {r('g')}, {r('b')} from lk")
def _(spark, sf):
    h = X.tex_size(spark, sf)
    out = TX.texture_lookup(_uv(spark, sf, h), X.tex(spark, sf), "tu", "tv", 32, h)
    return rounded(out.select("image_id", "y", "x", "r", "g", "b"), "r", "g", "b")


@query("c3_retile", f"with {UV}, tex1 as (select *, 1 as pattern_id from fx_tex), {calibrate_sql('tex1', 'pattern_id', 'cal', '0.35::double')}, {BILINEAR.format(tex='cal3')} select image_id, y, x, {r('r')}, {r('g')}, {r('b')} from lk")
def _(spark, sf):
    from .composites import retile
    h = X.tex_size(spark, sf)
    tex = X.tex(spark, sf).withColumn("pattern_id", F.lit(1))
    out = retile(X.raster(spark, sf), X.planes(spark, sf), tex, CAM, 32, h, tile_m=0.7, albedo=0.35, uv_places=9)
    return rounded(out.select("image_id", "y", "x", "r", "g", "b"), "r", "g", "b")


@query("c3_retile_cameras", f"with {UV.replace(RAYS, RAYS_SEEN)}, tex1 as (select *, 1 as pattern_id from fx_tex), {calibrate_sql('tex1', 'pattern_id', 'cal', '0.35::double')}, {BILINEAR.format(tex='cal3')} select image_id, y, x, {r('r')}, {r('g')}, {r('b')} from lk")
def _(spark, sf):
    from .composites import retile
    tex = X.tex(spark, sf).withColumn("pattern_id", F.lit(1))
    out = retile(X.raster(spark, sf), X.planes(spark, sf), tex, _image_cameras(spark, sf), 32, X.tex_size(spark, sf), tile_m=0.7, albedo=0.35, uv_places=9)
    return rounded(out.select("image_id", "y", "x", "r", "g", "b"), "r", "g", "b")


# ---- meshes, splats, voxels
@query("s7_to_yup", "select mesh_id, vid, x, z as y, -y as z from fx_vertices")
def _(spark, sf):
    return to_yup(X.vertices(spark, sf))


@query("j6_faces_with_vertices", "select * from fx_wide_faces")
def _(spark, sf):
    return ME.faces_with_vertices(X.faces(spark, sf), X.vertices(spark, sf))


CROSS = """cr as (select *, (y1-y0)*(z2-z0)-(z1-z0)*(y2-y0) as nx, (z1-z0)*(x2-x0)-(x1-x0)*(z2-z0) as ny, (x1-x0)*(y2-y0)-(y1-y0)*(x2-x0) as nz from fx_wide_faces)"""
VN = CROSS + """, st as (select mesh_id, unnest([v0,v1,v2]) as vid, nx, ny, nz from cr), vs as (select mesh_id, vid, sum(nx) as nx, sum(ny) as ny, sum(nz) as nz from st group by 1, 2),
vn as (select mesh_id, vid, nx, ny, nz, sqrt(nx*nx+ny*ny+nz*nz) as l from vs)"""


@query("a19_face_normals", f"with {CROSS} select mesh_id, fid, " + ", ".join(r(f"{n}/greatest(sqrt(nx*nx+ny*ny+nz*nz), 1e-9)", n) for n in ("nx", "ny", "nz")) + " from cr")
def _(spark, sf):
    out = ME.face_normals(ME.faces_with_vertices(X.faces(spark, sf), X.vertices(spark, sf)))
    return rounded(out.select("mesh_id", "fid", "nx", "ny", "nz"), "nx", "ny", "nz")


@query("a19_vertex_normals", f"with {VN} select mesh_id, vid, " + ", ".join(r(f"case when l > 0 then {n}/l else 0 end", n) for n in ("nx", "ny", "nz")) + " from vn")
def _(spark, sf):
    return rounded(ME.vertex_normals(X.faces(spark, sf), X.vertices(spark, sf)), "nx", "ny", "nz")


CENTRED = "ce as (select mesh_id, vid, " + ", ".join(f"{a} - (min({a}) over w + max({a}) over w)/2 as {a}" for a in "xyz") + " from fx_vertices window w as (partition by mesh_id))"


@query("a20_normalise_mesh", f"with {CENTRED} select mesh_id, vid, " + ", ".join(r(f"{a}/greatest(max(sqrt(x*x+y*y+z*z)) over (partition by mesh_id), 1e-6)", a) for a in "xyz") + " from ce")
def _(spark, sf):
    return rounded(ME.normalise_mesh(X.vertices(spark, sf)), "x", "y", "z")


@query("a20_normalise_extent", f"with {CENTRED} select mesh_id, vid, " + ", ".join(r(f"{a}/greatest(max(greatest(abs(x),abs(y),abs(z))) over (partition by mesh_id), 1e-6)", a) for a in "xyz") + " from ce")
def _(spark, sf):
    return rounded(ME.normalise_mesh(X.vertices(spark, sf), by="extent"), "x", "y", "z")


@query("a21_splat_filter_report", """select asset_id, (count(*) filter (where 1/(1+exp(-opacity)) >= 0.1))::bigint as points,
(count(*) filter (where not 1/(1+exp(-opacity)) >= 0.1))::bigint as dropped from fx_splats group by 1""")
def _(spark, sf):
    return ME.splat_filter_report(X.splats(spark, sf))


def grid_sql(kx, ky, res):
    return f"""
with t as (select mesh_id, fid, x0*{kx}::double as sx0, y0*{ky}::double as sy0, z0+1 as z0, x1*{kx}::double as sx1, y1*{ky}::double as sy1, z1+1 as z1, x2*{kx}::double as sx2, y2*{ky}::double as sy2, z2+1 as z2,
x0 as q0, x1 as q1, x2 as q2 from fx_wide_faces),
a as (select *, (sx1-sx0)*(sy2-sy0)-(sx2-sx0)*(sy1-sy0) as area from t),
b as (select *, greatest(0,least({res - 1},floor(least(sx0,sx1,sx2))))::int as xlo, greatest(0,least({res - 1},ceil(greatest(sx0,sx1,sx2))))::int as xhi,
greatest(0,least({res - 1},floor(least(sy0,sy1,sy2))))::int as ylo, greatest(0,least({res - 1},ceil(greatest(sy0,sy1,sy2))))::int as yhi from a where abs(area) > 1e-12 and least(z0,z1,z2) > 0),
c as (select *, unnest(range(xlo, xhi+1))::int as x from b), d as (select *, unnest(range(ylo, yhi+1))::int as y from c),
e as (select *, ((sx1-sx0)*((y+0.5::double)-sy0)-((x+0.5::double)-sx0)*(sy1-sy0))/area as l2, (((x+0.5::double)-sx0)*(sy2-sy0)-(sx2-sx0)*((y+0.5::double)-sy0))/area as l1 from d),
f as (select *, 1-l1-l2 as l0 from e), g as (select *, l0*z0+l1*z1+l2*z2 as depth, l0*q0+l1*q1+l2*q2 as q from f where l0>=0 and l1>=0 and l2>=0)
select mesh_id, y, x, arg_min(fid, (depth, fid)) as fid, round(min(depth), 6) as depth, round(arg_min(q, (depth, fid)), 6) as q from g group by 1, 2, 3"""


@query("a26_grid_raster", grid_sql(0.6, 1.5, 32))
def _(spark, sf):
    out = ME.grid_raster(X.triangles(spark, sf), 32, attrs=["q"], block=16)
    return rounded(out.select("mesh_id", "y", "x", "fid", "depth", "q"), "depth", "q")


@query("a26_grid_raster_fine", grid_sql(9.7, 24.1, 512))
def _(spark, sf):
    """Triangles that lie over several blocks."""
    out = ME.grid_raster(X.triangles(spark, sf, 9.7, 24.1), 512, attrs=["q"], block=16)
    return rounded(out.select("mesh_id", "y", "x", "fid", "depth", "q"), "depth", "q")


KERNEL = [((i * 7) % 11 - 5) / 10 for i in range(27)]
OFFS = """off as (select k::int as k, (k//9)::int-1 as dx, ((k//3)%3)::int-1 as dy, (k%3)::int-1 as dz, (((k*7)%11)-5)/10.0::double as w from unnest(range(27)) t(k)),
nb as (select p.batch, p.x, p.y, p.z, o.k, o.w, q.feat from fx_vox p, off o, fx_vox q where q.batch=p.batch and q.x=p.x+o.dx and q.y=p.y+o.dy and q.z=p.z+o.dz)"""


@query("j7_voxel_neighbours", f"with {OFFS} select batch, x, y, z, k, round(feat, 6) as nfeat from nb")
def _(spark, sf):
    return rounded(VB.voxel_neighbours(X.vox(spark, sf)), "nfeat")


@query("j7_submanifold", f"with {OFFS} select batch, x, y, z, round(sum(w*feat) + 0.5, 6) + 0.0::double as feat from nb group by 1, 2, 3, 4")
def _(spark, sf):
    return VB.submanifold_aggregate(X.vox(spark, sf), KERNEL, 3, 0.5).withColumn("feat", F.round("feat", 6) + F.lit(0.0))


@query("j7_submanifold_channels", f"with {OFFS} select batch, x, y, z, round(sum(w*feat - w*w*sqrt(feat)), 5) + 0.0::double as f0, round(sum(2*w*sqrt(feat)), 5) + 0.0::double as f1 from nb group by 1, 2, 3, 4")
def _(spark, sf):
    vox = X.vox(spark, sf).withColumn("feat", F.array("feat", F.sqrt("feat")))
    out = VB.submanifold_aggregate(vox, [[[w, -w * w], [0.0, 2 * w]] for w in KERNEL])
    return out.select("batch", "x", "y", "z", *[(F.round(F.col("feat")[i], 5) + F.lit(0.0)).alias(f"f{i}") for i in (0, 1)])


@query("j7_linear_map", "select batch, x, y, z, round(feat*1.5 - 2, 6) as feat from fx_vox")
def _(spark, sf):
    return rounded(VB.submanifold_aggregate(X.vox(spark, sf), [1.5], 1, -2.0), "feat")


@query("c7_mesh_report", f"""with {VN}, v as (select mesh_id, count(*)::bigint as vertices, max(x)-min(x) as extent_x, max(y)-min(y) as extent_y, max(z)-min(z) as extent_z from fx_vertices group by 1),
f as (select mesh_id, count(*)::bigint as faces from fx_faces group by 1), n as (select mesh_id, (count(*) filter (where nx=0 and ny=0 and nz=0))::bigint as flat_vertices from vn group by 1)
select mesh_id, vertices, extent_x, {r('extent_y')}, extent_z, coalesce(faces, 0)::bigint as faces, coalesce(flat_vertices, 0)::bigint as flat_vertices from v left join f using (mesh_id) left join n using (mesh_id)""")
def _(spark, sf):
    out = ME.mesh_report(X.faces(spark, sf), X.vertices(spark, sf))
    return rounded(out, "extent_y").fillna(0, ["faces", "flat_vertices"])


@query("c7_cloud_report", """
with p as (select asset_id, 1/(1+exp(-opacity)) >= 0.1 as keep, trunc(least(greatest(0.5+0.28209479177387814*f_dc[1],0),1)*255)::int as red from fx_splats)
select asset_id, (count(*) filter (where keep))::bigint as points, (count(*) filter (where not keep))::bigint as dropped, round(avg(red) filter (where keep), 6) as mean_red from p group by 1""")
def _(spark, sf):
    p = ME.splat_points(X.splats(spark, sf))
    return p.groupBy("asset_id").agg(F.count_if("keep").alias("points"), F.count_if(~F.col("keep")).alias("dropped"),
                                     r6(F.avg(F.when(F.col("keep"), F.col("red")))).alias("mean_red"))
