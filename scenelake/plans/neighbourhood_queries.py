"""Filters, morphology, regions and components."""

from pyspark.sql import functions as F

from ..operators import components as CC
from ..operators import fill
from ..operators import neighbourhood as N
from ..operators import region_rows as RR
from ..operators import regions as RG
from ..operators import run_graph as RN
from ..operators.proposals import keep_proposals, pick_proposal
from . import tables as X
from .catalog import query
from .geometry_queries import r, rounded

W, H, RW = X.WIDTH, X.HEIGHT, X.RGB_WIDTH


def values(rows, names):
    return f"(values {', '.join('(' + ', '.join(str(v) for v in row) + ')' for row in rows)}) t({names})"


def line_sql(src, name, cols, weights, axis, n, border, keys="image_id"):
    """One weighted pass along an axis: weights is a list over offsets -r..r."""
    rad = len(weights) // 2
    other = "y" if axis == "x" else "x"
    off = values([(i - rad, f"{w!r}::double") for i, w in enumerate(weights)], "d, w")
    p = f"{axis}+d"
    at = {"truncate": p, "reflect": f"(case when {p}<0 then -1-({p}) when {p}>={n} then 2*{n}-1-({p}) else {p} end)",
          "reflect101": f"(case when {p}<0 then -({p}) when {p}>={n} then 2*{n}-2-({p}) else {p} end)"}[border]
    sums = ", ".join(f"sum(w*b.{c})/sum(w) as {c}" for c in cols)
    ks = keys.split(",")
    same = " and ".join(f"a.{k}=b.{k}" for k in ks)
    akeys = ", ".join(f"a.{k}" for k in ks)
    return f"""{name} as (select {akeys}, a.y, a.x, {sums} from (select *, {at} as pp from {src}, {off}) a
join {src} b on {same} and a.{other}=b.{other} and b.{axis}=a.pp group by {akeys}, a.y, a.x)"""


def blur_sql(src, name, cols, weights, w, h, border="truncate", keys="image_id"):
    return line_sql(src, f"{name}_x", cols, weights, "x", w, border, keys) + ", " + line_sql(f"{name}_x", name, cols, weights, "y", h, border, keys)


def offsets(element):
    return [(dy, dx) for dy, a, b in element for dx in range(a, b + 1)]


def dilate_sql(src, name, element, w, h, keys="image_id, mask_id"):
    off = values(offsets(element), "dy, dx")
    return f"""{name} as (select distinct {keys}, (y+dy)::int as y, (x+dx)::int as x from {src}, {off} where y+dy between 0 and {h - 1} and x+dx between 0 and {w - 1})"""


def erode_sql(src, name, element, w, h, keys="image_id, mask_id"):
    off = values(offsets(element), "dy, dx")
    ks = [k.strip() for k in keys.split(",")]
    same = " and ".join(f"a.{k}=b.{k}" for k in ks)
    akeys = ", ".join(f"a.{k}" for k in ks)
    return f"""{name} as (select {akeys}, a.y, a.x from (select *, y+dy as py, x+dx as px from {src}, {off} where y+dy between 0 and {h - 1} and x+dx between 0 and {w - 1}) a
left join {src} b on {same} and b.y=a.py and b.x=a.px group by {akeys}, a.y, a.x having count(b.x) = count(*))"""


def close_sql(src, name, element, w, h, keys="image_id, mask_id"):
    return dilate_sql(src, f"{name}_d", N.flipped(element), w, h, keys) + ", " + erode_sql(f"{name}_d", name, element, w, h, keys)


def grey_sql(src, name, element, fn):
    return f"""{name} as (select a.image_id, a.y, a.x, {fn}(b.v) as v from (select image_id, y, x, y+dy as py, x+dx as px from {src}, {values(offsets(element), 'dy, dx')}) a
join {src} b on a.image_id=b.image_id and b.y=a.py and b.x=a.px group by 1, 2, 3)"""


def cc_sql(src, name, conn=8, keys="image_id, mask_id"):
    """Component labels of the pixels of src: the smallest pixel number reachable over runs."""
    d = 1 if conn == 8 else 0
    ks = [k.strip() for k in keys.split(",")]

    def same(a, b):
        return " and ".join(f"{a}.{k}={b}.{k}" for k in ks)
    ekeys = ", ".join(f"e.{k}" for k in ks)
    return f"""{name}_r as (select {keys}, y, min(x) as x0, max(x) as x1, y::bigint*4294967296+min(x) as id from
  (select {keys}, y, x, x - row_number() over (partition by {keys}, y order by x) as g from {src}) group by {keys}, y, g),
{name}_e1 as (select {', '.join('a.' + k for k in ks)}, a.id as a, b.id as b from {name}_r a join {name}_r b on {same('a', 'b')} and b.y=a.y+1 and b.x0<=a.x1+{d} and b.x1>=a.x0-{d}),
{name}_e as (select * from {name}_e1 union all select {keys}, b, a from {name}_e1),
{name}_cc({keys}, id, l) using key ({keys}, id) as (select {keys}, id, id from {name}_r union
  select {ekeys}, e.b, min(c.l) from {name}_e e join {name}_cc c on {same('c', 'e')} and c.id=e.a join recurring.{name}_cc q on {same('q', 'e')} and q.id=e.b where c.l<q.l group by {ekeys}, e.b),
{name} as (select {', '.join('m.' + k for k in ks)}, m.y, m.x, c.l::bigint as label from {src} m join {name}_r r on {same('m', 'r')} and m.y=r.y and m.x between r.x0 and r.x1 join {name}_cc c on {same('c', 'r')} and c.id=r.id)"""


def px(cols="v"):
    return "select image_id, y, x, " + cols


# ---- filters
BOX5 = [1.0] * 5


@query("w1_box_filter", f"with {blur_sql('fx_raster', 'b', ['v'], BOX5, W, H)} {px(r('v'))} from b")
def _(spark, sf):
    # an untouched corner of the frame has fewer neighbours, and the mean is over those present
    return rounded(N.box_filter(X.raster(spark, sf), 2, ["v"]), "v")


@query("w1_box_filter_reflect", f"with {blur_sql('fx_raster', 'b', ['v'], BOX5, W, H, 'reflect')} {px(r('v'))} from b")
def _(spark, sf):
    return rounded(N.box_filter(X.raster(spark, sf), 2, ["v"], width=W, height=H, border="reflect"), "v")


@query("w1_box_filter_tiled", f"with {blur_sql('fx_raster', 'b', ['v'], BOX5, W, H)} {px(r('v'))} from b")
def _(spark, sf):
    return rounded(N.box_filter(X.raster(spark, sf), 2, ["v"], tile=16), "v")


G1 = N.gaussian_kernel(1.0)


@query("w2_gaussian", f"with {blur_sql('fx_raster', 'b', ['v'], G1, W, H)} {px(r('v'))} from b")
def _(spark, sf):
    return rounded(N.gaussian(X.raster(spark, sf), 1.0, ["v"]), "v")


@query("w2_gaussian_reflect101", f"with {blur_sql('fx_raster', 'b', ['v'], N.gaussian_kernel(2.0), W, H, 'reflect101')} {px(r('v'))} from b")
def _(spark, sf):
    return rounded(N.gaussian(X.raster(spark, sf), 2.0, ["v"], width=W, height=H, border="reflect101", tile=32), "v")


@query("w3_guided_filter", f"""with src as (select image_id, y, x, r as g, r*r as gg, b as s, r*b as gs from fx_rgb),
{blur_sql('src', 'm', ['g', 'gg', 's', 'gs'], [1.0] * 7, RW, H, 'reflect')},
ab as (select image_id, y, x, (gs-g*s)/(gg-g*g+1e-3::double) as a, s-(gs-g*s)/(gg-g*g+1e-3::double)*g as b from m),
{blur_sql('ab', 'n', ['a', 'b'], [1.0] * 7, RW, H, 'reflect')}
select image_id, y, x, {r('n.a*p.r+n.b', 'b')} from n join fx_rgb p using (image_id, y, x)""")
def _(spark, sf):
    return rounded(N.guided_filter(X.rgb(spark, sf), "r", ["b"], 3, 1e-3, width=RW, height=H), "b")


# ---- morphology
@query("w4_dilate_rect", f"with {dilate_sql('fx_mask', 'd', N.rect(5, 3), W, H)} select * from d")
def _(spark, sf):
    return N.dilate(X.mask(spark, sf), N.rect(5, 3), W, H)


@query("w4_erode_rect", f"with {dilate_sql('fx_mask', 'd', N.rect(5, 5), W, H)}, {erode_sql('d', 'e', N.rect(3, 3), W, H)} select * from e")
def _(spark, sf):
    return N.erode(N.dilate(X.mask(spark, sf), N.rect(5, 5), W, H), N.rect(3, 3), W, H)


@query("w5_dilate_ellipse", f"with {dilate_sql('fx_mask', 'd', N.ellipse(7), W, H)} select * from d")
def _(spark, sf):
    return N.dilate(X.mask(spark, sf), N.ellipse(7), W, H)


@query("w5_erode_ellipse", f"with {dilate_sql('fx_mask', 'd', N.rect(5, 5), W, H)}, {erode_sql('d', 'e', N.ellipse(5), W, H)} select * from e")
def _(spark, sf):
    return N.erode(N.dilate(X.mask(spark, sf), N.rect(5, 5), W, H), N.ellipse(5), W, H)


@query("w6_close", f"with {close_sql('fx_mask', 'c', N.rect(5, 5), W, H)} select * from c")
def _(spark, sf):
    return N.close(X.mask(spark, sf), N.rect(5, 5), W, H)


@query("w6_open", f"""with {dilate_sql('fx_mask', 'b', N.rect(3, 3), W, H)}, {erode_sql('b', 'e', N.rect(5, 3), W, H)},
{dilate_sql('e', 'o', N.rect(5, 3), W, H)} select * from o""")
def _(spark, sf):
    return N.open_(N.dilate(X.mask(spark, sf), N.rect(3, 3), W, H), N.rect(5, 3), W, H)


E5 = N.ellipse(5)
FLAT = ", ".join([grey_sql("fx_raster", "f1", E5, "max"), grey_sql("f1", "f2", E5, "min"), grey_sql("f2", "f3", E5, "min"), grey_sql("f3", "f4", E5, "max")])


@query("w6_grey_close_open", f"with {FLAT} {px(r('v'))} from f4")
def _(spark, sf):
    return rounded(N.grey_close_open(X.raster(spark, sf), ["v"], 5), "v")


@query("w7_thin_structure_filter", f"""with {FLAT} select image_id, y, x, round(case when thin then fv else v end, 6) + 0.0::double as v, thin from
(select a.*, f.v as fv, abs(f.v-a.v) > 0.5*greatest(a.v, 1e-3) as thin from fx_raster a join f4 f using (image_id, y, x))""")
def _(spark, sf):
    return rounded(N.thin_structure_filter(X.raster(spark, sf), ["v"], 5, 0.5).withColumnRenamed("thin_v", "thin"), "v")


def lowfreq_sql(src, name, cols, sigma, w, h):
    f = max(1, int(sigma / 4))
    small = f"{name}_s as (select image_id, (y//{f})::int as y, (x//{f})::int as x, {', '.join(f'avg({c}) as {c}' for c in cols)} from {src} group by all)"
    return f"""{small}, {blur_sql(name + '_s', name + '_b', cols, N.gaussian_kernel(sigma / f), -(-w // f), -(-h // f), 'reflect101')},
{name}_p as (select image_id, y, x, least(greatest((x+0.5::double)/{f}-0.5, 0), {-(-w // f) - 1}) as u, least(greatest((y+0.5::double)/{f}-0.5, 0), {-(-h // f) - 1}) as vv from {src}),
{name} as (select p.image_id, p.y, p.x, {', '.join(f'sum(b.{c}*(case dy when 1 then vv-floor(vv) else 1-(vv-floor(vv)) end)*(case dx when 1 then u-floor(u) else 1-(u-floor(u)) end)) as {c}' for c in cols)}
from {name}_p p, unnest(range(2)) a(dy), unnest(range(2)) c(dx), {name}_b b where b.image_id=p.image_id and b.y=least(floor(vv)+dy, {-(-h // f) - 1}) and b.x=least(floor(u)+dx, {-(-w // f) - 1}) group by 1, 2, 3)"""


@query("w8_lowfreq", f"with {lowfreq_sql('fx_raster', 'l', ['v'], 8.0, W, H)} {px(r('v'))} from l")
def _(spark, sf):
    return rounded(N.lowfreq(X.raster(spark, sf), ["v"], 8.0, W, H), "v")


@query("w8_delight", f"""with {blur_sql('fx_rgb', 'l', ['r', 'g', 'b'], N.gaussian_kernel(0.15 * RW), RW, H, 'reflect101')},
lev as (select image_id, avg(0.2126::double*r+0.7152::double*g+0.0722::double*b) as lev from l group by 1)
select p.image_id, p.y, p.x, {', '.join(f'round(p.{c}*(1-0.8::double) + p.{c}/greatest(l.{c},1e-4)*lev*0.8::double, 6) + 0.0::double as {c}' for c in 'rgb')}
from fx_rgb p join l using (image_id, y, x) join lev using (image_id)""")
def _(spark, sf):
    return rounded(N.delight(X.rgb(spark, sf), 0.8, RW, H), "r", "g", "b")


NC = f"""hv as (select image_id, y, x, (v>0.1)::int::double as h, v*(v>0.1)::int as v from fx_raster), {blur_sql('hv', 'c', ['h', 'v'], N.gaussian_kernel(1.0), W, H, 'reflect101')},
q as (select image_id, quantile_cont(h, 0.75) as ref from c where h > 0 group by 1)"""


@query("w9_normalised_convolution", f"with {NC} select image_id, y, x, {r('v/greatest(h,1e-4)', 'v')}, {r('least(greatest(h/greatest(ref,1e-4),0),1)', 'confidence')} from c join q using (image_id)")
def _(spark, sf):
    src = X.raster(spark, sf).withColumn("hit", F.col("v") > 0.1)
    return rounded(N.normalised_convolution(src, "hit", ["v"], 1.0, width=W, height=H), "v", "confidence")


BB = "bb as (select image_id, mask_id, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from small group by 1, 2)"
SMALL = """small as (select image_id, (mask_id*100 + (y//12)*10 + x//12)::int as mask_id, y, x from fx_mask)"""


def _small(spark, sf):
    """Objects of up to 12 x 12 pixels: each mask cut along a grid."""
    cell = F.col("mask_id") * 100 + F.floor(F.col("y") / 12) * 10 + F.floor(F.col("x") / 12)
    return X.mask(spark, sf).withColumn("mask_id", cell.cast("int"))


@query("w10_shadow_region", f"""with {SMALL}, {BB},
m as (select image_id, mask_id, round_even(0.35::double*greatest(x1-x0, y1-y0), 0)::int as m from bb),
g as (select *, round_even(0.3::double*m, 0)::int as u, round_even(1.5::double*m, 0)::int as d from m)
select distinct s.image_id, s.mask_id, (s.y+dy)::int as y, (s.x+dx)::int as x from small s join g using (image_id, mask_id), unnest(range(-10, 11)) a(dy), unnest(range(-10, 11)) b(dx)
where dy between -u and d and dx between -m and m and s.y+dy between 0 and 49 and s.x+dx between 0 and 63""")
def _(spark, sf):
    return RG.shadow_region(_small(spark, sf), X.images(spark, sf))


REGIONS = f"""{SMALL}, {BB}, k as (select image_id, mask_id, ['mask','dilated','box','full'][(image_id+mask_id)%4+1] as kind,
round_even(0.35::double*greatest(x1-x0, y1-y0), 0)::int as m, x0, y0, x1, y1 from bb),
g as (select *, round_even(0.3::double*m, 0)::int as u, round_even(1.5::double*m, 0)::int as d from k),
ln as (select image_id, mask_id, y, min(x) as x0, max(x) as x1 from (select *, x - row_number() over (partition by image_id, mask_id, y order by x) as i from small) group by image_id, mask_id, y, i),
iv as (select image_id, mask_id, y, ln.x0, ln.x1 from ln join k using (image_id, mask_id) where kind='mask'
union all select image_id, mask_id, unnest(range(greatest(y-u, 0), least(y+d, 49)+1)) as y, greatest(ln.x0-m, 0), least(ln.x1+m, 63) from ln join g using (image_id, mask_id) where kind='dilated'
union all select image_id, mask_id, unnest(range(greatest(y0-m, 0), least(y1+m, 49)+1)) as y, greatest(x0-m, 0), least(x1+m, 63) from k where kind='box'
union all select image_id, mask_id, unnest(range(0, 50)) as y, 0, 63 from k where kind='full'),
tops as (select image_id, mask_id, y, x0, max(x1) as x1 from iv group by all),
cut as (select *, coalesce(greatest(x0, 1 + max(x1) over (partition by image_id, mask_id, y order by x0 rows between unbounded preceding and 1 preceding)), x0) as f from tops)"""


def _regions(spark, sf):
    small = _small(spark, sf)
    names = F.array(*[F.lit(k) for k in RG.KINDS])
    kinds = small.select("image_id", "mask_id").distinct().withColumn("kind", F.element_at(names, ((F.col("image_id") + F.col("mask_id")) % 4 + 1).cast("int")))
    return RG.edit_regions(small, X.images(spark, sf), kinds)


@query("w11_edit_region", f"""with {REGIONS} select image_id, mask_id, y::int as y, unnest(range(f, x1+1))::int as x from cut where f <= x1""")
def _(spark, sf):
    return RR.pixels(_regions(spark, sf))


@query("w11_edit_region_area", f"""with {REGIONS} select image_id, mask_id, sum(greatest(x1-f+1, 0))::bigint as area from cut group by 1, 2""")
def _(spark, sf):
    return RR.area(_regions(spark, sf))


@query("w14_soft_mask", f"with d as (select image_id, y, x, (v > 0.05)::int::double as alpha from fx_raster), {blur_sql('d', 'b', ['alpha'], G1, W, H, 'reflect101')} {px(r('alpha'))} from b")
def _(spark, sf):
    return rounded(N.soft_mask(X.raster(spark, sf), X.one_mask(spark, sf), 1.0, width=W, height=H), "alpha")


@query("w14_border_feather", f"""with d as (select image_id, y, x, (case when image_id%2=0 then y between 2 and 47 and x between 2 and 61 else v > 0.05 end)::int::double as alpha from fx_raster),
{blur_sql('d', 'b', ['alpha'], N.gaussian_kernel(2.0), W, H, 'reflect101')} {px(r('alpha'))} from b""")
def _(spark, sf):
    frame = X.raster(spark, sf)
    region = frame.where((F.col("image_id") % 2 == 0) | (F.col("v") > 0.05))
    return rounded(N.border_feather(frame, region, 2, W, H), "alpha")


@query("a27_subject_crop", f"""with {SMALL}, {BB}, p as (select *, round_even(0.15::double*greatest(x1+1-x0, y1+1-y0), 0)::int as pad from bb),
w as (select *, greatest(0, x0-pad) as wx0, greatest(0, y0-pad) as wy0, least(64, x1+1+pad) as wx1, least(50, y1+1+pad) as wy1 from p)
select w.image_id, w.mask_id, (f.y-wy0)::int as cy, (f.x-wx0)::int as cx, {r('f.v', 'v')}, (case when s.x is null then 0 else 255 end)::int as alpha
from w join fx_raster f on f.image_id=w.image_id and f.x >= wx0 and f.x < wx1 and f.y >= wy0 and f.y < wy1
left join small s on s.image_id=w.image_id and s.mask_id=w.mask_id and s.y=f.y and s.x=f.x""")
def _(spark, sf):
    out = RG.subject_crop(X.raster(spark, sf), _small(spark, sf), X.images(spark, sf))
    return rounded(out.select("image_id", "mask_id", "cy", "cx", "v", "alpha"), "v")


@query("a27_square_crop", f"""with {SMALL}, {BB}, p as (select *, trunc(greatest(x1+1-x0, y1+1-y0)*1.2::double)::int as side from bb)
select p.image_id, p.mask_id, side, (f.y-y0+floor((side-(y1+1-y0))/2.0))::int as cy, (f.x-x0+floor((side-(x1+1-x0))/2.0))::int as cx, {r('f.v', 'v')}, (case when s.x is null then 0 else 255 end)::int as alpha
from p join fx_raster f on f.image_id=p.image_id and f.x between x0 and x1 and f.y between y0 and y1
left join small s on s.image_id=p.image_id and s.mask_id=p.mask_id and s.y=f.y and s.x=f.x""")
def _(spark, sf):
    out = RG.square_crop(X.raster(spark, sf), _small(spark, sf), X.images(spark, sf))
    return rounded(out.select("image_id", "mask_id", "side", "cy", "cx", "v", "alpha"), "v")


# ---- components
CC_SQL = cc_sql("fx_mask", "c")


@query("g1_connected_components", f"with {CC_SQL} select * from c", recursive=True)
def _(spark, sf):
    return CC.connected_components(X.mask(spark, sf))


@query("g1_connected_components_tiled", f"with {CC_SQL} select * from c", recursive=True)
def _(spark, sf):
    return CC.connected_components(X.mask(spark, sf), tile=16)


@query("a24_component_stats", f"with {cc_sql('fx_mask', 'c', 4)} select image_id, mask_id, label, count(*)::bigint as area, min(x)::int as x0, min(y)::int as y0, max(x)::int as x1, max(y)::int as y1 from c group by 1, 2, 3", recursive=True)
def _(spark, sf):
    return CC.component_stats(CC.connected_components(X.mask(spark, sf), 4))


@query("g2_drop_small", f"""with {CC_SQL}, s as (select image_id, mask_id, label, count(*) as n from c group by 1, 2, 3)
select c.* from c join s using (image_id, mask_id, label) where n > 0.002*64*50""", recursive=True)
def _(spark, sf):
    return CC.drop_small(CC.connected_components(X.mask(spark, sf)), X.images(spark, sf))


LARGEST = "s as (select image_id, mask_id, label, count(*) as n from c group by 1, 2, 3), big as (select image_id, mask_id, arg_max(label, (n, -label)) as label from s group by 1, 2)"


@query("t5_largest_component", f"with {CC_SQL}, {LARGEST} select c.* from c join big using (image_id, mask_id, label)", recursive=True)
def _(spark, sf):
    return CC.largest_component(CC.connected_components(X.mask(spark, sf)))


PT = "pt as (select distinct image_id, mask_id, ((image_id*7)%50)::int as py, ((image_id*13)%64)::int as px from fx_mask)"
AT = """hit as (select c.image_id, c.mask_id, c.label from c join pt on pt.image_id=c.image_id and pt.mask_id=c.mask_id and c.y=py and c.x=px),
ch as (select big.image_id, big.mask_id, coalesce(hit.label, big.label) as label from big left join hit using (image_id, mask_id))"""


def _points(spark, sf):
    i = F.col("image_id")
    return X.mask(spark, sf).select("image_id", "mask_id", (i * 7 % 50).cast("int").alias("py"), (i * 13 % 64).cast("int").alias("px")).distinct()


@query("t5_component_at", f"with {CC_SQL}, {LARGEST}, {PT}, {AT} select c.* from c join ch using (image_id, mask_id, label)", recursive=True)
def _(spark, sf):
    return CC.component_at(CC.connected_components(X.mask(spark, sf)), _points(spark, sf))


THICK = dilate_sql("fx_mask", "thick", N.rect(3, 3), W, H)


def holes_sql(src, mode):
    keep = ("label = 0" if mode == "corner" else
            "(image_id, mask_id, label) in (select image_id, mask_id, label from bg where y in (0, 49) or x in (0, 63))")
    return f"""keyed as (select distinct image_id, mask_id from {src}),
frame as (select image_id, y::int as y, x::int as x from fx_images, unnest(range(height)) a(y), unnest(range(width)) b(x)),
inv as (select k.image_id, k.mask_id, p.y, p.x from keyed k join frame p using (image_id) where not exists (select 1 from {src} t where t.image_id=k.image_id and t.mask_id=k.mask_id and t.y=p.y and t.x=p.x)),
{cc_sql('inv', 'bg', 4)}, filled as (select image_id, mask_id, y, x from {src} union all select image_id, mask_id, y, x from bg where not {keep})"""


def _thick(spark, sf):
    return N.dilate(X.mask(spark, sf), N.rect(3, 3), W, H)


@query("g4_fill_holes", f"with {THICK}, {holes_sql('thick', 'border')} select * from filled", recursive=True)
def _(spark, sf):
    return RN.fill_holes(_thick(spark, sf), X.images(spark, sf))


@query("g4_fill_holes_from_corner", f"with {THICK}, {holes_sql('thick', 'corner')} select * from filled", recursive=True)
def _(spark, sf):
    return RN.fill_holes(_thick(spark, sf), X.images(spark, sf), "corner")


@query("g3_clean_mask", f"""with {close_sql('fx_mask', 'cl', N.rect(3, 3), W, H)}, {cc_sql('cl', 'c')}, {LARGEST}, {PT}, {AT},
kept as (select image_id, mask_id, y, x from c join ch using (image_id, mask_id, label)), {holes_sql('kept', 'corner')} select * from filled""", recursive=True)
def _(spark, sf):
    return RN.clean_mask(X.mask(spark, sf), _points(spark, sf), X.images(spark, sf), 3, W, H)


@query("g5_border_connected", f"""with {THICK}, {cc_sql('thick', 'c', 4)} select image_id, mask_id, y, x from c
where (image_id, mask_id, label) in (select image_id, mask_id, label from c where y in (0, 49) or x in (0, 63))""", recursive=True)
def _(spark, sf):
    return CC.border_connected(_thick(spark, sf), X.images(spark, sf))


@query("g5_white_matte", f"""with white as (select image_id, y, x from fx_frames where r0 >= 105 and g0 >= 105 and b0 >= 105), {cc_sql('white', 'c', 4, 'image_id')},
outside as (select image_id, y, x from c where (image_id, label) in (select image_id, label from c where y in (0, 49) or x in (0, 21))),
ins as (select image_id, y, x from fx_frames except select * from outside), {close_sql('ins', 'cl', N.rect(5, 5), RW, H, 'image_id')} select * from cl""", recursive=True)
def _(spark, sf):
    return CC.white_matte(X.frame_before(spark, sf), X.rgb_images(spark, sf), RW, H, tol=150)


@query("g6_windows_per_hole", f"""with hole as (select image_id, y, x from fx_mask where mask_id=1),
reg as (select image_id, y, x from fx_raster where v > 0.03 or image_id%4=0), {cc_sql('hole', 'h', 8, 'image_id')}, {cc_sql('reg', 'g', 8, 'image_id')},
hs as (select image_id, label, count(*) as area, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from h group by 1, 2),
gs as (select image_id, label as rl, min(x) as rx0, min(y) as ry0, max(x) as rx1, max(y) as ry1 from g group by 1, 2),
met as (select distinct h.image_id, h.label, g.label as rl from h join g using (image_id, y, x)),
ar as (select image_id, label, min(rx0) as rx0, min(ry0) as ry0, max(rx1) as rx1, max(ry1) as ry1 from met join gs using (image_id, rl) group by 1, 2),
u as (select image_id, label, area, case when image_id%4=0 then x0 else rx0 end as x0, case when image_id%4=0 then y0 else ry0 end as y0,
case when image_id%4=0 then x1 else rx1 end as x1, case when image_id%4=0 then y1 else ry1 end as y1 from hs join ar using (image_id, label)),
s as (select *, least(trunc(greatest(8.0::double, 3.0::double*greatest(x1-x0, y1-y0)))::int, 50)::int as side from u)
select image_id, label, area::bigint as area, greatest(0, least(round_even((x0+x1)/2.0::double-side/2.0::double, 0), 64-side))::int as wx,
greatest(0, least(round_even((y0+y1)/2.0::double-side/2.0::double, 0), 50-side))::int as wy, side from s""", recursive=True)
def _(spark, sf):
    hole = X.one_mask(spark, sf, 1)
    region = X.raster(spark, sf).where((F.col("v") > 0.03) | (F.col("image_id") % 4 == 0))
    return CC.windows_per_hole(hole, region, X.images(spark, sf), min_side=8)


@query("j13_touching", f"""with m as (select image_id, y, x from fx_mask where mask_id=0), {cc_sql('m', 'c', 8, 'image_id')}
select * from c where (image_id, label) in (select image_id, label from c join fx_raster f using (image_id, y, x) where f.v > 0.2)""", recursive=True)
def _(spark, sf):
    from ..operators.masks import touching
    lab = CC.connected_components(X.one_mask(spark, sf), 8, ["image_id"])
    return touching(lab, X.raster(spark, sf).where("v > 0.2"))


# ---- proposals
@query("t1_pick_proposal", """
with t as (select prompt_id, arg_max(k, (iou, -k)) as top_k, arg_max(area, (iou, -k)) as top_area from fx_prop group by 1),
b as (select prompt_id, arg_max(k, (area, -k)) filter (where area > top_area and area <= 4*top_area and area < 0.3*frame_px and iou >= 0.75) as b from fx_prop join t using (prompt_id) group by 1)
select prompt_id, top_k, coalesce(b, top_k) as picked from t join b using (prompt_id)""")
def _(spark, sf):
    return pick_proposal(X.prop(spark, sf), min_iou=0.75)


@query("t2_keep_proposals", """
with n as (select prompt_id, count(*) filter (where area >= 0.3*10000) as n, arg_max(k, (area, iou, -k)) as bk from fx_prop group by 1),
k as (select p.* from fx_prop p join n using (prompt_id) where case when n > 0 then area >= 0.3*10000 else k = bk end)
select prompt_id, k, iou, area, row_number() over (partition by prompt_id order by iou desc, k) as rank from k""")
def _(spark, sf):
    out = keep_proposals(X.prop(spark, sf), 0.3, box_px="frame_px")
    return out.select("prompt_id", "k", "iou", "area", "rank")


# ---- filling
FILL = f"""kn as (select image_id, y, x, r0, g0, b0, (not (x between 8 and 13 and y between 20 and 26))::int::double as h from fx_frames),
kv as (select image_id, y, x, h, r0*h as r, g0*h as g, b0*h as b from kn), {blur_sql('kv', 'kb', ['h', 'r', 'g', 'b'], N.gaussian_kernel(3.0), RW, H, 'reflect101')}"""


@query("f2_fill_from_background", f"""with {FILL} select k.image_id, k.y, k.x, {', '.join(f'(case when k.h=1 then {c}0 else trunc(b.{c}/greatest(b.h,1e-4)+1e-6) end)::int as {c}' for c in 'rgb')}
from kn k join kb b using (image_id, y, x)""")
def _(spark, sf):
    hole = X.frames(spark, sf).where(F.col("x").between(8, 13) & F.col("y").between(20, 26)).select("image_id", "y", "x")
    return fill.fill_from_background(X.frame_before(spark, sf), hole, 3.0, RW, H)



