"""Frames, composite jobs, backends and streams."""

from pyspark.sql import functions as F

from .. import registry
from ..functions.numeric import r6
from ..operators import frames as FR
from ..operators import neighbourhood as N
from ..operators import raster as R
from ..operators import regions as RG
from ..scale import new_table_path
from ..sources import sinks as SK
from ..streaming import jobs as ST
from . import composites as C
from . import tables as X
from .catalog import query
from .geometry_queries import CHROMA, CHROMA_OUT, ENV, LUM, _environment, r
from .neighbourhood_queries import blur_sql, cc_sql, close_sql, dilate_sql, grey_sql
from .run_queries import JOB_STATE

W, H = X.RGB_WIDTH, X.HEIGHT
BEFORE = "before as (select image_id, y, x, r0 as r, g0 as g, b0 as b from fx_frames)"


def over(o, e, a):
    return f"trunc(least(greatest({o}+({e}-({o}))*{a}, 0), 255))::int"


@query("j2_pixel_diff", """select image_id, y, x, greatest(abs(r0-r1), abs(g0-g1), abs(b0-b1))::int as diff from fx_frames
where greatest(abs(r0-r1), abs(g0-g1), abs(b0-b1)) > 2""")
def _(spark, sf):
    return FR.pixel_diff(X.frame_before(spark, sf), X.frame_after(spark, sf))


@query("j3_composite", f"""with d as (select image_id, y, x, (x between 5 and 12 and y between 10 and 25)::int::double as alpha from fx_frames),
{blur_sql('d', 'a', ['alpha'], N.gaussian_kernel(1.5), W, H, 'reflect101')}
select f.image_id, f.y, f.x, {', '.join(f'{over(c + "0", "255-" + c + "1", "alpha")} as {c}' for c in 'rgb')} from fx_frames f join a using (image_id, y, x)""")
def _(spark, sf):
    base, after = X.frame_before(spark, sf), X.frame_after(spark, sf)
    edit = after.select("image_id", "y", "x", *[(255 - F.col(c)).alias(c) for c in "rgb"])
    region = base.where(F.col("x").between(5, 12) & F.col("y").between(10, 25)).select("image_id", "y", "x")
    return FR.composite(base, edit, N.soft_mask(base, region, 1.5, width=W, height=H))


PASTE = """mv as (select image_id, i::int as move_idx, 5 as sx, 10 as sy, 12 as dx, 25 as dy, (case i when 0 then 1.0 else 0.8 end)::double as s from fx_rgb_images, unnest(range(2)) t(i)),
tg as (select m.image_id, m.move_idx, f.y, f.x, round_even((f.y-dy)/s+sy, 0)::int as py, round_even((f.x-dx)/s+sx, 0)::int as px from mv m join fx_frames f using (image_id)),
foot as (select t.image_id, t.move_idx, t.y, t.x, f.r0 as r, f.g0 as g, f.b0 as b from tg t join fx_frames f on f.image_id=t.image_id and f.y=t.py and f.x=t.px where f.r0 > {thr})"""


def _moves(spark, sf):
    m = F.explode(F.array(*[F.struct(F.lit(i).alias("move_idx"), F.lit(s).alias("scale")) for i, s in enumerate((1.0, 0.8))]))
    return X.rgb_images(spark, sf).select("image_id", F.lit(0).alias("mask_id"), F.lit(5).alias("src_x"), F.lit(10).alias("src_y"),
                                          F.lit(12).alias("dst_x"), F.lit(25).alias("dst_y"), m.alias("m")).select("*", "m.*").drop("m")


def _object(spark, sf, thr=160):
    return X.frame_before(spark, sf).where(F.col("r") > thr).select("image_id", F.lit(0).alias("mask_id"), "y", "x")


@query("j4_affine_paste", f"with {PASTE.format(thr=160)} select * from foot")
def _(spark, sf):
    return FR.affine_paste(X.frame_before(spark, sf), _object(spark, sf), _moves(spark, sf), X.rgb_images(spark, sf))


INSIDE = "x between 5 and 12 and y between 12 and 25"              # the edit began two lines higher


@query("j9_containment_audit", f"select image_id, y, x from fx_frames where (r0<>r1 or g0<>g1 or b0<>b1) and not ({INSIDE})")
def _(spark, sf):
    b = X.frame_before(spark, sf)
    region = b.select("image_id").distinct().selectExpr("image_id", "12 as y0", "25 as y1", "5 as x0", "12 as x1")
    return FR.containment_audit(b, X.frame_after(spark, sf), region)


@query("j9_containment_audit_violations", "select image_id, y, x from fx_frames where (r0<>r1 or g0<>g1 or b0<>b1) and not (x between 6 and 11 and y between 11 and 24)")
def _(spark, sf):
    b = X.frame_before(spark, sf)
    return FR.containment_audit(b, X.frame_after(spark, sf), b.where(F.col("x").between(6, 11) & F.col("y").between(11, 24)))


@query("g7_layer_fold_opaque", f"""with {PASTE.format(thr=160)}, l as (select image_id, y, x, arg_max(r, move_idx) as r, arg_max(g, move_idx) as g, arg_max(b, move_idx) as b from foot group by 1, 2, 3)
select f.image_id, f.y, f.x, coalesce(l.r, r0)::int as r, coalesce(l.g, g0)::int as g, coalesce(l.b, b0)::int as b from fx_frames f left join l using (image_id, y, x)""")
def _(spark, sf):
    b = X.frame_before(spark, sf)
    return FR.layer_fold(b, FR.affine_paste(b, _object(spark, sf), _moves(spark, sf), X.rgb_images(spark, sf)), opaque=True)


def fold_sql(base, c):
    """Two layers with alpha 0.75 and 0.5, the second over the quantised first."""
    first = f"(case when a.{c} is null then {base}.{c} else {over(f'{base}.{c}', f'a.{c}', '0.75::double')} end)"
    return f"(case when z.{c} is null then {first} else {over(first, f'z.{c}', '0.5::double')} end)::int as {c}"


@query("g7_layer_fold", f"""with {PASTE.format(thr=160)}, {BEFORE} select before.image_id, before.y, before.x, {', '.join(fold_sql('before', c) for c in 'rgb')}
from before left join foot a on a.image_id=before.image_id and a.y=before.y and a.x=before.x and a.move_idx=0
left join foot z on z.image_id=before.image_id and z.y=before.y and z.x=before.x and z.move_idx=1""")
def _(spark, sf):
    b = X.frame_before(spark, sf)
    foot = FR.affine_paste(b, _object(spark, sf), _moves(spark, sf), X.rgb_images(spark, sf))
    return FR.layer_fold(b, foot.withColumn("alpha", F.when(F.col("move_idx") == 0, 0.75).otherwise(0.5)))


@query("f3_paste_inserter", f"""with {PASTE.format(thr=200)}, l as (select image_id, y, x, arg_max(r, move_idx) as r, arg_max(g, move_idx) as g, arg_max(b, move_idx) as b from foot group by 1, 2, 3)
select f.image_id, f.y, f.x, coalesce(l.r, r1)::int as r, coalesce(l.g, g1)::int as g, coalesce(l.b, b1)::int as b from fx_frames f left join l using (image_id, y, x)""")
def _(spark, sf):
    insert = registry.make("insertion", "paste", registry.config(insertion="paste", feather_px=0))
    out, _footprint = insert(X.frame_before(spark, sf), X.frame_after(spark, sf), _object(spark, sf, 200), _moves(spark, sf), X.rgb_images(spark, sf))
    return out


def feathered_sql(bg, r, g, b, grow=15, feather=4.0):
    """Tables up to `fd`: two layers, each the object over the background, faded by the blurred, grown footprint, folded one after the other."""
    side = f"select f.image_id, f.move_idx, p.y, p.x, (f.y is not null)::int::double as alpha"
    near = f"w.image_id=p.image_id and w.move_idx=p.move_idx and abs(w.y-p.y) <= {grow} and abs(w.x-p.x) <= {grow}"
    layer = {c: f"coalesce(l{{k}}.{c}, n.{v})" for c, v in zip("rgb", (r, g, b))}

    def step(k, c, below):
        return f"(case when al{k}.alpha is null then {below} else {over(below, layer[c].format(k=k), f'al{k}.alpha')} end)"
    folded = ", ".join(f"{step(1, c, step(0, c, f'n.{v}'))}::int as {c}" for c, v in zip("rgb", (r, g, b)))
    both = " ".join(f"left join al al{k} on al{k}.image_id=n.image_id and al{k}.move_idx={k} and al{k}.y=n.y and al{k}.x=n.x left join foot l{k} on l{k}.image_id=n.image_id and l{k}.move_idx={k} and l{k}.y=n.y and l{k}.x=n.x" for k in (0, 1))
    return f"""pl as (select distinct f.image_id, f.move_idx, p.y, p.x from (select distinct image_id, move_idx from foot) f join fx_frames p using (image_id)),
gl as (select p.*, exists (select 1 from foot w where {near})::int::double as alpha from pl p),
{blur_sql('gl', 'al', ['alpha'], N.gaussian_kernel(feather), W, H, 'reflect101', 'image_id,move_idx')}, fd as (select n.image_id, n.y, n.x, {folded} from {bg} n {both})"""


@query("f3_paste_feathered", f"""with {PASTE.format(thr=200)}, {feathered_sql('fx_frames', 'r1', 'g1', 'b1')} select * from fd""")
def _(spark, sf):
    insert = registry.make("insertion", "paste", {**registry.config(insertion="paste"), "width": W, "height": H})
    out, _layer = insert(X.frame_before(spark, sf), X.frame_after(spark, sf), _object(spark, sf, 200), _moves(spark, sf), X.rgb_images(spark, sf))
    return out


# ---- composite jobs
C1 = f"""s3 as (select *, p::int as pass_id, p=2 as mirrored from fx_scores, unnest(range(3)) t(p)),
sm as (select image_id, model, y, (case when mirrored then 7-x else x end)::int as x, class_id, pass_id, mirrored, logit*(1+3*pass_id) as logit from s3),
e as (select *, exp(logit - max(logit) over (partition by image_id, pass_id, model, y, x)) as e from sm),
q as (select *, e / sum(e) over (partition by image_id, pass_id, model, y, x) as p from e),
m as (select image_id, y, x, pass_id, mirrored, class_id, avg(p) as p from q group by all),
b as (select image_id, y, x, pass_id, mirrored, max({{'p': p, 'neg': -class_id}}) as b from m group by all),
v as (select image_id, y, (case when mirrored then 7-x else x end)::int as x, pass_id, (-b.neg) in (1, 3, 5, 6) as v from b),
cnt as (select image_id, y, x, count(*) as n_pass, count(*) filter (where v) as n_on from v group by 1, 2, 3),
raw as (select image_id, y, x from cnt where n_on >= ceil(n_pass/2.0)), {close_sql('raw', 'cl', N.rect(5, 5), 8, 50, 'image_id')}, {cc_sql('cl', 'c', 8, 'image_id')},
sz as (select image_id, label, count(*) as n from c group by 1, 2),
mask as (select c.image_id, count(*) as mask_px from c join sz using (image_id, label) where n > 0.02*8*50 group by 1),
ag as (select image_id, pass_id, round_even((count(*) filter (where v and major))::double / greatest(count(*) filter (where v or major), 1), 4)::double as iou,
round_even((count(*) filter (where n_on=0 or n_on=n_pass))*100.0::double/count(*), 2)::double as una from (select v.*, n_on, n_pass, n_on >= ceil(n_pass/2.0) as major from v join cnt using (image_id, y, x)) group by 1, 2)"""


@query("c1_label_consensus", f"""with {C1} select image_id, coalesce(mask_px, 0)::bigint as mask_px, min(iou) as worst_iou, max(una) as unanimous_pct from ag left join mask using (image_id) group by 1, 2""", recursive=True)
def _(spark, sf):
    p = F.explode(F.array(*[F.lit(i) for i in range(3)]))
    s = X.scores(spark, sf).withColumn("pass_id", p).withColumn("mirrored", F.col("pass_id") == 2)
    s = s.withColumns({"x": F.when(F.col("mirrored"), 7 - F.col("x")).otherwise(F.col("x")).cast("int"), "logit": F.col("logit") * (1 + 3 * F.col("pass_id"))})
    small = X.images(spark, sf).withColumn("width", F.lit(8))
    mask, agree = C.label_consensus(s, X.classes(spark, sf), [f"nation_{i}" for i in (1, 3, 5, 6)], small, 8, 50, frac=0.02)
    px = mask.groupBy("image_id").agg(F.count("*").alias("mask_px"))
    a = agree.groupBy("image_id").agg(F.min("iou_vs_majority").alias("worst_iou"), F.max("unanimous_pct").alias("unanimous_pct"))
    return a.join(px, "image_id", "left").fillna(0, ["mask_px"])


def c4_sql():
    e5 = N.ellipse(5)
    parts = []
    for c in "rgb":
        chain = [f"{c}0 as (select image_id, y, x, {c} as v from fx_rgb)"]
        for i, fn in enumerate(("max", "min", "min", "max")):
            chain.append(grey_sql(f"{c}{i}", f"{c}{i + 1}", e5, fn))
        parts.append(", ".join(chain))
    thin = {c: f"(abs({c}4.v-p.{c}) > 0.1*greatest(p.{c}, 1e-3))" for c in "rgb"}
    flat = f"""flat as (select image_id, y, x, p.r > 0.4 as inside, {', '.join(f'greatest(case when {thin[c]} then {c}4.v else p.{c} end, 1e-5) as {c}' for c in 'rgb')},
({' + '.join(f'{thin[c]}::int' for c in 'rgb')})/3.0::double as thin from fx_rgb p join r4 using (image_id, y, x) join g4 using (image_id, y, x) join b4 using (image_id, y, x))"""
    lum = LUM
    rest = f"""sh as (select image_id, round_even(avg(thin)*100, 2)::double as grout_filtered_pct, avg({lum}) as ref from flat where inside group by 1),
lit as (select image_id, y, x, inside, r/greatest(ref,1e-5) as r, g/greatest(ref,1e-5) as g, b/greatest(ref,1e-5) as b from flat join sh using (image_id)),
am as (select image_id, least(greatest(quantile_cont({lum}, 0.03)/greatest(quantile_cont({lum}, 0.95), 1e-5), 0.05), 0.6) as a from lit where inside group by 1)"""
    chroma = CHROMA.replace("from fx_rgb where r > 0.3", "from lit where inside")
    env = ENV
    return f"""with {', '.join(parts)}, {flat}, {rest}, {chroma}, {env}
select image_id, grout_filtered_pct, {r('ref', 'ref_irradiance')}, {r('a', 'ambient_fraction')}, {CHROMA_OUT}, n::bigint as n_above,
{', '.join(r(f'coalesce(case when n > 100 then above_{c} else off_{c} end, 0.1)', f'env_{c}') for c in 'rgb')}
from sh join am using (image_id) join c using (image_id) join f using (image_id)"""


@query("c4_field_report", c4_sql())
def _(spark, sf):
    light = X.rgb(spark, sf).withColumn("inside", F.col("r") > 0.4)
    out = C.field_report(light, _environment(spark, sf), 5, 0.1)
    return out.withColumns({c: r6(c) for c in out.columns if c not in ("image_id", "n_above", "grout_filtered_pct")})


C5 = f"""ob as (select image_id, 0 as mask_id, y, x from fx_frames where r0 > 200), {dilate_sql('ob', 'hole', N.rect(3, 3), W, H)},
kn as (select f.image_id, f.y, f.x, r0, g0, b0, (h.x is null)::int::double as h from fx_frames f left join hole h using (image_id, y, x)),
kv as (select image_id, y, x, h, r0*h as r, g0*h as g, b0*h as b from kn), {blur_sql('kv', 'kb', ['h', 'r', 'g', 'b'], N.gaussian_kernel(3.0), W, H, 'reflect101')},
bg as (select k.image_id, k.y, k.x, {', '.join(f'(case when k.h=1 then {c}0 else trunc(b.{c}/greatest(b.h,1e-4)+1e-6) end)::int as {c}' for c in 'rgb')} from kn k join kb b using (image_id, y, x)),
{PASTE.format(thr=200)}, l as (select image_id, y, x, arg_max(r, move_idx) as r, arg_max(g, move_idx) as g, arg_max(b, move_idx) as b from foot group by 1, 2, 3)"""


@query("c5_move_objects", f"""with {C5} select bg.image_id, bg.y, bg.x, {', '.join(f'coalesce(l.{c}, bg.{c})::int as {c}' for c in 'rgb')}, 0::bigint as violations from bg left join l using (image_id, y, x)""")
def _(spark, sf):
    cfg = registry.config(dilate_radius=1, src_region="mask", feather_px=0)
    out, audit, _rejected = C.move_objects(X.frame_before(spark, sf), _object(spark, sf, 200), _moves(spark, sf), X.rgb_images(spark, sf), cfg, W, H)
    return _with_violations(out, audit)


def _with_violations(out, audit):
    bad = audit.groupBy("image_id").agg(F.count("*").alias("violations"))
    return out.join(bad, "image_id", "left").fillna(0, ["violations"])


@query("c5_move_objects_feathered", f"""with {C5}, {feathered_sql('bg', 'r', 'g', 'b')} select *, 0::bigint as violations from fd""")
def _(spark, sf):
    cfg = registry.config(dilate_radius=1, src_region="mask")
    out, audit, _rejected = C.move_objects(X.frame_before(spark, sf), _object(spark, sf, 200), _moves(spark, sf), X.rgb_images(spark, sf), cfg, W, H)
    return _with_violations(out, audit)


REFERENCES = """mv as (select f.image_id + 100000 * (i // 2) as image_id, i::int as move_idx, (7 * (i % 2))::int as mask_id from fx_rgb_images f, unnest(range(4)) t(i)),
ob as (select distinct image_id from fx_frames where r0 > 200)"""


def _references(spark, sf):
    i = F.explode(F.sequence(F.lit(0), F.lit(3)))
    m = X.rgb_images(spark, sf).select(F.col("image_id").alias("f"), i.alias("move_idx"))
    return m.select((F.col("f") + 100000 * F.floor(F.col("move_idx") / 2)).alias("image_id"), "move_idx", (F.col("move_idx") % 2 * 7).cast("int").alias("mask_id"))


@query("c5_move_references", f"""with {REFERENCES} select mv.*, case when mv.image_id not in (select image_id from fx_rgb_images) then 'unknown image'
when mask_id <> 0 or image_id not in (select image_id from ob) then 'unknown or empty mask' end as error from mv""")
def _(spark, sf):
    return FR.checked_moves(_references(spark, sf), _object(spark, sf, 200), X.rgb_images(spark, sf))


C6 = f"""{BEFORE}, li as (select image_id, (y//2)::int as y, (x//2)::int as x, {', '.join(f'trunc(avg({c})+0.5)::int as {c}' for c in 'rgb')} from before group by all),
lo as (select image_id, y, x, (case when x between 3 and 5 and y between 8 and 12 then 255-r else r end)::int as r, g, b from li),
ch as (select image_id, y, x from li a join lo b using (image_id, y, x) where abs(a.r-b.r) > 2), {dilate_sql('ch', 'gr', N.rect(3, 3), 11, 25, 'image_id')},
up as (select p.image_id, p.y, p.x, (g.x is not null)::int::double as alpha from fx_frames p left join gr g on g.image_id=p.image_id and g.y=p.y//2 and g.x=p.x//2),
{blur_sql('up', 'al', ['alpha'], N.gaussian_kernel(2.0), W, H, 'reflect101')}"""


@query("c6_multires_merge", f"""with {C6} select f.image_id, f.y, f.x, {', '.join(f'{over("f." + c, "lo." + c, "alpha")} as {c}' for c in 'rgb')}
from before f join al using (image_id, y, x) join lo on lo.image_id=f.image_id and lo.y=f.y//2 and lo.x=f.x//2""")
def _(spark, sf):
    b = X.frame_before(spark, sf)
    low = R.block_mean(b, 2, ["r", "g", "b"], W, H, white=255.0)
    low = low.select("image_id", "y", "x", *[F.col(f"{c}_u8").alias(c) for c in "rgb"])
    hit = F.col("x").between(3, 5) & F.col("y").between(8, 12)
    edited = low.withColumn("r", F.when(hit, 255 - F.col("r")).otherwise(F.col("r")))
    return C.multires_merge(b, low, edited, 2, W, H, grow_px=1, feather_px=2.0)


@query("c5_depth_scaled_moves", """
with mv as (select image_id, i::int as move_idx, 5+i as sx, 10+i*3 as sy, 40-i*20 as dx, 25+i*10 as dy from fx_images, unnest(range(2)) t(i)),
e as (select *, 'src' as e, sx as ax, sy as ay from mv union all select *, 'dst', dx, dy from mv),
m as (select e.image_id, move_idx, e, coalesce(median(z) filter (where valid), median(z)) as z from e join fx_depth d on d.image_id = e.image_id
and d.x between ax-6 and ax+6 and d.y between ay-6 and ay+6 group by 1, 2, 3),
p as (select image_id, move_idx, max(case when e='src' then z end) as zs, max(case when e='dst' then z end) as zd from m group by 1, 2)
select image_id, move_idx, sx::int as src_x, sy::int as src_y, dx::int as dst_x, dy::int as dst_y, case when zs is not null and zd is not null then round(least(greatest(zs/greatest(zd, 1e-3), 0.25), 4), 6) end as scale
from mv left join p using (image_id, move_idx)""")
def _(spark, sf):
    i = F.col("move_idx")
    moves = X.images(spark, sf).select("image_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("move_idx")).select(
        "image_id", "move_idx", (5 + i).alias("src_x"), (10 + i * 3).alias("src_y"), (40 - i * 20).alias("dst_x"), (25 + i * 10).alias("dst_y"))
    return C.scaled_moves(moves, "auto", X.depth(spark, sf)).withColumn("scale", r6("scale"))


@query("c6_low_resolution_task", f"""with {PASTE.format(thr=160)}, o as (select image_id, 0::int as mask_id, y, x from fx_frames where r0 > 160 and y < 50-50%4 and x < 22-22%4),
lm as (select image_id, mask_id, count(distinct (y//4, x//4))::bigint as mask_px from o group by 1, 2)
select image_id, move_idx, (sx//4)::int as src_x, (sy//4)::int as src_y, (dx//4)::int as dst_x, (dy//4)::int as dst_y, mask_px from mv join lm using (image_id)""")
def _(spark, sf):
    moves, masks = C.low_resolution_moves(_moves(spark, sf), _object(spark, sf), 4, W, H)
    px = masks.groupBy("image_id", "mask_id").agg(F.count("*").alias("mask_px"))
    return moves.join(px, ["image_id", "mask_id"]).select("image_id", "move_idx", "src_x", "src_y", "dst_x", "dst_y", "mask_px")


@query("a27_empty_masks", """select image_id, m::int as mask_id, 'mask is empty' as error from fx_images, unnest(range(2)) t(m)
where not exists (select 1 from fx_raster r where r.image_id = fx_images.image_id and r.v > 0.4::double + m*0.06::double)""")
def _(spark, sf):
    wanted = X.images(spark, sf).select("image_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("mask_id"))
    px = X.raster(spark, sf)
    which = F.filter(F.array(F.when(F.col("v") > 0.4, 0), F.when(F.col("v") > F.lit(0.4) + 0.06, 1)), lambda m: m.isNotNull())
    return RG.empty_masks(wanted, px.select("image_id", F.explode(which).alias("mask_id")))


@query("a27_subject_on_white", f"""with m as (select image_id, (y//12)*10 + x//12 as mask_id, y, x from fx_frames where r0 > 160),
b as (select image_id, mask_id, min(x) as x0, min(y) as y0, max(x)+1 as x1, max(y)+1 as y1 from m group by 1, 2)
select b.image_id, b.mask_id::int as mask_id, greatest(x1-x0, y1-y0)::int as side, (f.y-y0+floor((greatest(x1-x0, y1-y0)-(y1-y0))/2.0))::int as cy,
(f.x-x0+floor((greatest(x1-x0, y1-y0)-(x1-x0))/2.0))::int as cx, {', '.join(f'(case when m.x is null then 255 else {c}0 end)::int as {c}' for c in 'rgb')}
from b join fx_frames f on f.image_id=b.image_id and f.x >= x0 and f.x < x1 and f.y >= y0 and f.y < y1
left join m on m.image_id=b.image_id and m.mask_id=b.mask_id and m.y=f.y and m.x=f.x""")
def _(spark, sf):
    px = X.frame_before(spark, sf)
    cell = (F.floor(F.col("y") / 12) * 10 + F.floor(F.col("x") / 12)).cast("int")
    objects = px.where("r > 160").select("image_id", cell.alias("mask_id"), "y", "x")
    out = RG.on_white(RG.square_crop(px, objects, X.rgb_images(spark, sf), 1.0))
    return out.select("image_id", "mask_id", "side", "cy", "cx", "r", "g", "b")


# ---- streams
def _in_files(spark, df, files=5):
    """The rows of a table in a few files that follow no order, as a folder for a stream that takes one file at a time."""
    path = new_table_path(spark, "files")
    df.repartition(files, F.xxhash64("event_id")).write.parquet(path)
    return path


@query("m1_job_state_stream", JOB_STATE)
def _(spark, sf):
    files = _in_files(spark, X.read(spark, sf, "events"))
    events = X.job_events(ST.event_stream(spark, files, files_per_trigger=1))
    sink, check = new_table_path(spark, "states"), new_table_path(spark, "progress")
    ST.run_available(ST.job_state_stream(events), sink, check, "update")
    return X.plain_times(ST.latest_states(spark, sink).drop("error"))


@query("m3_stage_log_stream", """select user_id as job_id, event_id as seq, ts, stage, case when k%3 > 0 then 'm'||k%3 end as model, value as time_s,
case when k%5=0 then value/2 end as gen_s, case when k%2=0 then k/4.0::double end as gpu_peak_gb
from (select e.*, (props->>'k')::int as k, j.stage from events e join fx_job_events j on e.event_id = j.seq and e.user_id = j.job_id where j.type='stage')""")
def _(spark, sf):
    raw = X.read(spark, sf, "events")
    files = _in_files(spark, raw.unionByName(raw.where("event_id % 3 = 0").withColumn("event_id", F.col("event_id"))), 3)
    events = X.job_events(ST.event_stream(spark, files, files_per_trigger=1))
    again = events.withColumn("twice", F.explode(F.array(F.lit(0), F.lit(1)))).drop("twice")
    sink, check = new_table_path(spark, "stage_log"), new_table_path(spark, "progress")
    ST.stage_log(again, sink, check)
    return X.plain_times(spark.read.parquet(sink).drop("batch", "bucket"))


@query("m4_cache_fill_stream", "select 'seg_'||content_key||'_v1' as cache_key, max(size)::bigint as result from fx_assets group by 1")
def _(spark, sf):
    docs = ST.event_stream(spark, f"{sf}/documents.parque[t]")      # as a pattern it names a file and a folder of files alike
    a = docs.select(SK.content_key(F.col("text")).alias("content_key"), F.col("n_chars").alias("size"))
    cache, schema = new_table_path(spark, "cache"), "cache_key string, result bigint"
    for name in ("first", "again"):      # the second stream over the same assets finds everything cached
        ST.cache_fill_stream(a, cache, SK.cache_key("seg", F.col("content_key"), "v1"),
                             lambda miss: miss.select("cache_key", F.col("size").cast("bigint").alias("result")),
                             new_table_path(spark, f"progress-{name}"), schema, name)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(cache)
