"""Raster, mask and voting queries."""

from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import masks as M
from ..operators import raster as R
from . import tables as X
from .catalog import query

MASK0 = "(select image_id, y, x from fx_mask where mask_id = 0)"
MASK1 = "(select image_id, y, x from fx_mask where mask_id = 1)"


@query("s4_explode_raster", "select image_id, y, x, round(v, 6) + 0.0::double as v from fx_raster")
def _(spark, sf):
    return X.raster(spark, sf).withColumn("v", r6("v"))


@query("a1_block_mean", """
with b as (select image_id, (y//4)::int as y, (x//4)::int as x, avg(v) as v, avg(v+0.5) as w from fx_raster
           where y < 50 - 50%4 and x < 64 - 64%4 group by 1, 2, 3)
select image_id, y, x, round(v, 6) + 0.0::double as v, trunc(least(greatest(w*255+0.5, 0), 255))::int as v_u8 from b""")
def _(spark, sf):
    px = X.raster(spark, sf).withColumn("w", F.col("v") + 0.5)
    out = R.block_mean(px, 4, ["v", "w"], X.WIDTH, X.HEIGHT)
    return out.select("image_id", "y", "x", r6("v").alias("v"), F.col("w_u8").alias("v_u8"))


@query("a2_block_any", """select distinct image_id, mask_id, (y//4)::int as y, (x//4)::int as x from fx_mask
where y < 50 - 50%4 and x < 64 - 64%4""")
def _(spark, sf):
    return R.block_any(X.mask(spark, sf), 4, X.WIDTH, X.HEIGHT)


@query("j8_upsample_nearest", """
with low as (select image_id, y//4 as y, x//4 as x, avg(v) as v from fx_raster where y < 48 group by all)
select image_id, (y*4+dy)::int as y, (x*4+dx)::int as x, round(v, 6) + 0.0::double as v
from low, unnest(range(4)) a(dy), unnest(range(4)) b(dx)""")
def _(spark, sf):
    low = R.block_mean(X.raster(spark, sf), 4, ["v"], X.WIDTH, X.HEIGHT)
    return R.upsample_nearest(low, 4, ["image_id", "v"]).withColumn("v", r6("v"))


@query("a3_mask_stats", """
select image_id, mask_id, count(*)::bigint as area, min(x)::int as x0, min(y)::int as y0, max(x)::int as x1, max(y)::int as y1,
(max(x)+1)::int as x1_excl, (max(y)+1)::int as y1_excl, round_even(count(*)*100.0::double/(64*50), 2)::double as coverage_pct,
(min(x)+max(x))/2.0::double as cx, (min(y)+max(y))/2.0::double as cy from fx_mask group by 1, 2""")
def _(spark, sf):
    return M.mask_stats(X.mask(spark, sf), X.images(spark, sf))


SOFT = """with e as (select *, exp(logit - max(logit) over (partition by image_id, model, y, x)) as e from fx_scores),
s as (select *, e / sum(e) over (partition by image_id, model, y, x) as p from e),
m as (select image_id, y, x, class_id, avg(p) as p from s group by all),
b as (select image_id, y, x, max({'p': p, 'neg': -class_id}) as b from m group by all),
best as (select image_id, y, x, (-b.neg)::int as class_id, b.p as p from b)"""


@query("a4_ensemble_argmax", SOFT + """
select image_id, y, x, class_id, round(p, 6) as p, trim(split_part(lower(n_name), ',', 1)) as name,
lower(n_name) in ('nation_1', 'nation_3') as is_wanted from best left join nation on class_id = n_nationkey""")
def _(spark, sf):
    out = M.ensemble_argmax(X.scores(spark, sf), X.classes(spark, sf), ["nation_1", "nation_3"])
    return out.withColumn("p", r6("p"))


@query("a5_majority_vote", """select image_id, y, x, n_on::bigint as n_on, n_pass::bigint as n_pass,
n_on >= ceil(n_pass/2.0) as v from fx_vote_counts""")
def _(spark, sf):
    return M.majority_vote(X.votes(spark, sf), X.WIDTH)


AGREE = """select image_id, pass_id,
round_even((count(*) filter (where v and major))::double / greatest(count(*) filter (where v or major), 1), 4)::double as iou_vs_majority,
round_even((count(*) filter (where n_on = 0 or n_on = n_pass))*100.0::double/count(*), 2)::double as unanimous_pct
from (select v.image_id, v.pass_id, v.v, c.n_on, c.n_pass, c.n_on >= ceil(c.n_pass/2.0) as major
      from fx_votes v join fx_vote_counts c
      on v.image_id = c.image_id and v.y = c.y and c.x = case when v.mirrored then 63-v.x else v.x end) group by 1, 2"""


@query("a6_vote_agreement", AGREE)
def _(spark, sf):
    return M.vote_agreement(X.votes(spark, sf), X.WIDTH)


@query("consensus_report", f"""
with agree as ({AGREE}),
maj as (select image_id, count(*) filter (where n_on >= ceil(n_pass/2.0)) as area, count(*) as n from fx_vote_counts group by 1),
a as (select image_id, min(iou_vs_majority) as worst_iou, max(unanimous_pct) as unanimous_pct from agree group by 1)
select image_id, area::bigint as area, round_even(area*100.0::double/n, 2)::double as coverage_pct, worst_iou, unanimous_pct
from maj join a using (image_id)""")
def consensus_report(spark, sf):
    votes = X.votes(spark, sf)
    share = M.majority_vote(votes, X.WIDTH).groupBy("image_id").agg(F.count_if("v").alias("area"), F.count("*").alias("n"))
    agree = M.vote_agreement(votes, X.WIDTH).groupBy("image_id").agg(
        F.min("iou_vs_majority").alias("worst_iou"), F.max("unanimous_pct").alias("unanimous_pct"))
    return share.join(agree, "image_id").select(
        "image_id", "area", F.bround(F.col("area") * 100.0 / F.col("n"), 2).alias("coverage_pct"), "worst_iou", "unanimous_pct")


@query("a7_mask_iou", f"""
with a as {MASK0}, b as (select image_id, y, x from fx_raster where v < 0.08),
f as (select image_id, y, x, max(a) as a, max(b) as b from (select *, 1 as a, 0 as b from a union all select *, 0, 1 from b) group by all)
select image_id, sum(a*b)::bigint as inter, count(*)::bigint as uni, round(sum(a*b)/count(*), 6)::double as iou from f group by 1""")
def _(spark, sf):
    other = X.raster(spark, sf).where("v < 0.08")
    return M.mask_iou(X.one_mask(spark, sf), other).withColumn("iou", r6("iou"))


@query("a8_instance_union", """
with inst as (select distinct image_id, y % 5 as instance_id, 0.5 + (y % 5) / 10.0 + (image_id % 3) / 20.0 as score from fx_raster)
select distinct m.image_id, m.y, m.x from fx_mask m join inst i on m.image_id = i.image_id and m.y % 5 = i.instance_id
where score > 0.65""")
def _(spark, sf):
    inst = _instances(spark, sf)
    px = X.mask(spark, sf).withColumn("instance_id", F.col("y") % 5)
    return M.instance_union(inst, px, 0.65)


def _instances(spark, sf):
    k = F.col("y") % 5
    return X.raster(spark, sf).select("image_id", k.alias("instance_id"), F.round(F.lit(0.5) + k / 10 + (F.col("image_id") % 3) / 20, 4).alias("score")).distinct()


@query("a8_instance_scores", """select prompt_id, round_even(iou, 3)::double as score, count(*)::bigint as n from fx_prop
where iou > 0.85 group by 1, 2""")
def _(spark, sf):
    return M.instance_scores(X.prop(spark, sf).withColumnRenamed("iou", "score"), 0.85, ("prompt_id",))


@query("a25_border_fraction", """
with p as (select image_id, y, x, (r0 >= 133 and g0 >= 133 and b0 >= 133)::int as white,
(y=0)::int + (y=49)::int + (x=0)::int + (x=21)::int as n from fx_frames),
s as (select image_id, sum(white*n)::double/sum(n) as border_white from p group by 1)
select image_id, round(border_white, 6)::double as border_white,
case when image_id%7=0 then 'none' when border_white >= 0.12 then 'white' else 'rmbg' end as matte from s""")
def _(spark, sf):
    images = X.rgb_images(spark, sf).withColumn("has_alpha", F.col("image_id") % 7 == 0)
    return M.border_fraction(X.frame_before(spark, sf), images, tol=122, frac=0.12).withColumn("border_white", r6("border_white"))


@query("u1_mask_union", """
with m as (select l_suppkey % (select count(distinct vec_id//50) from embeddings) as image_id, l_linenumber % 2 as tight, case when l_quantity > 25 then (l_linenumber+1) % 2 end as region from lineitem)
select distinct k.image_id, k.y, k.x from fx_mask k join m on k.image_id = m.image_id and k.mask_id = coalesce(m.region, m.tight)""")
def _(spark, sf):
    li = X.read(spark, sf, "lineitem")
    moves = li.select((F.col("l_suppkey") % X.image_count(spark, sf)).alias("image_id"), (F.col("l_linenumber") % 2).alias("tight"),
                      F.when(F.col("l_quantity") > 25, (F.col("l_linenumber") + 1) % 2).alias("region"))
    return M.union_of_moves(X.mask(spark, sf), moves, "region", "tight")


@query("u2_mask_intersection", f"select image_id, y, x from fx_raster where v > 0.05 and v < 0.2")
def _(spark, sf):
    return M.intersection(X.one_mask(spark, sf), X.raster(spark, sf).where("v < 0.2").select("image_id", "y", "x"))


@query("u3_mask_difference", f"select image_id, y, x from fx_raster where v > 0.05 and not v > 0.1")
def _(spark, sf):
    return M.difference(X.one_mask(spark, sf, 0), X.one_mask(spark, sf, 1))


@query("u4_label_membership", SOFT + """
select image_id, y, x, class_id from best where class_id in (select n_nationkey from nation where lower(n_name) in ('nation_1', 'nation_2', 'nation_4'))""")
def _(spark, sf):
    best = M.ensemble_argmax(X.scores(spark, sf), X.classes(spark, sf), []).select("image_id", "y", "x", "class_id")
    return M.label_membership(best, "class_id", ["nation_1", "nation_2", "nation_4"], X.classes(spark, sf))
