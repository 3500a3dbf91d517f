"""Sources, run logs, jobs and request checks."""

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions.numeric import r6
from ..operators import jobs as J
from ..operators import requests as Q
from ..operators import runs as R
from ..scale import new_table_path
from ..sources import assets as SA
from ..sources import moves as SM
from ..sources import runs as SR
from ..sources import sinks as SK
from . import tables as X
from .catalog import query

FACTS = """facts as (select event_id, run_id, ts, case stage when 'illumination' then 'irradiance' else stage end as stage,
coalesce(time_s, gen_s, 0) as seconds, cached, k, props from fx_stages)"""


def _facts(spark, sf):
    return R.stage_facts(X.stages(spark, sf))


@query("s1_run_source", """
select 'floor' as kind, 'scene'||user_id%4 as scene_name, 'ensemble' as segmenter,
case when user_id%2=0 then 'smooth-matte' else 'smooth-glossy' end as material_name, event_type as pattern_name, seed,
0::int as stage_idx, case event_type when 'signup' then 'irradiance' else event_type end as stage, round(value, 4) as time_s, (props->>'k')::int < 50 as cached, k as extra_k
from (select *, event_id::int as seed, (props->>'k')::int as k from events)""")
def _(spark, sf):
    e = X.read(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    even = F.col("user_id") % 2 == 0
    stage = F.struct(F.when(F.col("event_type") == "signup", "illumination").otherwise(F.col("event_type")).alias("stage"),
                     F.when(even, F.col("value")).alias("gen_s"), F.when(~even, F.col("value")).alias("time_s"),
                     (k < 50).alias("cached"), k.alias("k"))
    docs = e.select(F.lit("floor").alias("kind"), F.concat(F.lit("scene"), F.col("user_id") % 4).alias("scene"),
                    F.col("event_type").alias("pattern"), F.lit("ensemble").alias("seg"),
                    F.when(even, "smooth-matte").otherwise("smooth-glossy").alias("material"),
                    F.col("event_id").cast("int").alias("seed"), F.array(stage).alias("stages"))
    root = new_table_path(spark, "runs")
    docs.write.partitionBy("kind", "scene", "pattern", "seg", "material").json(root)
    runs = SR.read_runs(spark, root, multi_line=False)
    rows = SR.stage_rows(runs, ["kind", "scene_name", "pattern_name", "segmenter", "material_name", "seed"])
    return rows.select("kind", "scene_name", "pattern_name", "segmenter", "material_name", "seed", "stage_idx", "stage",
                       F.round("time_s", 4).alias("time_s"), "cached", F.col("extras")["k"].cast("int").alias("extra_k"))


@query("s2_move_source", """
with d as (select l_orderkey||'-'||l_linenumber||'-'||l_partkey||'-'||l_suppkey as scene, l_linenumber as n, l_partkey::int as p, l_suppkey::int as s, l_quantity::int as q from lineitem)
select scene, 0::int as move_idx, p as src_x, s as src_y, q as dst_x, n as dst_y, null::varchar as mask_id from d where n%3=0
union all select scene, 0::int, p, s, round_even((q + (q + n))/2.0::double, 0)::int, round_even((s+(s+q))/2.0::double, 0)::int, 'm'||p from d where n%3<>0
union all select scene, 1::int, s, p, n, q, null from d where n%3<>0""")
def _(spark, sf):
    li = X.read(spark, sf, "lineitem")
    n, p, s, q = F.col("l_linenumber"), F.col("l_partkey").cast("int"), F.col("l_suppkey").cast("int"), F.col("l_quantity").cast("int")

    def point(x, y):
        return F.struct(x.alias("x"), y.alias("y"))
    listed = F.array(
        F.struct(point(p, s).alias("initial"), F.lit(None).cast("struct<x:int,y:int>").alias("final"),
                 F.array(q, s, q + n, s + q).alias("dst_box"), F.concat(F.lit("m"), p).alias("mask")),
        F.struct(point(s, p).alias("initial"), point(n, q).alias("final"), F.lit(None).cast("array<int>").alias("dst_box"),
                 F.lit(None).cast("string").alias("mask")))
    pair = n % 3 == 0
    docs = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("scene"),
                     F.when(~pair, listed).alias("moves"), F.when(pair, point(p, s)).alias("initial"), F.when(pair, point(q, n)).alias("final"))
    root = new_table_path(spark, "moves")
    docs.write.json(root)
    return SM.read_moves(spark, root, multi_line=False).select("scene", "move_idx", "src_x", "src_y", "dst_x", "dst_y", "mask_id")


@query("s3_asset_inventory", """
select kind, lpad(asset_id::varchar,12,'0') as asset_id, 'file:/data/uploads/'||kind||'/'||lpad(asset_id::varchar,12,'0')||case when is_clean then '_clean.png' else '.jpg' end as path,
'file:/data/uploads/'||kind||'/'||lpad(asset_id::varchar,12,'0')||'.jpg' as original_path, 'jpg' as ext, size*4096 as size, is_clean as precleaned,
size*4096 > 20*1024*1024 as too_large from fx_assets""")
def _(spark, sf):
    return SA.asset_inventory(X.listing(spark, sf))


@query("s5_partitioned_sink", """
select 'scene'||user_id%4 as scene, event_type as pattern, 'ensemble' as seg, 'm'||user_id%2 as material, event_id,
case when event_type = 'view' then value + 1000 else value end as value from events""")
def _(spark, sf):
    e = X.read(spark, sf, "events").select(
        F.concat(F.lit("scene"), F.col("user_id") % 4).alias("scene"), F.col("event_type").alias("pattern"), F.lit("ensemble").alias("seg"),
        F.concat(F.lit("m"), F.col("user_id") % 2).alias("material"), "event_id", "value")
    root = new_table_path(spark, "results")
    SK.write_result(e, root)
    SK.write_result(e.where("pattern = 'view'").withColumn("value", F.col("value") + 1000), root)
    return spark.read.parquet(root).select("scene", "pattern", "seg", "material", "event_id", "value")


@query("s6_incremental_cache", """
with k as (select asset_id, kind, 'seg_'||content_key||'_ensemble_1_0' as cache_key, size from fx_assets),
old as (select cache_key, max(size)::bigint as result from k where kind in ('src1','src3','src5') group by 1)
select asset_id, k.cache_key, coalesce(o.result, f.result)::bigint as result, o.cache_key is not null as cached
from k left join old o using (cache_key) join (select cache_key, max(size) as result from k group by 1) f using (cache_key)""")
def _(spark, sf):
    a = X.assets(spark, sf)
    key = SK.cache_key("seg", F.col("content_key"), "ensemble", 1, 0)
    old = a.where(F.col("kind").isin("src1", "src3", "src5")).select(key.alias("cache_key"), F.col("size").alias("result")) \
        .groupBy("cache_key").agg(F.max("result").alias("result"))
    rows, _fresh = SK.incremental(a, old, key, lambda miss: miss.select("cache_key", F.col("size").alias("result")))
    return rows.select("asset_id", "cache_key", "result", "cached")


@query("p3_stage_extras", """select event_id, (props->>'k')::int as k, (props->>'k')::int < 50 as cached, (props->>'missing')::double as missing from events""")
def _(spark, sf):
    return X.read(spark, sf, "events").select(
        "event_id", SR.typed_extra("props", "$.k", "int").alias("k"), (SR.typed_extra("props", "$.k", "int") < 50).alias("cached"),
        SR.typed_extra("props", "$.missing", "double").alias("missing"))


@query("a22_run_totals", f"with {FACTS} select run_id, count(*)::bigint as n_stages, round_even(sum(seconds), 2)::double as total_s from facts group by 1")
def _(spark, sf):
    return R.run_totals(_facts(spark, sf))


@query("a23_stage_profile", f"""with {FACTS} select coalesce(stage, 'all') as stage, coalesce(cached::varchar, 'all') as cached, grouping(stage, cached)::bigint as level, count(*)::bigint as n,
round(sum(seconds), 4) as total_s, round(avg(seconds), 6) as mean_s, max(seconds) as max_s from facts group by rollup(stage, cached)""")
def _(spark, sf):
    every = F.lit("all")
    return R.stage_profile(_facts(spark, sf).drop("gpu_peak_gb")).withColumns({
        "stage": F.coalesce("stage", every), "cached": F.coalesce(F.col("cached").cast("string"), every),
        "total_s": F.round("total_s", 4), "mean_s": r6("mean_s")})


@query("a23_stage_profile_models", f"""with {FACTS}, f as (select f.*, s.kind, coalesce(s.model, 'none') as model, s.gpu_peak_gb from facts f join fx_stages s using (event_id))
select kind, stage, model, cached::varchar as cached, grouping(kind, stage, model, cached)::bigint as level, count(*)::bigint as n, round(sum(seconds), 4) as total_s,
round(avg(seconds), 6) as mean_s, max(seconds) as max_s, max(gpu_peak_gb) as gpu_peak_gb from f group by rollup(kind, stage, model, cached)""")
def _(spark, sf):
    facts = _facts(spark, sf).fillna("none", ["model"])
    out = R.stage_profile(facts, ("kind", "stage", "model", "cached"))
    return out.withColumns({"cached": F.col("cached").cast("string"), "total_s": F.round("total_s", 4), "mean_s": r6("mean_s")})


@query("a23_cold_cached_ratio", f"""with {FACTS}, m as (select stage, avg(case when not cached then seconds end) as cold_s,
avg(case when cached then seconds end) as cached_s from facts group by 1)
select stage, round(cold_s, 6) as cold_s, round(cached_s, 6) as cached_s, round(cold_s/greatest(cached_s, 1e-9), 6) as ratio from m""")
def _(spark, sf):
    return R.cold_cached_ratio(_facts(spark, sf)).select("stage", r6("cold_s").alias("cold_s"), r6("cached_s").alias("cached_s"), r6("ratio").alias("ratio"))


@query("c8_run_report", f"""with {FACTS} select run_id, count(*)::bigint as n_stages, round(sum(seconds), 4) as total_s,
round(sum(case when cached then 0 else seconds end), 4) as cold_s, arg_max(stage, (seconds, stage)) as longest_stage from facts group by 1""")
def _(spark, sf):
    return R.run_report(_facts(spark, sf)).withColumns({"total_s": F.round("total_s", 4), "cold_s": F.round("cold_s", 4)})


ACTIVE = "(select * from fx_jobs where status in ('queued', 'running'))"


@query("w12_queue_position", f"""
with t as (select created, count(*) as n from {ACTIVE} group by 1),
a as (select created, coalesce(sum(n) over (order by created rows between unbounded preceding and 1 preceding), 0) as ahead from t)
select job_id, status, (case when status = 'queued' then coalesce(ahead, 0) else 0 end)::bigint as position from fx_jobs left join a using (created)""")
def _(spark, sf):
    return J.queue_position(X.jobs(spark, sf)).select("job_id", "status", "position")


@query("w12_queue_position_per_queue", f"""
with t as (select queue_id, created, count(*) as n from {ACTIVE} group by 1, 2),
a as (select queue_id, created, coalesce(sum(n) over (partition by queue_id order by created rows between unbounded preceding and 1 preceding), 0) as ahead from t)
select job_id, queue_id, (case when status = 'queued' then coalesce(ahead, 0) else 0 end)::bigint as position from fx_jobs left join a using (queue_id, created)""")
def _(spark, sf):
    return J.queue_position(X.jobs(spark, sf), "queue_id").select("job_id", "queue_id", "position")


@query("w13_stage_in_progress", """
with l as (select run_id, arg_max(stage, (ts, event_id)) as last_stage from fx_stages group by 1)
select run_id, last_stage, case last_stage when 'segmentation' then 'geometry' when 'geometry' then 'irradiance' when 'illumination' then 'render' end as stage from l""")
def _(spark, sf):
    return J.stage_in_progress(X.stages(spark, sf), "run_id", F.lit("floor"), ["ts", "event_id"])


NAMES = "['mask_object.png','background.png','zebra.png','apple.png','metrics.json','task_points.png','output_lowres.png']"


@query("t3_order_artifacts", f"""
with f as (select distinct source as job, case when doc_id%9 < 7 then {NAMES}[(doc_id%9)::int+1] else doc_id||'.png' end as name from documents),
r as (select job, name, coalesce(list_position(['task_points.png','mask_object.png','mask_dilated.png','region_source.png','input_lowres.png','background.png','output_lowres.png','output_sr_full.png'], name), 100000) as r
from f where name like '%.png')
select job, name, row_number() over (partition by job order by r, name) as position from r""")
def _(spark, sf):
    d = X.read(spark, sf, "documents")
    names = F.array(*[F.lit(n) for n in ("mask_object.png", "background.png", "zebra.png", "apple.png", "metrics.json", "task_points.png", "output_lowres.png")])
    i = (F.col("doc_id") % 9).cast("int")
    name = F.when(i < 7, F.try_element_at(names, i + 1)).otherwise(F.concat(F.col("doc_id"), F.lit(".png")))
    return J.order_artifacts(d.select(F.col("source").alias("job"), name.alias("name")), "job", F.lit("object"))


@query("t4_dispatch_order", """select job_id, (not interactive)::int as priority,
row_number() over (order by (not interactive)::int, created, job_id) as dispatch from fx_jobs""")
def _(spark, sf):
    return J.dispatch_order(X.jobs(spark, sf), [F.col("created"), F.col("job_id")]).select("job_id", "priority", "dispatch")


NOW = "2024-02-01 00:00:00"


@query("d1_elapsed_s", f"""
with j as (select *, case when status <> 'queued' then created + to_seconds(job_id%100) end as started from fx_jobs)
select job_id, round_even((epoch_us(coalesce(finished, timestamp '{NOW}')) - epoch_us(coalesce(started, created)))/100000.0::double, 0)/10 as elapsed_s from j""")
def _(spark, sf):
    jobs = X.jobs(spark, sf).withColumn("started", F.when(F.col("status") != "queued", F.timestamp_micros(F.unix_micros("created") + F.col("job_id") % 100 * 1000000)))
    return jobs.select("job_id", J.elapsed_s(F.lit(NOW).cast("timestamp")).alias("elapsed_s"))


JOB_STATE = """
with ends as (select job_id, arg_min(type, (ts, seq)) as etype, min(ts) as ets, min((ts, seq)) as e from fx_job_events where type in ('done','failed') group by 1),
live as (select v.*, etype, ets from fx_job_events v left join ends on v.job_id = ends.job_id where e is null or (ts, seq) <= e),
s as (select job_id, any_value(etype) as etype, any_value(ets) as finished, min(ts) as created, min(ts) filter (where type in ('started','stage')) as started,
count(*) filter (where type='stage') as stages_done, arg_max(stage, (ts, seq)) filter (where type='stage') as last from live group by 1)
select job_id, coalesce(etype, case when started is not null then 'running' else 'queued' end) as status,
case when etype is not null or started is null then null when last is null then 'segmentation'
when last='segmentation' then 'geometry' when last='geometry' then 'irradiance' when last='irradiance' then 'render' end as stage,
stages_done::bigint as stages_done, created, started, finished from s"""


@query("m1_job_state", JOB_STATE)
def _(spark, sf):
    return X.plain_times(J.job_state(X.job_events(X.read(spark, sf, "events"))))


@query("m2_fail_unfinished", f"""select job_id, case when status in ('queued','running') then 'failed' else status end as status,
case when status in ('queued','running') then 'server stopped' end as error,
case when status in ('queued','running') then timestamp '{NOW}' else finished end as finished from fx_jobs""")
def _(spark, sf):
    out = J.fail_unfinished(X.jobs(spark, sf), "server stopped", F.lit(NOW).cast("timestamp"))
    return X.plain_times(out.select("job_id", "status", "error", "finished"))


@query("p4_validate_specs", """
with e as (select spec_id, list_filter([
case when kind not in ('floor','object','image3d') then 'kind' end,
case when kind='floor' and scene_id is null then 'scene_id' end,
case when kind='floor' and pattern_id is null then 'pattern_id' end,
case when kind='floor' and material not in ('smooth-matte','smooth-glossy') then 'material' end,
case when kind='floor' and not (m_per_1000px > 0 and m_per_1000px <= 100) then 'm_per_1000px' end,
case when kind='object' and scene_id is null then 'scene_id' end,
case when kind='object' and n_moves < 1 then 'moves' end,
case when kind='object' and removal <> 'background' then 'removal' end,
case when kind='object' and insertion <> 'paste' then 'insertion' end,
case when kind='object' and src_region not in ('mask','dilated','box','full') then 'src_region' end,
case when kind='object' and dst_region not in ('mask','dilated','box','full') then 'dst_region' end,
case when kind='object' and not region_margin between 0 and 2 then 'region_margin' end,
case when kind='object' and sr_factor not in (1,2,3,4) then 'sr_factor' end,
case when kind='object' and omnipaint_mode not in ('window','full') then 'omnipaint_mode' end,
case when kind='object' and not omnipaint_res between 256 and 1536 then 'omnipaint_res' end,
case when kind='object' and not omnipaint_steps between 1 and 50 then 'omnipaint_steps' end,
case when kind='image3d' and scene_id is null then 'scene_id' end,
case when kind='image3d' and mask_id is null then 'mask_id' end,
case when kind='image3d' and not ss_steps between 1 and 50 then 'ss_steps' end,
case when kind='image3d' and not slat_steps between 1 and 50 then 'slat_steps' end], lambda x: x is not null) as errors from fx_specs)
select spec_id, array_to_string(errors, ',') as errors, len(errors) = 0 as valid from e""")
def _(spark, sf):
    return Q.validate_specs(X.specs(spark, sf)).select("spec_id", F.array_join("errors", ",").alias("errors"), "valid")


@query("p5_resolve_material", """
with r as (select spec_id, material, case when sr_factor = 0 then 0.9 + steps/600.0::double end as albedo, case when sr_factor = 1 then 1.2::double + steps/100.0::double end as ior from fx_specs),
m as (select spec_id, r.material, coalesce(r.albedo, p.albedo) as albedo, p.roughness, coalesce(r.ior, p.ior) as ior, p.coat from r left join fx_presets p on r.material = p.name),
f as (select *, ((ior-1)/(ior+1))**2 as f0 from m), g as (select *, greatest(1-roughness, f0) as g from f)
select spec_id, material, round(albedo, 6) as albedo, roughness, round(ior, 6) as ior, coat, round(f0, 6) as f0,
round((1-g)*albedo+g, 6) as energy_max, coalesce((1-g)*albedo+g > 1, false) as gains_energy from g""")
def _(spark, sf):
    req = X.specs(spark, sf).select(
        "spec_id", "material", F.when(F.col("sr_factor") == 0, 0.9 + F.col("steps") / 600.0).alias("albedo"),
        F.when(F.col("sr_factor") == 1, 1.2 + F.col("steps") / 100.0).alias("ior"))
    out = Q.resolve_material(req, X.presets(spark))
    return out.select("spec_id", "material", r6("albedo").alias("albedo"), "roughness", r6("ior").alias("ior"), "coat", r6("f0").alias("f0"),
                      r6("energy_max").alias("energy_max"), F.coalesce("gains_energy", F.lit(False)).alias("gains_energy"))


@query("p6_tile_extent", """
select p_partkey, round(coalesce(t, w/1000.0*5.0), 6) as su, round(coalesce(t, w/1000.0*5.0)*(h/w), 6) as sv
from (select p_partkey, case when p_partkey%3=0 then p_size/10.0::double end as t, (p_size*40)::double as w, p_retailprice as h from part)""")
def _(spark, sf):
    p = X.read(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") / 10.0).alias("t"),
                                         (F.col("p_size") * 40).cast("double").alias("w"), F.col("p_retailprice").alias("h"))
    su, sv = Q.tile_extent("t", "w", "h")
    return p.select("p_partkey", r6(su).alias("su"), r6(sv).alias("sv"))


CLAMP = """c as (select box_id, image_id, w, h, least(greatest(0, least(x0, w-1)), greatest(0, least(x1, w)))::int as x0,
greatest(greatest(0, least(x0, w-1)), greatest(0, least(x1, w)))::int as x1,
least(greatest(0, least(y0, h-1)), greatest(0, least(y1, h)))::int as y0,
greatest(greatest(0, least(y0, h-1)), greatest(0, least(y1, h)))::int as y1 from fx_boxes)"""


@query("p13_clamp_box", f"""with {CLAMP} select box_id, x0, y0, x1, y1, x1-x0 < 2 or y1-y0 < 2 as degenerate,
round_even((x0+x1)/2.0::double, 0)::int as cx, round_even((y0+y1)/2.0::double, 0)::int as cy from c""")
def _(spark, sf):
    c = Q.clamp_boxes(X.boxes(spark, sf))
    cx, cy = B.box_centre("x0", "y0", "x1", "y1")
    return c.select("box_id", "x0", "y0", "x1", "y1", "degenerate", cx.alias("cx"), cy.alias("cy"))


@query("p14_square_window", f"""
with {CLAMP}, s as (select *, greatest(8, ceil(3.0::double*sqrt((x1-x0)**2+(y1-y0)**2)*greatest(1.0, 0.5::double+box_id%3)))::int as want,
(x0+x1)/2.0::double as cx, (y0+y1)/2.0::double as cy, greatest(16.0::double, 3.0*greatest(x1-x0, y1-y0))::int as target from c),
q as (select *, least(want, w, h)::int as side from s)
select box_id, want, target, side, greatest(0, least(round_even(cx-side/2.0::double, 0), w-side))::int as wx,
greatest(0, least(round_even(cy-side/2.0::double, 0), h-side))::int as wy from q""")
def _(spark, sf):
    c = Q.clamp_boxes(X.boxes(spark, sf)).withColumn("scale", 0.5 + F.col("box_id") % 3)
    c = c.withColumn("want", B.window_side("x0", "y0", "x1", "y1", "scale", 3.0, 8)) \
        .withColumn("target", B.target_side("x0", "y0", "x1", "y1", 3.0, 16))
    win = B.square_window((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, "want", "w", "h")
    return c.select("box_id", "want", "target", *[v.alias(k) for k, v in win.items()])


@query("j1_resolve_refs", """
select m.scene_id, m.mask_id, m.src_x, m.src_y, m.dst_x, m.dst_y, m.l_suppkey,
case when s.scene_id is null then 'unknown scene' when k.mask_id is null then 'unknown mask'
when k.mask_w <> s.width or k.mask_h <> s.height then 'mask size differs' when k.n_px = 0 then 'mask is empty' end as error
from fx_moves m left join fx_scenes_present s on m.scene_id = s.scene_id left join fx_masks_present k on m.mask_id = k.mask_id""")
def _(spark, sf):
    out = Q.resolve_refs(X.moves(spark, sf), X.masks_present(spark, sf), X.scenes_present(spark, sf))
    return out.select("scene_id", "mask_id", "src_x", "src_y", "dst_x", "dst_y", "l_suppkey", "error")


@query("j12_missing_assets", """
select doc_id, marker from (select doc_id, substr(sha1(text),1,16) as marker, [lang, source] as tags from documents)
where list_has_any(tags, ['en', 'src3']) and marker not in (select substr(sha1(text),1,16) from documents join labels using (doc_id))""")
def _(spark, sf):
    d = X.read(spark, sf, "documents").select("doc_id", SK.content_key(F.col("text")).alias("marker"), F.array("lang", "source").alias("tags"))
    present = d.join(X.read(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("marker")
    return SA.missing_assets(d, present, ["en", "src3"]).select("doc_id", "marker")
