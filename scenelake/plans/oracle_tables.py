"""The derived tables in SQL, and a helper that puts the ones a query needs in front of it."""

import re

TABLES = {
    "fx_raster": """select vec_id//50 as image_id, (vec_id%50)::int as y, i::int as x, embedding[i+1]::double as v
        from embeddings, unnest(range(64)) t(i)""",
    "fx_images": "select distinct vec_id//50 as image_id, 64::int as width, 50::int as height from embeddings",
    "fx_rgb_images": "select distinct vec_id//50 as image_id, 22::int as width, 50::int as height from embeddings",
    "fx_mask": """select image_id, 0::int as mask_id, y, x from fx_raster where v > 0.05
        union all select image_id, 1::int, y, x from fx_raster where v > 0.1""",
    "fx_votes": """select image_id, p::int as pass_id, p=2 as mirrored, y, (case when p=2 then 63-x else x end)::int as x,
        v > 0.04::double+0.01::double*p as v from fx_raster, unnest(range(3)) t(p)""",
    "fx_rgb": """select image_id, y, x, r, coalesce(g, r) as g, coalesce(b, r) as b from (
        select image_id, y, (x//3)::int as x,
        max(case when x%3=0 then least(greatest(v*2+0.5,0),1) end) as r,
        max(case when x%3=1 then least(greatest(v*2+0.5,0),1) end) as g,
        max(case when x%3=2 then least(greatest(v*2+0.5,0),1) end) as b from fx_raster group by 1,2,3)""",
    "fx_frames": """select image_id, y, x, floor(r*255)::int as r0, floor(g*255)::int as g0, floor(b*255)::int as b0,
        least(floor(r*255)::int + case when x between 5 and 12 and y between 10 and 25 then x%6 else 0 end, 255)::int as r1,
        floor(g*255)::int as g1, floor(b*255)::int as b1 from fx_rgb""",
    "fx_tex": """select (p_partkey//32)::int as ty, (p_partkey%32)::int as tx, p_size/50.0::double as r,
        (p_retailprice%100)/100 as g, (p_partkey%17)/17.0::double as b from part""",
    "fx_scores": """select image_id, 'a' as model, y, (x//8)::int as x, (x%8)::int as class_id, v as logit from fx_raster
        union all select image_id, 'b', y, ((63-x)//8)::int, ((63-x)%8)::int, v from fx_raster""",
    "fx_prop": """select l_orderkey as prompt_id, row_number() over (partition by l_orderkey order by l_linenumber,
        l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 as k,
        round(1.0::double-6.0::double*l_discount,2) as iou, (l_quantity*100)::bigint as area, 10000::int as frame_px from lineitem""",
    "fx_points": """select l_returnflag as scene_id, l_quantity as px, l_extendedprice/1000 as py, l_discount*100+1 as pz,
        l_tax<0.07 as valid, l_orderkey||'-'||l_linenumber||'-'||l_partkey||'-'||l_suppkey as point_id from lineitem""",
    "fx_depth": "select image_id, y, x, 3+v as z, v<0.2 as valid from fx_raster",
    "fx_anchors": """select s_suppkey as move_id, s_suppkey%(select count(distinct vec_id//50) from embeddings) as image_id, (s_nationkey*2)::int as src_x,
        (s_suppkey%50)::int as src_y, (63-s_nationkey)::int as dst_x, ((s_suppkey*7)%50)::int as dst_y from supplier""",
    "fx_vertices": """select p_partkey//50 as mesh_id, p_partkey%50 as vid, p_size::double as x, p_retailprice/100 as y,
        (p_partkey%37)::double as z from part""",
    "fx_faces": """select mesh_id, vid as fid, vid as v0, (vid+1)%50 as v1, (vid+7)%50 as v2 from fx_vertices""",
    "fx_vox": """select l_suppkey%20 as batch, floor(l_quantity/7)::int as x, round(l_discount*100)::int as y,
        round(l_tax*100)::int as z, sum(l_extendedprice)/1000 as feat from lineitem group by 1,2,3,4""",
    "fx_splats": """select l_suppkey as asset_id, l_quantity as x, l_extendedprice/1000 as y, l_tax*100 as z,
        (l_discount-0.05)*100 as opacity, [(l_tax-0.04)*20, l_discount*10, (l_quantity-25)/20] as f_dc from lineitem""",
    "fx_stages": """select event_id, user_id || '-' || strftime(ts,'%Y%m%d') as run_id, ts,
        case event_type when 'view' then 'segmentation' when 'click' then 'geometry' when 'signup' then 'illumination'
        when 'purchase' then 'render' else 'load' end as stage,
        case when user_id%2=0 then value end as gen_s, case when user_id%2=1 then value end as time_s,
        (props->>'k')::int as k, (props->>'k')::int < 50 as cached, props, ['floor','object','image3d'][user_id%3+1] as kind,
        case when (props->>'k')::int%5 > 0 then 'm'||(props->>'k')::int%5 end as model,
        case when (props->>'k')::int%2 = 0 then (props->>'k')::int/4.0::double end as gpu_peak_gb from events""",
    "fx_jobs": """select event_id as job_id, user_id as queue_id, ts as created, event_id%4=0 as interactive,
        case event_type when 'view' then 'running' when 'click' then 'queued' when 'signup' then 'queued'
        when 'purchase' then 'done' else 'failed' end as status,
        case when event_type in ('purchase','error') then ts + to_microseconds(trunc(value*1000000)::bigint) end as finished
        from events""",
    "fx_job_events": """select user_id as job_id, event_id as seq, ts, type,
        case when type='stage' then ['segmentation','geometry','irradiance','render'][k%4+1] end as stage,
        'floor' as kind, case when type='stage' then value end as time_s from (
        select *, (props->>'k')::int as k, case when event_type='signup' then 'created' when event_type='click' then 'started'
        when event_type='view' then 'stage' when event_type='purchase' and (props->>'k')::int>=90 then 'done'
        when event_type='error' and (props->>'k')::int>=95 then 'failed' else 'stage' end as type from events)""",
    "fx_moves": """select l_orderkey as scene_id, l_partkey + l_linenumber*40 as mask_id, (l_quantity*12)::int as src_x,
        (l_linenumber*50)::int as src_y, (600-l_quantity*10)::int as dst_x, (l_linenumber*40)::int as dst_y, l_suppkey
        from lineitem""",
    "fx_masks_present": """select p_partkey as mask_id, greatest(p_size-3,0)::int as n_px,
        (case when p_size=50 then 320 else 640 end)::int as mask_w, 480::int as mask_h from part""",
    "fx_scenes_present": "select o_orderkey as scene_id, 640::int as width, 480::int as height from orders",
    "fx_boxes": """select c_custkey as box_id, c_custkey%(select count(distinct vec_id//50) from embeddings) as image_id, ((c_custkey%70)-3)::int as x0, ((c_nationkey*2)-4)::int as y0,
        ((c_custkey%70)-3+(c_custkey%13))::int as x1, (c_nationkey*2+(c_custkey%11))::int as y1, 64::int as w, 50::int as h
        from customer""",
    "fx_specs": """select c_custkey as spec_id, case c_custkey%4 when 0 then 'floor' when 1 then 'object' when 2 then 'image3d'
        else 'bogus' end as kind, c_acctbal/100 as m_per_1000px, c_acctbal/4000 as region_margin,
        (c_custkey%6)::int as sr_factor, (c_custkey%60)::int as steps,
        case c_custkey%5 when 0 then 'smooth-matte' when 1 then 'smooth-glossy' else 'satin' end as material,
        (c_custkey%3)::int as n_moves, (c_custkey%2000)::int as omnipaint_res,
        case c_custkey%3 when 0 then 'full' when 1 then 'box' else 'halo' end as src_region,
        case when c_custkey%7 > 0 then 's'||c_custkey%7 end as scene_id, case when c_custkey%8 > 0 then 'p'||c_custkey%9 end as pattern_id,
        case when c_custkey%10 <> 2 then 'm'||c_custkey end as mask_id, case when c_custkey%11 < 8 then 'background' when c_custkey%11 < 9 then 'lasso' end as removal,
        case when c_custkey%13 < 10 then 'paste' else 'glue' end as insertion, case when c_custkey%4 < 3 then 'mask' else 'halo' end as dst_region,
        case when c_custkey%9 < 4 then 'window' when c_custkey%9 < 7 then 'full' else 'tile' end as omnipaint_mode, (c_custkey*7%60)::int as omnipaint_steps,
        case when c_custkey%3 > 0 then (c_custkey*11%60)::int end as ss_steps, (c_custkey*13%60)::int as slat_steps from customer""",
    "fx_assets": """select doc_id as asset_id, source as kind, substr(sha1(text),1,16) as content_key, n_chars as size,
        doc_id%3=0 as is_clean from documents""",
    "fx_listing": """select root||suffix as path, size*4096 as length from (
        select 'file:/data/uploads/'||kind||'/'||lpad(asset_id::varchar,12,'0') as root, size,
        unnest(case when is_clean then ['.jpg','_clean.png'] else ['.jpg'] end) as suffix from fx_assets)""",
    "fx_presets": """select * from (values ('smooth-matte',0.35::double,0.75::double,1.5::double,0.0::double,0.03::double,0.8::double),
        ('smooth-glossy',0.35,0.08,1.5,0.0,0.03,0.8)) t(name,albedo,roughness,ior,coat,coat_roughness,delight)""",
    "fx_point_map": """select image_id, y, x, (x-32.0::double)/20*z as px, (y-25.0::double)/20*z as py, z as pz, valid from fx_depth""",
    "fx_planes": """select image_id, 0.0::double as c_x, (1+image_id%3)::double as c_y, 4.0::double as c_z, 0.0::double as n_x,
        (case when image_id%2=0 then -0.8 else -0.6 end)::double as n_y, (case when image_id%2=0 then -0.6 else -0.8 end)::double as n_z,
        1.0::double as u_x, 0.0::double as u_y, 0.0::double as u_z, 0.0::double as v_x,
        (case when image_id%2=0 then -0.6 else -0.8 end)::double as v_y, (case when image_id%2=0 then 0.8 else 0.6 end)::double as v_z
        from fx_images""",
    "fx_wide_faces": """select f.mesh_id, f.fid, f.v0, f.v1, f.v2, a.x as x0, a.y as y0, a.z as z0, b.x as x1, b.y as y1, b.z as z1,
        c.x as x2, c.y as y2, c.z as z2 from fx_faces f join fx_vertices a on f.mesh_id=a.mesh_id and f.v0=a.vid
        join fx_vertices b on f.mesh_id=b.mesh_id and f.v1=b.vid join fx_vertices c on f.mesh_id=c.mesh_id and f.v2=c.vid""",
    "fx_vote_counts": """select image_id, y, (case when mirrored then 63-x else x end)::int as x, count(*) as n_pass,
        count(*) filter (where v) as n_on from fx_votes group by all""",
}


def _needed(text: str, seen: list[str]) -> list[str]:
    for name in TABLES:
        if re.search(rf"\b{name}\b", text) and name not in seen:
            _needed(TABLES[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def with_tables(sql: str, recursive: bool = False) -> str:
    """`sql` may start with its own `with`; the derived tables it mentions are put in front."""
    names = _needed(sql, [])
    ctes = ",\n".join(f"{n} as ({TABLES[n]})" for n in names)
    body = sql.strip()
    head = "with recursive " if recursive else "with "
    if body.lower().startswith("with "):
        rest = body[5:].strip()
        return f"{head}{ctes + ', ' if ctes else ''}{rest}"
    return f"{head}{ctes} {body}" if ctes else body
