"""Run documents, move files, listings, sinks and the cache on small files."""

import json

import pytest
from pyspark.sql import functions as F

from scenelake.operators import jobs as J
from scenelake.operators import requests as Q
from scenelake.operators import runs as R
from scenelake.sources import assets as SA
from scenelake.sources import moves as SM
from scenelake.sources import runs as SR
from scenelake.sources import sinks as SK


def write(path, doc):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(doc, indent=2))


def test_run_documents_old_and_new(spark, tmp_path):
    write(tmp_path / "floor/hall/oak/ensemble/metrics.json",
          {"scene": "input\\hall.jpg", "total_gen_s": 3.5, "roi_box": [1, 2], "stages": [
              {"stage": "segmentation", "model": "a", "gen_s": 2.0, "gpu_peak_gb": 1.5, "load_s": 9.0},
              {"stage": "illumination", "gen_s": 1.5, "plane_residual_cm": 0.28}]})
    write(tmp_path / "floor/hall/oak/ensemble/smooth-matte/metrics.json",
          {"scene": "hall.jpg", "tta": 3, "material": "smooth-matte", "stages": [
              {"stage": "irradiance", "time_s": 0.5, "cached": True, "vote_iou": [0.9, 0.8]}, {"stage": "load"}]})
    write(tmp_path / "object/kitchen/metrics.json", {"stages": []})
    runs = SR.read_runs(spark, str(tmp_path))
    got = {(r.kind, r.scene_name, r.pattern_name, r.segmenter, r.material_name) for r in runs.collect()}
    assert got == {("floor", "hall", "oak", "ensemble", None), ("floor", "hall", "oak", "ensemble", "smooth-matte"), ("object", "kitchen", None, None, None)}
    s = {(r.material_name, r.stage): r for r in SR.stage_rows(runs, ["run_path", "material_name"]).collect()}
    assert s[(None, "irradiance")].time_s == 1.5 and s[(None, "irradiance")].extras == {"plane_residual_cm": "0.28"}
    assert s[("smooth-matte", "irradiance")].cached and json.loads(s[("smooth-matte", "irradiance")].extras["vote_iou"]) == [0.9, 0.8]
    assert s[("smooth-matte", "load")].time_s == 0 and s[(None, "segmentation")].load_s == 9.0
    assert runs.select(SR.basename(F.col("scene")).alias("b"), SR.stem(F.col("scene")).alias("s")).where("b is not null").distinct().collect() == [("hall.jpg", "hall")]
    facts = SR.stage_rows(runs, ["run_path"]).withColumn("seconds", F.col("time_s"))
    assert {r.total_s for r in R.run_totals(facts, "run_path").collect()} == {3.5, 0.5}


def test_move_documents(spark, tmp_path):
    write(tmp_path / "a.json", {"scene": "a.jpg", "initial": {"x": 1, "y": 2}, "final": {"x": 3, "y": 4}})
    write(tmp_path / "b.json", {"scene": "b.jpg", "moves": [
        {"initial": {"x": 1, "y": 2}, "dst_box": [0, 0, 5, 7], "mask": "m.png"},
        {"src_box": [10, 10, 13, 20], "final": {"x": 9, "y": 9}}]})
    rows = SM.read_moves(spark, str(tmp_path)).orderBy("scene", "move_idx").collect()
    assert [(r.src_x, r.src_y, r.dst_x, r.dst_y, r.mask_id) for r in rows] == [
        (1, 2, 3, 4, None), (1, 2, 2, 4, "m.png"), (12, 15, 9, 9, None)]      # 2.5 -> 2, 3.5 -> 4, 11.5 -> 12


def test_asset_inventory_from_files(spark, tmp_path):
    (tmp_path / "scene").mkdir()
    for name, size in (("aa.JPG", 10), ("aa_clean.png", 5), ("bb.png", 30), ("cc.png", 2_000_000)):
        (tmp_path / "scene" / name).write_bytes(b"x" * size)
    inv = {r.asset_id: r for r in SA.asset_inventory(SA.list_files(spark, str(tmp_path)), max_mb=1).collect()}
    assert inv["aa"].path.endswith("aa_clean.png") and inv["aa"].precleaned and inv["aa"].size == 10 and inv["aa"].ext == "jpg"
    assert inv["bb"].path.endswith("bb.png") and not inv["bb"].too_large and inv["cc"].too_large and inv["cc"].kind == "scene"


def test_result_sink_rewrites_only_its_partitions(spark, tmp_path):
    root = str(tmp_path / "out")
    cols = ["scene", "pattern", "seg", "material", "v"]
    SK.write_result(spark.createDataFrame([("s1", "p", "e", "m", 1), ("s2", "p", "e", "m", 2)], cols), root)
    SK.write_result(spark.createDataFrame([("s2", "p", "e", "m", 3), ("s3", "p", "e", "m", 4)], cols), root)
    assert sorted((r.scene, r.v) for r in spark.read.parquet(root).collect()) == [("s1", 1), ("s2", 3), ("s3", 4)]


def test_cache_computes_each_missing_key_once(spark):
    df = spark.createDataFrame([(i, "hot" if i < 8 else f"k{i}") for i in range(12)], "id int, text string")
    key = SK.cache_key("seg", SK.content_key(F.col("text")), 3)
    cache = df.where("id = 9").select(key.alias("cache_key"), F.lit(-1).alias("n"))
    asked = []

    def compute(miss):
        asked.extend(r.id for r in miss.collect())
        return miss.select("cache_key", F.length("text").alias("n"))
    rows, fresh = SK.incremental(df, cache, key, compute)
    got = {r.id: (r.n, r.cached) for r in rows.collect()}
    assert len(got) == 12 and got[9] == (-1, True) and got[3] == (3, False) and len(asked) == 4 and fresh.count() == 4


def test_request_checks(spark):
    cols = ("kind", "scene_id", "pattern_id", "mask_id", "material", "m_per_1000px", "n_moves", "removal", "src_region", "omnipaint_mode", "region_margin", "sr_factor",
            "omnipaint_res", "omnipaint_steps", "ss_steps")
    given = [dict(kind="floor", scene_id="s", pattern_id="p", material="smooth-matte", m_per_1000px=5.0), dict(kind="floor", material="satin", m_per_1000px=0.0),
             dict(kind="object", n_moves=0, removal="none", src_region="halo", omnipaint_mode="tile", region_margin=2.5, sr_factor=5, omnipaint_res=2000, omnipaint_steps=51),
             dict(kind="object", scene_id="s", n_moves=1, removal="background", src_region="full", region_margin=2.0, sr_factor=4, omnipaint_res=256, omnipaint_steps=1),
             dict(kind="image3d", ss_steps=0), dict()]
    df = spark.createDataFrame([(i, *[g.get(c) for c in cols]) for i, g in enumerate(given)],
                               "id int, kind string, scene_id string, pattern_id string, mask_id string, material string, m_per_1000px double, n_moves int, removal string, "
                               "src_region string, omnipaint_mode string, region_margin double, sr_factor int, omnipaint_res int, omnipaint_steps int, ss_steps int")
    got = {r.id: r.errors for r in Q.validate_specs(df).collect()}
    assert got == {0: [], 1: ["scene_id", "pattern_id", "material", "m_per_1000px"],
                   2: ["scene_id", "moves", "removal", "src_region", "region_margin", "sr_factor", "omnipaint_mode", "omnipaint_res", "omnipaint_steps"],
                   3: [], 4: ["scene_id", "mask_id", "ss_steps"], 5: ["kind"]}
    assert [r.errors for r in Q.validate_specs(df.where("id = 2"), removals=["none"]).collect()][0].count("removal") == 0


def test_material_without_parameters(spark):
    presets = spark.createDataFrame([("legacy", None, None, None, None, None, None), ("matte", 0.35, 0.75, 1.5, 0.0, 0.03, 0.8)],
                                    "name string, albedo double, roughness double, ior double, coat double, coat_roughness double, delight double")
    req = spark.createDataFrame([(0, "matte", 0.9), (1, "legacy", None)], "id int, material string, albedo double")
    got = {r.id: r for r in Q.resolve_material(req, presets).collect()}
    assert got[0].albedo == 0.9 and got[0].f0 == pytest.approx(0.04) and not got[0].gains_energy and got[1].f0 is None


def test_queue_ties_share_a_position(spark):
    rows = [(1, "running", 1), (2, "queued", 2), (3, "queued", 2), (4, "queued", 3), (5, "done", 0)]
    df = spark.createDataFrame(rows, "job_id int, status string, t int").withColumn("created", F.timestamp_seconds("t"))
    assert {r.job_id: r.position for r in J.queue_position(df).collect()} == {1: 0, 2: 1, 3: 1, 4: 3, 5: 0}
