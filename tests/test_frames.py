"""Compositing, pasting, backends and merges on small frames."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scenelake import registry
from scenelake.operators import fill
from scenelake.operators import frames as FR
from scenelake.operators import neighbourhood as N
from scenelake.plans import composites as C

H, W = 20, 30


@pytest.fixture(scope="module")
def scene(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 256, (H, W, 3))
    y, x = np.mgrid[0:H, 0:W]
    px = pd.DataFrame({"image_id": 0, "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), **{c: a[..., i].ravel().astype("int32") for i, c in enumerate("rgb")}})
    m = np.zeros((H, W), bool)
    m[5:9, 4:10] = True
    my, mx = np.nonzero(m)
    mask = pd.DataFrame({"image_id": 0, "mask_id": 0, "y": my.astype("int32"), "x": mx.astype("int32")})
    images = spark.createDataFrame([(0, W, H)], "image_id bigint, width int, height int")
    return a, m, spark.createDataFrame(px), spark.createDataFrame(mask), images


def move(spark, scale, dst=(20, 12), idx=0):
    return spark.createDataFrame([(0, idx, 0, 6, 7, dst[0], dst[1], float(scale))],
                                 "image_id bigint, move_idx int, mask_id bigint, src_x int, src_y int, dst_x int, dst_y int, scale double")


def array(df):
    p = df.toPandas()
    out = np.full((H, W, 3), -1)
    out[p["y"], p["x"]] = p[["r", "g", "b"]]
    return out


@pytest.mark.parametrize("scale,dst", [(1.0, (20, 12)), (2.0, (20, 12)), (0.5, (3, 3)), (1.5, (29, 19))])
def test_paste_maps_back(spark, scene, scale, dst):
    a, m, px, mask, images = scene
    got = array(FR.affine_paste(px, mask, move(spark, scale, dst), images))
    want = np.full_like(got, -1)
    for y in range(H):
        for x in range(W):
            sy, sx = int(np.rint((y - dst[1]) / scale + 7)), int(np.rint((x - dst[0]) / scale + 6))
            if 0 <= sy < H and 0 <= sx < W and m[sy, sx]:
                want[y, x] = a[sy, sx]
    assert (got == want).all()


def test_fill_leaves_the_rest_alone_and_reaches_deep_holes(spark, scene):
    a, m, px, mask, images = scene
    wide = px.where("x < 28").select("image_id", "y", "x")
    out = array(fill.fill_from_background(px, wide, 1.0, W, H))
    assert (out[:, 28:] == a[:, 28:]).all() and (out >= 0).all()
    flat = px.select("image_id", "y", "x", *[F.lit(77).alias(c) for c in "rgb"])
    assert (array(fill.fill_from_background(flat, mask, 2.0, W, H)) == 77).all()


def test_audit_finds_changes_and_missing_pixels(spark, scene):
    _, _, px, mask, _ = scene
    after = px.withColumn("r", F.when((F.col("y") == 5) & F.col("x").isin(4, 20), F.col("r") + 1).otherwise(F.col("r"))).where("not (y = 0 and x = 0)")
    bad = FR.containment_audit(px, after, mask).orderBy("y", "x").collect()
    assert [(r.y, r.x) for r in bad] == [(0, 0), (5, 20)]


def test_move_objects_changes_only_what_it_may(spark, scene):
    a, m, px, mask, images = scene
    cfg = registry.config(dilate_radius=1, src_region="full", feather_px=0)        # 'full' falls back to the box for this filler
    moves = move(spark, 1.0)
    for idx, image, name in ((1, 0, 9), (2, 5, 0), (3, 0, None)):              # an unknown mask, an unknown image, no mask
        moves = moves.union(move(spark, 1.0, idx=idx).withColumns({"image_id": F.lit(image).cast("bigint"), "mask_id": F.lit(name).cast("bigint")}))
    out, audit, rejected = C.move_objects(px, mask, moves, images, cfg, W, H)
    assert audit.count() == 0
    assert sorted((r.move_idx, r.error) for r in rejected.collect()) == [(1, "unknown or empty mask"), (2, "unknown image"), (3, "unknown or empty mask")]
    got = array(out)
    assert (got[10:14, 18:24] == a[5:9, 4:10]).all() and (got[:3] == a[:3]).all()


def test_feathered_paste_is_contained_and_blends(spark, scene):
    a, _, px, mask, images = scene
    cfg = {**registry.config(), "feather_px": 1.0, "grow_px": 1, "width": W, "height": H}
    out, layer = registry.make("insertion", "paste", cfg)(px, px, mask, move(spark, 1.0), images)
    got = array(out)
    assert (got[11:13, 20:22] == a[6:8, 6:8]).all() or np.abs(got[11:13, 20:22] - a[6:8, 6:8]).max() < 40
    assert (got[0:5] == a[0:5]).all() and FR.containment_audit(px, out, layer).count() == 0


def test_feather_by_default_equals_a_blur_of_the_whole_frame(spark, scene):
    a, m, px, mask, images = scene
    cfg = {**registry.config(grow_px=2, feather_px=0.8), "width": W, "height": H}
    assert registry.config()["grow_px"] == 15 and registry.config()["feather_px"] == 4
    dark = px.withColumns({c: (F.col(c) / 3).cast("int") for c in "rgb"})
    got = array(registry.make("insertion", "paste", cfg)(px, dark, mask, move(spark, 1.0), images)[0])
    hit = np.zeros((H, W), bool)
    hit[10:14, 18:24] = True
    wide = np.zeros((H, W), bool)
    wide[8:16, 16:26] = True
    k = np.array(N.gaussian_kernel(0.8))
    pad = np.pad(wide.astype(float), len(k) // 2, mode="reflect")
    blur = np.apply_along_axis(np.convolve, 1, np.apply_along_axis(np.convolve, 0, pad, k, "valid"), k, "valid")
    low = (a // 3)
    layer = np.where(hit[..., None], np.roll(a, (5, 14), (0, 1)), low)
    want = layer * blur[..., None] + low * (1 - blur[..., None])
    assert np.abs(got - want).max() <= 1


def test_merge_without_edit_is_the_original(spark, scene):
    a, _, px, _, _ = scene
    low = px.groupBy("image_id", F.floor(F.col("y") / 3).cast("int").alias("y"), F.floor(F.col("x") / 3).cast("int").alias("x")).agg(*[F.avg(c).cast("int").alias(c) for c in "rgb"]).where("y < 6")
    assert (array(C.multires_merge(px, low, low, 3, W, H)) == a).all()


def test_many_layers_fold_in_rounds(spark, scene):
    _, _, px, _, _ = scene
    layers = px.where("x < 5").select("image_id", "y", "x", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("move_idx")).select(
        "*", F.lit(0.6).alias("alpha"), *[((F.col("move_idx") + 1) * k % 256).alias(c) for c, k in zip("rgb", (37, 59, 83))])
    assert (array(FR.layer_fold(px, layers)) == array(FR.layer_fold(px, layers, at_once=2))).all()


def test_rounds_follow_the_stack_not_the_order_column(spark, scene, monkeypatch):
    _, _, px, _, _ = scene
    far = F.explode(F.array(F.lit(1), F.lit(10**9)))
    layers = px.where("x < 5").select("image_id", "y", "x", far.alias("move_idx")).select("*", F.lit(0.6).alias("alpha"), *[(F.col("move_idx") % 251).cast("int").alias(c) for c in "rgb"])
    rounds, fold = [], FR._fold
    monkeypatch.setattr(FR, "_fold", lambda *a: rounds.append(1) or fold(*a))
    got = array(FR.layer_fold(px, layers))
    assert len(rounds) == 1 and (got == array(fold(px, layers, "move_idx"))).all()


def test_backends(spark):
    with pytest.raises(ValueError, match="only background"):
        registry.make("removal", "nothing", {})
    with pytest.raises(KeyError, match="sr_faktor"):
        registry.config(sr_faktor=2)
    registry.register("removal", "leak", lambda cfg: lambda px, hole, region, images: px.withColumn("r", F.lit(0)))
    try:
        px = spark.createDataFrame([(0, 0, 0, 9, 9, 9), (0, 0, 1, 9, 9, 9)], "image_id bigint, y int, x int, r int, g int, b int")
        bad = FR.containment_audit(px, registry.make("removal", "leak", {})(px, px.where("x = 0"), px.where("x = 0"), None), px.where("x = 0"))
        assert [(r.y, r.x) for r in bad.collect()] == [(0, 1)]
    finally:
        registry._BACKENDS["removal"].pop("leak")


def test_paste_computes_its_layer_once(spark):
    """The layer is read by the fold, twice, and by the audit: what they read is a written table, not the steps that made it."""
    from scenelake import registry
    px = spark.range(400).selectExpr("0L as image_id", "cast(id div 20 as int) as y", "cast(id % 20 as int) as x", "1 as r", "2 as g", "3 as b")
    masks = px.where("y < 4 and x < 4").selectExpr("image_id", "0 as mask_id", "y", "x")
    moves = spark.sql("select 0L as image_id, 0 as move_idx, 0 as mask_id, 1 as src_x, 1 as src_y, 9 as dst_x, 9 as dst_y, 1.0D as scale")
    images = spark.sql("select 0L as image_id, 20 as width, 20 as height")
    for feather in (0, 2):
        insert = registry.make("insertion", "paste", {**registry.config(feather_px=feather), "width": 20, "height": 20})
        for out in insert(px, px, masks, moves, images):
            assert out.count() and "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
