"""Neighbourhood and component operators against brute force on small frames."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scenelake.operators import components as CC
from scenelake.operators import neighbourhood as N
from scenelake.operators import raster as R
from scenelake.operators import regions as RG
from scenelake.operators import run_graph as RN

H, W = 23, 31


def frame(a, image=0, name="v"):
    y, x = np.mgrid[0:a.shape[0], 0:a.shape[1]]
    return pd.DataFrame({"image_id": image, "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), name: a.ravel()})


def sparse(m, image=0, mask=0):
    y, x = np.nonzero(m)
    return pd.DataFrame({"image_id": image, "mask_id": mask, "y": y.astype("int32"), "x": x.astype("int32")})


def dense(df, value="v"):
    p = df.toPandas()
    out = np.full((H, W), np.nan)
    out[p["y"], p["x"]] = p[value]
    return out


def on(df):
    p = df.toPandas()
    assert not p.duplicated().any()
    out = np.zeros((H, W), bool)
    out[p["y"], p["x"]] = True
    return out


def flood(m, conn):
    """Labels by flood fill, numbered by first pixel."""
    lab = np.zeros(m.shape, int)
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if conn == 8 else [])
    n = 0
    for s in zip(*np.nonzero(m)):
        if lab[s]:
            continue
        n += 1
        todo, lab[s] = [s], n
        while todo:
            y, x = todo.pop()
            for dy, dx in steps:
                q = (y + dy, x + dx)
                if 0 <= q[0] < m.shape[0] and 0 <= q[1] < m.shape[1] and m[q] and not lab[q]:
                    lab[q] = n
                    todo.append(q)
    return lab


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(3)


def brute_dilate(m, element):
    out = np.zeros_like(m)
    for dy, a, b in element:
        for dx in range(a, b + 1):
            ys, xs = np.nonzero(m)
            ok = (ys + dy >= 0) & (ys + dy < H) & (xs + dx >= 0) & (xs + dx < W)
            out[ys[ok] + dy, xs[ok] + dx] = True
    return out


def brute_erode(m, element):
    padded = np.ones((3 * H, 3 * W), bool)
    padded[H:2 * H, W:2 * W] = m
    out = np.ones_like(m)
    for dy, a, b in element:
        for dx in range(a, b + 1):
            out &= padded[H + dy:2 * H + dy, W + dx:2 * W + dx]
    return out


@pytest.mark.parametrize("element", [N.rect(5, 3), N.rect(4, 5, 1, 3), N.ellipse(7), [(0, -2, 2), (1, 0, 0)]])
def test_morphology_matches_brute_force(spark, rng, element):
    m = rng.random((H, W)) < 0.15
    got = on(N.dilate(spark.createDataFrame(sparse(m)), element, W, H))
    assert (got == brute_dilate(m, element)).all()
    thick = brute_dilate(m, N.rect(5, 5))
    assert (on(N.erode(spark.createDataFrame(sparse(thick)), element, W, H)) == brute_erode(thick, element)).all()


def test_close_contains_mask(spark, rng):
    m = rng.random((H, W)) < 0.3
    df = spark.createDataFrame(sparse(m))
    closed = on(N.close(df, N.rect(5, 5), W, H))
    assert (closed | ~m).all()
    assert (on(N.close(N.close(df, N.rect(5, 5), W, H), N.rect(5, 5), W, H)) == closed).all()


@pytest.mark.parametrize("conn,tile", [(8, 256), (4, 256), (8, 8), (4, 8), (8, 3)])
def test_components_match_flood_fill(spark, rng, conn, tile):
    m = rng.random((H, W)) < 0.45
    m[5, :] = True                                     # one component across many tiles
    df = spark.createDataFrame(sparse(m)).orderBy(F.rand(1))
    p = CC.connected_components(df, conn, tile=tile).toPandas()
    want = flood(m, conn)[p["y"], p["x"]]
    pairs = pd.DataFrame({"got": p["label"], "want": want})
    assert pairs.groupby("got")["want"].nunique().max() == 1 and pairs.groupby("want")["got"].nunique().max() == 1
    first = p.assign(key=p["y"].astype("int64") * (1 << 32) + p["x"]).groupby("label")["key"].min()
    assert (first.index == first.to_numpy()).all()


def test_spiral_is_one_component(spark):
    m = np.zeros((H, W), bool)
    for i in range(0, 10, 2):
        m[i, i:W - i] = m[H - 1 - i, i:W - i] = True
        m[i:H - i, i] = m[i:H - i, W - 1 - i] = True
        m[i + 1, i] = False
        if i + 2 < 10:
            m[i + 2, i + 1] = True
    n = len(np.unique(flood(m, 4))) - 1
    got = CC.connected_components(spark.createDataFrame(sparse(m)), 4, tile=4).select("label").distinct().count()
    assert got == n


def test_fill_holes_modes(spark):
    m = np.zeros((H, W), bool)
    m[4:10, 4:10] = True
    m[6:8, 6:8] = False                                # a hole
    m[15:, 20] = m[15, 20:] = True                     # a pocket cut off in the corner
    images = spark.createDataFrame([(0, W, H)], "image_id bigint, width int, height int")
    df = spark.createDataFrame(sparse(m))
    border, corner = on(RN.fill_holes(df, images)), on(RN.fill_holes(df, images, "corner"))
    assert border[6:8, 6:8].all() and not border[20, 25] and border.sum() == m.sum() + 4
    assert corner[20, 25] and corner[16:, 21:].all()
    m[0, 0] = True
    assert on(RN.fill_holes(spark.createDataFrame(sparse(m)), images, "corner")).all()


def pad(a, r, mode):
    return np.pad(a, r, mode=mode)


@pytest.mark.parametrize("border,mode", [("reflect", "symmetric"), ("reflect101", "reflect")])
def test_box_and_gaussian_match_numpy(spark, rng, border, mode):
    a = rng.random((H, W))
    df = spark.createDataFrame(frame(a))
    p = pad(a, 3, mode)
    want = sum(p[i:i + H, j:j + W] for i in range(7) for j in range(7)) / 49
    np.testing.assert_allclose(dense(N.box_filter(df, 3, ["v"], width=W, height=H, border=border, tile=8)), want, atol=1e-12)
    k = np.array(N.gaussian_kernel(1.2))
    r = len(k) // 2
    p = pad(a, r, mode)
    want = sum(k[i] * k[j] * p[i:i + H, j:j + W] for i in range(len(k)) for j in range(len(k)))
    np.testing.assert_allclose(dense(N.gaussian(df, 1.2, ["v"], width=W, height=H, border=border, tile=9)), want, atol=1e-12)


def test_filters_keep_a_constant(spark):
    df = spark.createDataFrame(frame(np.full((H, W), 0.25)).assign(g=lambda d: d["x"] / W))
    for out in (N.box_filter(df, 4, ["v"]), N.gaussian(df, 1.5, ["v"]), N.grey_close_open(df, ["v"], 5),
                N.guided_filter(df, "g", ["v"], 2, 1e-3, width=W, height=H), N.lowfreq(df, ["v"], 9.0, W, H)):
        np.testing.assert_allclose(dense(out), 0.25, atol=1e-12)


def test_guided_filter_matches_numpy(spark, rng):
    g, s = rng.random((H, W)), rng.random((H, W))

    def box(a):
        p = np.pad(a, 2, mode="symmetric")
        return sum(p[i:i + H, j:j + W] for i in range(5) for j in range(5)) / 25
    mg, ms = box(g), box(s)
    a = (box(g * s) - mg * ms) / (box(g * g) - mg * mg + 1e-3)
    want = box(a) * g + box(ms - a * mg)
    df = spark.createDataFrame(frame(s).assign(g=g.ravel()))
    np.testing.assert_allclose(dense(N.guided_filter(df, "g", ["v"], 2, 1e-3, width=W, height=H)), want, atol=1e-10)


def test_ellipse_rows():
    assert N.ellipse(5) == [(-2, 0, 0), (-1, -2, 2), (0, -2, 2), (1, -2, 2), (2, 0, 0)]
    assert N.ellipse(1) == [(0, 0, 0)]


def test_block_mean_undoes_upsample(spark, rng):
    a = rng.random((6, 7))
    up = R.upsample_nearest(spark.createDataFrame(frame(a)), 3, ["image_id", "v"])
    back = R.block_mean(up, 3, ["v"], 21, 18).toPandas()
    np.testing.assert_allclose(back["v"], a[back["y"], back["x"]])


def test_box_region_and_shadow_match_definition(spark):
    m = np.zeros((H, W), bool)
    m[8:13, 10:20] = True
    images = spark.createDataFrame([(0, W, H)], "image_id bigint, width int, height int")
    df = spark.createDataFrame(sparse(m))
    box = np.zeros_like(m)
    box[8 - 3:13 + 3, 10 - 3:20 + 3] = True            # 0.35 * 9 = 3.15
    assert (on(RG.edit_region(df, images, "box")) == box).all()
    shadow = np.zeros_like(m)
    shadow[8 - 1:13 + 4, 10 - 3:20 + 3] = True         # up 0.9 -> 1, down 4.5 -> 4
    assert (on(RG.edit_region(df, images, "dilated")) == shadow).all()
    assert on(RG.edit_region(df, images, "full")).all() and (on(RG.edit_region(df, images, "full", generative=False)) == box).all()
    with pytest.raises(ValueError, match="one of mask, dilated, box, full"):
        RG.edit_region(df, images, "halo")


@pytest.mark.parametrize("border,mode", [("reflect", "symmetric"), ("reflect101", "reflect")])
@pytest.mark.parametrize("shape", [(5, 4), (3, 9), (1, 6)])
def test_kernels_wider_than_the_frame_mirror_again(spark, rng, border, mode, shape):
    a = rng.random(shape)
    k = np.array(N.gaussian_kernel(2.0))
    pad = np.pad(a, len(k) // 2, mode=mode)
    want = np.apply_along_axis(np.convolve, 1, np.apply_along_axis(np.convolve, 0, pad, k, "valid"), k, "valid")
    got = N.gaussian(spark.createDataFrame(frame(a)), 2.0, ["v"], width=shape[1], height=shape[0], border=border).toPandas()
    assert np.allclose(want[got["y"], got["x"]], got["v"], atol=1e-9) and len(got) == a.size
