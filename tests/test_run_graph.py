"""Runs and their graph against flood fill and brute force on small frames."""

import numpy as np
import pandas as pd
import pytest

from scenelake.operators import neighbourhood as N
from scenelake.operators import region_rows as RR
from scenelake.operators import run_graph as RN
from tests.test_rasters import H, W, brute_dilate, brute_erode, flood, on, sparse

IMAGES = [(k, W, H) for k in range(4)]


@pytest.fixture(scope="module")
def images(spark):
    return spark.createDataFrame(IMAGES, "image_id bigint, width int, height int")


def noise(seed, share):
    return np.random.default_rng(seed).random((H, W)) < share


def spiral():
    m = np.zeros((H, W), bool)
    for i in range(0, 10, 2):
        m[i, i:W - i] = m[H - 1 - i, i:W - i] = True
        m[i:H - i, i] = m[i:H - i, W - 1 - i] = True
    m[1, 0] = False
    return m


SHAPES = {"noise": noise(1, 0.5), "dense": noise(2, 0.7), "sparse": noise(3, 0.05), "spiral": spiral(), "full": np.ones((H, W), bool),
          "ring": np.pad(np.pad(np.zeros((3, 4), bool), 1, constant_values=True), ((8, H - 13), (9, W - 15))), "line": np.pad(np.ones((1, W), bool), ((11, H - 12), (0, 0)))}


def plain_fill(m, mode):
    free = flood(~m, 4)
    outside = {free[0, 0]} if mode == "corner" else {*free[0], *free[-1], *free[:, 0], *free[:, -1]}
    return m | ((free > 0) & ~np.isin(free, list(outside - {0})))


@pytest.mark.parametrize("band", [256, 4, 1])
@pytest.mark.parametrize("mode", ["border", "corner"])
def test_fill_holes(spark, images, band, mode):
    df = spark.createDataFrame(pd.concat([sparse(m, k % 4, k) for k, m in enumerate(SHAPES.values())])).repartition(3)
    got = RN.fill_holes(df, images, mode, band=band).toPandas()
    assert not got.duplicated().any()
    for k, m in enumerate(SHAPES.values()):
        out = np.zeros((H, W), bool)
        p = got[got["mask_id"] == k]
        out[p["y"], p["x"]] = True
        assert (out == plain_fill(m, mode)).all(), list(SHAPES)[k]


@pytest.mark.parametrize("conn", [4, 8])
@pytest.mark.parametrize("band", [256, 4, 1])
def test_labels_of_runs(spark, conn, band):
    m = noise(5, 0.45)
    p = RN.label_runs(RN.as_runs(spark.createDataFrame(sparse(m))), conn, band=band).toPandas()
    want = flood(m, conn)[p["y0"], p["x0"]]
    assert len(set(zip(p["label"], want))) == len(set(p["label"])) == len(set(want))
    assert (p.groupby("label").apply(lambda g: (g["y0"].astype("int64") * (1 << 32) + g["x0"]).min()) == sorted(set(p["label"]))).all()


def test_clean_mask(spark, images):
    m, point = noise(8, 0.3), (6, 12)
    df, at = spark.createDataFrame(sparse(m)), spark.createDataFrame([(0, 0, *point)], "image_id bigint, mask_id int, py int, px int")
    closed = brute_erode(brute_dilate(m, N.rect(3, 3)), N.rect(3, 3))
    lab = flood(closed, 8)
    pick = lab[point] or max(range(1, lab.max() + 1), key=lambda k: ((lab == k).sum(), -k))
    assert (on(RN.clean_mask(df, at, images, 3, W, H, band=5)) == plain_fill(lab == pick, "corner")).all()


def test_nothing(spark, images):
    none = spark.createDataFrame([], "image_id bigint, mask_id int, y int, x int")
    assert RN.fill_holes(none, images).count() == 0


def test_sweep_counts(spark):
    rng = np.random.default_rng(4)
    rows = [(int(y), int(a), int(a + n), int(s)) for y, a, n, s in zip(rng.integers(0, 3, 60), rng.integers(0, 40, 60), rng.integers(0, 9, 60), rng.integers(0, 2, 60))]
    want = np.zeros((2, 3, 60), int)
    for y, a, b, s in rows:
        want[0, y, a:b + 1] += 1
        want[1, y, a:b + 1] += s
    got = np.zeros_like(want)
    for r in N.swept(spark.createDataFrame(rows, "y int, x0 int, x1 int, s int"), [], "s").collect():
        assert (got[0, r.y, r.x0:r.x1 + 1] == 0).all()
        got[0, r.y, r.x0:r.x1 + 1], got[1, r.y, r.x0:r.x1 + 1] = r["_n"], r["_n_s"]
    assert (got == want).all()


def test_region_algebra(spark):
    rng = np.random.default_rng(6)

    def some(n):
        y, x = rng.integers(0, H - 6, n), rng.integers(0, W - 8, n)
        return [(0, int(a), int(a + h), int(b), int(b + w)) for a, b, h, w in zip(y, x, rng.integers(0, 6, n), rng.integers(0, 8, n))]

    def dense(rows):
        m = np.zeros((H, W), bool)
        for _, y0, y1, x0, x1 in rows:
            m[y0:y1 + 1, x0:x1 + 1] = True
        return m
    kinds, keys = "image_id bigint, y0 int, y1 int, x0 int, x1 int", ["image_id"]
    a, b = some(9), some(9)
    da, db = (spark.createDataFrame(r, kinds) for r in (a, b))
    ma, mb = dense(a), dense(b)
    for got, want in ((RR.union(da, db, keys), ma | mb), (RR.intersection(da, db, keys), ma & mb), (RR.difference(da, db, keys), ma & ~mb)):
        assert (on(RR.pixels(got, keys)) == want).all()
    assert RR.area(da, keys).first().area == ma.sum()
    px = spark.createDataFrame(sparse(np.ones((H, W), bool)))
    left = RR.outside(px, da)
    assert left.columns == px.columns and (on(left) == ~ma).all()


@pytest.mark.parametrize("name", ["g3_clean_mask", "g4_fill_holes", "g4_fill_holes_from_corner"])
def test_incomplete_frames(spark, tmp_path, name):
    """A frame has the size that `images` gives it, also where the table has only its first lines."""
    from __spark_entry__ import oracle_sql, queries
    from tests.harness import compare
    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 106").toPandas().to_parquet(f"{tmp_path}/embeddings.parquet")
    err, _, n = compare(spark, name, queries()[name], oracle_sql()[name], str(tmp_path))
    assert err is None and n, err
