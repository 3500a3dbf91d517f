"""The skew-safe helpers give the same rows as the plain way when one key holds most of the table."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scenelake import scale as S


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    k = np.where(rng.random(6000) < 0.6, 0, rng.integers(1, 40, 6000))
    v = np.round(rng.lognormal(0, 3, 6000), 3)
    v[k == 1] = 5.0                                     # a group of copies of one value
    pdf = pd.DataFrame({"k": k, "v": v, "i": np.arange(6000)})
    return spark.createDataFrame(pdf).repartition(7).cache(), pdf


def test_attach_salted_equals_broadcast(spark, skewed):
    df, pdf = skewed
    means = df.groupBy("k").agg(F.avg("v").alias("m"))
    salted = S.attach(df, means, ["k"], broadcast_rows=0, hot_rows=300).toPandas()
    want = pdf.merge(pdf.groupby("k", as_index=False)["v"].mean().rename(columns={"v": "m"}))
    assert len(salted) == len(want)
    np.testing.assert_allclose(salted.sort_values("i")["m"], want.sort_values("i")["m"])


def test_attach_left_keeps_unmatched(spark, skewed):
    df, pdf = skewed
    few = df.where("k < 3").groupBy("k").agg(F.count("*").alias("n"))
    for limit in (0, 1000):
        out = S.attach(df, few, ["k"], "left", broadcast_rows=limit).toPandas()
        assert len(out) == len(pdf) and out["n"].isna().sum() == (pdf["k"] >= 3).sum()


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_equals_join(spark, skewed, how):
    df, _ = skewed
    right = df.where("k < 30").groupBy("k").agg(F.max("v").alias("top"))
    want = df.join(right, ["k"], how).orderBy("i").toPandas()
    got = S.skew_join(df, right, ["k"], how, hot_rows=200).select(*want.columns).orderBy("i").toPandas()
    pd.testing.assert_frame_equal(got, want)


@pytest.fixture
def plain_partitions(spark):
    """As many tasks as partitions, and no broadcast joins, so that a hot task shows."""
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_equal_rows_of_a_hot_key_are_dealt_out(spark, plain_partitions):
    same = spark.range(1000).select(F.lit(1).alias("k"), F.lit("x").alias("v"))
    right = spark.createDataFrame([(1, "r"), (2, "s")], "k int, w string")
    for left in (same, S.settle(same)):
        out = S.skew_join(left, right, ["k"], hot_rows=50)
        assert out.count() == 1000
        assert max(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()) < 500


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_null_keys_are_dealt_out(spark, plain_partitions, how):
    """A third of the rows has no key; one scan of the left side."""
    scans = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def seen(i):
        scans.add(1)
        return i
    left = spark.range(3000).select(seen(F.col("id").cast("int")).alias("i"), F.when(F.col("id") % 3 > 0, F.col("id") % 50).alias("k"))
    right = spark.createDataFrame([(i, f"r{i}") for i in range(40)], "k long, w string")
    out = S.skew_join(left, right, ["k"], how, hot_rows=100)
    parts = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert scans.value == 3000 and max(parts) < 1000
    want = left.join(right, ["k"], how)
    assert out.columns == want.columns and sorted(map(str, out.collect())) == sorted(map(str, want.collect()))


def test_sketch_lists_hot_keys(spark):
    df = spark.range(200_000).select(F.when(F.col("id") % 4 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    once = S.settle(df, hot=S.hot_metric(["k"]))
    hot = S.hot_keys(S.settled(once)["hot"], 10_000)
    assert list(hot.values()) == [5] or list(hot.values()) == [6]
    assert S.hot_keys(S.settled(once)["hot"], 10**6) == {}


@pytest.mark.parametrize("limit", [300, 10**9])
def test_quantiles_exact(spark, skewed, limit):
    df, pdf = skewed
    qs = {"a": 0.03, "b": 0.5, "c": 0.8, "d": 0.95, "lo": 0.0, "hi": 1.0}
    got = S.quantiles(df, ["k"], "v", qs, group_rows=limit).orderBy("k").toPandas()
    want = pdf.groupby("k")["v"].quantile(list(qs.values())).unstack()
    np.testing.assert_allclose(got[list(qs)].to_numpy(), want.to_numpy(), rtol=1e-12)


@pytest.mark.parametrize("keys", [["k"], []])
def test_ranked_by_ranges_equals_window(spark, skewed, keys):
    df, _ = skewed
    order = [F.col("v"), F.col("i")]
    near = S.ranked(df, keys, order).orderBy("i").toPandas()
    far = S.ranked(df, keys, order, group_rows=0).select(*near.columns).orderBy("i").toPandas()
    pd.testing.assert_frame_equal(near, far)


def test_prefix_sum_equals_running_window(spark, skewed):
    df, _ = skewed
    order = [F.col("i")]
    near = S.sum_before(df, ["k"], order, F.col("i"), "s").orderBy("i").toPandas()
    far = S.sum_before(df, ["k"], order, F.col("i"), "s", group_rows=0).select(*near.columns).orderBy("i").toPandas()
    pd.testing.assert_frame_equal(near, far)


def test_settle_observes_rows(spark):
    out = S.settle(spark.range(10).toDF("a"), "t", top=F.max("a"))
    assert S.settled(out) == {"rows": 10, "top": 9} and S.settled(out.where("a > 1")) is None


def test_many_rows_in_a_small_file_are_not_broadcast(spark):
    """250,000 rows that pack into a few kilobytes; the optimiser knows the size of the file only."""
    many = S.settle(spark.range(250_000).selectExpr("id % 10 as k", "1 as v"))
    other = S.settle(spark.range(300_000).selectExpr("id % 9 as k"))
    few = spark.range(9).selectExpr("id as k", "id as w")

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(many.where("v > 0").join(other, ["k"]))
    assert "BroadcastHashJoin" in plan(S.attach(many, few, ["k"])) and S.attach(many, few, ["k"]).count() == 225_000


def test_layout_follows_the_row_count(spark):
    """Not the size of the shuffled blocks, which pack so well that few tasks would get all rows."""
    from scenelake.operators import masks as M
    assert [S.dealt(spark.range(n), ["id"], 100).rdd.getNumPartitions() for n in (5_000, 20_000)] == [50, 200]
    scores = spark.range(64).selectExpr("0L as image_id", "0 as y", "cast(id div 8 as int) as x", "'a' as model", "cast(id % 8 as int) as class_id", "id / 64 as logit")
    out = M.ensemble_argmax(scores, spark.sql("select 7 as class_id, 'floor' as name"), ["floor"])
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString() and out.where("is_wanted").count() == 8
