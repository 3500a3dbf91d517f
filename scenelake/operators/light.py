"""Light estimates: normalisation, ambient share, chromaticity and albedo calibration per image."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colour import jitter_contrast, luminance
from ..functions.numeric import clip, guard, u8_trunc
from ..scale import attach, quantiles, settle

RGB = ("r", "g", "b")


def percentile_normalise(px: DataFrame, value: str, inside: Column, keys=("image_id",), q: float = 0.9,
                         lo: float = 1e-3, hi: float = 1.15, out: str = "norm") -> DataFrame:
    """Value over its q-quantile inside a mask, limited to [0, hi]; null where the mask of the image is empty."""
    ref = quantiles(px.where(inside), list(keys), value, {"_ref": q})
    norm = F.when(F.col("_ref").isNotNull(), clip(F.col(value) / guard("_ref", lo), 0.0, hi))
    return attach(px, ref, list(keys), "left").withColumn(out, norm).drop("_ref")


def anchor_mean_one(px: DataFrame, inside: Column, keys=("image_id",)) -> DataFrame:
    """Scale colours so that mean luminance inside the mask is 1; `ref` is the level that was divided out.

    An image whose mask is empty keeps its rows, with null colours and level.
    """
    ref = px.where(inside).groupBy(*keys).agg(F.avg(luminance()).alias("ref"))
    j = attach(px, ref, list(keys), "left")
    return j.withColumns({c: F.when(F.col("ref").isNotNull(), F.col(c) / guard("ref", 1e-5)) for c in RGB})


def ambient_split(px: DataFrame, inside: Column, keys=("image_id",), ambient: float | None = None, y="lum") -> DataFrame:
    """Ambient share a of the light, given or read off the darkest part, and the direct term S of each pixel; both are
    null where the mask of the image is empty."""
    if ambient is not None:
        j = px.withColumn("a", F.lit(float(ambient)))
    else:
        p = quantiles(px.where(inside), list(keys), y, {"_p3": 0.03, "_p95": 0.95})
        a = clip(F.col("_p3") / guard("_p95", 1e-5), 0.05, 0.6)
        j = attach(px, p.select(*keys, a.alias("a")), list(keys), "left")
    return j.withColumn("s", F.when(F.col("a").isNotNull(), F.greatest((F.col(y) - F.col("a")) / guard(F.lit(1.0) - F.col("a"), 1e-5), F.lit(0.0))))


def quartile_chroma(px: DataFrame, inside: Column, keys=("image_id",), min_rows: int = 50) -> DataFrame:
    """Mean chromaticity of the darkest and the brightest quarter, at unit luminance; white when there are few pixels or none."""
    lit = px.withColumn("_y", luminance()).where(inside)
    q = quantiles(lit, list(keys), "_y", {"_lo": 0.25, "_hi": 0.75})
    j = attach(lit, q, list(keys))
    aggs = []
    for side, sel in (("amb", F.col("_y") <= F.col("_lo")), ("dir", F.col("_y") >= F.col("_hi"))):
        aggs.append(F.count_if(sel).alias(f"_n{side}"))
        aggs += [F.avg(F.when(sel, F.col(c) / guard("_y", 1e-5))).alias(f"_{side}_{c}") for c in RGB]
    m = px.select(*keys).distinct().join(j.groupBy(*keys).agg(*aggs), list(keys), "left")
    out = []
    for side in ("amb", "dir"):
        unit = guard(luminance(*[f"_{side}_{c}" for c in RGB]), 1e-5)
        out += [F.when(F.coalesce(f"_n{side}", F.lit(0)) < min_rows, F.lit(1.0)).otherwise(F.col(f"_{side}_{c}") / unit).alias(f"{side}_{c}") for c in RGB]
    return m.select(*keys, *out)


def calibrate_mean(tex: DataFrame, target: float, keys: list[str], rounds: int = 4, lo: float = 0.01, hi: float = 0.95) -> DataFrame:
    """Scale and clip colours until mean luminance meets the target.

    A round needs one number per texture. The numbers found so far are kept in one small written row and replayed on
    the source pixels, so each round is a single scan with a map-side combined mean.
    """
    def replay(df, n):
        for i in range(n):
            df = df.withColumns({c: clip(F.col(c) * F.col(f"_k{i}"), lo, hi) for c in RGB})
        return df
    factors = settle(tex.select(*keys).distinct(), "factors")
    for i in range(rounds):
        now = replay(attach(tex, factors, keys), i)
        k = now.groupBy(*keys, *[f"_k{j}" for j in range(i)]).agg((F.lit(target) / guard(F.avg(luminance()), 1e-4)).alias(f"_k{i}"))
        factors = settle(k, "factors")
    return replay(attach(tex, factors, keys), rounds).drop(*[f"_k{i}" for i in range(rounds)])


def augment(px: DataFrame, passes: list[dict], width: Column, seed: int = 0, out: str = "u8") -> DataFrame:
    """Test-time copies of each frame: mirror, contrast, brightness and noise, quantised to 8 bits.

    `passes` is a short list of dicts with mirrored, contrast, brightness and noise_sd; it becomes an array literal. Noise
    is a function of the pixel, the channel and the seed, so a retried task draws the same values.
    """
    table = F.array(*[F.struct(F.lit(i).alias("pass_id"), F.lit(bool(p.get("mirrored", False))).alias("mirrored"),
                               F.lit(float(p.get("contrast", 1.0))).alias("contrast"), F.lit(float(p.get("brightness", 0.0))).alias("brightness"),
                               F.lit(float(p.get("noise_sd", 0.0))).alias("noise_sd")) for i, p in enumerate(passes)])
    j = px.select("*", F.explode(table).alias("p")).select(*px.columns, "p.*")

    def uniform(c, salt):
        h = F.xxhash64("image_id", "pass_id", "y", "x", F.lit(f"{c}{salt}{seed}"))
        return (F.pmod(h, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)

    def noise(c):
        if not any(p.get("noise_sd") for p in passes):
            return F.lit(0.0)
        return F.sqrt(F.log(uniform(c, "a")) * -2) * F.cos(uniform(c, "b") * 6.283185307179586) * F.col("noise_sd")
    shade = {c: u8_trunc(jitter_contrast(c, "contrast", "brightness") + noise(c)) for c in RGB}
    return j.select("image_id", "pass_id", "mirrored", "y", F.when(F.col("mirrored"), width - 1 - F.col("x")).otherwise(F.col("x")).cast("int").alias("x"),
                    *[v.alias(f"{c}_{out}") for c, v in shade.items()])
