"""Masks as sparse pixel sets: a row (image, mask, y, x) means the pixel is on."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import attach, dealt

PIXEL = ["image_id", "y", "x"]


def union(a: DataFrame, b: DataFrame, key=("image_id", "y", "x")) -> DataFrame:
    return a.select(*key).union(b.select(*key)).distinct()


def intersection(a: DataFrame, b: DataFrame, key=("image_id", "y", "x")) -> DataFrame:
    return a.join(b.select(*key).distinct(), list(key), "left_semi")


def difference(a: DataFrame, b: DataFrame, key=("image_id", "y", "x")) -> DataFrame:
    return a.join(b.select(*key), list(key), "left_anti")


def union_of_moves(masks: DataFrame, moves: DataFrame, column: str, fallback: str | None = None) -> DataFrame:
    """Union over all moves of a scene of the mask each move names in `column`, or else in `fallback`."""
    mask_id = F.coalesce(F.col(column), F.col(fallback)) if fallback else F.col(column)
    wanted = moves.select("image_id", mask_id.alias("mask_id")).distinct()
    return attach(masks, wanted, ["image_id", "mask_id"], "left_semi").select(*PIXEL).distinct()


def label_membership(pixels: DataFrame, label: str, names: list, dictionary: DataFrame | None = None) -> DataFrame:
    """Pixels whose label is one of `names`; with a `dictionary` (label, name) only the first listed name counts."""
    if dictionary is None:
        return pixels.where(F.col(label).isin(names))
    wanted = dictionary.where(first_name("name").isin(names)).select(label).distinct()
    return attach(pixels, wanted, [label], "left_semi")


def first_name(column: str) -> Column:
    """'floor, flooring' -> 'floor'."""
    return F.trim(F.split(F.col(column), ",")[0])


def mask_stats(mask: DataFrame, images: DataFrame, keys=("image_id", "mask_id")) -> DataFrame:
    """Area, inclusive and exclusive box, coverage in percent and box centre of each mask."""
    box = mask.groupBy(*keys).agg(
        F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"),
        F.max("x").alias("x1"), F.max("y").alias("y1"))
    sized = box.join(images.select("image_id", "width", "height"), "image_id")
    return sized.select(
        *keys, "area", "x0", "y0", "x1", "y1",
        (F.col("x1") + 1).alias("x1_excl"), (F.col("y1") + 1).alias("y1_excl"),
        F.bround(F.col("area") * 100.0 / (F.col("width").cast("bigint") * F.col("height")), 2).alias("coverage_pct"),
        ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))


def mask_iou(a: DataFrame, b: DataFrame, key=("image_id", "y", "x"), group=("image_id",)) -> DataFrame:
    """Intersection over union per group; an empty union gives 0."""
    both = (a.select(*key, F.lit(1).alias("a"), F.lit(0).alias("b"))
            .union(b.select(*key, F.lit(0).alias("a"), F.lit(1).alias("b"))))
    flags = both.groupBy(*key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    sums = flags.groupBy(*group).agg(F.sum(F.col("a") * F.col("b")).alias("inter"), F.count("*").alias("uni"))
    return sums.select(*group, "inter", "uni", (F.col("inter") / F.greatest("uni", F.lit(1))).alias("iou"))


def touching(labelled: DataFrame, mask: DataFrame, key=("image_id", "y", "x"), label=("image_id", "label")) -> DataFrame:
    """All pixels of the components that share at least one pixel with `mask`."""
    hit = labelled.join(mask.select(*key), list(key), "left_semi").select(*label).distinct()
    return attach(labelled, hit, list(label), "left_semi")


def mirrored_back(votes: DataFrame, width) -> DataFrame:
    """Undo the left-right flip of the passes that were run on a mirrored copy."""
    w = F.col(width) if isinstance(width, str) else F.lit(width)
    return votes.withColumn("x", F.when(F.col("mirrored"), w - 1 - F.col("x")).otherwise(F.col("x")).cast("int"))


def majority_vote(votes: DataFrame, width) -> DataFrame:
    """Pixel-wise majority over passes; an even split counts as on."""
    tally = mirrored_back(votes, width).groupBy(*PIXEL).agg(
        F.count_if("v").alias("n_on"), F.count("*").alias("n_pass"))
    return tally.withColumn("v", F.col("n_on") >= F.ceil(F.col("n_pass") / 2.0))


def vote_agreement(votes: DataFrame, width) -> DataFrame:
    """Per pass: IoU with the majority (4 places) and the share of pixels on which all passes agree (percent, 2 places).

    The passes of one pixel meet in a window, so the votes are shuffled once and never joined with themselves.
    """
    w = Window.partitionBy(*PIXEL)
    on = F.col("v").cast("int")
    marked = mirrored_back(votes, width).select(
        "image_id", "pass_id", on.alias("v"), F.sum(on).over(w).alias("n_on"), F.count("*").over(w).alias("n_pass"))
    major = (F.col("n_on") >= F.ceil(F.col("n_pass") / 2.0)).cast("int")
    agreed = (F.col("n_on") == 0) | (F.col("n_on") == F.col("n_pass"))
    sums = marked.groupBy("image_id", "pass_id").agg(
        F.sum(F.col("v") * major).alias("inter"), F.sum(F.greatest(F.col("v"), major)).alias("uni"),
        F.count_if(agreed).alias("agreed"), F.count("*").alias("n"))
    return sums.select(
        "image_id", "pass_id",
        F.bround(F.col("inter") / F.greatest("uni", F.lit(1)), 4).alias("iou_vs_majority"),
        F.bround(F.col("agreed") * 100.0 / F.col("n"), 2).alias("unanimous_pct"))


def ensemble_argmax(scores: DataFrame, classes: DataFrame, wanted: list[str], extra=()) -> DataFrame:
    """Softmax per model, mean over models, best class per pixel and whether it is one of the wanted names.

    The scores are laid out by pixel once; softmax, mean and argmax then all run on that layout. `extra` names further
    key columns, such as the pass of a test-time copy.
    """
    at = [*PIXEL, *extra]
    laid = dealt(scores, at)
    per_model = Window.partitionBy(*at, "model")
    e = laid.withColumn("_e", F.exp(F.col("logit") - F.max("logit").over(per_model)))
    soft = e.withColumn("p", F.col("_e") / F.sum("_e").over(per_model))
    mean = soft.groupBy(*at, "class_id").agg(F.avg("p").alias("p"))
    best = mean.groupBy(*at).agg(F.max(F.struct("p", (-F.col("class_id")).alias("neg"))).alias("b"))
    picked = best.select(*at, (-F.col("b.neg")).alias("class_id"), F.col("b.p").alias("p"))
    names = classes.select("class_id", first_name("name").alias("name"))
    return attach(picked, names, ["class_id"], "left").select(
        *at, "class_id", "p", "name", F.coalesce(F.col("name").isin(wanted), F.lit(False)).alias("is_wanted"))


def instance_union(instances: DataFrame, pixels: DataFrame, threshold: float, keys=("image_id",)) -> DataFrame:
    """Union of the pixels of all instances whose score exceeds the threshold; an image without any gives no row."""
    kept = instances.where(F.col("score") > threshold).select(*keys, "instance_id").distinct()
    return attach(pixels, kept, [*keys, "instance_id"], "left_semi").select(*keys, "y", "x").distinct()


def instance_scores(instances: DataFrame, threshold: float, keys=("image_id",)) -> DataFrame:
    """The kept scores to 3 places with their multiplicity, as rows rather than one list per image."""
    return (instances.where(F.col("score") > threshold)
            .groupBy(*keys, F.bround("score", 3).alias("score")).agg(F.count("*").alias("n")))


def border_fraction(pixels: DataFrame, images: DataFrame, tol: int = 12, frac: float = 0.9) -> DataFrame:
    """Share of near-white border pixels and the matting route that follows from it; corners count twice.

    A frame that already carries an alpha channel (`has_alpha`) needs no matting.
    """
    sized = attach(pixels, images.select("image_id", "width", "height", "has_alpha"), ["image_id"])
    sides = ((F.col("y") == 0).cast("int") + (F.col("y") == F.col("height") - 1).cast("int")
             + (F.col("x") == 0).cast("int") + (F.col("x") == F.col("width") - 1).cast("int"))
    white = (F.least("r", "g", "b") >= 255 - tol).cast("double")
    share = (sized.withColumn("_n", sides).where("_n > 0").groupBy("image_id")
             .agg((F.sum(white * F.col("_n")) / F.sum("_n")).alias("border_white"), F.first("has_alpha").alias("has_alpha")))
    route = F.when(F.col("has_alpha"), "none").when(F.col("border_white") >= frac, "white").otherwise("rmbg")
    return share.select("image_id", "border_white", route.alias("matte"))
