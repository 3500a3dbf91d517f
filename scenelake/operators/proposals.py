"""Choosing among mask proposals of a prompt."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import ranked, settle, skew_join


def pick_proposal(props: DataFrame, max_frac: float = 0.3, max_ratio: float = 4.0, min_iou: float = 0.3, prompt: str = "prompt_id") -> DataFrame:
    """Start from the best IoU; take the largest proposal that is a modest enlargement of it, if there is one.

    Both steps are maxima combined map-side, so no group is sorted; a prompt with very many proposals is salted in the
    join between them. Ties go to the smaller k.
    """
    best_iou = props.groupBy(prompt).agg(F.max(F.struct("iou", (-F.col("k")).alias("neg"), "area")).alias("t"), F.count("*").alias("n"))
    top = settle(best_iou.select(prompt, (-F.col("t.neg")).alias("top_k"), F.col("t.area").alias("top_area"), "n"), "top", peak=F.max("n"))
    fits = ((F.col("area") > F.col("top_area")) & (F.col("area") <= F.col("top_area") * max_ratio)
            & (F.col("area") < F.col("frame_px") * max_frac) & (F.col("iou") >= min_iou))
    best = skew_join(props, top.drop("n"), [prompt], counts=top).groupBy(prompt).agg(
        F.first("top_k").alias("top_k"), F.max(F.when(fits, F.struct("area", (-F.col("k")).alias("neg")))).alias("b"))
    return best.select(prompt, "top_k", F.coalesce(-F.col("b.neg"), F.col("top_k")).alias("picked"))


def keep_proposals(props: DataFrame, min_frac: float = 0.01, prompt: str = "prompt_id", box_px: str = "box_px") -> DataFrame:
    """Proposals that cover enough of the prompt box, best IoU first; the largest is kept if none does."""
    enough = F.col("area") >= F.col(box_px) * min_frac
    per = props.groupBy(prompt).agg(F.count_if(enough).alias("_n"), F.max(F.struct("area", "iou", (-F.col("k")).alias("neg"))).alias("_b"), F.count("*").alias("n"))
    s = settle(per, "enough", peak=F.max("n"))
    kept = skew_join(props, s.drop("n"), [prompt], counts=s).where(
        F.when(F.col("_n") > 0, enough).otherwise(F.col("k") == -F.col("_b.neg"))).drop("_n", "_b")
    return ranked(kept, [prompt], [F.col("iou").desc(), F.col("k")], "rank")
