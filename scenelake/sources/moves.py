"""Move specifications: JSON with a list of moves, or one pair of points at the top level."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.boxes import box_centre

MOVE_SCHEMA = ("scene string, description string, moves array<struct<initial: struct<x: int, y: int>, "
               "final: struct<x: int, y: int>, src_box: array<int>, dst_box: array<int>, mask: string>>, "
               "initial struct<x: int, y: int>, final struct<x: int, y: int>")


def read_moves(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return parse_moves(spark.read.schema(MOVE_SCHEMA).option("multiLine", multi_line).json(path))


def parse_moves(docs: DataFrame) -> DataFrame:
    """One row per move. A move without a point uses the centre of its box; a missing mask stays null."""
    nothing = F.lit(None)
    single = F.array(F.struct(
        F.col("initial").alias("initial"), F.col("final").alias("final"), nothing.cast("array<int>").alias("src_box"),
        nothing.cast("array<int>").alias("dst_box"), nothing.cast("string").alias("mask")))
    listed = F.when(F.size("moves") > 0, F.col("moves")).otherwise(single)
    m = docs.select("scene", F.posexplode(listed).alias("move_idx", "m"))

    def place(point, box):
        x, y = box_centre(*[F.try_element_at(box, F.lit(i)) for i in (1, 2, 3, 4)])
        return F.coalesce(F.col(f"m.{point}.x"), x), F.coalesce(F.col(f"m.{point}.y"), y)
    src, dst = place("initial", F.col("m.src_box")), place("final", F.col("m.dst_box"))
    return m.select("scene", "move_idx", src[0].alias("src_x"), src[1].alias("src_y"), dst[0].alias("dst_x"), dst[1].alias("dst_y"),
                    F.col("m.src_box").alias("src_box"), F.col("m.dst_box").alias("dst_box"), F.col("m.mask").alias("mask_id"))
