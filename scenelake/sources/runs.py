"""Run documents: nested JSON, one document per run, whose layout drifted over time."""

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The public fields of a stage row, and a stage name that was renamed.
STAGE_FIELDS = ("stage", "model", "time_s", "gen_s", "load_s", "gpu_peak_gb", "cached")
RENAMED_STAGES = {"illumination": "irradiance"}

# Stages keep every key they come with, so they are read as maps; the other fields are typed.
RUN_SCHEMA = """
    scene string, pattern string, seg string, illum string, material string, device string, tta int, seed int,
    tile_m double, m_per_1000px double, floor_coverage_pct double, total_gen_s double, total_s double,
    material_params struct<name string, albedo double, roughness double, ior double, coat double,
        coat_roughness double, delight double, f0 double>,
    moves array<struct<src array<int>, dst array<int>, scale double, src_box array<int>, dst_box array<int>>>,
    removal string, insertion string, src_region string, dst_region string, region_margin double, sr_factor int,
    sr_steps int, start_step int, voxels int, image string, mask string, weights string, matte string,
    formats array<string>, stages array<map<string,string>>
"""


def basename(path: Column) -> Column:
    """Last part of a path written with either kind of slash."""
    return F.element_at(F.split(path, r"[\\/]"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def read_runs(spark: SparkSession, root: str, multi_line: bool = True) -> DataFrame:
    """All run documents below `root`; kind, scene, pattern, segmenter and material come from the folders.

    The folders are <kind>/<scene>[/<pattern>/<segmenter>[/<material>]]; `key=value` folder names work too.
    """
    docs = (spark.read.schema(RUN_SCHEMA).option("multiLine", multi_line).option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.json").json(root))
    below = re.escape(root.removeprefix("file:").strip("/"))
    inner = F.regexp_extract(F.input_file_name(), f"{below}/(.+)/[^/]+$", 1)
    parts = F.transform(F.split(inner, "/"), lambda p: F.regexp_replace(p, "^[a-z]+=", ""))

    def part(i):
        return F.try_element_at(parts, F.lit(i))
    return docs.select(
        inner.alias("run_path"), part(1).alias("kind"), part(2).alias("scene_name"), part(3).alias("pattern_name"),
        part(4).alias("segmenter"), F.coalesce(part(5), F.col("material")).alias("material_name"), "*")


def normalise_stage_name(name: Column) -> Column:
    for old, new in RENAMED_STAGES.items():
        name = F.when(name == old, F.lit(new)).otherwise(name)
    return name


def stage_seconds(time_s="time_s", gen_s="gen_s") -> Column:
    """Old documents call the time gen_s; a stage without either took no time. Loading is not included."""
    return F.coalesce(F.col(time_s), F.col(gen_s), F.lit(0.0))


def stage_rows(runs: DataFrame, keep: list[str]) -> DataFrame:
    """One row per stage of each run: typed public fields, everything else in `extras`."""
    s = runs.select(*keep, F.posexplode("stages").alias("stage_idx", "_s"))

    def field(name, kind="string"):
        return F.try_element_at("_s", F.lit(name)).cast(kind)
    extras = F.map_filter("_s", lambda k, v: ~k.isin(*STAGE_FIELDS))
    return s.select(*keep, "stage_idx", normalise_stage_name(field("stage")).alias("stage"), field("model").alias("model"),
                    F.coalesce(field("time_s", "double"), field("gen_s", "double"), F.lit(0.0)).alias("time_s"),
                    field("load_s", "double").alias("load_s"), field("gpu_peak_gb", "double").alias("gpu_peak_gb"),
                    F.coalesce(field("cached", "boolean"), F.lit(False)).alias("cached"), extras.alias("extras"))


def typed_extra(column: str, path: str, kind: str) -> Column:
    """One value out of an open JSON column."""
    return F.get_json_object(column, path).cast(kind)
