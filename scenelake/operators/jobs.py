"""The job table: queue order, progress, elapsed time and state."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import attach, ranked, skew_join, sum_before
from ..sources.runs import normalise_stage_name

# The stage order of each job kind, and the order in which result pictures are shown.
STAGE_ORDER = {
    "floor": ["segmentation", "geometry", "irradiance", "render"],
    "object": ["segmentation", "mask_dilation", "geometry", "downsample", "background_generation", "load",
               "regeneration", "super_resolution"],
    "image3d": ["preprocess", "reconstruct"],
}
ARTIFACTS = {
    "floor": ["mask_floor.png", "irradiance.png", "ao.png", "albedo_old.png"],
    "object": ["task_points.png", "mask_object.png", "mask_dilated.png", "region_source.png", "input_lowres.png",
               "background.png", "output_lowres.png", "output_sr_full.png"],
    "image3d": ["subject.png", "input_processed.png", "preview.png"],
}
STAGE_AFTER = {(kind, a): b for kind, order in STAGE_ORDER.items() for a, b in zip(order, order[1:])}
ACTIVE = ("queued", "running")
TERMINAL = ("done", "failed")


def queue_position(jobs: DataFrame, queue: str | None = None) -> DataFrame:
    """0 unless queued, else how many queued or running jobs were created strictly earlier.

    Active jobs are first counted per creation time; equal times therefore share a position, and the running sum over
    times is split into ranges when the queue is long.
    """
    keys = [queue] if queue else []
    per_time = jobs.where(F.col("status").isin(*ACTIVE)).groupBy(*keys, "created").agg(F.count("*").alias("_n"))
    ahead = sum_before(per_time, keys, [F.col("created")], F.col("_n"), "_ahead").select(*keys, "created", "_ahead")
    queued = F.col("status") == "queued"
    return (skew_join(jobs, ahead, [*keys, "created"], "left")
            .withColumn("position", F.when(queued, F.coalesce("_ahead", F.lit(0))).otherwise(F.lit(0)).cast("bigint"))
            .drop("_ahead"))


def next_stage(kind: Column, stage: Column) -> Column:
    """The stage that runs after a finished one; null after the last or an unknown one."""
    table = F.create_map(*[F.lit(v) for (k, a), b in STAGE_AFTER.items() for v in (f"{k}/{a}", b)])
    return F.try_element_at(table, F.concat_ws("/", kind, normalise_stage_name(stage)))


def first_stage(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for k, order in STAGE_ORDER.items() for v in (k, order[0])]), kind)


def stage_in_progress(finished: DataFrame, job: str, kind: Column, order: list[str]) -> DataFrame:
    """Per job: the last finished stage and the one in progress."""
    last = finished.groupBy(job).agg(F.max(F.struct(*order, "stage")).alias("l"))
    return last.select(job, F.col("l.stage").alias("last_stage"), next_stage(kind, F.col("l.stage")).alias("stage"))


def order_artifacts(files: DataFrame, job: str, kind: Column, name: str = "name") -> DataFrame:
    """Pictures of a job: the known ones in their listed order, then the others by name."""
    ranks = [(f"{k}/{n}", i) for k, names in ARTIFACTS.items() for i, n in enumerate(names)]
    table = F.create_map(*[F.lit(v) for pair in ranks for v in pair])
    pictures = (files.where(F.col(name).endswith(".png")).select(job, name, kind.alias("_kind")).distinct()
                .select(job, name, F.coalesce(F.try_element_at(table, F.concat_ws("/", "_kind", name)), F.lit(1_000_000)).alias("_r")))
    return ranked(pictures, [job], [F.col("_r"), F.col(name)], "position").drop("_r")


def dispatch_order(jobs: DataFrame, arrival: list[Column]) -> DataFrame:
    """Order in which one worker takes requests: interactive ones first, then by arrival."""
    priority = F.when(F.col("interactive"), F.lit(0)).otherwise(F.lit(1))
    return ranked(jobs.withColumn("priority", priority), [], [F.col("priority"), *arrival], "dispatch")


def elapsed_s(now: Column, created="created", started="started", finished="finished") -> Column:
    """Seconds to one place, from the start (or creation) to the end (or now)."""
    micros = (F.unix_micros(F.coalesce(F.col(finished), now)) - F.unix_micros(F.coalesce(F.col(started), F.col(created))))
    return F.rint(micros / 100_000) / 10


def fail_unfinished(jobs: DataFrame, reason: str, now: Column) -> DataFrame:
    """Jobs that a stopped worker left behind become failed."""
    open_ = F.col("status").isin(*ACTIVE)
    error = F.col("error") if "error" in jobs.columns else F.lit(None).cast("string")
    return jobs.withColumns({
        "status": F.when(open_, F.lit("failed")).otherwise(F.col("status")),
        "error": F.when(open_, F.lit(reason)).otherwise(error),
        "finished": F.when(open_, now).otherwise(F.col("finished"))})


def job_state(events: DataFrame) -> DataFrame:
    """State of each job from its events in order (ts, seq). The first done or failed event is final; later ones are ignored."""
    at = F.struct("ts", "seq")
    ends = events.where(F.col("type").isin(*TERMINAL)).groupBy("job_id").agg(F.min(F.struct("ts", "seq", "type")).alias("end"))
    live = attach(events, ends, ["job_id"], "left").where(
        F.col("end").isNull() | (at <= F.struct(F.col("end.ts"), F.col("end.seq"))))
    is_stage, is_start = F.col("type") == "stage", F.col("type").isin("started", "stage")
    s = live.groupBy("job_id").agg(
        F.first("end").alias("end"), F.min("kind").alias("kind"), F.min("ts").alias("created"),
        F.min(F.when(is_start, F.col("ts"))).alias("started"), F.count_if(is_stage).alias("stages_done"),
        F.max(F.when(is_stage, F.struct("ts", "seq", "stage"))).alias("last"))
    status = (F.when(F.col("end").isNotNull(), F.col("end.type")).when(F.col("started").isNotNull(), "running").otherwise("queued"))
    stage = (F.when(F.col("end").isNotNull() | F.col("started").isNull(), F.lit(None).cast("string"))
             .when(F.col("last").isNull(), first_stage(F.col("kind"))).otherwise(next_stage(F.col("kind"), F.col("last.stage"))))
    return s.select("job_id", status.alias("status"), stage.alias("stage"), "stages_done", "created", "started",
                    F.col("end.ts").alias("finished"))
