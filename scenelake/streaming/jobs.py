"""Job progress as a stream: exact state machine, stage log and cache filling."""

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import STAGE_AFTER, STAGE_ORDER
from ..sources.runs import RENAMED_STAGES
from ..sources.sinks import compute_missing

FACTS = """kind string, created timestamp, start_ts timestamp, start_seq bigint, end_ts timestamp, end_seq bigint, end_type string,
    stage_us array<bigint>, stage_seq array<bigint>, stage array<string>, stopped timestamp"""
OUTPUT = """job_id bigint, status string, stage string, stages_done bigint, created timestamp, started timestamp, finished timestamp,
    error string"""
BUCKETS = 64                                      # folders by key in a sink, so that a micro-batch reads those of its own keys
STAGE_FIELDS = ("stage", "model", "time_s", "gen_s", "gpu_peak_gb")      # fixed values: the public fields of a finished stage


def event_stream(spark: SparkSession, path: str, glob: str = "*.parquet", files_per_trigger: int = 1000) -> DataFrame:
    """Stream of the files of a folder; `files_per_trigger` bounds the events of a micro-batch."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(path).schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def job_state_stream(events: DataFrame, idle_timeout: str | None = None, reason: str = "no progress") -> DataFrame:
    """State of each job after each micro-batch that has events for it.

    The state is a set of facts that are merged by comparison: the earliest event, the earliest start, the earliest end and
    the stages not later than that end. So the last row of a job is the same in whatever files and order its events
    arrive, and equals the batch result. What is kept of a job grows with its stages only. With `idle_timeout` (for example
    "1 hour" of event time) a job that stays open is failed with `reason`, and that is final; the stream then needs a
    watermark on ts.
    """
    millis = int(pd.Timedelta(idle_timeout).total_seconds() * 1000) if idle_timeout else None
    firsts, following, renamed = {k: v[0] for k, v in STAGE_ORDER.items()}, STAGE_AFTER, RENAMED_STAGES

    epoch, micro = datetime(1970, 1, 1), timedelta(microseconds=1)

    # A call sees a handful of events of one job, so plain lists are used here: a pandas expression costs more than they do.
    def earliest(ts: list, seq: list, kinds: list, wanted: tuple, old: tuple) -> tuple:
        """The smaller of `old` (ts, seq, ...) and the first event of the wanted types by (ts, seq); `old` starts with None if there is none."""
        new = min(((t, q, k) for t, q, k in zip(ts, seq, kinds) if k in wanted and t is not None), default=None)
        if new is None:
            return old
        return new[:len(old)] if old[0] is None or new[:2] < old[:2] else old

    def merge(rows: pd.DataFrame, f: dict) -> None:
        us, known = rows["ts"].to_numpy("datetime64[us]").astype(np.int64).tolist(), rows["ts"].notna().tolist()
        ts = [epoch + t * micro if ok else None for t, ok in zip(us, known)]
        seq, types = rows["seq"].tolist(), rows["type"].tolist()
        kind = min((k for k in rows["kind"].tolist() if isinstance(k, str)), default=None)
        if kind is not None and (f["kind"] is None or kind < f["kind"]):
            f["kind"] = kind
        low = min((t for t in ts if t is not None), default=None)
        if low is not None:
            f["created"] = low if f["created"] is None else min(low, f["created"])
        f["start"] = earliest(ts, seq, types, ("started", "stage"), f["start"])
        f["end"] = earliest(ts, seq, types, ("done", "failed"), f["end"])
        f["stages"] += [(t, q, n) for t, q, k, n in zip(us, seq, types, rows["stage"].tolist()) if k == "stage"]
        if f["end"][0] is not None:
            end = ((f["end"][0] - epoch) // micro, f["end"][1])
            f["stages"] = [s for s in f["stages"] if s[:2] <= end]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kind, created, s_ts, s_seq, e_ts, e_seq, e_type, us, seq, stage, stopped = state.get if state.exists else (None,) * 7 + ([], [], [], None)
        f = {"kind": kind, "created": created, "start": (s_ts, s_seq), "end": (e_ts, e_seq, e_type), "stages": list(zip(us, seq, stage))}
        latest = None
        if state.hasTimedOut:
            if f["end"][0] is None:
                stopped = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms").to_pydatetime()
        else:
            for rows in batches:
                if stopped is None:
                    merge(rows, f)
                if millis:
                    latest = rows["ts"].max() if latest is None else max(latest, rows["ts"].max())
        ended, started = f["end"][0] is not None, f["start"][0]
        if started is not None and ended and f["start"] > f["end"][:2]:
            started = None
        running = started is not None and not ended and stopped is None
        now = None
        if running:
            now = firsts.get(f["kind"])
            if f["stages"]:
                name = max(enumerate(f["stages"]), key=lambda s: (*s[1][:2], s[0]))[1][2]
                now = following.get((f["kind"], renamed.get(name, name)))
        status = "failed" if stopped is not None else f["end"][2] if ended else "running" if running else "queued"
        if millis and not ended and stopped is None and latest is not None:
            state.setTimeoutTimestamp(int(latest.timestamp() * 1000) + millis)
        state.update((f["kind"], f["created"], *f["start"], *f["end"], *([s[i] for s in f["stages"]] for i in range(3)), stopped))
        yield pd.DataFrame([(key[0], status, now, len(f["stages"]), f["created"], started, stopped or f["end"][0], reason if stopped is not None else None)],
                           columns=["job_id", "status", "stage", "stages_done", "created", "started", "finished", "error"])
    timeout = GroupStateTimeout.EventTimeTimeout if millis else GroupStateTimeout.NoTimeout
    return events.groupBy("job_id").applyInPandasWithState(step, OUTPUT, FACTS, "update", timeout)


def stage_log(events: DataFrame, sink: str, checkpoint: str) -> None:
    """Append finished stages with their public fields to `sink`, one row a (job, seq), however late or often it arrives.

    A micro-batch reads only the folders of the sink that can hold its keys, and replaces its own folder when repeated.
    """
    rows = events.where("type = 'stage'").select("job_id", "seq", "ts", *STAGE_FIELDS)

    def write(batch: DataFrame, batch_id: int) -> None:
        keyed = batch.dropDuplicates(["job_id", "seq"]).withColumn("bucket", F.pmod(F.xxhash64("job_id", "seq"), F.lit(BUCKETS)).cast("int"))
        known = others_in_buckets(keyed, sink, batch_id)
        fresh = keyed if known is None else keyed.join(known.select("job_id", "seq"), ["job_id", "seq"], "left_anti")
        fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{sink}/batch={batch_id}")
    rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def others_in_buckets(keyed: DataFrame, sink: str, batch) -> DataFrame | None:
    """Rows of `sink` that other micro-batches wrote to the buckets of `keyed`; None while the sink is empty."""
    spark = keyed.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sink)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    mine = [r.bucket for r in keyed.select("bucket").distinct().collect()]               # at most BUCKETS numbers
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields)
    rows = spark.read.schema(f"{schema}, batch string").option("basePath", sink).parquet(sink)
    return rows.where(F.col("bucket").isin(mine) & (F.col("batch") != str(batch)))


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop. Each micro-batch replaces its own folder, so a repeated batch changes nothing."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start())
    q.awaitTermination()


def latest_states(spark: SparkSession, sink: str) -> DataFrame:
    """Last state of each job over all micro-batches."""
    rows = spark.read.option("basePath", sink).parquet(sink)
    cols = [c for c in rows.columns if c not in ("job_id", "batch")]
    last = rows.groupBy("job_id").agg(F.max_by(F.struct(*cols), "batch").alias("s"))
    return last.select("job_id", "s.*")


def cache_fill_stream(assets: DataFrame, cache: str, key: Column, compute: Callable[[DataFrame], DataFrame], checkpoint: str,
                      cache_schema: str, name: str) -> None:
    """Compute what the cache lacks for newly arrived assets and append it, once per key.

    Each micro-batch of the stream called `name` owns one folder of the cache. What an earlier attempt at the same
    micro-batch left there does not count as known and is replaced. Only folders that can hold keys of the micro-batch are
    read; columns are those of `cache_schema`.
    """
    bucket = F.pmod(F.xxhash64("cache_key"), F.lit(BUCKETS)).cast("int")

    def fill(batch: DataFrame, batch_id: int) -> None:
        part = f"{name}-{batch_id}"
        keyed = batch.withColumn("cache_key", key)
        empty = batch.sparkSession.createDataFrame([], cache_schema).withColumn("bucket", bucket)
        mine = keyed.select(bucket.alias("bucket")).distinct()
        known = others_in_buckets(empty.unionByName(mine, allowMissingColumns=True), cache, part)
        fresh = compute_missing(keyed, empty if known is None else known, compute, empty.columns[:-1])
        fresh.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{cache}/batch={part}")
    q = assets.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(fill).start()
    q.awaitTermination()
