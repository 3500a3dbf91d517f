"""Streams of small event files."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scenelake.operators import jobs as J
from scenelake.streaming import jobs as ST

SCHEMA = "job_id bigint, seq bigint, ts timestamp, type string, stage string, kind string, time_s double, model string, gen_s double, gpu_peak_gb double"


def events(spark, rows):
    base = pd.Timestamp("2024-01-01")
    return spark.createDataFrame([(j, s, (base + pd.Timedelta(seconds=t)).to_pydatetime(), ty, st, "floor", 1.0, "m", None, 2.5) for j, s, t, ty, st in rows], SCHEMA)


def feed(spark, folder, batches):
    for i, rows in enumerate(batches):
        events(spark, rows).coalesce(1).write.parquet(str(folder / f"in/{i:02d}"))
    return (spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1)
            .option("pathGlobFilter", "*.parquet").parquet(str(folder / "in")))


BATCHES = [
    [(1, 0, 0, "created", None), (2, 1, 0, "created", None), (3, 2, 1, "created", None)],
    [(1, 3, 5, "started", None), (1, 4, 9, "stage", "segmentation"), (2, 5, 6, "started", None)],
    [(1, 6, 12, "stage", "illumination"), (2, 7, 13, "failed", None)],
    [(2, 8, 20, "started", None), (2, 9, 21, "done", None), (1, 10, 30, "stage", "render"), (1, 11, 31, "done", None)],
]


def test_state_machine_over_micro_batches(spark, tmp_path):
    stream = feed(spark, tmp_path, BATCHES)
    ST.run_available(ST.job_state_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"), "update")
    log = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))
    one = [(r.status, r.stage, r.stages_done) for r in log.where("job_id = 1").orderBy("batch").collect()]
    assert one == [("queued", None, 0), ("running", "geometry", 1), ("running", "render", 2), ("done", None, 3)]
    got = ST.latest_states(spark, str(tmp_path / "out")).drop("error").orderBy("job_id").collect()
    want = J.job_state(events(spark, sum(BATCHES, []))).orderBy("job_id").collect()
    assert got == want and got[1].status == "failed" and got[1].finished.second == 13 and got[2].status == "queued"


def test_idle_jobs_fail(spark, tmp_path):
    late = [[(1, 0, 0, "started", None)], [(2, 1, 7200, "started", None)], [(2, 2, 7300, "stage", "segmentation")], [(2, 3, 7400, "done", None)]]
    stream = feed(spark, tmp_path, late).withWatermark("ts", "1 minute")
    ST.run_available(ST.job_state_stream(stream, "1 hour", "stopped"), str(tmp_path / "out"), str(tmp_path / "cp"), "update")
    got = {r.job_id: (r.status, r.error) for r in ST.latest_states(spark, str(tmp_path / "out")).collect()}
    assert got == {1: ("failed", "stopped"), 2: ("done", None)}


def test_any_order_of_files_gives_the_batch_row(spark, tmp_path):
    want = J.job_state(events(spark, sum(BATCHES, []))).orderBy("job_id").collect()
    for k, order in enumerate(([3, 2, 1, 0], [1, 3, 0, 2])):
        stream = feed(spark, tmp_path / str(k), [BATCHES[i] for i in order])
        ST.run_available(ST.job_state_stream(stream), str(tmp_path / f"out{k}"), str(tmp_path / f"cp{k}"), "update")
        assert ST.latest_states(spark, str(tmp_path / f"out{k}")).drop("error").orderBy("job_id").collect() == want


def test_stage_log_drops_repeats_and_keeps_late_rows(spark, tmp_path):
    twice, late = BATCHES[1] + BATCHES[1], [(9, 1, -10**7, "stage", "render")]
    stream = feed(spark, tmp_path, [twice, BATCHES[1], BATCHES[2], late])
    ST.stage_log(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.job_id, r.seq) for r in rows.collect()) == [(1, 4), (1, 6), (9, 1)]
    assert set(ST.STAGE_FIELDS) <= set(rows.columns)


def test_repeated_micro_batch_changes_nothing(spark, tmp_path):
    ST.stage_log(feed(spark, tmp_path, BATCHES), str(tmp_path / "out"), str(tmp_path / "cp1"))
    again = (spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    ST.stage_log(again, str(tmp_path / "out"), str(tmp_path / "cp2"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_cache_stream_computes_once(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "text string, n int").coalesce(1).write.parquet(str(tmp_path / "in/0"))
    spark.createDataFrame([("b", 2), ("c", 3)], "text string, n int").coalesce(1).write.parquet(str(tmp_path / "in/1"))
    src = (spark.readStream.schema("text string, n int").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    ST.cache_fill_stream(src, str(tmp_path / "cache"), F.col("text"), lambda m: m.select("cache_key", "n"), str(tmp_path / "cp"), "cache_key string, n int", "s")
    rows = spark.read.parquet(str(tmp_path / "cache")).select("cache_key", "n").collect()
    assert sorted(map(tuple, rows)) == [("a", 1), ("b", 2), ("c", 3)]


@pytest.mark.parametrize("files", [0, 3])
def test_documents_in_one_file_or_a_folder(spark, tmp_path, files):
    from scenelake.plans.queries import QUERIES
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(50)
    if files:
        docs.repartition(files).write.parquet(f"{tmp_path}/documents.parquet")
    else:
        docs.toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["m4_cache_fill_stream"](spark, str(tmp_path)).count() == docs.select("text").distinct().count()


def test_state_step_needs_no_package_on_workers(tmp_path):
    """The function of the state runs where this package isn't installed, and on plain lists: a call sees few events."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    class Events:
        def groupBy(self, *_):
            return self

        def applyInPandasWithState(self, step, *_):
            return step
    (tmp_path / "step").write_bytes(cloudpickle.dumps(ST.job_state_stream(Events())))
    code = """if 1:
        import pickle, pandas as pd
        class State:
            exists, hasTimedOut, get = False, False, None
            def update(self, v): self.get, self.exists = v, True
        step, state, t = pickle.load(open("step", "rb")), State(), pd.Timestamp("2024-01-01")
        for types in (["stage", "started"], ["done", "stage"]):
            rows = pd.DataFrame({"ts": [t, t], "seq": [1, 2], "type": types, "kind": "floor", "stage": ["render", None]})
            out = list(step((7,), iter([rows]), state))[0].iloc[0]
        print(out.status, out.stages_done)"""
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=60)
    assert run.stdout.split() == ["done", "1"], run.stderr
