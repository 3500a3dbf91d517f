"""Skew-safe building blocks: size-checked joins, exact quantiles, ranks and running sums.

Every helper here has two ways: a cheap one, taken only after the size that makes it safe was measured, and a
distributed one that gives the same rows when one key holds a large share of the table.
"""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 200_000      # statistics rows are a handful of doubles, so this stays in the tens of MB
TASK_ROWS = 500_000           # rows that a task lays out and sorts several times over
GROUP_ROWS = 1_000_000        # largest group that may be sorted by, or held in, one task
SKETCH, LISTED = 131_072, 10_000   # counters of the sketch of frequent keys, and how many keys it lists
QUANTILE_ROWS = 500_000       # above this the built-in exact quantile, which keeps every distinct value, is the slower way

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's `spark.checkpoint.dir`, or a fresh one under /tmp in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that every executor can reach")
        if app not in _local_dirs:
            _local_dirs[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        root = _local_dirs[app]
    return f"{root.rstrip('/')}/scenelake/{app}"


def new_table_path(spark: SparkSession, name: str = "t") -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "t", **metrics: Column) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    This cuts the lineage so that it survives lost executors, stops a statistic from being recomputed by each
    consumer, and gives the optimiser the real size of the table. The row count and any further `metrics` are observed
    during the write and cost no job of their own; see `settled`. Files of pixels pack very well, so a small file may hold millions of
    rows: a table of more than BROADCAST_ROWS is never broadcast for the size of its files.
    """
    path = new_table_path(df.sparkSession, name)
    seen = Observation()
    extra = [m.alias(k) for k, m in metrics.items()]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *extra).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    got = seen.get
    if got["rows"] > BROADCAST_ROWS:
        out = out.hint("merge")
    out._settled = got
    return out


def settled(df: DataFrame) -> dict | None:
    """What was observed while a table was settled (`rows` and named metrics), or None for any other DataFrame."""
    return getattr(df, "_settled", None)


def attach(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
           broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = GROUP_ROWS) -> DataFrame:
    """Join per-key statistics back to the rows they were taken from.

    `small` holds one row per key. It is written once and counted while it is written: up to `broadcast_rows` it is broadcast, so the big
    side is not shuffled at all; beyond that the two are joined as in `skew_join`.
    """
    small = small if settled(small) else settle(small, "stats")
    if settled(small)["rows"] <= broadcast_rows:
        return big.join(F.broadcast(small), on, how)
    return skew_join(big, small, on, how, hot_rows)


def dealt(df: DataFrame, on: list[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """`df` laid out by `on` over as many tasks as its row count asks for, so that what one task sorts or holds doesn't grow with the table."""
    return df.repartition(max(-(-df.count() // task_rows), df.sparkSession.sparkContext.defaultParallelism), *on)


def key_hash(on: list[str]) -> Column:
    return F.xxhash64(*on)


def hot_metric(on: list[str]) -> Column:
    """A mergeable sketch of the most frequent keys, to be observed while a table is written: it costs no pass and no shuffle of its own.

    Keys go in by their hash. Of SKETCH counters, every key with more than a 7/SKETCH share of the rows is sure to be listed.
    """
    return F.call_function("approx_top_k", key_hash(on), F.lit(LISTED), F.lit(SKETCH))


def hot_keys(sketch, hot_rows: int = GROUP_ROWS) -> dict[int, int]:
    """Hash and number of tasks of the keys that a sketch counts more than `hot_rows` times; at most LISTED of them."""
    return {item["item"]: -(-item["count"] // hot_rows) for item in sketch or [] if item["count"] > hot_rows}


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", hot_rows: int = GROUP_ROWS,
              counts: DataFrame | None = None, hot: dict[int, int] | None = None, row: str | None = None) -> DataFrame:
    """Equi join (inner, left, left_semi, left_anti) for two large tables of which `left` may repeat a key very often and `right` holds it once.

    The left side is written once, and a sketch of its frequent keys observed with it; a left side that `settle` wrote is only
    sketched by its keys. Keys above `hot_rows` are dealt out by row number over as many tasks as their count asks for, so
    that equal rows part as well, and the right side's row is copied to these. The list of them has LISTED rows at most and is broadcast. A null
    matches nothing: rows with one are left out or, where the join keeps them, dealt out likewise. Without hot keys and nulls this is a plain join.

    A caller may know more: `counts` (columns `on`, n; if settled also the metric `peak` = max n), or `hot` as by `hot_keys`, together
    with `row`, a column of `left` that numbers its rows and stays the same when a task is run again.
    """
    spark, null = left.sparkSession, F.lit(False)
    for c in on:
        null = null | F.col(c).isNull()
    keeps = how in ("left", "left_anti")
    nulls = keeps
    if counts is not None:
        if settled(counts) and (settled(counts)["peak"] or 0) <= hot_rows:
            return left.join(right, on, how)
        top = counts.where(F.col("n") > hot_rows).orderBy(F.desc("n")).limit(LISTED)
        hot = {r["h"]: -(-r["n"] // hot_rows) for r in top.select(key_hash(on).alias("h"), "n").collect()}
    elif hot is None:
        seen = settled(left)
        if not seen:
            left = settle(left, "left", hot=hot_metric(on), nulls=F.count_if(null))
            seen = settled(left)
            hot, nulls = hot_keys(seen["hot"], hot_rows), keeps and seen["nulls"] > hot_rows
        elif seen["rows"] <= hot_rows:
            return left.join(right, on, how)
        else:
            got = left.agg(hot_metric(on).alias("hot"), F.count_if(null).alias("nulls")).first()
            hot, nulls = hot_keys(got["hot"], hot_rows), keeps and got["nulls"] > hot_rows
    if not hot and not nulls:
        return left.join(right, on, how)
    if row is None and not settled(left):
        left = settle(left, "left")              # row numbers of a written table are the same in every attempt
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    listed = F.broadcast(spark.createDataFrame(list(hot.items()) or [(0, 1)], "_h long, _salts int"))
    numbered = left.withColumns({"_row": number, "_h": key_hash(on)}).join(listed, "_h", "left")
    salt = F.when(null, F.pmod("_row", F.lit(1 << 20))).otherwise(F.pmod("_row", F.coalesce("_salts", F.lit(1)))).cast("int")
    dealt = numbered.withColumn("_salt", salt).drop("_h", "_salts", "_row")
    if not keeps:
        dealt = dealt.where(~null)
    copies = right.withColumn("_h", key_hash(on)).join(listed, "_h", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
    return dealt.join(copies.drop("_h", "_salts"), [*on, "_salt"], how).drop("_salt")


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows in the fullest group; the count is combined map-side and only one number reaches the driver."""
    if not keys:
        return df.count()
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def prefix_sum(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Sum of `value` over the rows of the same key that come strictly earlier in a unique `order`.

    The table is range-partitioned by (key, order), so a hot key is cut into many ranges; the row numbers are frozen by
    writing them, and per-range totals give each range its offset.
    """
    cols = df.columns
    frozen = settle(
        df.withColumn("_v", value)
        .repartitionByRange(*[F.col(k) for k in keys], *order)
        .sortWithinPartitions(*[F.col(k) for k in keys], *order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright("_id", 33)), "sorted")
    by_key = [F.col(k) for k in keys] or [F.lit(0)]
    totals = frozen.groupBy(*keys, "_range").agg(F.sum("_v").alias("_t"))
    offsets = totals.select(
        *keys, "_range",
        F.coalesce(F.sum("_t").over(Window.partitionBy(*by_key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    within = Window.partitionBy(*keys, "_range").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    local = frozen.withColumn("_loc", F.coalesce(F.sum("_v").over(within), F.lit(0)))
    return attach(local, offsets, [*keys, "_range"]).select(*cols, (F.col("_off") + F.col("_loc")).alias(name))


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank",
           group_rows: int = GROUP_ROWS) -> DataFrame:
    """1-based position of each row in its group; a plain window while every group fits a task, ranges beyond that and always
    for one order of the whole table."""
    if keys and largest_group(df, keys) <= group_rows:
        w = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(*order)
        return df.withColumn(name, F.row_number().over(w).cast("bigint"))
    ranks = prefix_sum(df, keys, order, F.lit(1).cast("bigint"), name)
    return ranks.withColumn(name, F.col(name) + 1)


def quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float],
              group_rows: int = QUANTILE_ROWS, largest: int | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per key and one column per entry of `qs`.

    Groups up to `group_rows` use the built-in exact aggregate. Larger ones are narrowed first (see `_narrow`), so no
    task ever holds all values of a group. `largest` is the size of the fullest group where the caller knows a bound.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    plain = [F.percentile("_v", F.lit(p)).alias(n) for n, p in qs.items()]
    if (largest_group(rows, keys) if largest is None else largest) <= group_rows:
        return rows.groupBy(*keys).agg(*plain)
    rows = settle(rows, "values")                # read several times below
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = attach(rows, sizes, keys)
    cold = rows.where(F.col("_n") <= group_rows).groupBy(*keys).agg(*plain)
    hot = _narrow(rows.where(F.col("_n") > group_rows), keys, qs, group_rows)
    return cold.unionByName(hot)


def _narrow(rows: DataFrame, keys: list[str], qs: dict[str, float], group_rows: int) -> DataFrame:
    """Order statistics of big groups by repeated bracketing.

    A mergeable sketch gives 255 splitters per (key, quantile); the two splitters around the wanted rank bracket it, the
    rows below are only counted, and the rows inside go to the next round. Each round keeps about 1/60 of the rows and
    the loop ends when a bracket fits a task, where the two neighbours of the rank are read off exactly.
    """
    grid = [i / 256 for i in range(1, 256)]
    slack = 2
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("_q"), F.lit(float(p)).alias("_p")) for n, p in qs.items()]))
    cur = rows.select(*keys, "_v", "_n", names.alias("s")).select(
        *keys, "_v", "s._q", (F.col("s._p") * (F.col("_n") - 1)).alias("_pos"))
    group = [*keys, "_q"]
    while True:
        sketch = cur.groupBy(*group, "_pos").agg(
            F.count("*").alias("_m"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
            F.percentile_approx("_v", grid, 10_000).alias("_s"))
        cell = F.col("_pos") / F.col("_m") * 256
        low, high = (F.floor(cell) - slack).cast("int"), (F.ceil(cell) + slack).cast("int")
        bracket = sketch.select(
            *group, "_m",
            F.when(low < 1, F.col("_min")).otherwise(F.try_element_at("_s", low)).alias("_lo"),
            F.when(high > 255, F.col("_max")).otherwise(F.try_element_at("_s", high)).alias("_hi"))
        marked = attach(cur, bracket, group)
        below = marked.groupBy(*group).agg(F.count_if(F.col("_v") < F.col("_lo")).alias("_below"))
        inside = marked.where(F.col("_v").between(F.col("_lo"), F.col("_hi"))).drop("_m", "_lo", "_hi")
        before = cur.groupBy(*group).count().agg(F.max("count")).first()[0]
        cur = settle(attach(inside, below, group).select(*group, "_v", (F.col("_pos") - F.col("_below")).alias("_pos")), "bracket")
        after = cur.groupBy(*group, "_v").count()
        size = largest_group(after, group)
        if size <= group_rows or largest_group(cur, group) >= before:
            break
    # equal values were combined above, so a bracket of copies of one value is a single row here
    counts = cur.groupBy(*group, "_pos", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*group).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    steps = counts.withColumn("_end", upto)
    lo_k, hi_k = F.floor("_pos"), F.ceil("_pos")
    picked = steps.groupBy(*group, "_pos").agg(
        F.min(F.when(F.col("_end") > lo_k, F.col("_v"))).alias("_a"),
        F.min(F.when(F.col("_end") > hi_k, F.col("_v"))).alias("_b"))
    frac = F.col("_pos") - F.floor("_pos")
    value = picked.select(*group, (F.col("_a") + (F.col("_b") - F.col("_a")) * frac).alias("_x"))
    return value.groupBy(*keys).agg(*[F.max(F.when(F.col("_q") == n, F.col("_x"))).alias(n) for n in qs])


def sum_before(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str,
               group_rows: int = GROUP_ROWS) -> DataFrame:
    """`prefix_sum`, or a running window while every group of a keyed table fits a task."""
    if not keys or largest_group(df, keys) > group_rows:
        return prefix_sum(df, keys, order, value, name)
    w = (Window.partitionBy(*[F.col(k) for k in keys]).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))
