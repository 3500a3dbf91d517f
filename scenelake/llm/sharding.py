"""Two-pass external shuffle: scatter by seeded hashes into memory-sized buckets, then Fisher-Yates in each bucket.

A shard is the concatenation of its buckets. The shard of a row depends on its id and the number of shards only (a jump
consistent hash), so one more shard takes rows only into itself.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scenelake.scale import attach, new_table_path

from .catalog import query, table

BUCKET_BYTES = 32 << 20


def jump(keys: np.ndarray, n: int) -> np.ndarray:
    """Jump consistent hash (Lamping and Veach, 2014) of 64-bit keys into n shards."""
    key, b, j = keys.astype(np.uint64), np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    with np.errstate(over="ignore"):
        while (on := j < n).any():
            b[on] = j[on]
            key[on] = key[on] * np.uint64(2862933555777941757) + np.uint64(1)
            j[on] = ((b[on] + 1) * (float(1 << 31) / ((key[on] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
    return b.astype(np.int32)


def shard_of(n: int, seed: int):
    @F.pandas_udf("int")
    def pick(key):
        import pandas as pd
        return pd.Series(jump(key.to_numpy().view(np.uint64), n))
    return pick(F.xxhash64(F.lit(seed), F.col("doc_id")))


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    order, picks = np.arange(n), rng.integers(0, np.arange(n, 1, -1)) if n > 1 else ()
    for i, j in zip(range(n - 1, 0, -1), picks):
        order[i], order[j] = order[j], order[i]
    return order


def _shuffler(schema, seed: int, bucket_bytes: int):
    """Rows come ordered by bucket and in it by a seeded hash. A bucket above its size, as repeated rows or very long texts can
    make it, is shuffled piece by piece; a piece is then a random part of the bucket."""
    def run(batches):
        held, at, piece, size = [], None, 0, 0

        def flush():
            rows = pa.Table.from_batches(held).combine_chunks()
            order = fisher_yates(rows.num_rows, np.random.default_rng([seed, *at, piece]))
            rows = rows.take(pa.array(order))
            n = rows.num_rows
            rows = rows.append_column("__piece", pa.array(np.full(n, piece, np.int32))).append_column("__pos", pa.array(np.arange(n, dtype=np.int64)))
            return rows.cast(schema).to_batches()
        for b in batches:
            keys = np.stack([b.column("shard").to_numpy(), b.column("__sub").to_numpy()], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                now = tuple(keys[lo].tolist())
                if now != at:
                    if held:
                        yield from flush()
                    held, at, piece, size = [], now, 0, 0
                elif size > bucket_bytes:
                    yield from flush()
                    held, piece, size = [], piece + 1, 0
                held.append(b.slice(lo, hi - lo))
                size += b.nbytes * (hi - lo) // b.num_rows
        if held:
            yield from flush()
    return run


def two_pass_shuffle(docs: DataFrame, shards: int = 40, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes `docs` in shuffled order, one folder a shard, and returns the written rows with `shard` and `slot` (from 0).

    Only column names `shard` and `slot` are taken; columns of `docs` with these names must be renamed first. Null ids
    share one shard, null texts count no bytes. Rows that agree in id and text share a bucket; a bucket above its size is
    shuffled in pieces, so memory stays bounded. An empty table gives no rows. The same rows give the same order again.
    """
    total = docs.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    subs = max(1, -(-2 * total // (shards * bucket_bytes)))       # half the size on average, so few buckets exceed it
    sub = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("text")), F.lit(subs)).cast("int")
    put = docs.withColumns({"shard": shard_of(shards, seed), "__sub": sub}).repartition("shard", "__sub")
    put = put.sortWithinPartitions("shard", "__sub", F.xxhash64(F.lit(seed + 2), F.col("doc_id"), F.col("text")), "doc_id", "text")
    schema = T.StructType([*put.schema.fields, T.StructField("__piece", T.IntegerType()), T.StructField("__pos", T.LongType())])
    path = new_table_path(docs.sparkSession, "shards")
    put.mapInArrow(_shuffler(to_arrow_schema(schema), seed, bucket_bytes), schema).write.partitionBy("shard").parquet(path)
    rows = docs.sparkSession.read.schema(schema).parquet(path)
    part = ["shard", "__sub", "__piece"]
    ahead = F.sum("n").over(Window.partitionBy("shard").orderBy("__sub", "__piece").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy(*part).agg(F.count("*").alias("n")).select(*part, F.coalesce(ahead, F.lit(0)).alias("__start"))
    return attach(rows, starts, part).select(*docs.columns, "shard", (F.col("__start") + F.col("__pos")).alias("slot"))


@query("op6_shard_two_pass")
def op6_shard_two_pass(spark, sf_dir):
    rows = two_pass_shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    bytes_ = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return rows.select("doc_id", (F.octet_length(bytes_) + 16).cast("long").alias("size"), F.crc32(bytes_).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", shard_of(41, 17).alias("grown_shard"))
