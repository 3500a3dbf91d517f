"""Exact top-k search by inner product: tiled matrix products, a partial selection in each tile, and a merge tree.

Queries and candidates are dealt into tiles of bounded size. A cell of the grid (query tile x candidate tile) is one matrix
product; the k best of each of its rows leave the cell. Lists are merged first among neighbouring tiles, then in whole.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenelake.scale import settle, settled

from .catalog import query, table

QUERY_TILE, SHARD_TILE, FAN_IN = 4_096, 16_384, 32
BEST = "query_id long, vec_id long, score long, at long"


def quantised(col: str, steps: float = 64.0) -> Column:
    """floor(steps * x) of each component, or null where the vector is null or holds null or non-finite components."""
    x = F.col(col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == F.lit(float("inf"))))
    return F.when(x.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(F.lit(steps) * v.cast("double")).cast("long")))


def _matrix(vectors, width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors are filled with zeros, which leaves inner products as they are."""
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: by floating-point BLAS where every partial sum is an exact integer there, else as integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if top < 2 ** 53 else a @ b.T


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of the k largest of each row, ties to the smaller column; in no order. Masked ones are minimal."""
    m = scores.shape[1]
    if k >= m:
        return np.broadcast_to(np.arange(m), scores.shape)
    if np.abs(scores).max(initial=0) < 2 ** 62 // m:
        return np.argpartition(-(scores * m + np.arange(m - 1, -1, -1)), k - 1, axis=1)[:, :k]
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def _cell(k: int, rows: int = 512):
    def run(key, left, right):
        parts, at = [], key[1].as_py()
        if left.num_rows and right.num_rows:
            both = left.column("v"), right.column("cand")
            width = max(int(np.diff(c.combine_chunks().offsets.to_numpy()).max(initial=0)) for c in both)
            a, b = (_matrix(c, width) for c in both)
            qid, vid = left.column("vec_id").to_numpy(), right.column("cand_id").to_numpy()
            order = np.argsort(vid)
            vid, b = vid[order], b[order]
            for lo in range(0, len(a), rows):
                s = products(a[lo:lo + rows], b)
                own = qid[lo:lo + rows, None] == vid[None, :]
                pick = best(np.where(own, np.iinfo(np.int64).min // (4 * s.shape[1]), s), k)
                score, keep = np.take_along_axis(s, pick, 1), ~np.take_along_axis(own, pick, 1)
                q = np.broadcast_to(qid[lo:lo + rows, None], pick.shape)
                parts.append((q[keep], vid[pick][keep], score[keep]))
        q, v, s = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
        return pa.table({"query_id": q, "vec_id": v, "score": s, "at": np.full(len(q), at, np.int64)})
    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 20, query_tile: int = QUERY_TILE, shard_tile: int = SHARD_TILE) -> DataFrame:
    """query_id, rank, vec_id, score of the k best for every row of `vectors` (vec_id, v) that `queries` selects.

    A null `v` or vec_id takes no part. Of rows that share a vec_id the smallest vector counts, once. Vectors of different
    length meet over their common components. Ties go to the smaller vec_id; fewer than k others give fewer rows.
    """
    whole = settle(vectors.where("vec_id is not null and v is not null").groupBy("vec_id").agg(F.min("v").alias("v")), "vectors", wanted=F.count_if(queries))
    n, wanted = settled(whole)["rows"], settled(whole)["wanted"]
    across, down = max(1, -(-n // shard_tile)), max(1, -(-wanted // query_tile))
    tile = lambda m, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(m))
    others = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    left = whole.where(queries).select(tile(down, 1).alias("i"), others(across).alias("j"), "vec_id", "v")
    right = whole.select(others(down).alias("i"), tile(across, 2).alias("j"), F.col("vec_id").alias("cand_id"), F.col("v").alias("cand"))  # own names: one side would lose columns that both share
    lists = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_cell(k), BEST)
    order = [F.desc("score"), F.asc("vec_id")]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    while across > FAN_IN:
        across = -(-across // FAN_IN)
        lists = lists.withColumn("at", F.floor(F.col("at") / FAN_IN)).withColumn("rank", rank("query_id", "at")).where(F.col("rank") <= k).drop("rank")
    return lists.withColumn("rank", rank("query_id")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64.0::double * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from s qualify rank <= 20"""


@query("op2_exact_topk", SQL)
def op2_exact_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", quantised("embedding").alias("v"))
    return top_k(vectors, F.col("vec_id") % 20 == 0, 20)
