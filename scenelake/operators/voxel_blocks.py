"""Block-sparse voxel grids: neighbourhoods inside blocks that carry the margin they need.

A voxel goes to its own block and to those in whose margin it lies, 1.42 times at most for blocks of 16^3 and kernels of 3^3. A block is a bounded group,
so neighbours are looked up in a small dense table of row numbers, and features are gathered for the hits only. What a voxel's neighbours sum
up to needs no further shuffle, as all of them are in its block.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE = 16
VOXEL = ["batch", "x", "y", "z"]
BLOCK = ["_bx", "_by", "_bz"]


def reach(k: int) -> tuple[int, int]:
    """How far a kernel of size k looks back and ahead along an axis."""
    return (k - 1) // 2, k - 1 - (k - 1) // 2


def in_blocks(vox: DataFrame, k: int, side: int = SIDE) -> DataFrame:
    """Every voxel once for each block that needs it."""
    back, ahead = reach(k)
    blocks = lambda a: F.sequence(F.floor((F.col(a) - ahead) / side).cast("int"), F.floor((F.col(a) + back) / side).cast("int"))
    out = vox
    for a, b in zip("xyz", BLOCK):
        out = out.withColumn(b, F.explode(blocks(a)))
    return out


def _lookup(key, table: pa.Table, k: int, side: int):
    """Rows of the block's own voxels, and for each kernel cell the row found there or -1: an array (own voxels, k^3)."""
    back, ahead = (k - 1) // 2, k - 1 - (k - 1) // 2
    at = [table.column(a).to_numpy().astype(np.int64) - side * b.as_py() for a, b in zip("xyz", key[1:])]
    rows = np.full((side + k - 1,) * 3, -1, np.int64)
    rows[tuple(a + back for a in at)] = np.arange(table.num_rows)
    own = np.flatnonzero(np.logical_and.reduce([(a >= 0) & (a < side) for a in at]))
    steps = range(k)
    found = [rows[at[0][own] + i, at[1][own] + j, at[2][own] + m] for i in steps for j in steps for m in steps]
    return own, np.stack(found, 1)


def _pairs(k: int, side: int):
    def run(key, table):
        own, found = _lookup(key, table, k, side)
        row, cell = np.nonzero(found >= 0)
        mine = table.select(VOXEL).take(own[row])
        return mine.append_column("k", pa.array(cell, pa.int32())).append_column("nfeat", table.column("feat").take(found[row, cell]))
    return run


def _convolved(weights: np.ndarray, k: int, side: int, bias: float):
    def run(key, table):
        own, found = _lookup(key, table, k, side)
        feat = table.column("feat").combine_chunks()
        if weights.ndim == 1:
            x = np.nan_to_num(feat.to_numpy(zero_copy_only=False).astype(np.float64))
            out = (np.where(found >= 0, x[found], 0.0) * weights).sum(1) + bias
            return table.select(VOXEL).take(own).append_column("feat", pa.array(out))
        x = feat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)
        out = np.full((len(own), weights.shape[1]), bias)
        for cell in range(found.shape[1]):
            hit = found[:, cell] >= 0
            out[hit] += x[found[hit, cell]] @ weights[cell].T
        lists = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), weights.shape[1]).cast(pa.list_(pa.float64()))
        return table.select(VOXEL).take(own).append_column("feat", lists)
    return run


def _by_block(vox: DataFrame, k: int, side: int):
    return in_blocks(vox.select(*VOXEL, "feat"), k, side).groupBy("batch", *BLOCK)


def _kinds(vox: DataFrame) -> str:
    return ", ".join(f"{c} {vox.schema[c].dataType.simpleString()}" for c in VOXEL)


def voxel_neighbours(vox: DataFrame, k: int = 3, side: int = SIDE) -> DataFrame:
    """(voxel, kernel cell, neighbour's feature) for every active neighbour of the same batch; a voxel is its own neighbour in the middle cell.

    Cells count along z first. A voxel (batch, x, y, z) may come once only; positions may be negative, features of any type.
    """
    kind = vox.schema["feat"].dataType.simpleString()
    return _by_block(vox, k, side).applyInArrow(_pairs(k, side), f"{_kinds(vox)}, k int, nfeat {kind}")


def submanifold_aggregate(vox: DataFrame, weights: list, k: int = 3, bias: float = 0.0, side: int = SIDE) -> DataFrame:
    """out[p] = bias + sum over active neighbours of W[i] * in[p + offset_i]; k=1 is a map over voxels and needs no blocks.

    With scalar features `weights` is a list of k^3 numbers, and a null feature counts as 0. With array features each entry is a
    [c_out][c_in] matrix and the result is an array.
    """
    w = np.asarray(weights, np.float64)
    if k == 1:
        if w.ndim == 1:
            return vox.select(*VOXEL, (F.col("feat") * float(w[0]) + bias).alias("feat"))
        return vox.select(*VOXEL, F.array(*[_dot([float(v) for v in row]) + bias for row in w[0]]).alias("feat"))
    kind = "double" if w.ndim == 1 else "array<double>"
    return _by_block(vox, k, side).applyInArrow(_convolved(w, k, side, float(bias)), f"{_kinds(vox)}, feat {kind}")


def _dot(row: list[float]) -> Column:
    return F.aggregate(F.zip_with(F.array(*map(F.lit, row)), "feat", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
