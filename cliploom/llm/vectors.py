"""Vectors as exact integers, for the operators on embeddings.

A component x becomes floor(1024 * x), exactly, whatever its size. If all components of a table are under
2**22 (:data:`NARROW`), int64 and double arithmetic hold every product and sum below without rounding: a squared distance of 64
components stays under 2**52. Otherwise NumPy arrays of Python integers are used, by the same code.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components under this (after scaling) take the fast way.
NARROW = 1 << 22
#: Bits of a limb, in which sums of large integers travel.
LIMB = 32
SCALE = 1024


def kept(df: DataFrame, vector_col: str, dim: int) -> Column:
    """True for rows whose vector has ``dim`` components, none null or not finite."""
    v = F.col(f"`{vector_col}`")
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(v) == dim) & F.forall(v, good), F.lit(False))


def limbs_of(rows: DataFrame) -> int:
    """How many limbs sums of the components of column ``v`` take; 1 if all are narrow."""
    top = rows.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()[0] or 0.0
    if top * SCALE < NARROW:
        return 1
    return 2 + (math.floor(math.log2(top)) + 11 + 40) // LIMB


def _whole(x: float) -> int:
    return math.floor(x * SCALE) if abs(x) < 2.0**52 else int(x) * SCALE


def integers(column: pa.Array, dim: int, wide: bool) -> np.ndarray:
    """An array of lists as a matrix of integers."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
    if wide:
        return np.frompyfunc(_whole, 1, 1)(x)
    return np.floor(x * SCALE).astype(np.int64)


def squares(x: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of e, exactly. Narrow products are whole numbers under 2**53, so doubles hold them."""
    if x.dtype == object:
        d = x[:, None, :] - e[None, :, :]
        return (d * d).sum(axis=2)
    xf, ef = x.astype(np.float64), e.astype(np.float64)
    return ((xf * xf).sum(axis=1)[:, None] - 2 * (xf @ ef.T) + (ef * ef).sum(axis=1)[None, :]).astype(np.int64)


def split(total: np.ndarray, limbs: int) -> list[list[int]]:
    """Integers as ``limbs`` lists of parts of LIMB bits, the last of which has the rest and the sign."""
    rest, out = [int(t) for t in total], []
    for _ in range(limbs - 1):
        out.append([t & ((1 << LIMB) - 1) for t in rest])
        rest = [t >> LIMB for t in rest]
    return [*out, rest]


def summed(rows: DataFrame, keys: list[str], dim: int, limbs: int) -> dict[tuple, tuple[int, list[int]]]:
    """Sums over partial sums (keys, n, s): {keys: (count, components)}. There must be few keys: it is a table for the driver."""
    sums = [F.sum(F.col("s")[k][i]) for k in range(limbs) for i in range(dim)]
    found = rows.groupBy(*keys).agg(F.sum("n"), F.array(*sums)).collect()
    k = len(keys)
    return {tuple(r[:k]): (r[k], [sum(r[k + 1][j * dim + i] << (LIMB * j) for j in range(limbs)) for i in range(dim)]) for r in found}


def matrix(rows: list[list[int]], dim: int, wide: bool) -> np.ndarray:
    """Lists of integers as a matrix of the right kind."""
    return np.array(rows, object if wide else np.int64).reshape(len(rows), dim)


def long_or_null(values) -> pa.Array:
    """Integers as long; those beyond it are null."""
    return pa.array([v if v < 1 << 63 else None for v in map(int, values)], pa.int64())


def rebatched(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows, from batches of any size."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            held.append(batch.slice(at, rows))
            if sum(b.num_rows for b in held) >= rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def total(column: str) -> Column:
    """The sum of a long column of numbers >= 0 as long; null if it is beyond long, or a number was."""
    exact = F.sum(F.col(column).cast("decimal(38,0)"))
    return F.when(F.count("*") == F.count(column), exact.try_cast("long"))
