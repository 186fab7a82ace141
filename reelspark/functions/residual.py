"""Scaling and inverse transforms of H.264 residuals: columns of arrays, all blocks of a batch transformed at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from reelspark.functions.arrays import lists, matrix, numbers

# The scale of a coefficient at even places, at odd places, and elsewhere, by qp modulo 6; and the scanning order of a 4 x 4 block.
SCALES = ((10, 16, 13), (11, 18, 14), (13, 20, 16), (14, 23, 18), (16, 25, 20), (18, 29, 23))
ZIGZAG = (0, 1, 4, 8, 5, 2, 3, 6, 9, 12, 13, 10, 7, 11, 14, 15)
#: Residuals beyond these bounds are no result of an encoder.
BOUNDS = (-512, 511)


_SCALES = np.array(SCALES)
#: Of each place in raster order: where it stands in scanning order, and its kind (0 even, 1 odd, 2 elsewhere).
_SCAN = np.array([ZIGZAG.index(at) for at in range(16)])
_KINDS = np.array([0 if not (at // 4 % 2 or at % 4 % 2) else 1 if at // 4 % 2 and at % 4 % 2 else 2 for at in range(16)])


def _blocks(levels: pa.ListArray, qp: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first n levels, the qp, and whether all of them are there."""
    v, there = matrix(levels, n)
    q, known = numbers(qp)
    known &= q >= 0
    return v, np.where(known, q, 0), there.all(axis=1) & known


def _across(block: np.ndarray, step) -> np.ndarray:
    """A step over each line, then over each column, of blocks of 4 x 4."""
    rows = np.stack(step(*(block[:, :, k] for k in range(4))), axis=2)
    return np.stack(step(*(rows[:, k, :] for k in range(4))), axis=1).reshape(-1, 16)


def _butterfly(a, b, c, d):
    even, odd = a + c, a - c
    low, high = (b >> 1) - d, b + (d >> 1)
    return [even + high, odd + low, odd - low, even - high]


def _hadamard(a, b, c, d):
    return [a + b + c + d, a + b - c - d, a - b - c + d, a - b + c - d]


ROWS = [[4 * r + c for c in range(4)] for r in range(4)]
COLUMNS = [[4 * r + c for r in range(4)] for c in range(4)]


def _inverse(levels: pa.Array, qp: pa.Array, dc_scaled: pa.Array) -> pa.Array:
    v, q, there = _blocks(levels, qp, 16)
    scale = _SCALES[q % 6][:, _KINDS] << (q // 6)[:, None]
    scale[pc.fill_null(dc_scaled, False).to_numpy(zero_copy_only=False), 0] = 1
    r = (_across((v[:, _SCAN] * scale).reshape(-1, 4, 4), _butterfly) + 32) >> 6
    there &= ((r >= BOUNDS[0]) & (r <= BOUNDS[1])).all(axis=1)
    return lists(np.where(there[:, None], r, 0), pa.int32(), none=~there)


def _luma_dc(levels: pa.Array, qp: pa.Array) -> pa.Array:
    v, q, there = _blocks(levels, qp, 16)
    f = _across(v[:, _SCAN].reshape(-1, 4, 4), _hadamard) * _SCALES[q % 6, 0][:, None]
    six = (q // 6)[:, None]
    small = (f + (1 << np.maximum(1 - six, 0))) >> np.maximum(2 - six, 0)
    return lists(np.where(six >= 2, f << np.maximum(six - 2, 0), small), pa.int32(), empty=~there)


def _chroma_dc(levels: pa.Array, qp: pa.Array) -> pa.Array:
    v, q, there = _blocks(levels, qp, 4)
    a, b, c, d = v.T
    out = np.stack([a + b + c + d, a - b + c - d, a + b - c - d, a - b - c + d], axis=1)
    return lists(((out * _SCALES[q % 6, 0][:, None]) << (q // 6)[:, None]) >> 1, pa.int32(), empty=~there)


_NUMBERS = ArrayType(IntegerType())
_INVERSE, _LUMA, _CHROMA = (F.arrow_udf(f, _NUMBERS) for f in (_inverse, _luma_dc, _chroma_dc))


def inverse(levels: Column, qp: Column, dc_scaled: Column) -> Column:
    """array<int>: the residual of a 4 x 4 block in raster order, from levels in scanning order; null if one is out of BOUNDS. A first level that is scaled already stays."""
    return _INVERSE(levels, qp, dc_scaled)


def luma_dc(levels: Column, qp: Column) -> Column:
    """array<int> of 16: the scaled DC values of a macroblock's blocks in raster order, from levels in scanning order."""
    return _LUMA(levels, qp)


def chroma_dc(levels: Column, qp: Column) -> Column:
    """array<int> of 4: the scaled DC values of a chroma plane's blocks."""
    return _CHROMA(levels, qp)
