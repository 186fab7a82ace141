"""Pictures rebuilt from intra-predicted blocks: each block is predicted from the rebuilt blocks around it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from reelspark.functions.intra import TAPS
from reelspark.operators.references import Step, in_order


def _predicted(mode: int | None, above: list | None, left: list | None, corner: int | None) -> list[int] | None:
    if mode == 2:
        sides = [v for side in (above and above[:4], left) if side for v in side]
        return [(sum(sides) + len(sides) // 2) // len(sides) if sides else 128] * 16
    if mode not in TAPS:
        return None
    edge = [*(left[::-1] if left else [None] * 4), corner, *(above or [None] * 8)]
    seen = [[edge[t] for t in taps] for taps in TAPS[mode]]
    if any(v is None for s in seen for v in s):
        return None
    return [s[0] if len(s) == 1 else (s[0] + s[1] + 1) >> 1 if len(s) == 2 else (s[0] + 2 * s[1] + s[2] + 2) >> 2 for s in seen]


def _rebuilding() -> Step:
    """State of a picture: the rebuilt blocks of its current row of macroblocks, and the lowest ones of the row above."""
    held: dict[tuple[int, int], list[int]] = {}
    row_of = 0

    def step(row: tuple | None) -> list[tuple]:
        nonlocal held, row_of
        if row is None:
            return []
        picture, n, across, down, mode, residual = row
        if down // 4 != row_of:
            row_of = down // 4
            held = {k: v for k, v in held.items() if k[1] >= 4 * row_of - 1}
        up, side, diagonal = held.get((across, down - 1)), held.get((across - 1, down)), held.get((across - 1, down - 1))
        right = held.get((across + 1, down - 1))
        above = up and up[12:] + (right[12:] if right else up[15:] * 4)
        block = _predicted(mode, above, side and side[3::4], diagonal and diagonal[15]) if residual is not None else None
        if block is not None:
            block = held[across, down] = [min(max(p + r, 0), 255) for p, r in zip(block, residual, strict=True)]
        return [(picture, n, across, down, block)]

    return step


def rebuilt(blocks: DataFrame) -> DataFrame:
    """(picture, n, across, down, block): the 16 samples in raster order of each 4 x 4 block of blocks (picture, n, across, down, mode, residual: array<int> of 16).

    n is the order of decoding, macroblock rows (four rows of blocks) from above to below: a block takes the samples of those
    before it that stand to its left, above, and above to the right, where the last sample above is repeated while nothing stands there.
    A block that cannot be predicted (a side that its mode needs is not there, no such mode, a null residual) is null and
    stands there for no other. Pictures are dealt over tasks; a task holds two rows of one picture's blocks. Pictures with a
    null number are one; other columns are not carried.
    """
    schema = "picture bigint, n bigint, across int, down int, block array<int>"
    return in_order(blocks, ["picture"], ["n"], ["picture", "n", "across", "down", "mode", "residual"], _rebuilding, schema)
