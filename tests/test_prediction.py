"""Intra prediction of macroblocks and chroma, and pictures rebuilt from blocks, against scalar forms."""

import random

from pyspark.sql import functions as F
from test_recovery import scalar_intra

from reelspark.functions import intra
from reelspark.operators import prediction


def plane(above, left, corner, z):
    p = {(x, -1): v for x, v in enumerate(above)} | {(-1, y): v for y, v in enumerate(left)} | {(-1, -1): corner}
    half = z // 2
    h = sum((k + 1) * (p[half + k, -1] - p[half - 2 - k, -1]) for k in range(half))
    v = sum((k + 1) * (p[-1, half + k] - p[-1, half - 2 - k]) for k in range(half))
    scale = 5 if z == 16 else 34
    a, b, c = 16 * (p[-1, z - 1] + p[z - 1, -1]), (scale * h + 32) >> 6, (scale * v + 32) >> 6
    return [max(0, min(255, (a + b * (x - half + 1) + c * (y - half + 1) + 16) >> 5)) for y in range(z) for x in range(z)]


def mean(*sides):
    n = sum(map(len, sides))
    return (sum(map(sum, sides)) + n // 2) // n if n else 128


def scalar(name, above, left, corner, z):
    if name == "vertical":
        return above and above * z
    if name == "horizontal":
        return left and [v for v in left for _ in range(z)]
    if name == "plane":
        return plane(above, left, corner, z) if above and left else None
    if z == 16:
        return [mean(above or [], left or [])] * 256
    out = {}
    for qx in (0, 1):
        for qy in (0, 1):
            u, s = (above or [])[4 * qx : 4 * qx + 4], (left or [])[4 * qy : 4 * qy + 4]
            out[qx, qy] = mean(u, s) if qx == qy else mean(u or s) if qx else mean(s or u)
    return [out[x // 4, y // 4] for y in range(8) for x in range(8)]


def test_macroblocks_and_chroma_by_all_modes(spark):
    rng = random.Random(11)
    for z, names, by in ((16, intra.MODES_16, intra.predicted_16), (8, intra.MODES_CHROMA, intra.predicted_chroma)):
        side = lambda: rng.choice([None, [rng.randrange(256) for _ in range(z)], [rng.choice([0, 255]) for _ in range(z)]])  # noqa: E731, B023
        rows = [(m, a, s, rng.randrange(256) if a and s else None) for m in range(4) for _ in range(40) for a, s in [(side(), side())]] + [(4, [0] * z, [0] * z, 0), (None, [0] * z, [0] * z, 0)]
        df = spark.createDataFrame(rows, "mode int, above array<int>, side array<int>, corner int")
        got = df.select("*", by(F.col("mode"), F.col("above"), F.col("side"), F.col("corner")).alias("r")).collect()
        for r in got:
            assert r.r == (scalar(names[r["mode"]], r.above, r.side, r.corner, z) if r["mode"] in range(4) else None), (z, r)


def rebuild(blocks):
    """Over a whole picture of samples."""
    p, out = {}, {}
    for n, bx, by, mode, residual in sorted(blocks):
        x, y = 4 * bx, 4 * by
        above = [p.get((x + k, y - 1)) for k in range(8)]
        above = None if above[0] is None else above if above[4] is not None else above[:4] + [above[3]] * 4
        left = [p.get((x - 1, y + k)) for k in range(4)]
        block = scalar_intra(mode, above, None if left[0] is None else left, p.get((x - 1, y - 1))) if mode in range(9) and residual else None
        out[n] = block and [max(0, min(255, a + b)) for a, b in zip(block, residual, strict=True)]
        if block:
            p |= {(x + i % 4, y + i // 4): v for i, v in enumerate(out[n])}
    return out


def drawn(rng, wide, high):
    """Blocks of a picture of so many macroblocks in decoding order; now and then one is missing, or has no residual or an unknown mode."""
    inside = [(0, 0), (1, 0), (0, 1), (1, 1)]
    places = [(4 * mx + 2 * ax + cx, 4 * my + 2 * ay + cy) for my in range(high) for mx in range(wide) for ax, ay in inside for cx, cy in inside]
    residual = lambda: None if rng.random() < 0.02 else [rng.randrange(-60, 60) for _ in range(16)]
    return [(n, x, y, rng.choice([2, *range(10)]) if rng.random() < 0.7 else 2, residual()) for n, (x, y) in enumerate(places) if rng.random() > 0.03]


def test_pictures_rebuilt_block_by_block(spark):
    rng = random.Random(13)
    pictures = {k: drawn(rng, rng.randrange(1, 4), rng.randrange(1, 4)) for k in range(12)} | {None: drawn(rng, 1, 1)}
    rows = [(k, *b, "clash") for k, blocks in pictures.items() for b in blocks]
    rng.shuffle(rows)
    x = spark.createDataFrame(rows, "picture bigint, n bigint, across int, down int, mode int, residual array<int>, block string").repartition(7)
    got = {(r.picture, r.n): r.block for r in prediction.rebuilt(x).collect()}
    want = {(k, n): b for k, blocks in pictures.items() for n, b in rebuild(blocks).items()}
    assert got == want
    assert sum(b is not None for b in want.values()) > 300 < len(want)
    assert prediction.rebuilt(x.limit(0)).collect() == []
