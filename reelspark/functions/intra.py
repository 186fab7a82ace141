"""Intra prediction of H.264: 4 x 4 blocks by all nine modes, whole macroblocks and chroma by all four, as column expressions over the samples around a block."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The modes by their numbers.
MODES = ("vertical", "horizontal", "dc", "diagonal down left", "diagonal down right", "vertical right", "horizontal down", "vertical left", "horizontal up")
MODES_16 = ("vertical", "horizontal", "dc", "plane")
MODES_CHROMA = ("dc", "horizontal", "vertical", "plane")


def _taps(mode: int, x: int, y: int) -> tuple[int, ...]:
    """Places on the edge whose samples a directional mode takes the mean of: one, two, or three of which the middle one counts twice.

    The edge runs from the lowest sample of the left side (0) over the corner (4) to the last one above to the right (12).
    """
    up, left = (lambda k: 5 + k), (lambda k: 3 - k)
    three = lambda middle: (max(middle - 1, 0), middle, min(middle + 1, 12))
    if mode == 0:
        return (up(x),)
    if mode == 1:
        return (left(y),)
    if mode == 3:
        return three(up(x + y + 1))
    if mode == 4:
        return three(4 + x - y)
    if mode == 5:
        z, at = 2 * x - y, up(x - y // 2)
        return three(4 - y + 1) if z < -1 else three(4) if z == -1 else (at - 1, at) if z % 2 == 0 else three(at - 1)
    if mode == 6:
        z, at = 2 * y - x, left(y - x // 2)
        return three(4 + x - 1) if z < -1 else three(4) if z == -1 else (at, at + 1) if z % 2 == 0 else three(at + 1)
    if mode == 7:
        at = up(x + y // 2)
        return (at, at + 1) if y % 2 == 0 else three(at + 1)
    z, at = x + 2 * y, left(y + x // 2)
    return (0,) if z > 5 else (0, 0, 1) if z == 5 else (at - 1, at) if z % 2 == 0 else three(at - 1)


def _mean(edge: Column, taps: tuple[int, ...]) -> Column:
    s = [F.get(edge, F.lit(t)) for t in taps]
    return s[0] if len(s) == 1 else F.shiftright(s[0] + s[1] + 1, 1) if len(s) == 2 else F.shiftright(s[0] + 2 * s[1] + s[2] + 2, 2)


def _dc(above: Column, left: Column) -> Column:
    """The mean of the sides that are there, 128 without any."""
    total = lambda a: F.aggregate(F.slice(a, 1, 4), F.lit(0), lambda s, v: s + v)
    both = F.shiftright(total(above) + total(left) + 4, 3)
    return F.coalesce(both, F.shiftright(total(above) + 2, 2), F.shiftright(total(left) + 2, 2), F.lit(128))


def predicted(mode: Column, above: Column, left: Column, corner: Column) -> Column:
    """array<int> of 16 in raster order; null where the mode needs a side that is not there, or is none of the nine.

    above has eight samples, of which the last four repeat the fourth where nothing stands above to the right; left has four;
    a side that is not there is null.
    """
    edge = F.concat(F.reverse(F.coalesce(left, F.array_repeat(F.lit(None).cast("int"), 4))), F.array(corner), F.coalesce(above, F.array_repeat(F.lit(None).cast("int"), 8)))

    def blocks(e: Column) -> Column:
        out = F.when(mode == 2, F.array_repeat(_dc(above, left), 16))
        for m in (0, 1, 3, 4, 5, 6, 7, 8):
            out = out.when(mode == m, F.array(*[_mean(e, _taps(m, at % 4, at // 4)) for at in range(16)]))
        return out

    whole = F.get(F.transform(F.array(edge), blocks), F.lit(0))
    return F.get(F.transform(F.array(whole), lambda b: F.when(~F.exists(b, lambda v: v.isNull()), b)), F.lit(0))


def _once(value: Column, then) -> Column:
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _part(side: Column, start: int, size: int) -> Column:
    return F.aggregate(F.slice(side, start + 1, size), F.lit(0), lambda s, v: s + v)


def _slope(side: Column, corner: Column, size: int) -> Column:
    """The weighed differences of a side's samples about its middle; the corner stands before its first one."""
    at = lambda k: corner if k < 0 else F.get(side, F.lit(k))
    return sum(((k + 1) * (at(size // 2 + k) - at(size // 2 - 2 - k)) for k in range(size // 2)), F.lit(0))


def _plane(above: Column, left: Column, corner: Column, size: int) -> Column:
    scale, middle = (5, 7) if size == 16 else (34, 3)
    step = lambda side: F.shiftright(scale * _slope(side, corner, size) + 32, 6)
    terms = F.struct(step(above).alias("b"), step(left).alias("c"), (16 * (F.get(above, F.lit(size - 1)) + F.get(left, F.lit(size - 1))) + 16).alias("a"))
    clip = lambda v: F.greatest(F.least(v, F.lit(255)), F.lit(0))
    places = F.sequence(F.lit(0), F.lit(size * size - 1))
    return _once(terms, lambda t: F.when(t["a"].isNotNull() & t["b"].isNotNull(), F.transform(places, lambda i: clip(F.shiftright(t["a"] + t["b"] * (i % size - middle) + t["c"] * (F.floor(i / size).cast("int") - middle), 5)))))


def _copied(side: Column, size: int, down: bool) -> Column:
    places = F.sequence(F.lit(0), F.lit(size * size - 1))
    return F.when(side.isNotNull(), F.transform(places, lambda i: F.get(side, (i % size) if down else F.floor(i / size).cast("int"))))


def predicted_16(mode: Column, above: Column, left: Column, corner: Column) -> Column:
    """array<int> of 256 in raster order by one of MODES_16; null where the mode needs a side that is not there, or is none of the four.

    Sides have sixteen samples; a side that is not there is null.
    """
    u, l = _part(above, 0, 16), _part(left, 0, 16)
    mean = F.coalesce(F.shiftright(u + l + 16, 5), F.shiftright(u + 8, 4), F.shiftright(l + 8, 4), F.lit(128))
    return F.when(mode == 0, _copied(above, 16, True)).when(mode == 1, _copied(left, 16, False)).when(mode == 2, F.array_repeat(mean, 256)).when(mode == 3, _plane(above, left, corner, 16))


def predicted_chroma(mode: Column, above: Column, left: Column, corner: Column) -> Column:
    """array<int> of 64 in raster order by one of MODES_CHROMA, under the same terms as predicted_16; sides have eight samples.

    Each quarter has a mean of its own: of both sides on the diagonal, else of the side that it touches, if that is there.
    """
    u, l = [_part(above, k, 4) for k in (0, 4)], [_part(left, k, 4) for k in (0, 4)]
    one = lambda s: F.shiftright(s + 2, 2)
    both = lambda a, b: F.coalesce(F.shiftright(a + b + 4, 3), one(a), one(b), F.lit(128))
    means = F.array(both(u[0], l[0]), F.coalesce(one(u[1]), one(l[0]), F.lit(128)), F.coalesce(one(l[1]), one(u[0]), F.lit(128)), both(u[1], l[1]))
    places = F.sequence(F.lit(0), F.lit(63))
    quarters = _once(means, lambda m: F.transform(places, lambda i: F.get(m, (F.floor(i / 32) * 2 + F.floor(i % 8 / 4)).cast("int"))))
    return F.when(mode == 0, quarters).when(mode == 1, _copied(left, 8, False)).when(mode == 2, _copied(above, 8, True)).when(mode == 3, _plane(above, left, corner, 8))


#: The places on the edge of each mode's samples in raster order, but for the mean.
TAPS = {m: tuple(_taps(m, at % 4, at // 4) for at in range(16)) for m in (0, 1, 3, 4, 5, 6, 7, 8)}
