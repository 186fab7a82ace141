"""Bounded output, missing frames, activation, configurations, latch, rollback, disposal and transforms against plain computations."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from reelspark.functions import residual
from reelspark.operators import recovery, references
from reelspark.sources import files


def bumped(pictures, size):
    """(n, shown_at, shown_no) of one stream's pictures (n, poc, idr) in order."""
    waiting, out, no = [], [], 0
    for n, poc, idr in pictures:
        if idr:
            for _, p in sorted(waiting):
                out.append((p, None, no))
                no += 1
            waiting, no = [], 0
        waiting.append((poc, n))
        while len(waiting) > size:
            waiting.sort()
            out.append((waiting.pop(0)[1], n, no))
            no += 1
    return out + [(p, None, no + k) for k, (_, p) in enumerate(sorted(waiting))]


@pytest.mark.parametrize("size", [0, 1, 2, 5, 16])
def test_bounded_output_of_any_size(spark, size):
    rng = random.Random(size)
    streams = {s: [(n, rng.randrange(20), n == 0 and s < 3 or rng.random() < 0.05) for n in range(rng.randrange(1, 120))] for s in range(6)}
    df = spark.createDataFrame([(s, *p) for s, ps in streams.items() for p in ps], "stream_id bigint, n bigint, poc bigint, idr boolean").repartition(5)
    got = {}
    for r in references.bounded_output(df, size).collect():
        got.setdefault(r.stream_id, []).append((r.n, r.shown_at, r.shown_no))
    assert {s: sorted(v, key=str) for s, v in got.items()} == {s: sorted(bumped(ps, size), key=str) for s, ps in streams.items()}
    assert references.bounded_output(df.limit(0), size).count() == 0


@pytest.mark.parametrize("gap", [0, 1, 3, 7, 12, 14])
def test_missing_frames_take_part_in_marking(spark, gap):
    plain = [(1, n, 0 if n == 3 else (n + (gap if n >= 2 and n < 3 else 0)) % 16 if n < 3 else n - 3, True, n in (0, 3), 0, 0, 0) for n in range(6)]
    schema = "stream_id bigint, n bigint, frame_num bigint, is_reference boolean, idr boolean, op bigint, a bigint, b bigint"
    filled = references.frame_gaps(spark.createDataFrame(plain, schema), 4)
    rows = filled.orderBy("place").collect()
    missing = [r.frame_num for r in rows if not r.exists]
    assert missing == [(2 + k) % 16 for k in range(gap)] and len(rows) == 6 + gap
    assert all(r.is_reference and not r.idr and r.op == 0 for r in rows if not r.exists)
    held = {r.n: r.short_term for r in references.mark_references(filled, 4, 4, "place").collect()}
    before = [1, 0] if gap == 0 else [*[-1 - (16 * 2 + k) for k in range(gap)][::-1], 1, 0][:4]
    assert held[2] == before and held[3] == [] and held[4] == [3]


def test_activation_waits_for_an_idr(spark):
    rows = [("set", 1, "a", None), ("slice", 2, None, False), ("slice", 1, None, False), ("slice", 1, None, False), ("set", 1, "a", None), ("slice", 1, None, False), ("set", 1, "b", None), ("slice", 1, None, False),
            ("set", 1, "a", None), ("slice", 1, None, False), ("slice", 1, None, True), ("slice", 1, None, True), ("set", 2, "c", None), ("slice", 2, None, False), ("slice", 2, None, True), ("slice", 1, None, False)]
    df = spark.createDataFrame([(7, n, *r) for n, r in enumerate(rows)], "stream_id bigint, n bigint, kind string, set_id bigint, content string, idr boolean")
    got = [(r.n, r.verdict, r.set_n) for r in recovery.activations(df).orderBy("n").collect()]
    assert got == [(1, "missing", None), (2, "activated", 0), (3, "ok", 0), (5, "ok", 0), (7, "refused", None), (9, "refused", None), (10, "activated", 8), (11, "ok", 8), (13, "refused", None), (14, "activated", 12), (15, "refused", None)]
    assert recovery.activations(df.limit(0)).count() == 0


def test_frames_after_damage_equal_those_of_the_undamaged_tail(spark):
    frame = lambda k: b"\xff\xf1\x50\x80" + bytes([(7 + k % 20) >> 3, ((7 + k % 20) & 7) << 5 | 31, 0xFC]) + bytes(k % 20)
    good = [frame(k) for k in range(40)]
    damaged = b"".join(good[:10]) + b"\x00\x01" + good[10][3:] + b"".join(good[12:])
    media = spark.createDataFrame([("d", damaged), ("tail", b"".join(good[12:]))], "object_id string, content binary")
    walked = files.walk(media, "adts", lambda kind, size: True).withColumn("n", F.col("seq"))
    # Bytes between frames are the damage: a frame that does not follow on the one before.
    gap = F.col("offset") > F.lag(F.col("offset") + F.col("length")).over(Window.partitionBy("object_id").orderBy("seq"))
    told = recovery.latched(walked.withColumn("gap", gap), ["object_id"], F.lit(False), F.lit(True))
    frames = {o: [bytes(r.payload) for r in sorted((r for r in told.collect() if r.object_id == o), key=lambda r: r.n)] for o in ("d", "tail")}
    assert frames["d"][-28:] == frames["tail"] == good[12:]
    rows = [(0, "x", None), (1, "bad", None), (2, "x", None), (3, "sync", None), (4, "x", None), (5, "both", None), (6, "sync", None)]
    df = spark.createDataFrame([(1, *r) for r in rows], "s bigint, n bigint, what string, kept string")
    got = recovery.latched(df, ["s"], F.col("what").isin("bad", "both"), F.col("what").isin("sync", "both")).orderBy("n").collect()
    assert [(r.kept, r.faults, r.fresh) for r in got] == [(True, 0, False), (False, 1, False), (False, 1, False), (True, 1, True), (True, 1, False), (False, 2, False), (True, 2, True)]


def test_a_cut_unit_restores_its_snapshot(spark):
    rows = [(0, False, False, True, 5), (1, True, False, False, 10), (2, False, False, True, 1), (3, True, False, False, 7), (4, False, True, True, 2), (5, True, False, True, 100), (6, True, False, False, 3), (7, False, None, True, 4), (8, True, False, False, 9)]
    df = spark.createDataFrame([(1, *r) for r in rows], "stream_id bigint, n bigint, starts boolean, cut boolean, ends boolean, bytes bigint")
    got = [(r.counted, r.snapshot, r.state) for r in recovery.rolled_back(df).orderBy("n").collect()]
    assert got == [(False, 0, 0), (True, 0, 10), (True, 0, 11), (False, 11, 18), (False, 11, 20), (True, 11, 111), (False, 111, 114), (False, 111, 118), (False, 111, 120)]


def test_configurations_in_mid_stream(spark):
    units = spark.createDataFrame([(1, n, f"u{n}") for n in range(8)], "stream_id bigint, n bigint, body string")
    told = [(1, 2, 4, "S", "P", True), (1, 4, 2, "S", "P", True), (1, 5, 1, "T", "P", False), (1, 6, 1, "T", "P", True)]
    config = spark.createDataFrame(told, "stream_id bigint, n bigint, nal_length int, sps string, pps string, adopted boolean")
    got = [(r.n, r.config_n, r.nal_length, r.sets) for r in recovery.bind_configurations(units, config).orderBy("n").collect()]
    assert got == [(0, None, None, None), (1, None, None, None), (2, 2, 4, "SP"), (3, 2, 4, ""), (4, 4, 2, ""), (5, 4, 2, ""), (6, 6, 1, "TP"), (7, 6, 1, "")]


def test_canvases_under_all_disposals(spark):
    rng = random.Random(5)
    frames = [(p, f, x, 0, rng.choice([None, rng.randrange(9)]), rng.random() < 0.7, rng.randrange(5)) for p in range(30) for f in range(8) for x in range(2)]
    df = spark.createDataFrame(frames, "picture int, frame int, x int, y int, v int, inside boolean, disposal int").repartition(4)
    canvas, expected = {}, {}
    for p, f, x, _, v, inside, disposal in sorted(frames, key=lambda r: r[1]):
        before = canvas.get((p, x), 99)
        shown = v if inside and v is not None else before
        after = 99 if inside and disposal == 2 else before if inside and disposal == 3 else shown
        canvas[p, x] = after
        expected[p, f, x] = (shown, after)
    assert {(r.picture, r.frame, r.x): (r.shown, r.left) for r in recovery.composed(df, 99).collect()} == expected


def scalar_inverse(levels, qp, dc_scaled):
    d = [0] * 16
    for i, at in enumerate(residual.ZIGZAG):
        r, c = divmod(at, 4)
        scale = residual.SCALES[qp % 6][0 if r % 2 == c % 2 == 0 else 1 if r % 2 and c % 2 else 2] << qp // 6
        d[at] = levels[i] if i == 0 and dc_scaled else levels[i] * scale
    for lines in (residual.ROWS, residual.COLUMNS):
        for line in lines:
            a, b, c, e = (d[k] for k in line)
            d[line[0]], d[line[1]], d[line[2]], d[line[3]] = a + c + b + (e >> 1), a - c + (b >> 1) - e, a - c - (b >> 1) + e, a + c - b - (e >> 1)
    d = [(v + 32) >> 6 for v in d]
    return d if all(-512 <= v <= 511 for v in d) else None


def test_inverse_transform_of_all_qps(spark):
    rng = random.Random(3)
    rows = [(qp, k % 2 == 1, [rng.choice([0, 0, rng.randrange(-9, 10)]) for _ in range(16)]) for qp in range(52) for k in range(6)]
    df = spark.createDataFrame(rows, "qp int, scaled boolean, levels array<int>")
    got = df.select("qp", "scaled", "levels", residual.inverse(F.col("levels"), F.col("qp"), F.col("scaled")).alias("r")).collect()
    assert all(r.r == scalar_inverse(r.levels, r.qp, r.scaled) for r in got) and any(r.r is None for r in got) and any(r.r for r in got)


def test_planes_of_odd_sizes(spark):
    from reelspark.functions import raster

    w, h = 5, 3
    data = bytes(range(w * h)) + bytes(range(100, 106)) + bytes(range(200, 206))
    df = spark.createDataFrame([(data, x, y) for x in range(w) for y in range(h)] + [(data[:20], 4, 2)], "c binary, x int, y int")
    got = df.select("x", "y", *[v.alias(n) for n, v in zip("abc", raster.i420(F.col("c"), F.lit(w), F.lit(h), F.col("x"), F.col("y")), strict=True)]).collect()
    assert [tuple(r) for r in got[:-1]] == [(x, y, y * w + x, 100 + y // 2 * 3 + x // 2, 200 + y // 2 * 3 + x // 2) for x in range(w) for y in range(h)]
    assert tuple(got[-1])[2:] == (14, None, None)


def scalar_intra(mode, above, left, corner):
    """By the formulas over p[x, y], the samples at the sides of the block."""
    p = {(x, -1): v for x, v in enumerate(above or [])} | {(-1, y): v for y, v in enumerate(left or [])} | {(-1, -1): corner}
    two, three = lambda a, b: (p[a] + p[b] + 1) >> 1, lambda a, b, c: (p[a] + 2 * p[b] + p[c] + 2) >> 2
    turn = lambda: three((-1, 0), (-1, -1), (0, -1))

    def sample(x, y):
        h, v = x >> 1, y >> 1
        if mode == 0:
            return p[x, -1]
        if mode == 1:
            return p[-1, y]
        if mode == 2:
            sides = [v for s in (above and above[:4], left) if s for v in s]
            return (sum(sides) + len(sides) // 2) // len(sides) if sides else 128
        if mode == 3:
            return (p[6, -1] + 3 * p[7, -1] + 2) >> 2 if x == y == 3 else three((x + y, -1), (x + y + 1, -1), (x + y + 2, -1))
        if mode == 4:
            return three((x - y - 2, -1), (x - y - 1, -1), (x - y, -1)) if x > y else three((-1, y - x - 2), (-1, y - x - 1), (-1, y - x)) if x < y else turn()
        if mode == 5:
            z = 2 * x - y
            return turn() if z == -1 else three((-1, y - 1), (-1, y - 2), (-1, y - 3)) if z < 0 else three((x - v - 2, -1), (x - v - 1, -1), (x - v, -1)) if z % 2 else two((x - v - 1, -1), (x - v, -1))
        if mode == 6:
            z = 2 * y - x
            return turn() if z == -1 else three((x - 1, -1), (x - 2, -1), (x - 3, -1)) if z < 0 else three((-1, y - h - 2), (-1, y - h - 1), (-1, y - h)) if z % 2 else two((-1, y - h - 1), (-1, y - h))
        if mode == 7:
            return three((x + v, -1), (x + v + 1, -1), (x + v + 2, -1)) if y % 2 else two((x + v, -1), (x + v + 1, -1))
        z = x + 2 * y
        return p[-1, 3] if z > 5 else (p[-1, 2] + 3 * p[-1, 3] + 2) >> 2 if z == 5 else three((-1, y + h), (-1, y + h + 1), (-1, y + h + 2)) if z % 2 else two((-1, y + h), (-1, y + h + 1))

    try:
        return [sample(i % 4, i // 4) for i in range(16)]
    except (KeyError, TypeError):
        return None


def test_intra_prediction_by_all_modes(spark):
    from reelspark.functions import intra

    rng = random.Random(7)
    some = lambda n, p: [rng.randrange(256) for _ in range(n)] if rng.random() < p else None
    rows = [(m, a, b, rng.randrange(256) if a and b else None) for m in range(9) for _ in range(20) for a, b in [(some(8, 0.8), some(4, 0.8))]] + [(9, some(8, 1), some(4, 1), 1)]
    df = spark.createDataFrame(rows, "mode int, above array<int>, side array<int>, corner int")
    got = df.select("*", intra.predicted(F.col("mode"), F.col("above"), F.col("side"), F.col("corner")).alias("r")).collect()
    assert all(r.r == (scalar_intra(r["mode"], r.above, r.side, r.corner) if r["mode"] < 9 else None) for r in got)
    assert sum(r.r is not None for r in got) > 100


def scalar_hadamard(block):
    signs = ((1, 1, 1, 1), (1, 1, -1, -1), (1, -1, -1, 1), (1, -1, 1, -1))
    return [sum(signs[i // 4][r] * signs[i % 4][c] * block[4 * r + c] for r in range(4) for c in range(4)) for i in range(16)]


def test_transforms_take_whole_batches_and_missing_levels(spark):
    rng = random.Random(4)
    rows = [(i, i % 52, i % 3 == 0, [rng.randrange(-6, 7) for _ in range(16)]) for i in range(300)]
    odd = [(300, None, True, [1] * 16), (301, 5, None, [0, *[1] * 15]), (302, 5, False, [1] * 15 + [None]), (303, 5, False, [1] * 4), (304, 5, False, None)]
    df = spark.createDataFrame(rows + odd, "id int, qp int, scaled boolean, levels array<int>").coalesce(1)
    out = df.select("id", residual.inverse(F.col("levels"), F.col("qp"), F.col("scaled")).alias("r"), residual.luma_dc(F.col("levels"), F.col("qp")).alias("l"), residual.chroma_dc(F.col("levels"), F.col("qp")).alias("c"))
    got = {r.id: r for r in out.collect()}
    for i, qp, scaled, v in [*rows, (301, 5, False, odd[1][3])]:
        f, s = scalar_hadamard([v[residual.ZIGZAG.index(at)] for at in range(16)]), residual.SCALES[qp % 6][0]
        assert got[i].r == scalar_inverse(v, qp, scaled)
        assert got[i].l == [y * s << qp // 6 - 2 if qp >= 12 else y * s + 1 >> 1 if qp >= 6 else y * s + 2 >> 2 for y in f]
        a, b, c, d = v[:4]
        assert got[i].c == [(y * s << qp // 6) >> 1 for y in (a + b + c + d, a - b + c - d, a + b - c - d, a - b - c + d)]
    assert all(got[i].r is None and got[i].l == [None] * 16 for i in (300, 302, 303, 304)) and got[300].c == got[304].c == [None] * 4 and None not in got[303].c
    # No block is worked out by interpreted lambdas, row by row.
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_context_words_of_any_arrays_and_rows_dealt_to_tasks(spark):
    from reelspark.functions import bitstream, syntax
    from reelspark.plans import registry

    rng = random.Random(6)
    rows = [(i, rng.randrange(-3, 60), [rng.randrange(256) for _ in range(rng.choice((154, 154, 0, 1, 5)))]) for i in range(120)] + [(120, 30, None)]
    df = spark.createDataFrame(rows, "id int, qp int, v array<int>").coalesce(2)
    got = {r.id: r.w for r in df.select("id", syntax.context_words(F.col("v"), F.col("qp")).alias("w")).collect()}
    each = df.select("id", "qp", F.posexplode("v").alias("k", "i")).select("id", "k", bitstream.cabac_context(F.col("i"), F.col("qp")).alias("c")).collect()
    packed = {(r.id, r.k): r.c.state * 2 + r.c.mps for r in each}
    assert got == {i: v if v is None else [sum(packed.get((i, 4 * w + j), 0) << 8 * j for j in range(4)) for w in range((len(v) + 2) // 4)] for i, _, v in rows}
    # The rows of a file that is one row group go to many tasks.
    assert "Exchange" in registry.queries()["context_init"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
