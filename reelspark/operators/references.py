"""Picture order of H.264, reference marking with commands, reference lists, and picture slots of H.265.

Order counts are windows. Marking, slots and bounded output carry a state of at most 16 pictures from each picture to the
next and start anew at every IDR picture: runs between IDR pictures are dealt over tasks, each task's rows are sorted, and
one pass streams through them with the state of the run it is in.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a run's state does with a row's values: the rows to give out; at None, after the run's last row, the rest.
Step = Callable[[tuple | None], list[tuple]]


def in_order(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], begin: Callable[[], Step], schema: str) -> DataFrame:
    """One pass over rows that are dealt by keys and sorted by order: begin() makes each group's state, which takes columns and gives rows of schema.

    A task holds a batch and one state, however long its groups are.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order).select(*dict.fromkeys([*keys, *columns]))
    return dealt.mapInArrow(partial(_pass, keys, columns, begin, arrow), schema)


def _pass(keys: list[str], columns: list[str], begin: Callable[[], Step], schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group, step, out = None, None, []
    for batch in batches:
        told = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
        for key, row in zip(told, zip(*(batch.column(c).to_pylist() for c in columns), strict=True), strict=True):
            if step is None or key != group:
                out += step(None) if step else []
                group, step = key, begin()
            out += step(row)
        yield _batch(out, schema)
        out = []
    yield _batch(out + step(None) if step else out, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _runs(pictures: DataFrame, ends: Column, by: str = "n") -> DataFrame:
    """pictures with _run: it rises at an IDR picture and after a picture where `ends` holds."""
    order = Window.partitionBy("stream_id").orderBy(by)
    begun = F.sum(F.col("idr").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ended = F.coalesce(F.sum(ends.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return pictures.withColumn("_run", begun + ended)


def h264_order(pictures: DataFrame, log2_lsb: int, log2_frame_num: int, cycle: tuple[int, ...], non_reference: int) -> DataFrame:
    """pictures (stream_id, n, lsb, frame_num, delta, is_reference, idr, resets) with poc0, poc1, poc2: frames' order counts by each of the three types.

    Type 0 unwraps lsb against the reference picture before, type 1 adds up the offsets of a cycle of reference
    pictures, type 2 is decoding order. A picture that resets (the fifth marking command) has 0 and starts a new run.
    """
    period, wrap = 1 << log2_lsb, 1 << log2_frame_num
    x = _runs(pictures, F.col("resets"))
    inside = Window.partitionBy("stream_id", "_run").orderBy("n")
    earlier, so_far = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    prev = F.coalesce(F.last(F.when(F.col("is_reference"), F.col("lsb")), ignorenulls=True).over(earlier), F.lit(0))
    x = x.withColumn("_prev", prev)
    back, ahead = F.col("_prev") - F.col("lsb"), F.col("lsb") - F.col("_prev")
    x = x.withColumn("_change", F.when(back >= period // 2, period).when(ahead > period // 2, -period).otherwise(0))
    kept = F.coalesce(F.sum(F.when(F.col("is_reference"), F.col("_change")).otherwise(0)).over(earlier), F.lit(0))
    wraps = F.sum(F.when(F.coalesce(F.lag("frame_num").over(inside), F.lit(0)) > F.col("frame_num"), 1).otherwise(0)).over(so_far)
    x = x.withColumn("_poc0", kept + F.col("_change") + F.col("lsb")).withColumn("_abs", wraps * wrap + F.col("frame_num"))
    plain = (~F.col("is_reference")).cast("int")
    at = F.when(F.col("_abs") > 0, F.col("_abs") - plain).otherwise(0) if cycle else F.lit(0)
    sums = F.array(*[F.lit(sum(cycle[: i + 1])) for i in range(len(cycle))]) if cycle else None
    expected = F.when(at > 0, F.floor((at - 1) / len(cycle)) * sum(cycle) + F.get(sums, ((at - 1) % len(cycle)).cast("int"))).otherwise(0) if cycle else F.lit(0)
    shown = lambda v: F.when(F.col("resets"), 0).otherwise(v).cast("bigint")
    out = {"poc0": shown(F.col("_poc0")), "poc1": shown(expected + plain * non_reference + F.col("delta")), "poc2": shown(F.when(F.col("idr"), 0).otherwise(2 * F.col("_abs") - plain))}
    return x.withColumns(out).drop("_run", "_prev", "_change", "_poc0", "_abs")


def _marking(references: int, wrap: int) -> Step:
    """For each picture (stream_id, n, frame_num, is_reference, idr, op, a, b) the pictures held when it is decoded: short-term ones by falling number, long-term ones by index."""
    short: dict[int, int] = {}
    long: dict[int, int] = {}

    def step(row: tuple | None) -> list[tuple]:
        nonlocal short, long
        if row is None:
            return []
        stream, n, frame, is_reference, idr, op, a, b = row
        number = lambda p: short[p] - wrap if short[p] > frame else short[p]
        if idr:
            short, long = {}, {}
        listed = sorted(short, key=lambda p: (-number(p), p))
        out = [(stream, n, listed, [long[i] for i in sorted(long)], [number(p) for p in listed], sorted(long))]
        if not is_reference:
            return out
        named = next((p for p in short if number(p) == frame - (a + 1)), None) if op in (1, 3) else None
        if op == 2:
            long.pop(a, None)
        elif op == 4:
            long = {i: p for i, p in long.items() if i < a}
        elif op == 5:
            short, long, frame = {}, {}, 0
        if named is not None:
            short.pop(named)
            if op == 3:
                long[b] = named
        if op == 6:
            long.pop(a, None)
        if len(short) + len(long) >= references and short:
            short.pop(min(short, key=lambda p: (number(p), p)))
        if op == 6:
            long[a] = n
        else:
            short[n] = frame
        return out

    return step


def mark_references(pictures: DataFrame, references: int, log2_frame_num: int, order: str = "n") -> DataFrame:
    """(stream_id, n, short_term, long_term, short_numbers, long_numbers): the reference pictures held when each picture (stream_id, n, frame_num, is_reference, idr, op, a, b) is decoded.

    op is a marking command: 1 drops the short-term picture of a difference a + 1, 2 drops the long-term index a, 3 gives
    that picture the long-term index b, 4 keeps indexes below a, 5 drops all, 6 gives the picture itself the index a; 0
    and a full buffer drop the oldest short-term picture. short_term and long_term are the first reference list, and the
    numbers are those by which commands name its pictures. Pictures are decoded in the order of the column that order names.
    """
    columns = ["stream_id", "n", "frame_num", "is_reference", "idr", "op", "a", "b"]
    schema = "stream_id bigint, n bigint, short_term array<bigint>, long_term array<bigint>, short_numbers array<bigint>, long_numbers array<bigint>"
    return in_order(_runs(pictures, F.lit(False), order), ["stream_id", "_run"], [order], columns, partial(_marking, references, 1 << log2_frame_num), schema)


def frame_gaps(pictures: DataFrame, log2_frame_num: int) -> DataFrame:
    """pictures with the frames that their numbers say are missing, as non-existing pictures that take part in marking.

    Added are place, the order in which pictures and missing frames are marked, and exists. A picture whose frame_num is
    neither that of the reference picture before it nor the next one (modulo the wrap) has all numbers between before it;
    they are reference pictures without commands, and their n is -1 - (16 n + k), for k from 0. An IDR picture starts
    anew, a picture with the fifth command counts as number 0, and before a stream's first picture nothing is missing.
    """
    wrap = 1 << log2_frame_num
    x = _runs(pictures, F.lit(False))
    earlier = Window.partitionBy("stream_id", "_run").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    number = F.when(F.col("is_reference"), F.when(F.col("op") == 5, 0).otherwise(F.col("frame_num")))
    x = x.withColumn("_prev", F.last(number, ignorenulls=True).over(earlier))
    ahead = F.pmod(F.col("frame_num") - F.col("_prev"), F.lit(wrap))
    missing = F.when(~F.col("idr") & (ahead > 1), ahead - 1).otherwise(0).cast("int")
    each = x.withColumn("_k", F.explode(F.sequence(F.lit(0), missing))).withColumn("exists", F.col("_k") == missing)
    filled = lambda c, v: F.when(F.col("exists"), F.col(c)).otherwise(F.lit(v)).alias(c)
    plain = {"is_reference": True, "idr": False, "op": 0, "a": 0, "b": 0}
    number = F.when(F.col("exists"), F.col("frame_num")).otherwise(F.pmod(F.col("_prev") + 1 + F.col("_k"), F.lit(wrap))).cast(pictures.schema["frame_num"].dataType)
    name = F.when(F.col("exists"), F.col("n")).otherwise(-1 - (16 * F.col("n") + F.col("_k")))
    others = [c for c in pictures.columns if c not in ("stream_id", "n", "frame_num", *plain)]
    return each.select("stream_id", name.alias("n"), number.alias("frame_num"), *[filled(c, v) for c, v in plain.items()], *others, (16 * F.col("n") + F.col("_k")).alias("place"), "exists")


def _bumping(size: int) -> Step:
    """For each picture (stream_id, n, poc, idr) those that it pushes out of a buffer of so many waiting ones."""
    waiting: list[tuple[int, int]] = []
    stream, shown = None, 0

    def step(row: tuple | None) -> list[tuple]:
        nonlocal stream, shown
        out = []
        if row is not None:
            stream, n, poc, _ = row
            heapq.heappush(waiting, (poc, n))
        while waiting and (row is None or len(waiting) > size):
            poc, held = heapq.heappop(waiting)
            out.append((stream, held, poc, None if row is None else row[1], shown))
            shown += 1
        return out

    return step


def bounded_output(pictures: DataFrame, size: int) -> DataFrame:
    """(stream_id, n, poc, shown_at, shown_no): when a display buffer of so many pictures gives each picture (stream_id, n, poc, idr) out.

    A picture that finds the buffer full pushes out the one of the least poc, itself if it is that one; shown_at is the n of
    the picture that pushes, null where an IDR picture or the end of the stream empties the buffer. shown_no counts inside
    a run from an IDR picture to the next. A buffer of 0 shows every picture at once; of equal pocs the earlier picture goes first.
    """
    x = _runs(pictures, F.lit(False))
    schema = "stream_id bigint, n bigint, poc bigint, shown_at bigint, shown_no bigint"
    return in_order(x, ["stream_id", "_run"], ["n"], ["stream_id", "n", "poc", "idr"], partial(_bumping, size), schema)


def reordered(first: Column, commands: Column) -> Column:
    """A reference list after its commands: each puts the picture that it names (if it is there) at the next place, the others follow."""
    start = F.struct(F.lit(0).alias("at"), first.alias("list"))

    def step(acc: Column, p: Column) -> Column:
        rest = F.filter(F.slice(acc["list"], acc["at"] + 1, F.size(first)), lambda q: q != p)
        moved = F.concat(F.slice(acc["list"], F.lit(1), acc["at"]), F.array(p), rest)
        return F.struct((acc["at"] + F.array_contains(first, p).cast("int")).alias("at"), F.when(F.array_contains(first, p), moved).otherwise(acc["list"]).alias("list"))

    return F.aggregate(commands, start, step, lambda acc: acc["list"])


def _slots(slots: int) -> Step:
    held: list[int | None] = [None] * slots

    def step(row: tuple | None) -> list[tuple]:
        nonlocal held
        if row is None:
            return []
        stream, n, poc, keep = row
        kept = set(keep)
        held = [p if p in kept else None for p in held]
        free = held.index(None) if None in held else None
        if free is not None:
            held[free] = poc
        return [(stream, n, free, sum(p is not None for p in held))]

    return step


def picture_slots(pictures: DataFrame, slots: int = 16) -> DataFrame:
    """(stream_id, n, slot, occupancy): pictures (stream_id, n, poc, idr, keep: array of POCs) in the lowest slot that is free once all but the kept ones are gone; null without one."""
    schema = "stream_id bigint, n bigint, slot int, occupancy int"
    return in_order(_runs(pictures, F.lit(False)), ["stream_id", "_run"], ["n"], ["stream_id", "n", "poc", "keep"], partial(_slots, slots), schema)
