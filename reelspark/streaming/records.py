"""Record streams in Structured Streaming: the same algebra with state instead of windows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reelspark.operators.records import MAX_SILENCE

GAPS = "stream_id bigint, seq bigint, pts bigint, expected bigint, silence bigint"


def _gaps(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    expected = state.get[0] if state.exists else None
    rows = []
    for unit in pd.concat(batches).sort_values("seq").itertuples():
        gap = 0 if expected is None else unit.pts - expected
        rows.append((key[0], unit.seq, unit.pts, expected, gap if unit.discontinuity and 0 < gap <= MAX_SILENCE else 0))
        expected = int(unit.pts + unit.samples)
    state.update((expected,))
    out = pd.DataFrame(rows, columns=["stream_id", "seq", "pts", "expected", "silence"])
    yield out.astype({"expected": "Int64"})


def fill_gaps(units: DataFrame) -> DataFrame:
    """The streaming form of operators.records.fill_gaps: the state of a stream is the pts that it expects next.

    Inside a micro-batch units are put in order of seq; across batches they must arrive in order.
    """
    return units.groupBy("stream_id").applyInPandasWithState(_gaps, GAPS, "expected bigint", "append", GroupStateTimeout.NoTimeout)


def bitrate(units: DataFrame, seconds: int = 1, late: str = "10 seconds") -> DataFrame:
    """Bits of each stream in windows of its own time (pts at 8 kHz), closed by a watermark."""
    timed = units.withColumn("at", F.timestamp_millis(F.floor(F.col("pts") / 8).cast("bigint"))).withWatermark("at", late)
    return timed.groupBy(F.window("at", f"{seconds} seconds"), "stream_id").agg(F.sum(F.col("samples") * 8).alias("bits"), F.count("*").alias("units"))


LIVE = "stream_id bigint, kind string, bound_seq bigint, first_seq bigint, last_seq bigint, fragments bigint, bytes bigint"


_STATE = "bound_seq bigint, first_seq bigint, last_seq bigint, fragments bigint, bytes bigint, cut boolean"


def _live(idle_ms: int | None, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One record stream: its state is the open stream and the unit whose fragments have come so far."""
    if state.hasTimedOut:
        bound = state.get[0]
        state.remove()
        yield _told([(key[0], "idle", bound, None, None, 0, None)])
        return
    held = state.get if state.exists else None
    bound, part = (None, None) if held is None else (held[0], tuple(held[1:]) if held[3] else None)
    out = []
    batch = pd.concat(batches).sort_values("seq")
    names = ["seq", "kind", "continues", "truncated", "bytes"]
    for seq, kind, continues, truncated, size in zip(*(batch[n].astype(object).where(batch[n].notna(), None) for n in names), strict=True):
        if kind == "STREAM":
            bound, part = int(seq), None
        elif bound is None:
            out.append((key[0], "fault", None, int(seq), int(seq), 1, None))
        elif kind == "END":
            bound, part = None, None
        else:
            first, _, n, so_far, cut = part or (int(seq), None, 0, None, None)
            size = so_far if size is None else int(size) + (so_far or 0)
            # A unit is known to be whole only if a mark says so: true wins over false, false over null.
            cut = cut if truncated is None else bool(truncated) or bool(cut)
            part = (first, int(seq), n + 1, size, cut)
            if not continues:
                if continues is not None and cut is False:
                    out.append((key[0], "unit", bound, first, int(seq), n + 1, size))
                part = None
    if bound is None:
        if held is not None:
            state.remove()
    else:
        state.update((bound, *(part or (None, None, 0, None, None))))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
    yield _told(out)


def _told(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in LIVE.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({n: "Int64" for n in names if n != "kind"})


def live_units(records: DataFrame, idle_seconds: float | None = None) -> DataFrame:
    """The streaming form of operators.records: of records (stream_id, seq, kind, continues, truncated, bytes) rows LIVE.

    kind 'unit': a whole unit, as reassemble() has it, when its last fragment comes; 'fault': a record out of order, as
    faults() has it; 'idle': a stream of which nothing has come for so long, which is thereby ended; its partial unit is
    gone, and its later units are faults until it opens again. Inside a micro-batch records are put in order of seq, so a
    batch bounds what a task holds of a stream (maxFilesPerTrigger and the like); across batches they must come in order.
    Without idle_seconds streams stay open; with it Spark runs batches for the timers for ever, so the trigger must not be availableNow.
    """
    idle = None if idle_seconds is None else int(idle_seconds * 1000)
    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    return records.groupBy("stream_id").applyInPandasWithState(partial(_live, idle), LIVE, _STATE, "append", timeout)
