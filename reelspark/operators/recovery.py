"""What decoders keep or give up between rows: activated parameter sets, configurations in mid-stream, latched errors, and units rolled back.

All are windows over ordered rows: a state that changes only at marked rows is the last marked row's value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _so_far(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)


def _before(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)


def activations(nals: DataFrame) -> DataFrame:
    """Slices of nals (stream_id, n, kind: 'set' or 'slice', set_id, content, idr) with verdict and set_n, the parameter set that decodes them.

    A set is stored under its id when it comes and becomes active only at an IDR slice, or at the first slice that finds
    its set; the same content again changes nothing. verdict: 'activated' where a slice makes another set active, or one whose content
    has changed; 'ok' where the active set decodes it; 'missing' where no set of its id is stored; 'refused' where a slice
    that is no IDR names another set than the active one, or the active one has been changed since. set_n is the n of
    the row that brought the active content; null for missing and refused.
    """
    x = nals.withColumn("_is_set", F.col("kind") == "set")
    own = Window.partitionBy("stream_id", "set_id", "_is_set").orderBy("n")
    changed = F.col("_is_set") & ~F.col("content").eqNullSafe(F.lag("content").over(own)) | (F.col("_is_set") & F.lag("n").over(own).isNull())
    x = x.withColumn("_changed", F.when(changed, F.col("n")))
    # The row that brought what is stored under the id now.
    x = x.withColumn("_stored", F.last("_changed", ignorenulls=True).over(_so_far("stream_id", "set_id")))
    found = ~F.col("_is_set") & F.col("_stored").isNotNull()
    first = found & (F.sum(found.cast("int")).over(_so_far("stream_id")) == 1)
    taken = F.struct(F.col("set_id").alias("id"), F.col("_stored").alias("set_n"))
    x = x.withColumn("_takes", found & (F.col("idr") | first)).withColumn("_taken", F.when(F.col("_takes"), taken))
    x = x.withColumn("_active", F.last("_taken", ignorenulls=True).over(_before("stream_id")))
    same = F.coalesce((F.col("_active.id") == F.col("set_id")) & (F.col("_active.set_n") == F.col("_stored")), F.lit(False))
    verdict = F.when(F.col("_stored").isNull(), "missing").when(F.col("_takes") & ~same, "activated").when(same, "ok").otherwise("refused")
    out = x.where("kind = 'slice'").withColumn("verdict", verdict)
    return out.select("stream_id", "n", "set_id", "idr", "verdict", F.when(F.col("verdict").isin("ok", "activated"), F.col("_stored")).alias("set_n"))


def bind_configurations(units: DataFrame, configurations: DataFrame) -> DataFrame:
    """units (stream_id, n, body) with the configuration in force: nal_length, sets (put before a unit where they change) and config_n.

    configurations (stream_id, n, nal_length, sps, pps, adopted) holds from its n on, that of a unit's own n included; a
    null or false adopted leaves the one before in force. sets is what stands before a unit: both sets, where the unit is the
    first one of a configuration whose sets differ from those put before last; else empty. Units before any configuration have nulls.
    """
    told = F.struct("n", "nal_length", "sps", "pps")
    c = configurations.where("adopted").select("stream_id", "n", F.lit(0).alias("_unit"), told.alias("_config"), F.lit(None).cast(units.schema["body"].dataType).alias("body"))
    u = units.select("stream_id", "n", F.lit(1).alias("_unit"), F.lit(None).cast(c.schema["_config"].dataType).alias("_config"), "body")
    order = Window.partitionBy("stream_id").orderBy("n", "_unit")
    x = c.union(u).withColumn("_config", F.last("_config", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_unit = 1")
    last = F.lag("_config").over(Window.partitionBy("stream_id").orderBy("n"))
    sets = lambda v: F.struct(v["sps"], v["pps"])
    new = F.col("_config").isNotNull() & (last.isNull() | ~sets(F.col("_config")).eqNullSafe(sets(last)))
    put = F.when(F.col("_config").isNotNull(), F.when(new, F.concat(F.col("_config.sps"), F.col("_config.pps"))).otherwise(""))
    return x.withColumn("sets", put).select("stream_id", "n", "body", F.col("_config.n").alias("config_n"), F.col("_config.nal_length").alias("nal_length"), "sets")


def latched(rows: DataFrame, keys: list[str], fault: Column, sync: Column) -> DataFrame:
    """rows (keys, n, ...) with kept, faults and fresh: an error latch that a fault sets and a row to synchronise on clears.

    A faulty row and all rows after it are not kept, up to a row where sync holds and fault does not. faults counts the
    faulty rows that the latch has met, those that come while it is set among them; fresh marks the first row kept after a fault, before which state such as an
    overlap is cleared. Null conditions do not hold.
    """
    bad, good = F.coalesce(fault, F.lit(False)), F.coalesce(sync, F.lit(False))
    x = rows.withColumn("_mark", F.when(bad, False).when(good, True)).withColumn("_bad", bad.cast("int"))
    kept = F.coalesce(F.last("_mark", ignorenulls=True).over(_so_far(*keys)), F.lit(True))
    x = x.withColumn("kept", kept).withColumn("faults", F.sum("_bad").over(_so_far(*keys)))
    fresh = F.col("kept") & F.coalesce(~F.lag("kept").over(Window.partitionBy(*keys).orderBy("n")), F.lit(False))
    return x.withColumn("fresh", fresh).drop("_mark", "_bad")


def rolled_back(fragments: DataFrame) -> DataFrame:
    """fragments (stream_id, n, starts, cut, ends, bytes) with the state of their stream before and after: bytes of whole units.

    A unit begins at a fragment that starts and goes to the next that does; it counts only if none of its fragments is
    cut and its last one ends it. What a unit that does not count has added is taken back at the next unit's start: the snapshot
    of its own start is the state there. Columns added: snapshot, the state at the unit's start; state, that after the fragment
    while its unit is open; counted. Fragments before any start belong to no unit and add nothing.
    """
    x = fragments.withColumn("_unit", F.sum(F.coalesce(F.col("starts"), F.lit(False)).cast("int")).over(_so_far("stream_id")))
    unit = Window.partitionBy("stream_id", "_unit")
    last = F.last("ends").over(unit.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    whole = (F.col("_unit") > 0) & ~F.max(F.coalesce(F.col("cut"), F.lit(True))).over(unit) & F.coalesce(last, F.lit(False))
    x = x.withColumn("counted", whole)
    inside = F.when(F.col("_unit") > 0, F.sum(F.coalesce(F.col("bytes"), F.lit(0))).over(_so_far("stream_id", "_unit"))).otherwise(0)
    x = x.withColumn("_inside", inside).withColumn("_adds", F.when(F.col("counted"), F.coalesce(F.col("bytes"), F.lit(0))).otherwise(0))
    total = F.sum("_adds").over(_so_far("stream_id"))
    snapshot = total - F.when(F.col("counted"), F.col("_inside")).otherwise(0)
    return x.withColumn("snapshot", snapshot.cast("bigint")).withColumn("state", (F.col("snapshot") + F.col("_inside")).cast("bigint")).drop("_unit", "_inside", "_adds")


def composed(frames: DataFrame, ground: int = 0) -> DataFrame:
    """frames' places (picture, frame, x, y, v, inside, disposal) with shown and left: what stands there while the frame is shown, and after its disposal.

    v is null where the frame is transparent, inside says whether the place lies in the frame. Disposal 0 and 1 leave the frame,
    2 puts the ground back inside the frame, 3 puts back what was there before it; others count as 0. A frame either
    leaves a place as it was or gives it a value whatever was there, so the canvas is the last value given: a running
    last value, which any split of the frames computes in parts.
    """
    order = Window.partitionBy("picture", "x", "y").orderBy("frame")
    drawn = F.when(F.col("inside"), F.col("v"))
    gives = F.when(~F.col("inside") | (F.col("disposal") == 3), None).when(F.col("disposal") == 2, ground).otherwise(F.col("v"))
    x = frames.withColumn("_drawn", drawn).withColumn("_gives", gives.cast("int"))
    under = F.coalesce(F.last("_gives", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(ground))
    left = F.coalesce(F.last("_gives", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(ground))
    return x.withColumn("shown", F.coalesce("_drawn", under)).withColumn("left", left).drop("_drawn", "_gives")
