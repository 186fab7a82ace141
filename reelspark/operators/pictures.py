"""Picture order, parameter sets, access units and reference marking, as windows over pictures in decoding order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def picture_order(slices: DataFrame, log2_max_lsb: int) -> DataFrame:
    """slices (stream_id, n, lsb, tid, idr) with poc.

    The most significant part changes by one period whenever the least significant part wraps against the last picture
    of temporal id 0; an IDR picture starts anew at 0. A running sum of those changes replaces the decoder's state.
    """
    period = 1 << log2_max_lsb
    order = Window.partitionBy("stream_id").orderBy("n")
    so_far, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    anchor = F.when(F.col("idr"), F.lit(0)).when(F.col("tid") == 0, F.col("lsb"))
    seen = slices.withColumn("_run", F.sum(F.col("idr").cast("int")).over(so_far)).withColumn("_prev", F.last(anchor, ignorenulls=True).over(earlier))
    change = (
        F.when(F.col("idr") | F.col("_prev").isNull(), 0)
        .when((F.col("lsb") < F.col("_prev")) & (F.col("_prev") - F.col("lsb") >= period // 2), period)
        .when((F.col("lsb") > F.col("_prev")) & (F.col("lsb") - F.col("_prev") > period // 2), -period)
        .otherwise(0)
    )
    inside = Window.partitionBy("stream_id", "_run").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    kept = F.coalesce(F.sum(F.when(F.col("tid") == 0, F.col("_change")).otherwise(0)).over(inside), F.lit(0))
    poc = F.when(F.col("idr"), 0).otherwise(kept + F.col("_change") + F.col("lsb"))
    return seen.withColumn("_change", change).withColumn("poc", poc.cast("bigint")).drop("_run", "_prev", "_change")


def output_order(pictures: DataFrame) -> DataFrame:
    """pictures (stream_id, n, poc, idr) with display_no: by POC inside each run from an IDR picture to the next."""
    run = Window.partitionBy("stream_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    shown = Window.partitionBy("stream_id").orderBy("_run", "poc", "n")
    return pictures.withColumn("_run", F.sum(F.col("idr").cast("int")).over(run)).withColumn("display_no", F.row_number().over(shown) - 1).drop("_run")


def bind_parameters(nals: DataFrame) -> DataFrame:
    """Slices of nals (stream_id, n, kind, set_id) with set_n: the n of the latest parameter set of that id before them."""
    order = Window.partitionBy("stream_id", "set_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.last(F.when(F.col("kind") == "set", F.col("n")), ignorenulls=True).over(order)
    return nals.withColumn("set_n", latest).where("kind = 'slice'").select("stream_id", "n", "set_id", "set_n")


def access_units(slices: DataFrame, fields: list[str]) -> DataFrame:
    """slices (stream_id, n, fields) with au_no: a new access unit begins where any of the fields differs from the slice before."""
    order = Window.partitionBy("stream_id").orderBy("n")
    same = F.lit(True)
    for f in fields:
        same = same & F.lag(f).over(order).eqNullSafe(F.col(f))
    first = F.lag("n").over(order).isNull()
    return slices.withColumn("_new", F.when(first | ~same, 1).otherwise(0)).withColumn("au_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def sliding_window(pictures: DataFrame, references: int) -> DataFrame:
    """pictures (stream_id, n, is_reference, idr) with held: the n of the reference pictures marked when each is decoded, oldest first."""
    order = Window.partitionBy("stream_id").orderBy("n")
    runs = pictures.withColumn("_run", F.sum(F.col("idr").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # Each reference knows the few references up to itself; every picture takes what the latest reference before it knows.
    # References of a run come first in their own window, so a frame of fixed length holds them all.
    own = Window.partitionBy("stream_id", "_run", "is_reference").orderBy("n").rowsBetween(-(references - 1), 0)
    known = runs.withColumn("_known", F.when(F.col("is_reference"), F.collect_list("n").over(own)))
    inside = Window.partitionBy("stream_id", "_run").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.last("_known", ignorenulls=True).over(inside), F.array().cast("array<bigint>"))
    return known.withColumn("held", F.when(F.col("idr"), F.array().cast("array<bigint>")).otherwise(held)).drop("_run", "_known")
