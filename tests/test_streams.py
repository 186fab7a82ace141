"""Record streams live: equal to the batch form however the input is cut into micro-batches, also after a restart."""

import random
import time

import pytest
from pyspark.sql import functions as F

from reelspark.operators import records
from reelspark.streaming import records as live

SCHEMA = "stream_id bigint, seq bigint, kind string, continues boolean, truncated boolean, bytes bigint"


def made(rng, n=400):
    rows = []
    for seq in range(n):
        kind = rng.choices(["STREAM", "END", "UNIT"], [1, 1, 8])[0]
        rows.append((rng.randrange(6), seq, kind, rng.choice([True, True, False, False, None]), rng.choices([True, False, None], [1, 8, 1])[0], rng.choice([rng.randrange(2000), None])))
    return rows


def expected(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    units = [("unit", r.stream_id, r.bound_seq, r.first_seq, r.last_seq, r.fragments, r.bytes) for r in records.reassemble(df).collect()]
    return sorted(units + [("fault", r.stream_id, None, r.seq, r.seq, 1, None) for r in records.faults(df).collect()], key=str)


def run(spark, folder, schema=SCHEMA, name="live", **options):
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = live.live_units(source, **options)
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()


def told(spark, folder):
    rows = spark.read.parquet(f"{folder}/out").collect()
    return sorted(((r.kind, r.stream_id, r.bound_seq, r.first_seq, r.last_seq, r.fragments, r.bytes) for r in rows), key=str)


def put(spark, folder, rows, k):
    """A file of its own, later than those before."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    time.sleep(0.05)


@pytest.mark.parametrize("seed", [1, 2])
def test_units_of_any_micro_batches_and_after_a_restart(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = made(rng)
    cuts = [0, *sorted(rng.sample(range(1, len(rows)), 5)), len(rows)]
    parts = [rng.sample(rows[a:b], b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    for k, part in enumerate(parts[:3]):
        put(spark, tmp_path, part, k)
    run(spark, tmp_path)
    # A restart goes on from the checkpoint: the open streams and the partial units are still there.
    for k, part in enumerate(parts[3:]):
        put(spark, tmp_path, part, k)
    run(spark, tmp_path)
    assert told(spark, tmp_path) == expected(spark, rows)


def test_an_idle_stream_is_ended(spark, tmp_path):
    put(spark, tmp_path, [(1, 0, "STREAM", None, None, None), (1, 1, "UNIT", True, False, 5), (2, 2, "STREAM", None, None, None)], 0)
    source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    query = live.live_units(source, idle_seconds=0.5).writeStream.format("memory").queryName("idle").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="300 milliseconds").start()
    try:
        stop = time.monotonic() + 60
        while spark.table("idle").where("kind = 'idle'").count() < 2 and time.monotonic() < stop:
            time.sleep(0.5)
        put(spark, tmp_path, [(1, 3, "UNIT", False, False, 7), (2, 4, "STREAM", None, None, None), (2, 5, "UNIT", False, False, 7)], 1)
        while spark.table("idle").where("kind in ('unit', 'fault')").count() < 2 and time.monotonic() < stop:
            time.sleep(0.5)
        got = {(r.kind, r.stream_id, r.bound_seq, r.first_seq) for r in spark.table("idle").collect()}
    finally:
        query.stop()
    assert {("idle", 1, 0, None), ("idle", 2, 2, None), ("fault", 1, None, 3), ("unit", 2, 4, 5)} <= got


def test_live_units_of_an_empty_input(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    run(spark, tmp_path)
    assert spark.read.schema(live.LIVE).parquet(f"{tmp_path}/out").where(F.lit(True)).count() == 0
