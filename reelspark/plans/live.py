"""Queries that run as streams: a table's rows go through a stateful processor, all that is there now, and its results are read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelspark.plans import audio
from reelspark.sources import sinks
from reelspark.sources.views import _VIEWS, _split
from reelspark.streaming import records as live

QUERIES, ORACLE_SQL = {}, {}


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of a test table as a stream of its files."""
    source, columns = _VIEWS[name]
    path = f"{sf_dir}/{source}.parquet"
    stored = spark.read.parquet(path)
    reader = spark.readStream.schema(stored.schema)
    if all(f.endswith(f"/{source}.parquet") for f in stored.inputFiles()):
        # One file: a stream reads folders.
        return reader.option("pathGlobFilter", f"{source}.parquet").parquet(sf_dir).selectExpr(*_split(columns))
    return reader.parquet(path).selectExpr(*_split(columns))


def settled(out: DataFrame, label: str) -> DataFrame:
    """The rows that a stream gives for all its input, as a table."""
    folder = sinks.scratch(out.sparkSession, label)
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{folder}/rows")


def live_records(spark, d):
    """Whole units and records out of order, by the stateful processor."""
    return settled(live.live_units(stream_of(spark, d, "records")), "live-records").where("kind <> 'idle'")


QUERIES["live_records"] = live_records
ORACLE_SQL["live_records"] = f"""WITH units AS ({audio.ORACLE_SQL['record_reassemble']}), faults AS ({audio.ORACLE_SQL['record_faults']})
SELECT stream_id, 'unit' AS kind, bound_seq, first_seq, last_seq, fragments, bytes FROM units UNION ALL SELECT stream_id, 'fault', NULL, seq, seq, 1, NULL FROM faults"""
