"""Media-shaped tables derived from the relational test tables: whole-number projections, stated in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Samples of one stream of the PCM view: two seconds at 8 kHz.
STREAM_SAMPLES = 16000

# Each view: its columns in an SQL that both engines read, but for div (Spark) and // (DuckDB).
_VIEWS = {
    "pcm": ("events", f"event_id DIV {STREAM_SAMPLES} AS stream_id, event_id % {STREAM_SAMPLES} AS n, (event_id * 7919) % 65536 - 32768 AS l, (event_id * 104729 + user_id) % 65536 - 32768 AS r"),
    "units": ("events", "user_id AS stream_id, event_id AS seq, event_id * 4 AS pts, 160 + event_id % 3 * 80 AS samples, event_id % 3 = 0 AS discontinuity, event_id % 7 = 0 AS lost"),
    "records": ("events", "user_id AS stream_id, event_id AS seq, CASE WHEN event_id % 10 = 0 THEN 'STREAM' WHEN event_id % 10 = 9 THEN 'END' ELSE 'UNIT' END AS kind, event_id % 5 IN (1, 3) AS continues, event_id % 11 = 3 AS truncated, event_id % 1500 AS bytes"),
    "elements": ("lineitem", "l_orderkey % 97 AS object_id, l_orderkey * 8 + l_linenumber AS off, CASE WHEN l_linenumber = 1 THEN 'cluster' ELSE 'block' END AS kind, CASE WHEN l_linenumber = 1 THEN l_orderkey * 1000 ELSE l_partkey % 65536 - 32768 END AS val, l_suppkey % 256 AS flags"),
    "octets": ("lineitem", "l_orderkey AS object_id, l_linenumber AS k, l_orderkey * 31 % 256 AS b0, l_partkey % 256 AS b1, l_suppkey * 7 % 256 AS b2, l_partkey * 13 % 65536 AS w"),
    "slices": ("events", "user_id AS stream_id, event_id AS n, event_id DIV 7 % 16 AS lsb, event_id % 3 AS tid, event_id % 40 = 0 AS idr, event_id % 4 AS set_id, event_id % 2 = 0 AS is_reference, user_id % 4 AS pps"),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = _VIEWS[name]
    return table(spark, sf_dir, source).selectExpr(*_split(columns))


def sql(*names: str) -> str:
    """The views as DuckDB common table expressions, after WITH."""
    return ", ".join(f"{n} AS (SELECT {_VIEWS[n][1].replace(' DIV ', ' // ')} FROM {_VIEWS[n][0]})" for n in names)


def _split(columns: str) -> list[str]:
    """Expressions of a select list: commas inside brackets part nothing."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


def pixels(spark: SparkSession, sf_dir: str, by_image: bool = False) -> DataFrame:
    """(img, x, y, r, g, b): every vector as an image of 8 columns.

    by_image deals whole images to tasks before they become pixels: what follows by image, line or column needs no further shuffle.
    """
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    at = (vectors.repartition("vec_id") if by_image else vectors).select(F.col("vec_id").alias("img"), F.posexplode("embedding").alias("i", "e"))
    level = F.floor(F.abs(F.col("e").cast("double")) * 1000).cast("int")
    return at.select("img", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), (level % 256).alias("r"), (level * 3 % 256).alias("g"), (level * 7 % 256).alias("b"))


PIXELS_SQL = """pixels AS (SELECT img, ((i - 1) % 8)::INT AS x, ((i - 1) // 8)::INT AS y, (v % 256)::INT AS r, (v * 3 % 256)::INT AS g, (v * 7 % 256)::INT AS b FROM (
  SELECT vec_id AS img, i, floor(abs(embedding[i]::DOUBLE) * 1000)::INT AS v FROM (SELECT *, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)))"""

# Magic numbers in hex.
MAGIC = ("524946460000", "FFFB9064", "FFF15080", "424D3600", "1A45DFA3", "89504E470D0A1A0A", "FFD8FFE0", "474946383961", "494433", "", "FF")


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(object_id, content): first bytes of objects, with a magic number by id."""
    magic = F.get(F.array(*[F.lit(m) for m in MAGIC]), (F.col("doc_id") % len(MAGIC)).cast("int"))
    size = F.col("doc_id") % 7
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("object_id"), F.unhex(F.concat(magic, F.substring(F.hex(F.encode("text", "UTF-8")), F.lit(1), (size * 2).cast("int")))).alias("content"))


HEADS_SQL = f"heads AS (SELECT doc_id AS object_id, ([{', '.join(repr(m) for m in MAGIC)}])[doc_id % {len(MAGIC)} + 1] || substr(hex(encode(text)), 1, (doc_id % 7 * 2)::INT) AS h FROM documents)"
