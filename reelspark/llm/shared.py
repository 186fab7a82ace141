"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: By application, the folder of local sessions that name none.
_UNSET: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, as in tests, may leave it unset; it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _UNSET.get(app) or _UNSET.setdefault(app, tempfile.mkdtemp(prefix="reelspark-"))
    return found.rstrip("/")


#: The attribute that names a written table's folder.
_FOLDER = "_written_to"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _FOLDER, path)
    return out


def discard(*tables: DataFrame) -> None:
    """Removes written tables, once everything that reads them is written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(getattr(df, _FOLDER))
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Rows of a batch of texts that goes to a Python worker.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows, if they are larger: bounds what workers and executors hold of long texts."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str | Column) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


SPANS = "array<struct<start:int,stop:int,value:string>>"
#: Matches whose positions are summed together: keeps texts of very many matches far from quadratic work.
_PIECE = 256


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def span_arrays(text: Column, pattern: str, within: Column | None = None) -> Column:
    """Matches of a Java pattern as array<struct<start, stop, value>> in code points, leftmost first.

    The pattern may match no empty string. What lies between the matches comes from split(), the matches from
    regexp_extract_all(); lengths of both add up to the positions. Texts without a match take one search only.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.filter(F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("value"))), lambda x: x["value"].isNotNull())

    def place(piece: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast(SPANS).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            first = acc["at"] + x["gap"]
            last = first + F.length(x["value"])
            span = F.struct(first.alias("start"), last.alias("stop"), x["value"].alias("value"))
            return F.struct(last.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(piece, start, step, lambda acc: acc["out"])

    def walk(all_pairs: Column) -> Column:
        count = F.floor((F.size(all_pairs) + _PIECE - 1) / _PIECE).cast("int")
        pieces = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.slice(all_pairs, (i - 1) * _PIECE + 1, _PIECE))
        return bound(pieces, lambda ps: bound(F.transform(ps, _reach), lambda ls: F.flatten(F.transform(ps, lambda p, i: place(p, F.aggregate(F.slice(ls, F.lit(1), i), F.lit(0), lambda a, n: a + n))))))

    hit = text.rlike(pattern) if within is None else within & text.rlike(pattern)
    return F.when(hit, bound(pairs, walk)).otherwise(F.array().cast(SPANS))


def _reach(piece: Column) -> Column:
    """Code points that a piece of matches and the gaps before them cover."""
    return F.aggregate(piece, F.lit(0), lambda a, x: a + x["gap"] + F.length(x["value"]))


def uncovered(spans: DataFrame, row: str, base: str) -> DataFrame:
    """Of spans (row, start, stop, base: boolean and more): those that no base span of their row overlaps, and all base spans.

    A sort of each row's spans and running ends instead of all pairs: near linear in the spans of a row.
    """
    order = Window.partitionBy(row).orderBy("start")
    end = F.max(F.when(F.col(base), F.col("stop"))).over(order.rangeBetween(Window.unboundedPreceding, 0))
    later = F.min(F.when(F.col(base), F.col("start"))).over(order.rangeBetween(1, Window.unboundedFollowing))
    ends = spans.withColumns({"__end": end, "__later": later})
    free = (F.coalesce("__end", F.lit(-1)) <= F.col("start")) & (F.col("__later").isNull() | (F.col("__later") >= F.col("stop")))
    return ends.where(F.col(base) | free).drop("__end", "__later")
