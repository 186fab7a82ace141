"""Files written from rows: a Spark sink of whole files in pieces, and rasters as PPM and RGB565 files.

A task gets the pieces of its files in order and appends them, so a file may be larger than any row. It writes under hidden
names and gives the files their own only when it has all; what a failed task or job has written is removed.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from reelspark.functions import raster
from reelspark.sources.ranged import place

#: By application, the folder of local sessions that name none.
_UNSET: dict[str, str] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; only a local session may leave that unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _UNSET.get(app) or _UNSET.setdefault(app, tempfile.mkdtemp(prefix="reelspark-"))
    return f"{found.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@dataclass
class Written(WriterCommitMessage):
    """The files of a task."""

    names: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, at = place(self.path)
        fs.create_dir(at, recursive=True)
        attempt, names, moved, out = uuid.uuid4().hex, [], [], None
        hidden = lambda n: f"{at}/.{n}.{attempt}"
        try:
            for batch in iterator:
                for name, piece in zip(batch.column("name").to_pylist(), batch.column("piece"), strict=True):
                    if not names or name != names[-1]:
                        if out:
                            out.close()
                        if not name or "/" in name or name in names[-1:]:
                            raise ValueError(f"no name of a file: {name!r}")
                        names.append(name)
                        out = fs.open_output_stream(hidden(name))
                    if piece.is_valid:
                        out.write(piece.as_buffer())
            if out:
                out.close()
            if len(set(names)) < len(names):
                raise ValueError("pieces of a file do not stand together")
            for n in names:
                fs.move(hidden(n), f"{at}/{n}")
                moved.append(f"{at}/{n}")
        except BaseException:
            if out and not out.closed:
                out.close()
            _remove(fs, [*map(hidden, set(names)), *moved])
            raise
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = place(self.path)
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/_SUCCESS") as f:
            f.write(str(sum(len(m.names) for m in messages if m)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = place(self.path)
        _remove(fs, [f"{at}/{n}" for m in messages if m for n in m.names])


def _remove(fs: pafs.FileSystem, paths: list[str]) -> None:
    for info in fs.get_file_info(paths):
        if info.type == pafs.FileType.File:
            fs.delete_file(info.path)


class ObjectFiles(DataSource):
    """df.write.format("object_files").mode("append").save(folder): rows (name, piece: binary), a file's pieces together and in order.

    A null piece adds nothing, so a file may be empty. Files of the same name are replaced; others stay.
    """

    @classmethod
    def name(cls) -> str:
        return "object_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("object files are written with mode append")
        return _Writer(self.options["path"])


def write_files(pieces: DataFrame, path: str) -> None:
    """Writes pieces (name, at, piece), each file's in order of at. Files are dealt to tasks by name."""
    pieces.sparkSession.dataSource.register(ObjectFiles)
    in_order = pieces.repartition("name").sortWithinPartitions("name", "at").select("name", "piece")
    in_order.write.format("object_files").mode("append").save(path)


def _byte(value) -> F.Column:
    return F.lpad(F.hex(value.cast("bigint")), 2, "0")


def raster_pieces(pixels: DataFrame, how: str) -> DataFrame:
    """(name, at, piece) of the files of images, from pixels (img, x, y, r, g, b): how is 'ppm' or 'rgb565'.

    A piece is a line; PPM files have a header first, RGB565 files are little-endian 16-bit values, and their names
    tell width and height. Every pixel must be there once.
    """
    if how == "ppm":
        code, suffix = F.concat(_byte(F.col("r")), _byte(F.col("g")), _byte(F.col("b"))), F.lit(".ppm")
    elif how == "rgb565":
        v = raster.rgb565(F.col("r"), F.col("g"), F.col("b"))
        code, suffix = F.concat(_byte(v.bitwiseAND(255)), _byte(F.shiftright(v, 8))), F.concat(F.lit("_"), "w", F.lit("x"), "h", F.lit(".rgb565"))
    else:
        raise ValueError("rasters are written as ppm or rgb565")
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", code.alias("code")))), lambda p: p["code"]), "")
    lines = pixels.groupBy("img", "y").agg(F.unhex(line).alias("piece"), (F.max("x") + 1).alias("w"))
    sizes = lines.groupBy("img").agg(F.max("w").alias("w"), (F.max("y") + 1).alias("h"))
    named = lines.drop("w").join(sizes, "img").select(F.concat(F.col("img").cast("string"), suffix).alias("name"), F.col("y").cast("bigint").alias("at"), "piece")
    if how == "rgb565":
        return named
    head = F.encode(F.concat(F.lit("P6\n"), "w", F.lit(" "), "h", F.lit("\n255\n")), "UTF-8")
    return named.union(sizes.select(F.concat(F.col("img").cast("string"), suffix), F.lit(-1).cast("bigint"), head))


def write_rasters(pixels: DataFrame, path: str, how: str) -> None:
    write_files(raster_pieces(pixels, how), path)


def read_rasters(spark: SparkSession, path: str, how: str) -> DataFrame:
    """What write_rasters() wrote: (img, x, y, r, g, b) of PPM files, (img, x, y, rgb565) of RGB565 files; img is the name without its end."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{how}").load(path)
    base = F.regexp_extract("path", r"([^/]+)\.\w+$", 1)
    if how == "ppm":
        # Sizes stand in the first bytes; the header ends after the third line.
        start = F.decode(F.substring("content", 1, 40), "ISO-8859-1")
        head = F.regexp_extract(start, r"^P6\n([0-9]+) ([0-9]+)\n255\n", 0)
        part = lambda k: F.regexp_extract(start, r"^P6\n([0-9]+) ([0-9]+)\n255\n", k).cast("int")
        x = files.where(head != "").select(base.alias("img"), part(1).alias("w"), part(2).alias("h"), F.length(head).alias("skip"), "content")
        size = 3
    else:
        part = lambda k: F.regexp_extract("name", r"^(.*)_([0-9]+)x([0-9]+)$", k)
        x = files.select(base.alias("name"), "content").select(part(1).alias("img"), part(2).cast("int").alias("w"), part(3).cast("int").alias("h"), F.lit(0).alias("skip"), "content")
        size = 2
    lines = x.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    lines = lines.select("img", "y", "w", F.substring("content", F.col("skip") + F.col("y") * F.col("w") * size + 1, F.col("w") * size).alias("line"))
    each = lines.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    byte = lambda k: F.conv(F.hex(F.substring("line", F.col("x") * size + k + 1, F.lit(1))), 16, 10).cast("int")
    if how == "ppm":
        return each.select("img", "x", "y", byte(0).alias("r"), byte(1).alias("g"), byte(2).alias("b"))
    return each.select("img", "x", "y", (byte(0) + byte(1) * 256).alias("rgb565"))
