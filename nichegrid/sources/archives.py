"""Downloaded occurrence archives (ZIP with one tab-separated table) to parquet."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichegrid.functions.geo import archive_coordinates
from nichegrid.session import scratch_path

_CHUNK_LINES = 50_000


def _table_member(archive: zipfile.ZipFile) -> str:
    for name in archive.namelist():
        if name.endswith((".tsv", ".csv")):
            return name
    raise ValueError("the archive holds no table (.tsv or .csv)")


def _open_table(content: pa.Buffer) -> io.TextIOWrapper:
    archive = zipfile.ZipFile(pa.BufferReader(content))
    return io.TextIOWrapper(archive.open(_table_member(archive)), encoding="utf-8-sig", newline="")


def read_archives(
    spark: SparkSession, path: str, headers: Sequence[str] | None = None
) -> DataFrame:
    """All archives of a folder as one table of text columns."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return table_of_archives(files, headers)


def _lines(batches: Iterator[pa.RecordBatch], headers: Sequence[str] | None) -> Iterator[pa.RecordBatch]:
    """``header, line`` of every line of every archive, some thousand at a time."""
    for batch in batches:
        for content in batch.column(0):
            table = _open_table(content.as_buffer())
            header = table.readline().rstrip("\r\n")
            if headers is not None and header not in headers:
                raise ValueError(f"unexpected header: {header}")
            while chunk := [line.rstrip("\r\n") for _, line in zip(range(_CHUNK_LINES), table)]:
                kept = [line for line in chunk if line]
                yield pa.RecordBatch.from_pydict({"header": pa.array([header] * len(kept), pa.string()), "line": pa.array(kept, pa.string())})
            # an archive without a line still has its columns
            yield pa.RecordBatch.from_pydict({"header": pa.array([header]), "line": pa.array([None], pa.string())})


def table_of_archives(files: DataFrame, headers: Sequence[str] | None = None) -> DataFrame:
    """The same for a table with the archives' bytes in ``content``.

    Every archive is opened once: it is decompressed as a stream, in one task, since a ZIP member cannot be
    split, and its lines are written to the shared folder by layout. Layouts are resolved on what was
    written: each is a folder of its own that Spark parses with the columns of its header, spread over
    tasks. Extracted tables need none of this: see :func:`read_tables`. With ``headers`` a line under any
    other header is an error.
    """
    known = list(headers) if headers is not None else None
    rows = files.mapInArrow(lambda batches: _lines(batches, known), "header string, line string")
    path = scratch_path(files.sparkSession, "archive-lines")
    rows.withColumn("layout", F.md5("header")).write.partitionBy("layout").parquet(path)
    stored = files.sparkSession.read.schema("header string, line string, layout string").parquet(path)
    layouts = stored.groupBy("layout").agg(F.first("header").alias("header")).collect()  # one row per layout
    if not layouts:
        raise ValueError("no archive found")
    out = None
    for layout in sorted(layouts, key=lambda r: r["header"]):
        names = [c.replace("`", "``") for c in layout["header"].split("\t")]
        schema = ", ".join(f"`{c}` string" for c in names)
        lines = stored.where((F.col("layout") == layout["layout"]) & F.col("line").isNotNull())
        parsed = lines.select(F.from_csv("line", schema, {"sep": "\t"}).alias("r")).select("r.*")
        out = parsed if out is None else out.unionByName(parsed, allowMissingColumns=True)
    return out


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """Extracted tab-separated tables: splittable, one scan, no inference."""
    return spark.read.option("header", "true").option("sep", "\t").csv(path)


def standardise(table: DataFrame) -> DataFrame:
    """Canonical coordinate, species and year columns; the other columns stay."""
    lon, lat = archive_coordinates(table.columns)
    out = table.withColumnsRenamed({lon: "decimalLongitude", lat: "decimalLatitude"})
    if "species" not in out.columns and "scientificName" in out.columns:
        out = out.withColumn("species", F.col("scientificName"))
    year = F.col("year").try_cast("double").try_cast("long") if "year" in out.columns else F.lit(None).cast("long")
    return out.withColumns(
        {
            "decimalLongitude": F.col("decimalLongitude").try_cast("double"),
            "decimalLatitude": F.col("decimalLatitude").try_cast("double"),
            "year": year,
        }
    )


def ensure_ingested(spark: SparkSession, source: str, target: str, zipped: bool = True) -> DataFrame:
    """The dataset as parquet, built on first use; an existing one is read as it is."""
    try:
        return spark.read.parquet(target)
    except AnalysisException:  # not there, or never finished
        pass
    try:
        table = read_archives(spark, source) if zipped else read_tables(spark, source)
        standardise(table).write.mode("overwrite").parquet(target)
    except Exception as error:
        raise ValueError(f"{source} could not be ingested: {error}") from error
    return spark.read.parquet(target)
