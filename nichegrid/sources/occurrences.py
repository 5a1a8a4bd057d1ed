"""Occurrence records: scans, schema fallbacks and name suggestions.

Input is a table of published records, on disk or derived: ``species`` and/or
``scientificName``, ``year``, ``month``, ``decimalLongitude``, ``decimalLatitude``,
``countryCode``, ``hasCoordinate``, ``basisOfRecord`` and a unique ``key``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nichegrid.config import check_mode
from nichegrid.session import cut_lineage

# Record limits and the basis of record of the interactive scans.
EXPLORE_LIMIT = 300
OBSERVATION_LIMIT = 10000
SUGGESTION_LIMIT = 5
SUGGESTION_MIN_CHARS = 2
BASIS = "HUMAN_OBSERVATION"

PRESENCE_SCHEMA = "species string, year int, lon double, lat double"


def empty_presences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], PRESENCE_SCHEMA)


def _name_column(df: DataFrame) -> str:
    return "species" if "species" in df.columns else "scientificName"


def _observed(records: DataFrame, species: str, country: str) -> DataFrame:
    return records.where(
        (F.col(_name_column(records)) == species)
        & (F.col("countryCode") == country)
        & F.col("hasCoordinate")
        & (F.col("basisOfRecord") == BASIS)
    )


def _years(start: int, end: int) -> Column:
    return F.col("year").between(start, end)


def records_table(records: DataFrame, query: str, carry: Sequence[str] = ()) -> DataFrame:
    """Standard presence columns, after those in ``carry`` as they are. A missing ``species`` column (not a missing value) is taken
    from ``scientificName``, else from the text that was searched for."""
    if "species" in records.columns:
        species = F.col("species")
    elif "scientificName" in records.columns:
        species = F.col("scientificName")
    else:
        species = F.lit(query)
    out = records.select(
        *carry,
        species.alias("species"),
        F.col("year"),
        F.col("decimalLongitude").cast("double").alias("lon"),
        F.col("decimalLatitude").cast("double").alias("lat"),
    )
    return cleanup(out, (*carry, "year", "lon", "lat"))


def cleanup(df: DataFrame, keep: tuple[str, ...] = ("year", "lon", "lat")) -> DataFrame:
    """Every column to text, except the year and the coordinates. NULL stays NULL."""
    return df.select(
        *[
            F.col("year").try_cast("int").alias("year")
            if c == "year"
            else (F.col(c) if c in keep else F.col(c).cast("string").alias(c))
            for c in df.columns
        ]
    )


def explore(
    records: DataFrame,
    species: str,
    country: str,
    year_start: int,
    year_end: int,
    limit: int | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """A quick look: the first ``limit`` matching records by key, or all of them."""
    found = _observed(records, species, country).where(_years(year_start, year_end))
    return records_table(found if limit is None else found.orderBy("key").limit(limit), species, carry)


def deepdive(
    records: DataFrame, species: str, country: str, year_start: int, year_end: int, carry: Sequence[str] = ()
) -> DataFrame:
    """Every matching record. On a table partitioned by year only those years are read."""
    found = _observed(records, species, country).where(_years(year_start, year_end))
    return records_table(found, species, carry)


def read_by_year(spark: SparkSession, path: str) -> DataFrame:
    """A record table partitioned by year. An unreadable file is an error; see :func:`year_status`."""
    return spark.read.parquet(path)


def _file_status(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``year, n, failure`` of every file: its rows, or why it cannot be read. Every page of every column is read."""
    for batch in batches:
        counts, failures = [], []
        for path, content in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            n, failure = 0, None
            try:
                table = pq.ParquetFile(pa.BufferReader(content.as_buffer()))
                for rows in table.iter_batches(1 << 14):
                    n += rows.num_rows
            except Exception as error:  # noqa: BLE001
                failure = f"{path.rsplit('/', 1)[-1]}: {str(error).splitlines()[0] if str(error) else type(error).__name__}"
            counts.append(None if failure else n)
            failures.append(failure)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(failures, pa.string())],
            names=["year", "n", "failure"],
        )


def year_status(spark: SparkSession, path: str) -> DataFrame:
    """``year, n, status``: the records of every year of a table partitioned by year, or why it cannot be read.

    The year of records without one is NULL. One job reads every file on its own, so any number of years
    side by side, and a file that fails touches no other year. Spark lists and opens the files; a task holds
    as many of them as fit a scan partition, or one larger one.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    if "year" not in files.columns:
        raise ValueError(f"{path} is not partitioned by year")
    read = files.select(F.col("year").cast("long").alias("year"), "path", "content").mapInArrow(
        _file_status, "year long, n long, failure string"
    )
    failure = F.min("failure")
    return read.groupBy("year").agg(
        F.when(failure.isNull(), F.sum("n")).alias("n"),
        F.when(failure.isNull(), F.lit("read")).otherwise(F.concat(F.lit("failed: "), failure)).alias("status"),
    )


def read_readable(spark: SparkSession, path: str, schema: str | StructType) -> tuple[DataFrame, DataFrame]:
    """The records of all years that can be read, and the status of every year.

    Years that failed are pruned by their partition, so none of their files is opened. ``schema`` is that of
    the records, so that no damaged file is asked for it.
    """
    status = cut_lineage(year_status(spark, path))
    good = [r["year"] for r in status.where("status = 'read'").select("year").collect()]  # a row per year
    wanted = F.col("year").isin([y for y in good if y is not None])
    if None in good:
        wanted = wanted | F.col("year").isNull()
    return spark.read.schema(schema).parquet(path).where(wanted), status


def write_by_year(records: DataFrame, path: str) -> None:
    """Store records for year-pruned scans; an existing table is left as it is.

    Rows are rebalanced by year: a crowded year is written by as many tasks as its size asks for.
    """
    (
        records.hint("rebalance", F.col("year"))
        .write.mode("ignore")
        .partitionBy("year")
        .parquet(path)
    )


def records_per_year(records: DataFrame) -> DataFrame:
    return records.groupBy("year").agg(F.count("*").alias("n"))


def own(
    dataset: DataFrame, species: str, year_start: int, year_end: int, carry: Sequence[str] = ()
) -> DataFrame:
    """Records whose name contains the text, ignoring case, in the year range.

    ``%`` and ``_`` in the text are ordinary characters. A record without a year never matches.
    """
    name = F.lower(F.col(_name_column(dataset)))
    found = dataset.where(name.contains(species.lower()) & _years(year_start, year_end))
    return records_table(found, species, carry)


def fetch_presences(
    mode: str,
    records: DataFrame,
    species: str,
    country: str,
    year_start: int,
    year_end: int,
    dataset_key: str = "",
    limit: int | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Presences by data mode; a wrong mode or a missing key fails before any job.

    ``limit`` cuts the quick look only, ``carry`` names columns of the records to keep.
    """
    check_mode(mode, dataset_key)
    if mode == "explore":
        return explore(records, species, country, year_start, year_end, limit, carry)
    if mode == "deepdive":
        return deepdive(records, species, country, year_start, year_end, carry)
    return own(records, species, year_start, year_end, carry)


def observations(
    records: DataFrame, species: str, country: str, limit: int | None = None
) -> DataFrame | None:
    """Observations of a species in a country, any year; ``None`` when there are none."""
    found = _observed(records, species, country)
    found = (found if limit is None else found.orderBy("key").limit(limit)).select(
        F.col(_name_column(records)).alias("species"),
        "year",
        "month",
        F.col("decimalLongitude").alias("lon"),
        F.col("decimalLatitude").alias("lat"),
    )
    return None if found.isEmpty() else found


def query(records: DataFrame, sql: str, args: Mapping[str, object] | None = None) -> DataFrame:
    """SQL over the records as table ``occurrence``; values go in as ``:name`` parameters.

    The name holds inside this text only. Rows without a coordinate (``long``, ``lat``) are dropped
    from the result.
    """
    body = sql.strip().rstrip(";").replace("{", "{{").replace("}", "}}")
    text = f"with occurrence as (select * from {{records}}) select * from ({body})"
    out = records.sparkSession.sql(text, args=dict(args or {}), records=records)
    return out.dropna(subset=[c for c in ("long", "lat") if c in out.columns])


def suggest(taxa: DataFrame, text: str, limit: int = SUGGESTION_LIMIT) -> DataFrame:
    """Names that start with the text (at least two characters), in order, a few at most."""
    name = F.coalesce(
        *[F.nullif(F.col(c), F.lit("")) for c in ("canonicalName", "scientificName") if c in taxa.columns]
    )
    hits = taxa.select(name.alias("name"))
    if len(text) < SUGGESTION_MIN_CHARS:
        return hits.limit(0)
    return (
        hits.where(F.lower("name").startswith(text.lower())).distinct().orderBy("name").limit(limit)
    )
