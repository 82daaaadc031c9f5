"""Observation, grid, polygon and region scans, and the yearly writer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermocline.functions.missing import require_columns, without_nan
from thermocline.sources.batches import BatchTable, read_table, stored

OBSERVATIONS = (
    "obs_id bigint, year int, month int, latitude double, longitude double, "
    "percent_bleached string, depth string, percent_mortality string"
)
REGIONS = "region string, seq int, lats double, lons double"


def read_observations(spark: SparkSession, path: str, schema: str = OBSERVATIONS) -> DataFrame:
    """Observation CSV with a fixed schema; dirty columns stay text."""
    return without_nan(spark.read.csv(path, header=True, schema=schema))


def read_grid(
    spark: SparkSession, path: str, years: Sequence[int] | int | None = None, patches: Sequence[str] | None = None
) -> DataFrame:
    """Daily grid of the given years and tiles (default: all), pruned by the ``patch``/``year`` folders.

    A year or tile without data contributes no rows. Of a table of finished batches, those with a record are read.
    """
    grid = without_nan(read_table(spark, path))
    if years is not None:
        grid = grid.where(F.col("year").isin(*([years] if isinstance(years, int) else years)))
    return grid if patches is None else grid.where(F.col("patch").isin(*patches))


def read_grid_by_year(
    spark: SparkSession, path: str, years: Sequence[int], patches: Sequence[str] | None = None
) -> DataFrame:
    """The same scan kept apart by its ``year`` column."""
    grid = read_grid(spark, path, years, patches)
    require_columns(grid, "year")
    return grid


def read_grid_months(
    spark: SparkSession, path: str, year: int, months: Sequence[int] | int, patches: Sequence[str] | None = None
) -> DataFrame:
    wanted = [months] if isinstance(months, int) else months
    return read_grid(spark, path, year, patches).where(F.month("time").isin(*wanted))


def write_grid(grid: DataFrame, path: str, rows_per_file: int = 20_000_000) -> None:
    """Store a grid by tile and year, sorted by cell and time so that row groups can be skipped.

    Range partitioning on the full sort key splits a tile-year of any size over several tasks.
    """
    order = [c for c in ("patch", "year", "latitude", "longitude", "time") if c in grid.columns]
    folders = [c for c in ("patch", "year") if c in grid.columns]
    (
        grid.repartitionByRange(*order).sortWithinPartitions(*order)
        .write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(*folders).parquet(path)
    )


def write_by_cell(df: DataFrame, table: str, path: str, keys: Sequence[str], buckets: int, sort: Sequence[str] = ()) -> DataFrame:
    """Store a grid or field at ``path`` in ``buckets`` files by a hash of its cell, as the session's ``table``, and return that table.

    Tables stored by the same keys and number of buckets are joined, and windows over their cells run, without moving a row.
    """
    (
        df.repartition(buckets, *keys).write.mode("overwrite").option("path", path)
        .bucketBy(buckets, *keys).sortBy(*(sort or keys)).saveAsTable(table)
    )
    return df.sparkSession.table(table)


def read_by_cell(
    spark: SparkSession, table: str, path: str, schema: str, keys: Sequence[str], buckets: int, sort: Sequence[str] = ()
) -> DataFrame:
    """A table that ``write_by_cell`` stored in another session, made known to this one."""
    names = ", ".join(f"`{c}`" for c in keys)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({schema}) USING parquet CLUSTERED BY ({names}) "
        f"SORTED BY ({', '.join(f'`{c}`' for c in (sort or keys))}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(table)


def write_missing_years(df: DataFrame, path: str) -> None:
    """Add the years of ``df`` that the table at ``path`` does not hold yet.

    A year counts as held once the batch it came with is recorded (``BatchTable``), so a write that ended half-way is done
    again. If another writer records a year first, its rows stand. Rows without a year are a year of their own.
    """
    spark = df.sparkSession
    table = BatchTable(spark, path)
    seen = table.records()
    if not seen and stored(spark, path) is not None:
        raise ValueError(f"{path} holds a table without records; give a new path and add its rows there")
    held = {y for r in seen for y in r["years"]}
    known = F.col("year").isin(*(held - {None})) | F.lit(None in held) & F.col("year").isNull()
    name = table.stage(df.where(~F.coalesce(known, F.lit(False))), by_year=True)
    staged = table.staged(name)
    if staged is None:
        return

    def others_first(record: dict, newer: list) -> dict | None:
        own = [y for y in record["years"] if all(y not in r["years"] for r in newer)]
        return {**record, "years": own} if own else None

    years = [r["year"] for r in staged.select("year").distinct().collect()]
    table.commit({"rows": name, "years": years, "replaces": False}, seen, others_first)


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Vertex table (polygon_id, ring_id, seq, lon, lat)."""
    vertices = without_nan(spark.read.parquet(path))
    require_columns(vertices, "polygon_id", "ring_id", "seq", "lon", "lat")
    return vertices


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    return without_nan(spark.read.csv(path, header=True, schema=REGIONS))
