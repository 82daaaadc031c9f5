"""Catalogue of grid files: names, dates and what is available per tile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermocline.functions.dates import base_name, file_dates, parse_date, year_in_name
from thermocline.functions.geometry import BOUNDS, patch_bounds


def scan_files(spark: SparkSession, path: str, var: str) -> DataFrame:
    """Catalogue rows of the files under a tree; only file metadata is read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"{var}_*").load(path)
        .select("path", F.col("length").alias("bytes"))
    )
    return with_file_dates(
        files.withColumns(
            {
                "var": F.lit(var),
                "patch": F.regexp_extract("path", r"(patch_[^/]*)", 1),
                "year": year_in_name(F.col("path")),
            }
        )
    )


def with_file_dates(catalogue: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``start`` and ``end`` parsed from the file name."""
    dates = file_dates(F.col(path))
    return catalogue.withColumns({"start": dates["start"], "end": dates["end"]})


def _bound(value: Column | str | int) -> Column:
    return parse_date(value if isinstance(value, Column) else F.lit(value))


def filter_files(catalogue: DataFrame, lo: Column | str | int, hi: Column | str | int) -> DataFrame:
    """Files that lie within the bounds, given in any form ``parse_date`` takes."""
    return catalogue.where((F.col("start") >= _bound(lo)) & (F.col("end") <= _bound(hi)))


def availability(catalogue: DataFrame, var: str, patches: DataFrame | None = None) -> DataFrame:
    """Bounds, sorted years and file count of each well-named tile; tiles without files keep a row."""
    files = catalogue.where(F.col("var") == var).groupBy("patch").agg(
        F.sort_array(F.collect_set("year")).alias("available_years"), F.count("*").alias("file_count")
    )
    every = (patches if patches is not None else catalogue).select("patch").distinct()
    box = patch_bounds(F.col("patch"))
    return (
        every.withColumn("_box", box).where(F.col("_box").isNotNull()).join(files, "patch", "left")
        .select(
            "patch", *[F.col(f"_box.{b}").alias(b) for b in BOUNDS],
            F.coalesce("available_years", F.array().cast("array<int>")).alias("available_years"),
            F.coalesce("file_count", F.lit(0)).alias("file_count"),
        )
    )


def file_name(path: str = "path") -> Column:
    return base_name(F.col(path))
