"""Helpers shared by the corpus operators: stored tables, global prefix sums, words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermocline.session import shared_folder

# Fixed value: the white space that separates words (space, tab to carriage return).
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Words of a text (none for null), split at ASCII white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hashed_unit(*parts: Column, seed: int) -> Column:
    """A number in (0, 1] that depends on the parts alone: the first 48 bits of an MD5."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 1.0) / float(1 << 48)


def prefix_sums(rows: DataFrame, order: Sequence[Column], value: str, label: str) -> DataFrame:
    """Adds ``_start`` (sum of ``value`` over all rows before), ``_index`` (their number) and ``_total``.

    Rows are dealt out by ranges of ``order`` and written once, so the ranges stay fixed; sums then run inside
    each range and start from the totals of the ranges before. A single task only sees one row per range.
    Equal rows are told apart by their place in the input, so a repeated key is spread like any other.
    """
    keyed = rows.withColumn("_tie", F.monotonically_increasing_id())
    for k, column in enumerate(order):
        keyed = keyed.withColumn(f"_o{k}", column)
    by = [F.col(f"_o{k}").asc_nulls_last() for k in range(len(order))] + [F.col("_tie").asc()]
    ranged = stored(keyed.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), label)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"), F.count("*").alias("_rows")).select(
        "_part",
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_sum").over(whole).alias("_total"),
    )
    inside = Window.partitionBy("_part").orderBy(*by)
    return (
        ranged.withColumns(
            {
                "_run": F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                "_nth": F.row_number().over(inside).cast("long") - 1,
            }
        )
        .join(offsets, "_part")
        .withColumns({"_start": F.col("_sum_before") + F.col("_run"), "_index": F.col("_rows_before") + F.col("_nth")})
        .drop("_part", "_tie", "_run", "_nth", "_sum_before", "_rows_before", *[f"_o{k}" for k in range(len(order))])
    )
