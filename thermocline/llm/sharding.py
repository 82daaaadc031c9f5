"""Contiguous shards of nearly equal bytes, by global prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermocline.llm.common import prefix_sums


def balanced_shards(rows: DataFrame, n_shards: int, size: str = "size", order: Sequence[Column] | None = None) -> DataFrame:
    """Adds ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (0, 1, ... inside a shard) to ``rows``.

    Rows stand in ``order`` (``doc_id`` by default, nulls last, equal rows in input order). A row belongs to the
    shard in whose equal share of all bytes its middle byte lies, so shards are contiguous and each cut is off by
    at most half a row. Equal texts are not held together: a group of copies may be larger than a shard.
    Sizes must not be negative; if all are 0, every row is in shard 0. An empty table gives no rows. A shard may stay empty
    where a single row is larger than a share. Pass only the columns that are wanted; texts need not travel.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    placed = prefix_sums(rows, order or [F.col("doc_id")], size, "shards")
    middle = 2 * F.col("_start") + F.col(size)
    share = F.floor(middle.cast("double") * n_shards / F.nullif(2 * F.col("_total"), F.lit(0)))
    placed = placed.withColumn("shard", F.coalesce(F.least(share, F.lit(n_shards - 1)), F.lit(0)).cast("int"))
    # One row per shard, so this side is bounded by n_shards.
    firsts = F.broadcast(placed.groupBy("shard").agg(F.min("_index").alias("_first")))
    return (
        placed.join(firsts, "shard")
        .withColumn("slot", F.col("_index") - F.col("_first"))
        .drop("_start", "_index", "_total", "_first")
    )


def document_shards(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """``doc_id``, ``size`` (UTF-8 bytes plus 1; 1 for a null text), ``text_crc32`` (0 for null), ``shard``, ``slot``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    return balanced_shards(rows, n_shards)
