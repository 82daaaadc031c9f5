"""HotSpots and Degree Heating Weeks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermocline.functions.dates import day_number
from thermocline.operators.climatology import CELL
from thermocline.operators.ordered import with_lead_in, with_position

# Length of a block, in accumulation windows; lead-in rows are 1 in BLOCK_WINDOWS.
BLOCK_WINDOWS = 8


def _join_field(grid: DataFrame, field: DataFrame, keys: Sequence[str], spread: Column, shards: int) -> DataFrame:
    """Grid joined to a one-row-per-cell field on the cell.

    Left unhinted: the field is broadcast if its measured size allows, and two tables stored by cell (``write_by_cell``) meet where they lie.
    Otherwise the grid is shuffled once on the cell, which also serves a later window on finer keys. Only a grid whose cells have too many
    rows for one task needs ``shards`` above 1: each cell is then dealt over so many keys by ``spread``, with as many copies of its field row.
    """
    if shards == 1:
        return grid.join(field, list(keys))
    copies = field.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    sharded = grid.withColumn("_shard", F.pmod(spread, F.lit(shards)).cast("int"))
    return sharded.join(copies, [*keys, "_shard"])


def _excess(clip: bool):
    above = F.col("sst") - F.col("mmm")
    return F.coalesce(F.when(above > 0, above), F.lit(0.0)) if clip else above


def hotspot(grid: DataFrame, field: DataFrame, keys: Sequence[str] = CELL, shards: int = 1) -> DataFrame:
    """Excess over the maximum monthly mean; negative and missing values become 0. ``shards`` as in ``_join_field``."""
    joined = _join_field(grid, field.select(*keys, "mmm"), keys, day_number(F.col("time")), shards)
    return joined.withColumn("hotspot", _excess(clip=True)).drop("_shard", "mmm")


def dhw(
    grid: DataFrame,
    field: DataFrame,
    days: int = 84,
    frame: str = "days",
    empty: str = "null",
    min_hotspot: float = 1.0,
    keys: Sequence[str] = CELL,
    shards: int = 1,
) -> DataFrame:
    """Degree Heating Weeks: HotSpots of at least ``min_hotspot`` over the last ``days`` steps, over 7.

    ``frame='days'`` counts calendar days (the published definition); ``'rows'`` counts grid rows.
    A window without a qualifying HotSpot gives NULL, or 0 with ``empty='zero'``. A cell's series is
    cut into blocks of time with a lead-in, so a window never holds more than a block; with a broadcast field, or ``shards`` above 1,
    the blocks of one long series are spread over many tasks.
    """
    if frame not in ("days", "rows"):
        raise ValueError(f"Unknown frame: {frame}")
    if empty not in ("null", "zero"):
        raise ValueError(f"Unknown empty policy: {empty}")
    if frame == "days":
        stepped = grid.withColumn("_step", day_number(F.col("time")))
    else:
        stepped = with_position(grid, keys, name="_step")
    blocks = with_lead_in(stepped, F.col("_step"), BLOCK_WINDOWS * days, days - 1)
    joined = _join_field(blocks, field.select(*keys, "mmm"), keys, F.col("_block"), shards)
    over = Window.partitionBy(*keys, *(["_shard"] if shards > 1 else []), "_block").orderBy("_step")
    over = over.rangeBetween(-(days - 1), 0) if frame == "days" else over.rowsBetween(-(days - 1), 0)
    above = _excess(clip=False)
    weeks = F.sum(F.when(above >= min_hotspot, above)).over(over) / 7.0
    if empty == "zero":
        weeks = F.coalesce(weeks, F.lit(0.0))
    return (
        joined.withColumns({"hotspot": _excess(clip=True), "dhw": weeks})
        .where("_own")
        .drop("_own", "_block", "_shard", "_step", "mmm")
    )


def latest(grid: DataFrame) -> DataFrame:
    """Rows of the last time step; the bound is a scalar subquery and reaches the scan."""
    return grid.where(F.col("time") == grid.agg(F.max("time")).scalar())
