"""Order-dependent work on long keys, split so that no key is sorted in one task.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. Here a key is cut into slabs
first; only per-slab totals, which are few, pass through a window over the whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermocline.functions.dates import day_number
from thermocline.functions.lookup import count_at_most

SLAB_DAYS = 366
SCORE_SLABS = 256


def position_in_slabs(
    df: DataFrame, keys: Sequence[str], slab: Column, order: Sequence[Column], name: str, total: str = "_total"
) -> DataFrame:
    """1-based rank of each row in its key, and the key's row count as ``total``.

    ``slab`` must be non-decreasing in ``order``; keys must not be NULL.
    """
    cut = df.withColumn("_slab", slab)
    by = [*keys, "_slab"]
    earlier = Window.partitionBy(*keys).orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        cut.groupBy(*by)
        .agg(F.count("*").alias("_n"))
        .select(
            *by,
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_n").over(Window.partitionBy(*keys)).alias(total),
        )
    )
    inside = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return cut.join(before, by).withColumn(name, F.col("_before") + inside).drop("_slab", "_before")


def with_position(df: DataFrame, keys: Sequence[str], time: str = "time", name: str = "position") -> DataFrame:
    """0-based index of each row along its key's time axis."""
    slab = F.floor(day_number(F.col(time)) / SLAB_DAYS)
    return position_in_slabs(df, keys, slab, [F.col(time)], name).withColumn(name, F.col(name) - 1).drop("_total")


def with_lead_in(df: DataFrame, step: Column, size: int, lead: int) -> DataFrame:
    """Cut rows into blocks of ``size`` steps; the last ``lead`` steps also open the next block.

    Adds ``_block`` and ``_own`` (false for the lead-in copies, to be dropped after the window).
    """
    if lead > size:
        raise ValueError(f"lead-in of {lead} steps does not fit into blocks of {size}")
    own = F.floor(step / size)
    blocks = F.when(F.pmod(step, F.lit(size)) >= size - lead, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumns({"_home": own, "_block": F.explode(blocks)}).withColumn(
        "_own", F.col("_home") == F.col("_block")
    ).drop("_home")


def running_totals(
    df: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = (), slabs: int = SCORE_SLABS
) -> DataFrame:
    """Totals of ``sums`` over all rows of the group with a higher ``order`` value, and group totals.

    Adds ``before_<c>`` and ``total_<c>``. ``order`` must be unique in its group (aggregate first);
    group columns must not be NULL.
    Slab limits are quantiles of each group's own ``order`` values, from a sketch that merges over tasks, so the slabs of every group are even
    whatever its range; a group's limits are joined to its rows.
    """
    shares = F.array(*[F.lit(i / slabs) for i in range(1, slabs)])
    keys = list(by) or ["_all"]
    grouped = df if by else df.withColumn("_all", F.lit(0))
    limits = grouped.groupBy(*keys).agg(F.percentile_approx(order, shares, 10 * slabs).alias("_limits"))
    cut = grouped.join(limits, keys).withColumn("_slab", count_at_most(F.col("_limits"), F.col(order))).drop("_limits")
    cut = cut if by else cut.drop("_all")
    group = [*by, "_slab"]
    whole = Window.partitionBy(*by)
    higher = whole.orderBy(F.desc("_slab")).rowsBetween(Window.unboundedPreceding, -1)
    slab_sums = cut.groupBy(*group).agg(*[F.sum(c).alias(c) for c in sums])
    offsets = slab_sums.select(
        *group,
        *[F.coalesce(F.sum(c).over(higher), F.lit(0)).alias(f"_higher_{c}") for c in sums],
        *[F.sum(c).over(whole).alias(f"total_{c}") for c in sums],
    )
    inside = Window.partitionBy(*group).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.join(offsets, group)
    return joined.withColumns(
        {f"before_{c}": F.col(f"_higher_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums}
    ).drop("_slab", *[f"_higher_{c}" for c in sums])
