"""From a daily grid to climatology, warmest month and Degree Heating Weeks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from thermocline.operators.climatology import (
    BASE_PERIOD,
    CELL,
    epoch_midpoint,
    monthly_means,
    predict_climatology,
    regress_climatology,
    static_fields,
)
from thermocline.operators.heat import dhw


def climatology(
    grid: DataFrame, keys: Sequence[str] = CELL, years: Sequence[int] | None = BASE_PERIOD,
    target: float | None = None, nan_policy: str = "pairwise",
) -> DataFrame:
    """Slope, intercept and prediction per cell and month; ``years`` of None uses all the grid's years."""
    monthly = monthly_means(grid, keys)
    if years is not None:
        monthly = monthly.where(monthly["year"].between(*years))
    lines = regress_climatology(monthly, nan_policy, keys)
    return predict_climatology(lines, epoch_midpoint() if target is None else target)


def warmest_month(grid: DataFrame, keys: Sequence[str] = CELL, **settings) -> DataFrame:
    """Static fields ``mmm`` and ``month_of_mmm`` per cell."""
    return static_fields(climatology(grid, keys, **settings), keys)


def degree_heating_weeks(grid: DataFrame, keys: Sequence[str] = CELL, frame: str = "days", empty: str = "null", **settings) -> DataFrame:
    """Daily HotSpots and DHW of each cell. Slice the result, not the grid, to keep full windows."""
    return dhw(grid, warmest_month(grid, keys, **settings), frame=frame, empty=empty, keys=keys)
