"""Named steps that prepare cleaned observations, as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from thermocline.operators import filters
from thermocline.operators.polygons import join_polygons
from thermocline.operators.sampling import sample_grid
from thermocline.operators.summaries import years_with_enough

# Names of the steps, the essential ones in their order.
ESSENTIAL = (
    "essential_nans",
    "bleaching_nans",
    "determine_mmm",
    "filter_missing_sst_data",
    "bleach_labels",
    "years_2017",
    "years_obs_count",
)
OPTIONAL = ("remove_uncertain_bleach_presence",)


def determine_mmm(obs: DataFrame, month_of_mmm: DataFrame) -> DataFrame:
    """Adds ``mmm_i``, the warmest month at the nearest cell."""
    return sample_grid(obs, month_of_mmm, "nearest", "none", "month_of_mmm", "mmm_i")


def available_steps(
    month_of_mmm: DataFrame | None = None, polygons: DataFrame | None = None, obs_threshold: int = 100
) -> dict[str, Callable[[DataFrame], DataFrame]]:
    def with_mmm(df: DataFrame) -> DataFrame:
        if month_of_mmm is None:
            raise ValueError("This step needs the month_of_mmm field")
        return determine_mmm(df.drop("mmm_i"), month_of_mmm)

    def reef_areas(df: DataFrame) -> DataFrame:
        if polygons is None:
            raise ValueError("This step needs reef polygons")
        return join_polygons(df, polygons)

    def exposure(df: DataFrame) -> DataFrame:
        placed = df if "mmm_i" in df.columns else with_mmm(df)
        return filters.in_exposure_period(filters.drop_missing_mmm(placed))

    return {
        "essential_nans": filters.drop_missing_keys,
        "bleaching_nans": filters.drop_missing_target,
        "reef_areas": reef_areas,
        "bleach_labels": filters.with_presence,
        "remove_uncertain_bleach_presence": filters.drop_uncertain,
        "years_2017": filters.max_year,
        "years_obs_count": lambda df: years_with_enough(df, obs_threshold),
        "determine_mmm": with_mmm,
        "filter_missing_sst_data": filters.drop_missing_mmm,
        "filter_mmm_exposure_period": exposure,
    }


def prepare_observations(
    df: DataFrame,
    steps: Sequence[str] | None = OPTIONAL,
    essential: bool = True,
    month_of_mmm: DataFrame | None = None,
    polygons: DataFrame | None = None,
    obs_threshold: int = 100,
    counts: dict[str, Observation] | None = None,
) -> DataFrame:
    """Essential steps in order, then the given ones that have not run; an unknown name is an error.

    With ``counts`` given, the row count after each step is observed while the result is computed:
    ``counts[step].get["n"]`` after an action, without extra jobs.
    """
    known = available_steps(month_of_mmm, polygons, obs_threshold)
    names = list(ESSENTIAL) if essential else []
    for name in steps or ():
        if name not in known:
            raise ValueError(f"Unknown step: {name}. Available: {list(known)}")
        if name not in names or not essential:
            names.append(name)
    for name in names:
        df = df.transform(known[name])
        if counts is not None:
            counts[name] = Observation(f"{name}-{id(counts)}")
            df = df.observe(counts[name], F.count(F.lit(1)).alias("n"))
    return df
