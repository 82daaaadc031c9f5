"""Full comparison: series features, models, scores on the held-out split, saved results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermocline.operators.evaluation import average_precision, log_loss, pr_curve, ranked_scores, roc_curve
from thermocline.operators.features import observation_features
from thermocline.operators.filters import drop_empty_series, valid_rows
from thermocline.operators.models import (
    MODEL_TYPES,
    fit_with_patience,
    model_metrics,
    predict,
    sequence_classifier,
    spread,
    train_models,
    with_vector,
    written,
)
from thermocline.operators.sampling import axes_of, nearest_cells
from thermocline.operators.series import series_for, to_sequence
from thermocline.operators.split import sample_rows, stratified_split
from thermocline.session import together
from thermocline.sources.results import save_results
from thermocline.sources.store import FeatureStore, SeriesStore, store_key

SCORED = ("obs_id", "model", "label", "score", "prediction")


def stored_features(
    obs: DataFrame, grid: DataFrame, store: FeatureStore, days_before: int = 365, force: bool = False,
    axes: DataFrame | None = None, years_of_tile: DataFrame | None = None, retry_failed: bool = False,
) -> DataFrame:
    """Features of valid observations through the store: only new ones are computed.

    ``axes`` and ``years_of_tile`` as in ``series_for``. Ids that gave no row are tried again with ``retry_failed``, say after
    the grid has grown.
    """
    return store.compute(
        valid_rows(obs),
        lambda new: observation_features(new, grid, days_before, axes=axes, years_of_tile=years_of_tile),
        force, retry_failed,
    )


def window_key(obs: DataFrame, label: str = "bleach_presence", **config) -> str:
    """Store key of the configuration and of the observations' place, date and label."""
    return store_key({"label": label, **config}, obs.withColumn("bleach_presence", F.col(label))).first()[0]


def train_sequence_model(
    obs: DataFrame, grid: DataFrame, store: SeriesStore, days_before: int = 31, test: float = 0.2,
    val: float = 0.2, seed: int = 42, label: str = "bleach_presence",
    axes: DataFrame | None = None, years_of_tile: DataFrame | None = None,
):
    """Network on fixed-length series, fitted until its validation loss no longer falls. Returns the model of the least one, scored
    test rows, and loss and accuracy on the validation and test splits."""
    length = days_before + 1
    sequences = store.compute(
        valid_rows(obs),
        lambda new: drop_empty_series(
            series_for(new, grid, days_before, axes=axes, years_of_tile=years_of_tile).dropna(subset=["series"])
        ),
        read=lambda stored: to_sequence(stored, length).drop("series"),
    )
    rows = with_vector(sequences).drop("sequence").withColumn("label", F.col(label).cast("double"))
    parts = written(spread(stratified_split(rows, label, test, val, seed)), "split", ["split"])
    model, _ = fit_with_patience(
        sequence_classifier(length), parts.where(F.col("split") == "train").select("features", "label"), parts.where(F.col("split") == "val")
    )
    judged = predict(model, parts.where(F.col("split") != "train")).withColumn("label", F.col(label).cast("int"))
    return model, judged.where(F.col("split") == "test"), log_loss(judged, ["split"])


def compare_models(
    obs: DataFrame, grid: DataFrame, folder: str, types: Sequence[str] = MODEL_TYPES, days_before: int = 365,
    max_rows: int | None = None, test: float = 0.2, seed: int = 42, with_network: bool = True,
    label: str = "bleach_presence", grid_name: str = "grid", axes: DataFrame | None = None,
    years_of_tile: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Train and score every model on one split, write results under ``folder`` and return them.

    Stored features are kept by grid name, window, method, gate, label and observations, so a change in any of them
    computes anew. ``grid_name`` tells grids (their address and variable) apart. ``axes`` and ``years_of_tile`` as in ``series_for``.
    """
    spark = obs.sparkSession
    # Observations, axes and cells are asked for several times: made once, and what follows is spread over all cores.
    chosen, axes = together(
        spark,
        [
            lambda: written(spread(sample_rows(valid_rows(obs), max_rows, seed)), "chosen"),
            lambda: written(axes_of(grid), "axes") if axes is None else axes,
        ],
    )
    key, placed = together(
        spark,
        [
            lambda: window_key(
                chosen, label, grid=grid_name, window_days=days_before, method="nearest", gated=years_of_tile is not None
            ),
            lambda: written(nearest_cells(chosen, axes), "placed"),
        ],
    )

    def on_features() -> DataFrame:
        store = FeatureStore(spark, f"{folder}/features", key)
        features = stored_features(placed, grid, store, days_before, axes=axes, years_of_tile=years_of_tile)
        _, scored = train_models(features, types, label, test, seed)
        return written(scored, "scored")

    def on_series() -> DataFrame:
        store = SeriesStore(spark, f"{folder}/series", key)
        _, judged, _ = train_sequence_model(
            placed, grid, store, days_before, test, seed=seed, label=label, axes=axes, years_of_tile=years_of_tile
        )
        return written(judged.withColumn("model", F.lit("network")).select(*SCORED), "scored")

    # Scores feed several tables: write them once and read them back. So are their ranks.
    scored = reduce(DataFrame.unionByName, together(spark, [on_features, *([on_series] if with_network else [])]))
    scored.write.mode("overwrite").parquet(f"{folder}/scored")
    scored = spark.read.parquet(f"{folder}/scored")
    ranked = written(ranked_scores(scored, ["model"]), "ranked")
    frames = {
        **model_metrics(scored, ranked),
        "average_precision": average_precision(scored, ["model"], ranked),
        "roc_curve": roc_curve(scored, ["model"], ranked),
        "pr_curve": pr_curve(scored, ["model"], ranked),
    }
    save_results(frames, folder)
    return {name: spark.read.schema(frame.schema).json(f"{folder}/{name}") for name, frame in frames.items()}
