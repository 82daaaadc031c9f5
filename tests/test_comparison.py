"""The comparison of models: shared work is done once, independent parts at the same time, and what is returned is what was saved."""

import threading

import pytest
from pyspark.sql import functions as F

from thermocline.operators import evaluation, features, models, sampling, series
from thermocline.plans import comparison
from thermocline.session import together


@pytest.fixture(scope="module")
def grid(spark):
    return spark.range(3 * 60).selectExpr(
        "timestampadd(DAY, cast(id div 3 as int), timestamp_ntz'2000-01-01') as time", "cast(id % 3 as double) as latitude",
        "10.0D as longitude", "2000 as year", "20.0D + id % 7 as sst",
    )


@pytest.fixture(scope="module")
def obs(spark):
    return spark.range(90).selectExpr(
        "id as obs_id", "(id % 3) + 0.2D as latitude", "10.3D as longitude", "date_add(date'2000-01-20', cast(id % 30 as int)) as date",
        "cast(id % 2 as int) as bleach_presence",
    )


def test_observations_are_made_once_and_saved_frames_are_returned(spark, grid, obs, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    folder = str(tmp_path / "c")
    frames = comparison.compare_models(obs.mapInArrow(counted, obs.schema), grid, folder, ("logistic",), days_before=10, with_network=False)
    assert seen.value == 90
    assert {"summary", "confusion_matrix", "classification_report", "average_precision", "roc_curve", "pr_curve"} == set(frames)
    for name, frame in frames.items():
        assert all(f"/c/{name}/" in file for file in frame.inputFiles()) and frame.count() > 0
    scored = spark.read.parquet(f"{folder}/scored")
    assert scored.count() == 18 and set(scored.columns) == set(comparison.SCORED)
    for name, want in models.model_metrics(scored).items():
        assert frames[name].columns == want.columns and frames[name].exceptAll(want).count() == want.exceptAll(frames[name]).count() == 0
    want = evaluation.roc_curve(scored, ["model"])
    assert frames["roc_curve"].exceptAll(want).count() == want.exceptAll(frames["roc_curve"]).count() == 0


def test_jobs_run_together_and_in_order(spark):
    meet = threading.Barrier(2, timeout=60)

    def job(value):
        def run():
            meet.wait()
            return spark.range(value).count()

        return run

    assert together(spark, [job(3), job(5)]) == [3, 5]
    assert together(spark, [lambda: threading.current_thread()]) == [threading.current_thread()] and together(spark, []) == []

    def lost():
        raise ValueError("lost")

    with pytest.raises(ValueError, match="lost"):
        together(spark, [lost, lambda: 1])


def test_solvers_of_short_jobs_are_fitted_together(spark, monkeypatch):
    meet, done = threading.Barrier(2, timeout=60), []

    class Fit:
        def __init__(self, kind):
            self.kind = kind

        def fit(self, train):
            if self.kind != "random_forest":
                meet.wait()
            done.append(self.kind)
            return self.kind

    monkeypatch.setattr(models, "classifier", lambda kind, train: Fit(kind))
    monkeypatch.setattr(models, "without_summary", lambda model, train: model)
    table = spark.createDataFrame([(*[float(k + c) for c in range(len(models.FEATURES))], k % 2) for k in range(8)], [*models.FEATURES, "bleached"])
    fitted = models.fit_models(table, label="bleached")
    assert list(fitted) == list(models.MODEL_TYPES) and fitted == {t: t for t in models.MODEL_TYPES} and done[-1] == "random_forest"


def test_ranks_that_were_written_give_the_same_curves(spark):
    scored = spark.range(200).selectExpr("concat('m', id % 2) as model", "cast(id % 3 = 0 as int) as label", "(id * 37 % 50) / 50.0D as score", "cast(id * 37 % 50 >= 25 as int) as prediction")
    ranked = models.written(evaluation.ranked_scores(scored, ["model"]), "ranked")
    for curve in (evaluation.roc_curve, evaluation.pr_curve, evaluation.average_precision):
        plain, read = curve(scored, ["model"]), curve(scored, ["model"], ranked)
        assert plain.exceptAll(read).count() == read.exceptAll(plain).count() == 0


def test_observations_that_bring_their_cells_are_not_looked_up_again(spark, grid, obs, monkeypatch):
    axes = sampling.axes_of(grid)
    assert [r[0] for r in axes.select("latitude").collect()] == [0.0, 1.0, 2.0] and axes.where("longitude = 10").count() == 1
    placed = models.written(sampling.nearest_cells(obs, axes), "placed")
    want = features.observation_features(obs, grid, 10)
    arrays = series.series_for(obs, grid, 10)

    def again(points, grid):
        raise AssertionError("looked up again")

    monkeypatch.setattr(series, "nearest_cells", again)
    found, read = features.observation_features(placed, grid, 10), series.series_for(placed, grid, 10)
    assert found.columns == want.columns and read.columns == arrays.columns
    assert read.exceptAll(arrays).count() == 0 and read.count() == arrays.count() == 90
    both = want.join(found.select("obs_id", *[F.col(c).alias(f"_{c}") for c in features.FEATURES]), "obs_id")
    near = [F.abs(F.col(c) - F.col(f"_{c}")) < 1e-9 for c in features.FEATURES]
    assert found.count() == want.count() == 90 and both.where(F.forall(F.array(*near), lambda x: x)).count() == 90
