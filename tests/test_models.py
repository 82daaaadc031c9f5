"""Classifiers: the kernel margin on data that no line separates, calibration, early stopping, storage."""

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Observation
from pyspark.sql import functions as F

from thermocline.operators import evaluation, models


@pytest.fixture(scope="module")
def rings(spark):
    rng = np.random.default_rng(3)
    angle, label = rng.uniform(0, 2 * np.pi, 600), rng.integers(0, 2, 600)
    far = 1.0 + 2.0 * label + rng.normal(0, 0.25, 600)
    rows = [(k, float(r * np.cos(a)), float(r * np.sin(a)), float(c)) for k, (a, r, c) in enumerate(zip(angle, far, label))]
    return models.written(spark.createDataFrame(rows, "obs_id long, a double, b double, label double"), "rings")


def test_kernel_margin_separates_rings_and_is_calibrated(spark, rings):
    train, held = rings.where("obs_id % 3 > 0"), rings.where("obs_id % 3 = 0")
    model = models.classifier("svm", train, ["a", "b"]).fit(train)
    judged = models.predict(model, held).toPandas()
    assert judged.score.between(0, 1).all() and ((judged.score >= 0.5) == (judged.prediction == 1)).all()
    assert ((judged.prediction == 1) == (judged.label == 1)).mean() > 0.97
    assert -np.log(np.where(judged.label == 1, judged.score, 1 - judged.score)).mean() < 0.15
    again = models.predict(models.classifier("svm", train, ["a", "b"]).fit(train), held).toPandas()
    assert np.allclose(judged.sort_values("obs_id").score, again.sort_values("obs_id").score, atol=1e-6)


def test_calibration_does_not_see_its_own_margins(spark):
    # Labels are drawn by lot: margins of the rows that were fitted look certain, those of unseen rows do not.
    rng = np.random.default_rng(5)
    rows = [(float(x), float(y), float(c)) for x, y, c in zip(rng.normal(size=300), rng.normal(size=300), rng.integers(0, 2, 300))]
    train = models.written(spark.createDataFrame(rows, "a double, b double, label double"), "noise")
    model = models.KernelClassifier(["a", "b"], landmarks=150, regParam=1e-6).fit(train)
    scores = models.predict(model, train).toPandas().score
    assert scores.between(0.2, 0.8).mean() > 0.95


def test_landmark_map_gives_the_kernel(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 3))
    apart = ((centres[:, None] - centres[None]) ** 2).sum(axis=2)
    values, vectors = np.linalg.eigh(np.exp(-0.7 * apart))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({
        **{c: pa.array(centres[:, k]) for k, c in enumerate("xyz")}, "label": pa.array([0.0] * 12), "fold": pa.array([0] * 12, pa.int32()),
    })
    lifted = np.array(next(models._lifted("xyz", centres, 0.7, vectors / np.sqrt(values))(iter([batch]))).column("lifted").to_pylist())
    assert np.allclose(lifted @ lifted.T, np.exp(-0.7 * apart), atol=1e-8)


def test_kernel_classifier_of_one_class_and_of_none(spark):
    one = spark.createDataFrame([(1.0, 2.0, 0.0), (2.0, 2.0, 0.0), (3.0, 1.0, 0.0)], "a double, b double, label double")
    model = models.classifier("svm", one, ["a", "b"]).fit(one)
    assert {r["prediction"] for r in models.predict(model, one).collect()} == {0}
    with pytest.raises(ValueError):
        models.classifier("svm", one, ["a", "b"]).fit(one.limit(0))


def test_fitting_stops_and_returns_the_least_validation_loss(spark):
    rng = np.random.default_rng(8)
    rows = [([float(x) for x in rng.normal(size=6)], float(c), "train" if k % 2 else "val") for k, c in enumerate(rng.integers(0, 2, 120))]
    parts = models.written(
        spark.createDataFrame(rows, "s array<double>, label double, split string").select(array_to_vector("s").alias("features"), "label", "split"), "parts"
    )
    train, validation = parts.where("split = 'train'"), parts.where("split = 'val'")
    model, history = models.fit_with_patience(models.sequence_classifier(6, (12,)), train, validation, epochs=30, patience=3)
    losses = [h["loss"] for h in history]
    assert [h["epoch"] for h in history] == list(range(1, len(losses) + 1))
    assert len(losses) == losses.index(min(losses)) + 1 + 3 < 30  # noise is learnt by heart, so the validation loss turns
    found = evaluation.log_loss(models.predict(model, validation)).first()["loss"]
    assert found == pytest.approx(min(losses), abs=1e-9)
    model, history = models.fit_with_patience(models.sequence_classifier(6, (4,)), train, validation.where(F.lit(False)), epochs=2)
    assert len(history) == 2 and history[-1]["loss"] is None and model.weights.size > 0


def test_epochs_go_on_from_the_weights_before(spark, monkeypatch):
    rows = [([float(k % 5), float(k % 3)], float(k % 2)) for k in range(40)]
    train = spark.createDataFrame(rows, "s array<double>, label double").select(array_to_vector("s").alias("features"), "label")
    seen = []
    network = models.sequence_classifier(2, (3,))
    kind, plain = type(network), type(network).fit

    def fit(self, df, params=None):
        seen.append(self.getInitialWeights() if self.isSet(self.initialWeights) else None)
        return plain(self, df)

    monkeypatch.setattr(kind, "fit", fit)
    models.fit_with_patience(network, train, train, epochs=3, patience=3, iterations=1)
    assert seen[0] is None and seen[1] is not None and len(seen) == 3


@pytest.mark.parametrize("kind", ("logistic", "random_forest"))
def test_models_score_in_a_session_that_has_observed_metrics(spark, kind):
    session = spark.newSession()
    rows = [(k, *[float(k % (3 + c)) for c in range(len(models.FEATURES))], k % 2) for k in range(60)]
    table = models.written(session.createDataFrame(rows, ["obs_id", *models.FEATURES, "bleached"]), "observed")
    fitted = models.fit_models(table, (kind,), "bleached")[kind]
    seen = Observation("rows")
    session.range(5).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get["n"] == 5
    assert models.predict(fitted, table).where(F.col("score").between(0, 1)).count() == 60


def test_kernel_model_scores_in_a_session_that_has_observed_metrics(spark):
    session = spark.newSession()
    rows = [(k, float(k % 7), float(k % 5), float(k % 2)) for k in range(80)]
    table = models.written(session.createDataFrame(rows, "obs_id long, a double, b double, label double").coalesce(1), "observed")
    fitted = models.KernelClassifier(["a", "b"], landmarks=4, folds=2, maxIter=3).fit(table)
    session.range(5).observe(Observation("rows"), F.count("*").alias("n")).collect()
    assert models.predict(fitted, table).where(F.col("score").between(0, 1)).count() == 80


def test_solvers_read_a_table_spread_over_all_cores(spark, monkeypatch):
    rows = [(k, *[float(k % (3 + c)) for c in range(len(models.FEATURES))], k % 2) for k in range(60)]
    table = models.written(spark.createDataFrame(rows, ["obs_id", *models.FEATURES, "bleached"]).coalesce(1), "narrow")
    assert table.rdd.getNumPartitions() == 1
    seen = []

    class Fit:
        def fit(self, train):
            seen.append((train.rdd.getNumPartitions(), train.count()))

    monkeypatch.setattr(models, "classifier", lambda kind, train: Fit())
    models.fit_models(table, ("svm",), "bleached")
    assert seen == [(spark.sparkContext.defaultParallelism, 60)]


def test_kernel_margins_are_fitted_in_shared_passes(spark, rings):
    context = spark.sparkContext
    context.setJobGroup("kernel-passes", "one fit")
    try:
        models.classifier("svm", rings, ["a", "b"]).fit(rings)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("kernel-passes")) < 150  # some 1,000 with a solver for each margin


@pytest.mark.parametrize("pull", (0.0, 6.0))
def test_margins_have_the_least_hinge_loss(spark, pull):
    """The loss of both solvers on data by lot and nearly separated; of all rows and without a fold."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1500, 3)) * [1.0, 0.1, 0.01]
    label = (rng.uniform(size=1500) < 1.0 / (1.0 + np.exp(-0.2 - pull * (x[:, 0] - 8.0 * x[:, 1])))).astype(float)
    fold = rng.integers(0, 3, 1500)
    rows = [(r.tolist(), float(c), int(f)) for r, c, f in zip(x, label, fold)]
    table = spark.createDataFrame(rows, "lifted array<double>, label double, fold int")
    fits = models._fitted_margins(table, lambda batches: batches, 4, [None, 1])
    for left_out, fit in fits.items():
        mine = np.ones(1500, dtype=bool) if left_out is None else fold != left_out
        part = table if left_out is None else table.where(F.col("fold") != left_out)
        other = LinearSVC(maxIter=300, regParam=1.0 / mine.sum()).fit(part.select(array_to_vector("lifted").alias("features"), "label"))

        def loss(weights, shift):
            short = np.maximum(0.0, 1.0 - (2 * label[mine] - 1) * (x[mine] @ weights + shift))
            return short.mean() + 0.5 / mine.sum() * ((weights * x[mine].std(axis=0, ddof=1)) ** 2).sum()

        assert loss(fit[:-1], fit[-1]) < loss(other.coefficients.toArray(), other.intercept) + 2e-3
