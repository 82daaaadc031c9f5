"""Classifiers on series features and sequences, as Spark ML pipelines."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermocline.operators.evaluation import classification_report, confusion_matrix, log_loss, summary
from thermocline.operators.features import FEATURES
from thermocline.operators.split import stratified_split
from thermocline.session import shared_folder, together

MODEL_TYPES = ("random_forest", "logistic", "svm")
# Forest size and depth, iteration limit, hidden layer width, seed.
TREES, DEPTH, ITERATIONS, HIDDEN, SEED = 100, 10, 1000, 64, 42
# Kernel classifier: landmarks, rows they are chosen from at most, calibration folds, the solver's limit of passes, and the share of the
# largest eigenvalue under which a direction of the landmarks' kernel is left out.
LANDMARKS, LANDMARK_ROWS, FOLDS, MARGIN_ITERATIONS, LEAST_EIGENVALUE = 64, 50_000, 3, 100, 1e-8
# Its margins: widths over which the hinge's corner is rounded in turn, the gain (in widths) under which a width is done, and shares of a step that
# are tried.
BANDS, LEAST_GAIN, STEPS = (2.0, 0.5, 0.1, 0.02, 0.005), 1e-4, np.array([1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 1e-3, 1e-4])
# Sequence network: epochs, solver iterations in one, and epochs without a better validation loss before it stops.
EPOCHS, EPOCH_ITERATIONS, PATIENCE = 50, 2, 10
_INPUT, _CENTRED = "features", "_centred"


def classifier(model_type: str, train: DataFrame, inputs: Sequence[str] = FEATURES, **params) -> Pipeline | KernelClassifier:
    """Unfitted model from feature columns to ``prediction`` and ``probability``; its ``fit`` gives a pipeline model.

    The row count of ``train`` sets the penalty that equals a unit penalty on the summed loss.
    """
    if model_type not in MODEL_TYPES:
        raise ValueError(f"{model_type} is none of the model types {MODEL_TYPES}")
    assemble = VectorAssembler(inputCols=list(inputs), outputCol=_INPUT)
    if model_type == "random_forest":
        settings = {"numTrees": TREES, "maxDepth": DEPTH, "seed": SEED, **params}
        return Pipeline(stages=[assemble, RandomForestClassifier(featuresCol=_INPUT, **settings)])
    if model_type == "logistic":
        settings = {"maxIter": ITERATIONS, "regParam": 1.0 / _rows(train), "standardization": False, **params}
        # The intercept is not penalised, so centring keeps the optimum and spares the solver most iterations.
        centre = StandardScaler(inputCol=_INPUT, outputCol=_CENTRED, withMean=True, withStd=False)
        return Pipeline(stages=[assemble, centre, LogisticRegression(featuresCol=_CENTRED, **settings)])
    return KernelClassifier(inputs, **params)


def _rows(train: DataFrame) -> int:
    rows = train.count()
    if rows == 0:
        raise ValueError("No rows to fit on")
    return rows


class KernelClassifier:
    """Radial-kernel margin classifier by a landmark map, with calibrated probabilities.

    The kernel matrix is replaced by its projection on ``landmarks`` points (a parameter; the centres of a k-means over at most ``LANDMARK_ROWS`` rows):
    a row's values at the landmarks, whitened by the eigenvectors of the landmarks' own small kernel matrix, are the inputs of a linear margin. They are
    computed in each pass and never stored; the margins of all rows and of the folds are fitted in the same passes. The kernel
    width is 1 / (inputs * variance of all input values). Probabilities are a logistic fit on margins of rows that the margin's solver
    did not see, fold by fold; folds go by a hash of the inputs, so equal rows share one.
    """

    def __init__(self, inputs: Sequence[str] = FEATURES, landmarks: int = LANDMARKS, folds: int = FOLDS, **params) -> None:
        self.inputs, self.landmarks, self.folds, self.params = list(inputs), landmarks, folds, params

    def _width(self, train: DataFrame) -> tuple[int, float]:
        moments = train.agg(
            F.count("*").alias("rows"),
            *[F.avg(c).alias(f"mean_{c}") for c in self.inputs],
            *[F.avg(F.col(c) * F.col(c)).alias(f"square_{c}") for c in self.inputs],
        ).first()
        if moments["rows"] == 0:
            raise ValueError("No rows to fit on")
        means = [moments[f"mean_{c}"] for c in self.inputs]
        spread = np.mean([moments[f"square_{c}"] for c in self.inputs]) - np.mean(means) ** 2
        return moments["rows"], 1.0 / (len(self.inputs) * spread) if spread > 0 else 1.0

    def _centres(self, train: DataFrame, rows: int) -> np.ndarray:
        """Landmarks: k-means centres of the rows whose hash falls under the share that makes about ``LANDMARK_ROWS``, in one order."""
        place = F.pmod(F.xxhash64(*self.inputs), F.lit(1 << 20)) / float(1 << 20)
        some = VectorAssembler(inputCols=self.inputs, outputCol=_INPUT).transform(train.where(place <= min(1.0, LANDMARK_ROWS / rows)))
        means = KMeans(featuresCol=_INPUT, k=max(2, self.landmarks), seed=SEED, maxIter=10).fit(some.select(_INPUT)).clusterCenters()
        return np.unique(np.array(means), axis=0)

    def fit(self, train: DataFrame) -> PipelineModel:
        """``train`` has the inputs and a 0/1 double ``label``; it is read in every pass: pass a stored table that is spread over the cores."""
        rows, gamma = self._width(train)
        centres = self._centres(train, rows)
        apart = ((centres[:, None] - centres[None]) ** 2).sum(axis=2)
        values, vectors = np.linalg.eigh(np.exp(-gamma * apart))
        held = values > LEAST_EIGENVALUE * values.max()
        whitening = vectors[:, held] / np.sqrt(values[held])
        fold = F.pmod(F.xxhash64(*self.inputs), F.lit(self.folds)).cast("int")
        table = train.select(*[F.col(c).cast("double").alias(c) for c in self.inputs], "label", fold.alias("fold"))
        lift = _lifted(self.inputs, centres, gamma, whitening)
        seen = {(r["fold"], r["label"]): r["count"] for r in table.groupBy("fold", "label").count().collect()}
        if len({label for _, label in seen}) < 2:
            weights, shift, margins = np.zeros(len(centres)), 0.0, table.select(F.lit(0.0).alias("_margin"), "label")
        else:
            folds = sorted({k for k, _ in seen})
            # A fold that holds a whole class cannot be left out; its rows are judged by the margin of all rows.
            left_out = [k for k in folds if all(any(f != k and c == label for f, c in seen) for label in (0.0, 1.0))]
            fits = _fitted_margins(table, lift, whitening.shape[1] + 1, [None, *left_out], **self.params)
            weights, shift = whitening @ fits[None][:-1], fits[None][-1]
            margins = table.mapInArrow(_margins_by_fold(lift, {k: fits.get(k, fits[None]) for k in folds}), "_margin double, label double")
        judge = VectorAssembler(inputCols=["_margin"], outputCol="_margins")
        calibrated = LogisticRegression(featuresCol="_margins", maxIter=ITERATIONS).fit(judge.transform(margins))
        near = [
            f"{w:.17e}D * exp({-gamma:.17e}D * ({' + '.join(f'({c} - {x:.17e}D) * ({c} - {x:.17e}D)' for c, x in zip(self.inputs, centre))}))"
            for w, centre in zip(weights, centres)
        ]
        lift = SQLTransformer(statement=f"SELECT *, {shift:.17e}D + {' + '.join(near)} AS _margin FROM __THIS__")
        return without_summary(PipelineModel(stages=[lift, judge, calibrated]), train)


def _lifted(inputs: Sequence[str], centres: np.ndarray, gamma: float, whitening: np.ndarray):
    """Task code: the whitened kernel values of each row at the landmarks."""
    names = list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([np.asarray(batch.column(c), dtype=np.float64) for c in names], axis=1)
            apart = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None] - 2.0 * x @ centres.T
            values = np.exp(-gamma * np.maximum(apart, 0.0)) @ whitening
            offsets = np.arange(len(x) + 1, dtype=np.int32) * values.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([lists, batch.column("label"), batch.column("fold")], names=["lifted", "label", "fold"])

    return run


def _matrices(lift):
    """Task code: batches as the lifted rows with a last column of ones for the intercept, the labels and the folds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in lift(batches):
            lifted = batch.column("lifted").flatten().to_numpy().reshape(batch.num_rows, -1)
            x = np.concatenate([lifted, np.ones((batch.num_rows, 1))], axis=1)
            yield x, np.asarray(batch.column("label")), np.asarray(batch.column("fold"))

    return run


def _moments(lift, size: int):
    """Task code: per fold the rows, the sums of the lifted values and of their squares."""
    matrices = _matrices(lift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for x, _, folds in matrices(batches):
            for k in np.unique(folds).tolist():
                part = x[folds == k]
                found[k] = found.get(k, np.zeros((2, size))) + np.stack([part.sum(axis=0), (part * part).sum(axis=0)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())], names=["fold", "sums"]
        )

    return run


def _margin_sums(lift, size: int, asked: list[tuple]):
    """Task code: for each margin asked for, one row of sums over the rows outside its fold.

    A margin is given by its left-out fold, a point, a step and a band. The sums are the losses after each share of the step, and gradient and
    curvature after the whole step. A loss is the hinge with its corner rounded over ``band``.
    """
    points, shares, matrices = np.stack([a[1] for a in asked] + [a[2] for a in asked], axis=1), STEPS, _matrices(lift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        losses = np.zeros((len(asked), len(shares)))
        slopes, curves = np.zeros((len(asked), size)), np.zeros((len(asked), size, size))
        for x, labels, folds in matrices(batches):
            sign = 2.0 * labels - 1.0
            places = x @ points
            pulls = np.zeros((len(x), len(asked)))
            for m, (fold, _, step, band) in enumerate(asked):
                mine = np.ones(len(x), dtype=bool) if fold is None else folds != fold
                at, by, side = places[mine, m], places[mine, len(asked) + m], sign[mine]
                for k, share in enumerate(shares if step.any() else shares[:1]):
                    short = np.maximum(1.0 - side * (at + share * by), 0.0)
                    losses[m, k] += np.where(short < band, short * short / (2.0 * band), short - band / 2.0).sum()
                short = 1.0 - side * (at + by)
                pulls[mine, m] = -side * np.clip(short / band, 0.0, 1.0)
                bent = x[np.flatnonzero(mine)[(short > 0.0) & (short < band)]]
                curves[m] += bent.T @ bent / band
            slopes += pulls.T @ x
        sums = [np.concatenate([losses[m], slopes[m], curves[m].ravel()]).tobytes() for m in range(len(asked))]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(asked)), pa.int32()), pa.array(sums, pa.binary())], names=["margin", "sums"])

    return run


def _summed(rows: list, name: str) -> dict[int, np.ndarray]:
    """Sums by key over the tasks' rows, of which each task gives one a key."""
    total: dict[int, np.ndarray] = {}
    for row in rows:
        total[row[name]] = total.get(row[name], 0.0) + np.frombuffer(row["sums"])
    return total


def _fitted_margins(
    table: DataFrame, lift, size: int, left_out: Sequence[int | None], regParam: float | None = None, maxIter: int = MARGIN_ITERATIONS
) -> dict[int | None, np.ndarray]:
    """Weights and intercept of the linear margin that leaves out each given fold, all fitted in the same passes.

    Each has the least mean hinge loss plus half the penalty (one over its rows unless given) times the squared weights of the standardised inputs. Newton
    steps on the hinge with a rounded corner, rounded less and less, need some tens of passes; a task returns sums alone.
    """
    sums = _summed(table.mapInArrow(_moments(lift, size), "fold int, sums binary").collect(), "fold")
    fits = {}
    for fold in left_out:
        total = sum(v.reshape(2, size) for k, v in sums.items() if k != fold)
        n = total[0, -1]
        spread_of = np.sqrt(np.maximum(total[1] / n - (total[0] / n) ** 2, 0.0) * n / max(n - 1.0, 1.0))
        scale = np.divide(1.0, spread_of, out=np.zeros(size), where=spread_of > 1e-12)
        scale[-1] = 1.0
        fits[fold] = _Fit(n, scale, 1.0 / n if regParam is None else regParam)
    for _ in range(maxIter):
        open_fits = {fold: fit for fold, fit in fits.items() if not fit.done}
        if not open_fits:
            break
        asked = [(fold, fit.at * fit.scale, fit.step * fit.scale, BANDS[fit.band]) for fold, fit in open_fits.items()]
        sums = _summed(table.mapInArrow(_margin_sums(lift, size, asked), "margin int, sums binary").collect(), "margin")
        for k, fit in enumerate(open_fits.values()):
            fit.take(sums[k])
    return {fold: fit.at * fit.scale for fold, fit in fits.items()}


class _Fit:
    """Where the fit of one margin stands: its point in standardised inputs and the step that is tried from there."""

    def __init__(self, rows: float, scale: np.ndarray, penalty: float) -> None:
        self.rows, self.scale, self.penalties = rows, scale, np.append(np.full(len(scale) - 1, penalty), 0.0)
        self.at, self.step, self.band, self.loss, self.reach, self.done = np.zeros(len(scale)), np.zeros(len(scale)), 0, np.inf, BANDS[0], False

    def take(self, sums: np.ndarray) -> None:
        """Go on from a pass's sums: make the step or shorten it, and when little is gained round less or end."""
        size, shares = len(self.scale), len(STEPS)
        ends = self.at + STEPS[:, None] * self.step
        losses = sums[:shares] / self.rows + 0.5 * (self.penalties * ends * ends).sum(axis=1)
        if losses[0] < self.loss:
            self.at, self.loss = ends[0], losses[0]
            slope = sums[shares : shares + size] * self.scale / self.rows + self.penalties * self.at
            curve = sums[shares + size :].reshape(size, size) * np.outer(self.scale, self.scale) / self.rows + np.diag(self.penalties)
            self.reach = max(self.reach, 2.0 * np.linalg.norm(self.step))
            self.step = _step_within(self.reach, slope, curve)
            if -slope @ self.step - self.step @ curve @ self.step / 2.0 > LEAST_GAIN * BANDS[self.band]:
                return
        elif losses.min() < self.loss:
            self.step = STEPS[losses.argmin()] * self.step
            self.reach = np.linalg.norm(self.step)
            return
        self.done = self.band == len(BANDS) - 1
        self.band, self.loss, self.step = min(self.band + 1, len(BANDS) - 1), np.inf, np.zeros(size)
        self.reach = max(self.reach, BANDS[self.band])


def _step_within(reach: float, slope: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """Newton's step, damped until it is no longer than ``reach``."""
    damping = 1e-9
    while np.linalg.norm(step := -np.linalg.solve(curve + damping * np.eye(len(slope)), slope)) > reach:
        damping *= 2.0
    return step


def _margins_by_fold(lift, fits: dict[int, np.ndarray]):
    """Task code: each row's margin by the fit for its fold."""
    folds = np.array(sorted(fits))
    points, matrices = np.stack([fits[k] for k in folds], axis=1), _matrices(lift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, labels, of in matrices(batches):
            margins = (x @ points)[np.arange(len(x)), np.searchsorted(folds, of)]
            yield pa.RecordBatch.from_arrays([pa.array(margins), pa.array(labels)], names=["_margin", "label"])

    return run


def sequence_classifier(length: int, hidden: Sequence[int] = (HIDDEN,), epochs: int = EPOCHS) -> MultilayerPerceptronClassifier:
    """Two-class network on a vector column ``features`` of fixed-length sequences; ``epochs`` is the solver's iteration limit."""
    return MultilayerPerceptronClassifier(
        featuresCol=_INPUT, layers=[length, *hidden, 2], maxIter=epochs, blockSize=32, seed=SEED
    )


def fit_with_patience(
    network: MultilayerPerceptronClassifier, train: DataFrame, validation: DataFrame, epochs: int = EPOCHS,
    patience: int = PATIENCE, iterations: int = EPOCH_ITERATIONS,
) -> tuple[MultilayerPerceptronClassificationModel, list[dict]]:
    """The network as it was after the epoch with the least validation loss, and the epochs' losses.

    Each epoch goes on from the weights of the one before it for ``iterations`` of the solver. Fitting ends after ``patience`` epochs without a
    smaller loss, or after ``epochs``. Both tables have ``features`` and ``label`` and are read in every epoch: pass stored ones. Without
    validation rows there is nothing to compare, and the last epoch is returned.
    """
    model, best, least, waited, history = None, None, float("inf"), 0, []
    for epoch in range(1, epochs + 1):
        step = network.copy({network.maxIter: iterations})
        if model is not None:
            step.setInitialWeights(model.weights)
        model = step.fit(train)
        judged = log_loss(predict(model, validation.select("features", "label"))).first()
        history.append({"epoch": epoch, "loss": judged["loss"], "accuracy_percent": judged["accuracy_percent"]})
        if judged["loss"] is None:
            best = model
        elif judged["loss"] < least:
            best, least, waited = model, judged["loss"], 0
        else:
            waited += 1
            if waited >= patience:
                break
    return best, history


def with_vector(df: DataFrame, column: str = "sequence") -> DataFrame:
    return df.withColumn(_INPUT, array_to_vector(F.col(column)))


def predict(model, df: DataFrame) -> DataFrame:
    """Adds ``prediction`` (int) and ``score``, the probability of class 1."""
    if not hasattr(model, "transform"):
        raise ValueError("Only a fitted model predicts")
    keep = [c for c in df.columns if c not in ("features", "rawPrediction", "probability", "prediction", "score")]
    given = [*keep, "features"] if "features" in df.columns and not isinstance(model, PipelineModel) else keep
    return model.transform(df.select(*given)).select(
        *keep, F.col("prediction").cast("int").alias("prediction"),
        F.get(vector_to_array("probability"), 1).alias("score"),
    )


def written(df: DataFrame, label: str, parts: Sequence[str] = ()) -> DataFrame:
    """``df`` written to the shared folder, in a folder for each value of ``parts``, and read back."""
    path = shared_folder(df.sparkSession, label)
    df.write.partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly to as many tasks as the session has cores.

    Spark sizes shuffles and scans by bytes, and rows of numbers have few, so a solver's passes would else run in a task or two.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def fit_models(train: DataFrame, types: Sequence[str] = MODEL_TYPES, label: str = "label") -> dict[str, PipelineModel]:
    """Fitted pipelines by type. The solvers read the inputs many times: they are written once, spread over all cores.

    Solvers with many short jobs are fitted at the same time. The forest comes after them: its few long tasks take all cores, and short jobs would wait
    behind each of its levels.
    """
    labelled = written(spread(train.select(*FEATURES, F.col(label).cast("double").alias("label"))), "train")

    def fitted(kind: str):
        model = classifier(kind, labelled).fit(labelled)
        return model if kind == "svm" else without_summary(model, labelled)

    short = [t for t in types if t != "random_forest"]
    models = dict(zip(short, together(train.sparkSession, [partial(fitted, t) for t in short])))
    return {t: models[t] if t in models else fitted(t) for t in types}


def without_summary(model: PipelineModel, train: DataFrame) -> PipelineModel:
    """The model saved to the shared folder and read back, without its training summary.

    The summary of a two-class fit holds the session, and a session that has observed metrics (``DataFrame.observe``) cannot be sent to tasks;
    neither can the model's column functions then.
    """
    path = shared_folder(train.sparkSession, "fitted")
    save_model(model, path)
    return load_model(path)


def train_models(
    features: DataFrame, types: Sequence[str] = MODEL_TYPES, label: str = "bleach_presence",
    test: float = 0.2, seed: int = 42, key: str = "obs_id",
) -> tuple[dict, DataFrame]:
    """Fit each type on the training split; return the models and the scored test rows of all of them.

    The split is written once to the shared folder: solvers read it many times, and their jobs then start from a scan.
    """
    parts = written(stratified_split(features, label, test, seed=seed, key=key), "split", ["split"])
    models = fit_models(parts.where(F.col("split") == "train"), types, label)
    held_out = parts.where(F.col("split") == "test").withColumn("label", F.col(label).cast("int"))
    scored = None
    for name, model in models.items():
        one = predict(model, held_out).withColumn("model", F.lit(name)).select(
            key, "model", "label", "score", "prediction"
        )
        scored = one if scored is None else scored.unionByName(one)
    return models, scored


def model_metrics(scored: DataFrame, ranked: DataFrame | None = None) -> dict[str, DataFrame]:
    return {
        "classification_report": classification_report(scored, ["model"]),
        "confusion_matrix": confusion_matrix(scored, ["model"]),
        "summary": summary(scored, ranked=ranked),
    }


def save_model(model, path: str) -> None:
    if not hasattr(model, "transform"):
        raise ValueError("Only a fitted model can be saved")
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
