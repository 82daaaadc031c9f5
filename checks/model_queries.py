"""Model training and scoring. Scores depend on the solvers; which rows are scored, their labels and the form of the scores do not."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from checks import views as v
from checks.registry import query
from thermocline.operators import evaluation, features, filters, models, split
from thermocline.plans import comparison
from thermocline.session import shared_folder

_GRID = ("time", "latitude", "longitude", "year", "sst")


def _labelled(spark, sf):
    return filters.with_presence(v.dated(spark, sf)).select(
        "obs_id", "latitude", "longitude", "date", "bleach_presence", "mean_percent_bleached"
    )


def _features(spark, sf):
    """Features written once to the shared folder, since solvers read their input many times."""
    path = shared_folder(spark, "training")
    found = features.observation_features(_labelled(spark, sf), v.grid_daily(spark, sf).select(*_GRID))
    found.write.parquet(path)
    return spark.read.parquet(path)


def _judged(scored):
    """Whether scores are probabilities and agree with the predicted class."""
    return scored.withColumns(
        {"in_range": F.coalesce(F.col("score").between(0.0, 1.0), F.lit(False)), "agrees": (F.col("score") >= 0.5) == (F.col("prediction") == 1)}
    ).drop("score", "prediction")


def _held_out(spark, sf, model_type):
    _, scored = models.train_models(_features(spark, sf), (model_type,))
    return _judged(scored)


_TEST_ROWS = """WITH u AS (SELECT DISTINCT obs_id, CASE WHEN min_percent_bleached >= 20 THEN 1 ELSE 0 END AS label
      FROM series JOIN dated USING (obs_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42-', obs_id))) AS k, count(*) OVER (PARTITION BY label) AS n FROM u)"""


def _test_sql(model):
    return _TEST_ROWS + f" SELECT obs_id, '{model}' AS model, label, true AS in_range, true AS agrees FROM r WHERE k <= ceil(0.2::DOUBLE * n)"


@query("m01_random_forest", _test_sql("random_forest"), ["series", "dated"])
def random_forest(spark, sf):
    return _held_out(spark, sf, "random_forest")


@query("m02_logistic", _test_sql("logistic"), ["series", "dated"])
def logistic(spark, sf):
    return _held_out(spark, sf, "logistic")


@query("m03_svm", _test_sql("svm"), ["series", "dated"])
def svm(spark, sf):
    return _held_out(spark, sf, "svm")


@query(
    "m04_sequence_classifier",
    """WITH r AS (SELECT vec_id, (label < 5)::INT AS label, row_number() OVER (PARTITION BY label < 5 ORDER BY md5(concat('42-', vec_id))) AS k,
      count(*) OVER (PARTITION BY label < 5) AS n FROM embeddings)
    SELECT vec_id, label, true AS in_range, true AS agrees, true AS least_loss, true AS stopped FROM r WHERE k <= ceil(0.2::DOUBLE * n)""",
)
def sequence_classifier(spark, sf):
    """Test rows judged by the network of the least validation loss, and whether it is that one and fitting ended by its rule."""
    rows = v.table(spark, sf, "embeddings").withColumns(
        {
            "features": array_to_vector(F.transform("embedding", lambda x: x.cast("double"))),
            "label": (F.col("label") < 5).cast("double"),
        }
    )
    parts = models.written(models.spread(split.stratified_split(rows.drop("embedding"), "label", val=0.2, key="vec_id")), "vectors")
    of = {name: parts.where(F.col("split") == name) for name in ("train", "val", "test")}
    epochs, patience = 12, 3
    model, history = models.fit_with_patience(models.sequence_classifier(64, (8,)), of["train"], of["val"], epochs, patience)
    losses = [h["loss"] for h in history]
    found = evaluation.log_loss(models.predict(model, of["val"])).first()["loss"]
    stopped = len(losses) == epochs or len(losses) == losses.index(min(losses)) + 1 + patience
    judged = _judged(models.predict(model, of["test"])).withColumn("label", F.col("label").cast("int"))
    return judged.drop("split").withColumns({"least_loss": F.lit(abs(found - min(losses)) < 1e-9), "stopped": F.lit(stopped)})


@query(
    "m05_train_models_rows",
    _TEST_ROWS
    + """ SELECT m.model, label, count(*) AS n FROM r CROSS JOIN (VALUES ('random_forest'), ('logistic'), ('svm')) m(model)
    WHERE k <= ceil(0.2::DOUBLE * n) GROUP BY ALL""",
    ["series", "dated"],
)
def train_models(spark, sf):
    _, scored = models.train_models(_features(spark, sf))
    return scored.groupBy("model", "label").agg(F.count("*").alias("n"))


@query(
    "m06_a20_saved_model_predictions",
    "SELECT DISTINCT obs_id, true AS in_range, true AS agrees, true AS same FROM series",
    ["series"],
)
def saved_model(spark, sf):
    """Scores of a model that was saved and read back, and whether they are those of the model before."""
    table = _features(spark, sf)
    model = models.fit_models(table, ("logistic",), "bleach_presence")["logistic"]
    path = shared_folder(spark, "model")
    models.save_model(model, path)
    before = models.predict(model, table).select("obs_id", F.col("score").alias("before"))
    found = models.predict(models.load_model(path), table).select("obs_id", "prediction", "score").join(before, "obs_id")
    return _judged(found.withColumn("same", F.col("score") == F.col("before")).drop("before"))


@query(
    "m06_a20_saved_kernel_predictions",
    "SELECT DISTINCT obs_id, true AS in_range, true AS agrees, true AS same FROM series",
    ["series"],
)
def saved_kernel_model(spark, sf):
    table = _features(spark, sf)
    model = models.fit_models(table, ("svm",), "bleach_presence")["svm"]
    path = shared_folder(spark, "model")
    models.save_model(model, path)
    before = models.predict(model, table).select("obs_id", F.col("score").alias("before"))
    found = models.predict(models.load_model(path), table).select("obs_id", "prediction", "score").join(before, "obs_id")
    return _judged(found.withColumn("same", F.col("score") == F.col("before")).drop("before"))


@query(
    "l09_compare_models",
    _TEST_ROWS
    + """ SELECT m.model, label, count(*) AS n, true AS in_range FROM r CROSS JOIN (VALUES ('random_forest'), ('logistic'), ('svm'), ('network')) m(model)
    WHERE k <= ceil(0.2::DOUBLE * n) GROUP BY ALL""",
    ["series", "dated"],
)
def compare_models(spark, sf):
    """Test rows of each model and label in the saved confusion matrix, and whether all scores of the model's summary are shares."""
    frames = comparison.compare_models(
        _labelled(spark, sf), v.grid_daily(spark, sf).select(*_GRID), shared_folder(spark, "comparison"), days_before=31
    )
    scores = [c for c in frames["summary"].columns if c != "model"]
    shares = frames["summary"].select("model", F.forall(F.array(*scores), lambda x: x.between(0.0, 1.0)).alias("in_range"))
    counted = frames["confusion_matrix"].groupBy("model", "label").agg(F.sum("n").alias("n"))
    return counted.join(shares, "model").select("model", "label", "n", "in_range")
