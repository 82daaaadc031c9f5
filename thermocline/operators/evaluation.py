"""Scores of classifiers and regressions. Classifier input: ``label``, ``prediction``, ``score`` rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermocline.operators.ordered import running_totals, with_lead_in, with_position

CLIP = 1e-15
ORDER_BLOCK = 4096


def _cells(df: DataFrame, by: Sequence[str], classes: Sequence[int]) -> DataFrame:
    """One row per group with the count of each (label, prediction) pair as ``_<label>_<prediction>``."""
    return df.groupBy(*by).agg(
        *[
            F.count_if((F.col("label") == a) & (F.col("prediction") == p)).alias(f"_{a}_{p}")
            for a in classes
            for p in classes
        ]
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def _total(columns: Sequence[Column]) -> Column:
    total = F.lit(0).cast("bigint")
    for column in columns:
        total = total + column
    return total


def _class_scores(c: int, classes: Sequence[int]) -> dict[str, Column]:
    hit = F.col(f"_{c}_{c}")
    support = _total([F.col(f"_{c}_{p}") for p in classes])
    called = _total([F.col(f"_{a}_{c}") for a in classes])
    precision, recall = _ratio(hit, called), _ratio(hit, support)
    f1 = _ratio(2.0 * hit, support + called)
    return {"precision": precision, "recall": recall, "f1": f1, "support": support}


def _accuracy(classes: Sequence[int]) -> Column:
    every = _total([F.col(f"_{a}_{p}") for a in classes for p in classes])
    return _ratio(_total([F.col(f"_{c}_{c}") for c in classes]), every)


def confusion_matrix(df: DataFrame, by: Sequence[str] = (), classes: Sequence[int] = (0, 1)) -> DataFrame:
    entries = F.array(
        *[
            F.struct(F.lit(a).alias("label"), F.lit(p).alias("prediction"), F.col(f"_{a}_{p}").alias("n"))
            for a in classes
            for p in classes
        ]
    )
    return _cells(df, by, classes).select(*by, F.inline(entries))


def classification_report(df: DataFrame, by: Sequence[str] = (), classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Rows per class, ``accuracy``, ``macro avg`` and ``weighted avg``; empty denominators give 0."""
    scores = [_class_scores(c, classes) for c in classes]
    support = _total([s["support"] for s in scores])
    metrics = ("precision", "recall", "f1")

    def row(name: str, values: dict[str, Column]) -> Column:
        return F.struct(F.lit(name).alias("class"), *[values[m].alias(m) for m in metrics], values["support"].alias("support"))

    rows = [row(str(c), s) for c, s in zip(classes, scores)]
    rows.append(row("accuracy", {**{m: _accuracy(classes) for m in metrics}, "support": support}))
    macro, weighted = {"support": support}, {"support": support}
    for m in metrics:
        macro[m] = sum((s[m] for s in scores[1:]), scores[0][m]) / float(len(classes))
        weighted[m] = _ratio(sum((s[m] * s["support"] for s in scores[1:]), scores[0][m] * scores[0]["support"]), support)
    rows += [row("macro avg", macro), row("weighted avg", weighted)]
    return _cells(df, by, classes).select(*by, F.inline(F.array(*rows)))


def accuracy(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    right = (F.col("label") == F.col("prediction")).cast("double")
    return df.groupBy(*by).agg(F.avg(right).alias("accuracy"))


def ranked_scores(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct scores with their positives and negatives, those of all higher scores, and totals.

    Curves and areas are read off these rows. Where several are asked for, write the rows once and pass them as ``ranked``.
    """
    groups = df.where(F.col("score").isNotNull()).groupBy(*by, "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")
    )
    return running_totals(groups, "score", ["pos", "neg"], by)


def _ranked(df: DataFrame, by: Sequence[str], ranked: DataFrame | None) -> DataFrame:
    return ranked_scores(df, by) if ranked is None else ranked


def _found(kind: str) -> Column:
    """Positives or negatives at or above the row's score."""
    return F.col(f"before_{kind}") + F.col(kind)


def _with_end(point: Column, end: Column) -> Column:
    """The curve point of a row; the row of the highest score also carries the curve's fixed end."""
    first = F.col("before_pos") + F.col("before_neg") == 0
    return F.inline(F.when(first, F.array(end, point)).otherwise(F.array(point)))


def roc_curve(df: DataFrame, by: Sequence[str] = (), ranked: DataFrame | None = None) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, and (0, 0) with a NULL threshold."""
    point = F.struct(
        F.col("score").alias("threshold"), _ratio(_found("neg"), F.col("total_neg")).alias("fpr"),
        _ratio(_found("pos"), F.col("total_pos")).alias("tpr"),
    )
    end = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return _ranked(df, by, ranked).select(*by, _with_end(point, end))


def pr_curve(df: DataFrame, by: Sequence[str] = (), ranked: DataFrame | None = None) -> DataFrame:
    """(threshold, precision, recall) per distinct score, and (1, 0) with a NULL threshold."""
    point = F.struct(
        F.col("score").alias("threshold"), _ratio(_found("pos"), _found("pos") + _found("neg")).alias("precision"),
        _ratio(_found("pos"), F.col("total_pos")).alias("recall"),
    )
    end = F.struct(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return _ranked(df, by, ranked).select(*by, _with_end(point, end))


def _areas(df: DataFrame, by: Sequence[str], ranked: DataFrame | None = None) -> DataFrame:
    """ROC area as the share of (positive, negative) pairs in order, ties half; and average precision."""
    pairs = F.col("neg") * (F.col("before_pos") + F.col("pos") / 2.0)
    step = _ratio(F.col("pos"), F.col("total_pos")) * _ratio(_found("pos"), _found("pos") + _found("neg"))
    return _ranked(df, by, ranked).groupBy(*by).agg(
        F.try_divide(
            F.sum(pairs), F.max("total_pos").cast("double") * F.max("total_neg").cast("double")
        ).alias("roc_auc"),
        F.sum(step).alias("average_precision"),
    )


def roc_auc(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _areas(df, by).select(*by, "roc_auc")


def average_precision(df: DataFrame, by: Sequence[str] = (), ranked: DataFrame | None = None) -> DataFrame:
    return _areas(df, by, ranked).select(*by, "average_precision")


def summary(df: DataFrame, by: str = "model", ranked: DataFrame | None = None) -> DataFrame:
    """One row per model: accuracy, areas, and precision, recall and F1 of classes 0 and 1."""
    per_class = [
        _class_scores(c, (0, 1))[m].alias(f"{m}_{c}") for c in (0, 1) for m in ("precision", "recall", "f1")
    ]
    table = _cells(df, [by], (0, 1)).select(by, _accuracy((0, 1)).alias("accuracy"), *per_class)
    names = [c for c in table.columns if c not in (by, "accuracy")]
    return table.join(_areas(df, [by], ranked), by).select(by, "accuracy", "roc_auc", "average_precision", *names)


def log_loss(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean cross-entropy of ``score`` as the probability of class 1, and accuracy in percent."""
    chance = F.when(F.col("label") == 1, F.col("score")).otherwise(1.0 - F.col("score"))
    clipped = F.greatest(F.lit(CLIP), F.least(F.lit(1.0 - CLIP), chance))
    right = (F.col("label") == F.col("prediction")).cast("double")
    return df.groupBy(*by).agg(F.avg(-F.ln(clipped)).alias("loss"), (F.avg(right) * 100.0).alias("accuracy_percent"))


def regression_metrics(df: DataFrame, y: str, yhat: str, keys: Sequence[str], time: str = "time") -> DataFrame:
    """MAE, RMSE, MAPE (percent), R-squared and directional accuracy of series of predictions.

    Direction compares each step with the one before it in its series (``keys``), across blocks.
    """
    blocks = with_lead_in(with_position(df, keys, time, "_step"), F.col("_step"), ORDER_BLOCK, 1)
    past = Window.partitionBy(*keys, "_block").orderBy("_step")
    moved = {c: F.signum(F.col(c) - F.lag(c).over(past)) for c in (y, yhat)}
    rows = blocks.withColumn("_agrees", moved[y] == moved[yhat]).where("_own")
    off = F.col(y) - F.col(yhat)
    seen = F.when(off.isNotNull(), F.col(y))
    return rows.agg(
        F.avg(F.abs(off)).alias("mae"),
        F.sqrt(F.avg(off * off)).alias("rmse"),
        (F.avg(F.try_divide(F.abs(off), F.abs(F.col(y)))) * 100.0).alias("mape"),
        (1.0 - F.try_divide(F.avg(off * off), F.var_pop(seen))).alias("r2"),
        F.avg(F.col("_agrees").cast("double")).alias("directional_accuracy"),
    )
