"""Scores of scored rows, per model."""

from __future__ import annotations

from checks import views as v
from checks.registry import query, rounded
from thermocline.operators import evaluation as ev

BY = ["model"]
_CELLS = """WITH c AS (SELECT model, count(*) FILTER (label = 0 AND prediction = 0) AS n00, count(*) FILTER (label = 0 AND prediction = 1) AS n01,
    count(*) FILTER (label = 1 AND prediction = 0) AS n10, count(*) FILTER (label = 1 AND prediction = 1) AS n11, count(*) AS n FROM scored GROUP BY model),
    s AS (SELECT *, coalesce(n00 / nullif(n00 + n10, 0), 0) AS p0, coalesce(n00 / nullif(n00 + n01, 0), 0) AS r0,
      coalesce(2.0::DOUBLE * n00 / nullif(2 * n00 + n10 + n01, 0), 0) AS f0, coalesce(n11 / nullif(n11 + n01, 0), 0) AS p1,
      coalesce(n11 / nullif(n11 + n10, 0), 0) AS r1, coalesce(2.0::DOUBLE * n11 / nullif(2 * n11 + n10 + n01, 0), 0) AS f1,
      (n00 + n11) / n AS acc, n00 + n01 AS k0, n10 + n11 AS k1 FROM c)"""
_AREAS = """areas AS (SELECT model, sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / (max(p)::DOUBLE * max(n)) AS roc_auc,
    sum(pos / p * tp / (tp + fp)) AS average_precision FROM ranked GROUP BY model)"""


@query(
    "l01_confusion_matrix",
    """SELECT model, label, prediction, count(doc_id) AS n FROM (SELECT DISTINCT model FROM scored)
    CROSS JOIN (VALUES (0), (1)) l(label) CROSS JOIN (VALUES (0), (1)) p(prediction)
    LEFT JOIN scored USING (model, label, prediction) GROUP BY ALL""",
    ["scored"],
)
def confusion_matrix(spark, sf):
    return ev.confusion_matrix(v.scored(spark, sf), BY)


@query(
    "l02_classification_report",
    _CELLS
    + """ SELECT model, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (
      SELECT model, '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, k0 AS support FROM s
      UNION ALL SELECT model, '1', p1, r1, f1, k1 FROM s UNION ALL SELECT model, 'accuracy', acc, acc, acc, n FROM s
      UNION ALL SELECT model, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM s
      UNION ALL SELECT model, 'weighted avg', (p0 * k0 + p1 * k1) / n, (r0 * k0 + r1 * k1) / n, (f0 * k0 + f1 * k1) / n, n FROM s)""",
    ["scored"],
)
def classification_report(spark, sf):
    return rounded(ev.classification_report(v.scored(spark, sf), BY))


@query(
    "l03_accuracy",
    "SELECT model, round(avg((label = prediction)::INT), 6) AS accuracy FROM scored GROUP BY model",
    ["scored"],
)
def accuracy(spark, sf):
    return rounded(ev.accuracy(v.scored(spark, sf), BY))


@query(
    "l04_roc_curve",
    """SELECT model, score AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM ranked
    UNION ALL SELECT DISTINCT model, NULL, 0.0::DOUBLE, 0.0::DOUBLE FROM ranked""",
    ["ranked"],
)
def roc_curve(spark, sf):
    return rounded(ev.roc_curve(v.scored(spark, sf), BY))


@query("l05_roc_auc", f"WITH {_AREAS} SELECT model, round(roc_auc, 6) AS roc_auc FROM areas", ["ranked"])
def roc_auc(spark, sf):
    return rounded(ev.roc_auc(v.scored(spark, sf), BY))


@query(
    "l06_pr_curve",
    """SELECT model, score AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM ranked
    UNION ALL SELECT DISTINCT model, NULL, 1.0::DOUBLE, 0.0::DOUBLE FROM ranked""",
    ["ranked"],
)
def pr_curve(spark, sf):
    return rounded(ev.pr_curve(v.scored(spark, sf), BY))


@query(
    "l07_average_precision",
    f"WITH {_AREAS} SELECT model, round(average_precision, 6) AS average_precision FROM areas",
    ["ranked"],
)
def average_precision(spark, sf):
    return rounded(ev.average_precision(v.scored(spark, sf), BY))


SUMMARY_SQL = (
    _CELLS
    + f""", {_AREAS} SELECT model, round(acc, 6) AS accuracy, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision,
    round(p0, 6) AS precision_0, round(r0, 6) AS recall_0, round(f0, 6) AS f1_0,
    round(p1, 6) AS precision_1, round(r1, 6) AS recall_1, round(f1, 6) AS f1_1 FROM s JOIN areas USING (model)"""
)


@query("l08_summary", SUMMARY_SQL, ["scored", "ranked"])
def summary(spark, sf):
    return rounded(ev.summary(v.scored(spark, sf)))


@query(
    "l10_log_loss",
    """SELECT model, round(avg(-ln(greatest(1e-15, least(1 - 1e-15, CASE WHEN label = 1 THEN score ELSE 1 - score END)))), 6) AS loss,
      round(avg((label = prediction)::INT) * 100, 6) AS accuracy_percent FROM scored GROUP BY model""",
    ["scored"],
)
def log_loss(spark, sf):
    return rounded(ev.log_loss(v.scored(spark, sf), BY))
