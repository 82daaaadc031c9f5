"""Scores against plain Python and Spark's own evaluator, splits, models, stores."""

import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from thermocline.operators import evaluation as ev
from thermocline.operators import features, models, ordered, split
from thermocline.operators.ordered import running_totals
from thermocline.sources import batches, store, tables


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(2)
    rows = []
    for model in "ab":
        for i in range(3000):
            label = int(rng.random() < 0.3)
            score = round(min(1.0, max(0.0, rng.gauss(0.45 + 0.2 * label, 0.2))), 3)
            rows.append((i, model, label, score, int(score >= 0.5)))
    return spark.createDataFrame(rows, "k int, model string, label int, score double, prediction int"), rows


def _plain_auc(rows):
    pos = [r[3] for r in rows if r[2] == 1]
    neg = sorted(r[3] for r in rows if r[2] == 0)
    import bisect

    won = sum(bisect.bisect_left(neg, p) + 0.5 * (bisect.bisect_right(neg, p) - bisect.bisect_left(neg, p)) for p in pos)
    return won / (len(pos) * len(neg))


def test_auc_three_ways(spark, scored):
    df, rows = scored
    mine = {r["model"]: r["roc_auc"] for r in ev.roc_auc(df, ["model"]).collect()}
    for model in "ab":
        part = [r for r in rows if r[1] == model]
        spark_auc = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(df.where(F.col("model") == model))
        assert abs(mine[model] - _plain_auc(part)) < 1e-9 and abs(mine[model] - spark_auc) < 1e-9
    flipped = {r["model"]: r["roc_auc"] for r in ev.roc_auc(df.withColumn("score", -F.col("score")), ["model"]).collect()}
    assert all(abs(mine[m] + flipped[m] - 1) < 1e-9 for m in mine)


def test_curves_and_average_precision(scored):
    df, rows = scored
    one = df.where("model = 'a'")
    part = sorted((r for r in rows if r[1] == "a"), key=lambda r: -r[3])
    curve = ev.roc_curve(one).orderBy("fpr", "tpr").collect()
    assert (curve[0]["fpr"], curve[0]["tpr"], curve[-1]["fpr"], curve[-1]["tpr"]) == (0.0, 0.0, 1.0, 1.0)
    area = sum((b["fpr"] - a["fpr"]) * (a["tpr"] + b["tpr"]) / 2 for a, b in zip(curve, curve[1:]))
    assert abs(area - _plain_auc(part)) < 1e-9
    total, seen, hits, last, ap = sum(r[2] for r in part), 0, 0, 0.0, 0.0
    for i, r in enumerate(part):
        seen, hits = seen + 1, hits + r[2]
        if i + 1 == len(part) or part[i + 1][3] != r[3]:
            ap += (hits / total - last) * hits / seen
            last = hits / total
    assert abs(ev.average_precision(one).first()["average_precision"] - ap) < 1e-9
    pr = ev.pr_curve(one).collect()
    assert sum(1 for r in pr if r["threshold"] is None and (r["precision"], r["recall"]) == (1.0, 0.0)) == 1
    assert len(pr) == len({r[3] for r in part}) + 1


def test_report_and_matrix(spark, scored):
    df, rows = scored
    matrix = {(r["label"], r["prediction"]): r["n"] for r in ev.confusion_matrix(df.where("model = 'b'")).collect()}
    for (a, p), n in matrix.items():
        assert n == sum(1 for r in rows if r[1] == "b" and r[2] == a and r[4] == p)
    report = {r["class"]: r for r in ev.classification_report(df.where("model = 'b'")).collect()}
    assert abs(report["1"]["precision"] - matrix[1, 1] / (matrix[1, 1] + matrix[0, 1])) < 1e-12
    assert report["macro avg"]["support"] == 3000
    none = spark.createDataFrame([(0, 0, 0.1)], "label int, prediction int, score double")
    empty = {r["class"]: r["f1"] for r in ev.classification_report(none).collect()}
    assert empty["1"] == 0.0 and empty["0"] == 1.0


def test_running_totals_over_many_slabs(spark):
    """Skewed values: most of the order axis is empty, one group holds nearly all rows."""
    rng = random.Random(4)
    values = sorted({rng.random() ** 8 for _ in range(4000)}, reverse=True)
    df = spark.createDataFrame([("x", v, 1) for v in values] + [("y", v, 2) for v in values[:50]], "g string, s double, n int")
    got = {(r["g"], r["s"]): (r["before_n"], r["total_n"]) for r in running_totals(df, "s", ["n"], ["g"]).collect()}
    assert all(got["x", v] == (i, len(values)) for i, v in enumerate(values))
    assert all(got["y", v] == (2 * i, 100) for i, v in enumerate(values[:50]))


def test_split_sizes(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1003)], "obs_id int, y int")
    parts = split.stratified_split(df, "y", 0.2, 0.25)
    got = {(r["y"], r["split"]): r["count"] for r in parts.groupBy("y", "split").count().collect()}
    assert got == {(0, "test"): 181, (0, "val"): 181, (0, "train"): 540, (1, "test"): 21, (1, "val"): 20, (1, "train"): 60}
    again = split.stratified_split(df.repartition(7), "y", 0.2, 0.25)
    assert parts.exceptAll(again).count() == 0
    assert split.sample_rows(df, 10).exceptAll(split.sample_rows(df.repartition(5), 10)).count() == 0
    assert split.sample_rows(df, None).count() == 1003 and split.sample_rows(df, 5000).count() == 1003


def test_features_against_numpy(spark):
    np = pytest.importorskip("numpy")
    rng = random.Random(9)
    series = {k: [None if rng.random() < 0.1 else rng.uniform(20, 30) for _ in range(n)] for k, n in ((1, 40), (2, 13))}
    series |= {3: [25.0], 4: [None, None]}
    rows = [(k, i, v) for k, values in series.items() for i, v in enumerate(values)]
    got = {r["obs_id"]: r for r in features.extract_features(spark.createDataFrame(rows, "obs_id int, time int, sst double"), extended=True).collect()}
    assert set(got) == {1, 2, 3}
    for k in got:
        a = np.array([np.nan if v is None else v for v in series[k]])
        want = [np.nanmean(a), np.nanstd(a), np.nanmin(a), np.nanmax(a), np.nanmedian(a), *(np.nanpercentile(a, q) for q in (90, 95, 99))]
        assert np.allclose([got[k][f] for f in features.FEATURES], want)
        ok = ~np.isnan(a)
        trend = np.polyfit(np.arange(len(a))[ok], a[ok], 1)[0] if ok.sum() > 1 else 0.0
        weeks = [np.nanmean(a[i : i + 7]) - want[0] for i in range(0, len(a), 7)]
        longest = run = 0
        for hot in a > want[0] + 1:
            run = run + 1 if hot else 0
            longest = max(longest, run)
        recent = np.nanmean(a[-len(a) // 3 :]) - np.nanmean(a[: len(a) // 3]) if len(a) >= 30 else 0.0
        assert np.isclose(got[k]["trend"], trend) and np.isclose(got[k]["heat_proxy"], sum(w for w in weeks if w > 0))
        assert got[k]["longest_run"] == longest and np.isclose(got[k]["recent_change"], recent)


def test_models_learn_and_reload(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        y = i % 2
        rows.append((i, y, *[rng.gauss(2.0 * y, 0.7) for _ in features.FEATURES]))
    schema = "obs_id int, bleach_presence int, " + ", ".join(f"{f} double" for f in features.FEATURES)
    table = spark.createDataFrame(rows, schema).cache()
    fitted, scored = models.train_models(table)
    auc = {r["model"]: r["roc_auc"] for r in ev.roc_auc(scored, ["model"]).collect()}
    assert set(auc) == set(models.MODEL_TYPES) and min(auc.values()) > 0.95
    models.save_model(fitted["logistic"], str(tmp_path / "m"))
    again = models.predict(models.load_model(str(tmp_path / "m")), table)
    assert again.exceptAll(models.predict(fitted["logistic"], table)).count() == 0
    for call in (models.predict, models.save_model):
        with pytest.raises(ValueError, match="fitted"):
            call(models.classifier("logistic", table), table)
    with pytest.raises(ValueError, match="none of the model types"):
        models.train_models(table, ("boosting",))


def test_store_computes_only_new_ids(spark, tmp_path):
    seen = []

    def build(new):
        seen.append(new.count())
        return new.select("obs_id", (F.col("obs_id") * 2).alias("double"))

    kept = store.FeatureStore(spark, str(tmp_path), "key")
    with pytest.raises(ValueError):
        kept.matrix(spark.range(1).toDF("obs_id"))
    kept.compute(spark.range(5).toDF("obs_id"), build)
    rows = kept.compute(spark.range(8).toDF("obs_id"), build)
    assert seen == [5, 3] and rows.count() == 8
    kept.compute(spark.range(2).toDF("obs_id"), build, force=True)
    assert seen[-1] == 2 and kept.read().count() == 2
    kept.clear()
    assert kept.read().count() == 0 and kept.read().columns == ["obs_id", "double"]


def test_store_remembers_ids_without_a_row(spark, tmp_path):
    seen = []

    def odd_ones(new):
        seen.append(new.count())
        return new.where("obs_id % 2 = 1").select("obs_id")

    kept = store.FeatureStore(spark, str(tmp_path), "key")
    ids = spark.range(6).toDF("obs_id")
    assert kept.compute(ids, odd_ones).count() == 3 and kept.failed().count() == 3
    assert kept.compute(ids, odd_ones).count() == 3 and len(kept.batches.records()) == 1
    rows = kept.compute(ids, lambda new: new.select("obs_id"), retry_failed=True)
    assert seen == [6, 0] and rows.count() == 6 and kept.failed().count() == 0
    kept.clear()
    assert kept.missing(ids).count() == 6


def test_two_runs_at_a_time_store_an_id_once(spark, tmp_path):
    first, second = (store.FeatureStore(spark, str(tmp_path), "key") for _ in range(2))

    def doubled(new):
        return new.select("obs_id", F.lit("second").alias("by"))

    def while_the_other_runs(new):
        second.compute(spark.range(3, 8).toDF("obs_id"), doubled)
        return new.select("obs_id", F.lit("first").alias("by"))

    rows = first.compute(spark.range(6).toDF("obs_id"), while_the_other_runs)
    assert rows.count() == 6 and rows.where("by = 'second'").count() == 3
    assert first.read().count() == 8 and len(first.batches.records()) == 2


def test_a_write_that_ends_half_way_is_not_seen(spark, tmp_path):
    ids = spark.range(0, 100, 1, 4).toDF("obs_id")
    breaks = ids.where(F.when(F.col("obs_id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.lit(True)).cast("boolean"))
    kept = store.FeatureStore(spark, str(tmp_path / "s"), "key")
    with pytest.raises(Exception, match="lost"):
        kept.compute(ids, lambda new: breaks)
    assert kept.read() is None and kept.missing(ids).count() == 100
    assert kept.compute(ids, lambda new: new).count() == 100
    path, year = str(tmp_path / "y"), (2000 + F.col("obs_id") % 3).cast("int").alias("year")
    with pytest.raises(Exception, match="lost"):
        tables.write_missing_years(breaks.select("obs_id", year), path)
    tables.write_missing_years(ids.where("obs_id % 3 = 0").select("obs_id", year), path)
    tables.write_missing_years(ids.select("obs_id", year), path)
    found = tables.read_grid(spark, path)
    assert found.count() == 100 and found.select("obs_id").distinct().count() == 100


def test_two_writers_add_a_year_once(spark, tmp_path, monkeypatch):
    path, plain = str(tmp_path), batches.BatchTable.stage
    rows = spark.range(40).selectExpr("id", "if(id < 4, null, cast(2000 + id % 4 as int)) as year")

    def overtaken(self, *args, **named):
        monkeypatch.setattr(batches.BatchTable, "stage", plain)
        tables.write_missing_years(rows.where("year > 2001 or year is null").withColumn("id", -F.col("id")), path)
        return plain(self, *args, **named)

    monkeypatch.setattr(batches.BatchTable, "stage", overtaken)
    tables.write_missing_years(rows, path)
    found = tables.read_grid(spark, path)
    assert found.count() == 40 and found.where("id < 0 and year > 2001").count() == found.where("year > 2001").count() > 0
    assert found.where("year is null").count() == 4
    files = {r[0] for r in found.where("year = 2000").select(F.input_file_name()).collect()}
    assert len(files) == 1
    tables.write_grid(rows.withColumn("year", F.lit(1)), f"{path}/plain")
    with pytest.raises(ValueError, match="without records"):
        tables.write_missing_years(rows, f"{path}/plain")


def test_store_key_ignores_order_and_sees_changes(spark):
    df = spark.createDataFrame([(1.0, 2.0, "2000-01-01", 1), (3.0, 4.0, "2000-01-02", 0)], "latitude double, longitude double, date string, bleach_presence int")
    key = store.store_key({"a": 1, "b": 2}, df).first()[0]
    assert key == store.store_key({"b": 2, "a": 1}, df.orderBy(F.desc("date"))).first()[0] and len(key) == 16
    assert key != store.store_key({"a": 1, "b": 3}, df).first()[0]
    assert key != store.store_key({"a": 1, "b": 2}, df.unionByName(df)).first()[0]


def test_grid_tables(spark, tmp_path):
    grid = spark.range(0, 800).selectExpr(
        "concat('patch_', id % 2) as patch", "cast(2000 + id % 4 as int) as year",
        "timestampadd(DAY, cast(id as int), timestamp_ntz'2000-01-01') as time", "0.0D as latitude", "0.0D as longitude",
        "if(id % 100 = 0, double('NaN'), 1.0D) as sst",
    )
    path = str(tmp_path / "g")
    tables.write_grid(grid, path)
    read = tables.read_grid(spark, path, [2000, 2001], ["patch_0"])
    assert read.count() == 200 and read.where("isnan(sst)").count() == 0
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "patch" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert tables.read_grid(spark, path, 1990).count() == 0
    tables.write_missing_years(grid.where("year = 2000"), str(tmp_path / "y"))
    tables.write_missing_years(grid, str(tmp_path / "y"))
    tables.write_missing_years(grid, str(tmp_path / "y"))
    assert tables.read_grid(spark, str(tmp_path / "y")).count() == 800


def test_slabs_are_even_in_every_group(spark):
    rng = random.Random(2)
    rows = [("narrow", 0.5 + 0.06 * rng.random()) for _ in range(4000)] + [("wide", rng.random()) for _ in range(4000)]
    df = spark.createDataFrame(rows, "model string, score double").groupBy("model", "score").agg(F.count("*").alias("n"))
    seen = {}
    plain = ordered.count_at_most

    def watched(limits, value):
        seen["slab"] = plain(limits, value)
        return seen["slab"]

    ordered.count_at_most = watched
    try:
        totals = ordered.running_totals(df, "score", ["n"], ["model"], slabs=16)
    finally:
        ordered.count_at_most = plain
    limits = df.groupBy("model").agg(F.percentile_approx("score", F.array(*[F.lit(i / 16) for i in range(1, 16)]), 160).alias("_limits"))
    sizes = df.join(limits, "model").groupBy("model", seen["slab"].alias("slab")).count().collect()
    for model in ("narrow", "wide"):
        mine = [r["count"] for r in sizes if r["model"] == model]
        assert len(mine) == 16 and max(mine) < 2 * 4000 / 16
    want = {m: sorted((s for x, s in rows if x == m), reverse=True) for m in ("narrow", "wide")}
    for r in totals.collect():
        assert r["total_n"] == 4000 and want[r["model"]][r["before_n"]] == r["score"]


def test_sample_is_the_least_hashes_without_a_limit_in_one_task(spark):
    df = spark.range(5000).withColumnRenamed("id", "obs_id").withColumn("v", F.rand(1)).cache()
    for n in (0, 1, 37, 4999, 5000, 9000):
        found = split.sample_rows(df, n, seed=7)
        want = df.orderBy(split.shuffle_hash("obs_id", 7)).limit(n)
        assert found.columns == df.columns and found.count() == min(n, 5000) and found.exceptAll(want).count() == 0
    plan = split.sample_rows(df, 1_000_000)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Limit" not in plan
    assert split.sample_rows(df.limit(0), 5).count() == 0
