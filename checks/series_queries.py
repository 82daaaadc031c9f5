"""Series windows, features, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import query, rounded
from thermocline.operators import features, filters, series, split

_GRID = ("time", "latitude", "longitude", "year", "sst")


def _grid(spark, sf):
    return v.grid_daily(spark, sf).select(*_GRID)


@query(
    "d06_series_rows",
    "SELECT obs_id, time, round(sst, 6) AS sst FROM series",
    ["series"],
)
def series_rows(spark, sf):
    return rounded(series.series_rows(v.dated(spark, sf), _grid(spark, sf)))


_YEAR = """SELECT d.obs_id, g.time, g.sst FROM dated d JOIN placed p USING (obs_id)
    JOIN grid_daily g ON g.latitude = p._lat AND g.longitude = p._lon AND g.time BETWEEN d.date - INTERVAL 365 DAY AND d.date"""


@query(
    "d06_series_arrays_year",
    f"""SELECT d.obs_id, count(s.time) AS n, min(s.time) AS first, max(s.time) AS last, round(sum(s.sst), 6) AS total
    FROM dated d LEFT JOIN ({_YEAR}) s USING (obs_id) GROUP BY d.obs_id""",
    ["dated", "placed", "grid_daily"],
)
def series_arrays(spark, sf):
    arrays = series.series_for(v.dated(spark, sf), _grid(spark, sf), 365)
    total = F.aggregate("series", F.lit(0.0), lambda t, step: t + step["sst"])
    return rounded(
        arrays.select(
            "obs_id", F.coalesce(F.size("series"), F.lit(0)).cast("bigint").alias("n"),
            F.get("series", 0)["time"].alias("first"), F.try_element_at("series", F.lit(-1))["time"].alias("last"),
            total.alias("total"),
        )
    )


@query(
    "d06_series_linear",
    """WITH axes AS (SELECT list(DISTINCT latitude ORDER BY latitude) AS la, list(DISTINCT longitude ORDER BY longitude) AS lo FROM grid_daily),
    places AS (SELECT DISTINCT latitude, longitude, date FROM dated),
    squares AS (SELECT p.*, la, lo,
        greatest(least(len(list_filter(la, lambda a: a <= p.latitude)), len(la) - 1), 1) AS i,
        greatest(least(len(list_filter(lo, lambda a: a <= p.longitude)), len(lo) - 1), 1) AS j FROM places p, axes),
    shares AS (SELECT *, (latitude - la[i]) / (la[i + 1] - la[i]) AS u, (longitude - lo[j]) / (lo[j + 1] - lo[j]) AS w FROM squares),
    corners AS (SELECT latitude, longitude, date, la[i + a] AS _lat, lo[j + b] AS _lon,
        (CASE a WHEN 0 THEN 1 - u ELSE u END) * (CASE b WHEN 0 THEN 1 - w ELSE w END) AS weight
      FROM shares, (VALUES (0), (1)) AS s(a), (VALUES (0), (1)) AS t(b)),
    rows AS (SELECT c.latitude, c.longitude, date, time, CASE WHEN count(sst) = 4 THEN sum(weight * sst) END AS sst
      FROM corners c JOIN grid_daily g ON g.latitude = _lat AND g.longitude = _lon AND g.time BETWEEN date - INTERVAL 31 DAY AND date
      GROUP BY ALL)
    SELECT obs_id, time, round(sst, 6) AS sst FROM dated JOIN rows USING (latitude, longitude, date)""",
    ["dated", "grid_daily"],
)
def series_linear(spark, sf):
    return rounded(series.series_rows(v.dated(spark, sf), _grid(spark, sf), method="linear"))


@query(
    "f06_days_before",
    """SELECT obs_id, time, (row_number() OVER (PARTITION BY obs_id ORDER BY time DESC) - 1)::INT AS days_before FROM series""",
    ["series"],
)
def days_before(spark, sf):
    rows = series.series_rows(v.dated(spark, sf), _grid(spark, sf))
    return series.with_days_before(rows).select("obs_id", "time", "days_before")


@query(
    "k02_k03_value_transform",
    """SELECT d.obs_id, count(s.time) AS n, round(sum(s.sst - 20), 6) AS total FROM dated d LEFT JOIN series s USING (obs_id) GROUP BY d.obs_id""",
    ["dated", "series"],
)
def value_transform(spark, sf):
    def above_base(steps):
        return F.transform(steps, lambda step: step["sst"] - 20.0)

    arrays = series.series_for(v.dated(spark, sf), _grid(spark, sf), value_transform=above_base)
    total = F.aggregate("series", F.lit(0.0), lambda t, x: t + x)
    return rounded(
        arrays.select("obs_id", F.coalesce(F.size("series"), F.lit(0)).cast("bigint").alias("n"), total.alias("total"))
    )


@query(
    "b09_sequence",
    """WITH numbered AS (SELECT obs_id, sst, row_number() OVER (PARTITION BY obs_id ORDER BY time DESC) AS k FROM series)
    SELECT obs_id, round(max(CASE WHEN k = 12 THEN sst ELSE 0 END), 6) AS first, round(max(CASE WHEN k = 1 THEN sst END), 6) AS last,
      12::INT AS size, round(sum(CASE WHEN k <= 12 THEN sst END), 6) AS total
    FROM numbered GROUP BY obs_id""",
    ["series"],
)
def sequence(spark, sf):
    arrays = series.series_for(v.dated(spark, sf), _grid(spark, sf)).dropna(subset=["series"])
    fixed = series.to_sequence(arrays, 12)
    total = F.aggregate("sequence", F.lit(0.0), lambda t, x: t + x)
    return rounded(
        fixed.select(
            "obs_id", F.get("sequence", 0).alias("first"), F.get("sequence", 11).alias("last"),
            F.size("sequence").alias("size"), total.alias("total"),
        )
    )


@query(
    "b09_embedding_sequence",
    """SELECT vec_id, label < 5 AS positive, len(embedding)::INT AS size, round(list_sum(embedding[33:64]::DOUBLE[]), 4) AS total FROM embeddings""",
)
def embedding_sequence(spark, sf):
    steps = F.transform("embedding", lambda x: F.struct(x.cast("double").alias("sst")))
    rows = v.table(spark, sf, "embeddings").withColumn("series", steps)
    total = F.aggregate("sequence", F.lit(0.0), lambda t, x: t + x)
    return series.to_sequence(rows, 32).select(
        "vec_id", (F.col("label") < 5).alias("positive"), F.size("embedding").alias("size"), F.round(total, 4).alias("total")
    )


@query(
    "c12_drop_empty_series",
    "SELECT DISTINCT obs_id FROM series WHERE day(time) <> 1",
    ["series"],
)
def drop_empty(spark, sf):
    grid = _grid(spark, sf).withColumn("sst", F.when(F.dayofmonth("time") != 1, F.col("sst")))
    arrays = series.series_for(v.dated(spark, sf), grid)
    return filters.drop_empty_series(arrays).select("obs_id")


_FEATURES = """round(avg(sst), 8) AS mean, round(stddev_pop(sst), 8) AS std, round(min(sst), 8) AS min, round(max(sst), 8) AS max,
    round(quantile_cont(sst, 0.5), 8) AS median, round(quantile_cont(sst, 0.9), 8) AS p90,
    round(quantile_cont(sst, 0.95), 8) AS p95, round(quantile_cont(sst, 0.99), 8) AS p99"""


@query("j01_j02_series_features", f"SELECT obs_id, {_FEATURES} FROM series GROUP BY obs_id", ["series"])
def series_features(spark, sf):
    found = features.observation_features(v.dated(spark, sf), _grid(spark, sf))
    return rounded(found.select("obs_id", *features.FEATURES), 8)


_INDEXED = """WITH indexed AS (SELECT cell AS series_id, date_trunc('quarter', time)::DATE AS quarter, sst, time,
      row_number() OVER w - 1 AS i, count(*) OVER p AS len, avg(sst) OVER p AS m
    FROM grid_gaps WINDOW p AS (PARTITION BY cell, date_trunc('quarter', time)), w AS (PARTITION BY cell, date_trunc('quarter', time) ORDER BY time)),
    runs AS (SELECT series_id, quarter, island, sum(hot) AS run FROM (
        SELECT *, sum(1 - hot) OVER (PARTITION BY series_id, quarter ORDER BY i) AS island FROM (
          SELECT *, coalesce(sst > m + 1, false)::INT AS hot FROM indexed)) GROUP BY ALL),
    longest AS (SELECT series_id, quarter, max(run)::BIGINT AS longest_run FROM runs GROUP BY ALL),
    weeks AS (SELECT series_id, quarter, i // 7 AS week, avg(sst) - max(m) AS over FROM indexed GROUP BY ALL),
    heat AS (SELECT series_id, quarter, sum(greatest(coalesce(over, 0), 0)) AS heat_proxy FROM weeks GROUP BY ALL)"""


def _quarters(spark, sf):
    """Grid cells cut into quarters, as many bounded series."""
    return v.grid_gaps(spark, sf).select(
        F.col("cell").alias("series_id"), F.to_date(F.date_trunc("quarter", "time")).alias("quarter"), "time", "sst"
    )


@query(
    "j03_j04_j05_j06_extended_features",
    _INDEXED
    + f""", stats AS (SELECT series_id, quarter, {_FEATURES}, round(coalesce(regr_slope(sst, i), 0), 8) AS trend,
      round(CASE WHEN max(len) >= 30 THEN avg(CASE WHEN i >= len - ceil(len / 3) THEN sst END) - avg(CASE WHEN i < len // 3 THEN sst END) ELSE 0 END, 8) AS recent_change,
      count(sst) AS n FROM indexed GROUP BY ALL)
    SELECT s.* EXCLUDE (n), round(heat_proxy, 8) AS heat_proxy, longest_run
    FROM stats s JOIN heat USING (series_id, quarter) JOIN longest USING (series_id, quarter) WHERE n > 0""",
    ["grid_gaps"],
)
def extended_features(spark, sf):
    return rounded(features.extract_features(_quarters(spark, sf), ("series_id", "quarter"), extended=True), 8)


@query(
    "f07_longest_run",
    _INDEXED + " SELECT series_id, quarter, longest_run FROM longest",
    ["grid_gaps"],
)
def longest_run(spark, sf):
    return features.longest_run_above(_quarters(spark, sf), keys=("series_id", "quarter"))


@query(
    "g01_sorted_series",
    """SELECT obs_id, bool_and(coalesce(time > prev, true)) AS in_order FROM (
      SELECT obs_id, time, lag(time) OVER (PARTITION BY obs_id ORDER BY time) AS prev FROM series) GROUP BY obs_id""",
    ["series"],
)
def sorted_series(spark, sf):
    arrays = series.series_for(v.dated(spark, sf), _grid(spark, sf)).dropna(subset=["series"])
    times = F.transform("series", lambda step: step["time"])
    return arrays.select("obs_id", (times == F.array_sort(times)).alias("in_order"))


@query(
    "g02_sample_rows",
    """SELECT obs_id FROM cleaned ORDER BY md5(concat('42-', obs_id)) LIMIT 2000""",
    ["cleaned"],
)
def sample_rows(spark, sf):
    return split.sample_rows(v.cleaned(spark, sf).select("obs_id"), 2000)


@query(
    "g03_sample_with_replacement",
    """WITH r AS (SELECT obs_id, row_number() OVER (ORDER BY md5(concat('42-', obs_id))) AS k, count(*) OVER () AS n FROM cleaned),
    d AS (SELECT ('0x' || left(md5('42-draw-' || i), 12))::BIGINT AS h FROM range(1000) t(i))
    SELECT obs_id FROM d JOIN r ON r.k = 1 + d.h % r.n""",
    ["cleaned"],
)
def sample_replace(spark, sf):
    return split.sample_rows(v.cleaned(spark, sf).select("obs_id"), 1000, replace=True)


@query(
    "g04_stratified_split",
    """WITH r AS (SELECT obs_id, bleach_presence, row_number() OVER (PARTITION BY bleach_presence ORDER BY md5(concat('42-', obs_id))) AS k,
      count(*) OVER (PARTITION BY bleach_presence) AS n FROM (
        SELECT obs_id, CASE WHEN min_percent_bleached >= 20 THEN 1 ELSE 0 END AS bleach_presence FROM cleaned)),
    t AS (SELECT *, ceil(0.2::DOUBLE * n) AS nt, ceil(0.2::DOUBLE * (n - ceil(0.2::DOUBLE * n))) AS nv FROM r)
    SELECT obs_id, bleach_presence, CASE WHEN k <= nt THEN 'test' WHEN k <= nt + nv THEN 'val' ELSE 'train' END AS split FROM t""",
    ["cleaned"],
)
def stratified(spark, sf):
    labelled = filters.with_presence(v.cleaned(spark, sf)).select("obs_id", "bleach_presence")
    return split.stratified_split(labelled, "bleach_presence", 0.2, 0.2)


@query(
    "g04_stratified_split_scored",
    """WITH r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('7-', doc_id))) AS k,
      count(*) OVER (PARTITION BY label) AS n FROM scored WHERE model = 'a')
    SELECT doc_id, label, CASE WHEN k <= ceil(0.2::DOUBLE * n) THEN 'test' ELSE 'train' END AS split FROM r""",
    ["scored"],
)
def stratified_scored(spark, sf):
    rows = v.scored(spark, sf).where(F.col("model") == "a").select("doc_id", "label")
    return split.stratified_split(rows, "label", seed=7, key="doc_id")
