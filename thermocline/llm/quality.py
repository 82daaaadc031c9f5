"""Quality rules: robust multivariate outliers of text statistics, by minimum covariance determinant per language and source."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermocline.functions.binding import let
from thermocline.llm.common import BLANK, stored, words

# Symbol characters, least number of words, and the share of repeated words (percent) that fails a text.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MOST_REPEATED = 50

ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
STATISTICS = ("_x1", "_x2", "_x3", "_x4")
KEPT_SHARE = 0.5  # of a group's rows: the subset whose covariance determinant is made small
SETTLED = 1e-3  # least fall of a log determinant that counts; concentration steps go on until there is none
MAD = 1.4826  # standard deviations in a median absolute deviation of normal data
LEAST_GROUP = 100  # rows; smaller groups are judged by their language, then by all rows
FLOOR = (0.05, 0.03, 0.03, 0.06)  # least standard deviation of each statistic
CUT = 33.38  # 0.999999 quantile of chi-squared with 4 degrees of freedom
BINS = 64  # distance bins per e-fold, for the cut between kept and other rows

# Scale that makes the covariance of the nearest half consistent for normal data with 4 dimensions: 0.5 over the share of
# chi-squared with 6 degrees of freedom below the median of that with 4.
CONSISTENCY = 2.1090


def _window_hashes(word_list: Column) -> Column:
    """64-bit hashes of the 3-word windows of a bound array."""
    last = F.greatest(F.size(word_list) - 2, F.lit(0))
    return F.transform(
        F.slice(word_list, 1, last), lambda w, i: F.xxhash64(w, F.get(word_list, i + 1), F.get(word_list, i + 2))
    )


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more: sorted with their places, equal neighbours are repeats.

    A repeat covers its three words, less those that the next repeat covers as well.
    """

    def spots(s: Column) -> Column:
        same = lambda x, k: (F.get(s, k)["h"] == x["h"]).eqNullSafe(F.lit(True))
        return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

    def words_of(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b
        )

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(ordered, lambda s: let(spots(s), words_of))


def _word_statistics(word_list: Column) -> Column:
    """Number of words and of those in repeated windows; texts without a repeat are not sorted."""
    repeats = let(
        _window_hashes(word_list), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h))
    )
    return F.struct(F.size(word_list).cast("long").alias("n"), repeats.cast("long").alias("repeated"))


def text_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` and ``base_failed``.

    Null and empty texts have 0 everywhere and fail. Columns of ``docs`` with these names are replaced. Arrays are bound
    to lambda variables, since Spark would otherwise compute them anew for each element.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, BLANK, "")) > 0)
    return (
        docs.drop(*ADDED)
        .withColumns(
            {
                "_counts": let(words(F.col("text")), _word_statistics),
                "word_chars": F.length(F.regexp_replace(text, BLANK, "")).cast("long"),
                "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
                "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            }
        )
        .withColumns({"n_words": F.col("_counts.n"), "n_repeat_words": F.col("_counts.repeated")})
        .withColumn(
            "base_failed",
            (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
        )
        .drop("_counts")
    )


def _vector() -> dict[str, Column]:
    """Transformed statistics, free of the text's length: word length, symbols, repeated lines and repeated words."""
    chars, count = F.greatest("word_chars", F.lit(1)).cast("double"), F.greatest("n_words", F.lit(1)).cast("double")
    return {
        "_x1": F.log(chars / count),
        "_x2": F.sqrt(F.col("n_symbols") / chars),
        "_x3": F.sqrt(F.col("n_dup_lines") / count),
        "_x4": F.sqrt(F.col("n_repeat_words") / count) / F.log(count + 1.0),
    }


def _factored(out: DataFrame, spread: Callable[[int, int], Column]) -> DataFrame:
    """Means, the Cholesky factor of the covariance ``spread`` with its floors, and the log of its determinant."""
    p = len(STATISTICS)
    for i in range(p):
        for j in range(i + 1):
            value = spread(i, j) + (FLOOR[i] ** 2 if i == j else 0.0)
            for k in range(j):
                value = value - F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}")
            out = out.withColumn(f"_l{i}{j}", F.sqrt(F.greatest(value, F.lit(1e-12))) if i == j else value / F.col(f"_l{j}{j}"))
    det = sum((F.log(f"_l{i}{i}") for i in range(p)), F.lit(0.0))
    return out.select("_group", *[f"_m{i}" for i in range(p)], *[f"_l{i}{j}" for i in range(p) for j in range(i + 1)], det.alias("_det"))


def _moments(rows: DataFrame, scale: float = CONSISTENCY) -> DataFrame:
    """Mean and Cholesky factor of the covariance of each group; one row per group."""
    p = len(STATISTICS)
    sums = [F.avg(x).alias(f"_m{i}") for i, x in enumerate(STATISTICS)]
    sums += [F.covar_pop(STATISTICS[i], STATISTICS[j]).alias(f"_c{i}{j}") for i in range(p) for j in range(i + 1)]
    return _factored(rows.groupBy("_group").agg(*sums), lambda i, j: F.col(f"_c{i}{j}") * scale)


def _medians(rows: DataFrame) -> DataFrame:
    """The start that no half of the rows can move: coordinate-wise medians and median absolute deviations."""
    p = len(STATISTICS)
    half = lambda x: F.percentile_approx(x, F.lit(0.5), F.lit(1000))
    middles = stored(rows.groupBy("_group").agg(*[half(F.col(x)).alias(f"_m{i}") for i, x in enumerate(STATISTICS)]), "mcd-medians")
    off = rows.join(middles, "_group").groupBy("_group").agg(*[half(F.abs(F.col(x) - F.col(f"_m{i}"))).alias(f"_s{i}") for i, x in enumerate(STATISTICS)])
    return _factored(off.join(middles, "_group"), lambda i, j: F.pow(F.col(f"_s{i}") * MAD, 2) if i == j else F.lit(0.0))


def _distance(rows: DataFrame, shapes: DataFrame) -> DataFrame:
    """Adds ``_d``, the squared Mahalanobis distance to the shape of the row's group."""
    out = rows.join(shapes, "_group", "left")
    p = len(STATISTICS)
    for i, x in enumerate(STATISTICS):
        value = F.col(x) - F.col(f"_m{i}")
        for k in range(i):
            value = value - F.col(f"_l{i}{k}") * F.col(f"_z{k}")
        out = out.withColumn(f"_z{i}", value / F.col(f"_l{i}{i}"))
    total = sum((F.col(f"_z{i}") * F.col(f"_z{i}") for i in range(p)), F.lit(0.0))
    return out.withColumn("_d", total).drop(*[c for c in shapes.columns if c != "_group"], *[f"_z{i}" for i in range(p)])


def _nearest(rows: DataFrame, label: str) -> DataFrame:
    """Rows of each group up to the distance bin that fills KEPT_SHARE; bins are counted, so no group meets in one task."""
    binned = rows.withColumn("_bin", F.floor(F.log(F.col("_d") + 1e-9) * BINS))
    counts = binned.groupBy("_group", "_bin").agg(F.count("*").alias("_n"))
    run = Window.partitionBy("_group").orderBy("_bin")
    whole = Window.partitionBy("_group")
    cuts = (
        counts.withColumns({"_run": F.sum("_n").over(run), "_all": F.sum("_n").over(whole)})
        .where(F.col("_run") >= KEPT_SHARE * F.col("_all"))
        .groupBy("_group")
        .agg(F.min("_bin").alias("_cut"))
    )
    return binned.join(stored(cuts, label), "_group").where(F.col("_bin") <= F.col("_cut"))


def group_shapes(rows: DataFrame, label: str = "mcd") -> DataFrame:
    """Robust mean and covariance of each ``_group`` of stored rows: the nearest half with the least determinant found.

    Two starts, the group's medians with their absolute deviations and its mean with its covariance, run side by side. Each step keeps the
    half of the rows nearest to the present shape and takes their mean and covariance; a group takes steps until its determinant falls no
    more (distance bins vary the subset a little, so it is held against the least so far). The start with the lesser determinant gives the
    shape, so that nearly half of a group may be junk. The floor under the variances keeps the determinant positive where most rows agree
    exactly.
    """
    start = lambda shapes, k: shapes.withColumn("_group", F.concat(F.lit(f"{k} "), "_group"))
    shapes = stored(start(_medians(rows), 0).union(start(_moments(rows, 1.0), 1)), f"{label}-shape")
    twice = stored(rows.withColumn("_group", F.explode(F.array(*[F.concat(F.lit(f"{k} "), "_group") for k in range(2)]))), f"{label}-starts")
    settled = None  # the shape of least determinant so far; a start's own determinant is not that of a subset
    while True:
        falling = twice.join(shapes.select("_group"), "_group", "left_semi")
        shapes = stored(_moments(_nearest(_distance(falling, shapes), f"{label}-cut")), f"{label}-shape")
        if settled is None:
            settled = shapes
            continue
        before = settled.select("_group", F.col("_det").alias("_before"))
        shapes = stored(shapes.join(before, "_group").where(F.col("_det") < F.col("_before") - SETTLED).drop("_before"), f"{label}-fallen")
        if shapes.isEmpty():
            break
        settled = stored(settled.join(shapes, "_group", "left_anti").union(shapes), f"{label}-least")
    best = Window.partitionBy("_of").orderBy("_det", "_group")
    chosen = settled.withColumn("_of", F.substring("_group", 3, 1 << 30)).withColumn("_nth", F.row_number().over(best)).where(F.col("_nth") == 1)
    return stored(chosen.withColumn("_group", F.col("_of")).drop("_of", "_nth", "_det"), f"{label}-best")


def quality_rules(docs: DataFrame, cut: float = CUT, carry: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with its statistics, ``distance`` (squared, null where the base rule fails) and ``kept``.

    A document is kept if it passes the base rule and its transformed statistics lie within ``cut`` of the robust shape of its
    language and source. Groups under ``LEAST_GROUP`` rows are judged by their language, and languages under it by all
    rows. Null languages and sources are groups of their own. Rows do not affect each other otherwise, so repeated rows get
    equal verdicts; an empty table gives no rows. Columns of ``docs`` named like the added ones are replaced.

    Texts are read once and never shuffled: the rows are written with their statistics, and everything after that reads the
    written table. Otherwise a filter on the verdict would be pushed below the statistics and compute them again. ``carry``
    names the columns of ``docs`` to return beside the added ones; without it all are written, texts included. Shapes and cuts have a row per
    group; Spark broadcasts them by their measured size.
    """
    found = text_statistics(docs).withColumns({"_lang": F.col("lang"), "_source": F.col("source")}).drop("distance", "kept")
    if carry is not None:
        found = found.select(*[c for c in carry if c in found.columns and c not in ADDED], *ADDED, "_lang", "_source")
    measured = stored(found, "quality-statistics")
    vectors = stored(
        measured.where(~F.col("base_failed")).select("_lang", "_source", *[v.alias(k) for k, v in _vector().items()]),
        "quality-vectors",
    )
    counts = vectors.groupBy("_lang", "_source").agg(F.count("*").alias("_n"))
    by_lang = Window.partitionBy("_lang")
    pair = F.to_json(F.struct("_lang", "_source"))
    names = stored(
        counts.withColumn("_of_lang", F.sum("_n").over(by_lang)).select(
            F.col("_lang").alias("_gl"), F.col("_source").alias("_gs"),
            F.when(F.col("_n") >= LEAST_GROUP, F.concat(F.lit("pair "), pair))
            .when(F.col("_of_lang") >= LEAST_GROUP, F.concat(F.lit("lang "), F.to_json(F.struct("_lang"))))
            .otherwise("all").alias("_group"),
            (F.col("_of_lang") >= LEAST_GROUP).alias("_lang_group"),
        ),
        "quality-groups",
    )

    def named(rows: DataFrame, lang: str, source: str) -> DataFrame:
        return rows.join(names, F.col(lang).eqNullSafe(F.col("_gl")) & F.col(source).eqNullSafe(F.col("_gs")), "left").drop("_gl", "_gs", "_lang_group")

    # A fallback group is estimated from all its rows, so a row counts for its pair, its language and the whole.
    wanted = names.select(F.col("_group").alias("_wanted")).distinct()
    every = vectors.withColumn(
        "_group", F.explode(F.array(F.concat(F.lit("pair "), pair), F.concat(F.lit("lang "), F.to_json(F.struct("_lang"))), F.lit("all")))
    ).join(wanted, F.col("_group") == F.col("_wanted"), "left_semi").drop("_lang", "_source")
    shapes = group_shapes(stored(every, "quality-members"))
    judged = _distance(named(measured.withColumns(_vector()), "_lang", "_source"), shapes)
    return judged.withColumns(
        {
            "distance": F.when(~F.col("base_failed"), F.col("_d")),
            "kept": ~F.col("base_failed") & F.coalesce(F.col("_d") <= cut, F.lit(True)),
        }
    ).drop("_group", "_d", "_lang", "_source", *STATISTICS)
