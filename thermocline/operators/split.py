"""Repeatable samples and stratified splits, ordered by a hash of the row id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermocline.operators.ordered import position_in_slabs

# Hex digits of the hash that name a slab: 65,536 even slabs.
SLAB_DIGITS = 4


def shuffle_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))


def sample_rows(
    df: DataFrame, n: int | None, seed: int = 42, key: str = "obs_id", replace: bool = False
) -> DataFrame:
    """At most ``n`` rows: the ones with the smallest hashes, so repeatable; all rows without ``n``.

    ``replace`` makes ``n`` repeatable draws with replacement instead: each draw's hash names the position of a row in
    the order of the rows' hashes.
    """
    if n is None:
        return df
    if replace:
        slab = F.conv(F.substring("_hash", 1, SLAB_DIGITS), 16, 10).cast("int")
        hashed = df.withColumns({"_hash": shuffle_hash(key, seed), "_all": F.lit(0)})
        ranked = position_in_slabs(hashed, ["_all"], slab, [F.col("_hash")], "_rank")
        drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-draw-"), F.col("id").cast("string"))), 1, 12), 16, 10).cast("long")
        total = F.nullif(df.agg(F.count("*")).scalar(), F.lit(0))
        draws = df.sparkSession.range(n).select((1 + F.pmod(drawn, total)).alias("_drawn"))
        return draws.join(ranked, F.col("_drawn") == F.col("_rank")).select(*df.columns)
    return _least_hashes(df.withColumn("_hash", shuffle_hash(key, seed)), n).drop("_hash")


def _least_hashes(hashed: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of least ``_hash``; ties at the cut are settled by the row's other columns.

    A histogram of hash slabs gives the slab in which the n-th row falls. Rows of the slabs before it are taken as they are, by a filter, and only
    that one slab is ranked, so no task sees more rows than a slab has, however large ``n`` is.
    """
    slabbed = hashed.withColumn("_slab", _slab())
    counts = slabbed.groupBy("_slab").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # At most one row per slab passes this window, and one row leaves it: the slab with the n-th row, if there are so many.
    cut = counts.withColumn("_before", before).where((F.col("_before") < n) & (F.col("_before") + F.col("_n") >= n))
    edge = cut.agg(F.max("_slab").alias("slab"), F.max("_before").alias("before"))
    slab = F.coalesce(edge.select("slab").scalar(), F.lit(1 << 62))
    whole = slabbed.where(F.col("_slab") < slab)
    sortable = [c for c in hashed.columns if c != "_hash" and "map<" not in hashed.schema[c].dataType.simpleString()]
    order = Window.partitionBy("_slab").orderBy("_hash", *[F.col(f"`{c}`") for c in sortable])
    part = slabbed.where(F.col("_slab") == slab).withColumn("_rank", F.row_number().over(order))
    kept = part.where(F.col("_rank") <= n - edge.select("before").scalar()).drop("_rank")
    return whole.union(kept).drop("_slab") if n > 0 else hashed.limit(0)


def _slab():
    return F.conv(F.substring("_hash", 1, SLAB_DIGITS), 16, 10).cast("long")


def stratified_split(
    df: DataFrame, label: str, test: float = 0.2, val: float | None = None, seed: int = 42, key: str = "obs_id"
) -> DataFrame:
    """Adds ``split``: of each class, ceil(test * n) rows go to test, then ceil(val * rest) to val.

    ``key`` is a unique row id. Rows are ranked in even slabs of their hash, so a class that holds
    most rows is not sorted in one task.
    """
    slab = F.conv(F.substring("_hash", 1, SLAB_DIGITS), 16, 10).cast("int")
    hashed = df.withColumn("_hash", shuffle_hash(key, seed))
    ranked = position_in_slabs(hashed, [label], slab, [F.col("_hash")], "_rank")
    n_test = F.ceil(F.lit(float(test)) * F.col("_total"))
    n_val = F.ceil(F.lit(float(val or 0.0)) * (F.col("_total") - n_test))
    part = (
        F.when(F.col("_rank") <= n_test, "test").when(F.col("_rank") <= n_test + n_val, "val").otherwise("train")
    )
    return ranked.withColumn("split", part).drop("_hash", "_rank", "_total")
