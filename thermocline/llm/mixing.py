"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermocline.llm.common import hashed_unit, prefix_sums, stored, word_count

MOST_EPOCHS = 3
# Weights of the sources in code point order, repeating, and the characters that lower a text's quality.
SOURCE_WEIGHTS = (1.0, 2.0, 3.0)
MARKS = "#*$%&|<>"
SEED = 7


def quality_weight(text: Column) -> Column:
    """1 for a text without symbol characters, falling by their share to 0.05; 0.05 for an empty or null text."""
    length = F.length(text)
    plain = F.length(F.translate(text, MARKS, ""))
    return F.coalesce(F.greatest(F.lit(0.05), 1.0 - 5.0 * (length - plain) / F.nullif(length, F.lit(0))), F.lit(0.05))


def sampling_key(quality: Column, *identity: Column, seed: int = SEED) -> Column:
    """Exponential with rate ``quality``: the rows with the smallest keys are a weighted sample without replacement."""
    return -F.log(hashed_unit(*identity, seed=seed)) / quality


def _targets(sizes: DataFrame, most: int) -> DataFrame:
    """Target of each source: its weight's share of the sum of all sizes, at most ``most`` times its size.

    With sources sorted by cap over weight the capped ones come first, so the common level is found from running
    sums instead of by repeated sharing. The table has one row per source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in SOURCE_WEIGHTS]), (rank % len(SOURCE_WEIGHTS) + 1).cast("int"))
    weighed = sizes.withColumn("_rank", rank).withColumn("weight", weight).withColumn(
        "_cap", most * F.col("source_size").cast("double")
    )
    by = Window.orderBy(F.col("_cap") / F.col("weight"), "_rank")
    everything = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = weighed.withColumn(
        "_level",
        (
            F.sum(F.col("source_size").cast("double")).over(everything)
            - F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        )
        / F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)),
    ).withColumn("_free", F.col("_cap") / F.col("weight") > F.col("_level"))
    level = F.min(
        F.when(F.col("_free"), F.struct(F.col("_cap") / F.col("weight"), F.col("_rank"), F.col("_level")))
    ).over(everything)["_level"]
    starts = Window.orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    return levels.select(
        "source", "source_size", "weight",
        F.least(F.col("_cap"), F.coalesce(level * F.col("weight"), F.col("_cap"))).alias("target"),
        F.coalesce(F.sum("source_size").over(starts), F.lit(0)).alias("_source_start"),
    )


def mix(docs: DataFrame, size: Column | None = None, quality: Column | None = None, most: int = MOST_EPOCHS, seed: int = SEED) -> DataFrame:
    """Adds ``size``, ``source_size``, ``target`` and ``copies`` (how often the mix takes the document) to ``docs``.

    A source whose target is e + f times its size gives every document e times and, for the rest, those with the smallest
    keys until their sizes reach the rest; the document at the edge is taken if that comes closer to the target.
    Keys come from ``doc_id`` and text alone, so reruns agree, and repeats of a row are taken or left together. Sizes
    default to words. A null source is a source of its own, after all others; null and empty texts have size 0
    and are taken in whole epochs, or in the rest if their key is small. An empty table gives no rows. Columns of ``docs``
    named like the four added ones are replaced.

    Only (source, key, size) are sorted; the cut is then one key per source, so texts are never shuffled. The sources
    (with their cuts) are a small table, which Spark broadcasts by its measured size.
    """
    text = F.col("text")
    key = sampling_key(quality if quality is not None else quality_weight(text), F.col("doc_id"), F.md5(F.coalesce(text, F.lit(""))), seed=seed)
    added = ("size", "source_size", "target", "copies")
    sized = docs.withColumns({"_size": size if size is not None else word_count(text), "_key": key}).drop(*added)
    light = stored(sized.select("source", "_size", "_key"), "mix-keys")
    sources = stored(_targets(light.groupBy("source").agg(F.sum("_size").alias("source_size")), most), "mix-sources")
    epochs = F.coalesce(F.least(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(most)), F.lit(0))
    sources = sources.withColumn("_epochs", epochs).withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    placed = prefix_sums(light, [F.col("source"), F.col("_key")], "_size", "mix").alias("p")
    s = sources.alias("s")
    left = F.col("_rest") - (F.col("_start") - F.col("_source_start"))
    edges = (
        placed.join(s, F.col("p.source").eqNullSafe(F.col("s.source")))
        .where((left > 0) & (2.0 * left >= F.col("_size")))
        .groupBy("s.source")
        .agg(F.max("_key").alias("_edge"))
    )
    cuts = stored(
        s.join(edges.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")), "left").select(
            F.col("s.source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"),
            "_epochs", "_edge",
        ),
        "mix-cuts",
    )
    extra = F.coalesce((F.col("_key") <= F.col("_edge")).cast("long"), F.lit(0))
    return (
        sized.join(cuts, F.col("source").eqNullSafe(F.col("_s")))
        .withColumns(
            {"size": F.col("_size"), "source_size": F.col("_source_size"), "target": F.col("_target"), "copies": F.col("_epochs") + extra}
        )
        .drop("_s", "_size", "_key", "_source_size", "_target", "_epochs", "_edge")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    taken = mix(docs, **options).where(F.col("copies") > 0)
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)
