"""Hard negatives by angular triangle filtering.

Each row stores its angle to some reference directions. The angle between an anchor and a row is at least the difference and at most the sum of their angles to
one direction; the cosines of these limits times both norms, rounded outwards, bound the score. Only rows whose bounds overlap a window of
scores that still matters are scored, in integers. Rows are sorted by label and nearest direction and cut into blocks, whose ranges of angles
leave out whole blocks first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermocline.llm.common import stored

# Grid of a component, and the share of the positive's score (in 1/100) that a negative may have.
GRID, LEAST_SHARE, MOST_SHARE = 256, 50, 95
POSITIVES, NEGATIVES = 5, 3
DIRECTIONS = 12  # reference directions, chosen far apart among a bounded sample of rows
SAMPLE = 1024
BLOCK = 4096  # rows of a block
PART = 4096  # anchors of a part
LANES = 64  # over which the descriptions of parts are spread where each meets that of each block
TILE = 64  # anchors of a step in a task
SLACK = 1e-5  # of an angle (32 bits) and, relative to the norms, of a cosine
LARGEST = 1e7  # of a component; beyond it, or beyond SQUARES, a score may not fit 64 bits
SQUARES = 9.0e18


def prepared(rows: DataFrame) -> DataFrame:
    """``vec_id``, ``label`` and the integer ``vector`` of the rows that take part.

    A row takes no part without id, label or vector, with a null or non-finite component, or with components so large that a score would
    not fit 64 bits (any above 1e7 in size, or a squared integer norm above 9e18). A vector shorter than another one counts as followed by zeros.
    """
    x = F.col("embedding")
    read = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>"))
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= LARGEST))
    valid = read.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()).where(whole)
    vector = F.transform(x, lambda v: F.floor(v * float(GRID)))
    square = F.aggregate(F.col("vector"), F.lit(0.0), lambda t, v: t + v.cast("double") * v.cast("double"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return valid.select("vec_id", moved.alias("label"), vector.alias("vector")).where(square <= SQUARES)


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    """Lists as the rows of a matrix, shorter ones filled with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.asarray(lists.offsets)
    values = np.asarray(lists.flatten()).astype(kind, copy=False)
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width)
    filled = np.zeros((len(sizes), width), dtype=kind)
    row = np.repeat(np.arange(len(sizes)), sizes)
    filled[row, np.arange(len(values)) - (np.cumsum(sizes) - sizes)[row]] = values
    return filled


def directions(rows: DataFrame, count: int = DIRECTIONS, sample: int = SAMPLE) -> np.ndarray:
    """Unit vectors far apart from each other: the sample (the least hashes of ids) is bounded, and the choice only affects how much is left out."""
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    some = rows.select("vector", F.xxhash64("vec_id").alias("h")).orderBy("h", "vec_id").limit(sample).select("vector").toArrow()
    if not width or not some.num_rows:
        return np.zeros((0, width))
    found = _matrix(some.column("vector"), width, np.float64)
    norms = np.linalg.norm(found, axis=1)
    units = found[norms > 0] / norms[norms > 0, None]
    if not len(units):
        return np.zeros((0, width))
    chosen = [0]
    nearest = units @ units[0]
    while len(chosen) < min(count, len(units)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    return units[chosen]


PLACED = "vec_id long, label long, vector array<long>, norm double, angles array<float>, nearest int, near float, tie long"


def _placed(references: np.ndarray):
    count, width = references.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("vector"), width, np.float64)
            norms = np.linalg.norm(vectors, axis=1)
            cosines = (vectors @ references.T) / np.where(norms > 0, norms, 1.0)[:, None]
            angles = np.arccos(np.clip(cosines, -1.0, 1.0)).astype(np.float32)
            nearest = np.argmin(angles, axis=1) if count else np.zeros(len(vectors), dtype=np.int64)
            near = angles[np.arange(len(vectors)), nearest] if count else np.zeros(len(vectors), dtype=np.float32)
            lists = pa.ListArray.from_arrays(np.arange(len(vectors) + 1, dtype=np.int32) * count, pa.array(angles.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("vec_id", "label", "vector")), pa.array(norms), lists,
                 pa.array(nearest.astype(np.int32)), pa.array(near), batch.column("tie")],
                names=["vec_id", "label", "vector", "norm", "angles", "nearest", "near", "tie"],
            )

    return run


BLOCKED = "vec_id long, label long, vector array<long>, norm double, angles array<float>, block long"


def _blocked(rows: int):
    """Task code: numbers the rows of a partition, which come sorted, in blocks of ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            numbers = (seen + np.arange(batch.num_rows)) // rows + (task << 32)
            seen += batch.num_rows
            names = [n for n in batch.schema.names if n not in ("nearest", "near", "tie")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(numbers)], names=[*names, "block"])

    return run


def in_blocks(rows: DataFrame, references: np.ndarray, size: int = BLOCK) -> DataFrame:
    """Rows with norm and angles, sorted by label, nearest direction and angle to it, in blocks; equal rows are dealt out like any others."""
    placed = rows.withColumn("tie", F.monotonically_increasing_id()).mapInArrow(_placed(references), PLACED)
    by = ["label", "nearest", "near", "vec_id", "tie"]
    return stored(placed.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_blocked(size), BLOCKED), "negatives-rows")


class _Side:
    """Rows or anchors of a group as matrices."""

    def __init__(self, table: pa.Table, width: int, count: int):
        self.ids = np.asarray(table.column("vec_id"))
        self.labels = np.asarray(table.column("label"))
        self.vectors = _matrix(table.column("vector"), width, np.int64)
        self.norms = np.asarray(table.column("norm"))
        self.angles = _matrix(table.column("angles"), count, np.float32)


def _bounds(a: _Side, rows: slice, b: _Side) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score that the angles allow for each pair of anchor and row, rounded outwards."""
    shape = (len(a.norms[rows]), len(b.norms))
    apart, together = np.zeros(shape, dtype=np.float32), np.full(shape, np.pi, dtype=np.float32)
    for k in range(a.angles.shape[1]):
        mine, theirs = a.angles[rows, k][:, None], b.angles[:, k][None]
        np.maximum(apart, np.abs(mine - theirs), out=apart)
        both = mine + theirs
        np.minimum(together, np.minimum(both, np.float32(2 * np.pi) - both), out=together)
    norms = a.norms[rows][:, None] * b.norms[None]
    most = norms * (np.cos(np.maximum(apart - np.float32(SLACK), 0)).astype(np.float64) + SLACK) + 1.0
    least = norms * (np.cos(np.minimum(together + np.float32(SLACK), np.float32(np.pi))).astype(np.float64) - SLACK) - 1.0
    return least, most


def _best(ids: np.ndarray, scores: np.ndarray, count: int) -> np.ndarray:
    """Places of the first ``count`` rows by score, then id."""
    if len(scores) > 4 * count:
        edge = np.partition(scores, len(scores) - count)[len(scores) - count]
        some = np.flatnonzero(scores >= edge)
        return some[np.lexsort((ids[some], -scores[some]))[:count]]
    return np.lexsort((ids, -scores))[:count]


FOUND = "anchor long, slot int, id long, score long"


def _record(found: list[tuple]) -> pa.Table:
    columns = list(zip(*found)) if found else [[], [], [], []]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["anchor", "slot", "id", "score"])


def _positives(width: int, count: int, wanted: int):
    """Task code: the best rows of the anchor's label in one block, for the anchors of one part."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        a, b, found = _Side(anchors, width, count), _Side(rows, width, count), []
        keys, floors = np.asarray(anchors.column("anchor")), np.asarray(anchors.column("floor"))
        for start in range(0, len(keys), TILE):
            tile = slice(start, min(start + TILE, len(keys)))
            _, most = _bounds(a, tile, b)
            open_ = (a.labels[tile][:, None] == b.labels[None]) & (a.ids[tile][:, None] != b.ids[None]) & (most >= floors[tile][:, None])
            for i in np.flatnonzero(open_.any(axis=1)):
                at = np.flatnonzero(open_[i])
                scores = b.vectors[at] @ a.vectors[start + i]
                for j in _best(b.ids[at], scores, wanted):
                    found.append((keys[start + i], 0, b.ids[at[j]], scores[j]))
        return _record(found)

    return run


def _negatives(width: int, count: int, wanted: int):
    """Task code: for each window of each anchor, the best rows of another label whose score is in it, in one block."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        a, b, found = _Side(anchors, width, count), _Side(rows, width, count), []
        keys, windows = np.asarray(anchors.column("anchor")), anchors.column("windows").to_pylist()
        for start in range(0, len(keys), TILE):
            tile = slice(start, min(start + TILE, len(keys)))
            least, most = _bounds(a, tile, b)
            other = a.labels[tile][:, None] != b.labels[None]
            for i in range(most.shape[0]):
                spans = windows[start + i]
                overlap = np.zeros(len(b.ids), dtype=bool)
                for span in spans:
                    overlap |= (most[i] >= span["low"]) & (least[i] <= span["high"])
                at = np.flatnonzero(overlap & other[i])
                if not len(at):
                    continue
                scores = b.vectors[at] @ a.vectors[start + i]
                for span in spans:
                    inside = np.flatnonzero((scores >= span["low"]) & (scores <= span["high"]))
                    for j in inside[_best(b.ids[at[inside]], scores[inside], wanted)]:
                        found.append((keys[start + i], span["slot"], b.ids[at[j]], scores[j]))
        return _record(found)

    return run


def _ranges(rows: DataFrame, key: str, count: int) -> DataFrame:
    """One row a block or part: labels, largest norm, and the range of its angles to each direction."""
    angles = F.col("angles")
    low = F.array(*[F.min(angles[k]) for k in range(count)]) if count else F.array().cast("array<float>")
    high = F.array(*[F.max(angles[k]) for k in range(count)]) if count else F.array().cast("array<float>")
    return rows.groupBy(key).agg(
        F.min("label").alias("label_low"), F.max("label").alias("label_high"), F.max("norm").alias("norm"), low.alias("low"), high.alias("high")
    )


def _most_score(x: str, y: str) -> Column:
    """Largest score that the ranges of angles allow for rows of two blocks."""
    gaps = F.zip_with(
        F.arrays_zip(F.col(f"{x}.low"), F.col(f"{x}.high")), F.arrays_zip(F.col(f"{y}.low"), F.col(f"{y}.high")),
        lambda p, q: F.greatest(p["low"] - q["high"], q["low"] - p["high"], F.lit(0.0).cast("float")).cast("double"),
    )
    apart = F.greatest(F.coalesce(F.array_max(gaps), F.lit(0.0)) - SLACK, F.lit(0.0))
    return F.col(f"{x}.norm") * F.col(f"{y}.norm") * (F.cos(apart) + SLACK) + 1.0


def _met(anchors: DataFrame, rows: DataFrame, pairs: DataFrame, run) -> DataFrame:
    """``run`` on each pair of a part of anchors and a block of rows; both are of bounded size."""
    left = anchors.join(pairs, "part")
    right = rows.join(pairs, "block")
    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(run, FOUND)


def _first(found: DataFrame, count: int) -> DataFrame:
    """The first ``count`` of each anchor and slot by score, then id, and their ``rank``; Spark limits each task to them before the shuffle."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def _window(score: Column) -> Column:
    """Scores n with LEAST_SHARE * score <= 100 * n <= MOST_SHARE * score, as whole numbers; decimals hold the products."""
    wide = score.cast("decimal(20,0)")
    return F.struct(
        F.ceil(wide * LEAST_SHARE / 100).cast("long").alias("low"), F.floor(wide * MOST_SHARE / 100).cast("long").alias("high")
    )


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK, part: int = PART,
    count: int = DIRECTIONS,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    ``rows`` as from ``prepared``; anchors are those that fulfil ``is_anchor``. A score is the inner product with the anchor, higher ones first, ties by
    smaller ``vec_id``. Positives are the anchor's first rows of its label. For each, the negatives are the first rows of another label whose score
    is in the positive's window. No row of the anchor's own ``vec_id`` is its partner; otherwise each repeated row counts, and a repeated anchor gives its
    rows again. An empty table gives none. Every pair of an anchor and a row is bounded, in parts of anchors against blocks of rows.
    """
    rows = stored(rows, "negatives-read")
    references = directions(rows, count)
    count, width = references.shape
    held = in_blocks(rows, references, block)
    numbered = stored(held.where(is_anchor).withColumn("anchor", F.monotonically_increasing_id()), "negatives-anchors")

    # A score that five rows of the anchor's own block reach: rows that cannot reach it are no positives.
    own = numbered.withColumn("floor", F.lit(np.iinfo(np.int64).min))
    beside = held.join(numbered.select("block").distinct(), "block", "left_semi")
    near = own.groupBy("block").cogroup(beside.groupBy("block")).applyInArrow(_positives(width, count, positives), FOUND)
    floors = near.groupBy("anchor").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= positives)
    floored = numbered.join(floors.select("anchor", "least"), "anchor", "left").withColumn("floor", F.coalesce("least", F.lit(np.iinfo(np.int64).min)))
    by = ["label", "block", "anchor"]
    cut = T.StructType([*floored.drop("least", "block").schema.fields, T.StructField("part", T.LongType())])
    anchors = stored(
        floored.drop("least").repartitionByRange(*by).sortWithinPartitions(*by).drop("block").mapInArrow(_parted(part), cut), "negatives-parts"
    )

    blocks, parts = stored(_ranges(held, "block", count), "negatives-blocks"), stored(
        _ranges(anchors, "part", count).join(anchors.groupBy("part").agg(F.min("floor").alias("floor")), "part"), "negatives-ranges"
    )
    same = anchors.select("part", "label").distinct().join(held.select("block", "label").distinct(), "label").select("part", "block").distinct()
    meet = same.join(parts.alias("a"), "part").join(blocks.alias("b"), "block").where(_most_score("a", "b") >= F.col("floor"))
    found = _met(anchors, held, stored(meet.select("part", "block"), "negatives-pairs"), _positives(width, count, positives))
    first = stored(_first(found, positives), "negatives-positives")

    spans = first.select("anchor", F.struct(F.col("rank").alias("slot"), _window(F.col("score")).alias("w")).alias("s"))
    spans = spans.where(F.col("s.w.low") <= F.col("s.w.high")).groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct("s.slot", "s.w.low", "s.w.high"))).alias("windows")
    )
    spanned = stored(anchors.drop("floor").join(spans, "anchor"), "negatives-windows")
    lowest = spanned.groupBy("part").agg(F.min(F.array_min(F.transform("windows", lambda w: w["low"]))).alias("lowest"))
    bounded = parts.drop("floor").join(lowest, "part")
    one_label = (F.col("a.label_low") == F.col("a.label_high")) & (F.col("b.label_low") == F.col("b.label_high"))
    lanes = bounded.withColumn("lane", F.pmod(F.xxhash64("part"), F.lit(LANES)))
    spread = blocks.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LANES - 1).cast("long"))))
    meet = lanes.alias("a").join(spread.alias("b"), "lane").where(_most_score("a", "b") >= F.col("a.lowest"))
    meet = meet.where(~(one_label & (F.col("a.label_low") == F.col("b.label_low")))).select("a.part", "b.block")
    found = _met(spanned, held, stored(meet, "negatives-pairs"), _negatives(width, count, negatives))
    chosen = _first(found, negatives).withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score")
    kept = first.select("anchor", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = numbered.select("anchor", F.col("vec_id").alias("anchor_id"))
    return chosen.join(kept, ["anchor", "slot"]).join(ids, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


def _parted(size: int):
    """Task code: numbers the anchors of a partition, which come sorted, in parts of ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            numbers = (seen + np.arange(batch.num_rows)) // size + (task << 32)
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers)], names=[*batch.schema.names, "part"])

    return run
