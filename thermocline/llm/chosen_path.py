"""Near-duplicates by chosen paths: documents branch on selected minwise tokens, small nodes are compared exhaustively, trees repeat.

A document is the set of its distinct 5-word shingles. Equal sets are one class. A class has ``COORDINATES`` minwise tokens; the share on which two
classes agree estimates their Jaccard similarity. A node of a tree selects one or two coordinates, 1 / similarity on average, and sends
each of its classes to one child a selected coordinate, named by the node and the class's token there. Two classes at the threshold so share one child on
average, less similar ones fewer, and a node is compared once its pairs are few. All is done level by level, in joins and groupings on the node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermocline.llm.common import BLANK, stored
from thermocline.llm.components import components

SHINGLE = 5  # words
SIMILARITY = 0.85
SEED = 42
COORDINATES = 128  # minwise tokens of a class
RECALL = 0.9999  # of a pair at the threshold that meets at level RECALL_LEVEL
RECALL_LEVEL = 3
MOST_LEVELS = 8  # nodes still large there are compared as they are
SMALL = 4096  # classes of a small node, whose shingles are no more than SMALL_SETS
SMALL_SETS = 1 << 22
TINY = 32  # classes of a node whose pairs are joined; larger ones are compared inside a task, which returns links alone
FEW = 64  # classes outside the largest component of a node that is compared whatever its size
STRIP = 256  # classes compared with all others of a node in a step of task code
SPREAD = 5.0  # standard deviations of the number of differing sketch bits that a comparison allows
TOGETHER = 256  # texts in a step of task code
FILTER_BITS = 1 << 25  # of the table that leaves texts out before they are moved: 4 MB, whatever the number of texts
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 64-bit hash of each distinct shingle, ordered by both.

    A-Z is lower-cased and words end at ASCII white space. Fewer than ``width`` words are one shingle; a null or wordless text has none.
    """
    import xxhash

    # Trimmed first: Arrow's lower-casing of a slice reads from the wrong offset.
    trimmed = pc.replace_substring_regex(pc.fill_null(texts.cast(pa.large_string()), ""), f"^{BLANK}|{BLANK}$", "")
    split = pc.split_pattern_regex(pc.ascii_lower(trimmed), BLANK)
    offsets, coded = np.asarray(split.offsets), split.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) if w else 0 for w in distinct), dtype=np.uint64, count=len(distinct))
    filled = np.fromiter((bool(w) for w in distinct), dtype=bool, count=len(distinct))
    at = np.asarray(coded.indices, dtype=np.int64)
    keep = filled[at] if len(at) else np.zeros(0, dtype=bool)
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))[keep]
    word = hashes[at[keep]]
    sizes = np.bincount(text, minlength=len(texts))
    left = np.cumsum(sizes)[text] - np.arange(len(word))
    total = np.ones(len(word), dtype=np.uint64)
    for k in range(width):
        after = np.append(word[k:], np.zeros(min(k, len(word)), dtype=np.uint64))
        total = np.where(left > k, total * _MIX + after, total)
    total ^= total >> np.uint64(33)
    total *= np.uint64(0xFF51AFD7ED558CCD)
    total ^= total >> np.uint64(33)
    starts = (left >= width) | (left == sizes[text])
    text, total = text[starts], total[starts]
    order = np.lexsort((total, text))
    text, total = text[order], total[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (total[1:] != total[:-1])
    return text[new], total[new]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, TOGETHER):
            yield whole.slice(at, TOGETHER)


def _minwise(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Least 32-bit hash of each set (they begin at ``starts``) under each coordinate's hash function."""
    rng = np.random.default_rng(SEED)
    odd = rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flip = rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
    least = np.empty((len(starts), COORDINATES), dtype=np.uint32)
    for k in range(COORDINATES):
        mixed = (shingles ^ flip[k]) * odd[k]
        least[:, k] = np.minimum.reduceat((mixed >> np.uint64(32)).astype(np.uint32), starts)
    return least


SKETCHED = "doc_id long, text string, n int, c1 long, c2 long, low long, high long, tokens binary"


def _sketched(width: int):
    """Task code: size, 128-bit name, 128-bit sketch (the parity of each token) and tokens of each text's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in _slices(batches):
            text, shingles = shingle_sets(batch.column("text"), width)
            sizes = np.bincount(text, minlength=batch.num_rows)
            filled = np.flatnonzero(sizes)
            ends = np.cumsum(sizes)
            names = np.zeros((batch.num_rows, 2), dtype=np.int64)
            bits = np.zeros((batch.num_rows, 2), dtype=np.int64)
            tokens: list[bytes | None] = [None] * batch.num_rows
            if len(filled):
                least = _minwise(shingles, (ends - sizes)[filled])
                bits[filled] = np.packbits((least & 1).astype(np.uint8), axis=1, bitorder="little").view(np.int64)
                for row, i in zip(least, filled):
                    tokens[i] = row.tobytes()
                    names[i] = np.frombuffer(xxhash.xxh3_128_digest(shingles[ends[i] - sizes[i] : ends[i]].tobytes(), SEED), dtype=np.int64)
            columns = [sizes.astype(np.int32), names[:, 0], names[:, 1], bits[:, 0], bits[:, 1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), *(pa.array(c) for c in columns), pa.array(tokens, pa.binary())],
                names=["doc_id", "text", "n", "c1", "c2", "low", "high", "tokens"],
            )

    return run


def _mixed(*parts: np.ndarray | np.uint64) -> np.ndarray:
    total = np.uint64(SEED)
    for part in parts:
        total = (total ^ part) * _MIX
        total ^= total >> np.uint64(32)
    return total


def _children(similarity: float):
    """Task code: from rows ``at`` (the node of the tree), ``node`` (the class) and its tokens to a row a child.

    A node selects one coordinate, and a second one in as many nodes as makes 1 / similarity on average; the choice hangs on the node alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.asarray(batch.column("at")).view(np.uint64)
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)
            rows = np.arange(batch.num_rows)
            first = (_mixed(at, np.uint64(1)) % np.uint64(COORDINATES)).astype(np.int64)
            step = 1 + (_mixed(at, np.uint64(2)) % np.uint64(COORDINATES - 1)).astype(np.int64)
            twice = (_mixed(at, np.uint64(3)) >> np.uint64(11)) * 2.0**-53 < 1.0 / similarity - 1.0
            picked = [(rows, first), (rows[twice], ((first + step) % COORDINATES)[twice])]
            row = np.concatenate([r for r, _ in picked])
            spot = np.concatenate([c for _, c in picked])
            child = _mixed(at[row], spot.astype(np.uint64), tokens[row, spot].astype(np.uint64)).view(np.int64)
            kept = pa.array(row)
            columns = [batch.column(c).take(kept) for c in ("node", "n", "low", "high")]
            yield pa.RecordBatch.from_arrays([pa.array(child), *columns], names=["at", "node", "n", "low", "high"])

    return run


POSTED = "at long, node long, n int, low long, high long"


def _trees(similarity: float, recall: float, level: int = RECALL_LEVEL) -> int:
    """Independent trees that make the chance of a pair at the threshold to share no node at ``level`` at most 1 - recall."""
    twice, missed = 1.0 / similarity - 1.0, 0.0
    for _ in range(level):
        lost = 1.0 - similarity * (1.0 - missed)
        missed = (1.0 - twice) * lost + twice * lost * lost
    return max(1, math.ceil(math.log(1.0 - recall) / math.log(missed)))


def _verified(width: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            (ta, sa), (tb, sb) = (shingle_sets(batch.column(c), width) for c in ("text_a", "text_b"))
            text, shingles = np.concatenate([ta, tb]), np.concatenate([sa, sb])
            order = np.lexsort((shingles, text))
            text, shingles = text[order], shingles[order]
            same = (text[1:] == text[:-1]) & (shingles[1:] == shingles[:-1])
            shared = np.bincount(text[1:][same], minlength=batch.num_rows)
            every = np.bincount(text, minlength=batch.num_rows) - shared
            near = pa.array(shared * 100 >= np.round(similarity * 100, 6) * every)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(near)

    return run


def _allowed_bits(similarity: float) -> int:
    share = (1.0 - similarity) / 2.0
    return math.ceil(COORDINATES * share + SPREAD * math.sqrt(COORDINATES * share * (1.0 - share)))


def _alike(x: str, y: str, similarity: float) -> Column:
    """What two classes of at least that similarity must fulfil: sizes within the ratio and sketches within the allowed bits."""
    differing = sum((F.bit_count(F.col(f"{c}_{x}").bitwiseXOR(F.col(f"{c}_{y}"))) for c in ("low", "high")), F.lit(0))
    sizes = F.least(f"n_{x}", f"n_{y}") >= similarity * F.greatest(f"n_{x}", f"n_{y}") - 1e-9
    return sizes & (differing <= _allowed_bits(similarity))


class _Node:
    """The classes of a node in a task, by size, so that those within the ratio of sizes stand next to each other."""

    def __init__(self, table: pa.Table, similarity: float):
        sizes = np.asarray(table.column("n"))
        self.order = np.argsort(sizes, kind="stable")
        self.node, self.root, self.n, self.low, self.high = (
            np.asarray(table.column(c))[self.order] for c in ("node", "root", "n", "low", "high")
        )
        self.low, self.high = self.low.view(np.uint64), self.high.view(np.uint64)  # bits of negative numbers are counted without their sign
        self.ends = np.searchsorted(self.n, self.n / similarity + 1e-9, side="right")
        self.bits = _allowed_bits(similarity)

    def near(self, start: int, stop: int) -> tuple[int, np.ndarray]:
        """For the classes of a strip: whether each of those after ``start`` that may be similar to it differs in few enough bits."""
        last = int(self.ends[stop - 1])
        differing = sum(np.bitwise_count(x[start:stop, None] ^ x[None, start:last]).astype(np.uint8) for x in (self.low, self.high))
        ahead = np.arange(start, last)[None] > np.arange(start, stop)[:, None]
        return last, (differing <= self.bits) & ahead & (np.arange(start, last)[None] < self.ends[start:stop, None])


ACTIVE = "at long, i int, j int, node long"


def _active(similarity: float):
    """Task code: the classes of a node that may be similar to one of another component, by size and sketch."""

    def run(table: pa.Table) -> pa.Table:
        held = _Node(table, similarity)
        chosen = np.zeros(len(held.n), dtype=bool)
        for start in range(0, len(held.n), STRIP):
            stop = min(start + STRIP, len(held.n))
            last, near = held.near(start, stop)
            near &= held.root[start:stop, None] != held.root[None, start:last]
            chosen[start:stop] |= near.any(axis=1)
            chosen[start:last] |= near.any(axis=0)
        table = table.take(pa.array(held.order[chosen]))
        return table.select(["at", "i", "j", "node"])

    return run


def _node_links(similarity: float):
    """Task code: links of a node's classes, confirmed on their full sets; classes that are already in one component are not compared again."""
    least = round(similarity * 100, 6)

    def run(table: pa.Table) -> pa.Table:
        held = _Node(table, similarity)
        sets = table.column("shingles").combine_chunks().take(pa.array(held.order))
        sets = sets.combine_chunks() if isinstance(sets, pa.ChunkedArray) else sets
        starts = np.asarray(sets.offsets)[: len(held.n)] - np.asarray(sets.offsets)[0]
        distinct, ids = np.unique(np.asarray(sets.flatten()), return_inverse=True)
        marked = np.zeros(len(distinct), dtype=np.int32)
        stops = starts + held.n
        part = held.root.copy()
        found: list[tuple[int, int]] = []
        for start in range(0, len(held.n), STRIP):
            stop = min(start + STRIP, len(held.n))
            last, near = held.near(start, stop)
            for k in range(start, stop):
                others = start + np.flatnonzero(near[k - start] & (part[start:last] != part[k]))
                if not len(others):
                    continue
                marked[ids[starts[k] : stops[k]]] = 1
                first, end = others[0], others[-1] + 1
                shared = np.add.reduceat(marked[ids[starts[first] : stops[end - 1]]], starts[first:end] - starts[first])[others - first]
                marked[ids[starts[k] : stops[k]]] = 0
                for j in others[shared * 100 >= least * (held.n[k] + held.n[others] - shared)]:
                    if part[j] != part[k]:
                        found.append((int(max(held.node[k], held.node[j])), int(min(held.node[k], held.node[j]))))
                        part[part == part[j]] = part[k]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def _named(df: DataFrame, suffix: str, keep: tuple[str, ...] = ("at",)) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(f"{c}_{suffix}") for c in df.columns if c not in keep])


def _likely(read: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``read`` without most of the rows whose ``key`` is not in ``rows``, and with all that are.

    A bit table of fixed size is broadcast: the bit of a hash of each wanted key is set. The more keys are wanted, the fewer others it
    leaves out; the join that follows is exact.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bits = rows.select(slot.alias("_slot")).groupBy(F.bitmap_bucket_number("_slot").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits")
    )
    table = F.broadcast(stored(bits, "path-filter"))
    byte = "cast(conv(hex(substring(_bits, cast(bitmap_bit_position(_slot) div 8 as int) + 1, 1)), 16, 10) as int)"
    held = F.expr(f"({byte} >> cast(bitmap_bit_position(_slot) % 8 as int)) & 1") == 1
    named = read.withColumn("_slot", slot).withColumn("_bucket", F.bitmap_bucket_number("_slot"))
    return named.join(table, "_bucket").where(held).drop("_slot", "_bucket", "_bits")


def _with_tokens(large: DataFrame, sketches: DataFrame) -> DataFrame:
    """Rows of large nodes with their classes' tokens. Tokens are half a kilobyte a class, so those of other classes are left out before the join."""
    return large.join(_likely(sketches, large, "node"), "node")


class _Texts:
    """Texts of classes. Fetching some passes over all stored texts, so classes that are asked for again are not fetched again."""

    def __init__(self, classes: DataFrame, read: DataFrame):
        self.rows, self.read, self.held = classes.select("node", "row"), read.select("row", "text"), None

    def of(self, nodes: DataFrame) -> DataFrame:
        """``node`` and ``text`` of the classes in ``nodes``, and maybe of others; only texts that are not held yet are moved."""
        missing = nodes if self.held is None else stored(nodes.join(self.held.select("node"), "node", "left_anti"), "path-missing")
        if self.held is None or not missing.isEmpty():
            rows = stored(self.rows.join(missing, "node", "left_semi"), "path-missing-rows")
            found = stored(_likely(self.read, rows, "row").join(rows, "row").drop("row"), "path-texts")
            self.held = found if self.held is None else self.held.union(found)
        return self.held


def _ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _links(pairs: DataFrame, texts: _Texts, width: int, similarity: float) -> DataFrame:
    """Those of the pairs ``a``, ``b`` (each once) of classes whose full shingle sets have the similarity."""
    held = texts.of(_ends_of(pairs))
    both = pairs.join(held.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
        held.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"
    )
    return stored(both.mapInArrow(_verified(width, similarity), "a long, b long"), "path-links")


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            text, shingles = shingle_sets(batch.column("text"), width)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=batch.num_rows))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(shingles.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists], names=["node", "shingles"])

    return run


def _cut(rows: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The rows of nodes as tasks compare them, and those of them that may be similar to one of another component, by sketch.

    Nodes that are not small are cut into pieces by a hash of the class, and a task compares two pieces. Where few classes stand outside the
    largest component, these few are compared with each piece of the others instead.
    """
    own = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")
    all_pieces = F.sequence(F.lit(0), F.col("pieces").cast("int") - 1)
    in_pairs = F.transform(all_pieces, lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")))
    with_few = F.when(
        F.col("root") == F.col("major"), F.array(F.struct(own.alias("i"), F.lit(0).alias("j")))
    ).otherwise(F.transform(all_pieces, lambda k: F.struct(k.alias("i"), F.lit(0).alias("j"))))
    cut = rows.select("at", "node", "root", "n", "low", "high", F.inline(F.when(F.col("others") <= FEW, with_few).otherwise(in_pairs)))
    cut = stored(cut, "path-cut")
    return cut, stored(cut.groupBy("at", "i", "j").applyInArrow(_active(similarity), ACTIVE), "path-active")


def _in_tasks(rows: DataFrame, texts: _Texts, width: int, similarity: float) -> DataFrame:
    """Links of the nodes of ``rows``, each compared inside a task: by sketches first, then those that may be similar by their full sets."""
    cut, active = _cut(rows, similarity)
    wanted = active.select("node").distinct()
    held = texts.of(wanted).join(wanted, "node", "left_semi")
    sets = stored(held.mapInArrow(_sets(width), "node long, shingles array<long>"), "path-sets")
    compared = cut.join(active, ["at", "i", "j", "node"], "left_semi").join(sets, "node")
    return stored(compared.groupBy("at", "i", "j").applyInArrow(_node_links(similarity), "a long, b long"), "path-links")


def _by_size(rooted: DataFrame, similarity: float, all_of_them: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of the tiny nodes, rows of the other small ones, and of the large ones, of ``rooted`` (postings with the ``root`` known so far).

    A node whose classes have one root is done. A node is large, and branches, if it has too many classes or shingles and not just
    a few classes outside its largest component.
    """
    parts = rooted.groupBy("at", "root").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    nodes = parts.groupBy("at").agg(
        F.sum("k").alias("size"), F.sum("s").alias("sets"), F.max("k").alias("most"),
        F.max_by("root", F.struct("k", "root")).alias("major"), F.count("*").alias("roots"),
    )
    small = (F.col("size") <= SMALL) & (F.col("sets") <= SMALL_SETS)
    kind = F.when((F.col("size") <= TINY) & small, "tiny").when(small | (F.col("others") <= FEW) | F.lit(all_of_them), "task").otherwise("large")
    pieces = F.when(small, F.lit(1)).otherwise(F.greatest(F.ceil(2 * F.col("size") / SMALL), F.ceil(2 * F.col("sets") / SMALL_SETS)))
    mixed = nodes.where(F.col("roots") > 1).withColumn("others", F.col("size") - F.col("most"))
    mixed = stored(mixed.select("at", "major", "others", kind.alias("kind"), pieces.cast("long").alias("pieces")), "path-nodes")
    open_ = stored(rooted.join(mixed, "at"), "path-open")
    tiny = open_.where("kind = 'tiny'").select("at", "node", "root", "n", "low", "high")
    pairs = (
        _named(tiny, "a").join(_named(tiny, "b"), "at")
        .where((F.col("node_a") > F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & _alike("a", "b", similarity))
        .select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    )
    return stored(pairs, "path-pairs"), open_.where("kind = 'task'"), open_.where("kind = 'large'").select("at", "node")


def _shared(posted: DataFrame, label: str) -> DataFrame:
    """Postings of the nodes with two or more classes."""
    kept = stored(posted, label)
    least = kept.groupBy("at").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select("at")
    return stored(kept.join(least, "at", "left_semi"), label)


def class_roots(classes: DataFrame, read: DataFrame, width: int, similarity: float, recall: float) -> DataFrame:
    """``node`` and ``root`` of the classes that are linked to another one.

    First each class of a node is held against the node's least one; the components of these links close most nodes. Nodes that still hold different
    components are compared exhaustively if small, else branch; each level is written to the shared folder. The texts of all classes that
    the first level may have to confirm are fetched together.
    """
    sketches = classes.select("node", "n", "low", "high", "tokens")
    roots_of_trees = F.array(*[F.xxhash64(F.lit(f"tree {k}")) for k in range(_trees(similarity, recall))])
    branch = _children(similarity)
    posted = _shared(sketches.select(F.explode(roots_of_trees).alias("at"), "*").mapInArrow(branch, POSTED), "path-level")
    first = posted.groupBy("at").agg(F.min_by(F.struct("node", "n", "low", "high"), "node").alias("_f")).select("at", "_f.*")
    star = _named(posted, "a").join(_named(first, "b"), "at").where((F.col("node_a") > F.col("node_b")) & _alike("a", "b", similarity))
    star = stored(star.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), "path-star")

    tiny, small, _ = _by_size(posted.withColumn("root", F.col("node")), similarity, False)
    texts = _Texts(classes, read)
    texts.of(stored(_ends_of(star.union(tiny)).union(_cut(small, similarity)[1].select("node")).distinct(), "path-wanted"))
    links = _links(star, texts, width, similarity)
    roots = stored(components(links, "path-stars"), "path-roots")
    pairs = None
    for level in range(MOST_LEVELS):
        rooted = posted.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        found, small, large = _by_size(rooted, similarity, level == MOST_LEVELS - 1)
        pairs = found if pairs is None else pairs.union(found)
        links = links.union(_in_tasks(small, texts, width, similarity))
        if large.isEmpty():
            break
        posted = _shared(_with_tokens(large, sketches).mapInArrow(branch, POSTED), "path-level")
    links = links.union(_links(stored(pairs.distinct(), "path-pairs"), texts, width, similarity))
    return stored(components(links, "path-components"), "path-roots")


def similar_components(
    docs: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (the smallest ``doc_id`` reachable, itself included) and ``kept`` for each row.

    Documents with equal sets are always linked; others at a Jaccard similarity of ``similarity`` or more are found with at least the chance ``recall``
    each and confirmed on their full sets. A null or wordless text has no shingle and is linked with nothing. Null ids count as larger than all
    others, so a component of nothing else has a null id, and its rows are kept; repeated rows give repeated rows; an empty table gives none. Only ``doc_id``
    and ``text`` are read, so further columns do not matter.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = stored(texts.mapInArrow(_sketched(width), SKETCHED).withColumn("row", F.monotonically_increasing_id()), "path-read")
    classes = stored(
        read.where("n > 0").groupBy("c1", "c2").agg(
            F.min("doc_id").alias("first"), F.min("row").alias("row"), *[F.first(c).alias(c) for c in ("n", "low", "high", "tokens")]
        ).withColumn("node", F.monotonically_increasing_id()),
        "path-classes",
    )
    roots = class_roots(classes, read, width, similarity, recall)
    rooted = stored(
        classes.select("c1", "c2", "first", "node").join(roots, "node", "left").select("c1", "c2", "first", F.coalesce("root", "node").alias("root")),
        "path-rooted",
    )
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(ids, "root").select("c1", "c2", "component_id", F.lit(1).alias("_one"))
    found = read.select("doc_id", "n", "c1", "c2").join(named, ["c1", "c2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )
