"""Benchmark decontamination: passages of every text query a BM25 index of the test items, pruned by block maxima."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASSAGE = 64  # words in a passage; passages overlap by half
BLOCK = 32  # pieces of items in a block of the index
K1, B = 1.2, 0.75
THRESHOLD = 0.5  # share of the best score that a passage of this length can reach for the item
SHINGLE = 5
OVERLAP = 0.8  # share of the question's and of the answer's shingles
CHUNK = 512  # passages scored together
INDEX_BYTES = 16 << 20  # item texts in one index; more items are queried in as many passes
FOUND = "row {kind}, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def _split(texts: pa.Array) -> pa.Array:
    """Lower-cased words (runs of letters and numbers) of each text; items and texts go through the same function."""
    lowered = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    return pc.split_pattern_regex(lowered, r"[^\p{L}\p{N}]+")


def _words(texts: list[str]) -> list[list[str]]:
    return [[w for w in words if w] for words in _split(pa.array(texts, pa.large_string())).to_pylist()]


def _shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def _parts(text: str) -> tuple[list[str], list[str]]:
    """Question and answer of an item: the answer is its last sentence or line; a single sentence is both."""
    pieces = [w for w in _words(re.split(r"(?<=[.?!])\s+|\n+", text.strip())) if w]
    if len(pieces) < 2:
        return (pieces[0], pieces[0]) if pieces else ([], [])
    return [w for p in pieces[:-1] for w in p], pieces[-1]


def _pieces(words: list[str]) -> list[list[str]]:
    """What retrieves an item: all its words if a passage holds them, else overlapping pieces of half a passage. Wherever a copy of such a piece
    stands, one passage holds all of it, so a verbatim long item is retrieved whatever its rare words are."""
    if len(words) <= PASSAGE:
        return [words]
    length, step = PASSAGE // 2, PASSAGE // 4
    return [words[k : k + length] for k in (*range(0, len(words) - length, step), len(words) - length)]


class Index:
    """Inverted index of the items' pieces with impacts as shares of a piece's best score, and their maxima per block of pieces."""

    def __init__(self, items: list[tuple[int, str]], idf: dict[str, float], average: float):
        self.ids = [i for i, _ in items]
        self.parts = [_parts(t) for _, t in items]
        self.shingles = [tuple(map(_shingles, p)) for p in self.parts]
        worded = _words([t for _, t in items])
        self.lengths = [len(w) for w in worded]
        pieces = [(k, piece) for k, words in enumerate(worded) for piece in _pieces(words)]
        self.owner = [k for k, _ in pieces]
        self.terms: dict[str, int] = {}
        postings: list[list[tuple[int, float]]] = []
        for k, (_, piece) in enumerate(pieces):
            counted = Counter(piece)
            norm = K1 * (1 - B + B * sum(counted.values()) / average)
            impacts = {t: idf[t] * n * (K1 + 1) / (n + norm) for t, n in counted.items()}
            best = sum(sorted(impacts.values(), reverse=True)[:PASSAGE])
            for t, impact in impacts.items():
                place = self.terms.setdefault(t, len(postings))
                if place == len(postings):
                    postings.append([])
                postings[place].append((k, impact / best))
        self.blocks = -(-len(pieces) // BLOCK)
        starts = np.cumsum([0] + [len(p) for p in postings])
        self.starts = starts
        self.item = np.array([k for p in postings for k, _ in p], dtype=np.int64)
        self.impact = np.array([x for p in postings for _, x in p], dtype=np.float32)
        self.most = np.array([max(x for _, x in p) for p in postings] + [0.0], dtype=np.float32)  # last: not in the index

    def scores(self, passages: list[np.ndarray]) -> list[tuple[int, int, float]]:
        """(passage, item, score) of all pairs that reach THRESHOLD.

        Blocks whose summed maxima stay below it are skipped for the passage; the others are scored exactly.
        """
        terms, columns = np.unique(np.concatenate(passages), return_inverse=True)
        has = np.zeros((len(passages), len(terms)), dtype=np.float32)
        has[np.repeat(np.arange(len(passages)), [len(p) for p in passages]), columns] = 1.0
        rows = [np.arange(self.starts[t], self.starts[t + 1]) for t in terms]
        at = np.concatenate(rows)
        owner = np.repeat(np.arange(len(terms)), [len(r) for r in rows])
        impacts, blocks = self.impact[at], self.item[at] // BLOCK
        most = np.zeros((len(terms), self.blocks), dtype=np.float32)
        np.maximum.at(most, (owner, blocks), impacts)
        bound = has @ most
        found = []
        for b in np.flatnonzero((bound >= THRESHOLD - 1e-4).any(axis=0)):
            open_rows = np.flatnonzero(bound[:, b] >= THRESHOLD - 1e-4)
            mine = blocks == b
            exact = np.zeros((len(terms), BLOCK), dtype=np.float32)
            exact[owner[mine], self.item[at[mine]] - b * BLOCK] = impacts[mine]
            scored = has[open_rows] @ exact
            found += [(int(open_rows[r]), self.owner[b * BLOCK + c], float(scored[r, c])) for r, c in zip(*np.nonzero(scored >= THRESHOLD - 1e-4))]
        return found

    def overlaps(self, words: list[str], item: int) -> tuple[float, float]:
        have = {n: {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} for n in {len(s) for part in self.shingles[item] for s in part}}
        return tuple(sum(s in have[len(s)] for s in part) / len(part) if part else 0.0 for part in self.shingles[item])


def _queried(index: Index, key: pa.DataType):
    """Task code: all passages of each text against the index; verified pairs, the best one for each text and item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                split = _split(batch.column("text"))
                offsets, coded = np.asarray(split.offsets), split.flatten().dictionary_encode()
                terms = np.array([index.terms.get(w, -1) for w in coded.dictionary.to_pylist()], dtype=np.int64)
                codes = np.asarray(coded.indices)
                term = terms[codes] if len(codes) else np.zeros(0, dtype=np.int64)
                # Upper bound of a passage: the largest impacts of its words, repeats included.
                run_sum = np.concatenate([[0.0], np.cumsum(index.most[term], dtype=np.float64)])
                half = PASSAGE // 2
                counts = np.maximum(1, -(-(offsets[1:] - offsets[:-1] - half) // half))
                doc = np.repeat(np.arange(len(split)), counts)
                first = offsets[:-1][doc] + half * (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts))
                last = np.minimum(first + PASSAGE, offsets[1:][doc])
                likely = np.flatnonzero(run_sum[last] - run_sum[first] >= THRESHOLD - 1e-4)
                best: dict[tuple[int, int], tuple] = {}
                words: dict[int, list[str]] = {}
                checked: set[tuple[int, int, int]] = set()
                for c in range(0, len(likely), CHUNK):
                    chunk = likely[c : c + CHUNK]
                    known = [t[t >= 0] for t in (term[first[k] : last[k]] for k in chunk)]
                    for p, item, score in index.scores(known):
                        d = int(doc[chunk[p]])
                        spot = int(first[chunk[p]] - offsets[d])
                        if d not in words:
                            words[d] = split[d].as_py()
                        reach = index.lengths[item]
                        if (d, item, spot) in checked:
                            continue
                        checked.add((d, item, spot))
                        question, answer = index.overlaps(words[d][max(0, spot - reach) : spot + PASSAGE + reach], item)
                        if question >= OVERLAP and answer >= OVERLAP:
                            row = (score, question, answer, -spot)
                            best[d, item] = max(best.get((d, item), row), row)
                keys = batch.column("row").to_pylist()
                found = [(keys[d], index.ids[item], s, q, a, -spot) for (d, item), (s, q, a, spot) in sorted(best.items())]
                columns = list(zip(*found)) if found else [[]] * 6
                kinds = [key, pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                names = ["row", "item_id", "score", "question_overlap", "answer_overlap", "first_word"]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=names)

    return run


def _indexes(items: DataFrame) -> list[Index]:
    """Indexes over all items in blocks of at most INDEX_BYTES of text; statistics are those of all items."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    rows = items.where(F.size(words) > 0).select(F.col("item_id").cast("long").alias("item_id"), "text", F.octet_length("text").cast("long").alias("size"))
    sized = rows.agg(F.count("*"), F.sum("size")).first()
    if not sized[0]:
        return []
    passes = -(-int(sized[1]) // INDEX_BYTES)
    indexes, counted, total, length = [], Counter(), 0, 0
    parts = [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).select("item_id", "text") for k in range(passes)]
    for part in parts:
        for row in part.toLocalIterator():
            for piece in _pieces(_words([row["text"]])[0]):
                counted.update(set(piece))
                total, length = total + 1, length + len(piece)
    idf = {t: float(np.log(1 + (total - n + 0.5) / (n + 0.5))) for t, n in counted.items()}
    for part in parts:
        chosen = sorted({(r["item_id"], r["text"]) for r in part.collect() if _words([r["text"]])[0]})
        if chosen:
            indexes.append(Index(chosen, idf, length / total))
    return indexes


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``item_id``, ``score``, ``question_overlap``, ``answer_overlap``, ``first_word`` of each text and test item it holds.

    Passages of 64 words, each half overlapping the next, cover every whole text. A passage retrieves an item if its BM25 score is at least
    half of the best that a passage could reach, for an item of over 64 words that of one of its overlapping pieces; the pair stays if at least 0.8 of the five-word shingles of the item's question
    and of its answer stand around the passage. Null and empty texts and items match nothing; repeated rows are found
    repeatedly; an empty table gives no rows; other columns are ignored. ``key`` is a whole number or a string.

    The test items are the query set: their index (``INDEX_BYTES`` of text at most) goes to the tasks, larger benchmarks in several passes.
    """
    text_key = docs.schema[key].dataType.simpleString() == "string"
    kind, held = ("string", pa.string()) if text_key else ("long", pa.int64())
    found_schema = FOUND.format(kind=kind)
    rows = docs.select(F.col(key).cast(kind).alias("row"), "text")
    out = None
    for index in _indexes(items):
        found = rows.mapInArrow(_queried(index, held), found_schema)
        out = found if out is None else out.union(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], found_schema)
    return out.withColumnRenamed("row", key)
