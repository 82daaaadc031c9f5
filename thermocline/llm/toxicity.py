"""Toxicity by a bidirectional gated recurrent network with attention pooling over word and character inputs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermocline.llm.common import stored
from thermocline.llm.gru import Adam, Direction

HIDDEN = 8
WINDOW, STRIDE = 64, 32  # words; every window of a text is scored
PIECE = 40  # characters; longer words, as in scripts without spaces, are read as several
VOCABULARY = 6000  # most words with an input row of their own
GRAMS = 4096  # input rows of hashed character trigrams
LEAST_SEEN = 5  # training documents that hold a word of the vocabulary
SAMPLE = 2000  # most training documents of each label
SAMPLE_CHARS = 20_000  # longest training text
ROUNDS, STEPS, BATCH, RATE = 6, 60, 256, 0.01
DECAY = 0.004  # of the input rows in each step
DROPPED = 0.3  # share of words left out of training windows, so that rare words are not learned by heart
TRIMMED = 0.05  # share of toxic training documents set aside, those that look cleanest: labels may be wrong
TOGETHER = 4096
SEPARATOR = r"[^\p{L}\p{N}]+"


class WindowScorer:
    """Scores windows of words: input rows of words and of their character trigrams, two directions, attention, logit."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.vocabulary = vocabulary
        wide = 3 * HIDDEN
        self.ways = [Direction(HIDDEN, rng) for _ in range(2)]
        # Row 0 is for words outside the vocabulary.
        self.words = [(rng.standard_normal((len(vocabulary) + 1, wide)) * 0.1).astype(np.float32) for _ in range(2)]
        self.grams = [(rng.standard_normal((GRAMS, wide)) * 0.1).astype(np.float32) for _ in range(2)]
        self.attend = (rng.standard_normal(2 * HIDDEN) * 0.3).astype(np.float32)
        self.out = (rng.standard_normal(2 * HIDDEN) * 0.3).astype(np.float32)
        self.bias = np.full(1, -1.0, dtype=np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.attend, self.out, self.bias, *self.words, *self.grams, *[w.U for w in self.ways]]

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vocabulary rows of distinct words, their trigram rows one after another, and where each word's begin."""
        get = self.vocabulary.get
        rows = np.array([get(w, 0) for w in words], dtype=np.int64)
        grams, ends = [], [0]
        for w in words:
            b = f"<{w}>>".encode()  # never without a trigram
            grams += [zlib.crc32(b[k : k + 3]) % GRAMS for k in range(len(b) - 2)]
            ends.append(len(grams))
        return rows, np.array(grams, dtype=np.int64), np.array(ends, dtype=np.int64)

    def inputs(self, way: int, rows: np.ndarray, grams: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Input row of each distinct word, and a last one of zeros for padding."""
        total = np.add.reduceat(self.grams[way][grams], ends[:-1]) if len(rows) else np.zeros((0, 3 * HIDDEN), np.float32)
        table = self.words[way][rows] + total / (ends[1:] - ends[:-1])[:, None].astype(np.float32)
        return np.vstack([table, np.zeros((1, 3 * HIDDEN), np.float32)])

    def forward(self, ids: np.ndarray, tables: list[np.ndarray], keep: bool = False):
        """Logits of windows (N, T) of distinct-word numbers; the last number of the tables is padding."""
        turned = np.ascontiguousarray(ids.T)
        real = turned < len(tables[0]) - 1
        if keep:
            ahead, ka = self.ways[0].run(tables[0][turned], True)
            behind, kb = self.ways[1].run(tables[1][turned[::-1]], True)
        else:
            ahead, behind = self.ways[0].run(tables[0][turned]), self.ways[1].run(tables[1][turned[::-1]])
        both = np.concatenate([ahead, behind[::-1]], axis=2)
        e = np.where(real, both @ self.attend, np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        weight = e / e.sum(axis=0)
        pooled = (weight[:, :, None] * both).sum(axis=0)
        logit = pooled @ self.out + self.bias[0]
        return (logit, (turned, both, weight, pooled, ka, kb)) if keep else logit

    def gradients(self, ids: np.ndarray, want: np.ndarray, features, tables: list[np.ndarray], weights: np.ndarray) -> list[np.ndarray]:
        logit, (turned, both, weight, pooled, ka, kb) = self.forward(ids, tables, True)
        d = ((1 / (1 + np.exp(-logit)) - want) * weights / len(ids)).astype(np.float32)
        dp = d[:, None] * self.out
        db = weight[:, :, None] * dp
        de = weight * ((both * dp).sum(axis=2) - (pooled * dp).sum(axis=1))
        db = db + de[:, :, None] * self.attend
        rows, grams, ends = features
        tw, tg, gu = [], [], []
        for way, kept, part, seen in ((0, ka, db[:, :, :HIDDEN], turned), (1, kb, db[::-1, :, HIDDEN:], turned[::-1])):
            gx, g = self.ways[way].back(np.ascontiguousarray(part), kept)
            each = np.zeros_like(tables[way])
            np.add.at(each, seen.reshape(-1), gx.reshape(-1, 3 * HIDDEN))
            each = each[:-1]
            gw, gg = np.zeros_like(self.words[way]), np.zeros_like(self.grams[way])
            np.add.at(gw, rows, each)
            sizes = ends[1:] - ends[:-1]
            np.add.at(gg, grams, np.repeat(each / sizes[:, None].astype(np.float32), sizes, axis=0))
            tw.append(gw)
            tg.append(gg)
            gu.append(g)
        return [np.einsum("tn,tnh->h", de, both), pooled.T @ d, np.array([d.sum()], np.float32), *tw, *tg, *gu]

    def score(self, ids: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        parts = [self.forward(ids[at : at + TOGETHER], tables) for at in range(0, len(ids), TOGETHER)]
        return 1 / (1 + np.exp(-np.concatenate(parts).astype(np.float64))) if parts else np.zeros(0)


def _pieces(offsets: np.ndarray, codes: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The same texts with words over PIECE characters as consecutive pieces, each in a place of its own."""
    numbers: dict[str, int] = {}
    cut = [[numbers.setdefault(w[at : at + PIECE], len(numbers)) for at in range(0, max(1, len(w)), PIECE)] for w in words]
    sizes = np.array([len(c) for c in cut], dtype=np.int64)
    flat, begins = np.array([n for c in cut for n in c], dtype=np.int64), np.cumsum(sizes) - sizes
    ends = np.concatenate([[0], np.cumsum(sizes[codes])])
    place = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes[codes])
    return ends[offsets], flat[np.repeat(begins[codes], sizes[codes]) + place], list(numbers)


def _windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows (N, T) of distinct-word numbers over every whole text, the text of each, and the distinct words."""
    split = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), SEPARATOR)
    flat = split.flatten()
    offsets = np.asarray(split.offsets)
    coded = flat.dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), np.asarray(coded.indices, dtype=np.int64)
    if any(len(w) > PIECE for w in words):
        offsets, codes, words = _pieces(offsets, codes, words)
    codes = np.append(codes, len(words))
    sizes = offsets[1:] - offsets[:-1]
    counts = np.maximum(1, -(-(sizes - STRIDE) // STRIDE))
    owner = np.repeat(np.arange(len(sizes)), counts)
    first = offsets[:-1][owner] + STRIDE * (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts))
    at = first[:, None] + np.arange(WINDOW)
    return codes[np.where(at < offsets[1:][owner][:, None], at, len(codes) - 1)], owner, words


def train_scorer(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 1) -> WindowScorer | None:
    """A scorer fitted on at most ``sample`` different labelled texts of each label, up to ``SAMPLE_CHARS`` characters long.

    A document's label holds for its worst window only: after a first round on all windows, toxic documents are represented by their
    highest windows, others by all, so the windows learn what the documents are marked for. Null labels are left out;
    without both labels there is no scorer.
    """
    text = docs.where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).withColumn("_h", F.xxhash64("text"))
    marked = labels.where(F.col("toxic").isNotNull()).select("doc_id", "toxic")
    # Only ids and hashes are joined and shuffled; then the few texts are fetched by their hashes, a bounded table.
    least = stored(text.select("doc_id", "_h").join(marked, "doc_id").select("toxic", "_h").distinct(), "toxicity-texts")
    few = [least.where(F.col("toxic") == value).orderBy("_h").limit(sample) for value in (0, 1)]
    wanted = stored(few[0].union(few[1]), "toxicity-sample")
    found = text.select("_h", "text").join(F.broadcast(wanted), "_h").dropDuplicates(["toxic", "_h"])
    chosen = sorted(found.select("toxic", "_h", "text").collect())  # bounded by the sample
    target = np.array([r["toxic"] for r in chosen], dtype=np.float32)
    if len(set(target.tolist())) < 2:
        return None
    return fit([r["text"] for r in chosen], target, seed)


def fit(texts: list[str], target: np.ndarray, seed: int = 1) -> WindowScorer:
    """Training on the driver: rounds of stochastic steps over windows, then a shift that puts the best cut at 0.5."""
    windows, owner, words = _windows(pa.array(texts, pa.large_string()))
    held = np.unique(owner[:, None] * (len(words) + 1) + windows) % (len(words) + 1)
    seen = np.bincount(held, minlength=len(words) + 1)[: len(words)]
    order = np.argsort(-seen, kind="stable")[:VOCABULARY]
    scorer = WindowScorer({w: k + 1 for k, w in enumerate(sorted(words[k] for k in order if seen[k] >= LEAST_SEEN))}, seed)
    rng = np.random.default_rng(seed)
    adam = Adam(scorer.params(), RATE)
    rows_of, grams, ends = scorer.features(words)
    scores, highest = None, np.zeros(len(target))
    for k in range(ROUNDS):
        toxic = target[owner] == 1
        if scores is not None:
            known = highest >= np.quantile(highest[target == 1], TRIMMED)
            toxic &= known[owner] & ((scores >= highest[owner]) | (scores >= 0.9))
        positive, negative = np.flatnonzero(toxic), np.flatnonzero(target[owner] == 0)
        if scores is not None:  # half of the clean windows are those that look worst
            hard = negative[np.argsort(-scores[negative], kind="stable")[: max(BATCH, len(negative) // 50)]]
        adam.rate = RATE * (1 - k / ROUNDS) + 0.001
        for _ in range(STEPS):
            mine = rng.choice(positive, BATCH // 4)
            other = rng.choice(negative, BATCH - len(mine) - (0 if scores is None else BATCH // 3))
            parts = [mine, other] if scores is None else [mine, other, rng.choice(hard, BATCH // 3)]
            batch = np.concatenate(parts)
            shown = np.where(rng.random((len(batch), WINDOW)) < DROPPED, len(words), windows[batch])
            used, local = np.unique(shown, return_inverse=True)
            real = used[used < len(words)]
            ids = local.reshape(len(batch), WINDOW)  # padding, if any, is the largest number
            sizes = ends[real + 1] - ends[real]
            done = np.concatenate([[0], np.cumsum(sizes)])
            features = (rows_of[real], grams[np.repeat(ends[real] - done[:-1], sizes) + np.arange(done[-1])], done)
            tables = [scorer.inputs(w, *features) for w in range(2)]
            adam.step(scorer.gradients(ids, target[owner[batch]], features, tables, np.ones(len(batch), np.float32)))
            for table in (*scorer.words, *scorer.grams):
                table *= np.float32(1 - DECAY)
        tables = [scorer.inputs(w, rows_of, grams, ends) for w in range(2)]
        scores = scorer.score(windows, tables)
        highest = np.zeros(len(target))
        np.maximum.at(highest, owner, scores)
    # Cut of the documents' highest logits with the fewest errors, both labels weighing alike; ties take the highest cut.
    logits = np.log(np.clip(highest, 1e-9, 1 - 1e-9) / np.clip(1 - highest, 1e-9, 1))
    by = np.argsort(logits)
    share = np.where(target[by] == 1, 1 / (target == 1).sum(), -1 / (target == 0).sum())
    lost = np.concatenate([[0.0], np.cumsum(share)])
    at = len(lost) - 1 - int(np.argmin(lost[::-1]))
    cut = logits[by][0] - 1 if at == 0 else logits[by][-1] + 1 if at == len(by) else (logits[by][at - 1] + logits[by][at]) / 2
    scorer.bias -= np.float32(cut)
    return scorer


def _scored(scorer: WindowScorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                windows, owner, words = _windows(batch.column("text"))
                features = scorer.features(words)
                tables = [scorer.inputs(w, *features) for w in range(2)]
                best = np.zeros(batch.num_rows)
                np.maximum.at(best, owner, scorer.score(windows, tables))
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(best)], names=["key", "score"])

    return run


def score_toxicity(docs: DataFrame, scorer: WindowScorer | None, key: str = "doc_id") -> DataFrame:
    """``key`` and ``score``, the highest probability of the overlapping windows of each whole text.

    A null or empty text is one window of padding. Without a scorer all scores are 0. Rows are independent, so repeated rows get
    equal scores; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), "text")
    if scorer is None:
        return rows.select(F.col("key").alias(key), F.lit(0.0).alias("score"))
    return rows.mapInArrow(_scored(scorer), "key long, score double").withColumnRenamed("key", key)
