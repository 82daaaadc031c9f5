"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermocline.llm.common import stored
from thermocline.llm.gru import Adam, Direction, softmax

HIDDEN = 8
WINDOW = 64  # bytes that the network reads at a time; windows cover each whole text
TOGETHER = 2048  # windows that step together
SAMPLE = 3000  # training texts, shared out evenly among the languages
MARGIN = 4  # shares of a language that pass the cut before they are ranked
CUTS, CUT_CHARS = 4, 64  # stretches of each training document, at hashed places
STEPS, BATCH, RATE = 260, 256, 0.02
UNKNOWN = "und"


class ByteTagger:
    """Two directions over bytes; every position gets a probability for each label."""

    def __init__(self, labels: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.ways = [Direction(HIDDEN, rng) for _ in range(2)]
        self.tables = [(rng.standard_normal((257, 3 * HIDDEN)) * 0.3).astype(np.float32) for _ in range(2)]  # 256: padding
        self.W = (rng.standard_normal((2 * HIDDEN, len(labels))) * 0.3).astype(np.float32)
        self.c = np.zeros(len(labels), dtype=np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.W, self.c, *self.tables, *[w.U for w in self.ways]]

    def probabilities(self, ids: np.ndarray) -> np.ndarray:
        """(N, T, labels) for windows of byte values (N, T)."""
        turned = np.ascontiguousarray(ids.T)
        ahead = self.ways[0].run(self.tables[0][turned])
        behind = self.ways[1].run(self.tables[1][turned[::-1]])[::-1]
        logits = ahead @ self.W[:HIDDEN]
        logits += behind @ self.W[HIDDEN:]
        logits += self.c
        return softmax(logits).transpose(1, 0, 2)

    def train(self, ids: np.ndarray, targets: np.ndarray, seed: int = 1) -> None:
        """Backpropagation through time on windows (N, T) whose positions all carry the window's label; labels weigh alike."""
        rng = np.random.default_rng(seed)
        counts = np.bincount(targets, minlength=len(self.labels)).astype(np.float64)
        chance = 1.0 / counts[targets]
        adam = Adam(self.params(), RATE)
        for k in range(STEPS):
            adam.rate = RATE * (1 - k / STEPS) + 0.001
            chosen = rng.choice(len(ids), BATCH, p=chance / chance.sum())
            turned, want = ids[chosen].T, targets[chosen]
            ahead, kept_a = self.ways[0].run(self.tables[0][turned], keep=True)
            behind, kept_b = self.ways[1].run(self.tables[1][turned[::-1]], keep=True)
            both = np.concatenate([ahead, behind[::-1]], axis=2)
            grad = softmax(both @ self.W + self.c)
            grad[:, np.arange(BATCH), want] -= 1.0
            real = (turned < 256)[:, :, None]
            grad *= real / np.float32(max(1, real.sum()))
            flat = both.reshape(-1, 2 * HIDDEN)
            gw, gc = flat.T @ grad.reshape(-1, len(self.labels)), grad.sum(axis=(0, 1))
            gs = grad @ self.W.T
            gt, gu = [], []
            for way, kept, part, seen in ((0, kept_a, gs[:, :, :HIDDEN], turned), (1, kept_b, gs[::-1, :, HIDDEN:], turned[::-1])):
                gx, g = self.ways[way].back(np.ascontiguousarray(part), kept)
                table = np.zeros_like(self.tables[way])
                np.add.at(table, seen.reshape(-1), gx.reshape(-1, 3 * HIDDEN))
                gt.append(table)
                gu.append(g)
            adam.step([gw, gc, *gt, *gu])

    def label(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pooled label and probability of each text: the mean over all its positions."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        counts = -(-sizes // WINDOW)
        padded = np.full(int(counts.sum()) * WINDOW, 256, dtype=np.int16)
        starts = (np.cumsum(counts) - counts) * WINDOW
        for t, s in zip(texts, starts):
            padded[s : s + len(t)] = np.frombuffer(t, np.uint8)
        windows = padded.reshape(-1, WINDOW)
        sums = np.zeros((len(windows), len(self.labels)))
        for at in range(0, len(windows), TOGETHER):
            part = windows[at : at + TOGETHER]
            sums[at : at + TOGETHER] = (self.probabilities(part) * (part < 256)[:, :, None]).sum(axis=1)
        owner = np.repeat(np.arange(len(texts)), counts)
        pooled = np.zeros((len(texts), len(self.labels)))
        np.add.at(pooled, owner, sums)
        pooled /= np.maximum(1, sizes)[:, None]
        return pooled.argmax(axis=1), pooled.max(axis=1).clip(0.0, 1.0)


def held_out(key: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


def train_tagger(docs: DataFrame, sample: int = SAMPLE) -> ByteTagger | None:
    """A tagger fitted on stretches of about ``sample`` different labelled texts, those with the least hashes of each language.

    Every language has an equal share of the sample and at least one text, however rare it is; copies of a text count once. Null languages and texts are left out; without any labelled text there is no tagger.
    """
    places = [F.pmod(F.xxhash64(F.lit(k), "text"), F.greatest(F.length("text") - CUT_CHARS + 1, F.lit(1))).cast("int") for k in range(CUTS)]
    cuts = F.array(*[F.substr("text", p + 1, F.lit(CUT_CHARS)) for p in places])
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0)).withColumn("_h", F.xxhash64("text"))
    least = stored(rows.select("lang", "_h").distinct(), "language-texts")
    counts = stored(least.groupBy("lang").agg(F.count("*").alias("_n")), "language-counts")
    share = -(-sample // max(1, counts.count()))
    # Hashes are even, so a cut that passes about four shares of a language holds its least ones; few rows are left to rank.
    cut = F.when(F.col("_n") > MARGIN * share, MARGIN * share / F.col("_n")).otherwise(1.0)
    under = least.join(counts, "lang").where(F.col("_h").cast("double") / 2.0**64 + 0.5 <= cut)
    order = F.row_number().over(Window.partitionBy("lang").orderBy("_h"))
    hashes = stored(under.withColumn("_nth", order).where(F.col("_nth") <= share).select("lang", "_h"), "language-sample")
    # Only languages and hashes were shuffled; the sample's texts are fetched by them, a bounded table.
    found = rows.select("lang", "_h", "text").join(F.broadcast(hashes), ["lang", "_h"]).dropDuplicates(["lang", "_h"]).select("lang", cuts.alias("cuts"))
    rows = found.collect()  # bounded by the sample, or one row a language
    pairs = sorted({(r["lang"], c.encode()[:WINDOW]) for r in rows for c in r["cuts"]})
    if not pairs:
        return None
    labels = sorted({lang for lang, _ in pairs})
    ids = np.full((len(pairs), WINDOW), 256, dtype=np.int64)
    for k, (_, c) in enumerate(pairs):
        ids[k, : len(c)] = np.frombuffer(c, np.uint8)
    tagger = ByteTagger(labels)
    tagger.train(ids, np.array([labels.index(lang) for lang, _ in pairs]))
    return tagger


def _tagged(tagger: ByteTagger):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = batch.column("text").to_pylist()
                some = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))]  # Unicode category L
                found, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if some:
                    best, share = tagger.label([texts[k].encode() for k in some])
                    for k, b, s in zip(some, best, share):
                        found[k], score[k] = tagger.labels[b], s
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), pa.array(found, pa.string()), pa.array(score)], names=["key", "lang_pred", "score"]
                )

    return run


def predict_language(docs: DataFrame, tagger: ByteTagger | None, key: str = "doc_id") -> DataFrame:
    """``key``, ``lang_pred`` and ``score`` of every whole text: position probabilities averaged over the document.

    Texts that are null or have no letter are ``und`` with score 0, as are all texts when there is no tagger. Rows are independent;
    repeated rows get equal results, an empty table none. Other columns are ignored.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), "text")
    if tagger is None:
        return rows.select(F.col("key").alias(key), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(_tagged(tagger), "key long, lang_pred string, score double").withColumnRenamed("key", key)
