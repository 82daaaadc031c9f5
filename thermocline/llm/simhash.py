"""Near-duplicates by SimHash fingerprints, linked through an inverted index over byte positions with count filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermocline.llm.common import stored
from thermocline.llm.components import components

SHINGLE = 3
MOST_BITS = 2
BYTES = 8
SEED = 42
# Byte positions whose values form a posting key: any two positions are missing together from one of the four, so two
# fingerprints that differ in at most two bits (hence two bytes) agree on a whole key.
POSTINGS = ((1, 4, 7), (0, 3, 5), (0, 3, 6), (2, 5, 6))
MOST_LISTED = 64  # fingerprints in a posting whose pairs are tallied; larger postings are linked through midpoints


def _covering(families: tuple[tuple[int, ...], ...], lost: int = MOST_BITS) -> bool:
    from itertools import combinations

    return all(any(not set(gone) & set(f) for f in families) for gone in combinations(range(BYTES), lost))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: the fingerprint of each text, as a signed 64-bit integer."""
    import xxhash

    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for batch in batches:
        found = np.zeros(batch.num_rows, dtype=np.uint64)
        for k, value in enumerate(batch.column("text")):
            text = value.as_py()
            tokens = text.encode().lower().split() if text else []
            if not tokens:
                continue
            if len(tokens) < SHINGLE:
                shingles = [b" ".join(tokens)]
            else:
                shingles = [b"%b %b %b" % s for s in zip(tokens, tokens[1:], tokens[2:])]
            ones, total = np.zeros(64, dtype=np.int64), len(shingles)
            for at in range(0, total, 1 << 16):  # bounded even for very long texts
                part = shingles[at : at + (1 << 16)]
                hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), dtype="<u8", count=len(part))
                ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            found[k] = weights[2 * ones > total].sum(dtype=np.uint64)
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found.view(np.int64))], names=[*names, "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key`` as ``doc_id`` and ``fp``: bit b is 1 if it is set in over half of the hashes of the text's 3-word shingles.

    A-Z is lower-cased and words end at ASCII white space. Fewer than three words are one shingle; null and wordless texts
    have fingerprint 0.
    """
    return docs.select(F.col(key).cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _bytes(fp: Column, positions: tuple[int, ...]) -> Column:
    mask = sum(0xFF << (8 * p) for p in positions)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask).cast("long"))


def _shared_bytes(a: Column, b: Column) -> Column:
    """Tally of the byte positions on which two fingerprints agree."""
    return sum(((_bytes(a, (p,)) == _bytes(b, (p,))).cast("int") for p in range(BYTES)), F.lit(0))


def links(distinct: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of fingerprints (column ``fp``, each once) that differ in at most two bits, or paths of such pairs.

    Each fingerprint is listed in the posting of each key of three positional bytes. Pairs in a posting are tallied: those that share at
    least six of eight bytes, the least number for two differing bits, are verified. A posting with more
    than ``MOST_LISTED`` entries has no pairs made: two fingerprints are within two bits exactly if both are within one bit of
    a common midpoint, so its entries are linked to the least entry at each of their 65 midpoints. No link is lost.
    """
    posted = distinct.select("fp", F.posexplode(F.array(*[_bytes(F.col("fp"), p) for p in POSTINGS])).alias("posting", "key"))
    sizes = posted.groupBy("posting", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    listed = stored(posted.join(sizes, ["posting", "key"]), "simhash-postings")
    short = listed.where(F.col("n") <= MOST_LISTED).select("posting", "key", "fp")
    pairs = (
        short.withColumnRenamed("fp", "a").join(short.withColumnRenamed("fp", "b"), ["posting", "key"])
        .where(F.col("a") > F.col("b"))
        .where(_shared_bytes(F.col("a"), F.col("b")) >= BYTES - MOST_BITS)
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS)
        .select("a", "b")
    )
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - ((1 << 64) if b == 63 else 0)).cast("long") for b in range(64)])
    crowded = listed.where(F.col("n") > MOST_LISTED).select("fp").distinct()
    spots = crowded.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("midpoint"))
    least = spots.groupBy("midpoint").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where(F.col("n") > 1)
    through = spots.join(least, "midpoint").where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b")
    return pairs.union(through).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits, of 3-word shingles) and ``component_id``, the smallest ``key`` reachable over links.

    Fingerprints link at two or fewer differing bits. Copies meet in one grouping with partial aggregation and are never paired. Null keys
    are kept and count as larger than all others; repeated rows give repeated rows; an empty table gives none. Only ``key`` (a whole number)
    and ``text`` are read.
    """
    found = stored(fingerprints(docs, key), "simhash")
    classes = stored(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    roots = stored(components(links(classes.select("fp")), "simhash-links"), "simhash-roots")
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.join(named, "fp").select(F.col("doc_id").alias(key), fingerprint, "component_id")
