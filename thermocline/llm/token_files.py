"""Token-id files: whole documents in key order, entropy-coded in independent checksummed blocks.

A token table is a folder of Parquet files whose rows are frames. A frame holds whole documents up to about
``FRAME`` ids: their keys and lengths, the first id's number inside its file, and the blocks' lengths, sizes, checksums and
payloads. The checkpoints let any frame, and any block in it, be decoded alone. The shared frequency table lies beside.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermocline.llm.common import stored
from thermocline.llm.rans import Coder, scaled_frequencies
from thermocline.llm.tokenize import vocabulary_path, worker_encoder
from thermocline.session import shared_folder

FRAME = 1 << 20
END_ID = 0
IDS = 1 << 16

TOKENS = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("first", T.LongType()),
        T.StructField("keys", T.ArrayType(T.LongType())),
        T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("ids", T.BinaryType()),
    ]
)
FRAMES = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("first", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("keys", T.ArrayType(T.LongType())),
        T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("block_lengths", T.ArrayType(T.LongType())),
        T.StructField("block_bytes", T.ArrayType(T.LongType())),
        T.StructField("block_crcs", T.ArrayType(T.LongType())),
        T.StructField("payload", T.BinaryType()),
    ]
)
DOCUMENTS = "part int, key long, before long, n_tokens long, ids_crc32 long"
SLICE = 12 << 20  # bytes of the texts that are encoded together


def _lists(rows: list) -> pa.Array:
    return pa.array([np.asarray(r, dtype=np.int64) for r in rows], type=pa.list_(pa.int64()))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with equal shares of the batch's bytes of text, ``SLICE`` at most and what the last text has beyond."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    parts = max(1, -(-int(ends[-1]) // SLICE))
    cuts = np.unique([0, *(np.searchsorted(ends, ends[-1] / parts * np.arange(1, parts)) + 1), batch.num_rows])
    for at, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield batch.slice(at, stop - at)


def _tokens(path: str, end_id: int):
    """Task code: texts of one partition, in order, to rows of about FRAME ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        keys, lengths, ids, held, first = [], [], [], 0, 0

        def row(part: int) -> pa.RecordBatch:
            data = np.concatenate(ids).astype("<u2").tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([first], pa.int64()), _lists([np.concatenate(keys)]), _lists([np.concatenate(lengths)]), pa.array([data], pa.binary())],
                names=["part", "first", "keys", "lengths", "ids"],
            )

        part = -1
        for whole in batches:
            for batch in _slices(whole):
                part = batch.column("part")[0].as_py()
                found, counts = encoder.encode(batch.column("text"))
                ends = np.cumsum(counts)
                with_end = np.insert(found, ends, end_id)  # after the last id of each text
                keys.append(batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64))
                lengths.append(counts + 1)
                ids.append(with_end)
                held += len(with_end)
                pa.default_memory_pool().release_unused()  # what Arrow keeps for later would count beside the next stage's memory
                if held >= FRAME:
                    yield row(part)
                    first += held
                    keys, lengths, ids, held = [], [], [], 0
        if keys:
            yield row(part)

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: how often each id occurs in the partition."""
    counts = np.zeros(IDS, dtype=np.int64)
    for batch in batches:
        for data in batch.column("ids"):
            counts += np.bincount(np.frombuffer(data.as_buffer(), "<u2"), minlength=IDS)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], names=["id", "n"])


def _framed(frequencies: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(np.frombuffer(frequencies, "<u4"))
        for batch in batches:
            for k in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[k].as_buffer(), "<u2")
                blocks = coder.encode(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("part").slice(k, 1),
                        batch.column("first").slice(k, 1),
                        pa.array([len(ids)], pa.int64()),
                        batch.column("keys").slice(k, 1),
                        batch.column("lengths").slice(k, 1),
                        _lists([[b[0] for b in blocks]]),
                        _lists([[len(b[1]) for b in blocks]]),
                        _lists([[b[2] for b in blocks]]),
                        pa.array([b"".join(b[1] for b in blocks)], pa.binary()),
                    ],
                    names=[f.name for f in FRAMES],
                )

    return run


def write_tokens(docs: DataFrame, path: str, key: str = "doc_id", vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Encode every whole text of ``docs`` and write its ids to the folder ``path``, in ascending order of ``key``.

    A null text counts as empty; each document ends with ``end_id``. Null keys come first and are kept as the key -1, rows with one key stand
    in an order by a hash of their text, and other columns are ignored. An empty table gives an empty folder of frames.
    Texts are shuffled once, by ranges of the key; the ids are stored between counting and coding, so texts are encoded
    once. The frequency table covers all ids of all documents and has a row per id of the vocabulary at most.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("_k"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("_h", F.xxhash64("text"))  # never the text itself: range bounds are sampled on the driver
    ranged = rows.repartitionByRange("_k", "_h").sortWithinPartitions("_k", "_h")
    dealt = ranged.select(F.spark_partition_id().alias("part"), F.coalesce("_k", F.lit(-1)).alias("key"), "text")
    tokens = stored(dealt.mapInArrow(_tokens(vocabulary or vocabulary_path(), end_id), TOKENS), "token-ids")
    counted = tokens.select("ids").mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(IDS, dtype=np.int64)
    for row in counted.collect():  # at most one row per id of the vocabulary
        counts[row["id"]] = row["n"]
    frequencies = scaled_frequencies(counts)
    spark.createDataFrame([(bytearray(frequencies.astype("<u4").tobytes()),)], "frequencies binary").coalesce(1).write.parquet(f"{path}/table")
    tokens.mapInArrow(_framed(frequencies.astype("<u4").tobytes()), FRAMES).write.parquet(f"{path}/frames")


def _decoded(frequencies: bytes, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(np.frombuffer(frequencies, "<u4"))
        for batch in batches:
            for row in range(batch.num_rows):
                payload = batch.column("payload")[row].as_buffer().to_pybytes()
                sizes = batch.column("block_bytes")[row].as_py()
                starts = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
                blocks = [
                    (n, payload[starts[b] : starts[b + 1]], crc)
                    for b, (n, crc) in enumerate(zip(batch.column("block_lengths")[row].as_py(), batch.column("block_crcs")[row].as_py()))
                ]
                ids = coder.decode(blocks).astype("<u4")
                lengths = np.array(batch.column("lengths")[row].as_py(), dtype=np.int64)
                ends = np.cumsum(lengths)
                view = memoryview(ids.tobytes())
                texts = [view[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
                arrays = [
                    pa.array(np.full(len(lengths), batch.column("part")[row].as_py(), dtype=np.int32)),
                    batch.column("keys")[row].values,
                    pa.array(ends - lengths + batch.column("first")[row].as_py()),
                    pa.array(lengths),
                    pa.array([zlib.crc32(t) for t in texts], pa.int64()),
                ]
                names = ["part", "key", "before", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array([bytes(t) for t in texts], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of a token table, decoded from its files: ``key``, ``start``, ``n_tokens``, ``ids_crc32`` and, on request, ``ids``.

    ``start`` counts the ids of all documents before. Frames are decoded independently, with their checksums verified.
    """
    frequencies = bytes(spark.read.parquet(f"{path}/table").first()["frequencies"])
    frames = spark.read.schema(FRAMES).parquet(f"{path}/frames")
    totals = frames.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    offsets = totals.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_part_first"))
    schema = DOCUMENTS + (", ids binary" if with_ids else "")
    decoded = frames.mapInArrow(_decoded(frequencies, with_ids), schema)
    return decoded.join(offsets, "part").select(
        "key", (F.col("_part_first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])
    )


def token_table(docs: DataFrame, **options) -> DataFrame:
    """The token table of ``docs``, written to a fresh shared folder and read back from its files."""
    path = shared_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path, **options)
    return read_tokens(docs.sparkSession, path)
