"""Incremental stores of features or series, keyed by their configuration and input."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermocline.session import shared_folder
from thermocline.sources.batches import BatchTable

KEY_COLUMNS = ("latitude", "longitude", "date", "bleach_presence")
KEY_DIGITS = 16


def frame_digest(df: DataFrame) -> Column:
    """Order-free digest of the key columns as an aggregate: row count and the sum of row hashes."""
    texts = [
        F.coalesce(F.format_string("%.6f", c) if c in ("latitude", "longitude") else F.col(c).cast("string"), F.lit(""))
        for c in KEY_COLUMNS
    ]
    row_hash = F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, 15), 16, 10).cast("decimal(38,0)")
    return F.concat_ws(":", F.count("*").cast("string"), F.coalesce(F.sum(row_hash), F.lit(0)).cast("string"))


def store_key(config: Mapping, df: DataFrame) -> DataFrame:
    """One row with ``store_key``: 16 hex digits of the configuration and the frame's key columns."""
    text = json.dumps(dict(config), sort_keys=True)
    digest = F.md5(F.concat(F.lit(text), F.lit("|"), frame_digest(df)))
    return df.agg(F.substring(digest, 1, KEY_DIGITS).alias("store_key"))


class FeatureStore:
    """Rows per id under ``<path>/<key>``; only ids that were not tried yet are computed.

    Every call adds one batch (``BatchTable``): the new rows, and a marker for each id that gave none. A call that ends
    half-way adds nothing; of two calls at a time, the later one leaves out the ids that the other has added.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, id_column: str = "obs_id") -> None:
        self.spark, self.path, self.id = spark, f"{path.rstrip('/')}/{key}", id_column
        self.batches = BatchTable(spark, self.path)

    def read(self) -> DataFrame | None:
        return self.batches.read()

    def failed(self) -> DataFrame | None:
        """Ids that gave no row when they were tried and have none since."""
        tried = self.batches.read("failed")
        return None if tried is None else tried.distinct().join(self.read().select(self.id), self.id, "left_anti")

    def missing(self, obs: DataFrame, retry_failed: bool = False) -> DataFrame:
        live = self.batches.live()
        for kind in ("rows",) if retry_failed else ("rows", "failed"):
            done = self.batches.read(kind, live)
            obs = obs if done is None else obs.join(done.select(self.id), self.id, "left_anti")
        return obs

    def compute(
        self, obs: DataFrame, fn: Callable[[DataFrame], DataFrame], force: bool = False, retry_failed: bool = False,
        read: Callable[[DataFrame], DataFrame] | None = None,
    ) -> DataFrame:
        """Run ``fn`` on the observations not tried yet, add its rows and return those of ``obs``.

        ``force`` recomputes and replaces the store, ``retry_failed`` tries ids again that gave no row. ``fn`` leaves out
        series without any value. ``read`` as in ``matrix``.
        """
        seen = self.batches.records()
        new = self._asked(obs if force else self.missing(obs, retry_failed))
        record = {"rows": self.batches.stage(fn(new)), "replaces": force}
        without = new.select(self.id).join(self.batches.staged(record["rows"]).select(self.id), self.id, "left_anti")
        record["failed"] = self.batches.stage(without, "failed")
        if force or not seen or not self._empty(record):
            self.batches.commit(record, seen, lambda mine, newer: mine if force else self._others_first(mine, newer))
        return self.matrix(obs, read)

    def _asked(self, new: DataFrame) -> DataFrame:
        """The observations to compute, written once: ``fn`` may read them several times, and the markers need their ids again."""
        path = shared_folder(self.spark, "asked")
        new.write.parquet(path)
        return self.spark.read.schema(new.schema).parquet(path)

    def _empty(self, record: Mapping) -> bool:
        return all(self.batches.staged(record[kind], kind).isEmpty() for kind in ("rows", "failed"))

    def _others_first(self, record: dict, newer: list) -> dict | None:
        """The staged batch without ids that batches recorded meanwhile hold."""
        theirs = self.batches.read("rows", newer).select(self.id)
        for kind in ("rows", "failed"):
            left = self.batches.staged(record[kind], kind).join(theirs, self.id, "left_anti")
            record = {**record, kind: self.batches.stage(left, kind)}
        return None if self._empty(record) else record

    def matrix(self, ids: DataFrame, read: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Stored rows of the given ids; ids without a row are left out. ``read`` maps the rows, say to fewer columns, before they meet the ids."""
        done = self.read()
        if done is None:
            raise ValueError(f"Nothing is stored under {self.path}")
        return (done if read is None else read(done)).join(ids.select(self.id), self.id, "left_semi")

    def clear(self) -> None:
        """Replace all batches by an empty one of the same columns, so that no id counts as tried."""
        done = self.read()
        if done is not None:
            empty = self.batches.stage(self.spark.createDataFrame([], done.schema))
            self.batches.commit({"rows": empty, "replaces": True}, self.batches.records(), lambda mine, newer: mine)


class SeriesStore(FeatureStore):
    """The same for series: ``fn`` returns ids with an array of (time, sst)."""
