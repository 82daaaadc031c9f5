"""Tables that grow by finished batches: rows are staged in a folder of their own, and one record makes them part of the table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

RECORD = "rows string, failed string, years array<int>, replaces boolean"
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"  # Spark's folder name for a NULL partition value


def stored(spark: SparkSession, path: str | Iterable[str], **options: str) -> DataFrame | None:
    """The parquet table at a path or paths, or None when there is none yet."""
    try:
        return spark.read.options(**options).parquet(*([path] if isinstance(path, str) else path))
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


class BatchTable:
    """Rows under ``<path>/rows/_batch=…`` and one numbered record per batch under ``<path>/commits``.

    Readers see the batches that have a record, so a write that ended half-way leaves nothing to be seen and is done again. A
    record takes the next number by a rename that fails if the number is taken: of two writers the later one looks at what
    the other has added and tries again. File systems whose rename replaces a file without notice need one writer at a time.
    The records, one a batch, are all the driver reads.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self):
        fs = self.spark._jvm.org.apache.hadoop.fs
        folder = fs.Path(f"{self.path}/commits")
        conf = self.spark._jsc.hadoopConfiguration()
        folder = folder.getFileSystem(conf).makeQualified(folder)
        return fs, folder, fs.FileContext.getFileContext(folder.toUri(), conf)

    def exists(self) -> bool:
        _, folder, context = self._hadoop()
        return context.util().exists(folder)

    def records(self) -> list[Row]:
        """All records, oldest first."""
        if not self.exists():
            return []
        read = self.spark.read.schema(RECORD).json(f"{self.path}/commits")
        return sorted(read.select("*", F.col("_metadata.file_name").alias("number")).collect(), key=lambda r: r["number"])

    def live(self) -> list[Row]:
        """The records from the last one on that replaces all before it."""
        records = self.records()
        first = max((k for k, r in enumerate(records) if r["replaces"]), default=0)
        return records[first:]

    def _folders(self, records: Iterable[Row], kind: str) -> list[str]:
        folders = []
        for r in records:
            batch = f"{self.path}/{kind}/_batch={r[kind]}"
            if r[kind] is None:
                continue
            folders += [batch] if r["years"] is None else [f"{batch}/year={NULL_FOLDER if y is None else y}" for y in r["years"]]
        return folders

    def read(self, kind: str = "rows", records: Iterable[Row] | None = None) -> DataFrame | None:
        """The rows of the given records' batches, by default of all live ones; None if there are none."""
        folders = self._folders(self.live() if records is None else records, kind)
        found = stored(self.spark, folders, basePath=f"{self.path}/{kind}") if folders else None
        return None if found is None else found.drop("_batch")

    def stage(self, rows: DataFrame, kind: str = "rows", by_year: bool = False) -> str:
        """Write rows where no reader looks yet and return the batch's name."""
        name = f"b{uuid.uuid4().hex}"
        # Balanced by year: a year is one file or, if it is large, several, and not one of every task.
        writer = rows.hint("rebalance", F.col("year")).write.partitionBy("year") if by_year else rows.write
        writer.parquet(f"{self.path}/{kind}/_batch={name}")
        return name

    def staged(self, name: str, kind: str = "rows") -> DataFrame | None:
        return stored(self.spark, f"{self.path}/{kind}/_batch={name}")

    def commit(self, record: dict, seen: list[Row], rebase: Callable[[dict, list[Row]], dict | None]) -> None:
        """Add a record after those ``seen``. ``rebase`` fits it to records that others added meanwhile; None drops it."""
        while record is not None and not self._claim(len(seen), record):
            records = self.records()
            record, seen = rebase(record, records[len(seen):]), records

    def _claim(self, number: int, record: dict) -> bool:
        fs, folder, context = self._hadoop()
        context.mkdir(folder, fs.permission.FsPermission.getDirDefault(), True)
        draft, final = fs.Path(folder, f".{uuid.uuid4().hex}"), fs.Path(folder, f"{number:010d}.json")
        jvm = self.spark._jvm
        out = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(draft, False)
        out.write(json.dumps(record).encode())
        out.close()
        plain = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, final, plain)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            context.delete(draft, False)
            return False
        return True


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of finished batches, or the plain parquet table at a path."""
    table = BatchTable(spark, path)
    rows = table.read() if table.exists() else None
    return spark.read.parquet(path) if rows is None else rows
