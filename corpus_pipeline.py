"""A corpus pipeline: quality rules, SimHash near-duplicates, decontamination, mixing, token files.

Each stage is written as Parquet and read again by the next one. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermocline.llm import decontaminate, mixing, quality, simhash, token_files
from thermocline.llm.common import stored


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and lie near the robust shape of their language and source."""
    return quality.quality_rules(docs).where("kept").select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of fingerprints linked at two or fewer bits: the one with the smallest id, null last, then the first in the table."""
    name = _unused(docs, "place")
    rows = stored(docs.withColumn(name, F.monotonically_increasing_id()), "dedup-rows")  # written, so that a row keeps its number
    found = simhash.near_duplicates(rows, name).select(F.col(name).alias("place"), "component_id")
    ids = rows.select(F.col(name).alias("place"), F.col("doc_id").alias("id"))
    best = found.join(ids, "place").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "place")).alias("first"))
    # Few rows leave, so their places, and not all texts, are what a join has to move.
    gone = stored(found.select("place").join(best.select("first.place"), "place", "left_anti").withColumnRenamed("place", name), "dedup-gone")
    return rows.join(gone, name, "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Whether a row does hangs on its text alone, so leaks are named by 128 bits of the text, and rows
    without an id, or with that of another one, are told apart."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    name = _unused(docs, "digest")
    rows = docs.withColumn(name, F.md5(F.col("text").cast("binary")))
    leaks = stored(decontaminate.contaminated(rows, items, name).select(name).distinct(), "leaks")
    return rows.join(leaks, name, "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token table of the mix, read back from its files."""
    return token_files.token_table(docs).withColumnRenamed("key", "doc_id")


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token files", token_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
