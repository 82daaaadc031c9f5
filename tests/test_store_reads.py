"""Stores evaluate the observations they are asked for once."""

from pyspark.sql import functions as F

from thermocline.sources.store import FeatureStore


def test_asked_observations_are_evaluated_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(value):
        read.add(1)
        return value

    def twice(new):
        return new.join(new.groupBy("place").agg(F.sum("parsed").alias("total")), "place").where("obs_id <> 3").select("obs_id", "total")

    obs = spark.range(10, numPartitions=2).select(F.col("id").alias("obs_id"), (F.col("id") % 2).alias("place"), counted("id").alias("parsed"))
    store = FeatureStore(spark, str(tmp_path), "once")
    rows = store.compute(obs, twice)
    assert read.value == 10
    assert {(r["obs_id"], r["total"]) for r in rows.collect()} == {(k, 25 if k % 2 else 20) for k in range(10) if k != 3}
    assert [r["obs_id"] for r in store.failed().collect()] == [3]
