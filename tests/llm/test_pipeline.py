"""The pipeline's stages on the smallest tables, each against what its operator says alone."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from checks.compare import connect, differences
from thermocline.llm import decontaminate, mixing, quality, simhash
from thermocline.llm.common import stored

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_mixing_equals_sql(spark):
    name = "op3_mixing_to_target_weights"
    mine = entry.queries()[name](spark, SF).toPandas()
    assert differences(mine, connect(SF).execute(entry.oracle_sql()[name]).df()) is None


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    kept = stored(corpus_pipeline.quality_stage(spark, docs, SF), "t")
    assert kept.columns == docs.columns
    assert ids(kept) == ids(quality.quality_rules(docs).where("kept"))
    single = stored(corpus_pipeline.dedup_stage(spark, kept, SF), "t")
    found = simhash.near_duplicates(kept).collect()
    assert single.columns == docs.columns and ids(single) == sorted({r["component_id"] for r in found})
    clean = stored(corpus_pipeline.decontamination_stage(spark, single, SF), "t")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaks = {r["doc_id"] for r in decontaminate.contaminated(single, items).collect()}
    assert clean.columns == docs.columns and ids(clean) == [k for k in ids(single) if k not in leaks]
    mix = stored(corpus_pipeline.mixing_stage(spark, clean, SF), "t")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(clean).collect()}
    assert mix.columns == docs.columns and ids(mix) == sorted(k for k, n in copies.items() for _ in range(n))
    tokens = corpus_pipeline.token_stage(spark, mix, SF).orderBy("start").collect()
    assert [r["doc_id"] for r in tokens] == ids(mix)
    assert [r["start"] for r in tokens][1:] == [r["start"] + r["n_tokens"] for r in tokens][:-1]
    assert len(corpus_pipeline.run(spark, SF).collect()) == len(tokens)
