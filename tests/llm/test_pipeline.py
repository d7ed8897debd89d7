"""The pipeline's stages, each on what its predecessor kept."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import pii
from lodestone.llm.common import saved
from tests.conftest import SF
from tests.llm.test_operators import near_duplicates, removed


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(saved(stage(spark, kept[-1], SF)))
        assert kept[-1].columns == docs.columns
    ids = [{r[0] for r in k.select("doc_id").collect()} for k in kept]
    labels = dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect())
    clean = [i for i in ids[0] if labels.get(i) == 1]
    assert np.mean([i in ids[1] for i in clean]) > 0.97 and ids[2] < ids[1]
    assert ids[2] == {*near_duplicates(dict(kept[1].select("doc_id", "text").collect())).values()}
    before = kept[2].select("doc_id", "text").orderBy("doc_id").collect()
    after = dict(kept[3].select("doc_id", "text").collect())
    for r, (text, _, _) in zip(before, removed([r["text"] for r in before], 200), strict=True):
        assert after[r["doc_id"]] == text.decode("utf-8", "ignore")
    assert pii.find_pii(kept[4]).filter(F.exists("pii", lambda s: s["kind"].isin("email", "ip", "card", "phone"))).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, kept[4], SF)
    assert {r[0] for r in packed.select("doc_id").collect()} == ids[4] == ids[2]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
