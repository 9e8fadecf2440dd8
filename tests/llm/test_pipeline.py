"""The pipeline on the smallest tables: what each stage promises holds of its result."""

import corpus_pipeline
from tribuna.llm import decontam, neardup, secretscan
from tribuna.llm.common import materialise

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, n, kept = docs.columns, docs.count(), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, DIR), name)
        assert docs.columns == columns
        kept[name] = docs.count()
    assert n >= kept["quality_classifier"] >= kept["minhash_near_dedup"] >= kept["benchmark_decontamination"] == kept["secret_scan"] > 0
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    assert decontam.contamination(docs, bench).where("contaminated").count() == 0
    assert secretscan.scan_secrets(docs).where("spans <> ''").count() == 0
    assert docs.where("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert neardup.near_duplicates(docs).count() == docs.count()
