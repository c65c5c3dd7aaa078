from pyspark.sql import functions as F

import corpus_pipeline
from rotapanel.llm import decontaminate, near_dup, sharding

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_effect(spark, sf, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix_sources", "shard"]
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, steps[-1], sf).write.parquet(str(tmp_path / name))
        steps.append(spark.read.parquet(str(tmp_path / name)))
    assert all(s.columns == COLUMNS for s in steps[:5])
    good, unique, clean, mixed, shards = steps[1:]
    known = good.join(labels, "doc_id")
    assert known.where("quality = 0").isEmpty() and known.where("quality = 1").count() == labels.where("quality = 1").count()
    groups = near_dup.group_documents(good)
    assert unique.count() == groups.where("kept").count() < good.count()
    assert unique.join(groups.where("NOT kept"), "doc_id").isEmpty()
    hits = decontaminate.find_hits(unique, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert sorted(r.doc_id for r in clean.select("doc_id").collect()) == sorted(r.doc_id for r in hits.where("n_hit = 0").collect())
    assert mixed.join(clean, "doc_id", "left_anti").isEmpty() and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert shards.columns[-1] == "shard" or "shard" in shards.columns
    assert shards.count() == mixed.count() and shards.where(f"shard NOT BETWEEN 0 AND {sharding.SHARDS - 1}").isEmpty()


def test_run_equals_the_stages(spark, tiny):
    got = corpus_pipeline.run(spark, tiny)
    assert {"slot", "shard", *COLUMNS} == set(got.columns) and got.count() > 0


def test_stages_take_empty_and_odd_tables(spark, sf, odd, no_rows):
    for docs in (odd, no_rows):
        left = docs
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, left, sf)
            assert out.count() <= 2 * max(docs.count(), 1)
            left = out.select(*docs.columns)
