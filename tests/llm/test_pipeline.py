"""The pipeline's stages on a small table, each against what its operator promises."""

import corpus_pipeline
from siftwise.llm import mixing, rule_lists, shingle_sets


def test_stages(spark, small_dir, tmp_path):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    columns, at = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at[-1], small_dir).write.parquet(f"{tmp_path}/{name}")
        at.append(spark.read.parquet(f"{tmp_path}/{name}"))
    start, rules, near, plain, mix, packed = at
    assert all(d.columns == columns for d in at[:-1])
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    kept = rule_lists.verdicts(start, labels).where("kept")
    assert sorted(r.doc_id for r in rules.collect()) == sorted(r.doc_id for r in kept.collect())
    found = shingle_sets.near_duplicates(rules)
    assert near.count() == found.select("root").distinct().count()
    assert plain.count() == near.count() and {r.doc_id for r in plain.collect()} == {r.doc_id for r in near.collect()}
    times = {r.doc_id: r.times for r in mixing.mix(plain).where("size > 0 and times > 0").collect()}
    assert {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()} == times
    assert packed.where("piece = 0").count() == mix.count()
    assert packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 1024
