"""The pipeline stage by stage, against brute force on what each stage was given."""

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from lakeaudit.llm import jaccard_join, mixing
from lakeaudit.llm.text import WordHash
from tests.llm.test_operators import ODD, SCHEMA, brute_secrets


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given, outs = docs, []
    for _, stage in pipeline.STAGES:
        given = stage(spark, given, sf).persist()
        outs.append(given)
    kept, unique, masked, mixed, encoded = outs
    assert all(o.columns == docs.columns for o in outs[:-1]) and all(dict(o.dtypes) == dict(docs.dtypes) for o in outs[:-1])
    bad = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0")
    assert kept.join(bad, "doc_id", "left_semi").count() <= 0.1 * bad.count()
    hashes = WordHash()
    sets = {r["doc_id"]: set(jaccard_join.shingle_set(r["text"], hashes).tolist()) for r in kept.collect()}
    left = {r["doc_id"] for r in unique.collect()}
    similar = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    assert all(any(similar(d, o) for o in sets if o != d) for d in sets if d not in left)
    assert not any(similar(a, b) for a in left for b in left if a < b)
    assert not any(brute_secrets(r["text"]) for r in masked.collect()) and masked.count() == unique.count()
    assert masked.where("n_chars <> length(text)").isEmpty()
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(masked).collect()}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {d: n for d, n in copies.items() if n}
    assert encoded.count() == mixed.count() and encoded.where("not decoded_equal").isEmpty()


def test_odd_rows(spark, sf):
    given = spark.createDataFrame(ODD, SCHEMA).withColumn("kept", F.lit(1))
    for _, stage in pipeline.STAGES:
        given = stage(spark, given, sf).persist()
    assert given.where("doc_id in (7, 8, 9)").select("doc_id").distinct().count() <= 1
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0


def test_near_duplicates_of_odd_rows(spark, sf):
    out = pipeline.near_duplicate_stage(spark, spark.createDataFrame(ODD, SCHEMA), sf).collect()
    assert sorted((r["doc_id"] or 0 for r in out)) == [0, 1, 2, 3, 4, 5, 6, 7, 10]


def test_run(spark, sf):
    assert pipeline.run(spark, sf).count() > 0 and pipeline.ORACLE_SQL is None
