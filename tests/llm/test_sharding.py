"""Groups that a shard can hold stay whole at any size."""

from pyspark.sql import functions as F

from veritrail.llm import sharding


def test_large_group_stays_whole(spark):
    total, group = 300_000, 120_000
    text = F.when(F.col("id") < group, F.lit("copy")).otherwise(F.concat(F.lit("text "), F.col("id").cast("string")))
    docs = spark.range(total).select(F.col("id").alias("doc_id"), text.alias("text"))
    found = sharding.shard_documents(docs, shards=2).cache()
    assert found.where(F.col("doc_id") < group).select("shard").distinct().count() == 1
    assert sorted(r["count"] for r in found.groupBy("shard").count().collect()) == [150_000, 150_000]
    assert found.select("shard", "slot").distinct().count() == total
    assert found.agg(F.max("slot")).first()[0] == 149_999
