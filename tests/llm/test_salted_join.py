"""The copies of a group's figures are dealt over the tasks; they don't go through the driver."""

from pyspark.sql import functions as F

from ledgerlake.llm import near_dedup


def test_copies_are_not_broadcast(spark):
    rows = near_dedup.materialised(spark.range(3_000).select(F.col("id").alias("node"), (F.col("id") % 700).alias("group")))
    per_group = rows.groupBy("group").agg(F.count("*").alias("n"))
    found = near_dedup._with_group(rows, per_group)
    assert sorted(map(tuple, found.select("node", "group", "n").collect())) == [(k, k % 700, 5 if k % 700 < 200 else 4) for k in range(3_000)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
