from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from statuta.streaming import feeds, seen


def land(spark, folder, rows, number):
    spark.createDataFrame(rows, "url string, seq long").coalesce(1).write.parquet(f"{folder}/landed/{number}")


def run(spark, folder, buckets):
    feeds.first_seen(spark, f"{folder}/landed/*", "url string, seq long", f"{folder}/table", f"{folder}/work", buckets).awaitTermination()


@pytest.mark.parametrize("buckets", [1, 1000])
def test_each_url_once_over_batches(spark, tmp_path, buckets):
    rng, rows, folder = random.Random(2), [], f"file://{tmp_path}"
    for number in range(2):
        part = [(rng.choice([None, "", *[f"http://a/{i}" for i in range(150)]]), 1000 * number + i) for i in range(200)]
        rows += part
        land(spark, folder, part, number)
        run(spark, folder, buckets)
    first = {}
    for url, at in rows:
        first.setdefault(url, at)
    got = spark.read.parquet(f"{folder}/table").select("url", "seq").collect()
    assert len(got) == len(first) and {r.url: r.seq for r in got} == first


def test_a_batch_reads_its_own_buckets(spark, tmp_path):
    table = f"file://{tmp_path}/table"
    rows = spark.range(3000).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url")).withColumn("bucket", seen.bucket(F.col("url"), 1000))
    seen.add(rows, table, 0)
    seen.add(rows.limit(5), table, 0)  # a batch again: only its own folders change
    mine = [r["bucket"] for r in rows.limit(5).select("bucket").distinct().collect()]
    known = seen.known_urls(spark, table, mine, 1)
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert {r["bucket"] for r in known.collect()} == set(mine)
    read = known.withColumn("f", F.input_file_name()).select("f").distinct().count()
    assert read <= len(mine) < 10


def test_filters_rule_out_most_and_never_a_known_url(spark, tmp_path):
    table = f"file://{tmp_path}/table"
    rows = lambda a, b: spark.range(a, b).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url")).withColumn("bucket", seen.bucket(F.col("url"), 4))
    seen.add(rows(0, 2000), table, 0)
    marked = rows(0, 4000).join(seen.seen_filters(spark, table, [0, 1, 2, 3], 9), "bucket").select("url", seen.might_be_known(F.col("url"), F.col("filter")).alias("maybe"))
    known, other = (marked.filter((F.substring("url", 2, 9).cast("long") < 2000) == k) for k in (True, False))
    assert known.filter("not maybe").count() == 0 and other.filter("maybe").count() < 20
    assert seen.new_rows(spark, rows(1990, 2010), table, 1).count() == 10
