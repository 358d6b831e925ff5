"""First-seen discovery and change upserts on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.diffing import merge_changes
from ..sources import schemas
from ..tables import missing
from . import seen


def first_seen(spark: SparkSession, landed: str, schema: str, table: str, checkpoint: str, buckets: int = seen.BUCKETS):
    """Documents whose url no earlier batch had go to the table, each url once ever.

    The table is the state, in hash buckets: a batch reads the buckets of its own urls alone, and
    of those only what their filters can't rule out. A batch that is run again replaces its own
    folders. The number of buckets stays with the table.
    """

    def step(batch: DataFrame, number: int) -> None:
        first = batch.groupBy("url").agg(F.min_by(F.struct(*batch.columns), "seq").alias("r")).select("r.*")
        side = f"{checkpoint}/new-{number}"
        first.withColumn("bucket", seen.bucket(F.col("url"), buckets)).write.mode("overwrite").parquet(side)
        rows = spark.read.parquet(side)
        fresh = f"{checkpoint}/fresh-{number}"
        seen.new_rows(spark, rows, table, number).write.mode("overwrite").parquet(fresh)
        seen.add(spark.read.schema(rows.schema).parquet(fresh), table, number)

    stream = spark.readStream.schema(schema).parquet(landed)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start()


def append_ledger(spark: SparkSession, landed: str, ledger: str, checkpoint: str):
    """Landed ledger lines (JSON) go to the ledger, a folder a day, each once; nothing there is changed."""
    stream = spark.readStream.schema(schemas.LEDGER).json(landed).withColumn("day", F.substring("ts", 1, 10))
    return stream.writeStream.format("json").option("path", ledger).option("checkpointLocation", checkpoint).partitionBy("day").outputMode("append").trigger(availableNow=True).start()


def change_files(spark: SparkSession, landed: str, table: str, problems: str, checkpoint: str):
    """Landed change days, a JSON document a file: changes go to the table, files that can't be read to the problems.

    A corrupt day names no known url, so its documents are discovered again.
    """

    def step(batch: DataFrame, number: int) -> None:
        days = batch.select("file", F.from_json("value", schemas.DAY).alias("d"))
        readable = F.coalesce(F.col("d.detected_on").isNotNull(), F.lit(False))
        days.filter(readable).select(F.col("d.detected_on").alias("day"), F.inline("d.changes")).write.mode("overwrite").parquet(f"{table}/batch={number}")
        days.filter(~readable).select("file", F.lit("unreadable").alias("error")).write.mode("overwrite").parquet(f"{problems}/batch={number}")

    stream = spark.readStream.option("wholetext", "true").text(landed).select(F.col("_metadata.file_path").alias("file"), "value")
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_changes(spark: SparkSession, landed: str, schema: str, table: str, checkpoint: str):
    """Landed changes merged into the feed day by day; days that a batch doesn't touch aren't rewritten."""

    def step(batch: DataFrame, number: int) -> None:
        days = batch.select("detected_on").distinct()
        try:
            before = spark.read.parquet(table).join(F.broadcast(days) if days.count() < 10_000 else days, "detected_on", "left_semi").select(*batch.columns)
        except Exception as e:
            if not missing(e):
                raise
            before = batch.limit(0)
        latest = batch.groupBy("detected_on", "change_type", "policy_id", F.coalesce("url", F.lit("")).alias("url_key")).agg(F.max_by(F.struct(*batch.columns), "event_id").alias("r")).select("r.*")
        merged = merge_changes(before, latest).drop("kept")
        # the merged days are written beside the table first: a table can't be read and overwritten at once
        side = f"{checkpoint}/merged-{number}"
        merged.write.mode("overwrite").parquet(side)
        spark.read.schema(merged.schema).parquet(side).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("detected_on").parquet(table)

    stream = spark.readStream.schema(schema).parquet(landed)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start()
