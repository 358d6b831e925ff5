"""Known urls as a table in hash buckets, with a Bloom filter of each bucket beside it.

Urls lie in folders bucket=B/batch=N. A batch reads the filters of the buckets that its own urls
fall into. A url whose bits aren't all set was never seen; only the others are compared with
urls, and only with those of their buckets. A filter that has filled up costs time, never a url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import missing

BUCKETS = 256
#: Bitmaps of 32,768 bits in the filter of a bucket, and bits of a url in it.
BITMAPS, BITS = 8, 3


def bucket(url: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


def positions(url: Column) -> Column:
    """The places (bitmap, bit) of a url in its bucket's filter."""
    at = lambda k: F.pmod(F.xxhash64(url, F.lit(k)), F.lit(BITMAPS << 15))
    return F.array(*[F.struct(F.shiftright(at(k), 15).cast("int").alias("bitmap"), at(k).bitwiseAND(F.lit((1 << 15) - 1)).alias("bit")) for k in range(BITS)])


def filters(urls: DataFrame) -> DataFrame:
    """(bucket, bitmap, bits) of urls (url, bucket)."""
    places = urls.select("bucket", F.inline(positions(F.col("url"))))
    return places.groupBy("bucket", "bitmap").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _of_buckets(spark: SparkSession, folder: str, found: list[int], batch: int) -> DataFrame | None:
    try:
        return spark.read.parquet(folder).filter(F.col("bucket").isin(found) & (F.col("batch") != batch))
    except Exception as e:  # before the first batch
        if not missing(e):
            raise
        return None


def seen_filters(spark: SparkSession, table: str, found: list[int], batch: int) -> DataFrame | None:
    """(bucket, filter) of the given buckets: a map from bitmap to bits, of BITMAPS at most."""
    rows = _of_buckets(spark, f"{table}-filters", found, batch)
    if rows is None:
        return None
    one = rows.groupBy("bucket", "bitmap").agg(F.bitmap_or_agg("bits").alias("bits"))
    return one.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("bitmap", "bits"))).alias("filter"))


def might_be_known(url: Column, filter_: Column) -> Column:
    """False only if the url is in no earlier batch."""

    def is_set(place: Column) -> Column:
        byte = F.conv(F.hex(F.substring(filter_[place["bitmap"]], F.shiftright(place["bit"], 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.coalesce(F.getbit(byte, (place["bit"] % 8).cast("int")) == 1, F.lit(False))

    return F.forall(positions(url), is_set)


def known_urls(spark: SparkSession, table: str, found: list[int], batch: int) -> DataFrame | None:
    """The urls of the given buckets: all other folders are left unread."""
    rows = _of_buckets(spark, table, found, batch)
    return None if rows is None else rows.select("bucket", F.col("url").alias("seen"))


def new_rows(spark: SparkSession, rows: DataFrame, table: str, batch: int) -> DataFrame:
    """Those of rows, a written table with url and bucket, whose url no other batch has."""
    there = lambda df: [r["bucket"] for r in df.select("bucket").distinct().collect()]  # noqa: E731  at most as many as there are buckets
    marks = seen_filters(spark, table, there(rows), batch)
    if marks is None:
        return rows
    marked = rows.join(marks, "bucket", "left").withColumn("maybe", F.col("filter").isNotNull() & might_be_known(F.col("url"), F.col("filter"))).drop("filter")
    maybe = marked.filter("maybe").drop("maybe")
    known = known_urls(spark, table, there(maybe), batch)
    fresh = marked.filter("not maybe").drop("maybe")
    if known is None:
        return fresh.unionByName(maybe)
    same = (maybe["bucket"] == known["bucket"]) & maybe["url"].eqNullSafe(known["seen"])
    return fresh.unionByName(maybe.join(known, same, "left_anti"))


def add(rows: DataFrame, table: str, batch: int) -> None:
    """Appends a batch; one that is run again replaces its own folders. Filters are written first:
    a filter without its urls only costs a comparison."""
    for df, folder in ((filters(rows), f"{table}-filters"), (rows, table)):
        df.withColumn("batch", F.lit(batch)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(folder)
