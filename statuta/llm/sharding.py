"""Two-pass external shuffle of records into shards.

Pass one scatters the records into buckets that fit in memory, by seeded hashes: the key
chooses the shard by rendezvous hashing, a second hash of the whole row chooses one of the
shard's buckets. Pass two shuffles each bucket with Fisher-Yates and numbers its rows behind
those of the shard's earlier buckets, and they are written there. A shard read in slot order is then a random order of
its records, and no task ever holds more than one bucket.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_text, free, shared_dir, table

SHARDS = 40
BUCKET_BYTES = 8 << 20
SEED = 20231


def rendezvous(key: Column, shards: int, seed: int = SEED) -> tuple[Column, Column]:
    """The shard of a key among `shards`, and its shard once there is one more.

    Each shard bids a hash of (key, shard) and the highest bid wins, so a further shard only
    takes keys into itself. A null key is a key like any other.
    """
    bid = lambda s: F.xxhash64(key, s.cast("long"), F.lit(seed))
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(bid(s).alias("bid"), s.alias("s"))))
    return best["s"], F.when(bid(F.lit(shards)) >= best["bid"], F.lit(shards)).otherwise(best["s"])


def fisher_yates(n: int, seed: list[int]) -> list[int]:
    """A random order of 0..n-1: each place, from the last, swaps with a random earlier one or itself."""
    draws = (np.random.default_rng(seed).random(max(n - 1, 0)) * np.arange(n, 1, -1)).astype(np.int64).tolist()
    order = list(range(n))
    for i, j in zip(range(n - 1, 0, -1), draws, strict=True):
        order[i], order[j] = order[j], order[i]
    return order


def external_shuffle(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED, place: str | None = None, least_buckets: int = 1) -> DataFrame:
    """All rows of df with size, shard, bucket, slot and grown_shard.

    size: UTF-8 bytes of the text and 16 more. slot: 0, 1, ... in each shard. The order is a
    function of the rows and the seed, not of how they are partitioned. A shard has as many
    buckets as its own size asks for, and least_buckets at least. place: a column of numbers from
    0 to under 1, the same for the same row, by which the rows of a shard go to its buckets in
    turn: each bucket is then shuffled by itself, and the shard keeps the coarse order of the
    places; the column itself goes. A null text counts as 0 bytes; a null key is a key of its
    own; equal rows are kept, lie in one bucket and get slots of their own; no rows give no rows.
    An input column named like one of the added ones is replaced.
    """
    df = df.drop("size", "shard", "bucket", "slot", "grown_shard")
    at, row_of, spot_of = place, free("__row", df), free("__spot", df)
    kept = [f for f in df.schema if f.name != at]
    shard, grown = rendezvous(F.col(key), shards, seed)
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 16
    row = F.xxhash64(F.lit(seed + 1), *[F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in kept])
    spot = F.col(at) if at else F.pmod(F.xxhash64(F.lit(seed + 2), row), F.lit(1 << 30)) / float(1 << 30)
    # `shards` rows of sums: how many buckets each shard needs
    sums = {r["s"]: r["n"] for r in df.groupBy(shard.alias("s")).agg(F.sum(size).alias("n")).collect()}
    buckets = F.array(*[F.lit(max(least_buckets, math.ceil(sums.get(s, 0) / bucket_bytes))) for s in range(shards)])
    scattered = df.withColumns({"size": size, "shard": shard, "grown_shard": grown, row_of: row, spot_of: spot})
    scattered = scattered.withColumn("bucket", F.floor(F.col(spot_of) * F.get(buckets, F.col("shard"))).cast("int")).drop(spot_of, *[at] * bool(at))
    first_of = free("__first", scattered)
    counts = scattered.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first_of))
    joined = scattered.join(first, ["shard", "bucket"])
    out = T.StructType([f for f in scattered.schema if f.name != row_of] + [T.StructField("slot", T.LongType())])
    names = out.names

    def shuffled(group: pa.Table) -> pa.Table:
        where = [int(group.column(c)[0].as_py()) for c in ("shard", "bucket")]
        group = group.take(pc.sort_indices(group, [(key, "ascending"), (row_of, "ascending")]))
        group = group.take(pa.array(fisher_yates(group.num_rows, [seed, *where]), pa.int64()))
        first = group.column(first_of)[0].as_py()
        return group.append_column("slot", pa.array(np.arange(first, first + group.num_rows), pa.int64())).select(names)

    return joined.groupBy("shard", "bucket").applyInArrow(shuffled, out)


def write_shards(shuffled: DataFrame, path: str) -> None:
    """A folder per shard, in it a file for the buckets of each task; the rows of a file are in slot order.

    Nothing is moved again: the buckets are written where they were shuffled. No rows write no
    shard. The folders carry the shard's number, all other columns are in the files.
    """
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(spark, path: str, schema: T.StructType) -> DataFrame:
    """What write_shards() wrote, with the columns of the schema."""
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    shuffled, path = external_shuffle(table(spark, sf_dir, "documents")), shared_dir(spark)
    write_shards(shuffled, path)
    return digest(read_shards(spark, path, shuffled.schema))


def digest(shuffled: DataFrame) -> DataFrame:
    return shuffled.select("doc_id", "size", crc_text(F.col("text")).alias("text_crc32"), F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.col("grown_shard").cast("int").alias("grown_shard"), "bucket")
