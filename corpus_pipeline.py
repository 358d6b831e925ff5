"""The corpus pipeline: documents in, shuffled shards of clean, mixed documents out.

Each stage calls one operator on all that its predecessor kept. All stages but the last return
the columns of documents; the last adds where each document lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm import decontam, langid, mixing, ngram_join, sharding
from statuta.llm.common import free, materialize, shared_dir, table, text_of

#: Ids of rows to drop are broadcast up to this many (16 bytes each); beyond, texts are shuffled to them.
BROADCAST_ROWS = 1_000_000
#: Of a stretch of a shard within which the order is random, and how many such stretches a shard has at least.
BUCKET_BYTES, STRETCHES = 1 << 20, 16
#: Rows of a file of the mixture, at least.
FILE_ROWS = 256


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language: those without letters, and those between two languages, go."""
    found = langid.identify(docs, langid.fit(docs))
    return found.filter((F.col("lang_pred") != "und") & ~F.col("ambiguous")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; of equal rows, one."""
    groups = ngram_join.near_groups(docs)
    # without words a document is linked with nothing, and stays
    group = F.when(F.col("root").isNotNull(), F.struct(F.lit(1).alias("kind"), F.col("root").alias("id"))).otherwise(F.struct(F.lit(0).alias("kind"), F.col("row").alias("id")))
    rows = materialize(groups.withColumn("g", group).groupBy("row", "g").agg(F.count(F.lit(1)).alias("times"), F.min("doc_id").alias("doc_id")))
    first = rows.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("m")).select(F.col("m.row").alias("row"), F.lit(True).alias("first"))
    row, once = free("__row", docs), free("__first", docs)
    # what isn't simply kept: rows that go, and rows that come more than once
    odd = rows.join(first, "row", "left").filter(F.col("first").isNull() | (F.col("times") > 1))
    odd = materialize(odd.select(F.col("row").alias(row), F.col("first").isNotNull().alias(once)))
    known = docs.withColumn(row, F.xxhash64(F.col("doc_id").cast("long"), text_of(docs)))
    send = F.broadcast if odd.count() <= BROADCAST_ROWS else (lambda df: df)
    plain = known.join(send(odd.select(row)), row, "left_anti")
    repeated = known.join(send(odd.filter(F.col(once)).select(row)), row).dropDuplicates([row])
    return plain.select(*docs.columns).union(repeated.select(*docs.columns))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: file by file, and row by row in a file."""
    mixed = mixing.mix(docs)
    rows = docs.count()
    files = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // FILE_ROWS))
    # positions run from 0 to about the number of rows: gaps are behind short blocks alone
    file = F.least(F.floor(F.col("position") * files / max(rows, 1)), F.lit(files - 1)).cast("int")
    return mixed.repartitionById(files, file).sortWithinPartitions("position").select(*docs.columns)


def shuffle_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with shard and slot, read from the shards that were written.

    The buckets of a shard follow the order of the stage before, so that every stretch of a
    shard has the mixture's shares; within a bucket the order is random.
    """
    place = free("__place", docs)
    placed = sharding.external_shuffle(mixture_order(docs, place), bucket_bytes=BUCKET_BYTES, place=place, least_buckets=STRETCHES)
    path = shared_dir(spark)
    sharding.write_shards(placed, path)
    out = sharding.read_shards(spark, path, placed.schema)
    return out.select(*docs.columns, F.col("shard").cast("int").alias("shard"), "slot")


def mixture_order(docs: DataFrame, place: str) -> DataFrame:
    """docs with a column of where a row stands in the files that it is read from, in the order of their names: from 0 to under 1.

    Rows that aren't read from files have the place of a hash of the row.
    """
    if not docs.inputFiles():
        own = F.xxhash64(F.lit(3), *[F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith("map")])
        return docs.withColumn(place, F.pmod(own, F.lit(1 << 30)) / float(1 << 30))
    file, rank, first = (free(f"{place}_{x}", docs) for x in ("file", "rank", "first"))
    found = docs.withColumn(file, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).withColumn(rank, F.col("_metadata.row_index"))
    # a row for each file of one table
    ends = sorted((r[file], r["n"]) for r in found.groupBy(file).agg((F.max(rank) + 1).alias("n")).collect())
    total, starts, at = max(1, sum(n for _, n in ends)), [], 0
    for name, n in ends:
        starts.append((name, at))
        at += n
    named = docs.sparkSession.createDataFrame(starts, f"`{file}` string, `{first}` long")
    return found.join(F.broadcast(named), file).withColumn(place, (F.col(first) + F.col(rank)) / total).drop(file, rank, first)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("pfair_mixing", mix_sources),
    ("sharding", shuffle_into_shards),
]

#: Language models, near-duplicate groups and schedules have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
