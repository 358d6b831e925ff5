"""Publishing by manifest: data is written beside what is published, and one manifest row makes it so.

No reader sees half a publication: it reads what the manifest names. Data whose manifest row
was never written is in nobody's way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import missing

MANIFEST = "version long, label string, folder string, tables map<string,long>, days array<string>"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all publications, a few bytes each."""
    try:
        return spark.read.schema(MANIFEST).json(f"{root}/manifest/*")
    except Exception as e:
        if not missing(e):
            raise
        return spark.createDataFrame([], MANIFEST)


def _next(spark: SparkSession, root: str) -> int:
    return (manifest(spark, root).agg(F.max("version").alias("v")).first()["v"] or 0) + 1


def _announce(spark: SparkSession, root: str, version: int, label: str, folder: str, tables: dict[str, int], days: list[str]) -> None:
    """One file with one row; of two publishers with the same number the second fails."""
    spark.createDataFrame([(version, label, folder, tables, days)], MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{root}/manifest/{version:010d}")


def write_snapshot(tables: dict[str, DataFrame], root: str) -> tuple[str, dict[str, int]]:
    """The tables in a new folder, and their rows."""
    folder, rows = f"snapshot-{uuid.uuid4().hex}", {}
    for name, df in tables.items():
        df.write.option("ignoreNullFields", "false").json(f"{root}/{folder}/{name}")
        rows[name] = df.sparkSession.read.text(f"{root}/{folder}/{name}").count()
    return folder, rows


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, label: str = "") -> int:
    """Publishes the tables together as JSON lines; returns the number of the publication."""
    version = _next(spark, root)
    _announce(spark, root, version, label, *write_snapshot(tables, root), [])
    return version


def published(spark: SparkSession, root: str, name: str, schema) -> DataFrame | None:
    """A table as the newest publication has it; null if it has none."""
    newest = manifest(spark, root).filter(F.array_contains(F.map_keys("tables"), name) & F.col("folder").isNotNull()).orderBy(F.desc("version")).first()
    return spark.read.schema(schema).json(f"{root}/{newest['folder']}/{name}") if newest else None


def write_days(merged: DataFrame, root: str, version: int) -> list[str]:
    """Whole days of changes in folders of their own version; returns the days, of which there are as many as the calendar has."""
    path = f"{root}/days/version={version}"
    merged.withColumn("day", F.col("detected_on").cast("string")).repartition("day").write.mode("overwrite").partitionBy("day").parquet(path)
    return sorted(r["day"] for r in merged.select(F.col("detected_on").cast("string").alias("day")).distinct().collect())


def publish_days(spark: SparkSession, merged: DataFrame, root: str, label: str = "") -> int:
    """Publishes the days that occur in merged, each as a whole, and leaves all others as they are."""
    version = _next(spark, root)
    days = write_days(merged, root, version)
    _announce(spark, root, version, label, None, {}, days)
    return version


def published_days(spark: SparkSession, root: str, days: list[str] | None = None) -> DataFrame | None:
    """The feed: each day as its newest publication has it; null before the first. days: those alone, and no other folder is read."""
    newest = manifest(spark, root).select("version", F.explode("days").alias("day")).groupBy("day").agg(F.max("version").alias("version"))
    rows = [(r["day"], r["version"]) for r in newest.collect() if days is None or r["day"] in days]  # a row for each day of the calendar
    if not rows:
        return None
    folders = [f"{root}/days/version={v}/day={d}" for d, v in rows]
    return spark.read.option("basePath", f"{root}/days").parquet(*folders).drop("version", "day")
