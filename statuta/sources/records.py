"""Records, change days and the ledger as files. A file that can't be read is a row, never a silence."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.validation import duplicates
from . import schemas


@F.pandas_udf(T.StringType())
def yaml_to_json(text: pd.Series) -> pd.Series:
    """JSON of YAML texts, dates as ISO; null where the text can't be read or isn't a mapping."""
    import yaml

    def one(t):
        try:
            value = yaml.safe_load(t)
            return json.dumps(value, default=str, ensure_ascii=False) if isinstance(value, dict) else None
        except (yaml.YAMLError, AttributeError):
            return None

    return text.map(one)


def load_records(spark: SparkSession, path: str, schema: str = schemas.POLICY, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Records of a folder of YAML files, and issues: unreadable files and further files of an id.

    The first file of an id by path wins. A folder without files gives no rows.
    """
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.y*ml").option("recursiveFileLookup", "true").load(path)
    except Exception as e:  # an absent folder has no records
        if "PATH_NOT_FOUND" not in str(e):
            raise
        files = spark.createDataFrame([], "path string, content binary")
    parsed = files.select("path", F.from_json(yaml_to_json(F.decode("content", "utf-8")), schema).alias("r"))
    good = parsed.filter(F.col(f"r.{key}").isNotNull()).select("path", "r.*")
    bad = parsed.filter(F.col(f"r.{key}").isNull()).select(F.col("path").alias("record_id"), F.lit("unreadable").alias("rule"), F.lit("error").alias("severity"), F.lit(1).cast("long").alias("extra_rows"))
    first, extra = duplicates(good, key, "path")
    return first, bad.unionByName(extra)


def load_change_days(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Change days as rows of changes, newest day first, and the files that can't be read."""
    raw = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    days = raw.select("file", F.from_json("value", schemas.DAY).alias("d"))
    readable = F.col("d.detected_on").isNotNull()
    rows = days.filter(readable).select(F.col("d.detected_on").alias("day"), F.explode_outer("d.changes").alias("c")).select("day", "c.*").orderBy(F.desc("day"), "policy_id")
    return rows, days.filter(~F.coalesce(readable, F.lit(False))).select("file", F.lit("unreadable").alias("error"))


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.withColumn("day", F.substring("ts", 1, 10)).write.mode("append").partitionBy("day").json(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LEDGER).json(path)


def write_records(records: DataFrame, path: str) -> None:
    """One JSON object per record, dates in ISO form, nulls kept; the folder is replaced as a whole."""
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def persist_cards(cards: DataFrame, path: str, day: str) -> None:
    """Cards added to those kept, with the day; a roll-back removes none."""
    cards.withColumn("promoted_on", F.lit(day)).write.mode("append").partitionBy("promoted_on").json(path)
