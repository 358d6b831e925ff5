"""Written tables that cut a job's lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession, kind: str = "table") -> str:
    """The name of a new folder below spark.checkpoint.dir.

    Where the setting is absent, in local mode (tests), a temporary folder is set once and
    removed when the process ends; on a cluster its absence raises RuntimeError.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get("dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = _OWN["dir"] = tempfile.mkdtemp(prefix="spark-statuta-", dir="/tmp")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows as a written table: what follows starts from files, and a lost executor costs no more than its running tasks."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def missing(error: Exception) -> bool:
    """Whether reading failed because nothing was written there yet."""
    return "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error)
