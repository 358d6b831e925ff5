"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Arrow batch holds in a Python worker, about.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor sees.

    Where the setting is absent, in local mode (tests), a temporary folder is set once and
    removed when the process ends; on a cluster its absence raises RuntimeError.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get("dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = _OWN["dir"] = tempfile.mkdtemp(prefix="spark-statuta-", dir="/tmp")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/statuta-{uuid.uuid4().hex}"


_OWN: dict[str, str] = {}


def materialize(df: DataFrame) -> DataFrame:
    """The rows as a written table: a lost executor costs only the unwritten tasks, and the
    plan after it starts from files."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes tables that materialize() wrote and that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if folder.rpartition("/")[2].startswith("statuta-"):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most BATCH_BYTES, so that very long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def free(name: str, df: DataFrame) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_text(column: Column) -> Column:
    """CRC-32 of the value as text; null counts as the empty string."""
    return F.crc32(F.encode(F.coalesce(column.cast("string"), F.lit("")), "utf-8"))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column without nulls, and the n + 1 offsets of its values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    wide = column.cast(pa.large_binary())
    if len(wide) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `most` bytes of a string or binary column."""
    lengths = np.asarray(pc.binary_length(batch.column(column)).fill_null(0)).astype(np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads the bits of each value."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


_R = 0x9E3779B97F4A7C15 | 1
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R ** k and R ** -k modulo 2 ** 64 for k < n."""
    if len(_POWERS["up"]) < n:
        for name, r in (("up", _R), ("down", pow(_R, -1, 1 << 64))):
            p = np.full(n, np.uint64(r), np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of raw."""
    if len(raw) == 0 or len(starts) == 0:
        return np.zeros(len(starts), np.uint64)
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mixed(h ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))


#: The bytes that separate words: space and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Lower case for A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in raw, and the n + 1 offsets of each text's words in them."""
    if len(raw) == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[raw]
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(raw)]  # a text's first byte never continues a word
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[(last >= 0)]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)
