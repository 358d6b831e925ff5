"""Token ids in binary files: one zstandard frame per document, one dictionary for all.

A file set is a folder with two Parquet tables. `dictionary` has one row: the dictionary,
trained on serialized id arrays of a bounded sample, how it came about, its SHA-256, the id
width and the end id. `segments` has a row per run of consecutive documents: the SHA-256 of the dictionary, the
documents' ids, the offsets of their frames (n + 1, the last is the length) and the frames,
end to end. One document is read by its segment's offsets, without its neighbours.

Segments come in ascending document order: by part (a range of document ids), then by seq.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize, shared_dir, slices, table, text_of

END_ID = 1
#: Of the sample that the dictionary is trained on: documents, serialized bytes of one, bytes of the dictionary.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 32 << 10, 16 << 10
SEGMENT_BYTES = 4 << 20
LEVEL = 3
#: Words whose ids a worker keeps.
KEPT_WORDS = 1_000_000
# fixed values of this tokenizer: what ends the last id of a run, and how it cuts lower-case ASCII text into runs
RUN_END = "</w>"
RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Known:
    """Strings with their ids."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def add(self, new: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        at = len(self.number)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        if at + len(new) > len(self.starts):
            more = np.zeros(max(len(self.starts), len(new)), np.int64)
            self.starts, self.lengths = np.concatenate([self.starts, more]), np.concatenate([self.lengths, more])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[at : at + len(new)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[at : at + len(new)] = lengths
        self.used += len(ids)
        self.number.update(zip(new, range(at, at + len(new)), strict=True))

    def numbers(self, names: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, names), np.int64, len(names))

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Their ids end to end, and each one's count."""
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        places = np.repeat(self.starts[numbers] - (ends - lengths), lengths)
        places += np.arange(len(places))
        return self.ids[places], lengths


class Encoder:
    """Ids of whole texts, word by word.

    The tokenizer drops white space and joins nothing across it, so a text's ids are those of
    its words in turn; each distinct word is encoded once and kept. A word of ASCII signs
    without a special token falls into runs of letters, single digits and runs of other signs,
    as the tokenizer cuts it, and each distinct run is encoded once too.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = False
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.last = np.zeros(size, bool)  # ids that end a run
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(RUN_END)]] = True
        self.clear()

    def clear(self) -> None:
        self.words, self.runs = Known(), Known()
        self.words.add([""], np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def learn(self, new: list[str]) -> None:
        plain = [w for w in new if w.isascii() and "<|" not in w]
        if len(plain) < len(new):
            other = [w for w in new if not w.isascii() or "<|" in w]
            self.words.add(other, *self._of_words(other))
        if not plain:
            return
        cut = [RUNS.findall(w.lower()) for w in plain]
        flat = list(itertools.chain.from_iterable(cut))
        if fresh := list(set(flat).difference(self.runs.number)):
            self.runs.add(fresh, *self._of_runs(fresh))
        ids, lengths = self.runs.ids_of(self.runs.numbers(flat))
        ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        upto = np.concatenate([[0], np.cumsum(lengths)])
        self.words.add(plain, ids, np.diff(upto[ends], prepend=0))

    def _of_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs, end to end, and each one's count: many in one call, parted behind each id that ends a run."""
        ids, lengths = [], []
        for i in range(0, len(runs), 2048):
            some = runs[i : i + 2048]
            got = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[got]) + 1
            sizes = np.diff(ends, prepend=0)
            if len(ends) != len(some) or ends[-1] != len(got):  # another tokenizer, which parts words otherwise
                got, sizes = self._of_words(some)
            ids.append(got)
            lengths.append(sizes)
        return np.concatenate(ids), np.concatenate(lengths)

    def _of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of any words: each id tells by its offset which word it is of."""
        ids, lengths = [], []
        for i in range(0, len(words), 512):
            some = words[i : i + 512]
            encoded = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids.append(np.array(encoded.ids, np.uint32))
            upto = np.searchsorted([o[0] for o in encoded.offsets], np.cumsum([len(w) + 1 for w in some]))
            lengths.append(np.diff(upto, prepend=0))
        return np.concatenate(ids), np.concatenate(lengths)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, without end ids, and each text's count."""
        if len(self.words.number) > KEPT_WORDS:
            self.clear()
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if new := list(set(distinct).difference(self.words.number)):
            self.learn(new)
        ids, lengths = self.words.ids_of(self.words.numbers(distinct)[np.asarray(coded.indices)] if len(coded) else np.zeros(0, np.int64))
        ends = np.cumsum(lengths)
        upto = np.concatenate([[0], ends])
        bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(split)))]).astype(np.int64)
        return ids, upto[bounds[1:]] - upto[bounds[:-1]]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _serialized(texts: pa.Array, path: str) -> list[bytes]:
    e = encoder(path)
    ids, counts = e.encode(texts)
    ends = np.cumsum(counts)
    kind = np.dtype("<u2" if e.width == 2 else "<u4")
    out = np.insert(ids, ends, END_ID).astype(kind)
    ends = ends + np.arange(1, len(ends) + 1)
    starts = ends - counts - 1
    raw = out.tobytes()
    return [raw[a * e.width : b * e.width] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def train_dictionary(docs: DataFrame, path: str, text: str = "text") -> tuple[bytes, str]:
    """The dictionary and how it came about: `trained`; `samples` themselves, where there are too few to train on; `none` without any.

    The samples are the SAMPLE_DOCS texts of under SAMPLE_BYTES that a hash puts first.
    """
    some = docs.select(text_of(docs, text).alias("text")).filter(F.octet_length("text").between(1, SAMPLE_BYTES - 1))
    some = some.withColumn("h", F.xxhash64(F.lit(5), "text")).orderBy("h", "text").limit(SAMPLE_DOCS)

    def ids(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_serialized(batch.column(0), path), pa.binary())], ["raw"])

    samples = sorted(r["raw"] for r in some.select("text").mapInArrow(ids, "raw binary").collect())
    if not samples:
        return b"", "none"
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes(), "trained"
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES], "samples"


def _dictionary(raw: bytes, kind: str) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw, zstandard.DICT_TYPE_RAWCONTENT if kind == "samples" else zstandard.DICT_TYPE_FULLDICT) if raw else None


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, key: str = "doc_id", text: str = "text") -> None:
    """Encodes all rows and writes the file set.

    Rows are ordered by key, nulls first; rows of one key by a hash of the text, then the
    frame. A null text is the empty one and has the end id alone; repeated rows are kept; no
    rows make a set without segments. Other columns are left out. Texts are encoded where they
    lie: frames alone are put in order.
    """
    spark, path = docs.sparkSession, tokenizer or tokenizer_path()
    bounded_batches(spark)
    dictionary, kind = train_dictionary(docs, path, text)
    sha, width = hashlib.sha256(dictionary).hexdigest(), encoder(path).width
    spark.createDataFrame([(bytearray(dictionary), kind, sha, width, END_ID)], "dictionary binary, kind string, sha256 string, width int, end_id int").coalesce(1).write.parquet(f"{folder}/dictionary")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(docs, text).alias("text")).withColumn("tie", F.xxhash64("text"))

    def encode(batches):
        shared = _dictionary(dictionary, kind)
        if shared:
            shared.precompute_compress(level=LEVEL)  # once, not for each frame
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True, write_checksum=False, write_dict_id=False)
        for batch in batches:
            for piece in slices(batch, "text", 4 << 20):
                raw = _serialized(piece.column("text"), path)
                tokens = pa.array([len(x) // width for x in raw], pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("tie"), tokens, pa.array(map(press.compress, raw), pa.binary())], ["doc_id", "tie", "n_tokens", "frame"])

    frames = materialize(rows.mapInArrow(encode, "doc_id long, tie long, n_tokens long, frame binary"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ordered = frames.repartitionByRange(*order).sortWithinPartitions(*order, "frame").select("doc_id", "n_tokens", "frame")
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("dictionary_sha256", pa.string()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("frames", pa.binary())])

    def pack(batches):
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def segment():
            table = pa.Table.from_batches(held)
            sizes = np.asarray(pc.binary_length(table.column("frame")), np.int64)
            one = {"part": part, "seq": seq, "dictionary_sha256": sha, "n_docs": table.num_rows, "n_tokens": pc.sum(table.column("n_tokens")).as_py()}
            lists = {"doc_ids": table.column("doc_id").to_pylist(), "offsets": np.concatenate([[0], np.cumsum(sizes)]).tolist(), "frames": b"".join(table.column("frame").to_pylist())}
            return pa.RecordBatch.from_pylist([one | lists], schema)

        for batch in batches:
            for piece in slices(batch, "frame", 1 << 20):
                held.append(piece)
                size += pc.sum(pc.binary_length(piece.column("frame"))).as_py()
                if size >= SEGMENT_BYTES:
                    yield segment()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield segment()

    segments = ordered.mapInArrow(pack, "part int, seq int, dictionary_sha256 string, n_docs int, n_tokens long, doc_ids array<long>, offsets array<long>, frames binary")
    segments.write.option("compression", "uncompressed").parquet(f"{folder}/segments")
    discard(frames)


def read_token_files(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """Per document of a file set: doc_id, start, n_tokens, ids_crc32, and the ids if asked for.

    start: the ids of all documents before it. A segment whose dictionary isn't the set's
    raises ValueError.
    """
    head = spark.read.parquet(f"{folder}/dictionary").first()
    dictionary, kind, sha, width = bytes(head["dictionary"]), head["kind"], head["sha256"], head["width"]
    segments = spark.read.parquet(f"{folder}/segments")

    def decode(batches):
        press = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary, kind))
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                if row.column("dictionary_sha256")[0].as_py() != sha:
                    raise ValueError("a segment was written with another dictionary")
                frames, offsets = row.column("frames")[0].as_buffer(), np.asarray(row.column("offsets")[0].values)
                view, n = memoryview(frames), len(offsets) - 1
                counts, crcs, lists = np.zeros(n, np.int64), np.zeros(n, np.int64), []
                for k in range(n):
                    raw = press.decompress(view[offsets[k] : offsets[k + 1]])
                    values = np.frombuffer(raw, "<u2" if width == 2 else "<u4").astype("<u4")
                    counts[k], crcs[k] = len(values), zlib.crc32(values.tobytes())
                    if ids:
                        lists.append(values)
                part, seq = (row.column(c)[0].as_py() for c in ("part", "seq"))
                columns = {"part": np.full(n, part, np.int32), "seq": np.full(n, seq, np.int32), "doc_id": row.column("doc_ids")[0].values, "inner": np.cumsum(counts) - counts, "n_tokens": counts, "ids_crc32": crcs}
                if ids:
                    columns["ids"] = pa.array([x.astype(np.int64) for x in lists], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    bounded_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SEGMENT_BYTES))
    docs = segments.select("part", "seq", "dictionary_sha256", "doc_ids", "offsets", "frames").mapInArrow(decode, "part int, seq int, doc_id long, inner long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)
    sums = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    until = (Window.unboundedPreceding, -1)
    parts = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*until)), F.lit(0)).alias("of_part"))
    starts = segments.select("part", "seq", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(*until)), F.lit(0)).alias("of_seq")).join(parts, "part")
    out = docs.join(starts, ["part", "seq"]).withColumn("start", F.col("of_part") + F.col("of_seq") + F.col("inner"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids)


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[list[int]]:
    """The ids of each document with this id: only its segments are read, and only its frames decompressed."""
    head = spark.read.parquet(f"{folder}/dictionary").first()
    dictionary = bytes(head["dictionary"])
    rows = spark.read.parquet(f"{folder}/segments").filter(F.array_contains("doc_ids", F.lit(doc_id)))
    found = rows.select("part", "seq", F.posexplode("doc_ids").alias("k", "id"), "offsets", "frames").filter(F.col("id") == doc_id)
    found = found.select("part", "seq", "k", F.expr("substring(frames, cast(offsets[k] as int) + 1, cast(offsets[k + 1] - offsets[k] as int))").alias("frame"))
    press = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary, head["kind"]))
    return [np.frombuffer(press.decompress(bytes(r["frame"])), "<u2" if head["width"] == 2 else "<u4").tolist() for r in found.orderBy("part", "seq", "k").collect()]


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    write_token_files(table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder)
