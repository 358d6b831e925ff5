"""Language-model scores by deleted interpolation.

The model gives each word, and each document's end, the mixture of three estimates: its
maximum-likelihood probability after the word before it, its maximum-likelihood probability by
itself, and an even share. The weights of the mixture belong to a bucket of the frequency of the
word before. As in the base score, the outcomes are the words of training, the end, and one for
any unknown word. The weights are learned by expectation-maximisation on held-out counts: a tenth
of the training documents is deleted from the counts that the estimates use meanwhile. The scores
use the counts of all training documents.

Work goes by chunks, runs of documents of one task. A chunk sends the 63-bit hashes of its
distinct words and pairs of words with its counts to ranges of hashes, sorted and packed, and
gets the corpus counts of those back that other chunks have too; of the others its own counts
are the corpus'. The ranges are as many as the corpus asks for, so that one fits a task. There
is no table of the corpus in any task or on the driver. A word or pair is sent once by each
chunk at most: a range's keys are spread evenly, however common a word is.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bounded_batches, crc_text, materialize, mixed, shared_dir, slices, span_hashes, table, text_of, utf8, words

BUCKETS = 16
ITERATIONS = 8
CHUNK_BYTES = 16 << 20
#: Of the training documents one in so many is held out for the weights.
TUNE_IN = 10
#: Of the keys of one range, about.
RANGE_KEYS = 2_000_000
#: The lowest bit of a word's key; those of pairs lack it.
WORD = np.uint64(1)
END_HASH = np.uint64(0x2545F4914F6CDD1D)
#: Estimates: even share, word, word after a word.
ESTIMATES = 3


def bucket(counts: np.ndarray) -> np.ndarray:
    """0 for no occurrence, then one bucket for each doubling."""
    return np.minimum(np.ceil(np.log2(counts + 1)).astype(np.int64), BUCKETS - 1)


class Chunk:
    """The word hashes of some documents. kind 1: documents held out for the weights."""

    def __init__(self, kind: int):
        self.kind, self.hashes, self.counts, self.ids, self.train, self.bytes = kind, [], [], [], [], 0

    def add(self, ids: list, train: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> None:
        raw = LOWER[raw]
        starts, ends, at = words(raw, offsets)
        self.hashes.append(span_hashes(raw, starts, ends))
        self.counts.append(np.diff(at))
        self.ids += ids
        self.train.append(train)
        self.bytes += len(raw)

    def record(self, chunk: int) -> pa.RecordBatch:
        hashes, counts, train = np.concatenate(self.hashes), np.concatenate(self.counts), np.concatenate(self.train)
        unique, inverse, times = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order))
        tokens = place[inverse]
        learned = np.bincount(tokens[np.repeat(train, counts)], minlength=len(unique))
        press = zstandard.ZstdCompressor(level=3).compress
        return pa.RecordBatch.from_arrays(
            [
                pa.array([2 * chunk + self.kind], pa.int64()),
                pa.array([self.ids], pa.list_(pa.int64())),
                pa.array([counts], pa.list_(pa.int64())),
                pa.array([train], pa.list_(pa.bool_())),
                pa.array([press(tokens.astype("<u4").tobytes())], pa.binary()),
                pa.array([unique[order].astype("<u8").tobytes()], pa.binary()),
                pa.array([int(train.sum())], pa.int64()),
                pa.array([int(learned.sum())], pa.int64()),
            ],
            ["chunk", "ids", "counts", "train", "tokens", "hashes", "docs", "n_learned"],
        )


CHUNKS = "chunk long, ids array<long>, counts array<long>, train array<boolean>, tokens binary, hashes binary, docs long, n_learned long"


def chunks(docs: DataFrame, train: Column) -> DataFrame:
    """Chunk records of all documents (doc_id, text), those held out for the weights apart from the others. An odd number is a chunk of those."""
    tune = train & (F.pmod(F.xxhash64(F.lit(13), "doc_id", "text"), F.lit(TUNE_IN)) == 0)
    rows = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(tune, F.lit(False)).alias("tune"))

    def run(batches):
        seq, part, held = 0, TaskContext.get().partitionId(), [Chunk(0), Chunk(1)]
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                tune = np.asarray(piece.column("tune").to_numpy(zero_copy_only=False), bool)
                for kind in (0, 1):
                    some = piece.filter(pa.array(tune == bool(kind)))
                    if some.num_rows:
                        held[kind].add(some.column("doc_id").to_pylist(), np.asarray(some.column("train").to_numpy(zero_copy_only=False), bool), *utf8(some.column("text")))
                    if held[kind].bytes >= CHUNK_BYTES:
                        yield held[kind].record((part << 20) + seq)
                        held[kind], seq = Chunk(kind), seq + 1
        for c in held:
            if c.ids:
                yield c.record((part << 20) + seq)
                seq += 1

    return rows.mapInArrow(run, CHUNKS)


class Texts:
    """The documents of a chunk as numbers of its words, an end (number n) behind each, and their pairs with the number before."""

    def __init__(self, batch: pa.RecordBatch, r: int, press):
        self.hashes = np.frombuffer(batch.column("hashes")[r].as_py(), "<u8")
        counts = np.asarray(batch.column("counts")[r].values, np.int64)
        train = np.asarray(batch.column("train")[r].values.to_numpy(zero_copy_only=False), bool)
        self.n, self.sizes = len(self.hashes), counts + 1
        self.last = np.cumsum(self.sizes) - 1
        self.stream = np.full(int(self.sizes.sum()), self.n, np.int64)
        inside = np.ones(len(self.stream), bool)
        inside[self.last] = False
        self.stream[inside] = np.frombuffer(press.decompress(batch.column("tokens")[r].as_py()), "<u4") if counts.sum() else 0
        self.before = np.full(len(self.stream), self.n, np.int64)
        self.before[1:] = self.stream[:-1]  # an end stands before each first word too
        self.pairs, self.pair = np.unique(self.before * (self.n + 1) + self.stream, return_inverse=True)
        self.kind = batch.column("chunk")[r].as_py() & 1
        taught = np.repeat(train, self.sizes)
        self.own = np.concatenate([np.bincount(self.stream[taught], minlength=self.n + 1)[: self.n], np.bincount(self.pair[taught], minlength=len(self.pairs))])

    def keys(self) -> np.ndarray:
        """The hashes of the words, then of the pairs."""
        h = np.append(self.hashes, END_HASH)
        pair = mixed(h[self.pairs // (self.n + 1)] * np.uint64(0x9E3779B97F4A7C15) + h[self.pairs % (self.n + 1)])
        return np.concatenate([mixed(self.hashes) | WORD, pair & ~WORD])

    def estimates(self, counts: np.ndarray, total: int, ends: int, outcomes: int) -> tuple[np.ndarray, np.ndarray]:
        """At each place the bucket, and a row of the three estimates. counts: of the words, then of the pairs."""
        seen = np.append(counts[: self.n], ends).astype(float)
        context = seen[self.before]
        after = counts[self.n :][self.pair] / np.maximum(context, 1)
        return bucket(context), np.stack([np.full(len(after), 1 / outcomes), seen[self.stream] / max(total, 1), after], 1)


def packed(values: np.ndarray) -> bytes:
    """Numbers as bytes, byte by byte of all, and compressed."""
    raw = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=1).compress(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes())


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, len(flat) // size).T).view(kind).ravel()


def in_ranges(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and in it where each range begins, with the end."""
    order = np.argsort(keys)
    of = ((keys[order] >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    return order, np.searchsorted(of, np.arange(ranges + 1))


def asked(records: DataFrame, ranges: int) -> DataFrame:
    """(range, chunk, keys, n): of each chunk and range the keys in order, as differences, and how often its training documents have them."""

    def run(batches):
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for r in range(batch.num_rows):
                texts, chunk, rows = Texts(batch, r, press), batch.column("chunk")[r].as_py(), []
                keys = texts.keys()
                order, at = in_ranges(keys, ranges)
                keys, own = keys[order], texts.own[order].astype("<u4")
                for k in np.flatnonzero(np.diff(at)).tolist():
                    a, b = at[k], at[k + 1]
                    rows.append((k, chunk, packed(np.diff(keys[a:b], prepend=np.uint64(0))), packed(own[a:b])))
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(("range", "chunk", "keys", "n"), zip(*rows, strict=True), strict=True)), schema)

    schema = pa.schema([("range", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())])
    return records.select("chunk", "counts", "train", "tokens", "hashes").mapInArrow(run, "range int, chunk long, keys binary, n binary")


def answered(asks: DataFrame) -> DataFrame:
    """(range, chunk, at, base, tune, known): which of a chunk's keys in the range other chunks have too, and their corpus counts.

    base: in the training documents that aren't held out, tune: in those that are. known: in one
    row of each range, how many words of training it has."""
    schema = pa.schema([("range", pa.int32()), ("chunk", pa.int64()), ("at", pa.binary()), ("base", pa.binary()), ("tune", pa.binary()), ("known", pa.int64())])

    def merge(group: pa.Table) -> pa.Table:
        chunks, keys = group.column("chunk").to_pylist(), [np.cumsum(unpacked(x, "<u8"), dtype=np.uint64) for x in group.column("keys").to_pylist()]
        n = np.concatenate([unpacked(x, "<u4") for x in group.column("n").to_pylist()]).astype(np.int64)
        sizes = np.array([len(k) for k in keys])
        whole, odd = np.concatenate(keys), np.repeat(np.array(chunks) & 1, sizes).astype(bool)
        order = np.argsort(whole, kind="stable")
        fresh = np.ones(len(whole), bool)
        fresh[1:] = whole[order][1:] != whole[order][:-1]
        starts, number = np.flatnonzero(fresh), np.empty(len(whole), np.int64)
        number[order] = np.cumsum(fresh) - 1
        base, tune = (np.add.reduceat(np.where(odd == side, n, 0)[order], starts) for side in (False, True))
        shared = np.diff(np.append(starts, len(whole))) > 1
        known = int(np.count_nonzero((whole[order][starts] & WORD == WORD) & (base + tune > 0)))
        rows, upto = [], np.cumsum(sizes)
        for k, chunk in enumerate(chunks):
            mine = number[upto[k] - sizes[k] : upto[k]]
            at = np.flatnonzero(shared[mine])
            rows.append((group.column("range")[0].as_py(), chunk, packed(np.diff(at, prepend=0).astype("<u4")), packed(base[mine[at]].astype("<u8")), packed(tune[mine[at]].astype("<u8")), 0 if k else known))
        return pa.Table.from_pydict(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema)

    return asks.groupBy("range").applyInArrow(merge, "range int, chunk long, at binary, base binary, tune binary, known long")


def _counts(texts: Texts, batch: pa.RecordBatch, r: int, both: bool, ranges: int) -> np.ndarray:
    """Corpus counts of a chunk's words and pairs: its own, but for what others have too. both: of all training documents."""
    out = texts.own.copy() if both or not texts.kind else np.zeros(len(texts.own), np.int64)
    order, begin = in_ranges(texts.keys(), ranges)
    for x in batch.column("answers")[r].as_py() or ():
        at = order[begin[x["range"]] + np.cumsum(unpacked(x["at"], "<u4"), dtype=np.int64)]
        base = unpacked(x["base"], "<u8").astype(np.int64)
        out[at] = base + unpacked(x["tune"], "<u8").astype(np.int64) if both else base
    return out


def learn_weights(held: DataFrame, ranges: int, total: int, ends: int, outcomes: int, iterations: int = ITERATIONS) -> np.ndarray:
    """Weights by bucket and estimate, by expectation-maximisation over the held-out chunks; each round sums ESTIMATES * BUCKETS numbers."""
    weights = np.full((BUCKETS, ESTIMATES), 1 / ESTIMATES)
    weights[0] = [0.5, 0.5, 0.0]  # a word that wasn't seen has nothing after it
    for _ in range(iterations):

        def expect(batches, weights=weights):
            press, sums = zstandard.ZstdDecompressor(), np.zeros((BUCKETS, ESTIMATES))
            for batch in batches:
                for r in range(batch.num_rows):
                    texts = Texts(batch, r, press)
                    b, estimates = texts.estimates(_counts(texts, batch, r, False, ranges), total, ends, outcomes)
                    shares = weights[b] * estimates
                    shares /= shares.sum(1, keepdims=True)
                    for e in range(ESTIMATES):
                        sums[:, e] += np.bincount(b, shares[:, e], BUCKETS)
            yield pa.RecordBatch.from_pydict({"k": np.arange(sums.size), "v": sums.ravel()})

        sums = np.zeros(ESTIMATES * BUCKETS)
        for row in held.mapInArrow(expect, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            sums[row["k"]] = row["v"]
        sums = sums.reshape(BUCKETS, ESTIMATES)
        if not sums.any():
            break
        # the even share keeps a little weight, so that no outcome is impossible
        new = (sums + [1e-2, 1e-3, 0.0]) / (sums.sum(1, keepdims=True) + 1.1e-2)
        weights = np.where(sums.sum(1, keepdims=True) > 0, new, weights)
    return weights


def score_documents(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    train: which rows the model learns from; null is no. Tokens are words in lower case A-Z and
    one end per document; a null or empty text has the end alone. base_score: the unigram model
    with one added to each count; score: log10 of the model's probability of the text, never
    infinite. Without training rows every word is unknown. Keys of any type are kept; repeated
    rows are scored alike; no rows give no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(key).alias("key"), text_of(docs, text).alias("text"), train.alias("__train"))
    integral = docs.schema["key"].dataType.typeName() in ("byte", "short", "integer", "long")
    # other keys come back by a hash of key and text
    docs = docs.withColumn("doc_id", F.col("key").cast("long") if integral else F.xxhash64("key", "text"))
    records = _with_small_groups(chunks(docs, F.col("__train")))
    odd = F.col("chunk").bitwiseAND(F.lit(1)) == 1
    names = (("docs", F.col("docs")), ("words", F.col("n_learned")), ("base_docs", F.when(odd, 0).otherwise(F.col("docs"))), ("base_words", F.when(odd, 0).otherwise(F.col("n_learned"))), ("tokens", F.expr("aggregate(counts, 0L, (a, x) -> a + x + 1)")))
    sums = records.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(name) for name, x in names]).first()
    # of each token a word and a pair at most; ranges are joined to tasks by their sizes
    ranges = max(16, math.ceil(sums["tokens"] / RANGE_KEYS))
    answers = materialize(answered(asked(records, ranges).repartition(ranges, "range")))
    train_tokens, ends = sums["words"] + sums["docs"], sums["docs"]
    distinct = (answers.agg(F.sum("known")).first()[0] or 0) + (ends > 0)
    outcomes = distinct + 1  # one for unknown words
    of_chunk = answers.groupBy("chunk").agg(F.collect_list(F.struct("range", "at", "base", "tune")).alias("answers"))  # no more than it asked for
    both = records.join(of_chunk, "chunk", "left")
    held = _with_small_groups(both.filter(odd))
    weights = learn_weights(held, ranges, sums["base_words"] + sums["base_docs"], sums["base_docs"], outcomes)

    def run(batches):
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for r in range(batch.num_rows):
                texts = Texts(batch, r, press)
                counts = _counts(texts, batch, r, True, ranges)
                b, estimates = texts.estimates(counts, train_tokens, ends, outcomes)
                logs, at = np.log10((weights[b] * estimates).sum(1)), np.cumsum(texts.sizes) - texts.sizes
                seen = np.append(counts[: texts.n], ends)[texts.stream]
                base = np.log10((seen + 1) / (train_tokens + 1 * (distinct + 1)))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("ids")[r].values, "n_tokens": texts.sizes, "n_known": np.add.reduceat((seen > 0).astype(np.int64), at), "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(logs, at)})

    scored = both.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    out = ["n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score"]
    if integral:
        return scored.select("doc_id", *out)
    named = docs.select(F.col("doc_id").alias("__h"), "key")
    return named.join(scored.dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "__h"), "__h").select(F.col("key").alias("doc_id"), *out)


def _with_small_groups(records: DataFrame) -> DataFrame:
    """Written with small row groups: a reader holds few of the large records at a time."""
    spark, path = records.sparkSession, shared_dir(records.sparkSession)
    records.write.option("parquet.block.size", str(16 << 20)).parquet(path)
    return spark.read.schema(records.schema).parquet(path)


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = lambda: crc_text(F.col("doc_id")) % 7 == 2
    return score_documents(docs, ~held()).select("doc_id", held().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
