"""Language identification by error-correcting output codes.

Every language has a codeword; one binary n-gram classifier per bit tells the languages with
a 1 from those with a 0. A text's language is the codeword with the least loss, each bit
weighted by how often its classifier was right, and a small lead marks the text as ambiguous.

The classifiers are fitted on a bounded sample of labelled rows: about SAMPLE_PER_LANG of each
language, chosen by a hash. Half of it gives the n-gram weights, half the bit calibration.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bounded_batches, crc_text, materialize, slices, table, text_of, utf8

#: Rows of the sample: of one language, and of all together, about; at least LEAST_PER_LANG of each that has them.
SAMPLE_PER_LANG, SAMPLE_ROWS, LEAST_PER_LANG = 4000, 100_000, 100
ORDERS = (2, 3, 4)
BUCKET_BITS = 15
BUCKETS = len(ORDERS) << BUCKET_BITS
#: The languages and their codewords are in every task: more raise an error.
MOST_LANGS = 8000
#: A text is ambiguous if the best language leads the second by less.
LEAD = 0.05


def codebook(n: int, seed: int = 11) -> np.ndarray:
    """n codewords of +1 and -1: all splits of up to seven languages, else the best of random codes."""
    if n <= 7:
        splits = np.arange(2 ** max(n - 1, 0) - 1 if n > 1 else 0)
        return np.array([[1 if i == 0 or not (s >> (i - 1)) & 1 else -1 for s in splits + 1] for i in range(n)], np.int8).reshape(n, -1)
    rng, bits, best, most = np.random.default_rng(seed), math.ceil(10 * math.log2(n)), None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        agree = (code.astype(np.int32) @ code.T.astype(np.int32) + bits) // 2
        np.fill_diagonal(agree, 0)
        least = bits - agree.max()
        if least > most and (np.abs(code.sum(0)) < n).all():
            best, most = code, least
    return best


def ngrams(raw: np.ndarray, offsets: np.ndarray):
    """For each order the bucket of the n-gram at each byte and whether it lies in one text."""
    low = LOWER[raw].astype(np.uint32)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(len(raw))
    key = low
    for k in range(1, max(ORDERS)):
        key = (key[:-1] << np.uint32(8)) | low[k:]
        if k + 1 in ORDERS:
            inside = at[: len(key)] + k < ends[: len(key)]
            bucket = (key * np.uint32(2654435761) + np.uint32(k)) >> np.uint32(32 - BUCKET_BITS)
            yield ORDERS.index(k + 1), bucket.astype(np.int64) + (ORDERS.index(k + 1) << BUCKET_BITS), inside


def mean_weights(raw: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The mean weights of each text's n-grams, one column per bit."""
    n, total, count = len(offsets) - 1, np.zeros((len(offsets) - 1, weights.shape[1])), np.zeros(len(offsets) - 1)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        for _, bucket, inside in ngrams(raw, offsets):
            if not len(bucket):
                continue
            of_text = np.searchsorted(offsets[1:], np.flatnonzero(inside), "right")
            starts = np.flatnonzero(np.diff(of_text, prepend=-1))
            if len(starts):
                total[of_text[starts]] += np.add.reduceat(weights[bucket[inside]], starts, axis=0)
                count[of_text[starts]] += np.diff(np.append(starts, len(of_text)))
    return total / np.maximum(count, 1)[:, None] if n else total


class Model:
    """langs; code: a row per language; weights: a row per bucket, a column per bit; slope, shift, trust: per bit."""

    def __init__(self, langs, code, weights, slope, shift, trust):
        self.langs, self.code, self.weights, self.slope, self.shift, self.trust = langs, code, weights, slope, shift, trust

    def decode(self, means: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the best language, its share of belief, and the lead over the second."""
        if len(self.langs) == 1:
            one = np.ones(len(means))
            return np.zeros(len(means), np.int64), one, one
        margin = means * self.slope + self.shift
        ones = (self.code > 0).T.astype(float)
        loss = (self.trust * np.logaddexp(0, -margin)) @ ones + (self.trust * np.logaddexp(0, margin)) @ (1 - ones)
        apart = (self.trust.sum() - (self.code * self.trust) @ self.code.T.astype(float)) / 2
        belief = -loss / max(apart[~np.eye(len(self.code), dtype=bool)].min(), 1e-9)
        belief = np.exp(belief - belief.max(1, keepdims=True))
        belief /= belief.sum(1, keepdims=True)
        order = np.sort(belief, 1)
        return belief.argmax(1), order[:, -1], order[:, -1] - order[:, -2]


def fit(train: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model | None:
    """From rows with a language; None if there are none. Texts that are null or empty teach nothing."""
    bounded_batches(train.sparkSession)
    rows = train.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), text_of(train, text).alias("text"), F.xxhash64(F.lit(3), key, text).alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS + 1).collect()}
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not sizes:
        return None
    langs = sorted(sizes)
    each = max(LEAST_PER_LANG, min(SAMPLE_PER_LANG, SAMPLE_ROWS // len(langs)))
    shares = train.sparkSession.createDataFrame([(k, int(min(1.0, each / n) * (1 << 20))) for k, n in sizes.items()], "lang string, share long")
    # MOST_LANGS rows at most are sent; the sample is written by all tasks, and read by few
    sample = rows.join(F.broadcast(shares), "lang").filter(F.pmod("h", F.lit(1 << 20)) < F.col("share"))
    sample = materialize(sample.select("text", "lang", F.pmod(F.shiftright("h", 24), F.lit(2)).cast("int").alias("half"))).coalesce(8)
    number = {k: i for i, k in enumerate(langs)}

    def count(batches):
        """Of each piece the buckets that a language and half have, with their counts."""
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                raw, offsets = utf8(piece.column("text"))
                row = np.array([number[k] for k in piece.column("lang").to_pylist()]) * 2 + np.asarray(piece.column("half"))
                if len(raw):
                    row_at = np.repeat(row, np.diff(offsets))
                    where = np.concatenate([(row_at[: len(bucket)] * BUCKETS + bucket)[inside] for _, bucket, inside in ngrams(raw, offsets)])
                    where, times = np.unique(where, return_counts=True)
                    yield pa.RecordBatch.from_pydict({"i": (where // (2 * BUCKETS)).astype(np.int32), "half": (where // BUCKETS % 2).astype(np.int32), "bucket": (where % BUCKETS).astype(np.int32), "n": times})

    summed = sample.mapInArrow(count, "i int, half int, bucket int, n long").groupBy("i", "half", "bucket").agg(F.sum("n").alias("n"))
    by_lang = materialize(summed.groupBy("i", "half").agg(F.collect_list(F.struct("bucket", "n")).alias("counts")))  # at most BUCKETS of each
    # a language whose sample is in one half alone teaches from that half
    chosen = by_lang.groupBy("i").agg(F.min(F.struct("half", "counts")).alias("c")).select("i", "c.counts.bucket", "c.counts.n")
    code = codebook(len(langs))
    weights = bit_weights(((r["i"], np.array(r["bucket"]), np.array(r["n"])) for r in chosen.toLocalIterator()), code)
    if len(langs) == 1:
        return Model(langs, code, np.zeros((BUCKETS, 0), np.float32), np.ones(0), np.zeros(0), np.ones(0))

    def means(batches):
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                values = mean_weights(*utf8(piece.column("text")), weights)
                yield pa.RecordBatch.from_pydict({"lang": piece.column("lang"), "means": pa.array(list(values), pa.list_(pa.float64()))})

    held = sample.filter("half = 1 and length(text) > 0").mapInArrow(means, "lang string, means array<double>").collect()
    values = np.array([r["means"] for r in held]).reshape(len(held), code.shape[1])
    signs = code[[number[r["lang"]] for r in held]].reshape(values.shape)
    slope, shift, trust = np.ones(code.shape[1]), np.zeros(code.shape[1]), np.ones(code.shape[1])
    for b in range(code.shape[1]):
        slope[b], shift[b] = calibrated(values[:, b], signs[:, b])
        wrong = np.mean((values[:, b] * slope[b] + shift[b]) * signs[:, b] <= 0) if len(values) else 0.25
        trust[b] = max(1 - 2 * wrong, 0.05)
    return Model(langs, code, weights, slope, shift, trust)


def bit_weights(counts, code: np.ndarray) -> np.ndarray:
    """For each bucket and bit the log ratio of its smoothed mean rates under the 1-languages and the 0-languages.

    counts: (language, buckets, their counts), one language after another; one that has none has even rates.
    """
    sums, left = np.zeros((2, BUCKETS, code.shape[1]), np.float32), set(range(len(code)))

    def add(i, rate):
        for side, bits in enumerate((code[i] < 0, code[i] > 0)):
            sums[side][:, bits] += rate[:, None].astype(np.float32)

    for i, buckets, n in counts:
        dense = np.zeros(BUCKETS)
        dense[buckets] = n
        dense = dense.reshape(len(ORDERS), -1)
        add(i, ((dense + 0.5) / (dense.sum(1, keepdims=True) + 0.5 * (1 << BUCKET_BITS))).ravel())
        left.discard(i)
    for i in left:
        add(i, np.full(BUCKETS, 1 / (1 << BUCKET_BITS)))
    ones = np.maximum((code > 0).sum(0), 1)
    return np.log((sums[1] / ones) / (sums[0] / np.maximum(len(code) - ones, 1))) if len(code) > 1 else np.zeros((BUCKETS, 0), np.float32)


def calibrated(x: np.ndarray, sign: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (x, sign), by Newton's method with a small ridge."""
    if len(x) == 0 or (sign > 0).all() or (sign < 0).all():
        return 1.0, 0.0
    theta, scale = np.zeros(2), max(np.std(x), 1e-9)
    design, y = np.stack([x / scale, np.ones(len(x))], 1), (sign > 0).astype(float)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        grad = design.T @ (p - y) + 1e-2 * theta
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(theta[0] / scale, 1e-6), theta[1]


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous.

    A text that is null or has no letter is `und` with score 0 and isn't ambiguous; so is
    every text if there is no model. Input columns named like the added ones are replaced.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "ambiguous")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "ambiguous": F.lit(False)})
    names, letters = docs.columns, has_letter(text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "lang_pred string", "score double", "ambiguous boolean"])

    def predict(batches):
        for batch in batches:
            for piece in slices(batch, "__text"):
                best, score, lead = np.zeros(piece.num_rows, np.int64), np.zeros(piece.num_rows), np.zeros(piece.num_rows)
                for a, part in _parts(piece):
                    best[a : a + part.num_rows], score[a : a + part.num_rows], lead[a : a + part.num_rows] = model.decode(mean_weights(*utf8(part.column("__text")), model.weights))
                known = np.asarray(piece.column("__letters").to_numpy(zero_copy_only=False), bool)
                langs = [model.langs[i] if k else "und" for i, k in zip(best.tolist(), known.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(langs, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(known & (lead < LEAD))], [*names, "lang_pred", "score", "ambiguous"])

    ready = docs.withColumns({"__letters": letters, "__text": text_of(docs, text)})
    return ready.mapInArrow(predict, schema)


def _parts(piece: pa.RecordBatch):
    at = 0
    for part in slices(piece, "__text", 1 << 20):
        yield at, part
        at += part.num_rows


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_text(F.col("doc_id")) % 4 == 2
    model = fit(docs.filter(~held))
    out = identify(docs.select("doc_id", "text", held.alias("held_out")).select("doc_id", "held_out", "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
