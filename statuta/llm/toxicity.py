"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

A lexicon of words and word beginnings with their log odds, learned from labelled rows, gives
densities; beside them stand nearness to second-person words, capitals, punctuation and
obfuscation rates. The trees learn on other rows than the lexicon, the calibration on others
again. All three use a bounded sample of labelled rows: about SAMPLE_ROWS of each label.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc_text, materialize, slices, table, text_of

SAMPLE_ROWS = 20_000
#: A word enters the lexicon if it is in so many toxic texts, with odds of at least e ** LEAST_ODDS.
LEAST_DOCS, LEAST_ODDS, STRONG = 3, 1.5, 2.5
PREFIXES = (4, 5, 6)
TREES, DEPTH = 20, 3
TOXIC_FROM = 0.7
KEPT_WORDS = 300_000

# fixed values: second-person words of the languages at hand
SECOND = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros du dich dir dein deine deiner ihr euch euer eure".split())
# fixed values: signs that stand for letters
LEET = str.maketrans("013457@$!|", "oieastasii")
EDGE = ".,;:!?\"'()[]{}<>«»„“”‘’…-–—*#&%$/\\"
INNER = re.compile(r"[^\W_][*@$#%&!|+.0-9_-]+[^\W\d_]")
REPEAT = re.compile(r"([^\W\d_])\1\1")
DROP = re.compile(r"[^\w]|_")
FEATURES = ("log_words", "word_max", "word_density", "strong_density", "strong_log", "prefix_max", "prefix_density", "second_density", "near_second", "capitals", "shouted", "exclaimed", "punctuation", "runs_of_punctuation", "inner_signs", "repeats", "masked_hits", "mean_odds")


class Features:
    """Dense features of texts under a lexicon: word or '^' and a word's beginning to log odds."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.known = lexicon, {}

    def word(self, w: str) -> tuple:
        """Odds of the word and of its beginnings, odds found only behind a mask, and flags."""
        bare = w.strip(EDGE)
        low = bare.lower()
        get = self.lexicon.get
        odds = get(low, 0.0)
        begin = max((get("^" + low[:k], 0.0) for k in PREFIXES if len(low) >= k), default=0.0)
        inner = bool(INNER.search(bare))
        repeat = bool(REPEAT.search(low))
        masked = 0.0
        if not odds and (inner or repeat):
            plain = DROP.sub("", low.translate(LEET))
            masked = max(get(plain, 0.0), get(re.sub(r"(.)\1\1+", r"\1", plain), 0.0))
        return odds, begin, masked, low in SECOND, len(bare) > 2 and bare.isupper(), inner, repeat

    def of(self, text: str) -> list[float]:
        words = text.split()
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        seen = []
        for w in words:
            f = known.get(w)
            if f is None:
                f = known[w] = self.word(w)
            seen.append(f)
        n = max(len(words), 1)
        hits = [(i, f[0] or f[2]) for i, f in enumerate(seen) if f[0] or f[2]]
        strong = [i for i, odds in hits if odds >= STRONG]
        second = [i for i, f in enumerate(seen) if f[3]]
        begins = [f[1] for f in seen if f[1]]
        near = 0
        if strong and second:
            at = np.searchsorted(second, strong)
            near = sum(1 for i, a in zip(strong, at, strict=True) if (a < len(second) and second[a] - i <= 5) or (a and i - second[a - 1] <= 5))
        letters = sum(map(len, LETTERS.findall(text)))
        upper = len(UPPER.findall(text))
        signs = len(SIGNS.findall(text))
        return [
            math.log1p(len(words)),
            max((o for _, o in hits), default=0.0),
            sum(o for _, o in hits) / n,
            len(strong) / n,
            math.log1p(len(strong)),
            max(begins, default=0.0),
            sum(begins) / n,
            len(second) / n,
            near / n,
            upper / max(letters, 1),
            sum(f[4] for f in seen) / n,
            text.count("!") / n,
            signs / max(len(text), 1),
            len(RUNS.findall(text)) / n,
            sum(f[5] for f in seen) / n,
            sum(f[6] for f in seen) / n,
            sum(1.0 for f in seen if f[2]) / n,
            sum(o for _, o in hits) / max(len(hits), 1),
        ]


LETTERS = re.compile(r"[^\W\d_]+")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
SIGNS = re.compile(r"[^\w\s]")
RUNS = re.compile(r"[!?*#]{2,}")


def _units(batches):
    """The distinct words and word beginnings of each text."""
    for batch in batches:
        for piece in slices(batch, "text"):
            toxic, units = [], []
            for text, y in zip(piece.column("text").to_pylist(), piece.column("toxic").to_pylist(), strict=True):
                own = {w.strip(EDGE).lower() for w in set(text.split())} - {""}
                own |= {"^" + w[:k] for w in own for k in PREFIXES if len(w) >= k}
                units += own
                toxic += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array(toxic, pa.int32())], ["unit", "toxic"])


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Log odds of units, with one half added to each count, in rows (text, toxic): a bounded sample, so its units are few enough for every task."""
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return {}
    units = rows.mapInArrow(_units, "unit string, toxic int").groupBy("unit").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (n[1] + 1.0)) - F.log((F.col("good") + 0.5) / (n[0] + 1.0))
    units = units.filter(F.col("bad") >= LEAST_DOCS).withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS)
    return {r["unit"]: r["odds"] for r in units.select("unit", "odds").toLocalIterator()}


def with_features(docs: DataFrame, lexicon: dict[str, float], keep: list[str]) -> DataFrame:
    """The kept columns and `features`, an array of doubles in the order of FEATURES; docs has `text` without nulls."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches):
        features = Features(lexicon)
        for batch in batches:
            for piece in slices(batch, "text"):
                values = [features.of(t) for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), pa.array(values, pa.list_(pa.float64()))], [*keep, "features"])

    return docs.select(*keep, "text").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "features array<double>"]))


class Model:
    def __init__(self, lexicon, trees=None, curve=None, rate=0.0):
        self.lexicon, self.trees, self.curve, self.rate = lexicon, trees, curve, rate


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> Model:
    """From docs (key, text) and labels (key, toxic); a key with several labels counts by its greatest.

    Labels that are null or neither 0 nor 1 teach nothing, nor do those of null keys; with one
    label only, every text gets the share of toxic rows. The sample is drawn from the labels,
    so that the texts of other rows aren't moved.
    """
    bounded_batches(docs.sparkSession)
    rows = labels.filter(F.col("toxic").isin(0, 1)).groupBy(F.col(key).alias("key")).agg(F.max("toxic").cast("int").alias("toxic")).withColumn("h", F.xxhash64(F.lit(9), "key"))
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return Model({}, rate=float(bool(n.get(1))))
    take = F.when(F.col("toxic") == 1, int(min(1.0, SAMPLE_ROWS / n[1]) * (1 << 20))).otherwise(int(min(1.0, SAMPLE_ROWS / n[0]) * (1 << 20)))
    fold = F.pmod(F.shiftright("h", 24), F.lit(20))
    # SAMPLE_ROWS of each label, about: small enough to send to every task
    some = F.broadcast(rows.filter(F.pmod("h", F.lit(1 << 20)) < take).select("key", "toxic", fold.cast("int").alias("fold")))
    sample = materialize(docs.join(some, docs[key] == some["key"]).select(text_of(docs).alias("text"), "toxic", "fold"))
    lexicon = learn_lexicon(sample.filter("fold < 9"))
    ready = with_features(sample.filter("fold >= 9"), lexicon, ["toxic", "fold"]).withColumns({"__features": array_to_vector("features"), "label": F.col("toxic").cast("double")})
    ready = materialize(ready.select("label", "fold", "__features").coalesce(4)).coalesce(4).cache()
    parts = {(r["b"], r["label"]): r["n"] for r in ready.groupBy((F.col("fold") >= 16).alias("b"), "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(parts) < 4:
        return Model(lexicon, rate=n[1] / (n[0] + n[1]))
    # the sample may hold the labels at other shares than the rows do: weights restore them
    share = {y: n[y] / max(sum(c for (_, z), c in parts.items() if z == y), 1) for y in (0, 1)}
    ready = ready.withColumn("w", F.when(F.col("label") == 1, F.lit(share[1])).otherwise(F.lit(share[0])))
    trees = GBTClassifier(featuresCol="__features", labelCol="label", weightCol="w", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1, maxBins=32, minInstancesPerNode=2, cacheNodeIds=False).fit(ready.filter("fold < 16"))
    scored = trees.transform(ready.filter("fold >= 16")).select("label", "w", vector_to_array("probability")[1].alias("__raw"))
    curve = IsotonicRegression(featuresCol="__raw", labelCol="label", weightCol="w", predictionCol="__score").fit(scored)
    ready.unpersist()
    return Model(lexicon, trees, curve)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The kept columns, score (0 to 1) and predicted; docs has a column text; a null text is the empty one.

    Kept columns named score or predicted are replaced by these.
    """
    bounded_batches(docs.sparkSession)
    keep = [c for c in keep if c not in ("score", "predicted")]
    if model.trees is None:
        return docs.select(*keep, F.lit(model.rate).alias("score"), F.lit(int(model.rate >= TOXIC_FROM)).alias("predicted"))
    named = {c: f"__keep{k}" for k, c in enumerate(keep)}
    docs = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()], text_of(docs).alias("text"))
    ready = with_features(docs, model.lexicon, list(named.values())).withColumn("__features", array_to_vector("features"))
    raw = model.trees.transform(ready).withColumn("__raw", vector_to_array("probability")[1])
    out = model.curve.transform(raw.select(*named.values(), "__raw"))
    value = F.least(F.greatest(F.col("__score"), F.lit(0.0)), F.lit(1.0))
    return out.select(*[F.col(n).alias(c) for c, n in named.items()], value.alias("score"), (value >= TOXIC_FROM).cast("int").alias("predicted"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = crc_text(F.col("doc_id")) % 3 == 1
    model = fit(docs.select("doc_id", "text"), labels.filter(~held).select("doc_id", "toxic"))
    return score(docs.select("doc_id", "text", held.alias("held_out")), model, ["doc_id", "held_out"])
