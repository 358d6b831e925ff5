"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Fixed masks choose some positions of every window of tokens and ignore the others; equal
hashes of the chosen positions in a benchmark item and a document are a hit, so a copy whose
words were replaced here and there still hits: the masks leave no pattern of at most 30 %
replacements in LEAST_TOKENS or more tokens without a hit. Shorter items are looked up by the
hash of all their tokens. Around each hit the item is laid over the
document, position by position, and the pair counts if enough tokens agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

# fixed values: the masks; 1 is a position that must agree. A pattern that none of them hits has, for every
# length from 8 to 15 (a test goes through all), under 0.7 of its positions in place; longer ones are made of such pieces.
MASKS = ("1111", "110011", "101011", "11001001")
#: A pair counts with this share of the item's tokens in place, or with a stretch that scores LEAST_STRETCH.
LEAST_SHARE, LEAST_STRETCH = 0.7, 13
#: In a stretch an agreeing token counts 1 and another one this: it must agree in over four of five.
PENALTY = -4
#: Items of fewer tokens must be in place as a whole.
LEAST_TOKENS = 8
#: The seeds of the benchmark are broadcast up to this many rows (about 40 bytes each); beyond, the join is shuffled.
BROADCAST_ROWS = 500_000


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; none for a null or empty text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def seeds(array: Column) -> Column:
    """(seed, at) of every window and mask over an array of token hashes."""
    out = []
    for k, mask in enumerate(MASKS):
        spots = [i for i, c in enumerate(mask) if c == "1"]
        last = F.size(array) - len(mask)
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        out.append(F.transform(at, _chosen(array, k, spots)))
    return F.concat(*out)


def whole_seeds(array: Column, lengths: list[int]) -> Column:
    """(seed, at) of every window of the lengths, by all its tokens."""
    return F.concat(F.array().cast("array<struct<seed:bigint,at:int>>"), *[F.transform(F.when(F.size(array) >= n, F.sequence(F.lit(0), F.size(array) - n)).otherwise(F.array().cast("array<int>")), _chosen(array, -n, list(range(n)))) for n in lengths])


def _chosen(array: Column, k: int, spots: list[int]):
    return lambda i: F.struct(F.xxhash64(F.lit(k), *[F.get(array, i + s) for s in spots]).alias("seed"), i.alias("at"))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item that overlap: key, item, n_item, n_matched, share, stretch, at.

    n_matched: tokens of the item found in place; share: of all n_item; stretch: the best
    score of a contiguous piece; at: the token of the document below the item's first.
    Texts that are null or without tokens overlap with nothing; items of under LEAST_TOKENS
    tokens are found where all of them stand in a row. Documents or items with equal keys are one document or item with several
    texts: each pair of keys is returned once, with its best overlap. A null key is a key.
    Empty tables give no rows.
    """
    items = benchmark.select(F.col(item).alias("item"), hashes(F.col(item_text)).alias("item_hashes")).filter(F.size("item_hashes") > 0)
    items = items.withColumns({"item_row": F.xxhash64("item", "item_hashes"), "n_item": F.size("item_hashes")})
    items = materialize(items.dropDuplicates(["item_row"]))
    # lengths of short items: fewer than LEAST_TOKENS values
    lengths = sorted(r["n_item"] for r in items.filter(F.col("n_item") < LEAST_TOKENS).select("n_item").distinct().collect())
    of_item = F.when(F.col("n_item") >= LEAST_TOKENS, seeds(F.col("item_hashes")))
    for n in lengths:
        of_item = of_item.when(F.col("n_item") == n, whole_seeds(F.col("item_hashes"), [n]))
    of_items = materialize(items.select("item_row", "n_item", F.explode(of_item).alias("s")).select("item_row", "n_item", "s.seed", F.col("s.at").alias("item_at")))
    found = of_items
    if of_items.count() <= BROADCAST_ROWS:
        found = F.broadcast(of_items)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("row", F.xxhash64("key", "text"))
    of_doc = F.concat(seeds(F.col("h")), whole_seeds(F.col("h"), lengths)) if lengths else seeds(F.col("h"))
    of_docs = rows.select("row", hashes(F.col("text")).alias("h")).select("row", F.explode(of_doc).alias("s")).select("row", "s.seed", F.col("s.at").alias("doc_at"))
    hits = of_docs.join(found, "seed").select("row", "item_row", "n_item", (F.col("doc_at") - F.col("item_at")).alias("diagonal"))
    # every place of a short item agrees as a whole: its last one is enough
    hits = hits.groupBy("row", "item_row", "n_item", F.when(F.col("n_item") >= LEAST_TOKENS, F.col("diagonal")).alias("spot")).agg(F.max("diagonal").alias("diagonal")).drop("spot")
    hits = materialize(hits)
    # each document once, with all its hits
    of_row = hits.groupBy("row").agg(F.collect_list(F.struct("item_row", "n_item", "diagonal")).alias("hits"))
    laid = rows.join(of_row, "row").select("key", hashes(F.col("text")).alias("h"), "hits")
    piece = F.transform("hits", lambda x: F.struct(x["item_row"].alias("item_row"), x["diagonal"].alias("diagonal"), F.slice(F.col("h"), F.greatest(x["diagonal"], F.lit(0)) + 1, F.greatest(x["n_item"] + F.least(x["diagonal"], F.lit(0)), F.lit(0))).alias("piece")))
    laid = laid.select("key", F.inline(piece))
    laid = laid.join(items, "item_row")
    # the item's tokens that lie over the piece
    over = F.slice(F.col("item_hashes"), F.greatest(-F.col("diagonal"), F.lit(0)) + 1, F.size("piece"))
    same = F.zip_with(over, F.col("piece"), lambda a, b: a == b)
    laid = laid.withColumn("same", same)
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        now = F.greatest(acc["now"] + F.when(x, F.lit(1)).otherwise(F.lit(PENALTY)), F.lit(0))
        return F.struct(now.alias("now"), F.greatest(acc["best"], now).alias("best"))

    laid = laid.select("key", "item", "n_item", "diagonal", F.size(F.filter("same", lambda x: x)).alias("n_matched"), F.aggregate("same", zero, step)["best"].alias("stretch"))
    laid = laid.withColumn("share", F.col("n_matched") / F.col("n_item"))
    good = laid.filter((F.col("share") >= LEAST_SHARE) | (F.col("stretch") >= LEAST_STRETCH))
    best = good.groupBy("key", "item").agg(F.max(F.struct("n_matched", "stretch", F.col("n_item"), "share", F.col("diagonal").alias("at"))).alias("b"))
    return best.select(F.col("key").alias(key), F.col("item").alias(item), "b.n_item", "b.n_matched", "b.share", "b.stretch", "b.at")


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that overlap with no benchmark item, with the columns they had."""
    bad = contaminated_pairs(docs, benchmark, key, text).select(F.col(key).alias("__bad")).distinct()
    return docs.join(bad, docs[key].eqNullSafe(bad["__bad"]), "left_anti")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
