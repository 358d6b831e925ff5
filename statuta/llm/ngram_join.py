"""Set-similarity self-join of documents on word shingles by adaptive multi-match prefixes.

The shingles of every document stand in one global order, rare ones first. Two documents with
Jaccard similarity t share at least l of the first n - ceil(t n) + l shingles of each, for any
l. l is chosen for each document by the estimated cost of its candidates: a document whose
prefix holds frequent shingles gets a longer one, and a pair is verified only if it shares as
many prefix shingles as the lesser l of the two asks for, and as many as the lengths need.

Frequencies come from a counting sketch of fixed size over all documents. The order needs
them only roughly: any order that is the same for all documents finds the same pairs.

Equal sets are one class. Prefix shingles of one class alone are dropped. Classes are first
linked with one pivot per shingle, which takes a group of near copies in a linear number of
pairs; then every pair of different components that share enough is compared. Nothing is
capped, and a pair within a component needs no comparison for the components to be right.
Further pivots do the same for what the first left apart, while that makes many pairs.
Parity bits of the sets, an exact bound, spare most pairs that come close to the similarity
the comparison of their sets.
"""

from __future__ import annotations

import functools
import math
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bounded_batches, discard, materialize, mixed, slices, span_hashes, table, text_of, utf8, words
from .components import components

WIDTH = 5
#: Similarity as a fraction: 4 / 5.
UP, DOWN = 4, 5
SKETCH_BITS = 20
SKETCH_BLOCKS = 64
MOST_MATCHES = 4
#: Bytes of text that are hashed at once: a worker needs some fifty times as many.
PIECE_BYTES = 1 << 20
#: Of a filter of keys: bits in all, and of the places of its 64-bit words within one block.
FILTER_BITS, BLOCK_BITS = 26, 8
#: Parity bits of a set, in words: they bound what two sets of up to some thousand shingles share.
PARITY_WORDS = 16
#: Further rounds of pivots while what is left has more than so many pairs a row.
MORE_PIVOTS, FEW_PAIRS = 3, 64


def shingles(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and the n + 1 offsets of the texts in them.

    Words are runs of other bytes than space and tab to carriage return, A-Z in lower case. A
    text of fewer words than the width has one shingle, its whole sequence; one without words
    has none.
    """
    n, raw = len(offsets) - 1, LOWER[raw]
    starts, ends, at = words(raw, offsets)
    h = span_hashes(raw, starts, ends)
    counts = np.diff(at)
    factor, whole = np.uint64(0xD6E8FEB86659FD93), np.zeros(len(h), np.uint64)
    size = max(len(h) - width + 1, 0)
    for k in range(width):
        whole[:size] = whole[:size] * factor + h[k : k + size]
    of_word = np.repeat(np.arange(n), counts)
    full = np.arange(len(h)) + width <= at[1:][of_word] if len(h) else np.zeros(0, bool)
    docs, values = of_word[full], mixed(whole[full])
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        tails = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            tails[has] = tails[has] * factor + h[at[short[has]] + k]
        docs = np.concatenate([docs, short])
        values = np.concatenate([values, mixed(tails + counts[short].astype(np.uint64))])
    order = np.lexsort((values, docs))
    docs, values = docs[order], values[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (docs[1:] != docs[:-1]) | (values[1:] != values[:-1])
    docs, values = docs[fresh], values[fresh]
    return values, np.searchsorted(docs, np.arange(n + 1))


def _per_text(values: np.ndarray, offsets: np.ndarray, how) -> np.ndarray:
    out, full = np.zeros(len(offsets) - 1, values.dtype), np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = how.reduceat(values, offsets[full])
    return out


def sketch(docs: DataFrame) -> np.ndarray:
    """Counts of shingles by the low bits of their hashes, over all documents: 2 ** SKETCH_BITS numbers at any size of input."""
    from pyspark import TaskContext

    block = (1 << SKETCH_BITS) // SKETCH_BLOCKS
    salts = max(1, math.isqrt(docs.select("text").rdd.getNumPartitions()))  # as many sums of a block as each of them has parts

    def count(batches):
        counts, salt = np.zeros(1 << SKETCH_BITS, np.int64), TaskContext.get().partitionId() % salts
        for batch in batches:
            for piece in slices(batch, "text", PIECE_BYTES):
                values, _ = shingles(*utf8(piece.column("text")))
                counts += np.bincount((values & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=len(counts))
        if counts.any():
            for k in range(SKETCH_BLOCKS):
                part = counts[k * block : (k + 1) * block]
                yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "salt": pa.array([salt], pa.int32()), "counts": pa.array([part], pa.list_(pa.int64()))})

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(block, np.int64)
        for x in group.column("counts"):
            total += np.asarray(x.values)
        return pa.table({"block": group.column("block")[:1], "salt": pa.array([0], pa.int32()), "counts": pa.array([total], pa.list_(pa.int64()))})

    shape = "block int, salt int, counts array<long>"
    parts = docs.select("text").mapInArrow(count, shape).groupBy("block", "salt").applyInArrow(add, shape).groupBy("block").applyInArrow(add, shape)
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in parts.toLocalIterator():
        out[r["block"] * block : (r["block"] + 1) * block] = r["counts"]
    return out


def levels(counts: np.ndarray) -> np.ndarray:
    """0 for what is no more frequent than the sketch's mean load doubled, then a step for each factor of the square root of two."""
    floor = max(2.0 * counts.mean(), 1.0)
    return np.clip(np.ceil(2 * np.log2(np.maximum(counts, 1) / floor)), 0, 120).astype(np.uint8)


def prefixes(docs: DataFrame, level: np.ndarray) -> DataFrame:
    """Per row: doc_id, row, n, class (a checksum of the set), matches (l), last (order of the last prefix shingle), cost, parity bits and prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches):
        level = shared.value
        for batch in batches:
            for piece in slices(batch, "text", PIECE_BYTES):
                values, at = shingles(*utf8(piece.column("text")))
                n = np.diff(at)
                sums = _per_text(mixed(values + np.uint64(1)), at, np.add), _per_text(mixed(values ^ np.uint64(0x5851F42D4C957F2D)), at, np.bitwise_xor)
                docs_of = np.repeat(np.arange(len(n)), n)
                step = level[(values & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]
                key = (step.astype(np.uint64) << np.uint64(56)) | (values >> np.uint64(8))
                order = np.lexsort((values, key, docs_of))
                values, key, step = values[order], key[order], step[order]
                least = n - (UP * n + DOWN - 1) // DOWN + (n > 0)
                rank = np.arange(len(values)) - np.repeat(at[:-1], n)
                cost = np.where(rank < np.repeat(least, n), 2.0 ** (step / 2), 0.0)
                cost = _per_text(cost, at, np.add)
                mean = cost / np.maximum(least, 1)
                matches = 1 + np.clip(np.floor(np.log2(np.maximum(mean, 1)) / 2), 0, MOST_MATCHES - 1).astype(np.int64)
                length = np.minimum(least + matches - 1, n)
                matches = np.where(n > 0, length - least + 1, 1)
                inside = rank < np.repeat(length, n)
                ends = np.cumsum(length)
                last = np.zeros(len(n), np.int64)
                last[n > 0] = key[(at[:-1] + length - 1)[n > 0]].astype(np.int64)
                # parity of the shingles that fall on each bit
                spots = (docs_of << 10) | ((values >> np.uint64(24)) & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64)
                odd = np.packbits(np.bincount(spots, minlength=len(n) << 10).astype(np.uint8).reshape(len(n), -1) & 1, axis=1, bitorder="little")
                bits = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * PARITY_WORDS, pa.int32()), pa.array(np.ascontiguousarray(odd).view(np.int64).ravel()))
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values[inside].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("row"), pa.array(n, pa.int64()), pa.array(mixed(sums[0] ^ mixed(sums[1]) ^ n.astype(np.uint64)).view(np.int64)), pa.array(matches, pa.int32()), pa.array(last), pa.array(cost), bits, prefix],
                    ["doc_id", "row", "n", "class", "matches", "last", "cost", "bits", "prefix"],
                )

    return docs.mapInArrow(run, "doc_id long, row long, n long, class long, matches int, last long, cost double, bits array<long>, prefix array<long>")


def probably_in(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows of df whose column may be among the keys (one column of longs): none that is is missing.

    A bitmap of 2 ** FILTER_BITS bits, in blocks that are sent to every task, at any number of keys.
    """
    place = lambda c: F.pmod(c, F.lit(1 << FILTER_BITS))
    word, block = F.shiftright(place(F.col(keys.columns[0])), 6), 1 << BLOCK_BITS
    words = keys.groupBy(word.alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{keys.columns[0]}` & 63 as int))")).alias("v"))
    blocks = words.groupBy(F.shiftright("w", BLOCK_BITS).alias("__block")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("w") % block).alias("k"), "v"))).alias("m"))
    blocks = blocks.select("__block", F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda k: F.coalesce(F.try_element_at("m", k.cast("long")), F.lit(0).cast("long"))).alias("__words"))
    there = df.withColumn("__block", F.shiftright(place(F.col(column)), 6 + BLOCK_BITS)).join(F.broadcast(blocks), "__block")
    bit = F.expr(f"shiftrightunsigned(get(__words, cast(shiftright(pmod(`{column}`, {1 << FILTER_BITS}L), 6) % {block} as int)), cast(`{column}` & 63 as int)) & 1")
    return there.filter(bit == 1).select(*df.columns)


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity, by exact intersection.

    The texts are shuffled, which take half the bytes of their sets; no other texts are hashed.
    """
    wanted = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    # an inner join: a semi join would be moved below the filter, and all texts shuffled for it
    texts = probably_in(docs.select("row", "text"), "row", wanted).join(wanted, "row").dropDuplicates(["row"])
    left = pairs.join(texts.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text_a", PIECE_BYTES):
                (x, x_at), (y, y_at) = (shingles(*utf8(piece.column(c))) for c in ("text_a", "text_b"))
                keep = np.zeros(piece.num_rows, bool)
                for i in range(piece.num_rows):
                    one, other = x[x_at[i] : x_at[i + 1]], y[y_at[i] : y_at[i + 1]]
                    same = len(np.intersect1d(one, other, assume_unique=True))
                    keep[i] = DOWN * same >= UP * (len(one) + len(other) - same)
                yield pa.RecordBatch.from_arrays([piece.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, row, n_shingles, component_id, root.

    component_id: the smallest key reachable by links, the document's own included; null keys
    count for nothing in it and a component of null keys has a null one. A text that is null
    or has no word has n_shingles 0 and is linked with nothing: its component is its own key.
    Rows that are equal in key and text are returned as often as they come. `row` is a hash of
    key and text, `root` the least `row` of the component's classes, null without shingles. Sets
    are compared as sets of 64-bit shingle hashes, and are equal if their 64-bit checksums are.
    No rows give no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    all_rows = materialize(prefixes(docs, levels(sketch(docs))))
    classes = materialize(_classes(all_rows))
    # one pivot per shingle: the class whose prefix is the most frequent, in a group of near copies the one with the fewest changes
    tokens = _tokens(classes)
    pivots = materialize(_pivots(tokens))
    edges = materialize(verified(docs, _sharing(_possible(tokens.join(pivots, "token").filter("row != row_b")), classes)))
    roots = materialize(components(edges))
    # where what isn't a pivot belongs to several components, the others are compared too
    rest = materialize(_unsettled(tokens, roots, pivots))
    for _ in range(MORE_PIVOTS):
        size = rest.groupBy("token").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows"), F.sum(F.expr("n * (n - 1) / 2")).alias("pairs")).first()
        if (size["pairs"] or 0) <= FEW_PAIRS * (size["rows"] or 0):
            break
        pivots = materialize(_pivots(rest))
        links = rest.join(pivots, "token").filter("row != row_b and root != root_b")
        found = materialize(verified(docs, _sharing(_possible(links), classes)))
        edges = edges.union(found)
        roots = materialize(components(edges))
        rest, old = materialize(_unsettled(rest.drop("root"), roots, pivots)), rest
        discard(old)
    # all that are left of one shingle and of different components, if their bits don't tell them apart
    rest = rest.join(classes.select("row", *[F.get("bits", F.lit(k)).alias(f"w{k}") for k in range(PARITY_WORDS)]), "row")
    other = rest.select("token", *[F.col(c).alias(f"{c}_b") for c in rest.columns if c != "token"])
    ahead = (F.col("last") < F.col("last_b")) | ((F.col("last") == F.col("last_b")) & (F.col("row") < F.col("row_b")))  # each pair once
    words = [(F.col(f"w{k}"), F.col(f"w{k}_b")) for k in range(PARITY_WORDS)]
    links = rest.join(other, "token").filter(ahead & (F.col("root") != F.col("root_b")) & (F.col("rank") <= F.col("live") - F.least("matches", "matches_b")))
    edges = edges.union(materialize(verified(docs, _sharing(_possible(links, words), classes))))
    roots = components(edges)
    ends = all_rows.select("doc_id", "row", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class")).alias("class"))
    heads = classes_heads(all_rows).join(roots.select(F.col("node").alias("head"), "root"), "head", "left").select("class", F.coalesce("root", "head").alias("root"), "least")
    # the smallest key of a component: of its classes first, so that no group is gathered
    least = heads.groupBy("root").agg(F.min("least").alias("component_id"))
    heads = heads.select("class", "root").join(least, "root")
    out = ends.join(heads, "class", "left")
    return out.select("doc_id", "row", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "root")


def classes_heads(all_rows: DataFrame) -> DataFrame:
    """(class, head, least): of each class of equal sets the least row and the least key."""
    return all_rows.filter("n > 0").groupBy("class").agg(F.min("row").alias("head"), F.min("doc_id").alias("least"))


def _classes(all_rows: DataFrame) -> DataFrame:
    """Per class that shares a prefix shingle with another: row, n, matches, last, cost, bits and tokens, its shared (at, token) in order."""
    index = all_rows.select("class", F.posexplode("prefix").alias("at", "token"))
    shared = materialize(index.groupBy("token").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo != hi").select("token"))
    live = probably_in(index, "token", shared).join(shared, "token")
    live = live.groupBy("class").agg(F.array_sort(F.collect_set(F.struct("at", "token"))).alias("tokens"))  # at most a prefix
    about = all_rows.filter("n > 0").select("class", "row", "n", "matches", "last", "cost", "bits").groupBy("class").agg(F.min(F.struct("row", "n", "matches", "last", "cost", "bits")).alias("a"))
    return about.join(live, "class").select("a.*", "tokens")


def _tokens(classes: DataFrame) -> DataFrame:
    """A row for each class and shared prefix shingle. rank: its place among those; live: how many there are."""
    return classes.select("row", "n", "matches", "last", "cost", F.size("tokens").alias("live"), F.posexplode("tokens").alias("rank", "t")).select("t.token", "row", "n", "matches", "last", "cost", "live", "rank", "t.at")


def _pivots(tokens: DataFrame) -> DataFrame:
    """(token, row_b, ...): of each shingle the class with the greatest cost."""
    fields = [c for c in ("cost", "row", "n", "at", "live", "rank", "last", "matches", "root") if c in tokens.columns]
    best = tokens.groupBy("token").agg(F.max(F.struct(*fields)).alias("p"))
    return best.select("token", *[F.col(f"p.{c}").alias(f"{c}_b") for c in fields])


def _unsettled(tokens: DataFrame, roots: DataFrame, pivots: DataFrame) -> DataFrame:
    """The rows, with their root, that aren't pivots, of shingles where those belong to several components."""

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.join(roots.select(F.col("node").alias("row"), "root"), "row", "left").withColumn("root", F.coalesce("root", "row"))
        return rows.join(pivots.select("token", "row_b"), "token").filter("row != row_b").drop("row_b")

    several = placed(tokens.select("token", "row")).groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    several = materialize(several.filter("lo != hi").select("token"))
    return placed(probably_in(tokens, "token", several)).join(several, "token")


def _least(n: Column) -> Column:
    """The length of a prefix for one match."""
    return n - F.floor((UP * n + DOWN - 1) / DOWN).cast("long") + 1


def _needed(n: Column, m: Column) -> Column:
    """How many shingles sets of n and m must share."""
    return F.floor((UP * (n + m) + UP + DOWN - 1) / (UP + DOWN)).cast("long")


def _possible(joined: DataFrame, bits: list | None = None) -> DataFrame:
    """Distinct (a, b, must) of the rows of a join on token whose pair can have the similarity.

    Lengths: the lesser is at least t of the greater. Place: with a shared shingle at two
    places, no more can be shared than what stands before both and behind both. Matches: let x
    be the one whose prefix ends first in the order; what x shares of its prefix lies in the
    other's prefix, so at least must = need - (n - length) of it are shared, and x must have
    as many prefix shingles that are not its own alone. A shared shingle is among the first
    live - must + 1 of those, as no more than live - must are not shared; others are left out.
    """
    n, m = F.col("n"), F.col("n_b")
    need = _needed(n, m)
    before, behind = F.least("at", "at_b"), F.least(n - F.col("at"), m - F.col("at_b"))
    first = F.col("last") <= F.col("last_b")
    of_x = lambda c: F.when(first, F.col(c)).otherwise(F.col(f"{c}_b"))
    length = _least(of_x("n")) + of_x("matches") - 1
    must = F.greatest(need - (of_x("n") - length), F.least("matches", "matches_b").cast("long"))
    kept = joined.filter((DOWN * F.least(n, m) >= UP * F.greatest(n, m)) & (before + behind >= need) & (of_x("rank") <= of_x("live") - must))
    if bits:
        kept = kept.filter(_bits_allow(n, m, bits))
    return kept.select(F.least("row", "row_b").alias("a"), F.greatest("row", "row_b").alias("b"), must.alias("must")).distinct()


def _bits_allow(n: Column, m: Column, words: list) -> Column:
    """Sets differ in at least as many shingles as their parity bits do: n + m less those bits is twice what they can share."""
    apart = functools.reduce(operator.add, [F.bit_count(x.bitwiseXOR(y)) for x, y in words])
    return (n + m - apart) >= 2 * _needed(n, m)


def _sharing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that share as many prefix shingles as they must, and whose bits allow them the similarity."""
    pairs = materialize(pairs)
    wanted = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    lists = classes.select("row", "n", "bits", F.col("tokens.token").alias("tokens")).join(wanted, "row", "left_semi")
    both = pairs.join(lists.select(*[F.col(c).alias(c if c == "row" else f"{c}_a") for c in lists.columns]).withColumnRenamed("row", "a"), "a")
    both = both.join(lists.select(*[F.col(c).alias(c if c == "row" else f"{c}_b") for c in lists.columns]).withColumnRenamed("row", "b"), "b")
    words = [(F.get("bits_a", F.lit(k)), F.get("bits_b", F.lit(k))) for k in range(PARITY_WORDS)]
    return materialize(both.filter(_bits_allow(F.col("n_a"), F.col("n_b"), words) & (F.size(F.array_intersect("tokens_a", "tokens_b")) >= F.col("must"))).select("a", "b"))


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id")
