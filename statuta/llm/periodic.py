"""Periodic runs of words within texts, and texts without the repeats.

A run is a stretch of words in which words `period` apart agree, that no neighbour extends, with
at least `exponent` periods. Seed and extend on diagonals: a run of period q agrees with itself,
q words on, over at least (exponent - 1) * q words, so for periods from 2 ** s to under
2 ** (s + 1) every 2 ** (s + 1) words of that stretch are a seed: the same words stand q further
on. Seeds are the occurrences of equal grams in one text; gram names of twice the length are made
from pairs of names, so equality is exact. As a seed is longer than its period, the next
occurrence of its gram within a run is one period on: pairs of neighbouring occurrences are all
that is needed, at most one a word and scale. The pairs of a lag are taken in order with a table
of how far that lag is covered: a pair that begins in what is covered only moves it on, and one
that begins beyond opens a stretch of its own. Only grams that occur again in their text are
carried to the next scale.

Texts are independent of each other, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, slices, table, text_of, utf8, words

LEAST_WORDS, EXPONENT = 6, 4
RUN = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
WORDS = r"[^\x20\x09-\x0D]+"


def _covered(at: np.ndarray, lag: np.ndarray, gram: int) -> np.ndarray:
    """Rows (start, length, period): pairs of equal grams at `at` and lag words on, joined where they cover each other."""
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    if not len(at):
        return np.zeros((0, 3), np.int64)
    opens = np.ones(len(at), bool)
    # of a lag's pairs in order the one before has covered furthest
    opens[1:] = (lag[1:] != lag[:-1]) | (at[1:] > at[:-1] + gram)
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(at)) - 1
    return np.stack([at[first], at[last] + gram + lag[first] - at[first], lag[first]], 1).astype(np.int64)


def find_runs(ids: np.ndarray, offsets: np.ndarray, least: int = LEAST_WORDS, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (start, length, period) of all runs of texts of word ids, by start, then period.

    offsets: where each text's words begin, and their end; starts count through all of them.
    A run has at least `least` words and `exponent` periods, of which there must be 3.
    """
    if exponent < 3 or least < 3:
        raise ValueError("runs have three periods and three words at least")
    n, longest = len(ids), int(np.diff(offsets).max(initial=0))
    if longest < least:
        return np.zeros((0, 3), np.int64)
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    names, at, span, found = ids.astype(np.int64), np.arange(n), 1, []
    while len(at) and span * exponent <= longest:  # names: of the grams of `span` words at `at`
        right = np.searchsorted(at, at + span) if len(at) < n else at + span
        right[right >= len(at)] = 0
        both = (at[right] == at + span) & (text[at] == text[at[right]])
        key = names[both] * (int(names.max()) + 1) + names[right[both]]
        at = at[both]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        again = (key[1:] == key[:-1]) & (text[at[1:]] == text[at[:-1]])
        lag = np.diff(at)
        pair = again & (lag >= span) & (lag < 2 * span)
        found.append(_covered(at[:-1][pair], lag[pair], 2 * span))
        held = np.zeros(len(at), bool)
        held[1:] |= again
        held[:-1] |= again
        names = np.cumsum(np.append(False, key[1:] != key[:-1])[: len(key)])[held]
        at = at[held]
        order = np.argsort(at, kind="stable")
        at, names, span = at[order], names[order], span * 2
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    runs = runs[runs[:, 1] >= np.maximum(least, exponent * runs[:, 2])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _word_ids(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words."""
    if not len(starts):
        return np.zeros(0, np.int32)
    cuts = np.stack([starts, ends], 1).reshape(-1).astype(np.int64)  # words and what lies between them in turn
    parts = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(raw))])
    return parts.dictionary_encode().indices.to_numpy()[::2]


def _collapsed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, of_text: np.ndarray, kept: np.ndarray) -> pa.Array:
    """Of each text the words that are kept, joined by one space."""
    starts, ends = starts[kept], ends[kept]
    counts = np.append(0, np.cumsum(kept))[of_text]
    sizes = ends - starts + 1
    sizes[counts[1:][counts[1:] > counts[:-1]] - 1] -= 1  # none behind a text's last word
    edges = np.zeros(len(raw) + 2, np.int8)
    edges[starts] += 1
    edges[starts + sizes] -= 1
    inside = np.cumsum(edges[: len(raw)], dtype=np.int8).astype(bool)
    data = raw.copy()
    data[ends[sizes > ends - starts]] = 0x20
    offsets = np.append(0, np.cumsum(sizes))[counts].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(of_text) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))])


def periodic_runs(df: DataFrame, text: str = "text", least: int = LEAST_WORDS, exponent: int = EXPONENT) -> DataFrame:
    """df with runs and collapsed.

    runs: (start, length, period) in words from 0, by start, then period. collapsed: the words
    that no run contains behind its first period, joined by one space. Words are what lies
    between spaces and tabs to carriage returns, byte for byte. A null or empty text, or one of
    few words, has no runs; a text is worked on in one task, in memory in proportion to its
    length; repeated rows are kept; no rows give none. Input columns of the two names are
    replaced.
    """
    df = df.drop("runs", "collapsed")
    bounded_batches(df.sparkSession)
    # names with dots can't be handed to tasks
    rows, names = df.withColumn("__text", text_of(df, text)), [f"c{i}" for i in range(len(df.columns))]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "__text"):
                raw, offsets = utf8(piece.column("__text"))
                starts, ends, of_text = words(raw, offsets)
                runs = find_runs(_word_ids(raw, starts, ends), of_text, least, exponent)
                drop = np.zeros(len(starts) + 1, np.int32)
                np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
                np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
                kept = np.cumsum(drop[:-1]) == 0
                where = np.searchsorted(runs[:, 0], of_text)
                own = of_text[np.searchsorted(of_text, runs[:, 0], "right") - 1]
                fields = pa.StructArray.from_arrays([pa.array(runs[:, 0] - own), pa.array(runs[:, 1]), pa.array(runs[:, 2])], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), fields)
                columns = [piece.column(i) for i in range(piece.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, lists, _collapsed(raw, starts, ends, of_text, kept)], [*names, "runs", "collapsed"])

    fields = [T.StructField(n, f.dataType) for n, f in zip(names, df.schema.fields, strict=True)]
    out = rows.toDF(*names, "__text").mapInArrow(find, T.StructType([*fields, T.StructField("runs", RUN), T.StructField("collapsed", T.StringType())]))
    return out.toDF(*df.columns, "runs", "collapsed")


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, compared exactly; of equal ones the first. Null, if there are none."""
    more = lambda best, x: F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best)
    return F.reduce(runs, F.get(runs, 0), more)


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs in which a tenth of the texts, chosen by a checksum of the key, repeat one stretch of
    words to their end: from a word chosen by the checksum on, every word becomes the one a
    period before. A text without words stays, and so does one without a key."""
    h = F.crc32(F.encode(F.col(key).cast("string"), "utf-8"))
    rows = docs.withColumn("__g", F.floor(h / 10).cast("long")).withColumn("__w", F.when(h % 10 == 0, F.regexp_extract_all(text_of(docs, text), F.lit(WORDS), F.lit(0))))
    n, g = F.size("__w").cast("long"), F.col("__g")
    rows = rows.withColumn("__a", F.when(n > 0, g % n)).withColumn("__p", F.when(n > 0, 1 + F.floor((n - F.col("__a")) / (3 + g % 8))))
    a, p, w = F.col("__a").cast("int"), F.col("__p").cast("int"), F.col("__w")
    left = (n - F.col("__a")).cast("int")
    cycle = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil(left / p).cast("int"))), F.lit(1), left)
    return rows.withColumn(text, F.when(F.col("__a").isNotNull(), F.array_join(F.concat(F.slice(w, F.lit(1), a), cycle), " ")).otherwise(F.col(text))).drop("__g", "__w", "__a", "__p")


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return digest(periodic_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text"))))


def digest(found: DataFrame) -> DataFrame:
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), strongest(F.col("runs")).alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.floor(F.lit(1000) * F.col("b.length") / F.col("b.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
