from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from statuta.llm import periodic as pr


def by_definition(w, least=6, exponent=4):
    """Every maximal stretch of every period, those of smaller periods first."""
    out, n = [], len(w)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                smallest = next(p for p in range(1, q + 1) if all(w[x] == w[x + p] for x in range(i, j + q - p)))
                if smallest == q:
                    out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(texts, **k):
    ids = {}
    flat = np.array([ids.setdefault(w, len(ids)) for t in texts for w in t], np.int64)
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    runs = pr.find_runs(flat, offsets, **k)
    return [[(int(s - a), int(n), int(q)) for s, n, q in runs if a <= s < b] for a, b in zip(offsets, offsets[1:], strict=False)]


def random_text(rng):
    kind, w = rng.randrange(4), []
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randrange(60))]
    if kind == 1:
        a, b = "a", "ab"  # words of Fibonacci: many overlapping repeats
        while len(b) < 80:
            a, b = b, b + a
        return list(b[rng.randrange(20) :][: rng.randrange(80)])
    while len(w) < rng.randrange(1, 120):
        unit = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))]
        unit = unit * rng.randrange(1, 3) + unit[: rng.randrange(3)]
        w += (unit * rng.randrange(1, 7))[: rng.randrange(1, 90)]
    return w


def test_runs_are_those_of_the_definition():
    rng = random.Random(1)
    for _ in range(150):
        texts = [random_text(rng) for _ in range(rng.randrange(1, 12))]
        assert found(texts) == [by_definition(t) for t in texts], texts
    for e, m in ((3, 3), (5, 12)):
        texts = [random_text(rng) for _ in range(60)]
        assert found(texts, exponent=e, least=m) == [by_definition(t, m, e) for t in texts]


def test_equal_texts_side_by_side_are_no_run():
    assert found([["a", "b"]] * 9) == [[]] * 9 and found([[], ["a"] * 6, [], ["a"] * 5, ["a"] * 7]) == [[], [(0, 6, 1)], [], [], [(0, 7, 1)]]


def test_long_texts_are_not_quadratic():
    began = time.time()
    n = 300_000
    assert found([["a"] * n])[0] == [(0, n, 1)]
    half = [str(i) for i in range(n // 4)]
    assert found([half * 4 + ["x"]])[0] == [(0, len(half) * 4, len(half))]
    assert time.time() - began < 30


def expected(rows, plant):
    out = {}
    for key, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", text or "")
        h, n = zlib.crc32(str(key).encode()), len(w)
        if plant and key is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = by_definition(w)
        dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        out[key] = (len(runs), *four, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))
    return out


NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([" ", "\n", "\t\x0b "]).join(rng.choice(["é", "x", "Zz", "中 文"]) if rng.random() < 0.5 else w for w in random_text(rng))) for i in range(250)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "a" * 70_000), (1004, "a b c d " * 5), (None, "z " * 9), (1006, "\x85 \x1c " * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = pr.digest(pr.periodic_runs(pr.planted(df))).select(NAMES).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == expected(rows, True)


def test_other_columns_and_empty_tables(spark):
    df = spark.sql("select 1 as runs, 'a a a a a a b' as body, map('k', 1) as m, 'x' as collapsed, 2 as `a.b`")
    r = pr.periodic_runs(df, "body").first()
    assert r["collapsed"] == "a b" and r["m"] == {"k": 1} and r["a.b"] == 2 and [tuple(x) for x in r["runs"]] == [(0, 6, 1)]
    assert pr.digest(pr.periodic_runs(pr.planted(spark.createDataFrame([], "doc_id long, text string, n int")))).count() == 0
    twice = spark.createDataFrame([(5, "b a a a a a a")] * 2, "doc_id long, text string")
    assert [r["n_runs"] for r in pr.digest(pr.periodic_runs(twice)).collect()] == [1, 1]
    with pytest.raises(ValueError):
        pr.find_runs(np.zeros(9, np.int64), np.array([0, 9]), exponent=2)


def test_whole_table_of_the_smallest_size(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    short = docs.filter(F.length("text") < 6000)
    got = pr.digest(pr.periodic_runs(pr.planted(short))).select(NAMES).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == expected([(r.doc_id, r.text) for r in short.collect()], True)
