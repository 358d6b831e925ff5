from __future__ import annotations

import random
from collections import defaultdict

import pytest

from statuta.llm import components as cc
from statuta.llm import ngram_join as nj

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """Smallest key reachable by links, of each row."""
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)].append(d)
    return [(d, len(s), (min(ids[root(i)], default=None) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def corpus(seed, docs=200):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(900)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    common, base, rows = prose(14), prose(150), []
    for i in range(docs):
        kind = i % 8
        if kind == 0:
            text = prose(rng.randrange(1, 12))
        elif kind in (1, 2):  # one large group of near copies, from few changes to many
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 6, 9])):
                text[rng.randrange(len(text))] = rng.choice(words)
        elif kind == 3:  # a common passage with a little of its own
            text = prose(rng.randrange(0, 4)) + common
        elif kind == 4 and rows:
            text = rng.choice(rows)[1].split()
            text = text[: -1 - len(text) // 30]
        else:
            text = prose(rng.randrange(5, 80)) + common * rng.randrange(2)
        rows.append((i * 3, " ".join(text).upper() if i % 5 == 0 else "\t".join(text)))
    return [*rows, (None, rows[1][1]), (None, "only null here with some more words"), (7000, None), (7001, ""), (7002, " \n"), (9, rows[3][1]), (9, rows[3][1]), (7003, " ".join(words * 12)), (7004, " ".join(words * 12) + " tail")]


@pytest.mark.parametrize("seed", [1])
def test_components_match_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, root string").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nj.near_groups(df).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_longer_prefixes_find_the_same(spark, monkeypatch):
    rows = corpus(3, 120)
    monkeypatch.setattr(nj, "levels", lambda counts: (counts > 0).astype("uint8") * 9)  # everything counts as frequent
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nj.near_groups(df).collect()), key=str) == sorted(brute(rows), key=str)


def family(seed):
    """Near copies of one text that mostly miss the similarity among themselves, a clique that keeps it, and a stock passage."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(700)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    base, stock, rows = prose(120), prose(60), []
    for i in range(150):
        text = list(base)
        for _ in range(rng.randrange(2, 7) if i % 3 else 1):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
    return rows + [(200 + i, " ".join(stock + prose(4 + i % 20))) for i in range(60)]


@pytest.mark.parametrize("rounds", [0, 3])
def test_a_family_at_the_edge_of_the_similarity(spark, rounds, monkeypatch):
    monkeypatch.setattr(nj, "MORE_PIVOTS", rounds)
    monkeypatch.setattr(nj, "FEW_PAIRS", 0)
    rows = family(rounds)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in nj.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == sorted(brute(rows)) and len({c for *_, c in got}) > 20


def test_parity_bits_never_rule_out_similar_sets(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for n in (3, 8, 40, 300, 3000):
        base = [rng.choice(words) for _ in range(n)]
        for k in (0, 1, 3):
            other = list(base)
            for _ in range(k):
                other[rng.randrange(n)] = rng.choice(words)
            texts.append(" ".join(other))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("row", nj.F.col("doc_id"))
    import numpy as np

    made = nj.prefixes(rows, np.zeros(1 << nj.SKETCH_BITS, np.uint8)).collect()
    sets = {r.doc_id: shingle_set(texts[r.doc_id]) for r in made}
    for x in made:
        for y in made:
            apart = sum(bin((a ^ b) & (1 << 64) - 1).count("1") for a, b in zip(x.bits, y.bits, strict=True))
            assert apart <= len(sets[x.doc_id] ^ sets[y.doc_id])


def test_filter_of_keys_misses_none(spark):
    keys = [(k * 7919 - (1 << 62),) for k in range(300)] + [(5,), (-5,)]
    df = spark.createDataFrame([(k, i) for i, (k,) in enumerate(keys)] + [(k + 1, -1) for (k,) in keys], "k long, i int")
    got = nj.probably_in(df, "k", spark.createDataFrame(keys, "key long")).collect()
    assert {r.i for r in got} - {-1} == set(range(len(keys))) and len(got) < len(keys) + 5


def test_no_rows(spark):
    assert nj.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("few", [cc.FEW, 0])
def test_components_of_a_path_and_a_star(spark, few, monkeypatch):
    monkeypatch.setattr(cc, "FEW", few)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 300)] + [(500, 500), (3, 2)]
    got = {r.node: r.root for r in cc.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 400), 100)}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0
