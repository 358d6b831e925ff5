from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from statuta.llm import prefix_trie as pt

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(convs):
    """The trie of {conv_id: [(role, text), ...]}, node by node."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        below = children.get(key, [])
        leaves[key] = sum(leaves[k] for k in below) or 1
        saved[key] = (len(members[key]) - 1) * (len(key[-1][1].encode()) if key else 0) + sum(saved[k] for k in below)
    ends = {key: sorted(c for c in ids if len(convs[c]) == len(key)) for key, ids in members.items()}
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted(((min(ids), len(key), min(members[key[:-1]]) if key else None, len(ids), len(children.get(key, [])), leaves[key], saved[key], sha(ends[key])) for key, ids in members.items()), key=str)


def of_rows(rows):
    out = {}
    for c, _, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def random_rows(rng, n, most=7):
    rows = []
    for c in rng.sample(range(-20, 5 * n), n):
        roles = ["system", None] if rng.random() < 0.3 else ["user", "assistant"]
        rows += [(c, i if i else rng.choice([None, 0]), roles[i % 2], rng.choice(["", "x", "é", "long text " * 3, None])) for i in range(rng.randrange(1, most))]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def got(df):
    return sorted(map(tuple, df.select(*NAMES).collect()), key=str)


def test_rollup_of_random_forests():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randrange(1, 60)
        shape = rng.choice([lambda i: i - 1, lambda i: 0, lambda i: rng.randrange(i), lambda i: (i - 1) // 2])
        parent = [-1 if i == 0 or rng.random() < 0.05 else shape(i) for i in range(n)]
        values = [[rng.randrange(9) for _ in range(n)] for _ in range(2)]
        want = [list(v) for v in values]
        for w in want:
            for i in range(n - 1, 0, -1):
                if parent[i] >= 0:
                    w[parent[i]] += w[i]
        assert pt.rollup(parent, values) == want, parent


def test_rollup_of_a_long_chain():
    n = 50_000
    assert pt.rollup(list(range(-1, n - 1)), [[1] * n])[0] == list(range(n, 0, -1))


@pytest.mark.parametrize("bound", [1, 6, 40, 20_000])
def test_trie_equals_brute_force(spark, bound):
    rng = random.Random(bound)
    rows = random_rows(rng, 150)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(pt.prefix_trie(df, bound)) == brute(of_rows(rows))
    assert got(pt.trie(*pt.rebuilt(*pt.numbered(df)), bound)) == brute(rebuilt(of_rows(rows)))


def test_a_conversation_with_most_of_the_rows_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(pt, "STRETCH", 16)
    rng = random.Random(9)
    long = [("user", rng.choice("ab")) for _ in range(400)]
    convs = {7: long, 8: long[:300] + [("user", "c")] * 20, 9: long[:300], 11: []} | {c: long[:3] for c in range(100, 160)} | {c: long[:2] + [("user", str(c))] for c in range(200, 260)}
    rows = [(c, i, *t) for c, turns in convs.items() for i, t in enumerate(turns)]
    rng.shuffle(rows)
    del convs[11]
    for bound in (1, 50):
        assert got(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(6), bound)) == brute(convs)


def test_nulls_repeats_other_columns_and_empty_tables(spark):
    rows = [(None, 1, "user", "x"), (1, None, None, None), (1, None, None, None), (1, 2, "user", "é"), (2, None, "", ""), (2, None, "", "")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", depth int, k1 int")
    assert got(pt.prefix_trie(df)) == brute(of_rows(rows))
    assert pt.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    # a conversation that loses all its turns is a member of the root
    lost = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    alone = spark.createDataFrame([(lost, 0, "user", "x")], SCHEMA)
    assert got(pt.trie(*pt.rebuilt(*pt.numbered(alone)))) == brute({lost: []})


def test_query_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("create view conversations as select * from '/root/testdata/sf0.01/conversations.parquet'")
    cursor = con.execute(pt.SQL)
    names = [d[0] for d in cursor.description]
    assert sorted(map(tuple, pt.op12_prefix_trie(spark, "/root/testdata/sf0.01").select(*names).collect()), key=str) == sorted(cursor.fetchall(), key=str)
