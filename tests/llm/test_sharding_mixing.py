from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest

from statuta.llm import mixing, sharding

SCHEMA = "doc_id long, text string, source string, shard string"


def rows():
    out = [(i, f"text {i} ü", "big" if i % 3 == 0 else f"s{i % 5}", "x") for i in range(600)]
    return [*out, (None, "a", None, None), (None, None, None, None), (5, "text 5 ü", "s0", "x"), (5, "text 5 ü", "s0", "x"), (601, "y" * 100_000, "s1", "x"), (602, "", "s1", "x")]


def test_shards(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = [tuple(r)[:7] for r in sharding.digest(sharding.external_shuffle(df, bucket_bytes=600)).collect()]
    again = [tuple(r)[:7] for r in sharding.digest(sharding.external_shuffle(df.repartition(7), bucket_bytes=600)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, again))
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r[0], r[1], r[2]) for r in got) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t, *_ in data)
    slots = defaultdict(list)
    for r in got:
        slots[r[4]].append(r[5])
        assert r[6] in (r[4], 40) and 0 <= r[4] < 40
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(slots) == 40 and any(r[6] == 40 for r in got)
    more = {r.doc_id: r.shard for r in sharding.external_shuffle(df, shards=41).collect()}
    assert all(more[r[0]] == r[6] for r in got)


def test_shards_are_written_in_slot_order(spark, tmp_path):
    import pyarrow.dataset as ds

    df = spark.createDataFrame(rows(), SCHEMA)
    placed = sharding.external_shuffle(df, bucket_bytes=600)
    sharding.write_shards(placed, f"{tmp_path}/s")
    back = sharding.read_shards(spark, f"{tmp_path}/s", placed.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, placed.collect()))
    assert len({f.partition("shard=")[2].partition("/")[0] for f in back.inputFiles()}) == 40
    for f in ds.dataset(f"{tmp_path}/s", format="parquet").files:
        slots = ds.dataset(f).to_table(["slot"]).column(0).to_pylist()
        assert slots == sorted(slots)
    # a null key's shard, far larger than the others, has more buckets
    many = spark.createDataFrame([(None if i % 3 else i, f"{i} " * 20) for i in range(900)], "doc_id long, text string")
    sizes = Counter((r.shard, r.bucket) for r in sharding.external_shuffle(many, bucket_bytes=3000).collect())
    assert max(sizes.values()) < 120


def test_fisher_yates_is_fair():
    seen = Counter(tuple(sharding.fisher_yates(3, [i])) for i in range(6000))
    assert len(seen) == 6 and min(seen.values()) > 800


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert sharding.external_shuffle(none).count() == 0 and mixing.mix(none).count() == 0


@pytest.mark.parametrize("shares", [{"a": 1, "b": 1}, {"a": 7, "b": 2, "c": 1}, {"a": 13, "b": 29, "c": 5, "d": 53}])
def test_less_than_a_block(shares):
    total, slots = sum(shares.values()), mixing.period(shares)
    assert sorted(s for x in slots.values() for s in x) == list(range(total))
    for t in range(total + 1):
        for k, w in shares.items():
            assert abs(sum(s < t for s in slots[k]) - w * t / total) < 1


def test_mix(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    shares = {"big": 5, "s0": 1, "s1": 2, "s2": 3, "s3": 1, "s4": 1, None: 1}
    got = mixing.mix(df, shares, block_rows=4).collect()
    assert Counter((r.doc_id, r.text, r.source, r.shard) for r in got) == Counter(data)
    assert len({r.position for r in got}) == len(data)
    places = sorted({(r.slot, r.source, r.block, r.phase) for r in got}, key=lambda x: x[0])
    assert [p[0] for p in places] == list(range(len(places)))
    left = Counter(p[1] for p in places)
    start, begun, active = 0, Counter(), set(left)
    for t, (slot, source, block, phase) in enumerate(places):
        if phase != places[t - 1][3] and t:
            start, begun, active = t, Counter(), {k for k in left if left[k]}
        assert source in active
        begun[source] += 1
        left[source] -= 1
        whole = sum(shares[k] for k in active)
        assert all(abs(begun[k] - (t + 1 - start) * shares[k] / whole) < 1 for k in active)
    assert sorted(r.block for r in got if r.source == "big") == sorted(i // 4 for i in range(200))
    assert [tuple(r) for r in sorted(mixing.mix(df.repartition(5), shares, block_rows=4).collect(), key=lambda r: r.position)] == [tuple(r) for r in sorted(got, key=lambda r: r.position)]


def test_many_sources_go_by_pools(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 20)
    monkeypatch.setattr(mixing, "POOLS", 4)
    data = [(i, "t", f"s{i % 50 if i % 2 else 7}", "x") for i in range(3000)]
    df = spark.createDataFrame(data, SCHEMA)
    for shares in (None, {f"s{i}": 1 + i % 3 for i in range(50)}):
        got = sorted(mixing.mix(df, shares, block_rows=2).collect(), key=lambda r: r.position)
        assert Counter((r.doc_id, r.text, r.source, r.shard) for r in got) == Counter(data) and len({r.position for r in got}) == len(data)
        assert len({r.slot for r in got}) == max(r.slot for r in got) + 1
        if shares:  # while all have blocks left, each is less than a block from its share of its pool, and the pool from its own
            early = got[:240]
            whole = sum(shares[k] for k in {r.source for r in got})
            for k, w in ((k, shares[k]) for k in {r.source for r in got}):
                assert abs(sum(r.source == k for r in early) / 2 - w * 120 / whole) < 2
        assert [r.position for r in sorted(mixing.mix(df.repartition(3), shares, block_rows=2).collect(), key=lambda r: r.doc_id)] == [r.position for r in sorted(got, key=lambda r: r.doc_id)]


def test_missing_share(spark):
    with pytest.raises(ValueError, match="no target share"):
        mixing.mix(spark.createDataFrame(rows(), SCHEMA), {"big": 1})


def test_the_law_is_the_same_for_any_number_of_sources(spark, monkeypatch):
    """A schedule depends on its rows and shares alone: not on how many sources one plan, or runs one source, may have."""
    data = [(i, "t", "heavy" if i % 3 == 0 else f"s{i % 60}", "x") for i in range(1500)]
    df = spark.createDataFrame(data, SCHEMA)
    shares = {"heavy": 30} | {f"s{i}": 1 + i % 3 for i in range(60)}
    places = lambda: [[(r.doc_id, r.phase, r.slot, r.position) for r in mixing.mix(df, s, block_rows=2).orderBy("position").collect()] for s in (shares, None)]
    whole = places()
    monkeypatch.setattr(mixing, "MOST_SOURCES", 5)
    monkeypatch.setattr(mixing, "POOLS", 3)
    monkeypatch.setattr(mixing, "RUN_ROWS", 7)
    assert places() == whole


def test_five_thousand_sources_stay_within_a_block(spark):
    """One source with most of the share among many: less than a block from its share in every phase, as if they were few."""
    names = [f"s{i:04}" for i in range(5000)]
    df = spark.createDataFrame([(i, "t", "heavy" if i < 3000 else names[i % 5000], "x") for i in range(13000)], SCHEMA)
    shares = {"heavy": 2600} | {k: 1 + i % 2 for i, k in enumerate(names)}
    got = mixing.mix(df, shares, block_rows=1).orderBy("position").select("source", "phase", "slot").collect()
    assert [r.slot for r in got] == list(range(13000))
    left, phase, start, begun = Counter(r.source for r in got), 0, 0, 0
    active = sum(shares[k] for k in left)
    for t, r in enumerate(got):
        if r.phase != phase:
            phase, start, begun, active = r.phase, t, 0, sum(shares[k] for k, n in left.items() if n)
        left[r.source] -= 1
        begun += r.source == "heavy"
        if left["heavy"] or r.source == "heavy":
            assert abs(begun - (t + 1 - start) * shares["heavy"] / active) < 1
    # default shares keep their proportions among many
    heavy = mixing.tempered({"heavy": 10**6} | dict.fromkeys(names, 1))
    assert abs(heavy["heavy"] / heavy["s0000"] - (10**6) ** mixing.TEMPER) < 100
