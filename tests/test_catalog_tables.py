from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from statuta.operators import catalog
from statuta.sources import listing

D = dt.date
VERSIONS = "id string, versions array<struct<version:int,status:string,effective_from:date,effective_until:date>>"


def test_versions_as_of_equals_a_scan(spark):
    rng = random.Random(3)
    day = lambda: D(2020, 1, 1) + dt.timedelta(rng.randrange(60))
    records = [(f"r{i}", [(v + 1, "s", None if rng.random() < 0.1 else day(), None if rng.random() < 0.3 else day()) for v in range(rng.randrange(4))]) for i in range(40)]
    asked = [(i, None if rng.random() < 0.05 else f"r{rng.randrange(45)}", None if rng.random() < 0.05 else day()) for i in range(400)] + [(900 + i, "r1", D(2020, 2, 1)) for i in range(50)]

    def want(rid, on):
        found = [v for r, vs in records if r == rid and on for v in vs if v[2] and v[2] <= on and (v[3] is None or v[3] > on)]
        return max(found, key=lambda v: v[0])[0] if found else None

    df = spark.createDataFrame(asked, "k long, id string, day date").repartition(4)
    got = catalog.versions_as_of(spark.createDataFrame(records, VERSIONS), df).collect()
    assert len(got) == len(asked) and {r.k: r.version for r in got} == {k: want(i, d) for k, i, d in asked}
    assert catalog.versions_as_of(spark.createDataFrame([], VERSIONS), df).filter("version is not null").count() == 0


def test_postings_find_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abAB金é") for _ in range(rng.randrange(1, 7)))
    rows = [(str(i), " ".join(word() for _ in range(rng.randrange(4))), None if i % 3 else word(), [word()], None, ["d"], "x" if i % 2 else "y") for i in range(200)]
    p = spark.createDataFrame(rows, "id string, title string, issuer string, summaries array<string>, topics array<string>, domain array<string>, status string").withColumn("issuer_code", F.lit(None).cast("string"))
    folder = f"file://{tmp_path}/postings"
    catalog.write_postings(p.repartition(3), folder)
    for query in ["", "a", "d", "ab", "aba", " AB  baa", "金", "金é", "zzz", "abab", "ab zz", "a b é", *[word() for _ in range(12)]]:
        want = sorted(r.id for r in catalog.search(p, query, status="x").collect())
        assert sorted(r.id for r in catalog.search_postings(p, folder, query, status="x").collect()) == want, query


def test_a_search_reads_the_folders_of_its_grams(spark, tmp_path):
    p = spark.createDataFrame([(str(i), f"title {i}") for i in range(500)], "id string, title string").withColumns({c: F.lit(None).cast("string") for c in ("issuer", "issuer_code", "summaries", "topics", "domain")})
    catalog.write_postings(p, f"file://{tmp_path}/t")
    plan = catalog.search_postings(p, f"file://{tmp_path}/t", "e 499")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan


PATHS = [
    ({"payload": {"inner": {"items": [{"a": 1}]}}}, "payload.inner.items", [{"a": "1"}]),
    ({"payload": {"inner": []}, "rows": [{"a": 2}]}, "payload.inner.items", [{"a": "2"}]),
    ({"payload": [{"a": 1}], "list": [{"b": "x"}]}, "payload.inner", [{"b": "x"}]),
    ({"a b": {"c-d": [{"x": None}, 3]}}, "a b.c-d", [{"x": None}]),
    ({"items": [1, "x"], "rows": [{"a": 2}]}, "items", []),
    ({"rows": [{"a": 2}]}, "x['y']", [{"a": "2"}]),
    ({"data": {"results": [{"a": 3}]}}, None, [{"a": "3"}]),
    ({"*": [{"a": 3}], "z": [{"a": 4}]}, "*", []),
]


@pytest.mark.parametrize("column", [True, False])
def test_paths_of_items(spark, column):
    df = spark.createDataFrame([(i, json.dumps(p), path) for i, (p, path, _) in enumerate(PATHS)], "i int, p string, path string")
    if column:
        got = [r[1] for r in sorted(df.select("i", listing.items(F.col("p"), F.col("path"))).collect())]
    else:
        got = [df.filter(F.col("i") == i).select(listing.items(F.col("p"), path or "data.results")).first()[0] for i, (_, path, _) in enumerate(PATHS)]
    assert got == [w for *_, w in PATHS]
