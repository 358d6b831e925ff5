from __future__ import annotations

import datetime as dt
import io
import json
import tracemalloc

import pytest
from pyspark.sql import functions as F

from statuta.sources import files, publish


def test_groups_of_files():
    sizes = [(f"f{i}", 10_000 * i) for i in range(8)]
    groups = files.grouped(list(reversed(sizes)), 60_000)
    assert [p for g in groups for p in g.paths] == [p for p, _ in sizes] and len(groups) == 6 and files.grouped([], 5) == []


def test_record_files(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "a.yaml").write_text("id: x-1\ntitle: One\npublished_on: 2026-01-02\n")
    (tmp_path / "b" / "b.yml").write_text("id: x-1\ntitle: Two\n")
    (tmp_path / "c.yaml").write_text("a: [\n")
    (tmp_path / "d.json").write_text('{"id": "x-2", "published_on": "2026-02-30"}')
    (tmp_path / "e.json").write_bytes(b"\xff\xfe")
    (tmp_path / "f.yaml").write_text("title: none\n")
    (tmp_path / "g.txt").write_text("id: no\n")
    for most in (1, 1 << 20):
        good, issues = files.read_records(spark, f"file://{tmp_path}", groupBytes=str(most))
        assert sorted((r.id, r.title, r.published_on) for r in good.collect()) == [("x-1", "One", dt.date(2026, 1, 2)), ("x-2", None, None)]
        assert sorted((r.rule, r.record_id.rpartition("/")[2]) for r in issues.collect()) == [("duplicate_id", "x-1"), ("no_key", "f.yaml"), ("unreadable", "c.yaml"), ("unreadable", "e.json")]
    rows = files.record_files(spark, f"file://{tmp_path}", groupBytes="1")
    assert rows.rdd.getNumPartitions() == 6 and rows.count() == 6
    none, issues = files.read_records(spark, f"file://{tmp_path}/absent")
    assert none.count() == issues.count() == 0


def test_change_days(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"detected_on": "2026-01-01", "changes": [{"change_type": "new", "policy_id": "p"}]}))
    (tmp_path / "2.json").write_text("{broken")
    (tmp_path / "3.json").write_text(json.dumps({"changes": []}))
    (tmp_path / "4.json").write_text(json.dumps({"detected_on": "2026-01-04", "changes": []}))
    rows, bad = files.read_change_days(spark, f"file://{tmp_path}")
    assert [(r.day, r.policy_id) for r in rows.collect()] == [("2026-01-04", None), ("2026-01-01", "p")]
    assert sorted(r.error for r in bad.collect()) == ["no day", "unreadable: JSONDecodeError"]


DOCUMENTS = [
    '{"detected_on": "2026-01-01", "changes": [{"policy_id": "p\\u00e9\\n é中😀"}, 1, -2.5e-3, null, [{"a": ["]"]}], {"policy_id": "q"}], "change_count": 12}',
    '{"changes": [ ] , "detected_on":"2026-01-01"}', "{ }", '{"detected_on": "x", "changes": {"a": 1}}', '{"changes": null}', '{"a": {"changes": [1]}, "b": -Infinity}',
    '{"changes": [1, 2], "changes": [3], "a": 1, "a": 2}', '{"changes": [1, 2], "changes": 3}', '{"changes": 3, "changes": [1, 2]}', '[{"changes": [1]}]', "12", "",
    '{"changes": [1, 2,]}', '{"changes": [1 2]}', '{"changes": [1, 2]', '{"changes": [1, 2]} x', '{"changes": [tru]}', '{"changes": [{"a": "b]}', '{"changes": [1],}', '{changes: [1]}', '{1: 2}', '{"changes": ["\\x"]}',
]


@pytest.mark.parametrize("block", [1, 2, 7, 1 << 20])
def test_a_record_in_parts_is_the_record(monkeypatch, block):
    monkeypatch.setattr(files, "BLOCK_BYTES", block)
    monkeypatch.setattr(files, "PART_CHARS", 1)
    for raw in [*(d.encode() for d in DOCUMENTS), b'{"changes": [1, "\xff"]}', b'{"changes": [1}, "\xff"', b'{"changes": [1]}\xe4']:
        want, problem = files.read_record(raw, "a.json")
        got = list(files.read_in_parts(lambda raw=raw: io.BytesIO(raw), "a.json", "changes"))
        if problem:
            assert got == [(None, problem)], raw
            continue
        parts, want = [json.loads(r) for r, _ in got], json.loads(want)
        if isinstance(want.get("changes"), list):
            assert all(len(p["changes"]) <= 20 for p in parts)
            assert [x for p in parts for x in p.pop("changes")] == want.pop("changes"), raw
        assert all(p == want for p in parts), raw
        heads = [json.loads(r) for r, _ in files.read_in_parts(lambda raw=raw: io.BytesIO(raw), "a.json", "changes", True)]
        assert len(heads) == 1 and heads[0].get("changes") in ([], parts[0].get("changes")) and heads[0] | {"changes": 0} == parts[0] | {"changes": 0}


def test_a_large_day_is_read_in_parts(spark, tmp_path):
    changes = [{"change_type": "new", "policy_id": f"policy-{i}", "detail": "é" * (i % 50)} for i in range(60_000)]
    (tmp_path / "1.json").write_text(json.dumps({"detected_on": "2026-01-01", "changes": changes}, ensure_ascii=False))
    (tmp_path / "2.yaml").write_text("detected_on: '2026-01-02'\nchanges:\n- policy_id: y\n- policy_id: z\n")
    (tmp_path / "3.json").write_text(json.dumps({"changes": changes}))
    (tmp_path / "4.json").write_text(json.dumps({"detected_on": "2026-01-04", "changes": changes})[:-1])
    parts = files.record_files(spark, f"file://{tmp_path}", inParts="changes").filter("path like '%1.json'").selectExpr("part", "length(record) as n").collect()
    assert len(parts) > 10 and sorted(p.part for p in parts) == list(range(len(parts))) and max(p.n for p in parts) < files.PART_CHARS + 1000
    rows, bad = files.read_change_days(spark, f"file://{tmp_path}")
    assert [(r.day, r.policy_id) for r in rows.collect()] == [("2026-01-02", "y"), ("2026-01-02", "z"), *(("2026-01-01", p) for p in sorted(c["policy_id"] for c in changes))]
    assert sorted((r.file[-6:], r.error) for r in bad.collect()) == [("3.json", "no day"), ("4.json", "unreadable: JSONDecodeError")]
    raw = (tmp_path / "1.json").read_bytes()
    tracemalloc.start()
    n = sum(len(json.loads(r)["changes"]) for r, _ in files.read_in_parts(lambda: io.BytesIO(raw), "1.json", "changes"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(changes) and peak < 8 * files.BLOCK_BYTES


CHANGES = "detected_on date, policy_id string"


def days(spark, *rows):
    return spark.createDataFrame([(dt.date(2026, 1, d), p) for d, p in rows], CHANGES)


def feed(spark, root, **k):
    return sorted((r.detected_on.day, r.policy_id) for r in publish.published_days(spark, root, **k).collect())


def test_a_run_that_stops_before_its_manifest_row_changes_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/feed"
    assert publish.published_days(spark, root) is None
    publish.write_days(days(spark, (1, "lost")), root, 1)
    assert publish.published_days(spark, root) is None
    assert publish.publish_days(spark, days(spark, (1, "a"), (2, "b")), root) == 1
    publish.write_days(days(spark, (2, "half"), (3, "half")), root, 2)
    assert feed(spark, root) == [(1, "a"), (2, "b")]
    assert publish.publish_days(spark, days(spark, (2, "c"), (3, "d")), root) == 2
    assert feed(spark, root) == [(1, "a"), (2, "c"), (3, "d")] and feed(spark, root, days=["2026-01-02"]) == [(2, "c")]


def test_a_snapshot_is_published_as_a_whole(spark, tmp_path, monkeypatch):
    root, one = f"file://{tmp_path}/site", spark.createDataFrame([("a", None)], "id string, x string")
    assert publish.published(spark, root, "policies", one.schema) is None
    publish.publish(spark, {"policies": one, "changes": one.limit(0)}, root)
    two = one.withColumn("id", F.lit("b"))
    with monkeypatch.context() as m:
        m.setattr(publish, "_announce", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            publish.publish(spark, {"policies": two, "changes": two}, root)
    assert [r.id for r in publish.published(spark, root, "policies", one.schema).collect()] == ["a"]
    publish.publish(spark, {"policies": two, "changes": two}, root)
    assert [r.id for r in publish.published(spark, root, "policies", one.schema).collect()] == ["b"]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        publish._announce(spark, root, 2, "", "x", {}, [])
