from __future__ import annotations

import copy
import json

import pytest

from statuta.operators import shapes
from statuta.sources import documents

GOOD = {
    "id": "abcd-2026-x", "title": "某某办法", "title_en": None, "issuer": "机构", "issuer_code": "abcd", "jurisdiction": "CN", "instrument_type": "法律", "bindingness": "binding", "ai_relevance": "core", "domain": ["金融", "数据"], "topics": [], "status": "effective",
    "published_on": "2026-01-02", "effective_from": None, "superseded_by": None, "versions": [{"version": 1, "published_on": "2026-01-02", "status": "effective", "url": "https://a.b/c", "content_hash": None}], "source": {"url": "http://a.b", "site": "a.b", "tier": "primary", "fetched_at": "2026-01-02T03:04:05+08:00", "http_status": 200},
    "last_verified": "2026-01-02", "verified_by": "human", "key_obligations": [{"clause": "一", "summary": "应当报告", "obligation_type": None, "tags": ["a"]}], "notes": "n",
}


def broken(change):
    out = copy.deepcopy(GOOD)
    change(out)
    return out


CASES = [
    (lambda r: None, set()),
    (lambda r: r.update(id="a-b"), {"id:minLength"}),
    (lambda r: r.update(id="A" + "b" * 90), {"id:pattern", "id:maxLength"}),
    (lambda r: r.update(id=None), {"id:type"}),
    (lambda r: r.pop("source"), {"source:required"}),
    (lambda r: r.pop("id"), {"id:required"}),
    (lambda r: r.update(source=[]), {"source:type"}),
    (lambda r: r["source"].update(extra=1, fetched_at="2026-01-02"), {"source:additionalProperties", "source.fetched_at:pattern"}),
    (lambda r: r["source"].update(http_status="200"), {"source.http_status:type"}),
    (lambda r: r.update(extra={"a": 1}), {"record:additionalProperties"}),
    (lambda r: r.update(domain=[]), {"domain:minItems"}),
    (lambda r: r.update(domain=["金融", "金融"]), {"domain:uniqueItems"}),
    (lambda r: r.update(domain=["金融", "x", 1]), {"domain[]:enum", "domain[]:type"}),
    (lambda r: r.update(status="gone", published_on="2026-1-2"), {"status:enum", "published_on:pattern"}),
    (lambda r: r["versions"].append({"version": 0, "published_on": 5, "status": "x", "url": "ftp://a", "other": None}), {"versions[].version:minimum", "versions[].published_on:type", "versions[].status:enum", "versions[].url:pattern", "versions[]:additionalProperties"}),
    (lambda r: r["versions"].append({"version": 1.5}), {"versions[].version:type", "versions[].published_on:required", "versions[].status:required", "versions[].url:required"}),
    (lambda r: r.update(versions=[]), {"versions:minItems"}),
    (lambda r: r["key_obligations"].append({"clause": "", "summary": "abc", "obligation_type": "never", "tags": ["a", "a"]}), {"key_obligations[].clause:minLength", "key_obligations[].summary:minLength", "key_obligations[].obligation_type:enum", "key_obligations[].tags:uniqueItems"}),
    (lambda r: r.update(supersedes=["abcd-1", "BAD"]), {"supersedes[]:pattern"}),
]


def test_findings(spark):
    rows = [(str(i), json.dumps(broken(change), ensure_ascii=False)) for i, (change, _) in enumerate(CASES)] + [("text", "{broken"), ("list", "[1]"), ("null", None)]
    df = spark.createDataFrame(rows, "id string, raw string")
    found = shapes.shape_findings(df, "raw", documents.POLICY)
    got = {}
    for r in found.collect():
        got.setdefault(r.record_id, set()).add(r.rule)
    assert {i: got.get(str(i), set()) for i in range(len(CASES))} == {i: want for i, (_, want) in enumerate(CASES)}
    assert got["text"] == got["list"] == got["null"] == {"record:unreadable"}
    assert [r.id for r in shapes.well_formed(df, found).collect()] == ["0"]


def test_an_unknown_keyword_is_an_error():
    with pytest.raises(ValueError):
        shapes.findings({"type": "object", "properties": {"a": {"type": "string", "oneOf": []}}})
