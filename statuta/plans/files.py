"""Queries on files: record files with problems, change days, shapes of raw records, publications."""

from __future__ import annotations

import copy
import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import catalog, diffing, shapes
from ..sources import documents, files, publish
from ..tables import shared_folder
from . import frames as fr
from .queries import HALVES, ORACLE_SQL, P, _halves, _table, change, policy, query

# ---- record files --------------------------------------------------------------------------
RECORDS = "select s_suppkey as k, case when s_suppkey % 7 = 0 then 'broken' when s_suppkey % 11 = 0 then 'list' when s_suppkey % 13 = 0 then 'nameless' else 'good' end as kind, concat('sup-', s_suppkey - case when s_suppkey % 10 = 5 then 1 else 0 end) as id, s_name as title from supplier"
FIRST = f"r as ({RECORDS}), g as (select *, row_number() over (partition by id order by lpad(k::varchar, 12, '0')) as rn from r where kind = 'good')"


@query(f"with {FIRST} select 'record' as what, id as name, title as detail from g where rn = 1 union all select 'issue', case when kind = 'good' then id else concat('k', k) end, case kind when 'good' then 'duplicate_id' when 'nameless' then 'no_key' else 'unreadable' end from (select * from r where kind <> 'good' union all select k, kind, id, title from g where rn = 2)")
def record_file_rows(spark, sf):
    """A YAML file for each supplier: some can't be read, hold no record, have no id, or one that an earlier file has."""
    folder = shared_folder(spark, "files")
    k = F.col("s_suppkey")
    name = F.format_string("%012d", k)
    good = F.concat(F.lit("id: sup-"), (k - F.when(k % 10 == 5, 1).otherwise(0)).cast("string"), F.lit("\ntitle: '"), F.col("s_name"), F.lit("'\npublished_on: 2026-01-02\ntags: [a, b]\n"))
    text = F.when(k % 7 == 0, "id: [broken\n").when(k % 11 == 0, "- a\n- b\n").when(k % 13 == 0, "title: nameless\n").otherwise(good)
    _table(spark, sf, "supplier").select(text.alias("value"), name.alias("file")).repartition(8, "file").write.partitionBy("file").text(folder)
    rows, issues = files.read_records(spark, folder, suffixes=".txt")
    of_file = F.concat(F.lit("k"), F.regexp_extract("record_id", "file=0*([0-9]+)/", 1))
    issues = issues.select(F.lit("issue"), F.when(F.col("rule") == "duplicate_id", F.col("record_id")).otherwise(of_file), "rule")
    return rows.select(F.lit("record").alias("what"), F.col("id").alias("name"), F.col("title").alias("detail")).union(issues)


@query("with e as (select user_id % 40 as d, event_id from events), days as (select d, count(*) as n from e group by d) select concat('2026-01-', lpad(d::varchar, 2, '0')) as day, case when d % 5 = 0 then 'unreadable' when d % 7 = 0 then 'no day' else 'read' end as state, case when d % 5 = 0 or d % 7 = 0 then 0 when d % 11 = 0 then 0 else n end::bigint as changes from days")
def change_day_files(spark, sf):
    """A JSON document for each day, written line by line: some are cut short, some name no day, some have no changes."""
    folder = shared_folder(spark, "files")
    d = F.col("d")
    day = F.format_string("2026-01-%02d", "d").alias("file")
    one = F.struct(F.lit("discovered").alias("change_type"), F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("policy_id"))
    e = _table(spark, sf, "events").withColumn("d", F.col("user_id") % 40)
    opening = F.concat(F.lit("{"), F.when(d % 7 != 0, F.format_string('"detected_on":"2026-01-%02d",', "d")).otherwise(""), F.lit('"changes":['))
    edge = F.when(d % 5 == 0, F.array(F.substring(opening, 1, 10))).otherwise(F.array(opening, F.lit("]}")))
    edges = e.select("d").distinct().select(day, F.posexplode(edge).alias("place", "value")).select("file", (F.col("place") * 2).alias("place"), F.lit(0).cast("bigint").alias("at"), "value")
    lines = edges.unionByName(e.filter(~F.coalesce((d % 5 == 0) | (d % 11 == 0), F.lit(False))).select(day, F.lit(1).alias("place"), F.col("event_id").alias("at"), F.to_json(one).alias("value")))
    n = F.row_number().over(Window.partitionBy("file").orderBy("place", "at"))
    lines = lines.withColumn("n", n).sortWithinPartitions("file", "n")
    lines.select(F.when((F.col("place") == 1) & (F.col("n") > 2), F.concat(F.lit(","), "value")).otherwise(F.col("value")).alias("value"), "file").write.partitionBy("file").text(folder)
    changes, bad = files.read_change_days(spark, folder, suffixes=".txt")
    read = changes.groupBy("day").agg(F.count("policy_id").alias("changes")).select("day", F.lit("read").alias("state"), "changes")
    return read.union(bad.select(F.regexp_extract("file", "file=([0-9-]+)/", 1), F.substring_index("error", ":", 1), F.lit(0)))


# ---- shapes ----------------------------------------------------------------------------------
RAW = {
    "id": "order-{k}", "title": "Rules no {k}", "issuer": "Issuer", "jurisdiction": "CN", "instrument_type": "法律", "bindingness": "binding", "ai_relevance": "core", "domain": ["金融"], "status": "effective", "published_on": "2026-01-02", "last_verified": "2026-01-02", "verified_by": "human",
    "source": {"url": "http://a.b", "site": "a.b", "tier": "primary", "fetched_at": "2026-01-02T03:04:05Z"}, "versions": [{"version": 1, "published_on": "2026-01-02", "status": "effective", "url": "http://a.b"}], "key_obligations": [{"clause": "1", "summary": "must file"}],
}
# what is changed in every so-many-th record, by the path of the field, and the rules that this breaks
BROKEN = [
    ({}, ()),
    ({"id": "Order_{k}"}, ("id:pattern",)),
    ({"issuer_code": "9"}, ("issuer_code:pattern",)),
    ({"title": "x" * 301, "issuer": "y"}, ("title:maxLength", "issuer:minLength")),
    ({"title": None, "published_on": 20260102}, ("title:type", "published_on:type")),
    ({"status": "gone", "bindingness": "", "jurisdiction": "US"}, ("status:enum", "bindingness:enum", "jurisdiction:enum")),
    ({"id": "a-b", "issuer": ..., "source": ...}, ("id:minLength", "issuer:required", "source:required")),
    ({"more": 1, "source.more": 1}, ("record:additionalProperties", "source:additionalProperties")),
    ({"domain": []}, ("domain:minItems",)),
    ({"domain": ["金融", "金融"], "topics": ["disclosure", "none"]}, ("domain:uniqueItems", "topics[]:enum")),
    ({"versions": [{"version": 0, "status": "effective", "url": "b"}]}, ("versions[].version:minimum", "versions[].published_on:required", "versions[].url:pattern")),
    ({"key_obligations": [{"clause": "", "summary": "abc", "tags": [1]}]}, ("key_obligations[].clause:minLength", "key_obligations[].summary:minLength", "key_obligations[].tags[]:type")),
    ({"source": {"url": "x", "site": "a", "tier": "third", "fetched_at": "now"}}, ("source.url:pattern", "source.tier:enum", "source.fetched_at:pattern")),
    ({"superseded_by": "NO", "supersedes": ["a-b", "a-b", "c"]}, ("superseded_by:pattern", "supersedes:uniqueItems", "supersedes[]:pattern")),
]


def _raw(changes: dict) -> str:
    out = copy.deepcopy(RAW)
    for path, value in changes.items():
        *up, name = path.split(".")
        at = out
        for u in up:
            at = at[u]
        if value is ...:
            del at[name]
        else:
            at[name] = value
    return json.dumps(out, ensure_ascii=False)


CASES = ", ".join(f"({i}, '{rule}')" for i, (_, broken) in enumerate(BROKEN) for rule in broken)


@query(f"select concat('o', o_orderkey) as record_id, case when o_orderkey % 101 = 0 then 'record:unreadable' else rule end as rule, 'error' as severity from orders join (values {CASES}, (-1, '')) as c(place, rule) on case when o_orderkey % 101 = 0 then -1 else o_orderkey % {len(BROKEN)} end = c.place")
def shape_findings(spark, sf):
    """Raw records against the schema document; every keyword is broken by some."""
    k = F.col("o_orderkey")
    text = F.replace(F.get(F.array(*[F.lit(_raw(c)) for c, _ in BROKEN]), (k % len(BROKEN)).cast("int")), F.lit("{k}"), k.cast("string"))
    rows = _table(spark, sf, "orders").select(F.concat(F.lit("o"), k.cast("string")).alias("k"), F.when(k % 101 == 0, F.substring(text, 1, 100)).otherwise(text).alias("raw"))
    return shapes.shape_findings(rows, "raw", documents.POLICY, "k")


# ---- publications ----------------------------------------------------------------------------
@query(HALVES + "select event_id, detected_on, change_type, significance from merged")
def published_feed(spark, sf):
    """The feed published in two runs, the second merged into the days that it touches; a third run stops before its manifest row."""
    root = shared_folder(spark, "feed")
    before, now = _halves(spark, sf)
    publish.publish_days(spark, before, root)
    days = [r["day"] for r in now.select(F.col("detected_on").cast("string").alias("day")).distinct().collect()]
    publish.publish_days(spark, diffing.merge_changes(publish.published_days(spark, root, days), now).drop("kept"), root)
    publish.write_days(before.limit(0).union(change(spark, sf).filter("event_id % 3 = 0")), root, 3)
    return publish.published_days(spark, root).select("event_id", "detected_on", "change_type", "significance")


@query(f"select 'policies' as what, id, is_currently_valid as flag, status_label as label from ({ORACLE_SQL['site_view']}) union all select 'changes', policy_id, significance = 'high', concat(case change_type when 'new' then '首次收录' when 'content_changed' then '正文变更' when 'metadata_changed' then '元数据变更' when 'status_changed' then '状态变更' else '待录入' end, '/', case significance when 'high' then '重要' when 'medium' then '一般' else '次要' end) from ({fr.change(fr.Duck)})")
def published_site(spark, sf):
    """Records and changes published together, twice; what is read is the second publication."""
    root, p, c = shared_folder(spark, "site"), catalog.site_view(policy(spark, sf)), change(spark, sf).withColumn("label", F.concat(catalog.label(F.col("change_type"), catalog.CHANGE_LABELS), F.lit("/"), catalog.label(F.col("significance"), catalog.SIGNIFICANCE_LABELS)))
    publish.publish(spark, {"policies": p.filter("id like '%1'"), "changes": c.limit(0)}, root, "first")
    publish.publish(spark, {"policies": p, "changes": c}, root, "second")
    policies, changes = publish.published(spark, root, "policies", p.schema), publish.published(spark, root, "changes", c.schema)
    return policies.select(F.lit("policies").alias("what"), "id", F.col("derived.is_currently_valid").alias("flag"), F.col("derived.status_label").alias("label")).union(changes.select(F.lit("changes"), "policy_id", F.col("significance") == "high", "label"))
