"""Domain frames that Spark and DuckDB derive alike from the driver's tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "1999-06-01"
STATUS = "draft consultation published effective partially_effective amended repealed superseded expired unknown".split()


class Duck:
    """Names and date arithmetic of the oracle's dialect."""

    add = staticmethod(lambda d, n: f"({d} + cast({n} as integer))")
    array = staticmethod(lambda *x: f"[{', '.join(x)}]")
    none = "cast([] as varchar[])"
    extra = "text as body"
    table = staticmethod(lambda name: name)


class Spark:
    add = staticmethod(lambda d, n: f"date_add({d}, cast({n} as int))")
    array = staticmethod(lambda *x: f"array({', '.join(x)})")
    none = "cast(array() as array<string>)"
    extra = "map('body', text) as extra"
    table = staticmethod(lambda name: "{" + name + "}")


def load(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A frame's text run over the tables that it names in braces."""
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def status(index: str) -> str:
    return f"case {index} " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(STATUS)) + " end"


def policy(d, old: bool = False) -> str:
    k, day = "o_orderkey", "cast(o_orderdate as date)"
    at = f"case when {k} % 13 = 0 then ({k} + 1) % 10 else {k} % 10 end" if old else f"{k} % 10"
    text = f"case when {k} % 19 = 0 then concat('sha256:old', {k}) else concat('sha256:', o_custkey) end" if old else "concat('sha256:', o_custkey)"
    return f"""select concat('ord-', {k}) as id, concat('Rules on ', o_orderpriority, ' no ', {k}) as title, concat('Issuer ', o_custkey % 14) as issuer,
 case when o_custkey % 50 = 0 then null else concat('iss', o_custkey % 14) end as issuer_code, {status(f"({at})")} as status,
 case {k} % 3 when 0 then 'core' when 1 then 'related' else 'background' end as ai_relevance, {day} as published_on,
 case when {k} % 4 = 0 then null else {d.add(day, f"{k} % 60 - 5")} end as effective_from,
 case when {k} % 7 <> 0 then null else {d.add(day, f"{k} % 90 - 20")} end as effective_until, {d.add(day, "o_custkey % 400")} as last_verified,
 case when {k} % 10 = 7 then concat('ord-', {k} + 1) when {k} % 97 = 0 then concat('ord-', {k}) end as superseded_by,
 case when {k} % 20 = 8 then {d.array(f"concat('ord-', {k} - 1)")} when {k} % 89 = 0 then {d.array(f"concat('ord-', {k})", "'ord-none'")} else {d.none} end as supersedes,
 case when {k} % 31 = 0 then {d.array(f"concat('ord-', {k} + 2)")} else {d.none} end as amends, case when {k} % 37 = 0 then {d.array("'ord-gone'")} else {d.none} end as amended_by,
 case {k} % 4 when 0 then {d.array("'disclosure'")} when 1 then {d.array("'disclosure'", "'ethics-review'")} when 2 then {d.array("'model-risk'")} else {d.none} end as topics,
 {d.array("'金融'")} as domain, {d.array(f"concat('must file ', {k} % 9)")} as summaries,
 case when o_custkey % 3 = 0 then 'human' else 'automated' end as verified_by,
 case {k} % 6 when 0 then null when 1 then '生效日期待确认' when 2 then '已核验原文' when 3 then '未在公开摘录中明确写出施行日期' else 'checked' end as verified_note,
 case when {k} % 8 = 0 then '追溯适用' end as notes, case when o_custkey % 40 = 1 then 'secondary' else 'primary' end as tier,
 {text} as content_hash, concat('http://p.example/', {k} % 5000) as url, cast({k} % {4 if old else 5} as bigint) as n_obligations
 from {d.table("orders")}{f" where {k} % 11 <> 0" if old else ""}"""


def raw_doc(d) -> str:
    return f"""select doc_id as seq, source as source_id, replace(substr(text, 1, cast(8 + doc_id % 40 as int)), chr(10), ' ') as title,
 concat('http://a.example/', source, '/', doc_id % 37, case when doc_id % 3 = 0 then '/d.html' else '' end) as url,
 case when doc_id % 4 = 0 then null else {d.add("date '2026-01-01'", "doc_id % 200")} end as published_on, {d.extra} from {d.table("documents")}"""


def registry(d) -> str:
    return f"""select id, 'iss1' as issuer_code, id <> 'src3' as enabled, 'html_list' as fetcher, concat('http://a.example/', id, '/') as list_url,
 {d.array("'ción'", "'th'", "' '")} as include_keywords, {d.array("'ñ'", "'xt'", "''")} as exclude_keywords from (select distinct source as id from {d.table("documents")}) s
 union all select 'src_none', 'iss99', true, 'html_list', '', {d.none}, {d.none} union all select 'src_manual', 'iss2', true, 'manual', null, {d.none}, {d.none}"""


def change(d) -> str:
    return f"""select cast(ts as date) as detected_on, case event_type when 'view' then 'discovered' when 'click' then 'metadata_changed' when 'purchase' then 'content_changed' when 'signup' then 'new' else 'status_changed' end as change_type,
 concat('u', user_id) as policy_id, case event_id % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as significance,
 case when event_id % 5 = 0 then null else concat('http://e.example/', user_id % 40, '/', event_id % 7) end as url, event_id from {d.table("events")}"""


def penalty(d) -> str:
    words = ["未按规定履行客户身份识别义务", "违反数据安全管理规定", "未按规定保存客户身份资料", "违反信息披露管理规定", "", "虚报统计资料"]
    fact = "case l_partkey % 6 " + " ".join(f"when {i} then '{w}'" for i, w in enumerate(words)) + " end"
    return f"""select concat('pen-2020-', l_orderkey, '-', min(l_linenumber)) as id, concat('D', l_orderkey) as decision_no, s_name as party, n_name as authority, {fact} as violation_type,
 case when l_partkey % 6 < 3 then {d.array("n_name")} else {d.none} end as domain, concat('罚款', l_partkey % 6, '万元') as penalty_content,
 {d.array("concat('ord-', l_orderkey)", "concat('ord-', l_orderkey + 1)")} as related_policies, case when l_partkey % 6 = 1 then '第五条' end as legal_basis,
 case l_orderkey % 3 when 0 then '抄自原文' when 1 then '' end as notes, case when l_orderkey % 4 = 0 then 'human' else 'automated' end as verified_by, l_partkey % 6 as kind, l_orderkey as order_key
 from {d.table("lineitem")} join {d.table("supplier")} on l_suppkey = s_suppkey join {d.table("nation")} on s_nationkey = n_nationkey group by l_orderkey, s_name, n_name, l_partkey % 6"""


def versions(d) -> str:
    """A row per version."""
    day = "cast(l_shipdate as date)"
    return f"""select concat('ord-', l_orderkey) as id, l_linenumber as version, case l_returnflag when 'R' then 'superseded' when 'A' then 'amended' else 'effective' end as status,
 {day} as effective_from, case when l_linenumber % 3 = 0 then null else {d.add(day, "400")} end as effective_until from {d.table("lineitem")}"""


def evidence(d) -> str:
    """Records with the page that was captured for them."""
    y, m, day = "2020 + p_partkey % 6", "p_partkey % 12 + 1", "p_partkey % 28 + 1"
    body = f"""concat('某某办法', p_partkey, chr(10), case when p_partkey % 5 = 0 then '' else concat('本办法自', {y}, '年', {m}, '月', {day}, '日起施行。') end, chr(10), '第', p_partkey % 20 + 1, '条 金融机构应当建立管理制度并向监管部门报告。第', p_partkey % 20 + 2, '条 其他。')"""
    return f"""select concat('part-', p_partkey) as policy_id, concat('http://r.example/', p_partkey) as url, concat('某某办法', case when p_partkey % 17 = 0 then p_partkey + 1 else p_partkey end) as title, cast(null as string) as doc_number,
 case when p_partkey % 3 = 0 then null when p_partkey % 11 = 0 then date '2019-01-01' else make_date(cast({y} as int), cast({m} as int), cast({day} as int)) end as effective_from,
 case when p_partkey % 23 = 0 then null else cast(case when p_partkey % 29 = 0 then 404 else 200 end as int) end as status_code, case when p_partkey % 23 = 0 then 'timeout' end as error,
 case when p_partkey % 31 = 0 then 'http://r.example/' else concat('http://r.example/', p_partkey) end as final_url, {body} as body_text, p_partkey % 7 <> 0 as usable,
 case when p_partkey % 13 = 0 then 'sha256:0' end as content_hash, case when p_partkey % 19 = 0 then null else concat('某某办法', p_partkey, '_某网') end as page_title, p_partkey as k from {d.table("part")}"""
