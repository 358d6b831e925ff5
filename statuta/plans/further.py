"""Queries on publication, promotion, attachments, files and streams, beside those of .queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import catalog, cleaning, diffing, enforcement, evidence, promotion, validation
from ..sources import html, records
from ..streaming import feeds
from . import frames as fr
from .queries import CHG, ORACLE_SQL, P, _folder, _table, _with_versions, change, old_policy, policy, query


# ---- catalog and cleaning ------------------------------------------------------------------
@query(f"with p as ({P}) select id, status from p where status in ('repealed', 'superseded', 'expired')")
def terminal_records(spark, sf):
    return policy(spark, sf).filter(catalog.is_terminal()).select("id", "status")


@query(f"with p as ({P}) select id, title, status from p where id = 'ord-7'")
def record_by_id(spark, sf):
    return catalog.by_id(policy(spark, sf), "ord-7").select("id", "title", "status")


TITLES = "case p_partkey % 6 when 0 then '下一页' when 1 then concat('共', p_partkey, '页') when 2 then 'Contact us' when 3 then concat('第', p_partkey, '页') when 4 then concat('关于第', p_partkey, '号的通知') else concat('办法', p_partkey) end"


@query("select p_partkey as at, concat(case p_partkey % 6 when 4 then '关于第' else '办法' end, p_partkey, case p_partkey % 6 when 4 then '号的通知' else '' end) as title from part where p_partkey % 6 >= 4")
def pager_noise(spark, sf):
    return cleaning.without_pager_noise(_table(spark, sf, "part").select(F.col("p_partkey").alias("at"), F.expr(TITLES).alias("title")))


@query("select p_partkey as at from part where p_partkey % 4 = 3")
def derivatives(spark, sf):
    url = F.expr("concat('http://c.example/', case p_partkey % 4 when 0 then 'zhuanti/' when 1 then 'a/jiedu' when 2 then 'x_tujie_' else 'zhengce/' end, p_partkey)")
    return cleaning.without_derivatives(_table(spark, sf, "part").select(F.col("p_partkey").alias("at"), url.alias("url"))).select("at")


@query("select 'a' as source_id, s_suppkey as k, s_name as title, cast(null as varchar) as extra from supplier union all select 'b', c_custkey, c_name, c_mktsegment from customer")
def all_sources(spark, sf):
    one = _table(spark, sf, "supplier").select(F.lit("a").alias("source_id"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("title"))
    two = _table(spark, sf, "customer").select(F.lit("b").alias("source_id"), F.col("c_custkey").alias("k"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("extra"))
    return cleaning.all_sources(one, two)


@query("select o_orderkey as k, case when o_orderkey % 9 < 1 then 'http://l.example/' else concat('http://l.example/list_', o_orderkey % 9, '.html') end as zero_based, case when o_orderkey % 9 < 1 then 'http://l.example/' else concat('http://l.example/list_', o_orderkey % 9 + 1, '.html') end as one_based from orders")
def page_urls(spark, sf):
    at, pattern, page = F.lit("http://l.example/"), F.lit("http://l.example/list_{page}.html"), F.col("o_orderkey") % 9 + 1
    return _table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), S.page_url(at, pattern, page).alias("zero_based"), S.page_url(at, pattern, page, True).alias("one_based"))


@query("select o_orderkey as k, concat('http://l.example/api', case when o_orderkey % 2 = 0 then '?v=1&' else '?' end, 'channel=c', o_custkey, '&page=', o_orderkey % 9, '&rows=20') as url from orders")
def request_urls(spark, sf):
    params = F.create_map(F.lit("channel"), F.lit("c{channel_id}"), F.lit("page"), F.lit("{page}"), F.lit("rows"), F.lit("{page_size}"))
    base = F.expr("concat('http://l.example/api', case when o_orderkey % 2 = 0 then '?v=1' else '' end)")
    return _table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), S.request_url(base, params, F.col("o_custkey"), F.col("o_orderkey") % 9, F.lit(20)).alias("url"))


@query("select r_regionkey as region, n_nationkey as nation, case n_nationkey % 4 when 3 then '' else concat(n_name, ' site') end as site, case when n_nationkey % 4 = 3 then 'failed' when n_nationkey % 4 = 2 then 'failed' else 'ok' end as status from nation join region on n_regionkey = r_regionkey")
def site_checks(spark, sf):
    tag = F.expr("case n_nationkey % 4 when 0 then concat('<META Name=\"SiteName\" content=\"', n_name, ' site\">') when 3 then '<meta name=\"Other\" content=\"x\">' else concat('<meta content=\"', n_name, ' site\" name=SiteName>') end")
    pages = _table(spark, sf, "nation").join(_table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    pages = pages.select(F.col("r_regionkey").alias("region"), F.col("n_nationkey").alias("nation"), F.concat(F.lit("<html><head>"), tag, F.lit("</head></html>")).alias("html"), F.when(F.col("n_nationkey") % 4 == 2, "elsewhere").otherwise(F.col("n_name")).alias("expected"))
    return html.site_check(pages).select("region", "nation", "site", "status")


# ---- snapshots and the feed ----------------------------------------------------------------
@query(f"with i as (select concat('c', c_custkey) as record_id, case c_custkey % 3 when 0 then 'error' else 'warning' end as severity from customer) select 'change' as kind, policy_id as id, change_type as what from ({ORACLE_SQL['snapshot_diff']}) union all select 'error', record_id, 'baseline:unreadable' from i where severity = 'error'")
def baseline_diff(spark, sf):
    issues = _table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("record_id"), F.lit("unreadable").alias("rule"), F.when(F.col("c_custkey") % 3 == 0, "error").otherwise("warning").alias("severity"))
    changes, errors = diffing.baseline_changes(old_policy(spark, sf), issues, policy(spark, sf), fr.AS_OF)
    return changes.select(F.lit("change").alias("kind"), F.col("policy_id").alias("id"), F.col("change_type").alias("what")).union(errors.select(F.lit("error"), "record_id", "rule"))


@query(f"with c as ({CHG}), p as ({P}) select (select count(*) from c) as entries, (select count(distinct detected_on) from c) as days, (select count(*) from p) + (select count(distinct detected_on) from c) as pages")
def feed_totals(spark, sf):
    out = diffing.feed_totals(change(spark, sf), policy(spark, sf))
    return out.select(*[F.col(c).cast("long").alias(c) for c in ("entries", "days", "pages")])


# ---- penalties and obligations -------------------------------------------------------------
@query("select case when c_custkey % 5 = 0 then null when c_custkey % 5 < 3 then 'institution' else 'person' end as party_type, count(*) as penalties, count(distinct c_name) as parties from orders join customer on o_custkey = c_custkey group by 1")
def penalties_by_party_type(spark, sf):
    rows = _table(spark, sf, "orders").join(_table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return enforcement.by_party_type(rows.select(F.expr("case when c_custkey % 5 = 0 then null when c_custkey % 5 < 3 then 'institution' else 'person' end").alias("party_type"), F.col("c_name").alias("party")))


@query("select case l_returnflag when 'R' then 'prohibition' when 'A' then 'disclosure' else 'governance' end as obligation_type, count(*) as obligations, count(distinct l_orderkey) as records from lineitem group by 1")
def obligations_by_type(spark, sf):
    kind = F.expr("case l_returnflag when 'R' then 'prohibition' when 'A' then 'disclosure' else 'governance' end")
    rows = _table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(F.col("l_linenumber").cast("string").alias("clause"), kind.alias("obligation_type"))).alias("key_obligations"))
    return enforcement.obligations_by_type(rows)


# ---- evidence ------------------------------------------------------------------------------
ATTACHED = "select concat('http://r.example/', l_orderkey) as page_url, concat('http://r.example/f', l_linenumber, '.', case l_partkey % 4 when 0 then 'doc' when 1 then 'pdf' else 'docx' end) as href, l_orderkey * 10 + l_linenumber as k, min(l_partkey) as part, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey % 4) as rank from lineitem group by l_orderkey, l_linenumber, l_partkey % 4"
STATES = f"select *, case when part % 4 = 0 then 'unsupported' when part % 7 = 0 or part % 11 = 0 or part % 5 = 0 then 'failed' else 'extracted' end as status, case when part % 4 = 0 then null when part % 7 = 0 then 'HTTP 404' when part % 11 = 0 then 'too large' when part % 5 = 0 then 'no text' end as reason from ({ATTACHED})"
TRIED = f"with s as (select * from ({STATES}) where rank <= 3), f as (select page_url, min(rank) as first from s where status = 'extracted' group by 1) select s.page_url, s.href, s.rank, s.status from s left join f on s.page_url = f.page_url where first is null or rank <= first"


def _attachments(spark, sf):
    a = fr.load(spark, sf, ATTACHED.replace("from lineitem", "from {lineitem}"))
    fields = {"extension": "case part % 4 when 0 then 'doc' when 1 then 'pdf' else 'docx' end", "status_code": "case when part % 7 = 0 then 404 else 200 end", "size": "case when part % 11 = 0 then 20000000L else 1000L end", "text": "case when part % 5 = 0 then '' else concat('text ', part) end"}
    return evidence.attachment_state(a.withColumns({k: F.expr(v) for k, v in fields.items()}))


@query(f"select page_url, href, rank, status, reason from ({STATES})")
def attachment_states(spark, sf):
    return _attachments(spark, sf).select("page_url", "href", F.col("rank").cast("long").alias("rank"), "status", "reason")


@query(TRIED)
def attachments_tried(spark, sf):
    return evidence.tried_attachments(_attachments(spark, sf)).select("page_url", "href", F.col("rank").cast("long").alias("rank"), "status")


@query(f"with t as ({TRIED}), a as (select page_url, string_agg(concat(rank, ':', status), ',' order by rank) as tried from t group by 1), pages as (select concat('http://r.example/', c_custkey) as url, c_name as page_title from customer) select o_orderkey as k, page_title, coalesce(tried, '') as tried from (select *, concat('http://r.example/', o_orderkey) as url from orders) o left join pages using (url) left join a on a.page_url = url")
def evidence_join(spark, sf):
    """Records with their pages and the attachments that were tried."""
    recs = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("http://r.example/"), F.col("o_orderkey").cast("string")).alias("url"))
    pages = _table(spark, sf, "customer").select(F.concat(F.lit("http://r.example/"), F.col("c_custkey").cast("string")).alias("url"), F.col("c_name").alias("page_title"))
    out = evidence.joined_pages(recs, pages, evidence.tried_attachments(_attachments(spark, sf)))
    return out.select("k", "page_title", F.array_join(F.transform("attachments", lambda a: F.concat(a["rank"].cast("string"), F.lit(":"), a["status"])), ",").alias("tried"))


CHECKS = "select concat('p', o_custkey) as policy_id, cast(o_orderkey % 3 as int) as pos, concat('check:', o_orderkey) as check_id, case o_orderkey % 5 when 0 then 'error' when 1 then 'manual' else 'ok' end as status from orders where o_orderkey % 7 <> 0"


def _checks(spark, sf):
    c = fr.load(spark, sf, CHECKS.replace("from orders", "from {orders}"))
    none = F.array().cast("array<struct<key:string,label:string,kind:string,field:string,value:string,index:int>>")
    return c.select("policy_id", "pos", "check_id", F.lit("x").alias("layer"), "status", F.lit("").alias("summary"), F.array().cast("array<string>").alias("evidence"), none.alias("options"))


@query(f"with c as ({CHECKS}), r as (select concat('p', c_custkey) as policy_id from customer) select r.policy_id, case when count(c.check_id) = 0 then 1 else count(c.check_id) end as checks, case when count(c.check_id) = 0 then 1 else count(*) filter (c.status <> 'ok') end as pending_count, count(c.check_id) = 0 as failed from r left join c on r.policy_id = c.policy_id group by 1")
def cards_kept(spark, sf):
    """Cards written and read back: a record without any check keeps a card."""
    recs = _table(spark, sf, "customer").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("policy_id"))
    folder = _folder(spark)
    cards = evidence.cards_kept(_checks(spark, sf), recs)
    records.persist_cards(cards, folder, "2026-01-02")
    back = spark.read.schema(cards.schema).json(folder)
    return back.select("policy_id", F.size("checks").cast("long").alias("checks"), "pending_count", F.exists("checks", lambda c: c["check_id"] == "evidence-failure").alias("failed"))


# ---- promotion -----------------------------------------------------------------------------
GATE = f"with c as ({CHECKS}), d as (select concat('p', o_custkey) as policy_id, concat('check:', o_orderkey) as check_id from orders where o_orderkey % 3 <> 0), open as (select policy_id, count(*) as n from c where status <> 'ok' and not exists (select 1 from d where d.policy_id = c.policy_id and d.check_id = c.check_id) group by 1)"


def _decided(spark, sf):
    return _table(spark, sf, "orders").filter("o_orderkey % 3 <> 0").select(F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("policy_id"), F.concat(F.lit("check:"), F.col("o_orderkey").cast("string")).alias("check_id"))


def _drafts(spark, sf):
    return _table(spark, sf, "customer").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_custkey").alias("k"))


@query(GATE + " select concat('p', c_custkey) as policy_id, coalesce(n, 0) as open_checks, case when c_custkey % 10 = 0 then 'exists' when n > 0 then 'blocked' else 'promote' end as outcome from customer left join open on policy_id = concat('p', c_custkey)")
def promotion_gate(spark, sf):
    drafts = _drafts(spark, sf)
    return promotion.gate(drafts, _checks(spark, sf), _decided(spark, sf), drafts.filter("k % 10 = 0"))


@query("select 'left' as what, concat('p', c_custkey) as id from customer where not (c_custkey % 3 = 0 and c_custkey % 4 <> 0) union all select 'refused', concat('p', c_custkey) from customer where c_custkey % 3 = 0 and c_custkey % 4 = 0 union all select 'refused', concat('x', n_nationkey) from nation")
def rejected_drafts(spark, sf):
    """Drafts left after rejections, and requests refused: without a reason, or for what is no draft."""
    asked = _drafts(spark, sf).filter("k % 3 = 0").select(F.col("id").alias("policy_id"), F.when(F.col("k") % 4 == 0, " ").otherwise("not a rule").alias("reason"))
    asked = asked.union(_table(spark, sf, "nation").select(F.concat(F.lit("x"), F.col("n_nationkey").cast("string")), F.lit("no draft")))
    left, refused = promotion.reject(_drafts(spark, sf), asked)
    return left.select(F.lit("left").alias("what"), "id").union(refused.select(F.lit("refused"), "policy_id"))


OWN_ERRORS = f"select distinct record_id as id from ({ORACLE_SQL['validate_policies']}) where severity = 'error'"
INTO = f"""with recursive p as ({P}), cand as (select * from p where cast(substr(id, 5) as bigint) % 3 = 0), e as (select id, 'superseded_by' as kind, superseded_by as target from p where superseded_by is not null
 union all select id, 'supersedes', unnest(supersedes) from p union all select id, 'amends', unnest(amends) from p union all select id, 'amended_by', unnest(amended_by) from p),
 unclosed as (select id, target from ({ORACLE_SQL['unclosed_links']})), own as ({OWN_ERRORS}),
 first as (select id from own union select id from e where target not in (select id from p) union select id from e where id = target and kind in ('superseded_by', 'supersedes') union select id from unclosed union select target from unclosed where id not in (select id from cand)),
 bad as (select id from first where id in (select id from cand) union select e.id from e join bad on e.target = bad.id where e.id in (select id from cand))
 select id, case when id in (select id from bad) then 'rolled_back' else 'promoted' end as outcome from cand"""


@query(INTO)
def promote_into_repository(spark, sf):
    """A third of the records as candidates for a repository of the others."""
    p = _with_versions(spark, sf)
    number = F.substring("id", 5, 20).try_cast("long") % 3
    return promotion.promote_into(p.filter(number == 0), p.filter(number != 0))


@query(f"select 'human' as mode, case outcome when 'promoted' then 'promote' else 'rollback' end as kind, id as policy_id, '2026-01-02T03:00:00' as ts from ({INTO})")
def ledger_entries(spark, sf):
    """Ledger rows of a promotion, appended as JSON lines and read back."""
    folder = _folder(spark)
    records.append_ledger(promotion.ledger_rows(promote_into_repository(spark, sf), "2026-01-02T03:00:00", "human"), folder)
    return records.read_ledger(spark, folder).select("mode", "kind", "policy_id", "ts")


# ---- files -----------------------------------------------------------------------------------
@query(f"with p as ({P}) select id, effective_from, published_on, status from p")
def records_written(spark, sf):
    """Records as JSON objects and back: a null date stays null."""
    folder, p = _folder(spark), policy(spark, sf)
    records.write_records(p, folder)
    return spark.read.schema(p.schema).json(folder).select("id", "effective_from", "published_on", "status")


@query("select o_orderkey as k, concat('{\"id\":\"o', o_orderkey, '\",\"on\":', case when o_orderkey % 4 = 0 then 'null' else concat('\"', strftime(cast(o_orderdate as date), '%Y-%m-%d'), '\"') end, ',\"all\":[\"', strftime(cast(o_orderdate as date), '%Y-%m-%d'), '\"]}') as json from orders")
def iso_records(spark, sf):
    day = F.col("o_orderdate").cast("date")
    o = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.when(F.col("o_orderkey") % 4 != 0, day).alias("on"), F.array(day).alias("all"))
    return o.select("k", S.iso_json("id", "on", "all").alias("json"))


@query("select concat('o', o_orderkey) as record_id, case o_orderkey % 5 when 0 then 'published_on:required' else 'published_on:not_a_date' end as rule, 'error' as severity from orders where o_orderkey % 5 in (0, 1, 3)")
def date_issues(spark, sf):
    text = F.expr("case o_orderkey % 5 when 0 then '' when 1 then 'soon' when 2 then concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T10:00:00') when 3 then '2026-02-30' else date_format(o_orderdate, 'yyyy-MM-dd') end")
    rows = _table(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("k"), text.alias("published_on"))
    return validation.date_issues(rows, "k", {"published_on": True})[1]


@query("with s as (select concat('s', s_suppkey) as id, s_nationkey as n, s_suppkey as k from supplier) select id as record_id, 'duplicate_id' as rule, 'error' as severity from s where k % 9 = 0 union all select id, 'unknown_issuer', 'error' from s where n >= 20 union all select id, 'list_url_missing', 'error' from s where k % 4 = 0")
def registry_load(spark, sf):
    """Issuers and sources of a registry file per nation: a source may be given twice, name an unknown issuer, or lack its address."""
    s = _table(spark, sf, "supplier").withColumn("times", F.when(F.col("s_suppkey") % 9 == 0, 2).otherwise(1)).withColumn("t", F.explode(F.sequence(F.lit(1), "times")))
    one = F.struct(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("i"), F.col("s_nationkey").cast("string")).alias("issuer_code"), F.lit(True).alias("enabled"), F.lit("html_list").alias("fetcher"), F.when(F.col("s_suppkey") % 4 != 0, "http://x/").alias("list_url"))
    files = s.groupBy("s_nationkey").agg(F.collect_list(one).alias("sources"))
    issuers = F.when(F.col("s_nationkey") < 20, F.array(F.struct(F.concat(F.lit("i"), F.col("s_nationkey").cast("string")).alias("code")))).otherwise(F.array().cast("array<struct<code:string>>"))
    return validation.registry_tables(files.select(F.format_string("f%03d", "s_nationkey").alias("path"), issuers.alias("issuers"), "sources"))[2]


# ---- streams ---------------------------------------------------------------------------------
@query("select concat('u', user_id) as policy_id, event_type as kind, strftime(ts, '%Y-%m-%dT%H:%M:%S') as ts from events")
def stream_ledger(spark, sf):
    """Ledger lines landed in files, appended by a stream that is started twice: each line is there once."""
    folder = _folder(spark)
    lines = _table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("event_type").alias("kind"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("policy_id"))
    lines.repartition(5).write.json(f"{folder}/landed")
    for _ in range(2):
        feeds.append_ledger(spark, f"{folder}/landed", f"{folder}/ledger", f"{folder}/state").awaitTermination()
    return records.read_ledger(spark, f"{folder}/ledger").select("policy_id", "kind", "ts")


@query("with d as (select user_id % 40 as day, count(*) as n from events group by 1) select 'changes' as what, coalesce(sum(n) filter (day % 5 <> 0), 0)::bigint as n from d union all select 'unreadable', count(*) filter (day % 5 = 0) from d union all select 'known', count(distinct event_id % 1000) from events where user_id % 40 % 5 <> 0")
def stream_corrupt_days(spark, sf):
    """Change days as files, every fifth cut short: its changes aren't known, so they are discovered again, and the file is reported."""
    folder = _folder(spark)
    one = F.struct(F.lit("discovered").alias("change_type"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("policy_id"), F.concat(F.lit("http://e/"), (F.col("event_id") % 1000).cast("string")).alias("url"))
    days = _table(spark, sf, "events").groupBy((F.col("user_id") % 40).alias("day")).agg(F.collect_list(one).alias("changes"))
    text = F.to_json(F.struct(F.format_string("2026-01-%02d", "day").alias("detected_on"), "changes"))
    days.select(F.when(F.col("day") % 5 == 0, F.substring(text, 1, 40)).otherwise(text).alias("value"), "day").repartitionById(40, F.col("day").cast("int")).select("value").write.text(f"{folder}/landed")
    feeds.change_files(spark, f"{folder}/landed", f"{folder}/table", f"{folder}/problems", f"{folder}/state").awaitTermination()
    seen, bad = spark.read.parquet(f"{folder}/table"), spark.read.parquet(f"{folder}/problems")
    parts = [seen.agg(F.count(F.lit(1)).alias("n")), bad.agg(F.count(F.lit(1)).alias("n")), seen.agg(F.countDistinct("url").alias("n"))]
    named = [p.select(F.lit(w).alias("what"), "n") for w, p in zip(("changes", "unreadable", "known"), parts, strict=True)]
    return named[0].union(named[1]).union(named[2])


