"""The registered queries: each derives its frame, calls the library and, where SQL can say it, has an oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import catalog, cleaning, diffing, enforcement, evidence, promotion, validation
from ..sources import html, listing
from ..streaming import feeds
from ..tables import shared_folder
from . import frames as fr

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
P, OLD, RAW, REG, CHG, PEN, VER, EVI = (f(fr.Duck) for f in (fr.policy, lambda d: fr.policy(d, True), fr.raw_doc, fr.registry, fr.change, fr.penalty, fr.versions, fr.evidence))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def frame(name: str, *more):
    return lambda spark, sf: fr.load(spark, sf, getattr(fr, name)(fr.Spark, *more))


policy, old_policy, raw_doc, registry = frame("policy"), frame("policy", True), frame("raw_doc"), frame("registry")
change, penalty, versions, evidence_pages = frame("change"), frame("penalty"), frame("versions"), frame("evidence")

# ---- cleaning ----------------------------------------------------------------------------
MARKED = f"""with raw as ({RAW}), reg as ({REG}), dedup as (select * from (select *, row_number() over (partition by source_id, url order by seq) rn from raw) where rn = 1),
 marked as (select d.seq, d.source_id, d.title, d.url, d.published_on, case when d.published_on is null and len(list_filter(string_split(regexp_replace(d.url, '^[a-z]+://[^/]*', ''), '/'), lambda x: x <> '')) <= len(list_filter(string_split(regexp_replace(r.list_url, '^[a-z]+://[^/]*', ''), '/'), lambda x: x <> '')) and length(d.title) <= 12 then 'navigation'
 when contains(concat(d.title, chr(10), d.body), 'ñ') or contains(concat(d.title, chr(10), d.body), 'xt') then 'excluded' when contains(concat(d.title, chr(10), d.body), 'ción') or contains(concat(d.title, chr(10), d.body), 'th') then null else 'not_matched' end as drop_reason from dedup d join reg r on d.source_id = r.id) """


def marked(spark, sf):
    return cleaning.with_drop_reason(cleaning.dedupe_by_url(raw_doc(spark, sf)), registry(spark, sf))


@query(MARKED + "select source_id, count(*) as new_docs from marked where drop_reason is null and url not in (select url from raw where seq % 3 = 0) group by source_id")
def discover_new_docs(spark, sf):
    """Discovery end to end: dedupe, clean, compare with known urls, count by source."""
    known = raw_doc(spark, sf).filter("seq % 3 = 0").select("url")
    return cleaning.discovered(marked(spark, sf).filter("drop_reason is null"), known).groupBy("source_id").agg(F.count(F.lit(1)).alias("new_docs"))


@query(MARKED + ", c as (select source_id, count(*) found, count(*) filter (drop_reason = 'navigation') nav, count(*) filter (drop_reason = 'excluded') exc, count(*) filter (drop_reason = 'not_matched') nm, count(*) filter (drop_reason is null) kept from marked group by 1) select r.id as source_id, coalesce(found, 0) as found, coalesce(nav, 0) as dropped_navigation, coalesce(exc, 0) as dropped_excluded, coalesce(nm, 0) as dropped_not_matched, coalesce(kept, 0) as kept, case when not r.enabled then 'skipped' when coalesce(found, 0) = coalesce(nav, 0) then 'degraded' else 'ok' end as status from reg r left join c on r.id = c.source_id")
def cleaning_report(spark, sf):
    return cleaning.cleaning_report(registry(spark, sf), marked(spark, sf))


@query(MARKED + ", c as (select source_id, count(*) found, count(*) filter (drop_reason = 'navigation') nav, count(*) filter (drop_reason is null) kept from marked group by 1), s as (select r.id, coalesce(kept, 0) kept, case when not r.enabled then 'skipped' when coalesce(found, 0) = coalesce(nav, 0) then 'degraded' else 'ok' end as status from reg r left join c on r.id = c.source_id) select coalesce(string_agg(id, ',' order by id) filter (status = 'ok'), '') as ok_sources, coalesce(string_agg(id, ',' order by id) filter (status = 'degraded'), '') as failed_sources, coalesce(string_agg(id, ',' order by id) filter (status = 'skipped'), '') as skipped_sources, cast(sum(kept) as bigint) as total_docs from s")
def run_summary(spark, sf):
    return cleaning.run_summary(cleaning_report(spark, sf))


@query(MARKED + "select source_id, rank, seq, drop_reason, greatest(n - 40, 0) as more from (select *, cast(row_number() over (partition by source_id order by seq) as int) as rank, count(*) over (partition by source_id) as n from marked where drop_reason is not null) where rank <= 40")
def dropped_docs_topk(spark, sf):
    return cleaning.dropped_top(marked(spark, sf))


@query(f"with raw as ({RAW}) select source_id, avg(length(title)) as mean_title, avg(case when published_on is not null then 1 else 0 end) as dated_share, avg(length(title)) >= 8 and avg(case when published_on is not null then 1 else 0 end) >= 0.3 as passes from raw group by 1")
def quality_gate(spark, sf):
    return cleaning.quality_gate(raw_doc(spark, sf))


@query(f"with raw as ({RAW}) select seq, source_id from (select *, row_number() over (partition by source_id order by seq) rn from raw) where rn <= 20")
def detail_cap(spark, sf):
    return cleaning.capped_details(raw_doc(spark, sf), 20).select("seq", "source_id")


@query("with p as (select concat('s', user_id % 50) as source_id, cast(user_id // 50 + 1 as bigint) as page_no, count(*) % 21 as n_items from events group by user_id), q as (select *, min(case when (n_items = 0 and page_no > 1) or n_items < 5 then page_no end) over (partition by source_id) as stop from p) select source_id, page_no, n_items from q where page_no <= 8 and (stop is null or page_no <= stop)")
def page_stop_rule(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg((F.count(F.lit(1)) % 21).alias("n_items"))
    pages = e.select(F.concat(F.lit("s"), (F.col("user_id") % 50).cast("string")).alias("source_id"), (F.floor(F.col("user_id") / 50) + 1).alias("page_no"), "n_items")
    return cleaning.pages_to_keep(pages, 8, 5)


@query(f"with reg as ({REG}) select id as source_id, case when not enabled then 'skipped' when fetcher = 'manual' then 'skipped' when coalesce(list_url, '') = '' then 'failed' else 'fetch' end as plan from reg")
def source_plan(spark, sf):
    return cleaning.source_plan(registry(spark, sf))


# ---- scalars -----------------------------------------------------------------------------
@query("select doc_id, len(list_filter(string_split(concat('a/', source, '/', doc_id % 7, '/'), '/'), lambda x: x <> '')) as depth from documents")
def url_depth(spark, sf):
    url = F.concat(F.lit("http://h.example/a/"), "source", F.lit("/"), (F.col("doc_id") % 7).cast("string"), F.lit("/?q=/x/y#/z"))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", S.url_path_depth(url).alias("depth"))


@query("select event_id, try_cast(concat(2000 + event_id % 30, '-', lpad(cast(event_id % 12 + 1 as varchar), 2, '0'), '-', lpad(cast(event_id % 32 as varchar), 2, '0')) as date) as parsed from events")
def parse_dates(spark, sf):
    y, m, d = (f"cast({x} as string)" for x in ("2000 + event_id % 30", "event_id % 12 + 1", "event_id % 32"))
    text = F.expr(f"case event_id % 3 when 0 then concat('发布于 ', {y}, ' 年', {m}, '月 ', {d}, '日') when 1 then concat('x ', {y}, '-', {m}, '/', {d}, ' 10:00') else concat('[', substr({y}, 3), '.', {m}, '.', {d}, ']') end")
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", S.parse_date(text).alias("parsed"))


@query("select o_orderkey, concat('Rules ', o_orderkey) as title from orders")
def clean_titles(spark, sf):
    raw = F.expr("concat(' Rules \n\t', o_orderkey, case o_orderkey % 4 when 0 then '【最新】(附件)' when 1 then '（2020）附件3' when 2 then ' [附件]' else '　' end, ' ')")
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", S.clean_title(raw).alias("title"))


@query("select event_id, cast(ts + interval 8 hour as date) as d from events")
def epoch_dates(spark, sf):
    ms = F.expr("cast(case when event_id % 2 = 0 then unix_millis(cast(ts as timestamp)) else unix_seconds(cast(ts as timestamp)) end as string)")
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", S.epoch_date(ms).alias("d"))


@query("select o_orderkey, case when o_orderkey % 5 <> 0 then concat('http://x/?id=', o_orderkey, '&c=', o_custkey) end as url from orders")
def url_templates(spark, sf):
    item = F.expr("case when o_orderkey % 5 <> 0 then map('id', cast(o_orderkey as string), 'c', cast(o_custkey as string)) else map('id', cast(o_orderkey as string)) end")
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", S.render_template(F.lit("http://x/?id={id}&c={c}"), item).alias("url"))


@query(r"select doc_id, concat('sha256:', sha256(array_to_string(list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda x: regexp_replace(x, '^[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g')), lambda x: x <> ''), chr(10)))) as hash from documents")
def normalize_and_hash(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", S.content_hash(S.normalize_text(F.col("text"))).alias("hash"))


@query(r"select doc_id, md5(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) as squashed from documents")
def squash(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.md5(F.encode(S.squash(F.col("text")), "utf-8")).alias("squashed"))


@query("select p_partkey, cast(p_partkey % 99 + 1 as int) as number from part")
def chinese_numerals(spark, sf):
    """Numbers to Chinese numerals and back."""
    n = (F.col("p_partkey") % 99 + 1).cast("int")
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", S.chinese_to_int(S.int_to_chinese(n)).alias("number"))


# ---- diffing -----------------------------------------------------------------------------
DIFF = f"""with n as ({P}), o as ({OLD}), b as (select n.*, o.id as oid, o.status as ostatus, list_filter([case when n.content_hash <> o.content_hash then 'content_hash' end, case when n.effective_from is distinct from o.effective_from then 'effective_from' end, case when n.effective_until is distinct from o.effective_until then 'effective_until' end, case when n.superseded_by is distinct from o.superseded_by then 'superseded_by' end, case when n.n_obligations <> o.n_obligations then 'key_obligations' end, case when n.last_verified <> o.last_verified then 'last_verified' end], lambda x: x is not null) as ch from n left join o on n.id = o.id),
 changes as (select id as policy_id, 'new' as change_type, case when status in ('effective', 'partially_effective', 'amended') and ai_relevance = 'core' then 'high' else 'medium' end as significance, '' as fields, url from b where oid is null
 union all select id, 'status_changed', 'high', 'status', url from b where oid is not null and status <> ostatus
 union all select id, case when list_contains(ch, 'content_hash') then 'content_changed' else 'metadata_changed' end, case when list_contains(ch, 'content_hash') then 'high' else 'low' end, array_to_string(ch, ','), url from b where oid is not null and len(ch) > 0
 union all select id, 'metadata_changed', 'medium', 'last_verified', url from b where date_diff('day', last_verified, date '{fr.AS_OF}') > 180) """


def _diff(spark, sf):
    return diffing.snapshot_changes(old_policy(spark, sf), policy(spark, sf), fr.AS_OF)


@query(DIFF + "select * from changes")
def snapshot_diff(spark, sf):
    return _diff(spark, sf).withColumn("fields", F.array_join("fields", ","))


@query(DIFF + "select policy_id, change_type, cast(case significance when 'high' then 0 when 'medium' then 1 else 2 end as int) as rank from changes")
def diff_sorted(spark, sf):
    return diffing.ranked(_diff(spark, sf)).select("policy_id", "change_type", "rank")


@query(f"with p as ({P}) select id, date_diff('day', last_verified, date '{fr.AS_OF}') as days from p where date_diff('day', last_verified, date '{fr.AS_OF}') > 180")
def stale_records(spark, sf):
    return diffing.stale_records(policy(spark, sf), fr.AS_OF).select("id", "days")


HALVES = f"with c as ({CHG}), prev as (select * from c where event_id % 2 = 0), inc as (select * from c where event_id % 2 = 1), merged as (select *, false as kept from inc union all select p.*, true from prev p where not exists (select 1 from inc i where i.detected_on = p.detected_on and i.change_type = p.change_type and i.policy_id = p.policy_id and coalesce(i.url, '') = coalesce(p.url, ''))) "


def _halves(spark, sf):
    c = change(spark, sf)
    return c.filter("event_id % 2 = 0"), c.filter("event_id % 2 = 1")


@query(HALVES + "select event_id, kept from merged")
def change_merge(spark, sf):
    return diffing.merge_changes(*_halves(spark, sf)).select("event_id", "kept")


@query(HALVES + "select detected_on, count(*) as change_count, count(*) filter (significance = 'high') as high_significance_count, count(*) filter (kept) as merged_from_previous from merged group by 1")
def day_headers(spark, sf):
    return diffing.day_headers(diffing.merge_changes(*_halves(spark, sf)))


@query(HALVES + ", w as (select detected_on, change_type, policy_id, coalesce(url, '') u, count(*) n from prev group by all), i as (select detected_on, change_type, policy_id, coalesce(url, '') u, count(*) n from inc group by all), b as (select coalesce(w.detected_on, i.detected_on) d, coalesce(w.n, 0) w, coalesce(i.n, 0) i from w full join i on w.detected_on = i.detected_on and w.change_type = i.change_type and w.policy_id = i.policy_id and w.u = i.u) select d as detected_on, cast(sum(i) + sum(case when i = 0 then w else 0 end) as bigint) as total, cast(sum(i) - count(*) filter (w > 0 and i > 0) as bigint) as added, count(*) filter (w > 0 and i > 0) as replaced, cast(sum(case when i = 0 then w else 0 end) as bigint) as kept from b group by d")
def merge_outcome(spark, sf):
    return diffing.merge_outcome(*_halves(spark, sf))


@query(f"with c as ({CHG}) select change_type, count(*) as n from c group by 1")
def change_counts(spark, sf):
    return diffing.change_counts(change(spark, sf))


@query(f"with c as ({CHG}), p as ({P}) select url from p union select url from c where url is not null")
def known_urls(spark, sf):
    return cleaning.known_urls(policy(spark, sf), change(spark, sf))


@query(f"with c as ({CHG}) select count(distinct url) as pending from c where change_type = 'discovered' and url is not null and url not in (select url from c where policy_id like '%1' and url is not null)")
def pending_count(spark, sf):
    return diffing.pending_count(change(spark, sf), change(spark, sf).filter("policy_id like '%1' and url is not null"))


@query(f"with c as ({CHG}) select max(detected_on) as latest_day from c")
def latest_change_day(spark, sf):
    return diffing.latest_day(change(spark, sf))


# ---- validation --------------------------------------------------------------------------
VALID = "status in ('effective', 'partially_effective', 'amended')"
NOTED = "(" + " or ".join(f"contains(coalesce(verified_note, ''), '{w}')" for w in validation.BASIS) + ")"
POLICY_RULES = {
    "unsettled_with_date": ("error", "status in ('draft', 'consultation') and effective_from is not null"),
    "before_publication": ("error", "effective_from < published_on and not contains(coalesce(notes, ''), '追溯')"),
    "ends_before_start": ("error", "effective_until < effective_from"),
    "expired_without_end": ("error", "status = 'expired' and effective_until is null"),
    "unknown_without_note": ("error", "status = 'unknown' and coalesce(verified_note, '') = ''"),
    "superseded_without_successor": ("error", "status = 'superseded' and superseded_by is null"),
    "versions_not_continuous": ("error", "len(version_numbers) > 0 and list_sort(version_numbers) <> range(1, len(version_numbers) + 1)::int[]"),
    "effective_without_date": ("warning", "status in ('effective', 'partially_effective') and effective_from is null"),
    "valid_but_automated": ("warning", f"{VALID} and verified_by = 'automated'"),
    "not_primary": ("error", "tier <> 'primary'"),
    "date_unconfirmed": ("error", "effective_from is not null and verified_note in ('生效日期待确认', '未在公开摘录中明确写出施行日期')"),
    "date_without_basis": ("warning", f"verified_by = 'automated' and effective_from is not null and not {NOTED}"),
}
P_RULES = " union all ".join(f"select id as record_id, '{r}' as rule, '{s}' as severity from pv where {c}" for r, (s, c) in POLICY_RULES.items())
PV = f"with p as ({P}), v as ({VER}), n as (select id, list(version) as version_numbers from v group by id), pv as (select p.*, coalesce(n.version_numbers, []) as version_numbers from p left join n on p.id = n.id) "


def _with_versions(spark, sf):
    numbers = versions(spark, sf).groupBy("id").agg(F.collect_list("version").alias("version_numbers"))
    return policy(spark, sf).join(numbers, "id", "left").withColumn("version_numbers", F.coalesce("version_numbers", F.array().cast("array<int>")))


@query(PV + P_RULES)
def validate_policies(spark, sf):
    return validation.policy_issues(_with_versions(spark, sf))


@query(PV + f", i as ({P_RULES}) select severity, rule, count(*) as n from i group by all")
def issue_split(spark, sf):
    errors, warnings = validation.split(validate_policies(spark, sf))
    return errors.union(warnings).groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("n"))


PENALTY_RULES = {
    "violation_blank": ("error", "violation_type = ''"),
    "automated_without_basis": ("warning", "verified_by = 'automated' and coalesce(notes, '') <> '抄自原文'"),
    "technical_without_domain": ("warning", "(contains(violation_type, '数据') or contains(violation_type, '信息')) and len(domain) = 0"),
    "legal_basis_without_source": ("warning", "legal_basis is not null"),
}


@query(f"with e as ({PEN}) " + " union all ".join(f"select id as record_id, '{r}' as rule, '{s}' as severity from e where {c}" for r, (s, c) in PENALTY_RULES.items()))
def validate_penalties(spark, sf):
    return validation.penalty_issues(penalty(spark, sf))


@query(f"with p as ({P}) select id as record_id, concat(c, ':required') as rule, 'error' as severity from p, (select unnest(['jurisdiction', 'instrument_type', 'bindingness', 'source']) as c) union all select id, 'issuer_code:pattern', 'error' from p where false union all select id, 'superseded_by:pattern', 'error' from p where false union all select id, 'id:min_length', 'error' from p where length(id) < 6")
def shape_issues(spark, sf):
    return validation.shape_issues(policy(spark, sf), validation.POLICY_SHAPE)


@query("select concat('s', o_custkey) as record_id, 'duplicate_id' as rule, 'error' as severity, count(*) - 1 as extra_rows from orders group by o_custkey having count(*) > 1")
def duplicate_ids(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("id"), F.col("o_orderkey").alias("path"))
    return validation.duplicates(rows)[1]


@query("select concat('s', o_custkey) as id, min(o_orderkey) as path from orders group by 1")
def first_records(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("id"), F.col("o_orderkey").alias("path"))
    return validation.duplicates(rows)[0]


EDGES = f"with p as ({P}), e as (select id, 'superseded_by' as kind, superseded_by as target from p where superseded_by is not null union all select id, 'supersedes', unnest(supersedes) from p union all select id, 'amends', unnest(amends) from p union all select id, 'amended_by', unnest(amended_by) from p) "


@query(EDGES + "select * from e where target not in (select id from p)")
def dangling_refs(spark, sf):
    return validation.dangling(policy(spark, sf))


@query(EDGES + "select id, target from e where kind = 'superseded_by' and target in (select id from p) and not exists (select 1 from e b where b.kind = 'supersedes' and b.id = e.target and b.target = e.id)")
def unclosed_links(spark, sf):
    return validation.unclosed(policy(spark, sf))


@query(EDGES + "select id, kind from e where kind in ('superseded_by', 'supersedes') and id = target")
def self_refs(spark, sf):
    return validation.self_references(policy(spark, sf))


@query(EDGES + "select e.id, e.kind, e.target, p.title as target_title from e left join p on p.id = e.target")
def relation_edges(spark, sf):
    p = policy(spark, sf)
    return catalog.relations(p, validation.edges(p))


@query(f"with p as ({P}), r as ({PEN}), x as (select id, unnest(related_policies) as target from r) select id, target from x where target not in (select id from p where id not like '%0')")
def penalty_refs(spark, sf):
    return validation.penalty_references(penalty(spark, sf), policy(spark, sf).filter("id not like '%0'"))


@query(f"with reg as ({REG}) select id, issuer_code from reg where issuer_code not in (select distinct concat('iss', o_custkey % 14) from orders)")
def issuer_refs(spark, sf):
    issuers = spark.read.parquet(f"{sf}/orders.parquet").select(F.concat(F.lit("iss"), (F.col("o_custkey") % 14).cast("string")).alias("code"))
    return validation.issuer_references(registry(spark, sf), issuers)


@query(f"with reg as ({REG}) select id as record_id, 'list_url_missing' as rule, 'error' as severity from reg where enabled and fetcher <> 'manual' and coalesce(list_url, '') = ''")
def registry_issues(spark, sf):
    return validation.registry_issues(registry(spark, sf))


@query(f"with reg as ({REG}) select count(*) filter (enabled and fetcher <> 'manual') as automatic, count(*) filter (fetcher = 'manual') as manual, count(*) filter (not enabled and fetcher <> 'manual') as not_enabled from reg")
def registry_summary(spark, sf):
    return validation.registry_summary(registry(spark, sf))


@query(PV + f", i as ({P_RULES}) select severity, count(*) as n from i group by 1")
def repository_errors(spark, sf):
    return validation.policy_issues(_with_versions(spark, sf)).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


REPORT = f"""select record_id, rule, severity from ({ORACLE_SQL["validate_policies"]}) union all select record_id, rule, severity from ({ORACLE_SQL["validate_penalties"]})
 union all select id, 'dangling_reference', 'error' from ({ORACLE_SQL["dangling_refs"]}) union all select id, 'unclosed_reference', 'error' from ({ORACLE_SQL["unclosed_links"]})
 union all select id, 'self_reference', 'error' from ({ORACLE_SQL["self_refs"]}) union all select id, 'penalty_reference', 'error' from (with p as ({P}), x as (select id, unnest(related_policies) as target from ({PEN})) select id from x where target not in (select id from p)) union all select id, 'stale', 'stale' from ({ORACLE_SQL["stale_records"]})"""


@query(f"select severity, rule, count(*) as n from ({REPORT}) group by all")
def repository_report(spark, sf):
    report = validation.repository_report(_with_versions(spark, sf), penalty(spark, sf), fr.AS_OF)
    return report.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


# ---- catalog -----------------------------------------------------------------------------
@query(f"with p as ({P}) select id, title, issuer, status, effective_from, ai_relevance, array_to_string(topics, ',') as topics, url from p where {VALID} and issuer_code = 'iss3' and list_has_any(topics, ['ethics-review', 'model-risk'])")
def catalog_list(spark, sf):
    out = catalog.listing(policy(spark, sf), effective_only=True, issuer_code="iss3", topics=["ethics-review", "model-risk"])
    return out.select("id", "title", "issuer", "status", "effective_from", "ai_relevance", F.array_join("topics", ",").alias("topics"), "url")


@query(f"with p as ({P}), b as (select *, lower(concat_ws(' ', title, issuer, issuer_code, array_to_string(summaries, ' '), array_to_string(topics, ' '), array_to_string(domain, ' '))) as blob from p) select id from b where contains(blob, 'urgent') and contains(blob, 'disclosure') and contains(blob, '3') and status = 'effective'")
def catalog_search(spark, sf):
    """A search by postings, one of its words being a single letter."""
    folder = shared_folder(spark, "search")
    catalog.write_postings(policy(spark, sf), folder)
    return catalog.search_postings(policy(spark, sf), folder, " Urgent  DISCLOSURE 3 ", status="effective").select("id")


@query(f"with p as ({P}) select count(*) as total, count(*) filter ({VALID}) as currently_valid, count(distinct issuer_code) as issuers, count(*) filter (status = 'unknown') as unknown_status from p")
def catalog_stats(spark, sf):
    return catalog.stats(policy(spark, sf))


def _labelled(column: str, labels: dict[str, str]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in labels.items()) + f" else {column} end"


@query(f"with p as ({P}) select 'issuer' as facet, issuer_code as value, issuer as name from (select *, row_number() over (partition by issuer_code order by published_on desc, id desc) rn from p where issuer_code is not null) where rn = 1 union all select distinct 'status', status, {_labelled('status', catalog.STATUS_LABELS)} from p union all select distinct 'relevance', ai_relevance, {_labelled('ai_relevance', catalog.RELEVANCE_LABELS)} from p")
def facets(spark, sf):
    return catalog.facets(policy(spark, sf))


@query(f"with p as ({P}) select id, case when effective_from is not null then strftime(effective_from, '%Y-%m-%d') when {VALID} then 'to be verified' else 'not in force' end as date_state from p")
def tri_state_dates(spark, sf):
    p = policy(spark, sf)
    return p.select("id", catalog.date_state(p).alias("date_state"))


@query(f"with p as ({P}) select id, {_labelled('status', catalog.STATUS_LABELS)} as status_label, {_labelled('status', catalog.STATUS_TONES)} as tone, {VALID} as is_currently_valid, concat('policies/', id, '.html') as page from p")
def site_view(spark, sf):
    return catalog.site_view(policy(spark, sf)).select("id", "derived.*")


def _version_lists(spark, sf):
    return versions(spark, sf).groupBy("id").agg(F.collect_list(F.struct("version", "status", "effective_from", "effective_until")).alias("versions"))


@query(f"with v as ({VER}), g as (select id, max(version) as latest_version, count(*) as n from v group by id) select id, latest_version, cast(n as int) as n_versions from g")
def latest_versions(spark, sf):
    return catalog.latest_version(_version_lists(spark, sf))


@query(f"with v as ({VER}) select id, version, concat(strftime(effective_from, '%Y-%m-%d'), ' – ', coalesce(strftime(effective_until, '%Y-%m-%d'), '')) as span, cast(row_number() over (partition by id order by version, effective_from, coalesce(effective_until, date '9999-12-31'), status) - 1 as int) as place from v")
def timeline(spark, sf):
    return catalog.timeline(_version_lists(spark, sf)).select("id", "version", "span", "place")


@query(f"with v as ({VER}), d as (select id, version, max(status) as status, min(effective_from) as effective_from, count(*) c, max(effective_until) as effective_until from v group by id, version), a as (select * from d where effective_from <= date '{fr.AS_OF}' and (effective_until is null or effective_until > date '{fr.AS_OF}')) select id, version from (select *, row_number() over (partition by id order by version desc) rn from a) where rn = 1")
def version_as_of(spark, sf):
    # lines of an order may share a number: they count as one version
    one = versions(spark, sf).groupBy("id", "version").agg(F.max("status").alias("status"), F.min("effective_from").alias("effective_from"), F.max("effective_until").alias("effective_until"))
    lists = one.groupBy("id").agg(F.collect_list(F.struct("version", "status", "effective_from", "effective_until")).alias("versions"))
    return catalog.version_as_of(lists, fr.AS_OF).select("id", "version")


# ---- penalties ---------------------------------------------------------------------------
CELLS = """array(array('公示表'), array('序号', '当事人\n名称', '行政处罚决定书　文号', '备注', '违法行为类型', '行政处罚内容', '作出行政处罚 决定机关名称'))"""


def _penalty_pages(spark, sf):
    """A page per decision: a caption row, a header row with broken texts, and a row per penalty."""
    row = F.struct("party", "kind", F.array(F.lit("1"), F.col("party"), F.col("decision_no"), F.lit("x"), F.concat(F.lit(" "), F.col("violation_type")), "penalty_content", "authority").alias("r"))
    e = penalty(spark, sf).groupBy("decision_no").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return e.select(F.concat(F.lit("http://d.example/"), "decision_no").alias("url"), F.lit("s1").alias("source_id"), F.lit(None).cast("date").alias("published_on"), F.concat(F.expr(CELLS), F.transform("rows", lambda x: x["r"])).alias("cells"))


ROWS = f"with e as ({PEN}) "


@query(ROWS + "select concat('http://d.example/', decision_no) as document_url, party, decision_no, violation_type, penalty_content, authority, '' as publicity_period, concat('http://d.example/', decision_no, '#', decision_no) as url, case when violation_type = '' then party else concat(party, '｜', violation_type) end as title from e")
def penalty_rows(spark, sf):
    return enforcement.penalty_rows(_penalty_pages(spark, sf)).select("document_url", "party", "decision_no", "violation_type", "penalty_content", "authority", "publicity_period", "url", "title")


@query(ROWS + "select concat('http://d.example/', decision_no) as document_url, count(distinct party) as parties, count(distinct decision_no) as decisions, count(*) as penalty_rows from e group by 1")
def penalty_by_document(spark, sf):
    return enforcement.by_document(enforcement.penalty_rows(_penalty_pages(spark, sf)))


@query(ROWS + "select 's1' as source_id, count(distinct decision_no) as opened, cast(0 as bigint) as empty, 'ok' as outcome from e having count(*) > 0")
def detail_outcome(spark, sf):
    pages = _penalty_pages(spark, sf)
    return enforcement.detail_outcome(pages, enforcement.penalty_rows(pages))


@query(ROWS + "select domain_name, authority, violation_type, count(*) as penalties from (select unnest(case when len(domain) = 0 then [null] else domain end) as domain_name, authority, violation_type from e) group by all")
def penalties_by_domain(spark, sf):
    return enforcement.by_domain(penalty(spark, sf))


@query(f"with p as ({P}), e as ({PEN}), r as (select distinct id, unnest(related_policies) as policy_id from e), c as (select policy_id, count(*) as n from r group by 1) select p.id, coalesce(c.n, 0) as penalties from p left join c on p.id = c.policy_id union all select null, count(*) from e where len(related_policies) = 0")
def coverage(spark, sf):
    return enforcement.coverage(penalty(spark, sf), policy(spark, sf))


# ---- evidence ----------------------------------------------------------------------------
FULL = "contains(regexp_replace(body_text, '[^\\p{L}\\p{N}]', '', 'g'), title)"


@query(f"with r as ({EVI}) select policy_id, case when status_code is null then 'error' when status_code <> 200 then 'error' when final_url = 'http://r.example/' then 'error' when content_hash is not null and usable then 'warning' else 'ok' end as status from r")
def check_reachability(spark, sf):
    return evidence.reachability(evidence_pages(spark, sf)).select("policy_id", "status")


@query(f"with r as ({EVI}) select policy_id, case when not usable then 'manual' when effective_from is not null and k % 5 = 0 and not {FULL} then 'manual' when effective_from is not null and k % 5 = 0 then 'error' when effective_from is not null and k % 11 = 0 then 'warning' when effective_from is not null then 'ok' when k % 5 <> 0 then 'warning' when not {FULL} then 'manual' else 'ok' end as status from r")
def check_dates(spark, sf):
    return evidence.dates(evidence_pages(spark, sf)).select("policy_id", "status")


@query(f"with r as ({EVI}) select policy_id, case when k % 5 = 0 then '' else strftime(make_date(cast(2020 + k % 6 as int), cast(k % 12 + 1 as int), cast(k % 28 + 1 as int)), '%Y-%m-%d') end as candidates from r")
def date_candidates(spark, sf):
    return evidence_pages(spark, sf).select("policy_id", F.array_join(F.transform(S.effective_dates(F.col("body_text")), lambda d: d.cast("string")), ",").alias("candidates"))


@query(f"with r as ({EVI}) select policy_id, case when k % 5 = 0 then '' else concat('本办法自', 2020 + k % 6, '年', k % 12 + 1, '月', k % 28 + 1, '日起施行') end as quotes from r")
def status_sentences(spark, sf):
    return evidence_pages(spark, sf).select("policy_id", F.array_join(S.status_sentences(F.col("body_text")), "|").alias("quotes"))


@query(f"with p as ({P}) select id, verified_note as sentence from p where verified_note in ('生效日期待确认', '未在公开摘录中明确写出施行日期')")
def note_contradictions(spark, sf):
    return policy(spark, sf).select("id", S.unconfirmed_sentence(F.col("verified_note")).alias("sentence")).filter("sentence is not null")


# page titles of the frame differ from the record's in one number at most: too far apart for similar titles
TITLES_SQL = f"select policy_id, case when page_title is null then 'manual' when contains(replace(page_title, '_', ''), title) or contains(title, split_part(page_title, '_', 1)) then 'ok' when contains(regexp_replace(body_text, '[^\\p{{L}}\\p{{N}}]', '', 'g'), title) then 'ok' else 'manual' end as status from r"


@query(f"with r as ({EVI}) {TITLES_SQL}")
def check_titles(spark, sf):
    return evidence.titles(evidence_pages(spark, sf)).select("policy_id", "status")


def _records(spark, sf):
    """Records with two obligations: one clause that the page has, one that it hasn't."""
    o = "array(named_struct('clause', concat('第', k % 20 + 1, '条'), 'summary', '金融机构应当建立管理制度', 'obligation_type', case when k % 9 = 0 then 'encouraged' else 'mandatory' end), named_struct('clause', '第99条', 'summary', '无', 'obligation_type', 'mandatory'))"
    return evidence_pages(spark, sf).withColumn("key_obligations", F.expr(f"case when k % 37 = 0 then array() else {o} end"))


OBLIGATIONS_SQL = f"""select policy_id, 'obligations' as check_id, 'ok' as status, 'no obligations' as summary from r where k % 37 = 0
 union all select policy_id, 'obligation:0', case when not usable then 'manual' when k % 9 = 0 then 'error' else 'ok' end, case when not usable then 'no usable text' when k % 9 = 0 then 'modal words and type differ' else 'clause found' end from r where k % 37 <> 0
 union all select policy_id, 'obligation:1', case when not usable or not {FULL} then 'manual' else 'error' end, case when not usable then 'no usable text' else 'clause not found' end from r where k % 37 <> 0"""


@query(f"with r as ({EVI}) {OBLIGATIONS_SQL}")
def check_obligations(spark, sf):
    return evidence.obligations(_records(spark, sf)).select("policy_id", "check_id", "status", "summary")


ALL_CHECKS = f"""with r as ({EVI}), t as ({TITLES_SQL}), o as ({OBLIGATIONS_SQL}), c as (select policy_id, status from t union all select policy_id, status from o union all select policy_id, status from ({ORACLE_SQL['check_reachability']}) union all select policy_id, status from ({ORACLE_SQL['check_dates']}))"""


@query(ALL_CHECKS + " select policy_id, count(*) filter (status = 'ok') as n_ok, count(*) filter (status = 'warning') as n_warning, count(*) filter (status = 'error') as n_error, count(*) filter (status = 'manual') as n_manual, bool_and(status = 'ok') as all_green from c group by 1")
def evidence_counts(spark, sf):
    return evidence.counts(evidence.checks(_records(spark, sf)))


@query(ALL_CHECKS + " select policy_id, cast(count(*) as int) as n_checks, count(*) filter (status <> 'ok') as pending_count from c group by 1")
def evidence_cards(spark, sf):
    return evidence.cards(evidence.checks(_records(spark, sf))).select("policy_id", F.size("checks").alias("n_checks"), "pending_count")


# ---- promotion ---------------------------------------------------------------------------
LEDGER = "select concat('part-', user_id % 500) as policy_id, case event_id % 4 when 0 then 'date' when 1 then 'reachability' when 2 then 'title' else 'other' end as check_id, case event_type when 'view' then 'keep-date' when 'click' then 'confirm' else 'clear-date' end as option_key, event_type, event_id from events"


def _decisions(spark, sf):
    e = fr.load(spark, sf, LEDGER.replace("from events", "from {events}"))
    return e.filter("event_type in ('view', 'click', 'purchase')").select("policy_id", "check_id", "option_key", F.format_string("%012d", "event_id").alias("ts"))


@query(f"with l as ({LEDGER}), d as (select * from l where event_type in ('view', 'click', 'purchase')) select policy_id, check_id, max_by(option_key, event_id) as option_key from d group by 1, 2")
def last_decisions(spark, sf):
    return promotion.last_decisions(_decisions(spark, sf)).drop("ts")


REACH_AND_DATES = f"select policy_id, 'reachability' as check_id, status from ({ORACLE_SQL['check_reachability']}) union all select policy_id, 'date', status from ({ORACLE_SQL['check_dates']})"


def _two_layers(spark, sf):
    r = evidence_pages(spark, sf)
    return evidence.reachability(r).unionByName(evidence.dates(r))


@query(f"with c as ({REACH_AND_DATES}), l as ({LEDGER}) select policy_id, check_id, status from c where status <> 'ok' and not exists (select 1 from l where l.policy_id = c.policy_id and l.check_id = c.check_id and l.event_type in ('view', 'click', 'purchase'))")
def blocked_reasons(spark, sf):
    return promotion.blocked(_two_layers(spark, sf), _decisions(spark, sf))


LAST = f"(select policy_id, check_id, max_by(option_key, event_id) as option_key, max(event_id) as event_id from ({LEDGER}) where event_type in ('view', 'click', 'purchase') group by 1, 2)"
TAKEN = f"select d.*, c.status, coalesce((d.check_id = 'reachability' and c.status <> 'ok' and option_key = 'confirm') or (d.check_id = 'date' and ((c.status = 'error' and option_key in ('clear-date', 'keep-date')) or (c.status = 'warning' and option_key = 'keep-date'))), false) as accepted from {LAST} d left join ({REACH_AND_DATES}) c on d.policy_id = c.policy_id and d.check_id = c.check_id"


@query(f"select policy_id, check_id, option_key, accepted from ({TAKEN})")
def valid_decisions(spark, sf):
    good, bad = promotion.valid_decisions(promotion.last_decisions(_decisions(spark, sf)), _two_layers(spark, sf))
    return good.select("policy_id", "check_id", "option_key", F.lit(True).alias("accepted")).union(bad.select("policy_id", "check_id", "option_key", F.lit(False)))


REACH_SUMMARY = "case when status_code is null then 'not reachable' when status_code <> 200 then concat('HTTP ', status_code) when final_url = 'http://r.example/' then 'redirected to the home page' when content_hash is not null and usable then 'the text differs from the recorded hash' else 'reachable' end"
DATE_SUMMARY = f"case when not usable then 'no usable text' when effective_from is not null and k % 5 = 0 and not {FULL} then 'the page isn''t the document' when effective_from is not null and k % 5 = 0 then 'the text has no word about coming into force' when effective_from is not null and k % 11 = 0 then 'the text has other dates' when effective_from is not null then 'the text has the date' when k % 5 <> 0 then 'can be filled' when not {FULL} then 'the page isn''t the document' else 'neither the record nor the text has a date' end"
QUOTE = "case when k % 5 <> 0 then concat('本办法自', 2020 + k % 6, '年', k % 12 + 1, '月', k % 28 + 1, '日起施行') end"
#: Two layers of checks with their summaries, decisions that count, and what the note of each record says.
NOTES = f"""with r as ({EVI}), c as (select c.policy_id, c.check_id, c.status, case c.check_id when 'date' then 2 else 0 end as pos, case c.check_id when 'date' then {DATE_SUMMARY} else {REACH_SUMMARY} end as summary, case c.check_id when 'date' then {QUOTE} end as quote from ({REACH_AND_DATES}) c join r on c.policy_id = r.policy_id),
 t as (select * from ({TAKEN}) where accepted), d as (select policy_id, string_agg(option_key, '；' order by event_id, check_id) as labels, bool_or(option_key = 'clear-date') as cleared from t group by 1),
 o as (select policy_id, count(*) filter (status <> 'ok') as n_open, string_agg(concat('[', check_id, '] ', summary, case when quote is null then '' else concat('｜evidence: ', quote) end), '；' order by pos) filter (status <> 'ok') as excerpts, string_agg(concat('[', check_id, case when status = 'ok' then '' else concat('/', status) end, '] ', summary), '；' order by pos) filter (status <> 'ok') as open_list, string_agg(concat('[', check_id, '] ', summary), '；' order by pos) as all_list from c group by 1),
 n as (select r.*, coalesce(cleared, false) as cleared, coalesce(n_open, 0) as n_open, labels, open_list, all_list, concat('2026-01-02 verified by hand and promoted. Decisions: ', coalesce(labels, 'none needed, all checks are ok'), '. Changes: ', case when cleared then 'effective_from cleared' else 'none' end, '.', case when n_open > 0 then concat(' Evidence: ', excerpts) else '' end) as note from r left join d on r.policy_id = d.policy_id left join o on r.policy_id = o.policy_id)"""


@query(NOTES + " select policy_id as id, case when cleared then null else effective_from end as effective_from, cast(case when k % 37 = 0 then 0 else 2 end as int) as n_obligations, 'human' as verified_by, note as verified_note from n")
def apply_decisions(spark, sf):
    good, _ = promotion.valid_decisions(promotion.last_decisions(_decisions(spark, sf)), _two_layers(spark, sf))
    return promotion.apply_decisions(_draft_records(spark, sf), good, "2026-01-02", checks=_two_layers(spark, sf)).select("id", "effective_from", F.size("key_obligations").alias("n_obligations"), "verified_by", "verified_note")


def _draft_records(spark, sf):
    return _records(spark, sf).select(F.col("policy_id").alias("id"), "effective_from", "key_obligations", F.lit("automated").alias("verified_by"), F.lit(None).cast("date").alias("last_verified"), F.lit("").alias("verified_note"))


@query(f"with i as ({ORACLE_SQL['validate_policies']}), p as ({P}) select p.id, coalesce(e.n, 0) as errors, case when e.n > 0 then 'rolled_back' else 'promoted' end as outcome from p left join (select record_id, count(*) as n from i where severity = 'error' group by 1) e on p.id = e.record_id")
def promote_batch(spark, sf):
    return promotion.promote(policy(spark, sf), validate_policies(spark, sf))


@query(f"select outcome, count(*) as n from ({ORACLE_SQL['promote_batch']}) group by 1")
def promotion_outcome(spark, sf):
    return promotion.batch_outcome(promote_batch(spark, sf))


@query(f"with c as ({REACH_AND_DATES}), l as (select concat('part-', user_id % 500) as policy_id, case event_type when 'purchase' then 'promote' when 'signup' then 'rollback' when 'error' then 'reject' end as kind, event_id from events where event_type in ('purchase', 'signup', 'error')), e as (select policy_id, max_by(kind, event_id) as kind from l group by 1) select c.policy_id, count(*) filter (status = 'error') as errors, count(*) filter (status = 'warning') as warnings, count(*) filter (status = 'manual') as manuals, coalesce(any_value(e.kind) = 'promote', false) as done, coalesce(any_value(e.kind) = 'reject', false) as rejected from c left join e on c.policy_id = e.policy_id group by 1")
def review_queue(spark, sf):
    l = spark.read.parquet(f"{sf}/events.parquet").filter("event_type in ('purchase', 'signup', 'error')")
    kind = F.expr("case event_type when 'purchase' then 'promote' when 'signup' then 'rollback' else 'reject' end")
    return promotion.review_queue(_two_layers(spark, sf), l.select(F.concat(F.lit("part-"), (F.col("user_id") % 500).cast("string")).alias("policy_id"), kind.alias("kind"), F.format_string("%012d", "event_id").alias("ts")))


# ---- captured pages and listings -----------------------------------------------------------
@query("select o_orderkey as at, concat('Listing no ', o_orderkey) as title, concat('http://l.example/d?id=', o_orderkey) as url, cast(to_timestamp(1600000000 + o_orderkey * 86400) at time zone 'UTC' + interval 8 hour as date) as published_on from orders where o_orderkey % 3 <> 0 union all select o_orderkey, concat('Listing no ', o_orderkey), concat('http://l.example/p/', o_orderkey), make_date(2026, cast(o_orderkey % 12 + 1 as int), 5) from orders where o_orderkey % 3 = 0")
def json_listing_items(spark, sf):
    """Listings of two sources: one with urls and texts for dates, one with a template and epochs."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    payload = F.expr("case when o_orderkey % 3 = 0 then to_json(named_struct('data', named_struct('rows', array(named_struct('docTitle', concat('Listing no ', o_orderkey, '【新】'), 'url', concat('/p/', o_orderkey), 'publishDate', concat('2026-', o_orderkey % 12 + 1, '-5 10:00')))))) else to_json(named_struct('results', array(named_struct('docTitle', concat(' Listing\n no ', o_orderkey), 'docId', o_orderkey, 'publishDate', (1600000000 + o_orderkey * 86400) * 1000), named_struct('docTitle', 'abc', 'docId', 1L, 'publishDate', 1L)))) end")
    pages = o.select("o_orderkey", F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("source_id"), payload.alias("payload"), F.lit("http://l.example/d?id={docId}").alias("url_template"), F.lit("http://l.example/list/index.html").alias("list_url"), F.expr("map('title', 'docTitle', 'date', 'publishDate')").alias("field_map"))
    return listing.listing_docs(pages).select(F.substring("source_id", 2, 20).cast("bigint").alias("at"), "title", "url", "published_on")


@query("select page_id, trim(replace(replace(replace(regexp_extract(html, '<title>([^<]*)', 1), '&amp;', '&'), '&quot;', '\"'), '  ', ' ')) as title from pages")
def page_titles(spark, sf):
    return html.page_contents(spark.read.parquet(f"{sf}/pages.parquet")).select("page_id", F.col("page_title").alias("title"))


@query("select url, len(regexp_extract_all(html, '<li><a href')) as links from pages")
def page_links(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return html.linked(pages).select("url", F.when(F.col("html").isNotNull(), F.size("links").cast("bigint")).alias("links"))


# references that the pages hold, the ampersand last so that each is read once
REFERENCES = (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&"), ("&amp", "&"))


def _unescaped(text: str) -> str:
    for name, sign in REFERENCES:
        text = f"replace({text}, '{name}', '{sign}')"
    return text


BLOCK = "(?i)</?(" + "|".join(sorted(html.BLOCKS)) + r")(\s[^>]*)?/?>"
VISIBLE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style)\b.*?</(script|style)>', '', 'g'), '(?is)<title>.*?</title>', chr(10), 'g'), '" + BLOCK + "', chr(10), 'g')"
LINES = f"list_filter(list_transform(string_split({_unescaped(f"regexp_replace({VISIBLE}, '<[^>]*>', '', 'g')")}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@query(f"select page_id, cast(length(array_to_string({LINES}, chr(10))) as int) as length, length(array_to_string({LINES}, chr(10))) >= 200 as usable from pages")
def page_texts(spark, sf):
    return html.page_contents(spark.read.parquet(f"{sf}/pages.parquet")).select("page_id", F.length("body_text").alias("length"), "usable")


@query(f"""with i as (select url as list_url, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">[^<]*</a>', 1)) as href, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1)) as title, unnest(range(len(regexp_extract_all(html, '<li><a href')))) as place from pages)
 select list_url, cast(place as int) as at, trim({_unescaped('title')}) as title, concat(regexp_extract(list_url, '^https?://[^/]*'), {_unescaped('href')}) as url, cast(null as date) as published_on from i where length(trim({_unescaped('title')})) >= 4""")
def html_list_docs(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumns({"source_id": F.lit("s1"), "selectors": F.create_map(F.lit("item"), F.lit("li"))})
    return html.list_docs(pages).select("list_url", "at", "title", "url", "published_on")


# ---- streams -----------------------------------------------------------------------------
def _folder(spark) -> str:
    return shared_folder(spark, "stream")


@query(f"with raw as ({RAW}) select url, min(seq) as seq from raw group by 1")
def stream_first_seen(spark, sf):
    """Documents landed in seven files, read as a stream until all are seen."""
    folder, docs = _folder(spark), raw_doc(spark, sf)
    docs.repartitionByRange(7, "seq").write.parquet(f"{folder}/landed")
    feeds.first_seen(spark, f"{folder}/landed", docs.schema, f"{folder}/table", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/table").groupBy("url").agg(F.min("seq").alias("seq"))


@query(f"with c as ({CHG}) select detected_on, change_type, policy_id, coalesce(url, '') as url, max(event_id) as event_id from c group by 1, 2, 3, 4")
def stream_change_upsert(spark, sf):
    """Changes landed twice over: the state is what the last landing of each key says."""
    folder, c = _folder(spark), change(spark, sf)
    c.repartition(3).write.parquet(f"{folder}/landed")
    feeds.upsert_changes(spark, f"{folder}/landed", c.schema, f"{folder}/table", f"{folder}/work").awaitTermination()
    return spark.read.parquet(f"{folder}/table").select("detected_on", "change_type", "policy_id", F.coalesce("url", F.lit("")).alias("url"), "event_id")
