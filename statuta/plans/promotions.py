"""Queries on promotion: notes, ledger rows, rejections, cards with attachments, headers, coverage of obligations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, diffing, enforcement, evidence, promotion, validation
from ..sources import records
from ..tables import shared_folder
from . import frames as fr
from .further import STATES, _attachments, _checks, CHECKS
from .queries import HALVES, NOTES, ORACLE_SQL, P, TAKEN, _draft_records, _halves, _records, _table, _two_layers, _decisions, policy, query


def _good(spark, sf):
    return promotion.valid_decisions(promotion.last_decisions(_decisions(spark, sf)), _two_layers(spark, sf))[0]


@query(NOTES + " select policy_id as id, 'automated' as verified_by, concat('2026-01-02 ', case when n_open = 0 then 'all checks are ok' else concat(n_open, ' checks are not ok') end, ', promoted automatically, not verified by hand. Evidence: ', case when n_open = 0 then all_list else open_list end) as verified_note from n")
def automatic_notes(spark, sf):
    """Records promoted without decisions: they stay automated, and say what the checks found."""
    none = _good(spark, sf).filter("false")
    return promotion.apply_decisions(_draft_records(spark, sf), none, "2026-01-02", "auto", _two_layers(spark, sf)).select("id", "verified_by", "verified_note")


TYPED = "select p_partkey as k, concat('t', p_partkey) as id from part"


@query(f"""with r as ({TYPED}) select id, case when k % 4 = 0 then '' else concat(case when k % 4 = 1 then 'effective_from → 2020-05-06；' else '' end, case when k % 3 = 0 then 'obligation c1: type → encouraged；' else '' end, case when k % 5 = 0 then 'obligation c2 dropped；' else '' end, case when k % 2 = 0 then 'obligation c0 dropped；' else '' end) end as changes,
 case when k % 4 = 0 then 'c0:mandatory,c1:mandatory,c2:mandatory' else concat_ws(',', case when k % 2 = 0 then null else 'c0:mandatory' end, concat('c1:', case when k % 3 = 0 then 'encouraged' else 'mandatory' end), case when k % 5 = 0 then null else 'c2:mandatory' end) end as obligations,
 case when k % 4 = 1 then date '2020-05-06' else date '2019-01-01' end as effective_from from r""")
def decided_obligations(spark, sf):
    """Dates set, types set, obligations dropped, and indexes that no obligation has, with the changes in words."""
    k = F.col("p_partkey")
    one = lambda i: F.struct(F.lit(f"c{i}").alias("clause"), F.lit("s").alias("summary"), F.lit("mandatory").alias("obligation_type"))
    r = _table(spark, sf, "part").select(k.alias("k"), F.concat(F.lit("t"), k.cast("string")).alias("id"), F.lit("2019-01-01").cast("date").alias("effective_from"), F.array(one(0), one(1), one(2)).alias("key_obligations"))
    choice = lambda cond, ts, check, o: F.when(cond, F.struct(F.lit(ts).alias("ts"), F.lit(check).alias("check_id"), o["key"].alias("option_key"), o.alias("action")))
    k = F.col("k")
    made = F.array_compact(
        F.array(
            choice(k % 5 == 0, "1", "obligation:2", evidence.option("drop-obligation", "drop-obligation", None, None, 2)),
            choice(k % 4 == 1, "2", "date", evidence.option("adopt:2020-05-06", "set-field", "effective_from", "2020-05-06")),
            choice(k % 3 == 0, "3", "obligation:1", evidence.option("to-encouraged", "set-obligation-type", None, "encouraged", 1)),
            choice(k % 2 == 0, "4", "obligation:0", evidence.option("drop-obligation", "drop-obligation", None, None, 0)),
            choice(k % 2 == 0, "5", "obligation:9", evidence.option("drop-obligation", "drop-obligation", None, None, 9)),
            choice(k % 3 == 0, "6", "obligation:8", evidence.option("to-encouraged", "set-obligation-type", None, "encouraged", 8)),
            choice(k % 7 == 0, "7", "title", evidence.option("confirm-title", "acknowledge", "title")),
        )
    )
    decided = r.filter(k % 4 != 0).select(F.col("id").alias("policy_id"), F.explode(made).alias("m")).select("policy_id", "m.*")
    out = promotion.decided_drafts(r, decided)
    return out.select("id", F.array_join(F.transform("changes", lambda c: F.concat(c, F.lit("；"))), "").alias("changes"), F.array_join(F.transform("key_obligations", lambda o: F.concat(o["clause"], F.lit(":"), o["obligation_type"])), ",").alias("obligations"), "effective_from")


@query(NOTES + """ select 'decision' as kind, t.policy_id, t.check_id, t.option_key as label, concat(c.summary, case when quote is null then '' else concat('｜', quote) end) as evidence, null as decisions, null as changes, cast(null as int) as excerpts, null as card from t join c on t.policy_id = c.policy_id and t.check_id = c.check_id
 union all select 'promote', policy_id, null, null, null, coalesce(labels, ''), case when cleared then 'effective_from cleared' else '' end, cast(n_open as int), concat('cards/promoted_on=2026-01-02/', policy_id) from n""")
def ledger_of_promotions(spark, sf):
    """Decisions and promotions written to the ledger and read back."""
    good, checks, folder = _good(spark, sf), _two_layers(spark, sf), shared_folder(spark, "ledger")
    done = promotion.noted(promotion.decided_drafts(_draft_records(spark, sf), good), checks, "2026-01-02", "human")
    records.append_ledger(promotion.decision_rows(good.withColumn("ts", F.concat(F.lit("2026-01-02T"), "ts")), checks), folder)
    records.append_ledger(promotion.promotion_rows(done, "2026-01-02T10:00:00", "human"), folder)
    back = records.read_ledger(spark, folder)
    return back.select("kind", "policy_id", "check_id", "label", "evidence", F.when(F.col("kind") == "promote", F.array_join("decisions.label", "；")).alias("decisions"), F.array_join("changes", "；").alias("changes"), F.col("evidence_excerpt_count").alias("excerpts"), F.col("card_path").alias("card"))


ASKED = "select c_custkey as k, concat('p', c_custkey) as policy_id, case when c_custkey % 4 = 0 then ' ' else concat(' not a rule ', c_custkey) end as reason from customer where c_custkey % 3 = 0 union all select n_nationkey, concat('x', n_nationkey), 'no draft' from nation"


@query(f"with a as ({ASKED}), w as (select *, case when trim(reason) = '' then 'no reason' when policy_id like 'x%' then 'no draft' when k % 9 = 0 then 'exists' end as why from a) select policy_id, why, case when why is null then trim(reason) end as ledger, why is null as gone from w")
def rejections(spark, sf):
    """Requests to reject: without a reason, for no draft, for one that was rejected before; the others leave the queue and go to the ledger."""
    drafts = _table(spark, sf, "customer").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_custkey").alias("k"))
    asked = fr.load(spark, sf, ASKED.replace("from customer", "from {customer}").replace("from nation", "from {nation}")).select("policy_id", "reason")
    left, refused = promotion.reject(drafts, asked, drafts.filter("k % 9 = 0"))
    ledger = promotion.rejection_rows(asked, refused, "2026-01-02T00:00:00").select("policy_id", F.col("reason").alias("ledger"))
    still = left.select(F.col("id").alias("policy_id"), F.lit(True).alias("still"))
    return asked.join(refused.select("policy_id", "why"), "policy_id", "left").join(ledger, "policy_id", "left").join(still, "policy_id", "left").select("policy_id", "why", "ledger", (F.col("still").isNull() & F.col("why").isNull()).alias("gone"))


@query(f"with c as ({CHECKS}), s as ({STATES}), a as (select replace(page_url, 'http://r.example/', 'p') as policy_id, string_agg(concat(rank, ':', status, ':', coalesce(reason, '')), ',' order by rank) as attachments from s group by 1), r as (select concat('p', c_custkey) as policy_id from customer), n as (select r.policy_id, count(c.check_id) as n, count(*) filter (c.status <> 'ok') as open from r left join c on r.policy_id = c.policy_id group by 1) select n.policy_id, case when n = 0 then 1 else n end as checks, case when n = 0 then 1 else open end as pending_count, coalesce(attachments, '') as attachments from n left join a on n.policy_id = a.policy_id")
def cards_with_attachments(spark, sf):
    recs = _table(spark, sf, "customer").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("policy_id"))
    tried = _attachments(spark, sf).select(F.regexp_replace("page_url", "http://r.example/", "p").alias("policy_id"), "rank", "href", "status", "reason")
    cards = evidence.cards_kept(_checks(spark, sf), recs, tried.join(recs, "policy_id", "left_semi"))
    text = F.transform("attachments", lambda a: F.concat(a["rank"].cast("string"), F.lit(":"), a["status"], F.lit(":"), F.coalesce(a["reason"], F.lit(""))))
    return cards.select("policy_id", F.size("checks").cast("long").alias("checks"), "pending_count", F.array_join(text, ",").alias("attachments"))


RUNS = "select cast(ts as date) + cast(event_id % 3 as integer) as detected_on, event_id as ran_at, user_id as policies_scanned, event_id % 4 as failed from events where event_id % 50 = 0"


@query(HALVES + f", h as (select detected_on, count(*) as change_count, count(*) filter (significance = 'high') as high, count(*) filter (kept) as kept from merged group by 1), r as (select * from (select *, row_number() over (partition by detected_on order by ran_at desc) as rn from ({RUNS})) where rn = 1) select coalesce(h.detected_on, r.detected_on) as detected_on, coalesce(change_count, 0) as change_count, coalesce(high, 0) as high_significance_count, case when kept > 0 then kept end as merged_from_previous, policies_scanned, case failed when 0 then '' when 1 then 's1' when 2 then 's1,s2' when 3 then 's1,s2,s3' end as failed_sources from h full join r on h.detected_on = r.detected_on")
def day_headers_of_runs(spark, sf):
    """Headers with what the day's last run scanned and which sources failed in it."""
    runs = _table(spark, sf, "events").filter("event_id % 50 = 0").select(F.expr("date_add(cast(ts as date), cast(event_id % 3 as int))").alias("detected_on"), F.col("event_id").alias("ran_at"), F.col("user_id").alias("policies_scanned"), F.expr("slice(array('s3', 's2', 's1'), 4 - cast(event_id % 4 as int), 3)").alias("failed_sources"))
    out = diffing.day_headers(diffing.merge_changes(*_halves(spark, sf)), runs)
    return out.withColumn("failed_sources", F.array_join("failed_sources", ","))


@query(f"with p as ({P}), c as (select distinct concat('ord-', l_orderkey + t) as id from lineitem cross join (values (0), (1)) as s(t) where l_partkey % 3 <> 0), o as (select id, 'c' || i as clause from p cross join (values (0), (1), (2), (3)) as s(i) where i < n_obligations) select o.id, o.clause, 'mandatory' as obligation_type from o where o.id not in (select id from c)")
def unpenalized_obligations(spark, sf):
    clauses = F.transform(F.slice(F.array(*map(F.lit, range(4))), F.lit(1), F.col("n_obligations").cast("int")), lambda i: F.struct(F.concat(F.lit("c"), i.cast("string")).alias("clause"), F.lit("mandatory").alias("obligation_type")))
    p = policy(spark, sf).select("id", clauses.alias("key_obligations"))
    e = _table(spark, sf, "lineitem").filter("l_partkey % 3 <> 0").select(F.array(*[F.concat(F.lit("ord-"), (F.col("l_orderkey") + t).cast("string")) for t in (0, 1)]).alias("related_policies"))
    return enforcement.unpenalized_obligations(e, p)


@query("with l as (select l_orderkey, count(*) as n, count(distinct l_linenumber % 3) as kinds, bool_or(l_linenumber % 3 = 0) as a, bool_or(l_linenumber % 3 = 1) as b, bool_or(l_linenumber % 3 = 2) as c from lineitem group by 1) select concat('r', o_orderkey) as id, cast(coalesce(n, 0) as int) as n_obligations, cast(coalesce(n, 0) % 3 as int) as n_versions, case o_orderkey % 3 when 0 then '强制义务' when 1 then '软法（有事实约束力）' else 'other' end as binding_label, concat_ws(',', case when b then '强制要求' end, case when c then '未分类' end, case when a then '禁止' end) as type_labels from orders left join l on l_orderkey = o_orderkey")
def record_counts(spark, sf):
    kind = F.expr("case l_linenumber % 3 when 0 then 'prohibition' when 1 then 'mandatory' end")
    l = _table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(kind.alias("obligation_type"))).alias("key_obligations"))
    r = _table(spark, sf, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("id"), "key_obligations", F.slice("key_obligations", F.lit(1), F.size("key_obligations") % 3).alias("versions"), F.expr("case o_orderkey % 3 when 0 then 'binding' when 1 then 'soft-law' else 'other' end").alias("bindingness"))
    return catalog.record_counts(r).withColumn("type_labels", F.array_join("type_labels", ","))


@query("select concat('l', l_orderkey, '-', l_linenumber, '-', l_partkey) as record_id, rule, 'error' as severity from lineitem join (values (0, 'decision_no_blank'), (1, 'party_blank'), (1, 'decision_no_blank'), (2, 'violation_blank'), (3, 'party_blank'), (3, 'violation_blank')) as b(k, rule) on l_suppkey % 5 = k")
def blank_penalty_fields(spark, sf):
    """Penalties without number, party or violation: null, empty, or of white space, full-width spaces included."""
    i = "cast(l_suppkey % 5 as int)"
    blank = lambda *k: F.expr(f"case when l_suppkey % 5 in ({', '.join(map(str, k))}) then case l_linenumber % 3 when 0 then null when 1 then '' else ' 　' end else concat('x', {i}) end")
    rows = _table(spark, sf, "lineitem").select(F.expr("concat('l', l_orderkey, '-', l_linenumber, '-', l_partkey)").alias("id"), blank(0, 1).alias("decision_no"), blank(1, 3).alias("party"), blank(2, 3).alias("violation_type"), F.lit("human").alias("verified_by"), F.lit(None).cast("string").alias("notes"), F.lit(None).cast("string").alias("legal_basis"), F.array(F.lit("d")).alias("domain"))
    return validation.penalty_issues(rows)
