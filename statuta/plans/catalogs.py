"""Queries on versions as of given days, searches by postings, and listings with paths of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog
from ..sources import listing
from ..tables import shared_folder
from . import frames as fr
from .queries import VER, P, _table, policy, query, versions

ONE = f"with v as ({VER}), d as (select id, version, max(status) as status, min(effective_from) as effective_from, case when count(*) = count(effective_until) then max(effective_until) end as effective_until from v group by id, version)"
ASKED = "select o_orderkey * 10 + t as k, concat('ord-', o_orderkey + t % 2) as id, case when o_orderkey % 17 = 0 and t = 1 then null else cast(o_orderdate as date) + cast(t * 40 as integer) end as day from orders cross join (values (0), (1), (2), (9)) as s(t)"


@query(f"{ONE}, q as ({ASKED}), a as (select k, d.* from q join d on q.id = d.id and effective_from <= day and (effective_until is null or effective_until > day)), b as (select * from (select *, row_number() over (partition by k order by version desc) as rn from a) where rn = 1) select q.k, q.id, q.day, b.version, b.status, b.effective_from as since from q left join b on q.k = b.k")
def versions_on_days(spark, sf):
    """Four days for each order: the version of a record that applied then."""
    one = versions(spark, sf).groupBy("id", "version").agg(F.max("status").alias("status"), F.min("effective_from").alias("effective_from"), F.when(F.count(F.lit(1)) == F.count("effective_until"), F.max("effective_until")).alias("effective_until"))
    lists = one.groupBy("id").agg(F.collect_list(F.struct("version", "status", "effective_from", "effective_until")).alias("versions"))
    o = _table(spark, sf, "orders").withColumn("t", F.explode(F.array(*map(F.lit, (0, 1, 2, 9)))))
    day = F.when(~((F.col("o_orderkey") % 17 == 0) & (F.col("t") == 1)), F.date_add(F.col("o_orderdate").cast("date"), F.col("t") * 40))
    asked = o.select((F.col("o_orderkey") * 10 + F.col("t")).alias("k"), F.concat(F.lit("ord-"), (F.col("o_orderkey") + F.col("t") % 2).cast("string")).alias("id"), day.alias("day"))
    return catalog.versions_as_of(lists, asked).select("k", "id", "day", "version", "status", "since")


SEARCHES = ("ord 17", "rules 9", "1-URGENT", "x", "issuer 1 disclosure", "no-such-word", "金融 ur")
BLOB = "lower(concat_ws(' ', title, issuer, issuer_code, array_to_string(summaries, ' '), array_to_string(topics, ' '), array_to_string(domain, ' ')))"


@query(f"with p as ({P}), b as (select id, {BLOB} as blob from p) " + " union all ".join(f"select '{q}' as query, id from b where " + " and ".join(f"contains(blob, '{t}')" for t in q.lower().split()) for q in SEARCHES))
def searches(spark, sf):
    """Searches with words of one to many letters over one posting table."""
    folder, p = shared_folder(spark, "search"), policy(spark, sf)
    catalog.write_postings(p, folder)
    out = None
    for q in SEARCHES:
        one = catalog.search_postings(p, folder, q).select(F.lit(q).alias("query"), "id")
        out = one if out is None else out.union(one)
    return out


@query("select o_orderkey as k, concat('Listing no ', o_orderkey) as title, concat('http://l.example/', case o_orderkey % 4 when 0 then 'deep' when 1 then 'plain' when 2 then 'rows' else 'first' end, '/', o_orderkey) as url from orders where o_orderkey % 4 <> 3 or o_orderkey % 8 = 3")
def json_listing_paths(spark, sf):
    """Listings whose items lie where their own source says, at any depth, or else where listings usually have them.

    A configured list that isn't empty counts even if it holds no object; one that is empty or no list leaves it to the others.
    """
    k = "o_orderkey"
    one = lambda kind: f"array(named_struct('t', concat('Listing no ', {k}), 'u', concat('/{kind}/', {k})))"
    payload = F.expr(f"""case {k} % 4 when 0 then to_json(named_struct('payload', named_struct('inner part', named_struct('items', {one('deep')})), 'rows', {one('wrong')}))
      when 1 then to_json(named_struct('hits', {one('plain')})) when 2 then to_json(named_struct('payload', 3, 'data', named_struct('rows', {one('rows')})))
      else case when {k} % 8 = 3 then to_json(named_struct('payload', named_struct('inner part', named_struct('items', array())), 'list', {one('first')})) else to_json(named_struct('payload', named_struct('inner part', named_struct('items', array(1, 2))), 'list', {one('wrong')})) end end""")
    path = F.expr(f"case {k} % 4 when 1 then 'hits' else 'payload.inner part.items' end")
    o = _table(spark, sf, "orders").select(F.col(k).cast("string").alias("source_id"), payload.alias("payload"), path.alias("items_path"), F.lit("").alias("url_template"), F.lit("http://l.example/list/").alias("list_url"), F.expr("map('title', 't', 'url', 'u')").alias("field_map"))
    return listing.listing_docs(o).select(F.col("source_id").cast("long").alias("k"), "title", "url")
