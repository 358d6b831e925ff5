"""Queries on evidence whose outcome bounds, clause tables and attachments decide."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evidence
from . import frames as fr
from .queries import query

# titles that agree, that differ in one of n letters (2 * (n - 1) / 2 * n is the ratio), and that share no more than a number
TITLED = """select concat('t', p_partkey) as policy_id, p_partkey as k, 5 + p_partkey % 20 + length(cast(p_partkey as string)) as n, concat(repeat('甲', cast(3 + p_partkey % 20 as int)), '办法', p_partkey) as title,
 case when p_partkey % 3 = 2 then concat('D', p_partkey) end as doc_number, case p_partkey % 3 when 0 then concat('正文 ', repeat('甲', cast(3 + p_partkey % 20 as int)), '办法', p_partkey) when 1 then '无关' else concat('另见 D', p_partkey) end as body_text,
 case p_partkey % 5 when 0 then null when 1 then concat('《', repeat('甲', cast(3 + p_partkey % 20 as int)), '办法', p_partkey, '》_站') when 2 then concat(repeat('甲', cast(3 + p_partkey % 20 as int)), '辨法', p_partkey) when 3 then concat('公告', p_partkey) else repeat('乙', cast(5 + p_partkey % 20 as int)) end as page_title from {part}"""


def _titled(spark, sf):
    return fr.load(spark, sf, TITLED)


@query(f"with r as ({TITLED.replace('{part}', 'part')}) select policy_id, case when k % 5 = 0 then 'manual' when k % 5 = 1 or (k % 5 = 2 and n >= 10) or k % 3 = 0 then 'ok' when k % 3 = 1 then 'manual' else 'error' end as status from r")
def titles_bounded(spark, sf):
    return evidence.titles(_titled(spark, sf)).select("policy_id", "status")


CN = "['一', '二', '三', '四', '五', '六', '七', '八', '九', '十', '十一', '十二', '十三', '十四', '十五', '十六', '十七', '十八', '十九', '二十', '二十一', '二十二', '二十三']"


def _claimed(spark, sf):
    """Records with six obligations: clauses in the page in either script, in attachments only, without a number, nowhere; and a summary of the clause's letters in another order."""
    k = F.col("p_partkey")
    number = lambda i: (k % 20 + i).cast("int")
    body = F.concat(F.lit("总则。第"), number(1).cast("string"), F.lit("条 金融机构应当建立管理制度并向监管部门报告。（三十）细则。第 "), S.int_to_chinese(number(2)), F.lit("条 鼓励创新。"), F.when(k % 5 == 0, F.concat(F.lit("某办法"), k.cast("string"))).otherwise(""))
    one = lambda clause, summary, kind: F.struct(clause.alias("clause"), F.lit(summary).alias("summary"), kind.alias("obligation_type"))
    o = F.array(
        one(F.concat(F.lit("第"), S.int_to_chinese(number(1)), F.lit("条")), "金融机构应当建立管理制度", F.when(k % 9 == 0, "encouraged").otherwise("mandatory")),
        one(number(2).cast("string"), "鼓励创新", F.when(k % 2 == 0, "mandatory").otherwise("encouraged")),
        one(F.concat(F.lit("（"), number(3).cast("string"), F.lit("）")), "银行不得泄露客户信息", F.lit("prohibition")),
        one(F.lit("总则"), "zzzz", F.lit("mandatory")),
        one(F.lit("九十九"), "无", F.lit("mandatory")),
        one(number(1).cast("string"), "度制理管立建当应构机融金", F.lit("mandatory")),
    )
    r = fr.load(spark, sf, "select * from {part}").select(F.concat(F.lit("p"), k.cast("string")).alias("policy_id"), F.concat(F.lit("某办法"), k.cast("string")).alias("title"), F.lit(None).cast("string").alias("doc_number"), body.alias("body_text"), (k % 7 != 0).alias("usable"), F.when(k % 37 != 0, o).alias("key_obligations"), k.alias("k"))
    third = F.concat(F.lit("附件 第 "), (F.col("k") % 20 + 3).cast("string"), F.lit(" 条 银行不得泄露客户信息。"))
    space = lambda rank, status, text: F.struct(F.lit(rank).alias("rank"), F.lit(status).alias("status"), text.alias("text"))
    none = F.lit(None).cast("string")
    found = F.when(F.col("k") % 4 == 0, F.array(space(1, "extracted", third))).when(F.col("k") % 4 == 1, F.array(space(1, "failed", none))).when(F.col("k") % 4 == 2, F.array(space(1, "extracted", F.lit("别的")), space(2, "extracted", third), space(3, "extracted", F.concat(third, F.lit("zzzz")))))
    return r, r.select("policy_id", F.explode(found).alias("s")).select("policy_id", "s.*")


WHERE_MISSING = "case when k % 4 in (0, 2) then 'error' when k % 4 = 1 then 'manual' when k % 5 = 0 then 'error' else 'manual' end"
CLAIMED = f"""with r as (select concat('p', p_partkey) as policy_id, p_partkey as k from part),
 o as (select policy_id, k, 0 as i, case when k % 9 = 0 then 'error' else 'ok' end as status, case when k % 9 = 0 then 'modal words and type differ' else 'clause found' end as summary from r
 union all select policy_id, k, 1, case when k % 2 = 0 then 'error' else 'ok' end, case when k % 2 = 0 then 'modal words and type differ' else 'clause found' end from r
 union all select policy_id, k, 2, case when k % 4 in (0, 2) then 'ok' when k % 20 + 3 = 30 then 'ok' else {WHERE_MISSING} end, case when k % 4 in (0, 2) then 'clause found' else 'clause not found' end from r
 union all select policy_id, k, 3, 'error', 'summary and clause differ' from r union all select policy_id, k, 4, {WHERE_MISSING}, 'clause not found' from r union all select policy_id, k, 5, 'error', 'summary and clause differ' from r)
 select policy_id, concat('obligation:', i) as check_id, case when k % 7 = 0 then 'manual' else status end as status, case when k % 7 = 0 then 'no usable text' else summary end as summary from o where k % 37 <> 0 union all select policy_id, 'obligations', 'ok', 'no obligations' from r where k % 37 = 0"""


@query(CLAIMED)
def clauses_found(spark, sf):
    """Obligations looked up in pages and attachments."""
    return evidence.obligations(*_claimed(spark, sf)).select("policy_id", "check_id", "status", "summary")


@query(f"with t as ({TITLED.replace('{part}', 'part')}) select 'titles' as what, count(*) as n, count(*) filter (k % 5 = 2 and n >= 10) as compared from t union all select 'obligations', sum(case when p_partkey % 37 = 0 then 1 else 6 end)::bigint, count(*) filter (p_partkey % 37 <> 0 and p_partkey % 7 <> 0) from part")
def checks_compared(spark, sf):
    """How many rows containment, clauses and bounds leave to a comparison block by block."""
    t, o = evidence.open_titles(_titled(spark, sf)), evidence.open_obligations(*_claimed(spark, sf))
    return t.agg(F.lit("titles").alias("what"), F.count(F.lit(1)).alias("n"), F.count("open").alias("compared")).union(o.agg(F.lit("obligations"), F.count(F.lit(1)), F.count_if("undecided")))


CLAUSES = f"""with r as (select p_partkey as k, {CN} as cn from part), m as (select k, 0 as rank, k % 20 + 1 as number, 4 as pos from r union all select k, 0, 30, 4 + 3 + length(cast(k % 20 + 1 as varchar)) + 22 - 1 from r
 union all select k, 0, k % 20 + 2, 4 + 3 + length(cast(k % 20 + 1 as varchar)) + 22 - 1 + 7 from r union all select k, 1, k % 20 + 3, 4 from r where k % 4 = 0 union all select k, 2, k % 20 + 3, 4 from r where k % 4 = 2 union all select k, 3, k % 20 + 3, 4 from r where k % 4 = 2)
 select concat('p', k) as policy_id, cast(number as int) as number, cast(rank as int) as rank, cast(pos as bigint) as place from m"""


@query(CLAUSES)
def clause_places(spark, sf):
    """The inverted index of clauses: where each number first stands in each text."""
    r, spaces = _claimed(spark, sf)
    texts = r.select("policy_id", F.lit(0).alias("rank"), F.col("body_text").alias("text")).unionByName(spaces.filter("status = 'extracted'").select("policy_id", "rank", "text"))
    articles, heads = evidence.clause_index(texts)
    return heads.join(articles, ["policy_id", "rank", "article"]).select("policy_id", "number", "rank", (F.col("at") + F.col("offset")).alias("place"))
