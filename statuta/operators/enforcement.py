"""Penalty records: table rows by header text, regrouping by document, coverage of policies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# fixed values: header texts of the columns
COLUMNS = {"party": "当事人名称", "decision_no": "行政处罚决定书文号", "violation_type": "违法行为类型", "penalty_content": "行政处罚内容", "authority": "作出行政处罚决定机关名称", "decision_date": "作出行政处罚决定日期", "publicity_period": "公示期限"}


def penalty_rows(pages: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """Rows of penalty tables: pages has url, source_id, published_on and cells (array of arrays of text).

    The header is the first row with at least half of the wanted header texts, and two at
    least; columns are found by their text, never by place. A page without header gives no
    row, and neither do rows of under two cells or without a party. A missing column is "".
    """
    want = {**COLUMNS, **(columns or {})}
    least = max(2, len(want) // 2)
    heads = F.array(*[F.lit(v) for v in want.values()])
    matched = lambda row: F.size(F.array_intersect(F.transform(row, S.normalize_header), heads))
    found = F.filter(F.transform("cells", lambda row, i: F.struct(i.alias("at"), matched(row).alias("n"), F.transform(row, S.normalize_header).alias("texts"))), lambda x: x["n"] >= least)
    p = pages.withColumn("head", F.get(found, 0)).filter("head is not null")
    p = p.select("url", "source_id", "published_on", "head", F.posexplode("cells").alias("at", "row")).filter((F.col("at") > F.col("head.at")) & (F.size("row") >= 2))

    def cell(name: str):
        at = F.array_position(F.col("head.texts"), F.lit(want[name])).cast("int")
        return S.spaced(F.coalesce(F.get("row", F.when(at > 0, at - 1)), F.lit("")))

    out = p.select("url", "source_id", "published_on", "at", *[cell(c).alias(c) for c in want]).filter("party != ''")
    title = F.when(F.col("violation_type") != "", F.concat("party", F.lit("｜"), S.shorten(F.col("violation_type")))).otherwise(F.col("party"))
    row_url = F.concat("url", F.lit("#"), F.when(F.col("decision_no") != "", F.col("decision_no")).otherwise(F.col("party")))
    return out.select(title.alias("title"), row_url.alias("url"), "source_id", "published_on", *want, F.col("url").alias("document_url"), "at")


def detail_outcome(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """Per source: pages opened, pages without rows, and failed, warning or ok."""
    n = rows.groupBy(F.col("document_url").alias("url")).agg(F.count(F.lit(1)).alias("n"))
    out = pages.select("source_id", "url").join(n, "url", "left").groupBy("source_id").agg(F.count(F.lit(1)).alias("opened"), F.count_if(F.col("n").isNull()).alias("empty"))
    return out.withColumn("outcome", F.when(F.col("empty") == F.col("opened"), "failed").when(F.col("empty") > 0, "warning").otherwise("ok"))


def by_document(rows: DataFrame) -> DataFrame:
    """Decision documents with their parties and rows counted."""
    return rows.groupBy("document_url").agg(F.countDistinct("party").alias("parties"), F.countDistinct("decision_no").alias("decisions"), F.count(F.lit(1)).alias("penalty_rows"))


def by_domain(e: DataFrame) -> DataFrame:
    """Penalties by domain, authority and violation; one without domain counts under null."""
    return e.select("id", F.explode_outer("domain").alias("domain_name"), "authority", "violation_type").groupBy("domain_name", "authority", "violation_type").agg(F.count(F.lit(1)).alias("penalties"))


def by_party_type(e: DataFrame) -> DataFrame:
    """Penalties by the kind of party, null for unknown."""
    return e.groupBy("party_type").agg(F.count(F.lit(1)).alias("penalties"), F.countDistinct("party").alias("parties"))


def obligations_by_type(p: DataFrame) -> DataFrame:
    """Obligations of all records by their type, and how many records have one."""
    return p.select("id", F.explode("key_obligations.obligation_type").alias("obligation_type")).groupBy("obligation_type").agg(F.count(F.lit(1)).alias("obligations"), F.countDistinct("id").alias("records"))


def coverage(e: DataFrame, p: DataFrame) -> DataFrame:
    """Per existing policy the penalties that cite it, 0 for none; the rows of penalties that cite no policy have a null id."""
    refs = e.select("id", F.explode("related_policies").alias("policy_id")).distinct()
    cited = refs.groupBy("policy_id").agg(F.count(F.lit(1)).alias("penalties"))
    per_policy = p.select("id").join(cited, F.col("id") == F.col("policy_id"), "left").select("id", F.coalesce("penalties", F.lit(0)).alias("penalties"))
    free = e.filter(F.coalesce(F.size("related_policies"), F.lit(0)) <= 0).agg(F.count(F.lit(1)).alias("penalties")).select(F.lit(None).cast("string").alias("id"), "penalties")
    return per_policy.union(free)


def unpenalized_obligations(e: DataFrame, p: DataFrame) -> DataFrame:
    """Obligations (id, clause, obligation_type) of the policies that no penalty cites."""
    cited = e.select(F.explode("related_policies").alias("id")).distinct()
    return p.join(cited, "id", "left_anti").select("id", F.inline("key_obligations")).select("id", "clause", "obligation_type")
