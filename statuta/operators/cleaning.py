"""Cleaning of discovered documents: nothing is dropped without a count and a reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

TITLE_OF_NAVIGATION = 12
LEAST_TITLE, LEAST_DATED = 8, 0.3


def dedupe_by_url(docs: DataFrame) -> DataFrame:
    """Of each source and url the row with the least seq. The reduction starts before the shuffle."""
    row = F.struct("seq", *[F.col(c) for c in docs.columns if c != "seq"])
    kept = docs.groupBy("source_id", "url").agg(F.min_by(row, "seq").alias("r"))
    return kept.select(*[F.col(f"r.{c}").alias(c) for c in docs.columns])


def with_navigation(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """docs with is_navigation: no date, no deeper than the list page, and a short title."""
    base = registry.select(F.col("id").alias("source_id"), S.url_path_depth(F.col("list_url")).alias("list_depth"))
    out = docs.join(base, "source_id", "left")
    flag = F.col("published_on").isNull() & (S.url_path_depth(F.col("url")) <= F.col("list_depth")) & (F.length("title") <= TITLE_OF_NAVIGATION)
    return out.withColumn("is_navigation", F.coalesce(flag, F.lit(False))).drop("list_depth")


def haystack(docs: DataFrame) -> Column:
    """Title and the non-empty texts of extra, a line each."""
    if "extra" not in docs.columns:
        return F.col("title")
    return F.concat_ws("\n", "title", F.filter(F.coalesce(F.map_values("extra"), F.array().cast("array<string>")), lambda x: x != ""))


def with_drop_reason(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """docs with drop_reason: navigation, excluded, not_matched, or null for what stays.

    A source's exclude words win over its include words; blank words count for nothing; without
    include words all is kept.
    """
    words = registry.select(F.col("id").alias("source_id"), *[F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda w: F.trim(w) != "").alias(c) for c in ("include_keywords", "exclude_keywords")])
    out = with_navigation(docs, registry).withColumn("haystack", haystack(docs)).join(words, "source_id", "left")
    hit = lambda c: F.coalesce(F.exists(c, lambda w: F.contains(F.col("haystack"), w)), F.lit(False))
    reason = F.when(F.col("is_navigation"), "navigation").when(hit("exclude_keywords"), "excluded").when(F.coalesce(F.size("include_keywords"), F.lit(0)) <= 0, F.lit(None)).when(~hit("include_keywords"), "not_matched")
    return out.withColumn("drop_reason", reason).drop("haystack", "include_keywords", "exclude_keywords", "is_navigation")


def discovered(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Kept documents whose url isn't known, as changes to record."""
    new = docs.join(known.select("url").distinct(), "url", "left_anti")
    return new.select(F.lit("discovered").alias("change_type"), F.concat(F.lit("pending:"), "source_id", F.lit(":"), "url").alias("policy_id"), "title", F.lit("medium").alias("significance"), "url", "source_id")


def known_urls(recorded: DataFrame, changes: DataFrame) -> DataFrame:
    """Every url that a record or any change ever named."""
    return recorded.select("url").union(changes.select("url")).filter(F.col("url").isNotNull() & (F.col("url") != "")).distinct()


def cleaning_report(registry: DataFrame, marked: DataFrame) -> DataFrame:
    """Per source of the registry, those without rows included: counts by fate, and the run's status."""
    fate = lambda r: F.count_if(F.col("drop_reason") == r)
    counts = marked.groupBy("source_id").agg(F.count(F.lit(1)).alias("found"), fate("navigation").alias("dropped_navigation"), fate("excluded").alias("dropped_excluded"), fate("not_matched").alias("dropped_not_matched"), F.count_if(F.col("drop_reason").isNull()).alias("kept"))
    out = registry.select(F.col("id").alias("source_id"), "enabled").join(counts, "source_id", "left").fillna(0, ["found", "dropped_navigation", "dropped_excluded", "dropped_not_matched", "kept"])
    status = F.when(~F.col("enabled"), "skipped").when(F.col("found") == F.col("dropped_navigation"), "degraded").otherwise("ok")
    return out.withColumn("status", status).drop("enabled")


def run_summary(report: DataFrame) -> DataFrame:
    """One row: sources by outcome, and documents."""
    names = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("source_id")))), ",")
    ok, skipped = F.col("status").isin("ok", "empty"), F.col("status") == "skipped"
    return report.agg(names(ok).alias("ok_sources"), names(~ok & ~skipped).alias("failed_sources"), names(skipped).alias("skipped_sources"), F.sum("kept").alias("total_docs"))


def quality_gate(docs: DataFrame) -> DataFrame:
    """Per source: mean title length, share of dated rows, and whether the whole source passes."""
    out = docs.groupBy("source_id").agg(F.avg(F.length("title")).alias("mean_title"), F.avg(F.col("published_on").isNotNull().cast("int")).alias("dated_share"))
    return out.withColumn("passes", (F.col("mean_title") >= LEAST_TITLE) & (F.col("dated_share") >= LEAST_DATED))


def dropped_top(marked: DataFrame, most: int = 40) -> DataFrame:
    """The first dropped documents of each source, and how many more there are."""
    dropped = marked.filter(F.col("drop_reason").isNotNull())
    total = dropped.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    first = dropped.withColumn("rank", F.row_number().over(Window.partitionBy("source_id").orderBy("seq"))).filter(F.col("rank") <= most)
    return first.join(total, "source_id").select("source_id", "rank", "seq", "drop_reason", F.greatest(F.col("n") - most, F.lit(0)).alias("more"))


def capped_details(docs: DataFrame, configured: int, absolute: int = 60) -> DataFrame:
    """The first documents of each source in list order, as many as may be opened; navigation must be gone before."""
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy("seq"))
    return docs.withColumn("rank", rank).filter(F.col("rank") <= min(configured, absolute)).drop("rank")


def pages_to_keep(pages: DataFrame, most: int, page_size: int | None = None) -> DataFrame:
    """Pages (source_id, page_no, n_items) up to the first that ends the list: an empty one after the first, or with page_size a short one."""
    ends = (F.col("n_items") == 0) & (F.col("page_no") > 1)
    if page_size:
        ends = ends | (F.col("n_items") < page_size)
    stop = F.min(F.when(ends, F.col("page_no"))).over(Window.partitionBy("source_id"))
    return pages.withColumn("stop", stop).filter((F.col("page_no") <= most) & (F.col("stop").isNull() | (F.col("page_no") <= F.col("stop")))).drop("stop")


def source_plan(registry: DataFrame, only: list[str] | None = None, force: bool = False) -> DataFrame:
    """Per source what a run does: fetch, skipped or failed."""
    wanted = F.col("id").isin(only) if only else F.lit(True)
    plan = F.when(~wanted, "skipped").when(~F.col("enabled") & F.lit(not force), "skipped").when(F.col("fetcher") == "manual", "skipped").when(F.coalesce(F.col("list_url"), F.lit("")) == "", "failed").otherwise("fetch")
    return registry.select(F.col("id").alias("source_id"), plan.alias("plan"))


def without_derivatives(docs: DataFrame) -> DataFrame:
    """Without explanatory pages: those in topic folders, or with commentary in the address."""
    return docs.filter(~F.col("url").rlike("/zhuanti/|jiedu|tujie"))


def without_pager_noise(docs: DataFrame) -> DataFrame:
    """Without pager texts and titles that have no Chinese character."""
    return docs.filter(F.col("title").rlike("[一-鿿]") & ~F.col("title").rlike("^(上一页|下一页|首页|尾页|共[0-9]+页|第[0-9]+页)$"))


def all_sources(*docs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), docs)
