"""Differences of snapshots, and the daily change feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STALE_DAYS = 180
VALID = ("effective", "partially_effective", "amended")


def stale_days(as_of: Column) -> Column:
    return F.datediff(as_of, F.col("last_verified")).cast("long")


def snapshot_changes(old: DataFrame, new: DataFrame, as_of: str) -> DataFrame:
    """Changes from old to new, and records not verified for more than STALE_DAYS on as_of.

    One join by id finds new records, changed statuses and changed fields; a record may have
    a status change and a field change. A missing hash on either side is no difference.
    """
    keep = ["id", "status", "content_hash", "effective_from", "effective_until", "superseded_by", "n_obligations", "last_verified"]
    before = old.select(F.col("id"), *[F.col(c).alias(f"old_{c}") for c in keep if c != "id"], F.lit(True).alias("was"))
    both = new.select(*keep, "ai_relevance", "url").join(before, "id", "left")
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    hashes = (F.col("content_hash") != "") & (F.col("old_content_hash") != "") & (F.col("content_hash") != F.col("old_content_hash"))
    fields = F.array_compact(F.array(F.when(hashes, "content_hash"), *[F.when(differs(c), name) for c, name in (("effective_from", "effective_from"), ("effective_until", "effective_until"), ("superseded_by", "superseded_by"), ("n_obligations", "key_obligations"), ("last_verified", "last_verified"))]))
    was, change = F.coalesce(F.col("was"), F.lit(False)), lambda kind, weight, fields: F.struct(F.lit(kind).alias("change_type") if isinstance(kind, str) else kind.alias("change_type"), F.lit(weight).alias("significance") if isinstance(weight, str) else weight.alias("significance"), fields.alias("fields"))
    none = F.array().cast("array<string>")
    content = F.array_contains("changed", "content_hash")
    both = both.withColumn("changed", fields)
    rows = F.array_compact(
        F.array(
            F.when(~was, change("new", F.when(F.col("status").isin(*VALID) & (F.col("ai_relevance") == "core"), "high").otherwise("medium"), none)),
            F.when(was & (F.col("status") != F.col("old_status")), change("status_changed", "high", F.array(F.lit("status")))),
            F.when(was & (F.size("changed") > 0), change(F.when(content, "content_changed").otherwise("metadata_changed"), F.when(content, "high").otherwise("low"), F.col("changed"))),
            F.when(stale_days(F.lit(as_of).cast("date")) > STALE_DAYS, change("metadata_changed", "medium", F.array(F.lit("last_verified")))),
        )
    )
    return both.select("id", "url", F.inline(rows)).select(F.col("id").alias("policy_id"), "change_type", "significance", "fields", "url")


def baseline_changes(old: DataFrame, old_issues: DataFrame, new: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Changes since an older snapshot, and its load errors, marked as the baseline's; its warnings are dropped."""
    errors = old_issues.filter("severity = 'error'").withColumn("rule", F.concat(F.lit("baseline:"), "rule"))
    return snapshot_changes(old, new, as_of), errors


def feed_totals(changes: DataFrame, policies: DataFrame) -> DataFrame:
    """What a publication holds: change entries over all days, days, and pages: one per record and one per day."""
    c = changes.groupBy("detected_on").agg(F.count(F.lit(1)).alias("entries")).select("entries", F.lit(1).alias("days"), F.lit(0).alias("records"))
    both = c.union(policies.select(F.lit(0), F.lit(0), F.lit(1)))
    return both.agg(F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"), F.coalesce(F.sum("days"), F.lit(0)).alias("days"), F.coalesce(F.sum(F.col("records") + F.col("days")), F.lit(0)).alias("pages"))


def ranked(changes: DataFrame) -> DataFrame:
    """Changes with rank 0 for high to 3 for unknown significance, in that order."""
    rank = F.when(F.col("significance") == "high", 0).when(F.col("significance") == "medium", 1).when(F.col("significance") == "low", 2).otherwise(3)
    return changes.withColumn("rank", rank).orderBy("rank", "policy_id", "change_type")


def stale_records(policies: DataFrame, as_of: str, threshold: int = STALE_DAYS) -> DataFrame:
    """Records not verified for more than threshold days, longest first."""
    return policies.withColumn("days", stale_days(F.lit(as_of).cast("date"))).filter(F.col("days") > threshold).orderBy(F.desc("days"), "id")


KEY = ["detected_on", "change_type", "policy_id", "url_key"]


def keyed(changes: DataFrame) -> DataFrame:
    return changes.withColumn("url_key", F.coalesce("url", F.lit("")))


def merge_changes(previous: DataFrame, incoming: DataFrame) -> DataFrame:
    """The feed after a run: incoming rows replace those of the same day, type, record and url; others stay."""
    kept = keyed(previous).join(keyed(incoming).select(*KEY).distinct(), KEY, "left_anti")
    return keyed(incoming).withColumn("kept", F.lit(False)).unionByName(kept.withColumn("kept", F.lit(True))).drop("url_key")


def merge_outcome(previous: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per day with incoming or previous rows: total, added, replaced and kept."""
    was, now = keyed(previous).groupBy(*KEY).agg(F.count(F.lit(1)).alias("was")), keyed(incoming).groupBy(*KEY).agg(F.count(F.lit(1)).alias("now"))
    both = was.join(now, KEY, "full").fillna(0, ["was", "now"])
    out = both.groupBy("detected_on").agg(F.sum("now").alias("incoming"), F.count_if((F.col("was") > 0) & (F.col("now") > 0)).alias("replaced"), F.sum(F.when(F.col("now") == 0, F.col("was")).otherwise(0)).alias("kept"))
    return out.select("detected_on", (F.col("incoming") + F.col("kept")).alias("total"), (F.col("incoming") - F.col("replaced")).alias("added"), "replaced", "kept")


def day_headers(merged: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Per day the counts of its rows, made anew from the rows.

    runs: (detected_on, ran_at, policies_scanned, failed_sources); a day then has these of its
    last run too, and a day whose run found nothing has a header of its own.
    """
    out = merged.groupBy("detected_on").agg(F.count(F.lit(1)).alias("change_count"), F.count_if(F.col("significance") == "high").alias("high_significance_count"), F.count_if(F.col("kept")).alias("merged_from_previous"))
    if runs is None:
        return out
    last = runs.groupBy("detected_on").agg(F.max_by(F.struct("policies_scanned", F.array_sort(F.coalesce("failed_sources", F.array().cast("array<string>"))).alias("failed_sources")), "ran_at").alias("r"))
    both = out.join(last, "detected_on", "full").select("detected_on", *[F.coalesce(c, F.lit(0)).alias(c) for c in out.columns[1:]], "r.policies_scanned", "r.failed_sources")
    return both.withColumn("merged_from_previous", F.when(F.col("merged_from_previous") > 0, F.col("merged_from_previous")))


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))


def pending_count(changes: DataFrame, recorded: DataFrame) -> DataFrame:
    """How many discovered urls, over all days, no record has."""
    found = changes.filter((F.col("change_type") == "discovered") & F.col("url").isNotNull()).select("url").distinct()
    return found.join(recorded.select("url").distinct(), "url", "left_anti").agg(F.count(F.lit(1)).alias("pending"))


def latest_day(changes: DataFrame) -> DataFrame:
    return changes.agg(F.max("detected_on").alias("latest_day"))
