"""Validation: every broken rule is a row (record_id, rule, severity); errors block, warnings don't."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .diffing import VALID, stale_records

# fixed values: words that tell where a date or a transcription comes from, and words of technical matters
BASIS = ("依据", "出处", "来源", "条款", "载明", "核验", "原文", "核对", "确认", "明确", "施行", "生效", "第")
LEGAL_BASIS = ("依据", "出处", "来源", "条款")
TECHNICAL = ("数据", "信息", "网络", "科技", "算法", "智能", "技术")
# fixed values: the schema's vocabularies and patterns
STATUSES = ("draft", "consultation", "published", "effective", "partially_effective", "amended", "repealed", "superseded", "expired", "unknown")
INSTRUMENTS = ("法律", "行政法规", "部门规章", "部门规范性文件", "行业自律规则", "国家标准", "地方性文件", "其他")
BINDING = ("binding", "soft-law", "guidance", "consultation")
RELEVANCE = ("core", "related", "background")
OBLIGATIONS = ("prohibition", "mandatory", "requires-approval", "requires-reporting", "requires-recordkeeping", "requires-assessment", "encouraged")
ID = "^[a-z0-9]+(-[a-z0-9]+)+$"
PENALTY_ID = "^[a-z][a-z0-9_]*-[0-9]{4}-[a-z0-9-]+$"
HASH = "^sha256:[a-f0-9]{64}$"
URL = "^https?://"
STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\+\d{2}:\d{2}|Z)$"


def _issues(rows: DataFrame, rules: list[tuple[str, str, Column]], key: str = "id") -> DataFrame:
    """One pass over the rows: a row for every rule whose condition holds."""
    found = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))) for rule, severity, cond in rules]))
    return rows.select(F.col(key).alias("record_id"), F.inline(found))


def _blank(c: str) -> Column:
    return F.coalesce(S.trimmed(F.col(c)), F.lit("")) == ""


def policy_issues(p: DataFrame) -> DataFrame:
    """The semantic rules of policies; p has version_numbers, an array, and tier."""
    c, note = F.col, F.coalesce(F.col("verified_note"), F.lit(""))
    valid = c("status").isin(*VALID)
    numbers = F.array_sort("version_numbers")
    rules = [
        ("unsettled_with_date", "error", c("status").isin("draft", "consultation") & c("effective_from").isNotNull()),
        ("before_publication", "error", (c("effective_from") < c("published_on")) & ~F.contains(F.coalesce(c("notes"), F.lit("")), F.lit("追溯"))),
        ("ends_before_start", "error", c("effective_until") < c("effective_from")),
        ("expired_without_end", "error", (c("status") == "expired") & c("effective_until").isNull()),
        ("unknown_without_note", "error", (c("status") == "unknown") & (note == "")),
        ("superseded_without_successor", "error", (c("status") == "superseded") & (F.coalesce(c("superseded_by"), F.lit("")) == "")),
        ("versions_not_continuous", "error", (F.size("version_numbers") > 0) & (numbers != F.sequence(F.lit(1), F.greatest(F.size("version_numbers"), F.lit(1))))),
        ("effective_without_date", "warning", c("status").isin("effective", "partially_effective") & c("effective_from").isNull()),
        ("valid_but_automated", "warning", valid & (c("verified_by") == "automated")),
        ("not_primary", "error", c("tier") != "primary"),
        ("date_unconfirmed", "error", c("effective_from").isNotNull() & S.unconfirmed_sentence(c("verified_note")).isNotNull()),
        ("date_without_basis", "warning", (c("verified_by") == "automated") & c("effective_from").isNotNull() & ~S.any_word(note, BASIS)),
    ]
    return _issues(p, rules)


def penalty_issues(e: DataFrame) -> DataFrame:
    """The semantic rules of penalties."""
    c, notes = F.col, F.coalesce(F.col("notes"), F.lit(""))
    rules = [
        ("decision_no_blank", "error", _blank("decision_no")),
        ("party_blank", "error", _blank("party")),
        ("violation_blank", "error", _blank("violation_type")),
        ("automated_without_basis", "warning", (c("verified_by") == "automated") & ~S.any_word(notes, BASIS)),
        ("technical_without_domain", "warning", S.any_word(F.coalesce(c("violation_type"), F.lit("")), TECHNICAL) & (F.coalesce(F.size("domain"), F.lit(0)) <= 0)),
        ("legal_basis_without_source", "warning", (F.coalesce(c("legal_basis"), F.lit("")) != "") & ~S.any_word(notes, LEGAL_BASIS)),
    ]
    return _issues(e, rules)


def shape_issues(rows: DataFrame, shape: dict[str, dict], key: str = "id") -> DataFrame:
    """Findings against a column shape: required, enum, pattern, min, max, min_items, unique. All
    findings of a record are returned; a column that is absent is missing in every record."""
    rules = []
    for name, spec in shape.items():
        here, c = name.split(".")[0] in rows.columns, F.col(name)
        if spec.get("required"):
            rules.append((f"{name}:required", "error", c.isNull() if here else F.lit(True)))
        if not here:
            continue
        if "enum" in spec:
            rules.append((f"{name}:enum", "error", ~c.isin(*spec["enum"])))
        if "pattern" in spec:
            rules.append((f"{name}:pattern", "error", ~c.rlike(spec["pattern"])))
        if "min" in spec:
            rules.append((f"{name}:min_length", "error", F.length(c) < spec["min"]))
        if "max" in spec:
            rules.append((f"{name}:max_length", "error", F.length(c) > spec["max"]))
        if "min_items" in spec:
            rules.append((f"{name}:min_items", "error", F.when(c.isNotNull(), F.size(c)) < spec["min_items"]))
        if spec.get("unique"):
            rules.append((f"{name}:unique", "error", F.when(c.isNotNull(), F.size(c) != F.size(F.array_distinct(c)))))
    return _issues(rows, rules, key)


POLICY_SHAPE = {
    "id": {"required": True, "pattern": ID, "min": 6, "max": 80},
    "title": {"required": True, "min": 4, "max": 300},
    "issuer": {"required": True, "min": 2},
    "issuer_code": {"pattern": "^[a-z][a-z0-9_]*$"},
    "jurisdiction": {"required": True, "enum": ("CN",)},
    "instrument_type": {"required": True, "enum": INSTRUMENTS},
    "bindingness": {"required": True, "enum": BINDING},
    "ai_relevance": {"required": True, "enum": RELEVANCE},
    "domain": {"required": True, "min_items": 1, "unique": True},
    "status": {"required": True, "enum": STATUSES},
    "published_on": {"required": True},
    "superseded_by": {"pattern": ID},
    "source": {"required": True},
    "source.url": {"pattern": URL},
    "source.fetched_at": {"pattern": STAMP},
    "source.content_hash": {"pattern": HASH},
    "last_verified": {"required": True},
    "verified_by": {"required": True, "enum": ("human", "automated")},
}
PENALTY_SHAPE = {
    "id": {"required": True, "pattern": PENALTY_ID},
    "decision_no": {"required": True, "min": 4},
    "party": {"required": True, "min": 2},
    "party_type": {"enum": ("institution", "individual", "unknown")},
    "violation_type": {"required": True, "min": 2},
    "penalty_content": {"required": True, "min": 2},
    "authority": {"required": True, "min": 2},
    "verified_by": {"required": True, "enum": ("human", "automated")},
}


def duplicates(rows: DataFrame, key: str = "id", order: str = "path") -> tuple[DataFrame, DataFrame]:
    """The first row of each key, and an issue for each further one."""
    counted = rows.groupBy(key).agg(F.min(order).alias("__first"), F.count(F.lit(1)).alias("__n"))
    joined = rows.join(counted, key)
    first = joined.filter(F.col(order) == F.col("__first")).dropDuplicates([key]).select(*rows.columns)
    extra = counted.filter(F.col("__n") > 1).select(F.col(key).cast("string").alias("record_id"), F.lit("duplicate_id").alias("rule"), F.lit("error").alias("severity"), (F.col("__n") - 1).alias("extra_rows"))
    return first, extra


def edges(p: DataFrame) -> DataFrame:
    """(id, kind, target) of superseded_by, supersedes, amends and amended_by; direct pointers only."""
    one = F.transform(F.filter(F.array("superseded_by"), lambda t: t.isNotNull()), lambda t: F.struct(F.lit("superseded_by").alias("kind"), t.alias("target")))
    many = [_pointers(c) for c in ("supersedes", "amends", "amended_by")]
    return p.select("id", F.inline(F.concat(one, *many)))


def _pointers(kind: str) -> Column:
    return F.transform(F.coalesce(F.col(kind), F.array().cast("array<string>")), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("target")))


def dangling(p: DataFrame) -> DataFrame:
    """References to records that don't exist."""
    return edges(p).join(p.select(F.col("id").alias("target")).distinct(), "target", "left_anti").select("id", "kind", "target")


def unclosed(p: DataFrame) -> DataFrame:
    """superseded_by pointers to existing records that don't point back by supersedes."""
    e = edges(p)
    by = e.filter("kind = 'superseded_by'").join(p.select(F.col("id").alias("target")).distinct(), "target", "left_semi")
    back = e.filter("kind = 'supersedes'").select(F.col("id").alias("target"), F.col("target").alias("id")).distinct()
    return by.join(back, ["id", "target"], "left_anti").select("id", "target")


def self_references(p: DataFrame) -> DataFrame:
    return edges(p).filter(F.col("kind").isin("supersedes", "superseded_by") & (F.col("id") == F.col("target"))).select("id", "kind")


def penalty_references(e: DataFrame, p: DataFrame) -> DataFrame:
    """References of penalties to policies that don't exist."""
    refs = e.select("id", F.explode("related_policies").alias("target"))
    return refs.join(p.select(F.col("id").alias("target")).distinct(), "target", "left_anti").select("id", "target")


def issuer_references(sources: DataFrame, issuers: DataFrame) -> DataFrame:
    """Sources whose issuer isn't registered."""
    return sources.join(issuers.select(F.col("code").alias("issuer_code")).distinct(), "issuer_code", "left_anti").select("id", "issuer_code")


def registry_issues(sources: DataFrame) -> DataFrame:
    """Enabled sources that aren't manual need a list address."""
    return _issues(sources, [("list_url_missing", "error", F.col("enabled") & (F.col("fetcher") != "manual") & (F.coalesce(F.col("list_url"), F.lit("")) == ""))])


def registry_summary(sources: DataFrame) -> DataFrame:
    manual = F.col("fetcher") == "manual"
    return sources.agg(F.count_if(F.col("enabled") & ~manual).alias("automatic"), F.count_if(manual).alias("manual"), F.count_if(~F.col("enabled") & ~manual).alias("not_enabled"))


def date_issues(rows: DataFrame, key: str, dates: dict[str, bool]) -> tuple[DataFrame, DataFrame]:
    """Rows whose date texts became dates, and the issues: a text that is no date, and a required date (True) that is missing."""
    out, rules = rows, []
    for c, required in dates.items():
        text = F.coalesce(F.trim(F.col(c)), F.lit(""))
        rules.append((f"{c}:not_a_date", "error", (text != "") & S.coerced_date(F.col(c)).isNull()))
        if required:
            rules.append((f"{c}:required", "error", text == ""))
        out = out.withColumn(c, S.coerced_date(F.col(c)))
    return out, _issues(rows.withColumn("id", F.col(key)), rules)


def registry_tables(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Issuers and sources of registry files (path, issuers, sources), and issues: further rows of a code or id, unknown issuers, missing addresses.

    The first by path and place wins.
    """
    issuers = files.select("path", F.posexplode("issuers").alias("at", "i")).select(F.format_string("%s#%09d", "path", "at").alias("path"), "i.*")
    sources = files.select("path", F.posexplode("sources").alias("at", "s")).select(F.format_string("%s#%09d", "path", "at").alias("path"), "s.*")
    issuers, twice = duplicates(issuers, "code", "path")
    sources, more = duplicates(sources, "id", "path")
    unknown = issuer_references(sources, issuers).select(F.col("id").alias("record_id"), F.lit("unknown_issuer").alias("rule"), F.lit("error").alias("severity"))
    extra = twice.unionByName(more).select("record_id", "rule", "severity")
    return issuers, sources, extra.unionByName(unknown).unionByName(registry_issues(sources).select("record_id", "rule", "severity"))


def split(issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    return issues.filter("severity = 'error'"), issues.filter("severity = 'warning'")


def repository_report(policies: DataFrame, penalties: DataFrame, as_of: str) -> DataFrame:
    """All findings of a repository: (record_id, rule, severity), stale records as `stale`."""
    as_issue = lambda df, rule, severity="error": df.select(F.col("id").alias("record_id"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))
    parts = [
        policy_issues(policies),
        penalty_issues(penalties),
        as_issue(dangling(policies), "dangling_reference"),
        as_issue(unclosed(policies), "unclosed_reference"),
        as_issue(self_references(policies), "self_reference"),
        as_issue(penalty_references(penalties, policies), "penalty_reference"),
        as_issue(stale_records(policies, as_of), "stale", "stale"),
    ]
    return reduce(DataFrame.unionByName, parts)
