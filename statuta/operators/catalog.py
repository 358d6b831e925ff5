"""Catalog questions: listing, search, statistics, facets, timelines and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .diffing import VALID

TERMINAL = ("repealed", "superseded", "expired")
# fixed values: labels and tones of codes
STATUS_LABELS = {"draft": "起草中", "consultation": "征求意见", "published": "已公布未生效", "effective": "现行有效", "partially_effective": "部分有效", "amended": "已修订", "repealed": "已废止", "superseded": "已被取代", "expired": "已失效", "unknown": "状态待核验"}
STATUS_TONES = {"draft": "pending", "consultation": "pending", "published": "pending", "effective": "ok", "partially_effective": "ok", "amended": "ok", "repealed": "dead", "superseded": "dead", "expired": "dead", "unknown": "warn"}
BINDING_LABELS = {"binding": "强制义务", "soft-law": "软法（有事实约束力）", "guidance": "倡导性", "consultation": "征求意见（无义务）"}
RELEVANCE_LABELS = {"core": "核心", "related": "相关", "background": "背景"}
OBLIGATION_LABELS = {"prohibition": "禁止", "mandatory": "强制要求", "requires-approval": "需审批", "requires-reporting": "需报告", "requires-recordkeeping": "需留痕", "requires-assessment": "需评估", "encouraged": "鼓励"}
CHANGE_LABELS = {"new": "首次收录", "content_changed": "正文变更", "metadata_changed": "元数据变更", "status_changed": "状态变更", "discovered": "待录入"}
SIGNIFICANCE_LABELS = {"high": "重要", "medium": "一般", "low": "次要"}


def label(c: Column, labels: dict[str, str]) -> Column:
    """The label of a code; an unknown code is its own label."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[c], c)


def is_valid(c: str = "status") -> Column:
    return F.col(c).isin(*VALID)


def is_terminal(c: str = "status") -> Column:
    return F.col(c).isin(*TERMINAL)


def listing(p: DataFrame, statuses=None, effective_only: bool = False, issuer_code=None, relevance=None, topics=None) -> DataFrame:
    """Records that pass every filter given, newest first."""
    if statuses:
        p = p.filter(F.col("status").isin(*statuses))
    if effective_only:
        p = p.filter(is_valid())
    if issuer_code:
        p = p.filter(F.col("issuer_code") == issuer_code)
    if relevance:
        p = p.filter(F.col("ai_relevance") == relevance)
    if topics:
        p = p.filter(F.arrays_overlap("topics", F.array(*[F.lit(t) for t in topics])))
    return p.orderBy(F.desc("published_on"), "id")


def by_id(p: DataFrame, record_id: str) -> DataFrame:
    return p.filter(F.col("id") == record_id)


def search_blob(p: DataFrame) -> Column:
    """Lower-cased text that a search looks in."""
    return F.lower(F.concat_ws(" ", "title", "issuer", "issuer_code", "summaries", "topics", "domain"))


def search(p: DataFrame, query: str, **equal: str) -> DataFrame:
    """Records that contain every word of the query and equal the given columns; an empty query finds all. Reads every record."""
    return _verified(p, query, equal)


def _verified(p: DataFrame, query: str, equal: dict[str, str]) -> DataFrame:
    out = p.withColumn("__blob", search_blob(p))
    for term in query.lower().split():
        out = out.filter(F.contains("__blob", F.lit(term)))
    for column, value in equal.items():
        out = out.filter(F.col(column) == value)
    return out.drop("__blob")


GRAM, GRAM_BUCKETS = 3, 64
#: Behind each text, so that its last letters are in grams too.
PAD = "\x02\x03"


def gram_bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_BUCKETS)).cast("int")


def write_postings(p: DataFrame, folder: str) -> None:
    """A posting table of the grams of three letters in every record's text, in folders by hash of
    the gram, and the grams themselves in a second, small table."""
    text = F.concat(F.coalesce(search_blob(p), F.lit("")), F.lit(PAD))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("t") - GRAM + 1), lambda i: F.substring("t", i, F.lit(GRAM))))
    rows = p.select("id", text.alias("t")).filter(F.length("t") >= GRAM).select("id", F.explode(grams).alias("gram")).withColumn("bucket", gram_bucket(F.col("gram")))
    # a gram that most records have is dealt over several files of its bucket
    rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{folder}/postings")
    rows.sparkSession.read.parquet(f"{folder}/postings").groupBy("gram", "bucket").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/grams")


def search_postings(p: DataFrame, folder: str, query: str, **equal: str) -> DataFrame:
    """What search() finds, by the postings of p's records that write_postings() wrote.

    Of a word of three letters or more the rarest grams are looked up, each in its own folder; a
    shorter word is looked up by all grams that hold it. The records that all words lead to are
    compared with the query itself. Records without id aren't found.
    """
    spark, terms = p.sparkSession, list(dict.fromkeys(query.lower().split()))
    if not terms:
        return _verified(p, query, equal)
    vocabulary, postings = spark.read.parquet(f"{folder}/grams"), spark.read.parquet(f"{folder}/postings")
    found = None
    for term in terms:
        if len(term) >= GRAM:
            grams = [term[i : i + GRAM] for i in range(len(term) - GRAM + 1)]
            there = {r["gram"]: (r["n"], r["bucket"]) for r in vocabulary.filter(F.col("gram").isin(grams)).collect()}
            if len(there) < len(set(grams)):
                return p.limit(0)  # a gram that no record has
            rare = sorted(there, key=there.get)[:RAREST]
            buckets = sorted({there[g][1] for g in rare})
            hits = postings.filter(F.col("bucket").isin(buckets) & F.col("gram").isin(rare)).groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(rare)).select("id")
        else:
            holding = vocabulary.filter(F.contains("gram", F.lit(term))).select("bucket", "gram")
            hits = postings.join(holding, ["bucket", "gram"], "left_semi").select("id").distinct()
        found = hits if found is None else found.join(hits, "id", "left_semi")
    return _verified(p.join(found, "id", "left_semi"), query, equal)


#: Grams of a word that are looked up.
RAREST = 4


def stats(p: DataFrame) -> DataFrame:
    return p.agg(F.count(F.lit(1)).alias("total"), F.count_if(is_valid()).alias("currently_valid"), F.countDistinct(F.when(F.col("issuer_code") != "", F.col("issuer_code"))).alias("issuers"), F.count_if(F.col("status") == "unknown").alias("unknown_status"))


def facets(p: DataFrame) -> DataFrame:
    """(facet, value, name): issuers with the name of their newest record, statuses and relevances."""
    newest = p.filter(F.col("issuer_code").isNotNull()).groupBy("issuer_code").agg(F.max(F.struct("published_on", "id", "issuer")).alias("m"))
    parts = [newest.select(F.lit("issuer").alias("facet"), F.col("issuer_code").alias("value"), F.col("m.issuer").alias("name"))]
    for facet, column, labels in (("status", "status", STATUS_LABELS), ("relevance", "ai_relevance", RELEVANCE_LABELS)):
        parts.append(p.select(F.col(column).alias("value")).filter("value is not null").distinct().select(F.lit(facet).alias("facet"), "value", label(F.col("value"), labels).alias("name")))
    return parts[0].union(parts[1]).union(parts[2])


def date_state(p: DataFrame) -> Column:
    """The effective date as text: the date, to be verified for a valid record, else not in force."""
    return F.when(F.col("effective_from").isNotNull(), F.date_format("effective_from", "yyyy-MM-dd")).when(is_valid(), "to be verified").otherwise("not in force")


def site_view(p: DataFrame) -> DataFrame:
    """Records with what is derived for publication."""
    return p.withColumn("derived", F.struct(label(F.col("status"), STATUS_LABELS).alias("status_label"), label(F.col("status"), STATUS_TONES).alias("tone"), F.coalesce(is_valid(), F.lit(False)).alias("is_currently_valid"), F.concat(F.lit("policies/"), "id", F.lit(".html")).alias("page")))


def timeline(v: DataFrame) -> DataFrame:
    """Versions (id, versions) one by one in ascending order, with the span each applied; of equal numbers by dates, then status."""
    open_end = F.lit("9999-12-31").cast("date")
    keyed = F.transform("versions", lambda x: F.struct(x["version"], x["effective_from"], F.coalesce(x["effective_until"], open_end), x["status"], x.alias("v")))
    ordered = F.transform(F.array_sort(keyed), lambda x: x["v"])
    out = v.select("id", F.posexplode(ordered).alias("place", "v"))
    span = F.concat(F.coalesce(F.date_format("v.effective_from", "yyyy-MM-dd"), F.lit("?")), F.lit(" – "), F.coalesce(F.date_format("v.effective_until", "yyyy-MM-dd"), F.lit("")))
    return out.select("id", "place", "v.version", "v.status", span.alias("span"))


def latest_version(v: DataFrame) -> DataFrame:
    """The version with the greatest number; null without versions."""
    return v.select("id", F.array_max(F.transform("versions", lambda x: x["version"])).alias("latest_version"), F.size("versions").alias("n_versions"))


def record_counts(p: DataFrame) -> DataFrame:
    """Per record its obligations and versions, 0 for none, with the labels of its binding force and of its obligations' types."""
    types = F.array_sort(F.array_distinct(F.transform(F.coalesce("key_obligations.obligation_type", F.array().cast("array<string>")), lambda t: F.coalesce(label(t, OBLIGATION_LABELS), F.lit("未分类")))))
    return p.select("id", F.greatest(F.coalesce(F.size("key_obligations"), F.lit(0)), F.lit(0)).alias("n_obligations"), F.greatest(F.coalesce(F.size("versions"), F.lit(0)), F.lit(0)).alias("n_versions"), label(F.col("bindingness"), BINDING_LABELS).alias("binding_label"), types.alias("type_labels"))


def version_as_of(v: DataFrame, day: str) -> DataFrame:
    """The version of each record that applied on a day: in force from no later, until after it or open; of several the latest."""
    d = F.lit(day).cast("date")
    rows = v.select("id", F.inline("versions"))
    on = rows.filter((F.col("effective_from") <= d) & (F.col("effective_until").isNull() | (F.col("effective_until") > d)))
    return on.groupBy("id").agg(F.max_by(F.struct("version", "status", "effective_from"), "version").alias("v")).select("id", "v.*")


def version_spans(v: DataFrame) -> DataFrame:
    """(id, day, applies) for each day on which what applies to a record changes: the version from then on, null for none.

    v: (id, versions). Of versions that apply on a day the one with the greatest number counts, of
    equal numbers the one in force later. Versions of a record are a short list.
    """
    rows = v.select("id", F.filter("versions", lambda x: x["effective_from"].isNotNull()).alias("versions"))
    days = F.array_sort(F.array_distinct(F.concat(F.transform("versions", lambda x: x["effective_from"]), F.array_compact(F.transform("versions", lambda x: x["effective_until"])))))
    rows = rows.select("id", "versions", F.explode(days).alias("day"))
    on = F.filter("versions", lambda x: (x["effective_from"] <= F.col("day")) & (x["effective_until"].isNull() | (x["effective_until"] > F.col("day"))))
    best = F.array_max(F.transform(on, lambda x: F.struct(x["version"].alias("version"), x["effective_from"].alias("effective_from"), x["status"].alias("status"))))
    return rows.select("id", "day", best.alias("applies"))


def versions_as_of(v: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (id, day, ...) with the version that applied to each record on each day: version, status, since.

    Null where none applied, the record is unknown, or id or day is null. An as-of join: the
    changes of each record and the days asked for lie in one order, and each day takes the last
    change before or on it. A record's days are asked for once, however many requests name them,
    so no more rows of a record come together than there are days.
    """
    asked = requests.select("id", "day").filter("id is not null and day is not null").distinct()
    changes = version_spans(v).select("id", "day", F.struct("applies").alias("change"))
    both = changes.unionByName(asked.withColumn("change", F.lit(None).cast(changes.schema["change"].dataType)))
    # on one day the change comes first
    order = Window.partitionBy("id").orderBy("day", F.col("change").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    known = both.withColumn("last", F.last("change", ignorenulls=True).over(order)).filter("change is null")
    known = known.select("id", "day", F.col("last.applies.version").alias("version"), F.col("last.applies.status").alias("status"), F.col("last.applies.effective_from").alias("since"))
    return requests.join(known, ["id", "day"], "left")


def relations(p: DataFrame, e: DataFrame) -> DataFrame:
    """Relation edges with the title of the record they point to, null if there is none."""
    return e.join(p.select(F.col("id").alias("target"), F.col("title").alias("target_title")), "target", "left").select("id", "kind", "target", "target_title")
