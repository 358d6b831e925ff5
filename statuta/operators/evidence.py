"""Evidence checks of records against captured pages. The order of the branches is the meaning:
what couldn't be checked is manual, never passed and never an error."""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S

SIMILAR_TITLE, OVERLAP = 0.9, 0.12
LEAST_BODY = 200
# fixed values: obligation types that bind
MANDATORY_TYPES = ("mandatory", "prohibition", "requires-approval", "requires-reporting", "requires-recordkeeping", "requires-assessment")
OPTION = "struct<key:string,label:string,kind:string,field:string,value:string,index:int>"


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity by longest matching blocks; the order of the arguments matters. Null for null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def best_ratio(candidates: pd.Series, core: pd.Series) -> pd.Series:
    return pd.Series([None if cs is None else max((difflib.SequenceMatcher(None, c, core_).ratio() for c in cs), default=0.0) for cs, core_ in zip(candidates, core, strict=True)], dtype="float64")


# a filter over their results must not be moved below them
ratio, best_ratio = ratio.asNondeterministic(), best_ratio.asNondeterministic()


def ratio_bounds(a: Column, b: Column, threshold: float) -> tuple[Column, Column]:
    """Whether the ratio is surely under the threshold, and whether it surely reaches it.

    Matching blocks hold no more characters than the texts have in common, each character as
    often as in the text that has it less often. And where b is too short for frequent
    characters to be passed over, the longest block is as long as any stretch of a within b.
    Both are exact; what neither decides is compared block by block.
    """
    sizes = F.length(a) + F.length(b)
    times = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    letters = F.array_distinct(F.filter(F.split(a, ""), lambda c: c != ""))
    common = F.aggregate(letters, F.lit(0), lambda n, c: n + F.least(times(a, c), times(b, c)))
    # 2 * common / sizes < threshold, with a margin for the rounding of the quotient
    under = F.when(sizes > 0, 2.0 * F.least(F.length(a), F.length(b)) < threshold * sizes - 1e-6) | (F.when(sizes > 0, 2.0 * common < threshold * sizes - 1e-6))
    need = F.ceil((threshold * sizes + 1e-6) / 2).cast("int")
    starts = F.sequence(F.lit(1), F.length(a) - need + 1)
    inside = F.when((need >= 1) & (need <= F.length(a)), F.exists(starts, lambda i: F.contains(b, F.substring(a, i, need))))
    reaches = (F.length(b) < 200) & F.coalesce(inside, F.lit(False))
    return F.coalesce(under, F.lit(False)), F.coalesce(reaches, F.lit(False))


def option(key, kind, field=None, value=None, index=None) -> Column:
    """A choice of a check, and the action that it stands for. Its label says the key in words."""
    lit = lambda x, t: x if isinstance(x, Column) else F.lit(x).cast(t)
    label = F.translate(lit(key, "string"), ":", " ")
    return F.struct(lit(key, "string").alias("key"), label.alias("label"), lit(kind, "string").alias("kind"), lit(field, "string").alias("field"), lit(value, "string").alias("value"), lit(index, "int").alias("index"))


def said(status, summary) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(status).alias("status"), lit(summary).alias("summary"))


def _options(*options: Column) -> Column:
    return F.array(*options) if options else F.array().cast(f"array<{OPTION}>")


def is_full_text() -> Column:
    """The page holds the document: its title or number stands in the body."""
    body, title, number = S.squash(F.col("body_text")), S.squash(F.col("title")), S.squash(F.col("doc_number"))
    return F.coalesce((title != "") & F.contains(body, title), F.lit(False)) | F.coalesce((number != "") & F.contains(body, number), F.lit(False))


def reachability(r: DataFrame) -> DataFrame:
    """r: records joined with pages (status_code, error, final_url, body_text, usable). One check a record."""
    home = F.coalesce((F.col("final_url") != F.col("url")) & S.is_home_path(F.col("final_url")), F.lit(False))
    fetched = F.col("status_code").isNotNull() & F.col("error").isNull()
    changed = F.coalesce((F.col("content_hash") != "") & F.col("usable") & (S.content_hash(F.col("body_text")) != F.col("content_hash")), F.lit(False))
    finding = (
        F.when(~fetched, said("error", "not reachable"))
        .when(F.col("status_code") != 200, said("error", F.concat(F.lit("HTTP "), F.col("status_code").cast("string"))))
        .when(home, said("error", "redirected to the home page"))
        .when(changed, said("warning", "the text differs from the recorded hash"))
        .otherwise(said("ok", "reachable"))
    )
    rows = r.select("policy_id", finding.alias("f"))
    ask = F.when(F.col("f.status") != "ok", _options(option("confirm", "acknowledge", "reachability"))).otherwise(_options())
    return rows.select("policy_id", F.lit(0).alias("pos"), F.lit("reachability").alias("check_id"), F.lit("reachability").alias("layer"), "f.status", "f.summary", F.array().cast("array<string>").alias("evidence"), ask.alias("options"))


def open_titles(r: DataFrame) -> DataFrame:
    """Records with early, the outcome where containment tells, and open, the candidates that
    only a comparison block by block can decide; null where none is left."""
    core = S.squash(F.col("title"))
    rows = r.select("policy_id", core.alias("core"), "page_title", F.transform(S.title_candidates(F.col("page_title")), S.squash).alias("candidates"), S.squash(F.col("body_text")).alias("body"), is_full_text().alias("full"))
    contained = F.coalesce((F.col("core") != "") & F.exists("candidates", lambda c: F.contains(c, F.col("core")) | ((c != "") & F.contains(F.col("core"), c))), F.lit(False))
    rows = rows.withColumn("early", F.when(F.col("page_title").isNull(), "manual").when(contained, "ok"))
    near = F.filter("candidates", lambda c: ~ratio_bounds(c, F.col("core"), SIMILAR_TITLE)[0])
    rows = rows.withColumn("near", F.when(F.col("early").isNull(), near))
    return rows.withColumn("open", F.when(F.size("near") > 0, F.col("near"))).drop("near")


def titles(r: DataFrame) -> DataFrame:
    """The page title against the record's. What containment and bounds leave open is compared block by block."""
    rows = open_titles(r).withColumn("ratio", best_ratio("open", "core"))
    in_body = F.coalesce((F.col("core") != "") & F.contains("body", F.col("core")), F.lit(False))
    late = F.when(F.coalesce(F.col("ratio") >= SIMILAR_TITLE, F.lit(False)), "ok").when(in_body, "ok").when(~F.col("full"), "manual").otherwise("error")
    out = rows.withColumn("status", F.coalesce("early", late))
    ask = F.when(F.col("status") != "ok", _options(option("confirm-title", "acknowledge", "title"))).otherwise(_options())
    return out.select("policy_id", F.lit(1).alias("pos"), F.lit("title").alias("check_id"), F.lit("title").alias("layer"), "status", F.concat(F.lit("title "), "status").alias("summary"), F.array_compact(F.array("page_title")).alias("evidence"), ask.alias("options"))


def dates(r: DataFrame) -> DataFrame:
    """The effective date against what the page says about coming into force."""
    rows = r.select("policy_id", "effective_from", "usable", S.effective_dates(F.col("body_text")).alias("candidates"), S.status_hits(F.col("body_text")).alias("hits"), S.status_sentences(F.col("body_text")).alias("quotes"), is_full_text().alias("full"))
    filled, none = F.col("effective_from").isNotNull(), F.coalesce(F.col("hits"), F.lit(0)) == 0
    finding = (
        F.when(~F.coalesce(F.col("usable"), F.lit(False)), said("manual", "no usable text"))
        .when(filled & none & ~F.col("full"), said("manual", "the page isn't the document"))
        .when(filled & none, said("error", "the text has no word about coming into force"))
        .when(filled & F.array_contains("candidates", F.col("effective_from")), said("ok", "the text has the date"))
        .when(filled, said("warning", "the text has other dates"))
        .when((F.size("candidates") > 0) | ~none, said("warning", "can be filled"))
        .when(~F.col("full"), said("manual", "the page isn't the document"))
        .otherwise(said("ok", "neither the record nor the text has a date"))
    )
    rows = rows.withColumn("f", finding)
    adopt = F.transform(F.coalesce("candidates", F.array().cast("array<date>")), lambda d: option(F.concat(F.lit("adopt:"), d.cast("string")), "set-field", "effective_from", d.cast("string")))
    ask = F.when(F.col("f.status") == "manual", _options(option("confirm-date", "acknowledge", "date"))).when(F.col("f.status") == "error", _options(option("clear-date", "set-field", "effective_from"), option("keep-date", "acknowledge", "date"))).when(F.col("f.status") == "warning", F.concat(adopt, _options(option("keep-date", "acknowledge", "date")))).otherwise(_options())
    return rows.select("policy_id", F.lit(2).alias("pos"), F.lit("date").alias("check_id"), F.lit("date").alias("layer"), "f.status", "f.summary", F.coalesce("quotes", F.array().cast("array<string>")).alias("evidence"), ask.alias("options"))


def clause_index(spaces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An inverted index of texts (policy_id, rank, text): where clauses stand, and the articles.

    Each text is cut once at its articles' heads. articles: (policy_id, rank, article, at, body),
    at being the 1-based place of the article in its text. heads: (policy_id, number, rank,
    article, offset), the first place in a text of each clause number that stands there in one of
    its two usual forms, arabic or Chinese, as an article's head or in full-width brackets.
    """
    cut = spaces.select("policy_id", "rank", F.posexplode(F.split(F.coalesce("text", F.lit("")), f"(?={S.NEXT_CLAUSE})", -1)).alias("article", "body"))
    before = Window.partitionBy("policy_id", "rank").orderBy("article").rowsBetween(Window.unboundedPreceding, -1)
    articles = cut.withColumn("at", F.coalesce(F.sum(F.length("body")).over(before), F.lit(0)) + 1)
    parts = F.split(F.col("body"), f"(?={S.CLAUSE_HEAD})", -1)
    marks = cut.select("policy_id", "rank", "article", F.posexplode(parts).alias("part", "piece"))
    within = Window.partitionBy("policy_id", "rank", "article").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("offset", F.coalesce(F.sum(F.length("piece")).over(within), F.lit(0)))
    written_ = F.regexp_extract("piece", f"^{S.CLAUSE_HEAD}", 0)
    text = F.regexp_replace(written_, r"[第条（）\s]", "")
    marks = marks.select("policy_id", "rank", "article", "offset", text.alias("text"), S.number_to_int(text).alias("number")).filter((F.col("text") == F.col("number").cast("string")) | (F.col("text") == S.int_to_chinese(F.col("number"))))
    heads = marks.groupBy("policy_id", "number", "rank").agg(F.min(F.struct("article", "offset")).alias("h")).select("policy_id", "number", "rank", "h.article", "h.offset")
    return articles, heads


def found_clauses(items: DataFrame, spaces: DataFrame) -> DataFrame:
    """(policy_id, i, paragraph, rank) of items (policy_id, i, clause) whose clause stands in a text; the first text by rank counts.

    A clause with a number is looked up in the index. One without is a literal, searched for in
    the record's texts; its paragraph ends with the article that it stands in.
    """
    articles, heads = clause_index(spaces)
    asked = items.withColumn("number", S.clause_number(F.col("clause")))
    numbered = asked.filter("number is not null").join(heads, ["policy_id", "number"]).groupBy("policy_id", "i").agg(F.min(F.struct("rank", "article", "offset")).alias("h"))
    hits = numbered.select("policy_id", "i", "h.rank", "h.article", "h.offset").join(articles.select("policy_id", "rank", "article", "body"), ["policy_id", "rank", "article"])
    hits = hits.select("policy_id", "i", "rank", F.substring("body", F.col("offset").cast("int") + 1, F.length("body")).alias("paragraph"))
    literal = asked.filter("number is null").join(spaces, "policy_id").withColumn("at", F.position(S.trimmed(F.col("clause")), F.col("text"))).filter("at > 0")
    literal = literal.select("policy_id", "i", "rank", S.clause_paragraph(F.col("text"), F.col("at")).alias("paragraph")).groupBy("policy_id", "i").agg(F.min_by("paragraph", "rank").alias("paragraph"), F.min("rank").alias("rank"))
    return hits.select("policy_id", "i", "paragraph", "rank").unionByName(literal)


def obligations(r: DataFrame, spaces: DataFrame | None = None) -> DataFrame:
    """One check per obligation of r (key_obligations); records without obligations get one that is ok.

    spaces: texts of attachments (policy_id, rank from 1, status, text); the page is searched
    first, then they in order, and the first text that has the clause counts. Of no clause, an
    empty or null one is at the beginning of the first text.
    """
    rows = open_obligations(r, spaces)
    late = rows.withColumn("overlap", ratio(F.when(F.col("undecided"), F.col("summary")), F.when(F.col("undecided"), F.col("paragraph"))))
    differ = F.col("under") | F.coalesce(F.col("overlap") < OVERLAP, F.lit(False))
    must = F.col("obligation_type").isin(*MANDATORY_TYPES)
    finding = F.coalesce("early", F.when(differ, said("error", "summary and clause differ")).when(F.col("drift"), said("error", "modal words and type differ")).otherwise(said("ok", "clause found")))
    out = late.withColumn("f", finding).select("policy_id", "i", "f.status", "f.summary", "check_id", F.when(F.col("f.summary") == "modal words and type differ", F.when(must, "encouraged").otherwise("mandatory")).alias("kind"), "paragraph")
    field = F.col("check_id")
    retype = option(F.concat(F.lit("to-"), F.col("kind")), "set-obligation-type", None, F.col("kind"), F.col("i"))
    ask = F.when(F.col("status") == "ok", _options()).when(F.col("kind").isNotNull(), _options(retype, option("keep-type", "acknowledge", field))).when(F.col("status") == "error", _options(option("confirm-clause", "acknowledge", field), option("drop-obligation", "drop-obligation", None, None, F.col("i")))).otherwise(_options(option("confirm-clause", "acknowledge", field)))
    quote = F.array_compact(F.array(F.when(F.col("status") != "ok", F.col("paragraph"))))
    return out.select("policy_id", (F.col("i") + 3).alias("pos"), "check_id", F.lit("obligations").alias("layer"), "status", "summary", quote.alias("evidence"), ask.alias("options"))


def open_obligations(r: DataFrame, spaces: DataFrame | None = None) -> DataFrame:
    """A row per obligation with early, the finding where no comparison is needed, under, where
    summary and clause surely differ, and undecided, where only a comparison block by block tells."""
    pages = r.select("policy_id", F.coalesce("usable", F.lit(False)).alias("usable"), is_full_text().alias("full"), F.posexplode_outer("key_obligations").alias("i", "o"))
    rows = pages.select("policy_id", F.coalesce("i", F.lit(0)).alias("i"), F.col("i").isNull().alias("none"), "usable", "full", "o.*")
    texts = r.select("policy_id", F.lit(0).alias("rank"), F.col("body_text").alias("text"))
    if spaces is None:
        rows = rows.withColumns({"n_spaces": F.lit(0), "n_texts": F.lit(0)})
    else:
        got = spaces.groupBy("policy_id").agg(F.count(F.lit(1)).alias("n_spaces"), F.count_if(F.col("status") == "extracted").alias("n_texts"))
        rows = rows.join(got, "policy_id", "left").withColumns({"n_spaces": F.coalesce("n_spaces", F.lit(0)), "n_texts": F.coalesce("n_texts", F.lit(0))})
        texts = texts.unionByName(spaces.filter("status = 'extracted'").select("policy_id", F.col("rank").cast("int").alias("rank"), "text"))
    items = rows.filter("not none and usable").select("policy_id", "i", F.coalesce("clause", F.lit("")).alias("clause"))
    rows = rows.join(found_clauses(items, texts), ["policy_id", "i"], "left")
    missing = F.when(F.col("n_texts") > 0, "error").when(F.col("n_spaces") > 0, "manual").when(~F.col("full"), "manual").otherwise("error")
    early = F.when(F.col("none"), said("ok", "no obligations")).when(~F.col("usable"), said("manual", "no usable text")).when(F.col("paragraph").isNull(), said(missing, "clause not found"))
    soft, firm = S.any_word(F.col("paragraph"), S.SOFT_WORDS), S.any_word(F.col("paragraph"), S.MANDATORY_WORDS)
    drift = F.coalesce((soft & ~firm & F.col("obligation_type").isin(*MANDATORY_TYPES)) | (firm & ~soft & (F.col("obligation_type") == "encouraged")), F.lit(False))
    under, reaches = ratio_bounds(F.coalesce("summary", F.lit("")), F.coalesce("paragraph", F.lit("")), OVERLAP)
    rows = rows.withColumns({"early": early, "drift": drift, "summary": F.coalesce("summary", F.lit("")), "check_id": F.when(F.col("none"), "obligations").otherwise(F.concat(F.lit("obligation:"), F.col("i").cast("string")))})
    rows = rows.withColumns({"under": F.col("early").isNull() & under, "reaches": F.col("early").isNull() & reaches})
    return rows.withColumn("undecided", F.col("early").isNull() & ~F.col("under") & ~F.col("reaches"))


def checks(r: DataFrame, spaces: DataFrame | None = None) -> DataFrame:
    """All four layers of every record."""
    return reduce(DataFrame.unionByName, [reachability(r), titles(r), dates(r), obligations(r, spaces)])


def cards(all_checks: DataFrame, attachments: DataFrame | None = None) -> DataFrame:
    """Per record its checks in order, the count that is pending, and the attachments that were tried.

    attachments: (policy_id, rank, href, status, reason) of any number a record; in rank order.
    """
    one = F.struct("pos", "check_id", "layer", "status", "summary", "evidence", "options")
    out = all_checks.groupBy("policy_id").agg(F.array_sort(F.collect_list(one), lambda a, b: (a["pos"] - b["pos"]).cast("int")).alias("checks"), F.count_if(F.col("status") != "ok").alias("pending_count"))
    if attachments is None:
        return out
    found = attachments.groupBy("policy_id").agg(F.array_sort(F.collect_list(F.struct("rank", "href", "status", "reason"))).alias("attachments"))
    none = F.array().cast(found.schema["attachments"].dataType)
    return out.join(found, "policy_id", "left").withColumn("attachments", F.coalesce("attachments", none))


def cards_kept(all_checks: DataFrame, records: DataFrame, attachments: DataFrame | None = None) -> DataFrame:
    """Cards of all records: one that no check came from has a single manual row, `evidence-failure`."""
    none = records.select("policy_id").distinct().join(all_checks.select("policy_id").distinct(), "policy_id", "left_anti")
    failed = none.select("policy_id", F.lit(0).alias("pos"), F.lit("evidence-failure").alias("check_id"), F.lit("evidence").alias("layer"), F.lit("manual").alias("status"), F.lit("no check could be made").alias("summary"), F.array().cast("array<string>").alias("evidence"), _options().alias("options"))
    return cards(all_checks.unionByName(failed), attachments)


def joined_pages(records: DataFrame, pages: DataFrame, attachments: DataFrame) -> DataFrame:
    """Records with the page captured for their url and that page's attachments; without a page all its fields are null."""
    found = attachments.groupBy(F.col("page_url").alias("url")).agg(F.array_sort(F.collect_list(F.struct("rank", "href", "status", "text"))).alias("attachments"))
    return records.join(pages, "url", "left").join(found, "url", "left").withColumn("attachments", F.coalesce("attachments", F.array().cast(found.schema["attachments"].dataType)))


def tried_attachments(attachments: DataFrame, most: int = 3) -> DataFrame:
    """The first `most` attachments of each page in rank order, up to the first that was extracted."""
    ranked = attachments.withColumn("place", F.row_number().over(Window.partitionBy("page_url").orderBy("rank"))).filter(F.col("place") <= most)
    first = ranked.filter("status = 'extracted'").groupBy("page_url").agg(F.min("place").alias("first"))
    return ranked.join(first, "page_url", "left").filter(F.col("first").isNull() | (F.col("place") <= F.col("first"))).drop("first")


def counts(all_checks: DataFrame) -> DataFrame:
    """Per record the checks by status, and whether all are ok."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = all_checks.groupBy("policy_id").agg(n("ok").alias("n_ok"), n("warning").alias("n_warning"), n("error").alias("n_error"), n("manual").alias("n_manual"))
    return out.withColumn("all_green", (F.col("n_ok") > 0) & (F.col("n_warning") + F.col("n_error") + F.col("n_manual") == 0))


def attachment_state(a: DataFrame) -> DataFrame:
    """unsupported, failed or extracted; a has extension, status_code, size and text."""
    reason = F.when(F.col("status_code") != 200, F.concat(F.lit("HTTP "), F.col("status_code").cast("string"))).when(F.col("size") > 10 * 1024 * 1024, "too large").when(F.coalesce(F.col("text"), F.lit("")) == "", "no text")
    return a.withColumn("status", F.when(F.col("extension") == "doc", "unsupported").when(reason.isNotNull(), "failed").otherwise("extracted")).withColumn("reason", F.when(F.col("status") == "failed", reason))
