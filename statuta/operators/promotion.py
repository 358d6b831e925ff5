"""Applying reviewed decisions: gates, changes, roll-back and the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import schemas
from ..tables import written
from . import reach, validation


def last_decisions(decisions: DataFrame) -> DataFrame:
    """Of each record and check the latest decision; of equal times the greatest option."""
    return decisions.groupBy("policy_id", "check_id").agg(F.max(F.struct("ts", "option_key")).alias("d")).select("policy_id", "check_id", "d.option_key", "d.ts")


def valid_decisions(decisions: DataFrame, checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decisions whose check and option exist, with the option's action, and the others."""
    offered = checks.select("policy_id", "check_id", F.explode("options").alias("o")).select("policy_id", "check_id", F.col("o.key").alias("option_key"), F.col("o").alias("action"))
    keys = ["policy_id", "check_id", "option_key"]
    return decisions.join(offered, keys), decisions.join(offered, keys, "left_anti")


def blocked(checks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pending checks without a decision."""
    return checks.filter("status != 'ok'").join(decisions.select("policy_id", "check_id").distinct(), ["policy_id", "check_id"], "left_anti").select("policy_id", "check_id", "status")


def gate(drafts: DataFrame, checks: DataFrame, decisions: DataFrame, published: DataFrame, mode: str = "human") -> DataFrame:
    """Per draft promote, blocked or exists. In human mode every pending check needs a decision."""
    open_ = blocked(checks, decisions).groupBy("policy_id").agg(F.count(F.lit(1)).alias("open"))
    there = published.select(F.col("id").alias("policy_id"), F.lit(True).alias("there")).distinct()
    out = drafts.select(F.col("id").alias("policy_id")).join(open_, "policy_id", "left").join(there, "policy_id", "left")
    outcome = F.when(F.col("there"), "exists").when((F.col("open") > 0) & F.lit(mode == "human"), "blocked").otherwise("promote")
    return out.select("policy_id", F.coalesce("open", F.lit(0)).alias("open_checks"), outcome.alias("outcome"))


NO_DECISIONS = "array<struct<ts:string,check_id:string,option_key:string,action:struct<key:string,label:string,kind:string,field:string,value:string,index:int>>>"


def decided_drafts(drafts: DataFrame, decided: DataFrame) -> DataFrame:
    """Drafts with their valid decisions applied, and with decisions (in order of time, then check) and changes, what was changed in words.

    A date is set or cleared, obligation types are set, obligations are dropped by index, all at
    once at the end; an index that no obligation has changes nothing. An acknowledgement changes
    nothing. decided: valid decisions with ts and action.
    """
    of = decided.groupBy(F.col("policy_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ts", "check_id", "option_key", "action"))).alias("decisions"))
    out = drafts.join(of, "id", "left").withColumn("decisions", F.coalesce("decisions", F.array().cast(NO_DECISIONS)))
    action, there = lambda m: m["action"], lambda i: (i >= 0) & (i < F.coalesce(F.size("key_obligations"), F.lit(0)))
    is_date = lambda m: (action(m)["kind"] == "set-field") & (action(m)["field"] == "effective_from")
    is_type = lambda m: (action(m)["kind"] == "set-obligation-type") & there(action(m)["index"])
    clause = lambda i: F.concat(F.lit("obligation "), F.coalesce(F.get("key_obligations", i)["clause"], F.lit("?")))
    said = F.transform(
        "decisions",
        lambda m: F.when(is_date(m), F.when(F.coalesce(action(m)["value"], F.lit("")) != "", F.concat(F.lit("effective_from → "), action(m)["value"])).otherwise("effective_from cleared")).when(is_type(m), F.concat(clause(action(m)["index"]), F.lit(": type → "), action(m)["value"])),
    )
    drops = F.reverse(F.array_sort(F.array_distinct(F.filter(F.transform(F.filter("decisions", lambda m: action(m)["kind"] == "drop-obligation"), lambda m: action(m)["index"]), there))))
    out = out.withColumns({"changes": F.concat(F.array_compact(said), F.transform(drops, lambda i: F.concat(clause(i), F.lit(" dropped")))), "__drops": drops})
    last_date = F.element_at(F.filter("decisions", is_date), -1)
    date = F.when(F.size(F.filter("decisions", is_date)) > 0, F.when(F.coalesce(action(last_date)["value"], F.lit("")) != "", action(last_date)["value"].cast("date"))).otherwise(F.col("effective_from"))
    types = F.filter("decisions", is_type)
    last = lambda i: action(F.get(F.reverse(F.filter(types, lambda m: action(m)["index"] == i)), 0))["value"]
    typed = F.transform("key_obligations", lambda o, i: o.withField("obligation_type", F.coalesce(last(i), o["obligation_type"])))
    kept = F.filter(typed, lambda o, i: ~F.array_contains("__drops", i))
    return out.withColumns({"effective_from": date, "key_obligations": kept}).drop("__drops")


def noted(drafts: DataFrame, checks: DataFrame | None, day: str, mode: str) -> DataFrame:
    """Stamped drafts with decisions and changes: who verified them, on which day, and a note of why.

    By hand the note has the labels of the decisions, the changes, and of each check that isn't
    ok its layer, summary and the first 200 characters of its first evidence. Promoted
    automatically a record stays automated, and its note has every check that isn't ok, or all
    checks, if all are.
    """
    if checks is None:
        rows = drafts.withColumn("seen", F.array().cast("array<struct<pos:int,check_id:string,layer:string,status:string,summary:string,evidence:string>>"))
    else:
        of = checks.groupBy(F.col("policy_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("pos", "check_id", "layer", "status", "summary", F.substring(F.get("evidence", 0), 1, 200).alias("evidence")))).alias("seen"))
        rows = drafts.join(of, "id", "left")
    seen = F.coalesce(F.col("seen"), F.array().cast("array<struct<pos:int,check_id:string,layer:string,status:string,summary:string,evidence:string>>"))
    rows = rows.withColumn("seen", seen).withColumn("open", F.filter("seen", lambda c: c["status"] != "ok"))
    joined = lambda parts, none: F.when(F.size(parts) > 0, F.array_join(parts, "；")).otherwise(none)
    labels = F.transform("decisions", lambda m: F.coalesce(m["action"]["label"], m["option_key"]))
    excerpt = F.transform("open", lambda c: F.concat(F.lit("["), c["layer"], F.lit("] "), c["summary"], F.when(c["evidence"] != "", F.concat(F.lit("｜evidence: "), c["evidence"])).otherwise("")))
    by_hand = F.concat(F.lit(f"{day} verified by hand and promoted. Decisions: "), joined(labels, "none needed, all checks are ok"), F.lit(". Changes: "), joined(F.col("changes"), "none"), F.lit("."), F.when(F.size("open") > 0, F.concat(F.lit(" Evidence: "), F.array_join(excerpt, "；"))).otherwise(""))
    green = (F.size("seen") > 0) & (F.size("open") == 0)
    all_seen = F.transform("seen", lambda c: F.concat(F.lit("["), c["layer"], F.lit("] "), c["summary"]))
    not_ok = F.transform("open", lambda c: F.concat(F.lit("["), c["layer"], F.lit("/"), c["status"], F.lit("] "), c["summary"]))
    grade = F.when(green, "all checks are ok").otherwise(F.concat(F.size("open").cast("string"), F.lit(" checks are not ok")))
    by_machine = F.concat(F.lit(f"{day} "), grade, F.lit(", promoted automatically, not verified by hand. Evidence: "), F.when(green, F.array_join(all_seen, "；")).otherwise(F.array_join(not_ok, "；")))
    stamp = {"last_verified": F.lit(day).cast("date"), "verified_note": by_hand if mode == "human" else by_machine, "evidence_excerpt_count": F.size("open")}
    if mode == "human":
        stamp["verified_by"] = F.lit("human")
    return rows.withColumns(stamp).drop("seen", "open")


def apply_decisions(drafts: DataFrame, decided: DataFrame, day: str, mode: str = "human", checks: DataFrame | None = None) -> DataFrame:
    """Drafts with their decisions applied and stamped, in the drafts' own columns. See decided_drafts() and noted()."""
    return noted(decided_drafts(drafts, decided), checks, day, mode).select(*drafts.columns)


def promote(ready: DataFrame, issues: DataFrame) -> DataFrame:
    """Per candidate promoted or rolled_back: a record with an error of its own doesn't go in, the others do."""
    bad = issues.filter("severity = 'error'").groupBy(F.col("record_id").alias("id")).agg(F.count(F.lit(1)).alias("errors"))
    return ready.select("id").join(bad, "id", "left").select("id", F.coalesce("errors", F.lit(0)).alias("errors"), F.when(F.col("errors") > 0, "rolled_back").otherwise("promoted").alias("outcome"))


def promote_into(candidates: DataFrame, published: DataFrame) -> DataFrame:
    """Per candidate promoted or rolled_back, by what the repository with all candidates says.

    A candidate is rolled back for errors of its own, for references to nothing, to itself or to
    a record that doesn't point back, for published records that point to it without its pointing
    back, and for references to a candidate that is rolled back. Errors that the published
    records had before count for nothing.
    """
    pointers = ["superseded_by", "supersedes", "amends", "amended_by"]
    whole = written(published.select("id", *pointers).withColumn("new", F.lit(False)).unionByName(candidates.select("id", *pointers).withColumn("new", F.lit(True))))
    ids = written(whole.groupBy("id").agg(F.max("new").alias("new")))
    edges = written(validation.edges(whole))
    known = edges.join(ids.select(F.col("id").alias("target"), F.col("new").alias("to_new")), "target", "left")
    known = written(known.join(ids.withColumnRenamed("new", "from_new"), "id"))
    own = validation.policy_issues(candidates).filter("severity = 'error'").select(F.col("record_id").alias("id"))
    lost = known.filter("from_new and (to_new is null or (id = target and kind in ('superseded_by', 'supersedes')))").select("id")
    back = edges.filter("kind = 'supersedes'").select(F.col("id").alias("target"), F.col("target").alias("id")).distinct()
    unclosed = known.filter("kind = 'superseded_by' and to_new is not null").join(back, ["id", "target"], "left_anti")
    # the candidate at either end is to blame; the one that points, if both are
    blamed = unclosed.filter("from_new or to_new").select(F.when(F.col("from_new"), F.col("id")).otherwise(F.col("target")).alias("id"))
    bad = reach.leading_to(known.filter("from_new and to_new"), own.union(lost).union(blamed).distinct())
    return candidates.select("id").join(bad.withColumn("bad", F.lit(True)), "id", "left").select("id", F.when(F.col("bad"), "rolled_back").otherwise("promoted").alias("outcome"))


def batch_outcome(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def reject(drafts: DataFrame, requests: DataFrame, rejected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Drafts left in the queue, and requests refused, with why: no reason, no draft, or exists.

    rejected: records rejected before (id). A rejection that would overwrite one is refused, and
    its draft stays.
    """
    there = drafts.select(F.col("id").alias("policy_id"), F.lit(True).alias("__draft")).distinct()
    asked = requests.join(there, "policy_id", "left")
    if rejected is None:
        asked = asked.withColumn("__before", F.lit(None).cast("boolean"))
    else:
        asked = asked.join(rejected.select(F.col("id").alias("policy_id"), F.lit(True).alias("__before")).distinct(), "policy_id", "left")
    why = F.when(F.trim(F.coalesce("reason", F.lit(""))) == "", "no reason").when(F.col("__draft").isNull(), "no draft").when(F.col("__before").isNotNull(), "exists")
    asked = asked.withColumn("why", why).drop("__draft", "__before")
    left = drafts.join(asked.filter("why is null").select(F.col("policy_id").alias("id")).distinct(), "id", "left_anti")
    return left, asked.filter("why is not null")


def review_queue(checks: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per record the checks that wait, by status, and whether the ledger's last end state is promoted or rejected."""
    n = lambda s: F.count_if(F.col("status") == s)
    queue = checks.groupBy("policy_id").agg(n("error").alias("errors"), n("warning").alias("warnings"), n("manual").alias("manuals"))
    end = ledger.filter(F.col("kind").isin("promote", "reject", "rollback")).groupBy("policy_id").agg(F.max(F.struct("ts", "kind")).alias("e"))
    out = queue.join(end, "policy_id", "left")
    return out.select("policy_id", "errors", "warnings", "manuals", F.coalesce(F.col("e.kind") == "promote", F.lit(False)).alias("done"), F.coalesce(F.col("e.kind") == "reject", F.lit(False)).alias("rejected"))


def _ledger(rows: DataFrame) -> DataFrame:
    """Rows in the ledger's columns, null where a kind of row has none."""
    fields = T.StructType.fromDDL(schemas.LEDGER).fields
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields])


def decision_rows(decided: DataFrame, checks: DataFrame) -> DataFrame:
    """A ledger row for each valid decision (with ts and action): its label, and as evidence the check's summary with the first 150 characters of its first evidence."""
    first = F.substring(F.get("evidence", 0), 1, 150)
    seen = checks.select("policy_id", "check_id", F.concat("summary", F.when(F.coalesce(first, F.lit("")) != "", F.concat(F.lit("｜"), first)).otherwise("")).alias("evidence"))
    rows = decided.join(seen, ["policy_id", "check_id"], "left")
    return _ledger(rows.select("ts", F.lit("decision").alias("kind"), "policy_id", "check_id", "option_key", F.col("action.label").alias("label"), "evidence"))


def promotion_rows(promoted: DataFrame, ts: str, mode: str) -> DataFrame:
    """A ledger row for each promoted draft (id, decisions, changes, evidence_excerpt_count): what was decided and changed, and where its card is kept."""
    made = F.transform("decisions", lambda m: F.struct(m["check_id"].alias("check_id"), m["option_key"].alias("option_key"), m["action"]["label"].alias("label")))
    card = F.concat(F.lit(f"cards/promoted_on={ts[:10]}/"), "id")
    return _ledger(promoted.select(F.lit(ts).alias("ts"), F.lit("promote").alias("kind"), F.col("id").alias("policy_id"), F.lit(mode).alias("mode"), made.alias("decisions"), "changes", "evidence_excerpt_count", card.alias("card_path")))


def rollback_rows(outcomes: DataFrame, issues: DataFrame, ts: str, mode: str) -> DataFrame:
    """A ledger row for each candidate that was rolled back, with the rules of its own errors; the rows before it stay."""
    errors = issues.filter("severity = 'error'").groupBy(F.col("record_id").alias("id")).agg(F.array_sort(F.collect_set("rule")).alias("errors"))
    back = outcomes.filter("outcome = 'rolled_back'").join(errors, "id", "left")
    return _ledger(back.select(F.lit(ts).alias("ts"), F.lit("rollback").alias("kind"), F.col("id").alias("policy_id"), F.lit(mode).alias("mode"), F.lit("the repository with it has errors").alias("reason"), F.coalesce("errors", F.array().cast("array<string>")).alias("errors")))


def rejection_rows(requests: DataFrame, refused: DataFrame, ts: str) -> DataFrame:
    """A ledger row for each rejection that was carried out, with its reason."""
    done = requests.join(refused.select("policy_id").distinct(), "policy_id", "left_anti")
    return _ledger(done.select(F.lit(ts).alias("ts"), F.lit("reject").alias("kind"), "policy_id", F.trim("reason").alias("reason")))


def ledger_rows(outcomes: DataFrame, ts: str, mode: str) -> DataFrame:
    kind = F.when(F.col("outcome") == "promoted", "promote").when(F.col("outcome") == "rolled_back", "rollback").otherwise(F.col("outcome"))
    return outcomes.select(F.lit(ts).alias("ts"), kind.alias("kind"), F.col("id").alias("policy_id"), F.lit(mode).alias("mode"))
