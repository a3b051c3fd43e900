"""What people and gates decide: classification, quarantine, findings, decisions, what they are bound to, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import hashing, injection, scoping
from ledgerloom.operators import ranges
from ledgerloom.operators.relational import scoped_key
from ledgerloom.sources.shared import written

# What a document may be called, from what confidence on it need not be asked, and severities in order.
DOC_TYPES = ("master_agreement", "amendment", "invoice", "sow", "purchase_order", "policy", "unknown")
LEAST_CONFIDENCE = 0.70
SEVERITY_ORDER = ("blocker", "major", "minor", "info")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITY_ORDER)), severity).cast("int")


def classified(documents: DataFrame, answers: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """documents (document_id, doc_type, confidence) with proceeds and final_type: their own if sure enough, else what a
    person answered (document_id, answer) if that is a type, else null."""
    proceeds = F.coalesce(F.col("confidence") >= least, F.lit(False))
    rows = documents.join(answers.where(F.col("answer").isin(*DOC_TYPES)), "document_id", "left")
    return rows.withColumn("proceeds", proceeds).withColumn("final_type", F.when(proceeds, F.col("doc_type")).otherwise(F.col("answer")))


def quarantined(blocks: DataFrame) -> DataFrame:
    """blocks with signals, flagged and warning: a block that speaks to the reader's model is set aside with one warning."""
    rows = blocks.withColumn("_clean", injection.normalise(F.col("text"))).withColumn("_s", injection.scan_of(F.col("_clean"), F.col("text")))
    flagged = injection.suspicious(F.col("text"))
    warning = F.when(F.col("_s.suspicious"), F.concat(F.lit("block "), F.col("block_index").cast("string"), F.lit(" set aside: "), injection.describe(F.col("_s.signals"))))
    return rows.select(*blocks.columns, F.col("_s.signals").alias("signals"), flagged.alias("flagged"), warning.alias("warning"))


def extractable(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """The blocks that may be extracted from, each with the scope its facts are stamped with."""
    rows = quarantined(blocks).where("not flagged").drop("signals", "flagged", "warning").join(documents.select("document_id", F.col("text").alias("_document")), "document_id")
    amends = F.col("doc_type") == "amendment"
    scope = scoping.scope(F.col("doc_type"), F.col("_document"), F.col("text"), scoping.agreement_ref(F.col("_document")), amends)
    return rows.withColumn("scope", scope).drop("_document")


def repair(attempts: DataFrame, most: int = 1) -> DataFrame:
    """document_id, n_invalid, outcome of extraction attempts (document_id, attempt, valid): stored as soon as an attempt
    has no invalid candidate, repaired if that is not the first; without one, abstained after `most` repairs."""
    tries = attempts.where(F.col("attempt") <= most).groupBy("document_id", "attempt").agg(F.count_if(~F.col("valid")).alias("bad"))
    rows = tries.groupBy("document_id").agg(F.min(F.when(F.col("bad") == 0, F.col("attempt"))).alias("good"), F.min_by("bad", "attempt").alias("n_invalid"))
    return rows.select("document_id", "n_invalid", F.when(F.col("good").isNull(), "abstained").when(F.col("good") == 0, "stored").otherwise("repaired").alias("outcome"))


def lifecycle(updates: DataFrame, key: str, columns: list[str], at: list[str]) -> DataFrame:
    """The latest value that each column was given; a null changes nothing."""
    when = F.struct(*at)
    return updates.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), when)).alias(c) for c in columns])


def route_after_source(runs: DataFrame) -> DataFrame:
    """runs with next: rederivations look for conflicts, duplicates go on to routing, others to the differences."""
    return runs.withColumn("next", F.when(F.col("rederive"), "conflicts").when(F.col("duplicate"), "route").otherwise("differences"))


def route_findings(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """runs with next: to the gate if a document of theirs has an adverse finding, else to the report."""
    adverse = findings.where("verdict <> 'pass' and target_kind = 'document'").select("run_id").distinct().withColumn("_adverse", F.lit(True))
    return runs.join(adverse, "run_id", "left").select(*runs.columns, F.when(F.col("_adverse"), "gate").otherwise("report").alias("next"))


def adverse(findings: DataFrame, target_kind: str | None = None) -> DataFrame:
    """The findings that somebody must look at, of one kind of target or of all."""
    rows = findings.where("verdict <> 'pass'")
    return rows.where(F.col("target_kind") == target_kind) if target_kind else rows


def decided(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """findings with decision and recheck: who dismisses what a rule refused has the rule run again; verdicts stay."""
    rows = findings.join(decisions, "finding_id", "left")
    return rows.withColumn("recheck", F.coalesce((F.col("decision") == "dismissed") & (F.col("verdict") != "pass"), F.lit(False)))


def cache_of(findings: DataFrame, cache: DataFrame, rechecked: DataFrame) -> DataFrame:
    """The cache (cache_key, run_id) without what a dismissal makes stale."""
    gone = rechecked.where("recheck").join(findings.select("finding_id", "cache_key"), "finding_id").select("cache_key").distinct()
    return cache.join(gone, "cache_key", "left_anti")


def reused(documents: DataFrame, order: list[str]) -> DataFrame:
    """documents (cache_key, run's own row) with reused_from and hit: the first document of a key, if that is another."""
    first, _ = written(documents.groupBy(F.col("cache_key").alias("_key")).agg(F.min_by("document_id", F.struct(*order)).alias("reused_from")), "first")
    rows = documents.join(first, F.col("cache_key").eqNullSafe(F.col("_key")), "left").drop("_key")
    return rows.withColumn("hit", F.col("document_id") != F.col("reused_from"))


def deliverable_targets(register: DataFrame, touched: DataFrame, by: list[str]) -> DataFrame:
    """collection_id, target, statement of the register rows that a run touched: label, canonical value and state."""
    value = F.to_json(F.struct(F.col("value").alias("days")), {"ignoreNullFields": "false"})
    rows = register.join(touched.select(*by).distinct(), by, "left_semi")
    return rows.select("collection_id", scoped_key().alias("target"), F.concat(scoped_key(), F.lit(" = "), value, F.lit(" ("), "state", F.lit(")")).alias("statement"))


def gate_items(collections: DataFrame, findings: DataFrame, ran: DataFrame) -> DataFrame:
    """collection_id, n_findings, gate: the findings, else one confirmation; none where no rule ran (ran: collection_id)."""
    n = findings.groupBy("collection_id").agg(F.count("*").alias("n_findings"))
    rows = collections.select("collection_id").join(n, "collection_id", "left").join(ran.select("collection_id").distinct().withColumn("_ran", F.lit(True)), "collection_id", "left")
    return rows.select("collection_id", F.coalesce("n_findings", F.lit(0)).alias("n_findings"), F.when(F.col("n_findings") > 0, "findings").when(F.col("_ran"), "deliverable_confirmation").otherwise("none").alias("gate"))


def undecided(items: DataFrame, decisions: DataFrame, key: list[str]) -> DataFrame:
    """Items that nobody decided."""
    return items.join(decisions.select(*key).distinct(), key, "left_anti")


def confirmed(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """run_id, n_undecided, outcome of each run's items (run_id, item, kind): refused while any is undecided, blocked if
    its confirmation was declined, else confirmed."""
    rows = items.join(decisions, ["run_id", "item"], "left").groupBy("run_id").agg(F.count_if(F.col("decision").isNull()).alias("n_undecided"), F.bool_or((F.col("kind") == "deliverable_confirmation") & (F.col("decision") == "rejected")).alias("declined"))
    return rows.select("run_id", "n_undecided", F.when(F.col("n_undecided") > 0, "refused").when(F.coalesce("declined", F.lit(False)), "blocked").otherwise("confirmed").alias("outcome"))


def enforced(blockers: DataFrame, overrides: DataFrame) -> DataFrame:
    """blockers (run_id, codes) with outcome: only an override of a reviewer that gives a reason lets a run pass."""
    valid = overrides.where("role = 'reviewer' and length(trim(coalesce(reason, ''))) > 0").groupBy("run_id").agg(F.min("actor").alias("overridden_by"))
    return blockers.join(valid, "run_id", "left").withColumn("outcome", F.when(F.col("overridden_by").isNotNull(), "overridden").otherwise("blocked"))


def candidate_basis(register: DataFrame, ruleset_hash: Column, by: str = "collection_id") -> DataFrame:
    """by, basis: the digest of what a candidate register says (key, value, state, version) and of its playbook; by pages
    where the register is large (ranges.digest)."""
    row = F.struct(scoped_key().alias("key"), "state", "value", "version")
    rows = register.withColumn("_key", scoped_key())
    return ranges.digest(rows, by, ["_key", "state", "value", "version"], row, "register", {"ruleset": ruleset_hash})


def bound(items: DataFrame, basis: DataFrame, ruleset_hash: Column, by: str = "collection_id") -> DataFrame:
    """items stamped with what a decision on them is bound to."""
    return items.join(basis, by, "left").withColumn("ruleset_hash", ruleset_hash)


def basis_refused(decisions: DataFrame, now: DataFrame, key: list[str]) -> DataFrame:
    """decisions (kind and supplied fields) with refused: what was decided on must be what there is now. Proposals are
    bound to version and hash, findings to basis and playbook, others to nothing."""
    rows = decisions.join(now, key, "left")
    row = ~F.col("version").eqNullSafe(F.col("supplied_version")) | ~F.col("content_hash").eqNullSafe(F.col("supplied_hash"))
    whole = ~F.col("basis").eqNullSafe(F.col("supplied_basis"))
    return rows.withColumn("refused", F.when(F.col("kind") == "proposal", row).when(F.col("kind") == "finding", whole).otherwise(False))


def install(uploads: DataFrame, by: str, order: str, content: str) -> DataFrame:
    """uploads in order with changed, version and outcome: equal content is no change; a change must name the version that
    is active (if_match), or it is stale. Versions are counted over what is installed, which depends on what was before,
    so each name's uploads are folded in order."""

    def fold(rows):
        import pandas as pd

        active, version, out = None, 0, []
        for row in rows.sort_values(order).itertuples(index=False):
            value, match = getattr(row, content), row.if_match
            changed = version == 0 or value != active
            fits = version == 0 or (match is not None and not pd.isna(match) and int(match) == version)
            if changed and fits:
                active, version = value, version + 1
            out.append((getattr(row, by), getattr(row, order), changed, version, "no_op" if not changed else "installed" if fits else "stale"))
        return pd.DataFrame(out, columns=[by, order, "changed", "version", "outcome"])

    kinds = {f.name: f.dataType.simpleString() for f in uploads.schema}
    rows = uploads.select(by, order, content, "if_match")
    return rows.groupBy(by).applyInPandas(fold, f"{by} {kinds[by]}, {order} {kinds[order]}, changed boolean, version long, outcome string")


def replaced(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of each key that new has are replaced as a whole; other keys keep theirs."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def recorded(events: DataFrame, ledger: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, ledger) with new rows appended: always an event, and a ledger row if the stage has an input hash."""
    rows = new.select(*[F.col(c) for c in events.columns])
    entries = new.where("input_hash is not null").select(*[F.col(c) for c in ledger.columns])
    return events.unionByName(rows), ledger.unionByName(entries)


def register_excerpts(rows: DataFrame, facts: DataFrame, blocks: DataFrame) -> DataFrame:
    """item_id, place, document_id, block_index, text: the evidence of register rows (item_id, fact_ids), in order; facts
    or blocks that are missing and flagged blocks are passed over."""
    cited = rows.select("item_id", F.posexplode("fact_ids").alias("at", "fact_id"))
    found = cited.join(facts.select("fact_id", "document_id", "block_index"), "fact_id").join(blocks.where("not flagged").select("document_id", "block_index", "text"), ["document_id", "block_index"])
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("at")) - 1
    return found.select("item_id", place.cast("long").alias("place"), "document_id", "block_index", "text")


def approved_ids(requested: DataFrame, known: DataFrame) -> DataFrame:
    """Requests (batch_id, ids) with problem: approval names each change, once; there is no approval of everything. Ids meet
    those that are known (batch_id, change_id) a row each."""
    empty = (F.size("ids") == 0) | F.exists("ids", lambda x: F.coalesce(F.trim(x), F.lit("")) == "")
    named = requested.select(F.col("batch_id").alias("_batch"), F.col("ids").alias("_ids")).distinct().select("_batch", "_ids", F.explode("_ids").alias("change_id"))
    there = known.select(F.col("batch_id").alias("_batch"), "change_id").distinct()
    unknown = named.join(there, ["_batch", "change_id"], "left_anti").select("_batch", "_ids").distinct().withColumn("_unknown", F.lit(True))
    rows = requested.join(unknown, F.col("batch_id").eqNullSafe(F.col("_batch")) & F.col("ids").eqNullSafe(F.col("_ids")), "left")
    problem = F.when(F.col("ids").isNull() | empty, "names no change").when(F.size(F.array_distinct("ids")) < F.size("ids"), "names a change twice").when(F.col("_unknown"), "names an unknown change")
    return rows.select(*requested.columns, problem.alias("problem"))


def permitted(requests: DataFrame) -> DataFrame:
    """requests (role, actor, action) with allowed: reviewers decide, services run; what watches folders never decides."""
    decides = F.col("action").isin("decide", "override", "install_rules")
    return requests.withColumn("allowed", F.coalesce(F.when(decides, (F.col("role") == "reviewer") & (F.col("actor") != "watcher")).otherwise(F.col("role").isin("reviewer", "service")), F.lit(False)))


def review_counts(reviews: DataFrame) -> DataFrame:
    """Reviews by kind and state."""
    return reviews.groupBy("kind", "state").agg(F.count("*").alias("n"), F.count_distinct("run_id").alias("n_runs"))


def run_dashboard(events: DataFrame, unpriced: Column) -> DataFrame:
    """What a reader sees of each run: time with a model, cache hits, calls without a price, failures."""
    return events.groupBy("run_id").agg(F.sum(F.when(F.col("tokens_in") > 0, F.col("duration_ms")).otherwise(0)).alias("model_time"), F.count_if("cache_hit").alias("cache_hits"), F.count_if(unpriced).alias("unpriced"), F.count_if(F.col("decision") == "failed").alias("failed"))


def collection_dashboard(register: DataFrame, findings: DataFrame) -> DataFrame:
    """What a reader sees of each collection: disputed rows, those without a value, findings still open."""
    rows = register.groupBy("collection_id").agg(F.count_if(F.col("state") == "disputed").alias("disputed"), F.count_if(F.col("state").isin("unsupported", "missing", "ambiguous")).alias("without_value"))
    n = findings.where("state = 'pending' and verdict <> 'pass'").groupBy("collection_id").agg(F.count("*").alias("open_findings"))
    return rows.join(n, "collection_id", "left").withColumn("open_findings", F.coalesce("open_findings", F.lit(0)))


def exactly_once(rows: DataFrame, by: str, digest: Column) -> DataFrame:
    """n_rows, n_texts, n_repeats by group: what is stored more than once shows as a repeat."""
    counts = rows.groupBy(by, digest.alias("_d")).agg(F.count("*").alias("_n"))
    return counts.groupBy(by).agg(F.sum("_n").alias("n_rows"), F.count("*").alias("n_texts"), F.sum(F.col("_n") - 1).alias("n_repeats"))


def agreeing_retries(attempts: DataFrame) -> DataFrame:
    """run_id, stage, input of stages tried more than once, and whether all tries gave one output."""
    n = attempts.groupBy("run_id", "stage", "input").agg(F.count("*").alias("attempts"), F.count_distinct("output").alias("n_outputs"))
    return n.where("attempts > 1").select("run_id", "stage", "input", "attempts", (F.col("n_outputs") <= 1).alias("agree"))


def assessed(blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """One finding for each document and source rule: excerpts under the budget, judged, and grounded in what was shown."""
    from ledgerloom.operators import rules as R

    return R.grounded(R.judged(quarantined(blocks), rules))


def ingested(documents: DataFrame, started: DataFrame, order: list[str]) -> DataFrame:
    """documents (document_id, collection_id, sha, run_id) with duplicate and branch: a text that its collection has is a
    duplicate, unless this run started on it before (started: run_id, sha), for then it was this run that stored it.
    Duplicates skip extraction but not the source rules."""
    earlier = F.row_number().over(Window.partitionBy("collection_id", "sha").orderBy(*order)) > 1
    rows = documents.withColumn("_known", earlier).join(started.select("run_id", "sha").distinct().withColumn("_own", F.lit(True)), ["run_id", "sha"], "left")
    rows = rows.withColumn("duplicate", F.col("_known") & F.col("_own").isNull()).drop("_known", "_own")
    return rows.withColumn("branch", F.when(F.col("duplicate"), "source_rules").otherwise("extract"))


def pinned(runs: DataFrame, rulesets: DataFrame) -> DataFrame:
    """runs (run_id, collection_id, started_at) with the playbook (ruleset_id, ruleset_hash of its raw text) that was active
    when they began; null if there was none, and then no rule runs."""
    known = rulesets.select("collection_id", F.col("installed_at").alias("at"), F.struct("ruleset_id", F.sha2("raw", 256).alias("ruleset_hash")).alias("pin"))
    asked = runs.select("run_id", "collection_id", F.col("started_at").alias("at"))
    return ranges.as_of(asked, known, ["collection_id"], "at", "pin").select("run_id", "pin.ruleset_id", "pin.ruleset_hash")


def ruleset_content(rules: DataFrame, by: str) -> DataFrame:
    """by, content_hash: what a playbook says, whatever its version, layout or order: name and rules in order of code, keys
    sorted."""
    rule = F.struct(F.trim("code").alias("code"), F.array_sort("target_keys").alias("keys"), F.lower(F.trim("scope")).alias("scope"), F.lower(F.trim("severity")).alias("severity"), F.trim("rule_text").alias("text"))
    whole = F.struct(F.max(F.trim("name")).alias("name"), F.array_sort(F.collect_list(rule)).alias("rules"))
    return rules.groupBy(by).agg(hashing.sha256_text(hashing.canonical_json(whole)).alias("content_hash"))


def binding_drift(then: DataFrame, now: DataFrame, rulesets: DataFrame) -> DataFrame:
    """collection_id, what: the keys whose version changed since a decision was bound, and the playbook if its hash did."""
    from ledgerloom.operators import register

    keys = register.drift(then, now).select("collection_id", scoped_key().alias("what"))
    changed = rulesets.where(~F.col("bound_hash").eqNullSafe(F.col("ruleset_hash"))).select("collection_id", F.lit("(playbook)").alias("what"))
    return keys.unionByName(changed)


def carried_warnings(events: DataFrame, label: str = "warnings: ") -> DataFrame:
    """run_id, place, warning: the warnings that earlier extractions left in event reasons, in order."""
    rows = events.where(F.col("reason").startswith(label)).withColumn("_w", F.split(F.substring("reason", len(label) + 1, 1 << 30), "; "))
    return rows.select("run_id", "seq", F.posexplode("_w").alias("place", "warning")).where("warning <> ''")


#: Bounds of what a model's answer may say (fixed values).
VERDICTS, REASON_CHARS = ("pass", "violation", "insufficient_evidence"), 500


def answers(raw: DataFrame, known_keys: list[str]) -> DataFrame:
    """id, verdict, confidence, reason, key, value, quote_start, quote_end of model answers (id, content, text), one row for
    each fact: the outermost object is read; verdicts outside the list are no evidence, confidence is clamped, reasons are
    cut; facts with other keys or without a value are dropped, a bare value is wrapped, and quotes are placed where the text
    has them, or nowhere (0, 0)."""
    from ledgerloom.functions import text as T

    body = F.from_json(T.json_body(F.col("content")), "verdict string, confidence double, reason string, facts array<struct<key:string,value:string,quote:string>>")
    rows = raw.select("id", "text", body.alias("b")).where("b is not null")
    verdict = F.when(F.lower("b.verdict").isin(*VERDICTS), F.lower("b.verdict")).otherwise("insufficient_evidence")
    rows = rows.select("id", "text", verdict.alias("verdict"), F.least(F.greatest(F.coalesce("b.confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("confidence"), F.substring("b.reason", 1, REASON_CHARS).alias("reason"), F.explode_outer("b.facts").alias("f"))
    rows = rows.where(F.col("f.key").isin(*known_keys) & F.col("f.value").isNotNull())
    value = F.when(F.col("f.value").startswith("{"), F.col("f.value")).otherwise(F.to_json(F.struct(F.col("f.value").alias("value"))))
    at = F.when(F.coalesce(F.col("f.quote"), F.lit("")) != "", F.call_function("locate", F.col("f.quote"), F.col("text")) - 1).otherwise(-1)
    return rows.select("id", "verdict", "confidence", "reason", "f.key", value.alias("value"), F.when(at >= 0, at).otherwise(0).alias("quote_start"), F.when(at >= 0, at + F.length("f.quote")).otherwise(0).alias("quote_end"))
