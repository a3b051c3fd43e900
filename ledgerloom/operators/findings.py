"""What a run has to show for itself: verdicts reused or judged anew, everything a person must decide, and whether it is clean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import relational
from ledgerloom.sources.shared import written

#: Kinds of proposals that ask nobody anything.
SETTLED = ("none", "unchanged")


def reuse(documents: DataFrame, findings: DataFrame, order: list[str]) -> DataFrame:
    """document_id, code, verdict, origin, review_decision, decided_by of documents (document_id, cache_key and order) from
    the findings of those that were evaluated (document_id, code, verdict, review_decision, decided_by).

    A document's cache entry is the first of its key. Later documents take over that one's verdicts with origin `reused`,
    and as a decision was about another run's proposals, they are pending again. Where somebody dismissed what a rule had
    refused, the entry no longer holds: later documents have their own findings, as `evaluated`. A document whose entry
    has no findings, because nothing was evaluated, has its own too. Ids are unique; null keys are a key like others.
    """
    first, _ = written(documents.groupBy("cache_key").agg(F.min_by("document_id", F.struct(*order)).alias("entry")), "entries")
    adverse = (F.col("review_decision") == "dismissed") & (F.col("verdict") != "pass")
    # of all documents only those that are a key's first may lend what they have
    entries = findings.groupBy(F.col("document_id").alias("entry")).agg(F.bool_or(F.coalesce(adverse, F.lit(False))).alias("stale"))
    lent, _ = written(first.join(entries, "entry", "left").withColumnRenamed("cache_key", "_key"), "lent")
    rows = documents.select("document_id", "cache_key").join(lent, F.col("cache_key").eqNullSafe(F.col("_key")))
    hit = (F.col("document_id") != F.col("entry")) & F.coalesce(~F.col("stale"), F.lit(False))
    rows = rows.select("document_id", F.when(hit, F.col("entry")).otherwise(F.col("document_id")).alias("source"), hit.alias("hit"))
    met = rows.join(findings.withColumnRenamed("document_id", "source"), "source")
    return met.select("document_id", "code", "verdict", F.when(F.col("hit"), "reused").otherwise("evaluated").alias("origin"), F.when(F.col("hit"), "pending").otherwise(F.col("review_decision")).alias("review_decision"), F.when(~F.col("hit"), F.col("decided_by")).alias("decided_by"))


def review_items(proposals: DataFrame, blocks: DataFrame, findings: DataFrame) -> DataFrame:
    """collection_id, kind, target_key, document_id, force_review: everything that a person must decide before a commit.

    That is what derivations propose (collection_id, agreement_id, key, kind), but for what is settled; each block set aside
    (collection_id, document_id, block_index, flagged); and each source finding about a document (collection_id,
    document_id, code, target_kind, verdict) that is no pass. Nobody may be left out, so force_review is always true.
    """
    changes = proposals.where(~F.col("kind").isin(*SETTLED)).select("collection_id", "kind", relational.scoped_key().alias("target_key"), F.lit(None).cast("long").alias("document_id"))
    aside = blocks.where("flagged").select("collection_id", F.lit("injection_review").alias("kind"), F.concat(F.lit("block "), F.col("block_index").cast("string")).alias("target_key"), F.col("document_id").cast("long").alias("document_id"))
    refused = findings.where("verdict <> 'pass' and target_kind = 'document'").select("collection_id", F.lit("finding").alias("kind"), F.col("code").alias("target_key"), F.col("document_id").cast("long").alias("document_id"))
    return changes.unionByName(aside).unionByName(refused).withColumn("force_review", F.lit(True))


def assembled(items: DataFrame, proposals: DataFrame) -> DataFrame:
    """collection_id, decision and counts by kind of what was put before people; `skip` where there is nothing to decide."""
    kinds = ("conflict", "finding", "scope_question", "injection_review", "register_update")
    counts = items.groupBy("collection_id").agg(F.count("*").alias("n_items"), *[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    unchanged = proposals.groupBy("collection_id").agg(F.count_if(F.col("kind") == "unchanged").alias("unchanged"))
    rows = counts.join(unchanged, "collection_id", "full")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_items", *kinds, "unchanged")]
    return rows.select("collection_id", *zero).withColumn("decision", F.when(F.col("n_items") > 0, "continue").otherwise("skip"))


def run_summaries(runs: DataFrame, findings: DataFrame, warnings: DataFrame, confirmations: DataFrame) -> DataFrame:
    """One row for each of runs (run_id, expected, completed, failed) with its counts, against what was expected of it.

    findings: run_id, verdict, review_decision; warnings: run_id, warning, from extraction; confirmations: run_id,
    reviewed_by, confirmed. complete: no rule failed, and all that were expected gave a verdict that is there. certain: the
    extractor warned of nothing. dismissed: adverse verdicts that somebody dismissed, which are still no pass. clean: complete,
    something was expected, all passed, certain, and a named person confirmed it.
    """
    n = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    counts = findings.groupBy("run_id").agg(F.count("*").alias("n_findings"), n("pass"), n("violation"), n("insufficient_evidence"), F.count_if((F.col("review_decision") == "dismissed") & (F.col("verdict") != "pass")).alias("dismissed"))
    warned = warnings.where("warning is not null").groupBy("run_id").agg(F.count("*").alias("n_warnings"))
    # the last word of several: a refusal counts, and the least name stands for all
    signed = confirmations.groupBy("run_id").agg(F.min("reviewed_by").alias("reviewed_by"), F.bool_and(F.coalesce("confirmed", F.lit(False))).alias("_confirmed"))
    rows = runs.select("run_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("expected", "completed", "failed")])
    rows = rows.join(counts, "run_id", "left").join(warned, "run_id", "left").join(signed, "run_id", "left")
    numbers = ("n_findings", "pass", "violation", "insufficient_evidence", "dismissed", "n_warnings")
    rows = rows.select("run_id", "expected", "completed", "failed", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers], "reviewed_by", F.coalesce("_confirmed", F.lit(False)).alias("_confirmed"))
    complete = (F.col("failed") == 0) & (F.col("completed") == F.col("expected")) & (F.col("completed") == F.col("n_findings"))
    clean = complete & (F.col("expected") > 0) & (F.col("pass") == F.col("expected")) & (F.col("n_warnings") == 0) & F.col("reviewed_by").isNotNull() & F.col("_confirmed")
    return rows.select("run_id", "expected", "completed", "failed", *numbers[1:], "reviewed_by", complete.alias("complete"), (F.col("n_warnings") == 0).alias("certain"), clean.alias("clean"))
