"""Queries over findings as runs carry them: reused verdicts, all that people must decide, summaries of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import findings, review
from ledgerloom.plans import frames, gate_queries
from ledgerloom.plans import register_queries as Q
from ledgerloom.plans import text_queries as X
from ledgerloom.plans.registry import ORACLES, query
from ledgerloom.sources.shared import written

_ASSESSED = ORACLES["r3_assessed_documents"]
_FLAGGED = f"SELECT collection_id, document_id, block_index FROM blocks WHERE len({X._IMPERATIVES}) > 0"
# Who handled an order dismisses what is refused about it once it is finished.
_DECIDED = f"SELECT target AS document_id, a.code, verdict, CASE WHEN verdict = 'pass' THEN 'pending' WHEN status = 'F' THEN 'dismissed' WHEN status = 'O' THEN 'upheld' ELSE 'pending' END AS review_decision FROM ({_ASSESSED}) a JOIN docs ON document_id = target"


def _decided(spark: SparkSession, d: str) -> DataFrame:
    found = gate_queries.r3_assessed_documents(spark, d).withColumnRenamed("target", "document_id").join(frames.documents(spark, d).select("document_id", "collection_id", "status"), "document_id")
    decision = F.when(F.col("verdict") == "pass", "pending").when(F.col("status") == "F", "dismissed").when(F.col("status") == "O", "upheld").otherwise("pending")
    rows = found.select("document_id", "collection_id", "code", "verdict", decision.alias("review_decision"))
    return written(rows.withColumn("decided_by", F.when(F.col("review_decision") != "pending", "ann")), "decided")[0]


@query(f"""SELECT d.document_id, code, verdict, CASE WHEN hit THEN 'reused' ELSE 'evaluated' END AS origin, CASE WHEN hit THEN 'pending' ELSE review_decision END AS review_decision, CASE WHEN NOT hit AND review_decision <> 'pending' THEN 'ann' END AS decided_by FROM
    (SELECT k.document_id, CASE WHEN k.document_id <> entry AND NOT coalesce(stale, true) THEN entry ELSE k.document_id END AS source, k.document_id <> entry AND NOT coalesce(stale, true) AS hit FROM
      (SELECT document_id, first_value(document_id) OVER (PARTITION BY collection_id, text ORDER BY ingested_at, document_id) AS entry FROM docs) k
      LEFT JOIN (SELECT document_id, bool_or(review_decision = 'dismissed' AND verdict <> 'pass') AS stale FROM ({_DECIDED}) GROUP BY 1) s ON s.document_id = entry) d JOIN ({_DECIDED}) f ON f.document_id = source""", "docs")
def r5_source_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of every document, taken over where its collection had the same text before and nobody dismissed any."""
    docs = frames.documents(spark, d).select("document_id", "ingested_at", F.xxhash64("collection_id", F.sha2("text", 256)).alias("cache_key"))
    return findings.reuse(docs, _decided(spark, d).drop("collection_id"), ["ingested_at", "document_id"])


_ITEMS = f"""SELECT collection_id, kind, agreement_id || '::' || key AS target_key, NULL::BIGINT AS document_id FROM ({ORACLES["d9_proposals"]}) WHERE kind NOT IN ('none', 'unchanged')
    UNION ALL SELECT collection_id, 'injection_review', 'block ' || CAST(block_index AS VARCHAR), document_id FROM ({_FLAGGED})
    UNION ALL SELECT collection_id, 'finding', code, target FROM ({_ASSESSED}) JOIN docs ON document_id = target WHERE verdict <> 'pass'"""


def _items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    proposed = Q._proposed(spark, d)[1]
    found = _decided(spark, d).withColumn("target_kind", F.lit("document"))
    return findings.review_items(proposed, review.quarantined(frames.blocks(spark, d)), found), proposed


@query(f"SELECT *, true AS force_review FROM ({_ITEMS})", "docs", "blocks")
def d9_review_items(spark: SparkSession, d: str) -> DataFrame:
    """Everything that people must decide: proposals, blocks set aside, adverse findings about documents."""
    return _items(spark, d)[0]


@query(f"""SELECT collection_id, count(*) FILTER (WHERE i) AS n_items, {", ".join(f"count(*) FILTER (WHERE i AND kind = '{k}') AS {k}" for k in ("conflict", "finding", "scope_question", "injection_review", "register_update"))}, count(*) FILTER (WHERE NOT i) AS unchanged, CASE WHEN count(*) FILTER (WHERE i) > 0 THEN 'continue' ELSE 'skip' END AS decision
    FROM (SELECT collection_id, kind, true AS i FROM ({_ITEMS}) UNION ALL SELECT collection_id, kind, false FROM ({ORACLES["d9_proposals"]}) WHERE kind = 'unchanged') GROUP BY collection_id""", "docs", "blocks")
def d9_assembled(spark: SparkSession, d: str) -> DataFrame:
    """What each collection's run puts before people, by kind."""
    return findings.assembled(*_items(spark, d))


_RULES_DUE = "SELECT count(*) FROM rules WHERE scope IN ('source', 'both')"


@query(f"""SELECT run_id, expected, completed, failed, pass, violation, insufficient_evidence, dismissed, n_warnings, reviewed_by, complete, n_warnings = 0 AS certain, complete AND expected > 0 AND pass = expected AND n_warnings = 0 AND status = 'O' AS clean FROM
    (SELECT *, failed = 0 AND completed = expected AS complete FROM (SELECT d.document_id AS run_id, status, ({_RULES_DUE}) AS expected, coalesce(n, 0) AS completed, coalesce(e.failed, 0) AS failed, coalesce(pass, 0) AS pass, coalesce(violation, 0) AS violation, coalesce(insufficient_evidence, 0) AS insufficient_evidence, coalesce(dismissed, 0) AS dismissed, coalesce(w, 0) AS n_warnings, CASE WHEN status <> 'P' THEN 'ann' END AS reviewed_by FROM docs d
      LEFT JOIN (SELECT document_id, count(*) AS n, count(*) FILTER (WHERE verdict = 'pass') AS pass, count(*) FILTER (WHERE verdict = 'violation') AS violation, count(*) FILTER (WHERE verdict = 'insufficient_evidence') AS insufficient_evidence, count(*) FILTER (WHERE review_decision = 'dismissed') AS dismissed FROM ({_DECIDED}) GROUP BY 1) f USING (document_id)
      LEFT JOIN (SELECT document_id, count(*) AS w FROM ({_FLAGGED}) GROUP BY 1) USING (document_id)
      LEFT JOIN (SELECT run_id AS document_id, count(*) AS failed FROM run_events WHERE decision = 'failed' GROUP BY 1) e USING (document_id)))""", "docs", "blocks", "rules", "run_events")
def a5_run_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Each document's run against what was expected of it; those in work (status P) nobody has reviewed."""
    docs, found = frames.documents(spark, d), _decided(spark, d).withColumnRenamed("document_id", "run_id")
    failed = frames.run_events(spark, d).where("decision = 'failed'").groupBy("run_id").agg(F.count("*").alias("failed"))
    done = found.groupBy("run_id").agg(F.count("*").alias("completed"))
    due = frames.rules(spark).where("scope in ('source', 'both')").count()
    runs = docs.select(F.col("document_id").alias("run_id"), F.lit(due).alias("expected")).join(done, "run_id", "left").join(failed, "run_id", "left")
    warnings = review.quarantined(frames.blocks(spark, d)).select(F.col("document_id").alias("run_id"), "warning")
    signed = docs.where("status <> 'P'").select(F.col("document_id").alias("run_id"), F.lit("ann").alias("reviewed_by"), (F.col("status") == "O").alias("confirmed"))
    return findings.run_summaries(runs, found, warnings, signed)
