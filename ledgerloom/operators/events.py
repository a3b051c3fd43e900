"""Event logs folded: run status, attempts, stages, leases, decisions, idempotency."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators.folds import folded


def sequenced(events: DataFrame) -> DataFrame:
    """events with seq, from 1 on within each run."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy("run_id").orderBy("ts", "event_id")).cast("long"))


def status(runs: DataFrame, events: DataFrame, pending: DataFrame) -> DataFrame:
    """run_id, status, current_stage: a running run with pending reviews awaits them."""
    last = events.groupBy("run_id").agg(F.max_by("stage", F.struct("ts", "event_id")).alias("current_stage"))
    waiting = pending.groupBy("run_id").agg(F.count("*").alias("n_pending"))
    rows = runs.join(last, "run_id", "left").join(waiting, "run_id", "left")
    held = (F.col("status") == "running") & (F.coalesce("n_pending", F.lit(0)) > 0)
    return rows.select("run_id", F.when(held, "awaiting_review").otherwise(F.col("status")).alias("status"), "current_stage", F.coalesce("n_pending", F.lit(0)).alias("n_pending"))


def attempts(events: DataFrame) -> DataFrame:
    """Consecutive events of one stage as one group: islands by a running count of changes.

    depth is 1 if the group before ended by branching into this one.
    """
    order = Window.partitionBy("run_id").orderBy("ts", "event_id")
    rows = events.withColumn("change", F.when(F.lag("stage").over(order) == F.col("stage"), 0).otherwise(1)).withColumn("branched", F.lag("decision").over(order) == "branch").withColumn("grp", F.sum("change").over(order))
    return rows.groupBy("run_id", "grp").agg(F.first("stage").alias("stage"), F.count("*").alias("attempts"), F.sum("duration_ms").alias("duration_ms"), F.coalesce(F.max(F.when((F.col("change") == 1) & F.col("branched"), 1)), F.lit(0)).alias("depth"))


def ledger_fold(log: DataFrame) -> DataFrame:
    """Stage ledger from its log (run_id, stage, input, ts, seq, status, output): an attempt is any entry but the
    completion of a start; the status is the last, the output the first."""
    order = Window.partitionBy("run_id", "stage", "input").orderBy("ts", "seq")
    rows = log.withColumn("completes", (F.lag("status").over(order) == "started") & (F.col("status") == "completed"))
    return rows.groupBy("run_id", "stage", "input").agg(F.count_if(~F.coalesce("completes", F.lit(False))).alias("attempts"), F.max_by("status", F.struct("ts", "seq")).alias("status"), F.min_by("output", F.when(F.col("output").isNotNull(), F.struct("ts", "seq"))).alias("output"))


def decide(attempts_log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions, refusals) of a log (item, actor, decision, ts, seq): the first decides; the same again by the same
    actor is a replay, anything else is refused."""
    first = attempts_log.groupBy("item").agg(F.min_by(F.struct("actor", "decision"), F.struct("ts", "seq")).alias("f"), F.min(F.struct("ts", "seq")).alias("at"))
    rest = attempts_log.join(first, "item").where((F.struct("ts", "seq") != F.col("at")) & ((F.col("actor") != F.col("f.actor")) | (F.col("decision") != F.col("f.decision"))))
    return first.select("item", "f.actor", "f.decision"), rest.select("item", "actor", "decision", "ts", "seq")


def claims(requests: DataFrame) -> DataFrame:
    """Idempotency keys (request_key) that were used with more than one fingerprint."""
    return requests.groupBy("request_key").agg(F.count_distinct("fingerprint").alias("n_fingerprints"), F.count("*").alias("n_requests")).where("n_fingerprints > 1")


def leases(takes: DataFrame, ttl_seconds: int = 300) -> DataFrame:
    """takes (run_id, owner, ts, seq) with granted: a lease is free, one's own, or expired.

    The holder before a take is the owner of the last grant; grants are found by a fold over each run's takes
    in order, since each depends on the one before.
    """
    kind = dict(takes.dtypes)["run_id"]
    ttl = pd.Timedelta(seconds=ttl_seconds)

    def step(held, take):
        free = held is None or held[0] == take.owner or held[1] <= take.ts
        return ((take.owner, take.ts + ttl) if free else held), (take.seq, take.owner, free)

    return folded(takes.select("run_id", "ts", "seq", "owner"), ["run_id"], ["ts", "seq", "owner"], f"run_id {kind}, seq long, owner string, granted boolean", None, step)
