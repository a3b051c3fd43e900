"""The versioned register: proposals, candidate, binding, commit; pure transforms over frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.sources.shared import written

KEY = ["collection_id", "agreement_id", "key"]


def proposals(derived: DataFrame, register: DataFrame) -> DataFrame:
    """What each derivation would change: nothing if its hash is the row's, a scope question if it is ambiguous."""
    now = register.select(*KEY, F.col("content_hash").alias("before_hash"), F.col("value").alias("before"), F.col("version"))
    rows = derived.join(now, KEY, "left")
    kind = F.when(F.col("state") == "ambiguous", "scope_question").when(F.col("value").isNull(), "none").when(F.col("before_hash") == F.col("content_hash"), "unchanged").when(F.col("conflict_kind").isNotNull(), "conflict").otherwise("register_update")
    return rows.select(*KEY, kind.alias("kind"), "before", F.col("value").alias("after"), "state", "content_hash", F.coalesce("version", F.lit(0)).alias("base_version"), "before_hash")


def candidate(register: DataFrame, approved: DataFrame) -> DataFrame:
    """The stored register overlaid by approved values; a changed row's version goes up by one, a new one has 1."""
    a = approved.select(*KEY, F.col("after").alias("a_value"), F.col("state").alias("a_state"), F.col("content_hash").alias("a_hash"))
    rows = register.join(a, KEY, "full")
    new = F.col("a_hash").isNotNull() & ~F.col("a_hash").eqNullSafe(F.col("content_hash"))
    pick = lambda x, y: F.when(new, F.col(x)).otherwise(F.col(y))
    return rows.select(*KEY, pick("a_value", "value").alias("value"), pick("a_state", "state").alias("state"), pick("a_hash", "content_hash").alias("content_hash"), (F.coalesce("version", F.lit(0)) + new.cast("long")).alias("version"))


def drift(then: DataFrame, now: DataFrame) -> DataFrame:
    """Keys whose version differs between two registers, or that only one has."""
    a, b = then.select(*KEY, F.col("version").alias("then")), now.select(*KEY, F.col("version").alias("now"))
    return a.join(b, KEY, "full").where(~F.col("then").eqNullSafe(F.col("now")))


def against(approved: DataFrame, register: DataFrame) -> DataFrame:
    """Approved proposals with the hash and version that their row has now."""
    return approved.join(register.select(*KEY, F.col("content_hash").alias("actual_hash"), F.col("version").alias("actual_version")), KEY, "left")


def stale(approved: DataFrame, register: DataFrame) -> DataFrame:
    """Approved proposals whose row is no longer what they were made against."""
    return against(approved, register).where(~F.col("before_hash").eqNullSafe(F.col("actual_hash")) | (F.col("base_version") != F.coalesce("actual_version", F.lit(0))))


def outstanding(approved: DataFrame, register: DataFrame) -> DataFrame:
    """Approved proposals that the register does not hold."""
    return approved.join(register.select(*KEY, "content_hash"), [*KEY, "content_hash"], "left_anti")


def commit(run_id, register: DataFrame, approved: DataFrame, done: DataFrame) -> dict[str, DataFrame]:
    """Frames to publish for a run: register, changes, before and after snapshots, refused, ledger, and its event.

    Nothing changes if the ledger (done) has the run; proposals whose hash is the row's are no-ops, stale ones
    are refused. The frames are pure functions of the inputs, so a repeated attempt writes the same rows.
    """
    open_run = approved.limit(0) if done.where(F.col("run_id") == run_id).take(1) else approved
    judged, _ = written(against(open_run, register), "judged")
    moved = ~F.col("before_hash").eqNullSafe(F.col("actual_hash")) | (F.col("base_version") != F.coalesce("actual_version", F.lit(0)))
    refused = judged.where(moved)
    good = judged.where(~moved & ~F.col("before_hash").eqNullSafe(F.col("content_hash"))).drop("actual_hash", "actual_version")
    after = candidate(register, good)
    touched = good.select(*KEY)
    snap = lambda df, phase: df.join(touched, KEY, "left_semi").select(F.lit(run_id).alias("run_id"), F.lit(phase).alias("phase"), *KEY, "content_hash", "version")
    changes = good.select(F.lit(run_id).alias("run_id"), *KEY, F.col("before").alias("old_value"), F.col("after").alias("new_value"))
    n_refused = refused.agg(F.count("*").alias("n_refused"))
    ledger = good.agg(F.count("*").alias("n_changes")).select(F.lit(run_id).alias("run_id"), "n_changes")
    # both are one row
    event = ledger.withColumn("_one", F.lit(1)).join(n_refused.withColumn("_one", F.lit(1)), "_one").select("run_id", F.lit("commit").alias("stage"), F.when(F.col("n_refused") > 0, "partial_commit").otherwise("commit").alias("decision"), "n_changes", "n_refused")
    return {"event": event, "register": after, "changes": changes, "before": snap(register, "before"), "after": snap(after, "after"), "refused": refused, "ledger": ledger}


def insert_if_absent(stored: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(stored and the first new row of each unknown key, the duplicates that were refused)."""
    w = Window.partitionBy(*key).orderBy(*order)
    ranked = new.withColumn("_rank", F.row_number().over(w))
    first = ranked.where("_rank = 1").drop("_rank").join(stored.select(*key), key, "left_anti")
    known = new.join(first.select(*new.columns), new.columns, "left_anti")
    return stored.unionByName(first), known


def upsert(stored: DataFrame, new: DataFrame, key: list[str], identity: list[str]) -> DataFrame:
    """Rows merged by key: the old identity stays, other columns are refreshed."""
    rest = [c for c in stored.columns if c not in key]
    n = new.select(*key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in rest])
    rows = stored.withColumn("_old", F.lit(True)).join(n, key, "full")
    value = lambda c: F.coalesce(c, f"_new_{c}") if c in identity else F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c))
    return rows.select(*key, *[value(c).alias(c) for c in rest])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def report_status(rows: DataFrame) -> DataFrame:
    """rows with status by the first of these that holds."""
    return rows.withColumn("report", F.when(F.col("duplicate"), "duplicate_noop").when(F.col("n_outstanding") == 0, "nothing_to_rederive").when(F.col("n_stale") > 0, "stale").when(F.col("blocked"), "blocked").when(~F.col("confirmed"), "unconfirmed").otherwise("committed"))
