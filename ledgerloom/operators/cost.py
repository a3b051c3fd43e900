"""What runs cost: priced tokens by stage, with what has no price kept apart from what is free.

Prices are decimals in USD a million tokens. Spend is summed as decimal millionths of a dollar, so it does not depend
on the order of the rows, and is rounded once, where it is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Price tables up to so many rows are broadcast.
BROADCAST_ROWS = 10_000


def usd(micros: Column, places: int) -> Column:
    """Millionths of a dollar as dollars."""
    return F.round(micros.cast("decimal(28,4)") * F.lit("0.000001").cast("decimal(7,6)"), places).cast("double")


def priced(events: DataFrame, prices: DataFrame) -> DataFrame:
    """events with micros and unpriced. No tokens cost nothing and are never unpriced; a model without a price
    spends nothing that is known."""
    few = prices.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = events.join(F.broadcast(prices) if few else prices, "model", "left")
    idle = (F.col("tokens_in") == 0) & (F.col("tokens_out") == 0)
    whole = lambda c: F.col(c).cast("decimal(15,0)")
    price = lambda c: F.col(c).cast("decimal(9,4)")
    spend = whole("tokens_in") * price("price_in") + whole("tokens_out") * price("price_out")
    none = F.lit(0).cast("decimal(26,4)")
    return rows.select(*events.columns, F.when(idle, none).otherwise(F.coalesce(spend, none)).cast("decimal(26,4)").alias("micros"), (~idle & F.col("price_in").isNull()).alias("unpriced"))


def replays(ledger: DataFrame) -> DataFrame:
    """Executions of a stage beyond the first of each input."""
    return ledger.groupBy("run_id", "stage").agg(F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).alias("replay_attempts"))


def attempts(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Each stage's attempts in the order they were made, with what each cost."""
    w = Window.partitionBy("run_id", "stage").orderBy("ts", "event_id")
    return priced(events, prices).select("run_id", "stage", F.row_number().over(w).cast("long").alias("attempt"), "decision", "duration_ms", "model", "tokens_in", "tokens_out", usd(F.col("micros"), 6).alias("spend_usd"), "unpriced", "cache_hit", "external_service")


def by_stage(events: DataFrame, ledger: DataFrame, prices: DataFrame) -> DataFrame:
    """A row for each run and stage; replay_attempts is null where the ledger does not know the stage."""
    rows = priced(events, prices).groupBy("run_id", "stage").agg(
        usd(F.sum("micros"), 10).alias("spend"),
        F.count("*").alias("attempt_count"),
        F.sum("duration_ms").alias("duration_ms"),
        F.sum("micros").alias("micros"),
        F.bool_or("unpriced").alias("unpriced_usage"),
        F.array_sort(F.collect_set("model")).alias("models"),
        F.collect_set(F.when(F.col("unpriced"), F.col("model"))).alias("unpriced_models"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.count_if("cache_hit").alias("cache_hits"),
        F.count_if(F.col("external_service").isNotNull()).alias("external_service_calls"),
    )
    return rows.join(replays(ledger), ["run_id", "stage"], "left").withColumn("ledger_backed", F.col("replay_attempts").isNotNull())


def totals(stages: DataFrame) -> DataFrame:
    """Run totals as sums over the stages, so the parts always add up."""
    return stages.groupBy("run_id").agg(
        F.sum("duration_ms").alias("duration_ms"),
        usd(F.sum("micros"), 6).alias("spend_usd"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.bool_or("unpriced_usage").alias("has_unpriced_usage"),
        F.sum("attempt_count").alias("attempts"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("unpriced_models")))), ",").alias("unpriced_models"),
    )
