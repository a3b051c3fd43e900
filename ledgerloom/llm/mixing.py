"""Mixing sources to target weights by balanced (cube) sampling.

Each document may be taken zero, one or two times. The whole part of a source's rate is taken of every
document; the fraction is an inclusion probability. The flight moves probabilities along the null space of
two constraints, the expected number of documents and of words, until each is 0 or 1; it runs over blocks of
a source (a hash of doc_id), then over what the blocks leave open (two documents each at most), then a
landing step decides the last two of a source by the smallest error in words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from ledgerloom.llm.common import as_texts, written

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words, and the most that a source or document gives as a multiple of its size.
SHARE, MOST = 1.5, 2.0
#: Blocks of each source in the first flight, at least and by documents; the second flight has twice as many documents.
BLOCKS, BLOCK_ROWS = 256, 100_000
#: Up to so many sources (one row each) are broadcast; beyond it the join shuffles.
BROADCAST_SOURCES = 20_000

_EPS = 1e-9


@F.pandas_udf(LongType())
def n_words(text: pd.Series) -> pd.Series:
    return pd.Series([len(t.encode("utf-8", "surrogatepass").split()) for t in as_texts(text)], dtype="int64")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, rank, source_size, target of a table (source, size).

    Capped sources drop out and the rest is shared again by weight until none is above its cap; each round
    is one aggregate over the table of sources. The ranks need all sources in one sorted task: one short row
    for each source, not for each document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).select("source", F.row_number().over(order).alias("rank"), "source_size", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double").alias("weight"))
    table, _ = written(table, "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, cap = 0.0, F.col("source_size") * most
    for _ in range(10_000):
        over = F.col("weight") * level >= cap
        free, fixed = table.agg(F.sum(F.when(~over, F.col("weight"))), F.sum(F.when(over, cap))).first()
        new = (share * total - (fixed or 0.0)) / free if free else level
        if new <= level:
            break
        level = new
    else:
        raise RuntimeError("targets did not settle")
    return table.select("source", "rank", "source_size", F.least(F.col("weight") * level, cap).cast("double").alias("target"))


def _draw(seed: str) -> float:
    return xxhash.xxh64_intdigest(seed, 11) / 2**64


def _step(units: list[list], seed: str) -> None:
    """Move the probabilities of three units (or two of equal size) until one is 0 or 1; sums of both constraints stay."""
    x = [u[1] for u in units]
    if len(units) == 2 or x[0] == x[1]:
        move = [1.0, -1.0] + [0.0] * (len(units) - 2)
    else:
        move = [float(x[1] - x[2]), float(x[2] - x[0]), float(x[0] - x[1])]
    up = min(((1 - u[2]) / m if m > 0 else u[2] / -m) for u, m in zip(units, move, strict=True) if m)
    down = min((u[2] / m if m > 0 else (1 - u[2]) / -m) for u, m in zip(units, move, strict=True) if m)
    go = up if _draw(seed) * (up + down) < down else -down
    for u, m in zip(units, move, strict=True):
        u[2] += go * m
        if u[2] < _EPS or u[2] > 1 - _EPS:
            u[2] = round(u[2])


def flight(rows, land: bool) -> Iterator[tuple]:
    """(unit, probability) for rows of (unit, size, probability, seed): 0 or 1, but for two left open at most; land decides these."""
    open_units: list[list] = []
    for unit, size, p, seed in rows:
        if p <= _EPS or p >= 1 - _EPS:
            yield unit, float(round(p))
            continue
        open_units.append([unit, size, p])
        while len(open_units) == 3 or len(open_units) == 2 and open_units[0][1] == open_units[1][1]:
            _step(open_units, seed)
            yield from ((u[0], float(u[2])) for u in open_units if u[2] in (0, 1))
            open_units = [u for u in open_units if u[2] not in (0, 1)]
    if land and open_units:
        best = min(product((1, 0), repeat=len(open_units)), key=lambda s: (abs(sum(u[1] * (v - u[2]) for u, v in zip(open_units, s, strict=True))), abs(sum(v - u[2] for u, v in zip(open_units, s, strict=True)))))
        open_units = [[u[0], u[1], float(v)] for u, v in zip(open_units, best, strict=True)]
    yield from ((u[0], float(u[2])) for u in open_units)


def _flown(units: DataFrame, by: list[str], land: bool) -> DataFrame:
    """units with p moved; the rows of each group come sorted, so a task holds three open units and one batch.

    Ids travel as strings: a null among numbers would turn them into doubles.
    """

    columns = units.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for batch in batches:
                yield from batch.itertuples(index=False, name=None)

        done = []
        at = [columns.index(c) for c in by]
        i_size, i_p, i_seed = columns.index("size"), columns.index("p"), columns.index("seed")
        source, held = rows(), []

        def group(first):
            key = [first[i] for i in at]
            row = first
            while row is not None:
                if [row[i] for i in at] != key:
                    held.append(row)
                    return
                yield row, row[i_size], row[i_p], f"{row[i_seed]}"
                row = next(source, None)

        first = next(source, None)
        while first is not None:
            for row, p in flight(group(first), land):
                done.append((*row[:i_p], p, *row[i_p + 1 :]))
                if len(done) >= 20_000:
                    yield _frame(done, columns)
                    done = []
            first = held.pop() if held else None
        if done:
            yield _frame(done, columns)

    def _frame(rows, columns):
        return pd.DataFrame(rows, columns=columns)

    return units.repartition(*by).sortWithinPartitions(*by, F.col("seed"), F.col("doc_id"), F.col("size")).mapInPandas(run, units.schema)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, blocks: int | None = None) -> DataFrame:
    """doc_id, source, text_key, size, source_size, target and copies of every document.

    A null or empty text has size 0 and gives no words. Null is a source of its own, the last. Repeated
    rows are sampled one by one. A source without words has target 0 and rate 0. No rows give no rows.
    """
    spark = docs.sparkSession
    units, _ = written(docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_key"), n_words(F.col("text")).alias("size")), "sizes")
    blocks = blocks or max(BLOCKS, -(-units.count() // BLOCK_ROWS))
    table, _ = written(targets(units, weights, share, most), "targets")
    few = table.count() <= BROADCAST_SOURCES
    side = table.select(F.col("source").alias("_source"), "rank", "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(rate + _EPS)
    seed = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit("")), F.col("text_key"))
    all_units = units.join(F.broadcast(side) if few else side, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "source", "text_key", "size", "source_size", "target", "rank", base.cast("int").alias("base"), F.greatest(F.lit(0.0), rate - base).alias("p"), seed.alias("seed"), F.pmod(seed, F.lit(blocks)).cast("int").alias("block"))
    first, _ = written(_flown(all_units, ["rank", "block"], False), "flight")
    still = (F.col("p") > 0) & (F.col("p") < 1)
    out = first.where(~still).unionByName(_flown(first.where(still), ["rank"], True))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text_key", "size", "source_size", "target", (F.col("base") + F.round("p").cast("int")).alias("copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents, each as often as the mix takes it, with their columns as they were.

    Rows of one id, source and text are the same for this purpose: their copies are dealt in turn.
    """
    key = ["_id", "_source", "_key", "_turn"]
    of = Window.partitionBy("_id", "_source", "_key").orderBy("_size")
    taken = mix(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("?")).alias("_id"), F.coalesce("source", F.lit("\0")).alias("_source"), F.col("text_key").alias("_key"), F.col("size").alias("_size"), "copies")
    taken = taken.withColumn("_turn", F.row_number().over(of)).where("copies > 0").select(*key, F.col("copies").alias("_copies"))
    names = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), F.coalesce(docs["doc_id"].cast("string"), F.lit("?")).alias("_id"), F.coalesce(docs["source"].cast("string"), F.lit("\0")).alias("_source"), F.xxhash64(docs["text"]).alias("_key"))
    rows = rows.withColumn("_turn", F.row_number().over(Window.partitionBy("_id", "_source", "_key").orderBy(F.lit(0))))
    return rows.join(taken, key).select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("_n")).select("_row.*")
