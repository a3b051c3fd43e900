"""Shared pieces: written intermediate tables, batches by size, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.shared import drop_path, new_path, written  # noqa: F401  (used by the operators)

#: The white space that all operators here split and strip by.
SPACE = " \t\n\x0b\x0c\r"

def slices(lengths, limit: int) -> Iterator[slice]:
    """Consecutive slices whose lengths sum to about limit, one item at least."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if len(lengths) > start:
        yield slice(start, len(lengths))


def as_texts(series) -> list[str]:
    """Strings of a pandas series; null is an empty text."""
    return [x if isinstance(x, str) else "" for x in series.tolist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser over uint64 (the shift-multiply kind)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edges; root is the least node of its component.

    Alternates large and small stars. Each round is two aggregations with map-side combining and two equi-joins; the least
    neighbours are written before they are joined, so that adaptive execution may split the edges of a hub, whatever share
    of all edges is its own. Edges are written to the shared folder, and only a count and a checksum reach the driver.
    """
    spark = edges.sparkSession
    now, path = written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(seen) == mark or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        mark = tuple(seen)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least, least_at = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
        large, large_at = written(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        low, low_at = written(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b")
        new, new_at = written(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        for old in (path, least_at, large_at, low_at):
            drop_path(spark, old)
        now, path = new, new_at
