"""Folds over ordered rows, where each result depends on those before it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def folded(rows: DataFrame, by: list[str], order: list[str], schema: str, start, step: Callable) -> DataFrame:
    """by and what step(state, row) -> (state, results) gives for each row, in order within each key.

    Rows are sorted in their partitions and streamed: a task holds one state, however many rows a key has.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, start
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                this = tuple(getattr(row, c) for c in by)
                if this != key:
                    key, state = this, start
                state, results = step(state, row)
                out.append((*this, *results))
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)
