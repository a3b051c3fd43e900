"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (hash, documents, largest doc_id), bucketed by hash and sorted in each bucket, so joins of runs
neither shuffle nor sort them again (merging several into one does). Each batch of documents is merge-anti-joined with the runs so far; what they do
not have is added as a run of level 0. When a level has more than FAN runs, they are merged into one of the next.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import SPACE, as_texts, drop_path, new_path, written

#: A line counts if its key has so many code points and is in so many documents.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Batches a query deals its documents into, and runs of a level before they are merged.
BATCHES, FAN = 4, 2

RUN = "h binary, n_docs long, max_doc long"


def keys(text: str, least: int = LEAST_CHARS) -> list[bytes | None]:
    """For each line the 128-bit hash of its key, or None if the key is too short."""
    out = []
    for line in text.split("\n"):
        key = line.strip(SPACE)
        out.append(hashlib.blake2b(key.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest() if len(key) >= least else None)
    return out


def line_hashes(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """h, doc_id: a row for each distinct key of each document that has an id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, hashes = [], []
            for doc, text in zip(batch["doc_id"].tolist(), as_texts(batch["text"]), strict=True):
                found = {h for h in keys(text, least) if h}
                hashes += found
                ids += [doc] * len(found)
            yield pd.DataFrame({"h": hashes, "doc_id": np.array(ids, dtype="int64")})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInPandas(run, "h binary, doc_id long")


class LineRuns:
    """Levels of sorted runs in the shared folder.

    Every key is in one run only: that of the batch that brought it first. What later batches add to a known
    key is kept beside the runs as changes, and folded in when runs are merged. drop() removes all of them.
    """

    _IN_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"  # what a bucket's one file is sorted by is known

    def __init__(self, spark: SparkSession, fan: int = FAN):
        self.spark, self.fan = spark, fan
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[DataFrame, str]]] = []
        self.changes: list[tuple[DataFrame, str]] = []
        self.merged_away: list[str] = []

    def runs(self) -> list[DataFrame]:
        return [df for level in self.levels for df, _ in level]

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """One table of several: merge joins. (Spark 4.1.2 takes a union of bucketed scans for bucketed, but does not keep
        their buckets together, so sums over one are wrong.)"""

        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            both = a.join(b.select("h", F.col("n_docs").alias("_n"), F.col("max_doc").alias("_m")).hint("merge"), "h", "full_outer")
            return both.select("h", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n_docs"), F.greatest("max_doc", "_m").alias("max_doc"))

        return reduce(two, runs)

    def _write(self, df: DataFrame) -> tuple[DataFrame, str]:
        name = f"ledgerloom_run_{uuid.uuid4().hex}"
        old = self.spark.conf.get(self._IN_ORDER, "false")
        self.spark.conf.set(self._IN_ORDER, "true")
        try:
            df.write.bucketBy(self.buckets, "h").sortBy("h").option("path", new_path(self.spark, name)).saveAsTable(name)
        finally:
            self.spark.conf.set(self._IN_ORDER, old)
        return self.spark.table(name), name

    def _drop(self, name: str) -> None:
        at = self.spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()[1]
        self.spark.sql(f"DROP TABLE {name}")
        drop_path(self.spark, at)

    def drop(self) -> None:
        for name in [*self.merged_away, *(name for level in self.levels for _, name in level), *(name for _, name in self.changes)]:
            self._drop(name)
        self.levels, self.changes, self.merged_away = [], [], []

    def add(self, docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
        """Add a batch (documents not added before); returns the run of the keys that no earlier run has, to be read
        before the next batch is added."""
        return self.add_hashes(line_hashes(docs, least))

    def add_hashes(self, hashes: DataFrame) -> DataFrame:
        """The same for a batch of line_hashes."""
        for name in self.merged_away:
            self._drop(name)
        self.merged_away = []
        batch = hashes.groupBy("h").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        older = self.runs()
        if not older:
            run = self._write(batch)
        else:
            whole, name = self._write(batch)
            fresh = whole
            for keys_of in older:
                fresh = fresh.join(keys_of.select("h").hint("merge"), "h", "left_anti")
            run = self._write(fresh)
            self.changes.append(self._write(whole.join(run[0].select("h").hint("merge"), "h", "left_anti")))
            self._drop(name)
        self._put(run, 0)
        return run[0]

    def _put(self, run: tuple[DataFrame, str], level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) > self.fan:
            old, self.levels[level] = self.levels[level], []
            new = self._write(self._merged([df for df, _ in old]))
            if self.changes:
                # each change belongs to one run: to this one, or to one that stays
                whole = self._write(self._merged([new[0], *(df.join(new[0].select("h").hint("merge"), "h", "left_semi") for df, _ in self.changes)]))
                left = [self._write(df.join(new[0].select("h").hint("merge"), "h", "left_anti")) for df, _ in self.changes] if self.runs() else []
                self.merged_away += [name for _, name in self.changes] + [new[1]]
                self.changes, new = left, whole
            self.merged_away += [name for _, name in old]
            self._put(new, level + 1)

    def frequent(self, least_docs: int = LEAST_DOCS) -> DataFrame:
        """h, max_doc of the keys in so many documents."""
        parts = [*self.runs(), *(df for df, _ in self.changes)]
        if not parts:
            return self.spark.createDataFrame([], RUN).select("h", "max_doc")
        return self._merged(parts).where(F.col("n_docs") >= least_docs).select("h", "max_doc")


def dedup(docs: DataFrame, least: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text of every document.

    A key in at least least_docs documents stays only in the largest doc_id that has it. A null or empty
    text is one empty line. Documents without an id keep all lines and count for none. Rows that repeat an
    id are one document for the counts, and each gets its row. No rows give no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # texts are hashed once; batches are folders of the same table
    at = new_path(spark, "lines")
    line_hashes(docs, least).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(at)
    hashes = spark.read.schema("h binary, doc_id long, batch int").parquet(at)
    runs = LineRuns(spark)
    for k in range(batches):
        runs.add_hashes(hashes.where(F.col("batch") == k))
    frequent, frequent_at = written(runs.frequent(least_docs), "frequent")
    runs.drop()
    # a key may be in a third of all documents: the join of two shuffled sides lets adaptive execution split it
    lost = hashes.join(frequent, "h").where("doc_id <> max_doc").select("doc_id", "h").groupBy("doc_id").agg(F.collect_set("h").alias("lost"))
    lost, _ = written(lost, "lost")
    for path in (at, frequent_at):
        drop_path(spark, path)

    def drop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, gone in zip(batch["id"].tolist(), as_texts(batch["text"]), batch["lost"].tolist(), strict=True):
                lines = text.split("\n")
                n = len(lines)
                if gone is not None and len(gone):
                    gone = {bytes(g) for g in gone}
                    lines = [x for x, h in zip(lines, keys(text, least), strict=True) if h not in gone]
                rows.append((doc, n, n - len(lines), "\n".join(lines)))
            yield pd.DataFrame(rows, columns=["id", "n_lines", "n_dropped", "kept_text"])

    # shuffled at every size: what a document loses grows with the documents
    return docs.join(lost.hint("merge"), "doc_id", "left").select(F.col("doc_id").cast("string").alias("id"), "text", "lost").mapInPandas(drop, "id string, n_lines long, n_dropped long, kept_text string").select(F.col("id").cast("long").alias("doc_id"), "n_lines", "n_dropped", "kept_text")
