"""Watched folders as a stream: stable sightings, one run for each content, rejects kept apart."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ledgerloom.functions import hashing
from ledgerloom.operators import relational
from ledgerloom.sources.files import LARGEST, blocks_of
from ledgerloom.sources.tables import append_new, compact, exists, stored

# Fixed value: files that are still being written.
PARTIAL = (".part", ".partial", ".crdownload", ".tmp", ".swp", ".swx")


def wanted(path):
    """Neither hidden nor still being written."""
    name = F.lower(F.substring_index(path, "/", -1))
    skip = name.startswith(".")
    for suffix in PARTIAL:
        skip = skip | name.endswith(suffix)
    return ~skip


def source(spark: SparkSession, path: str) -> DataFrame:
    """New files below a folder, as they come."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path).where(wanted(F.col("path")))


def folders(collections: DataFrame) -> list[tuple[str, str]]:
    """(name, folder) of the collections that are watched now, listed afresh for each sweep: one row for each folder that
    somebody set up by hand."""
    return [(r.slug, r.watch_path) for r in relational.watched(collections).collect()]


def keyed(files: DataFrame, collection: str, largest: int = LARGEST) -> DataFrame:
    """files with collection, watch_key and outcome: by content, or by path and size for what is refused unread. A file
    whose content did not come is unavailable, and has no key: it is not recorded, so a later sweep takes it."""
    big = F.col("length") > largest
    key = F.when(big, F.concat(F.lit("watch:sha256:"), hashing.oversize_key(F.col("path"), F.col("length")))).otherwise(hashing.watch_key(F.col("content")))
    outcome = F.when(big, "oversize").when(F.col("content").isNull(), "unavailable").otherwise("new")
    return files.select("path", "length", F.lit(collection).alias("collection"), key.alias("watch_key"), outcome.alias("outcome"), F.when(~big, F.col("content")).alias("content"))


def judged(files: DataFrame, readers_of=blocks_of) -> DataFrame:
    """files with outcome and n_blocks: a new file that cannot be read is unreadable and stays recorded as such, so it is
    not read again; one file's failure is its own."""
    read = readers_of(files.where("outcome = 'new'").select("path", "length", "content"))
    found = read.groupBy("path").agg(F.max("error").alias("error"), F.count("block_index").alias("n_blocks"))
    rows = files.drop("content").join(found, "path", "left")
    return rows.withColumn("outcome", F.when(F.col("error").isNotNull(), "unreadable").otherwise(F.col("outcome"))).withColumn("n_blocks", F.coalesce("n_blocks", F.lit(0)))


def once_each(files: DataFrame) -> DataFrame:
    """One row for each collection and content of a stream. Its state is all keys seen; ingest() needs none, for it asks the
    stored table."""
    return files.dropDuplicates(["collection", "watch_key"])


def stable(sightings: DataFrame) -> DataFrame:
    """Sightings (path, poll, size, mtime) that equal those of the poll before: what is safe to read, batch form."""
    w = Window.partitionBy("path").orderBy("poll")
    same = (F.lag("size").over(w) == F.col("size")) & (F.lag("mtime").over(w) == F.col("mtime")) & (F.lag("poll").over(w) == F.col("poll") - 1)
    return sightings.withColumn("stable", F.coalesce(same, F.lit(False)))


_STATE = "poll long, size long, mtime long, done boolean"


def stable_stream(sightings: DataFrame) -> DataFrame:
    """path, size, mtime of a stream of sightings, once each time a file holds still for two polls."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        out = []
        rows = pd.concat(list(batches)).sort_values("poll")
        for poll, size, mtime in rows[["poll", "size", "mtime"]].itertuples(index=False, name=None):
            still = last is not None and last[0] == poll - 1 and last[1:3] == (size, mtime)
            done = still and (last[3] or True)
            if still and not last[3]:
                out.append((key[0], size, mtime))
            last = (int(poll), int(size), int(mtime), bool(done))
        state.update(last)
        yield pd.DataFrame(out, columns=["path", "size", "mtime"])

    return sightings.groupBy("path").applyInPandasWithState(run, "path string, size long, mtime long", _STATE, "append", GroupStateTimeout.NoTimeout)


#: How long the state of a file that no sweep sees any more is kept, in milliseconds.
FORGET_MS = 24 * 3600 * 1000
SIGHTING = "path string, poll long, size long, mtime long"


@contextmanager
def _state_store(spark: SparkSession, by_clock: bool = True) -> Iterator[None]:
    """Keyed state needs the store that keeps it on disk. Where it expires by the clock, batches without rows must not follow
    one another for ever; where it expires by event time, one without rows brings the watermark up to date. The session's settings come back once the query has started."""
    wanted_here = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false" if by_clock else "true"}
    before = {name: spark.conf.get(name, None) for name in wanted_here}
    for name, value in wanted_here.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class Still(StatefulProcessor):
    """Gives a file when two sweeps in a row saw it alike, once until it changes. A sighting without a size says that the
    file is gone, which ends its state; so does a time in which no sweep sees it."""

    def __init__(self, forget_ms: int) -> None:
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _STATE, ttlDurationMs=self.forget_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = self.last.get() if self.last.exists() else None
        for row in sorted(rows, key=lambda r: (r.poll, r.size is not None)):
            if row.size is None:
                last = None
                continue
            still = last is not None and last[0] == row.poll - 1 and tuple(last[1:3]) == (row.size, row.mtime)
            if still and not last[3]:
                yield Row(path=key[0], size=row.size, mtime=row.mtime)
            last = (row.poll, row.size, row.mtime, still)
        self.last.update(last) if last is not None else self.last.clear()

    def close(self) -> None:
        pass


def held_still(sightings: DataFrame, forget_ms: int = FORGET_MS) -> DataFrame:
    """path, size, mtime of a stream of sightings (SIGHTING), once each time a file holds still for two sweeps. State is one
    short row for each file that is there."""
    return sightings.groupBy("path").transformWithState(Still(forget_ms), "path string, size long, mtime long", "append", "ProcessingTime")


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(wanted(F.col("path")))
    return files.select("path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime"))


def sweep(spark: SparkSession, folder: str, sightings: str) -> int:
    """Lists a folder, without contents, as the next sweep of a table of sightings, and gives its number. Files that the
    sweep before saw and this one does not are sighted without a size. A sweep that failed is done again."""
    polls = stored_polls(spark, sightings)
    poll = max(polls, default=0) + 1
    now = _listed(spark, folder)
    if polls:
        before = spark.read.schema(SIGHTING).parquet(f"{sightings}/sweep-{poll - 1:012d}").where("size is not null")
        gone = before.join(now, "path", "left_anti").select("path", F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("mtime"))
        now = now.unionByName(gone)
    now.select("path", F.lit(poll).cast("long").alias("poll"), "size", "mtime").write.mode("overwrite").parquet(f"{sightings}/sweep-{poll:012d}")
    return poll


def stored_polls(spark: SparkSession, sightings: str) -> list[int]:
    """The numbers of the sweeps that were written to their end."""
    if not exists(spark, sightings):
        return []
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sightings)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [int(f.getPath().getName()[6:]) for f in fs.listStatus(at) if f.getPath().getName().startswith("sweep-") and exists(spark, f"{f.getPath()}/_SUCCESS")]


def contents(still: DataFrame, folder: str) -> DataFrame:
    """path, length, content of files (path, size, mtime) that are still as they were seen. Only files changed between the
    first and last of these times are opened at all, for the reader checks times before it reads."""
    span = still.agg(F.min("mtime"), F.max("mtime")).first()
    spark = still.sparkSession
    if span[0] is None:
        return spark.createDataFrame([], "path string, length long, content binary")
    time = lambda micros: F.timestamp_micros(F.lit(micros))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("modificationTime").between(time(span[0]), time(span[1])))
    same = [F.col("path") == F.col("_p"), F.col("length") == F.col("_s"), F.unix_micros("modificationTime") == F.col("_m")]
    return files.join(still.select(F.col("path").alias("_p"), F.col("size").alias("_s"), F.col("mtime").alias("_m")), same, "left_semi").select("path", "length", "content")


def sink(batch: DataFrame, batch_id: int, runs_path: str, collection: str, largest: int = LARGEST, blocks_path: str | None = None) -> None:
    """Stores what each file of a batch came to, once for each content that no run holds yet, and the blocks of those that
    became runs. A batch that is run twice is stored once; earlier ones are put together as they grow many."""
    files = keyed(batch, collection, largest)
    rows = judged(files).where("outcome <> 'unavailable'")
    append_new(rows, runs_path, ["collection", "watch_key"], batch_id, ["path"])
    if blocks_path and exists(batch.sparkSession, runs_path):
        mine = batch.sparkSession.read.schema("watch_key string, path string, outcome string, batch int").parquet(runs_path).where((F.col("batch") == batch_id) & (F.col("outcome") == "new")).select("watch_key", "path")
        taken = files.join(mine, ["watch_key", "path"], "left_semi")
        blocks = blocks_of(taken.select("path", "length", "content")).where("error is null").drop("error")
        runs = taken.select("path", hashing.name_uuid(F.concat_ws(":", "collection", F.sha2("content", 256))).alias("run_id"))
        blocks.join(runs, "path").withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(blocks_path)
    if exists(batch.sparkSession, runs_path):
        compact(batch.sparkSession, runs_path)


def ingest(spark: SparkSession, folder: str, collection: str, runs_path: str, checkpoint: str, largest: int = LARGEST, sightings: str | None = None, blocks_path: str | None = None, forget_ms: int = FORGET_MS):
    """A stream that takes what is in the folder now, exactly once over restarts, and ends.

    With a folder for sightings it sweeps first, and takes only files that two sweeps in a row saw alike: call it at each
    poll. It then keeps a short state for each file that is there; without one it keeps no state but the stored table, of
    which a batch reads the shards of its own keys. With blocks_path the blocks of new runs are stored too.
    """
    if sightings is None:
        files, take = source(spark, folder), lambda batch: batch
    else:
        sweep(spark, folder, sightings)
        seen = spark.readStream.schema(SIGHTING).option("recursiveFileLookup", "true").parquet(sightings)
        files, take = held_still(seen, forget_ms), lambda batch: contents(batch, folder)
    with _state_store(spark):
        writer = files.writeStream.foreachBatch(lambda df, i: sink(take(df), i, runs_path, collection, largest, blocks_path))
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def report(spark: SparkSession, runs_path: str) -> DataFrame:
    """collection, outcome, n, first_path, last_path of what was taken."""
    return stored(spark, runs_path).groupBy("collection", "outcome").agg(F.count("*").alias("n"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))


#: States that end a run (fixed values).
SETTLED = ("committed", "blocked", "failed", "cancelled")


def run_states(events: DataFrame) -> DataFrame:
    """run_id, status, settled, n_events of runs from their status events (run_id, seq, status), batch or stream: the latest
    wins, but nothing follows a settled state."""
    first_end = F.min_by("status", F.when(F.col("status").isin(*SETTLED), F.col("seq")))
    rows = events.groupBy("run_id").agg(first_end.alias("end"), F.max_by("status", "seq").alias("last"), F.count("*").alias("n_events"))
    return rows.select("run_id", F.coalesce("end", "last").alias("status"), F.col("end").isNotNull().alias("settled"), "n_events")


class Lifecycle(StatefulProcessor):
    """Folds a run's status events, which may come in any order until they are late; a run that is over is forgotten when
    nothing on time can follow."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "end_seq long, end string, last_seq long, last string, n long, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        end_seq, end, last_seq, last, n, at = self.run.get() if self.run.exists() else (None, None, None, None, 0, 0)
        for row in rows:
            n, at = n + 1, max(at, int(row["at"].timestamp() * 1000))
            if row["status"] in SETTLED and (end_seq is None or row["seq"] < end_seq):
                end_seq, end = row["seq"], row["status"]
            if last_seq is None or row["seq"] > last_seq:
                last_seq, last = row["seq"], row["status"]
        self.run.update((end_seq, end, last_seq, last, n, at))
        if end is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at + 1)
        yield Row(run_id=key[0], status=end or last, settled=end is not None, n_events=n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.run.clear()
        return iter([])

    def close(self) -> None:
        pass


def run_states_stream(events: DataFrame, late: str = "10 minutes"):
    """run_id, status, settled, n_events each time a run of a stream of events (run_id, seq, status, at) changes: run_states()
    of all events that were on time. Events later than `late` behind the latest are dropped."""
    rows = events.withWatermark("at", late)
    return rows.groupBy("run_id").transformWithState(Lifecycle(), "run_id long, status string, settled boolean, n_events long", "update", "EventTime")


def keep_states(events: DataFrame, path: str, checkpoint: str, late: str = "10 minutes"):
    """A stream that keeps the latest state of each run under path, one row for each run and batch; latest_states() reads it.
    A batch that is run again overwrites its own."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    with _state_store(events.sparkSession, by_clock=False):
        return run_states_stream(events, late).writeStream.foreachBatch(store).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_states(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.groupBy("run_id").agg(F.max_by(F.struct("status", "settled", "n_events"), F.struct("batch", "n_events")).alias("_s")).select("run_id", "_s.*")


def waits(interval: float = 2.0, factor: float = 1.5, longest: float = 30.0, timeout: float = 300.0) -> list[float]:
    """How long a client that asks for a run's state waits each time, until its time is up."""
    out, now = [], interval
    while sum(out) + now <= timeout:
        out.append(now)
        now = min(now * factor, longest)
    return out
