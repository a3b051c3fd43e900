"""Tables in a folder: appended by key, replaced by key, exported as JSON. A repeated attempt leaves what the first left."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.shared import drop_path

#: Folders that the keys of a table are dealt into, so that a batch reads only those of its own keys.
SHARDS = 256
#: Folders of one level that compaction puts together to one of the next.
LEVEL_WIDTH = 16


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in any store that Spark can read."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _sharded(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.xxhash64(*key), F.lit(SHARDS)).cast("int"))


def append_new(rows: DataFrame, path: str, key: list[str], batch: int, order: list[str] | None = None) -> None:
    """Appends the first row (by order) of each key that no other batch has stored. The batch has folders of its own, which a
    repeated attempt overwrites; only the shards of its keys are read, and of these only the keys."""
    spark = rows.sparkSession
    rows = _sharded(rows, key)
    ranked = rows.groupBy(*key, "shard").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in (*key, "shard")]), F.struct(*(order or key))).alias("_row"))
    rows = ranked.select(*key, "_row.*", "shard")
    schema = rows.withColumn("batch", F.lit(batch)).schema  # batches without rows leave a folder without files
    if exists(spark, path):
        shards = [r[0] for r in rows.select("shard").distinct().collect()]  # SHARDS at most
        for part in _parts(spark, path, schema):
            rows = rows.join(part.where(F.col("shard").isin(*shards) & (F.col("batch") != batch)).select(*key), key, "left_anti")
    rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "shard").parquet(path)


def _files(spark: SparkSession, path: str) -> list[str]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def manifest(spark: SparkSession, path: str) -> dict:
    """What compaction has left: version, upto (the last batch in a level) and folders, the latest that was finished."""
    versions = sorted((int(n[1:]) for n in _files(spark, f"{path}/_manifest") if n.startswith("v")), reverse=True)
    return json.loads(spark.read.text(f"{path}/_manifest/v{versions[0]}").first()[0]) if versions else {"version": 0, "upto": -1, "folders": []}


def _open_batches(spark: SparkSession, path: str, upto: int) -> list[int]:
    return sorted(b for b in (int(n[6:]) for n in _files(spark, path) if n.startswith("batch=")) if b > upto)


def _parts(spark: SparkSession, path: str, schema=None) -> list[DataFrame]:
    """The table in two parts at most: its levels (batch -1) and its open batches."""
    now = manifest(spark, path)
    read = lambda: spark.read.schema(schema) if schema is not None else spark.read
    batches = [f"{path}/batch={b}" for b in _open_batches(spark, path, now["upto"])]
    out = [read().option("basePath", path).parquet(*batches)] if batches else []
    levels = [read().option("basePath", f"{path}/_levels/{f}").parquet(f"{path}/_levels/{f}").drop("batch").withColumn("batch", F.lit(-1)) for f in now["folders"]]
    for one in levels[1:]:
        levels[0] = levels[0].unionByName(one)
    return [*levels[:1], *out]


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a table, wherever compaction has put them."""
    parts = _parts(spark, path)
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.drop("batch", "shard")


def compact(spark: SparkSession, path: str, width: int = LEVEL_WIDTH) -> bool:
    """Puts the open batches but the latest (which may still be run again) into one folder by shard once there are width of
    them, and folders of one level into one of the next by the same rule; says whether it did.

    New folders are written first, then a manifest that names them, then what it no longer names is removed. Readers go by
    the manifest: a run that stops in between leaves the table as it was before or as it is after, and the next one does
    again what was left. So a table of n batches has width folders a level and few open batches, and each row is written
    once for each level.
    """
    now = manifest(spark, path)
    done = _open_batches(spark, path, now["upto"])[:-1]
    if len(done) < width:
        return False
    folders = list(now["folders"])

    def merge(level: int, first: int, last: int, rows: DataFrame) -> str:
        name = f"{level}-{first}-{last}"
        rows.drop("batch").repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/_levels/{name}")
        return name

    folders.append(merge(1, done[0], done[-1], spark.read.option("basePath", path).parquet(*[f"{path}/batch={b}" for b in done])))
    level = 1
    while len(full := [f for f in folders if f.startswith(f"{level}-")]) >= width:
        rows = None
        for f in full:
            one = spark.read.parquet(f"{path}/_levels/{f}")
            rows = one if rows is None else rows.unionByName(one)
        level += 1
        bounds = [int(x) for f in full for x in f.split("-")[1:]]
        folders = [f for f in folders if f not in full] + [merge(level, min(bounds), max(bounds), rows)]
    new = {"version": now["version"] + 1, "upto": done[-1], "folders": folders}
    target = f"{path}/_manifest/v{new['version']}"
    _write_text(spark, f"{path}/_manifest/next", target, json.dumps(new))
    sweep(spark, path)
    return True


def _write_text(spark: SparkSession, temporary: str, path: str, text: str) -> None:
    """A small file, there whole or not at all."""
    jvm = spark.sparkContext._jvm
    at, to = jvm.org.apache.hadoop.fs.Path(temporary), jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.rename(at, to)


def sweep(spark: SparkSession, path: str) -> None:
    """Removes what the manifest no longer names: batches in levels, folders put together, older manifests."""
    now = manifest(spark, path)
    gone = [f"{path}/{n}" for n in _files(spark, path) if n.startswith("batch=") and int(n[6:]) <= now["upto"]]
    gone += [f"{path}/_levels/{n}" for n in _files(spark, f"{path}/_levels") if n not in now["folders"]]
    gone += [f"{path}/_manifest/{n}" for n in _files(spark, f"{path}/_manifest") if n != f"v{now['version']}" and n.startswith("v")]
    for one in gone:
        drop_path(spark, one)


def export_json(rows: DataFrame, path: str) -> None:
    """A JSON object for each row, nulls kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
