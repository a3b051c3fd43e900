"""Order without one task for each key: numbers by ranges, bounded pages, as-of by spans, first-seen order, digests by pages.

A key may hold most rows, so nothing here is a window over a key or an array of all its rows. Rows are sorted by ranges of key
and order, which cut a key wherever it is large; a small table of the ranges tells where each begins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from ledgerloom.functions import hashing
from ledgerloom.sources.shared import written

#: Entries of a page of nested rows, and of a page of a digest.
PAGE_SIZE, DIGEST_PAGE = 1_000, 10_000


def numbered(rows: DataFrame, keys: list[str], order: list[Column | str], name: str) -> DataFrame:
    """rows with name: their number from 1 among those of the same keys, in this order (equal rows in any).

    Two shuffles whatever the keys: one by ranges of keys and order, one by key and range, of which each is about one task's
    share. Null keys are a key of their own.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    parted, _ = written(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = parted.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    bases = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inner = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    return parted.withColumn("_inner", inner).join(bases, same).select(*rows.columns, (F.col("_base") + F.col("_inner")).cast("long").alias(name))


def paged(rows: DataFrame, keys: list[str], order: list[str], nested: Column, name: str, size: int = PAGE_SIZE) -> DataFrame:
    """keys, page, n, name: what rows say, nested in their order in pages of at most size entries, numbered from 0. Keys
    without rows have no page."""
    placed = numbered(rows, keys, order, "_at").withColumn("page", F.floor((F.col("_at") - 1) / size)).withColumn("_entry", F.struct(F.col("_at").alias("at"), nested.alias("what")))
    pages = placed.groupBy(*keys, "page").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("_entry")).alias("_all"))
    return pages.select(*keys, "page", "n", F.transform("_all", lambda e: e["what"]).alias(name))


def as_of(asked: DataFrame, known: DataFrame, keys: list[str], at: str, value: str, span_days: int = 30) -> DataFrame:
    """asked with value: that of the latest row of known with the same keys and a time not after asked's; null if none.

    Rows meet within spans of days; a span that has no value yet takes the last of the spans before it, which is worked out
    on one row for each span. Of known rows of one time the greatest value counts. Null times have no answer.
    """
    span = F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / (86_400 * span_days)).alias("_span")
    kind = known.schema[value].dataType
    ask = F.struct(*asked.columns)
    left = asked.select(*keys, span, F.col(at).alias("_at"), F.lit(1).alias("_turn"), F.lit(None).cast(kind).alias("_value"), ask.alias("_row"))
    right = known.where(F.col(at).isNotNull()).select(*keys, span, F.col(at).alias("_at"), F.lit(0).alias("_turn"), F.col(value).alias("_value"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    both = left.unionByName(right)
    lasts = both.groupBy(*keys, "_span").agg(F.max_by("_value", F.when(F.col("_turn") == 0, F.struct("_at", "_value"))).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_span").alias("_s"), F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    within = Window.partitionBy(*keys, "_span").orderBy("_at", "_turn", "_value").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_found", F.last("_value", ignorenulls=True).over(within)).where("_turn = 1")
    same = F.col("_span").eqNullSafe(F.col("_s"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = met.join(carried, same).select("_row.*", F.when(F.col("_at").isNotNull(), F.coalesce("_found", "_carried")).alias(value))
    return out


def first_seen(rows: DataFrame, keys: list[str], what: str, order: list[str]) -> DataFrame:
    """keys, position, what: the different values of each key in the order in which they were first seen, from 0. Repeats
    are combined before anything is shuffled."""
    firsts = rows.groupBy(*keys, what).agg(F.min(F.struct(*order)).alias("_first"))
    placed = numbered(firsts, keys, ["_first", what], "position")
    return placed.select(*keys, (F.col("position") - 1).alias("position"), what)


def digest(rows: DataFrame, by: str, order: list[str], entry: Column, name: str, rest: dict[str, Column], page: int = DIGEST_PAGE, levels: int | None = None) -> DataFrame:
    """by, basis: the SHA-256 of the canonical JSON object of name (the entries in order) and rest (single values).

    With more than a page of entries, each page's digest (of the JSON array of its entries) takes their place in the list,
    and so on until a list is one page: a tree whose form follows from the order alone. One page or less gives the digest of
    the whole text.

    With levels, entries are replaced by digests of pages so many times at most, and the list that is left is hashed as it is
    read, whatever its length: it passes through one task, for such a digest has no parts, but is never held.
    """
    if levels is not None and levels < 1:
        raise ValueError("levels must be positive")
    depth = 0
    placed = numbered(rows.select(F.col(by), entry.alias("_entry"), *[c.alias(f"_rest_{k}") for k, c in rest.items()], *[F.col(o).alias(f"_order_{i}") for i, o in enumerate(order)]), [by], [f"_order_{i}" for i in range(len(order))], "_at")
    level = placed.select(by, "_at", hashing.canonical_json(F.col("_entry")).alias("_text"), *[f"_rest_{k}" for k in rest])
    rests = [F.max(f"_rest_{k}").alias(f"_rest_{k}") for k in rest]
    while True:
        pages = level.groupBy(by, F.floor((F.col("_at") - 1) / page).alias("_page")).agg(F.array_sort(F.collect_list(F.struct("_at", "_text"))).alias("_all"), *rests)
        pages, _ = written(pages.select(by, "_page", F.concat(F.lit("["), F.array_join(F.transform("_all", lambda x: x["_text"]), ","), F.lit("]")).alias("_list"), *[f"_rest_{k}" for k in rest]), "digest")
        if not (pages.agg(F.max("_page")).first()[0] or 0):
            break
        many = pages.groupBy(by).agg(F.max("_page").alias("_last"))
        up = pages.join(many, by)
        text = F.when(F.col("_last") > 0, F.concat(F.lit('"'), F.sha2("_list", 256), F.lit('"'))).otherwise(F.substring("_list", F.lit(2), F.length("_list") - 2))
        level = up.select(by, (F.col("_page") + 1).alias("_at"), text.alias("_text"), *[f"_rest_{k}" for k in rest])
        depth += 1
        if depth == levels:
            return _hashed(level, by, name, rest)
    fields = sorted([name, *rest])
    body = [F.concat(F.lit(f'"{f}":'), F.col("_list") if f == name else _alone(F.col(f"_rest_{f}"))) for f in fields]
    return pages.select(by, F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *body), F.lit("}")), 256).alias("basis"))


def _alone(c: Column) -> Column:
    """The JSON of one value, for JSON functions take no bare one."""
    return F.regexp_extract(hashing.canonical_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)


def _hashed(level: DataFrame, by: str, name: str, rest: dict[str, Column]) -> DataFrame:
    """digest()'s last step over the texts of a list in their order, a row at a time."""
    field = lambda f: F.concat(F.lit(f'"{f}":'), _alone(F.col(f"_rest_{f}")))
    before = F.concat_ws(",", *[field(f) for f in sorted(rest) if f < name], F.lit(f'"{name}":['))
    after = F.concat_ws(",", F.lit("]"), *[field(f) for f in sorted(rest) if f > name])
    rows = level.select(by, "_at", "_text", F.concat(F.lit("{"), before).alias("_before"), F.concat(after, F.lit("}")).alias("_after"))
    kind = rows.schema[by].dataType
    # read again: a plan that had shuffled for a join by the same key leaves this shuffle out, and may then broadcast instead
    rows, _ = written(rows, "digests")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = text = end = out = None
        for batch in batches:
            out = pa.schema([(by, batch.schema.field(by).type), ("basis", pa.string())])
            done = []
            for key, _, entry, head, tail in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if text is None or key != now:
                    if text is not None:
                        text.update(end)
                        done.append((now, text.hexdigest()))
                    now, end, text = key, tail.encode(), hashlib.sha256(head.encode())
                else:
                    text.update(b",")
                text.update(entry.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t.type) for i, t in enumerate(out)], schema=out)
        if text is not None:
            text.update(end)
            yield pa.RecordBatch.from_arrays([pa.array([now], out[0].type), pa.array([text.hexdigest()])], schema=out)

    return rows.repartition(by).sortWithinPartitions(by, "_at").mapInArrow(run, StructType([StructField(by, kind), StructField("basis", StringType())]))
