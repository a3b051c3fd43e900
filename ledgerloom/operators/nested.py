"""Changes that arrive as JSON inside JSON: parsed twice, normalised, inherited, budgeted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators.folds import folded

CHANGE = "struct<change_id:string,operation:string,chunk_id:string,document_id:string,old_html:string,new_html:string,batch_id:string,batch_total:bigint>"
ENVELOPE = f"struct<batch_id:string,batch_total:bigint,changes:array<{CHANGE}>>"


def change_list(content: Column) -> Column:
    """Changes of a content string whatever its shape: a list, a wrapper with changes, a single change, or any of
    these as a string in JSON; null if it is none."""
    text = F.when(content.rlike(r'^\s*"'), F.get_json_object(F.concat(F.lit('{"x":'), content, F.lit("}")), "$.x")).otherwise(content)
    listed = F.from_json(text, f"array<{CHANGE}>")
    wrapped = F.from_json(text, ENVELOPE)
    single = F.from_json(text, CHANGE)
    inherited = F.transform(wrapped["changes"], lambda c: c.withField("batch_id", F.coalesce(c["batch_id"], wrapped["batch_id"])).withField("batch_total", F.coalesce(c["batch_total"], wrapped["batch_total"])))
    return F.when(text.rlike(r"^\s*\["), listed).when(F.get_json_object(text, "$.changes").isNotNull(), inherited).when(F.get_json_object(text, "$.change_id").isNotNull(), F.array(single))


def changes(batches: DataFrame, content: str = "content") -> DataFrame:
    """A row for each change of each batch (id, content), in order; what does not parse gives none."""
    rows = batches.select("id", F.posexplode_outer(change_list(F.col(content))).alias("place", "c")).where("c is not null")
    return rows.select("id", "place", "c.*")


def first_of_each(frame: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; rows without a key all stay."""
    w = Window.partitionBy(key).orderBy(*order)
    ranked = frame.where(F.col(key).isNotNull()).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
    return ranked.unionByName(frame.where(F.col(key).isNull()))


def within_budget(calls: DataFrame, most: int, order: list[str], by: list[str]) -> DataFrame:
    """calls (k, n) with used_before and allowed: a call is refused before it is made if it would pass the budget;
    a refused call uses nothing, so those after it may still fit. Ties are in the order of n and k."""
    kinds = dict(calls.dtypes)
    rows = calls.select(*by, *order, F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("k"))

    def step(used, call):
        fits = used + call.n <= most
        return used + call.n * fits, (call.k, used, fits)

    return folded(rows, by, [*order, "n", "k"], ", ".join([*(f"{c} {kinds[c]}" for c in by), "k long", "used_before long", "allowed boolean"]), 0, step)


def camel_names(frame: DataFrame) -> DataFrame:
    """Columns and nested fields renamed from snake to camel case at the boundary."""
    from pyspark.sql import types as S

    def camel(name: str) -> str:
        head, *rest = name.split("_")
        return head + "".join(p[:1].upper() + p[1:] for p in rest)

    def renamed(kind):
        if isinstance(kind, S.StructType):
            return S.StructType([S.StructField(camel(f.name), renamed(f.dataType), f.nullable) for f in kind.fields])
        if isinstance(kind, S.ArrayType):
            return S.ArrayType(renamed(kind.elementType), kind.containsNull)
        return kind

    return frame.select(*[F.col(f.name).cast(renamed(f.dataType)).alias(camel(f.name)) for f in frame.schema.fields])
