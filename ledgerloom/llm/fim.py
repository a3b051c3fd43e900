"""Fill-in-middle: texts cut at two of their units into prefix, middle and suffix, as relations of units.

Matches are exploded with their ordinals, window sums of their lengths give offsets, cut requests join by ordinal, the
offsets of a document are gathered and the parts are substrings. It is done twice: first the units are blocks of some
thousand characters, which carry how many small units they hold, then only blocks that a cut falls into are exploded.
Texts are dealt out once, by a number of their own; all that follows stays where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A unit of text: a run of ASCII letters, or any other code point.
UNIT = r"[A-Za-z]+|[^A-Za-z]"
#: A block ends where a unit does.
BLOCK = r"(?s).{1,4096}(?:(?<=[A-Za-z])[A-Za-z]*+)?"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of documents that are cut, and of those how many put the suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: Bytes of text for each task, beyond the session's number of shuffle partitions.
TASK_BYTES = 128_000_000


def draws(doc_id: Column) -> list[Column]:
    """Four numbers of 32 bits for an id; a null id has those of an empty one."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def offsets(rows: DataFrame, block: str = BLOCK, unit: str = UNIT) -> DataFrame:
    """row, doc_id, at_lo, at_hi: code points before the cuts of rows (row, doc_id, text, n_lo, n_hi), which come after so
    many units (null: not cut). Rows are dealt by row, and stay so."""
    key = ["row", "doc_id"]
    same = lambda a, b: a["row"] == b["row"]
    in_order = Window.partitionBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, order: F.coalesce(F.sum(c).over(in_order.orderBy(*order)), F.lit(0))
    blocks = rows.select(*key, F.posexplode(F.regexp_extract_all("text", F.lit(block), F.lit(0))).alias("block", "part")).withColumn("n", F.size(F.regexp_extract_all("part", F.lit(unit), F.lit(0)))).withColumn("chars", F.length("part"))
    blocks = blocks.withColumn("units_before", before("n", ["block"])).withColumn("chars_before", before("chars", ["block"]))
    requests = rows.select(F.col("row"), F.explode(F.array(F.struct(F.lit("lo").alias("cut"), F.col("n_lo").alias("ordinal")), F.struct(F.lit("hi").alias("cut"), F.col("n_hi").alias("ordinal")))).alias("_r")).select("row", "_r.*").where("ordinal > 0")
    # the last unit before a cut tells where it is: its end
    hit = blocks.join(requests, same(blocks, requests)).where((F.col("ordinal") > F.col("units_before")) & (F.col("ordinal") <= F.col("units_before") + F.col("n")))
    needed = hit.groupBy(blocks["row"], "doc_id", "block", "units_before", "chars_before").agg(F.min("part").alias("part"))
    units = needed.select("row", "doc_id", "block", "units_before", "chars_before", F.posexplode(F.regexp_extract_all("part", F.lit(unit), F.lit(0))).alias("pos", "match")).select("row", "doc_id", "block", (F.col("units_before") + F.col("pos") + 1).alias("unit"), "chars_before", F.length("match").alias("length"))
    ends = units.withColumn("end", F.col("chars_before") + F.sum("length").over(Window.partitionBy(*key, "block").orderBy("unit").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # rows meet by their number alone, by which they are dealt already; as a key the ordinal would have units shuffled
    found = ends.join(requests, same(ends, requests)).where(F.col("unit") - F.col("ordinal") == 0)
    return found.groupBy(ends["row"], "doc_id").agg(F.max(F.when(F.col("cut") == "lo", F.col("end"))).alias("at_lo"), F.max(F.when(F.col("cut") == "hi", F.col("end"))).alias("at_hi"))


def cut(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n, form, prefix, middle, suffix, text of every document.

    n is its number of units. form is plain (not cut, parts null) if the text is null or empty, holds one of the markers or
    is drawn so; else spm or psm. Ids that repeat draw alike; every row is cut on its own. Other columns are ignored.
    """
    h = draws(F.col("doc_id"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"], F.coalesce(docs["text"], F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spark = docs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) if size > TASK_BYTES else 1, -(-size // TASK_BYTES))
    rows = rows.repartition(tasks, "row")
    rows = rows.withColumn("n", F.length(F.regexp_replace("text", "[A-Za-z]+", "x")).cast("long"))
    one, two = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    whole = (F.col("text") == "") | F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE)) | (h[2] % 100 >= rate)
    rows = rows.select("row", "doc_id", "text", "n", F.when(whole, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm").alias("form"), F.when(~whole, F.least(one, two)).alias("n_lo"), F.when(~whole, F.greatest(one, two)).alias("n_hi"))
    # no filter here: all branches read one and the same shuffle of the texts
    at = offsets(rows).select(F.col("row").alias("_row"), "at_lo", "at_hi")
    both = rows.join(at, F.col("row") == F.col("_row"), "left")
    lo, hi = F.coalesce("at_lo", F.lit(0)), F.coalesce("at_hi", F.lit(0))
    part = lambda start, end: F.when(F.col("form") != "plain", F.substring("text", (start + 1).cast("int"), (end - start).cast("int")))
    return both.select("doc_id", "n", "form", part(F.lit(0), lo).alias("prefix"), part(lo, hi).alias("middle"), part(hi, F.length("text")).alias("suffix"), "text")


def output(form: Column, text: Column, prefix: Column, middle: Column, suffix: Column) -> Column:
    """The training text of a document's parts."""
    p, s, m = map(F.lit, (PREFIX, SUFFIX, MIDDLE))
    return F.when(form == "plain", text).when(form == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))


def restored(form: Column, written: Column) -> Column:
    """The document's text again, from its training text and form alone."""
    second = F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    body = F.substring(written, len(PREFIX) + 1, F.length(written))
    first = F.split_part(body, second, F.lit(1))
    rest = F.split_part(body, second, F.lit(2))
    other, middle = F.split_part(rest, F.lit(MIDDLE), F.lit(1)), F.split_part(rest, F.lit(MIDDLE), F.lit(2))
    return F.when(form == "plain", written).when(form == "psm", F.concat(first, middle, other)).otherwise(F.concat(other, middle, first))


def transform(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars (null if plain) and output, the training text, of every document."""
    parts = cut(docs, rate, suffix_first)
    made = output(F.col("form"), F.col("text"), F.col("prefix"), F.col("middle"), F.col("suffix"))
    return parts.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), made.alias("output"))
