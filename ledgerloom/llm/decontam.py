"""Benchmark decontamination: which test items lie inside which documents.

An item's shingles are five words long, or all of its words if these are fewer. A document contains the item if it has
at least LEAST of its n distinct shingles, so it lacks n - ceil(LEAST * n) of them at most.

Items are partitioned by size. An item's signature is its k least hashes (a bottom-k MinHash), with k SIGNATURE more
than what a document that contains it may lack; so such a document has at least k less that many of them. A document's
signature for a partition is its hashes up to the largest in any of the partition's signatures. The share of an item's
signature in a document's estimates containment, and the threshold for it is tuned to each item's size so that none is
missed; what passes is verified on the shingles themselves.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import drop_path, written

#: Words of a shingle and the share of an item's shingles that a document must contain.
WORDS, LEAST = 5, 0.8
#: Hashes of a signature beyond those that a document which contains the item may lack.
SIGNATURE = 8
#: Tables of so many bytes, as measured, are broadcast; larger ones are joined by shuffling both sides.
BROADCAST_BYTES = 32_000_000


def words(text: Column) -> Column:
    """Lower-cased words of a text; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _let(value: Column, of) -> Column:
    """of(value) with value bound once: wherever the optimizer moves the expression, a lambda in it reads a variable."""
    return F.get(F.transform(F.array(value), of), 0)


def _windows(v: Column, size: int, of) -> Column:
    """of(the words) of each window of a word array; none if it is shorter."""
    return F.when(F.size(v) >= size, F.transform(F.sequence(F.lit(0), F.size(v) - size), lambda i: of([F.get(v, i + k) for k in range(size)])))


def shingles(w: Column, size: int) -> Column:
    """The windows of a word array."""
    return _let(w, lambda v: F.coalesce(_windows(v, size, lambda x: F.concat_ws(" ", *x)), F.array().cast("array<string>")))


def shingle_hashes(w: Column, size: int) -> Column:
    """64-bit hashes of the windows of a word array."""
    return _let(w, lambda v: F.coalesce(_windows(v, size, lambda x: F.xxhash64(*x)), F.array().cast("array<long>")))


def _by_size(size: Column, sizes: list[int], of) -> Column:
    """of(the shingle size of the row), which is one of a few."""
    out = of(sizes[0])
    for n in sizes[1:]:
        out = F.when(size == n, of(n)).otherwise(out)
    return out


def _key(doc_id: Column, text: Column) -> Column:
    """The id, or for rows without one a digest of the text."""
    return F.when(doc_id.isNotNull(), doc_id.cast("string")).otherwise(F.concat(F.lit("~"), F.sha2(F.coalesce(text, F.lit("")), 256)))


def signatures(items: DataFrame, sizes: list[int], least: float = LEAST) -> DataFrame:
    """item, words, band, band_need, hits, hash: the signature of each item (item, words, w), a row for each hash.

    band is the partition by size and band_need the shingles that its smallest items need; hits is how much of the
    signature a document must have.
    """
    need = lambda n: F.ceil(F.lit(least) * n - F.lit(1e-9)).cast("int")
    table = items.select("item", "words", F.array_sort(F.array_distinct(_by_size(F.col("words"), sizes, lambda n: shingle_hashes(F.col("w"), n)))).alias("hashes"))
    table = table.withColumn("n", F.size("hashes")).withColumn("lacks", F.col("n") - need(F.col("n"))).withColumn("k", F.least(F.col("n"), F.col("lacks") + SIGNATURE))
    table = table.withColumn("band", F.floor(F.log2("n")).cast("int")).withColumn("band_need", need(F.pow(F.lit(2.0), F.col("band"))))
    return table.select("item", "words", "band", "band_need", (F.col("k") - F.col("lacks")).alias("hits"), F.explode(F.slice("hashes", 1, F.col("k"))).alias("hash"))


def _small(table: DataFrame, size: Column | int) -> bool:
    """Whether a written table has few bytes enough to be broadcast; size is what a row takes, rows have 32 bytes more."""
    return (table.agg(F.sum((size if isinstance(size, Column) else F.lit(size)) + 32)).first()[0] or 0) <= BROADCAST_BYTES


def _pairs(docs: DataFrame, benchmark: DataFrame, least: float) -> DataFrame:
    """key, item_id, n_shingles, n_found of the items that documents contain."""
    spark, made = docs.sparkSession, []

    def kept(df: DataFrame, tag: str) -> DataFrame:
        table, path = written(df, tag)
        made.append(path)
        return table

    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct().select(F.xxhash64("item_id", "text").alias("item"), "item_id", words(F.col("text")).alias("w"))
    items = kept(items.where(F.size("w") > 0).withColumn("words", F.least(F.size("w"), F.lit(WORDS))), "items")
    sizes = sorted(r[0] for r in items.select("words").distinct().collect()) or [WORDS]  # five at most
    table = kept(signatures(items, sizes, least), "signatures")
    bands = table.groupBy("words", "band").agg(F.max("band_need"), F.max("hash")).collect()  # by the logarithm of a size
    wanted = kept(items.select("item", "item_id", "words", F.array_distinct(_by_size(F.col("words"), sizes, lambda n: shingles(F.col("w"), n))).alias("wanted")), "wanted")
    rows = docs.select(_key(docs["doc_id"], docs["text"]).alias("key"), docs["text"].alias("text"))
    probes = rows.select("key", words(F.col("text")).alias("w")).select("key", F.size("w").alias("n_words"), *[shingle_hashes(F.col("w"), n).alias(f"h{n}") for n in sizes])
    signed = None
    for n in sizes:
        # an outer generator: the filter that the optimizer derives from an inner one would make every array twice
        of = probes.select("key", (F.col("n_words") - n + 1).alias("n"), F.lit(n).alias("words"), F.explode_outer(f"h{n}").alias("hash"))
        in_reach = F.lit(False)
        for _, _, least_n, most in (b for b in bands if b[0] == n):
            in_reach = in_reach | ((F.col("n") >= least_n) & (F.col("hash") <= most))
        of = of.where(in_reach)
        signed = of if signed is None else signed.unionByName(of)
    met = signed.join(F.broadcast(table) if _small(table, 32) else table, ["words", "hash"]).where(F.col("n") >= F.col("band_need"))
    near = met.groupBy("key", "item").agg(F.count_distinct("hash").alias("found"), F.max("hits").alias("hits")).where("found >= hits").select("key", "item")
    near = kept(near, "candidates")
    # an item may lie in a third of all documents: pairs are joined by document
    with_text = rows.join(F.broadcast(near) if _small(near, F.octet_length("key") + 16) else near, "key").select("key", "item", words(F.col("text")).alias("w"))
    few = _small(wanted, F.aggregate("wanted", F.lit(0), lambda total, x: total + F.octet_length(x) + 16) + 32)
    found = with_text.join(F.broadcast(wanted) if few else wanted, "item").select("key", "item_id", F.size("wanted").alias("n_shingles"), F.size(F.array_intersect(_by_size(F.col("words"), sizes, lambda n: shingles(F.col("w"), n)), F.col("wanted"))).alias("n_found"))
    best = found.groupBy("key", "item_id").agg(F.max(F.struct(F.col("n_found") / F.col("n_shingles"), "n_shingles", "n_found")).alias("m"))
    best = best.select("key", "item_id", "m.n_shingles", "m.n_found").where(F.col("n_found") >= F.ceil(F.lit(least) * F.col("n_shingles") - F.lit(1e-9)))
    out = written(best, "contained")[0]
    for path in made:
        drop_path(spark, path)
    return out


def contained(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found, containment: a row for each item that a document contains.

    An item of fewer than five words is one shingle, found wherever these words follow one another; null or empty
    items have none and are never found. Of rows that repeat an id the best counts. Documents
    without an id are reported with a null id, once for each distinct text. Items without an id likewise.
    """
    doc_id = F.when(~F.startswith("key", F.lit("~")), F.col("key").cast("long"))
    return _pairs(docs, benchmark, least).select(doc_id.alias("doc_id"), "item_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.col("n_found").cast("long").alias("n_found"), F.round(F.col("n_found") / F.col("n_shingles"), 6).alias("containment"))


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents that contain no item, with their columns as they were."""
    leaked, _ = written(_pairs(docs, benchmark, least).select(F.col("key").alias("_leaked")).distinct(), "leaked")
    few = _small(leaked, F.octet_length("_leaked"))
    return docs.join(F.broadcast(leaked) if few else leaked, _key(docs["doc_id"], docs["text"]) == leaked["_leaked"], "left_anti")
