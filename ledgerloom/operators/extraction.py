"""From text to facts and relations, as rows: what sentences claim, what blocks state, each checked and scoped, with repair.

Texts are cut into arrays of parts, and only the parts are exploded; what is decided about a part is plain columns of its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import grounding, scoping
from ledgerloom.functions import text as T
from ledgerloom.sources.shared import drop_path, written

#: Attempts after the first that an extraction has (a fixed value), and how many blocks either side each adds as context.
MOST_REPAIRS, WIDER_BY = 1, 1
_OPEN, _CLOSE = "\u0001", "\u0002"


def parts_at(text: Column, pattern: str) -> Column:
    """array<struct<part, at>>: a text cut before every match of a pattern; part begins with the match and its closing mark,
    the first with neither. at is the part's offset."""
    parts = F.split(F.regexp_replace(F.translate(text, _OPEN + _CLOSE, "  "), pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN)

    def numbered(parts: Column) -> Column:
        sizes = F.transform(parts, lambda p: F.length(p) - F.when(F.contains(p, F.lit(_CLOSE)), 1).otherwise(0))
        starts = F.aggregate(sizes, F.array(F.lit(0)).cast("array<int>"), lambda done, n: F.array_append(done, F.element_at(done, -1) + n))
        return F.arrays_zip(parts.alias("part"), F.slice(starts, F.lit(1), F.size(parts)).alias("at"))

    return grounding.let(parts, numbered).cast("array<struct<part:string,at:int>>")


def relations_of(documents: DataFrame) -> DataFrame:
    """document_id, place, kind, target_ref, quote, quote_start, quote_end: what sentences claim about which agreement.

    As scoping.relations() has it, numbered by place in each document. Documents whose text no claim could be in are not cut.
    """
    docs = documents.where(F.col("text").rlike(scoping.ANY_CLAIM)).select("document_id", T.agreement_ref(F.col("text")).alias("own"), parts_at(F.col("text"), T.RELATION_SENTENCE_BREAK).alias("parts"))
    rows = docs.select("document_id", "own", F.explode("parts").alias("p")).select("document_id", "own", "p.part", "p.at").where(F.col("part").rlike(scoping.ANY_CLAIM))
    body = F.substring_index("part", _CLOSE, -1)
    rows = rows.select("document_id", "own", body.alias("body"), (F.col("at") + F.length("part") - F.length(body) - F.when(F.contains("part", F.lit(_CLOSE)), 1).otherwise(0)).alias("at"))
    rows = rows.select("document_id", "own", T.strip(F.col("body")).alias("quote"), (F.col("at") + F.length("body") - F.length(F.regexp_replace("body", r"(?U)^\s+", ""))).alias("quote_start"))
    rows = rows.select("*", F.posexplode(scoping.relation_kinds(F.col("quote"))).alias("_k", "kind"))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("quote_start", "_k")) - 1
    return rows.select("document_id", place.alias("place"), "kind", F.coalesce(T.agreement_ref(F.col("quote")), "own", F.lit("")).alias("target_ref"), "quote", "quote_start", (F.col("quote_start") + F.length("quote")).alias("quote_end"))


def facts_of(blocks: DataFrame, wide: Column | bool = True) -> DataFrame:
    """blocks with key, value, quote, quote_start, quote_end: a row for every match of the offline extractor's patterns.

    wide lets a quote go on to the end of its sentence where the rest would change its meaning; else it is the match alone.
    """
    whole = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<k:int,at:int,match:string>>")

    def hits(k: int, pattern: str) -> Column:
        of = lambda x: F.struct(F.lit(k).alias("k"), x["at"].alias("at"), F.substring_index(x["part"], _CLOSE, 1).alias("match"))
        return F.when(whole.rlike(pattern), F.transform(F.filter(parts_at(whole, pattern), lambda x: F.contains(x["part"], F.lit(_CLOSE))), of)).otherwise(none)

    found = [hits(k, f"(?iU){pattern}") for k, (_, _, pattern) in enumerate(grounding.FACT_PATTERNS)]
    rows = blocks.select(*blocks.columns, F.explode(F.flatten(F.array(*found))).alias("_f"))
    key, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (name, kind, pattern) in enumerate(grounding.FACT_PATTERNS):
        mine = F.col("_f.k") == k
        key = F.when(mine, name).otherwise(key)
        value = F.when(mine, grounding.recorded(kind, F.regexp_extract("_f.match", f"(?iU){pattern}", 1))).otherwise(value)
    end = F.col("_f.at") + F.length("_f.match")
    wide = wide if isinstance(wide, Column) else F.lit(wide)
    rows = rows.select(*blocks.columns, key.alias("key"), value.alias("value"), F.col("_f.at").alias("quote_start"), F.when(wide, grounding.widened(F.coalesce("text", F.lit("")), end)).otherwise(end).alias("quote_end"))
    return rows.select(*blocks.columns, "key", "value", F.substring("text", F.col("quote_start") + 1, F.col("quote_end") - F.col("quote_start")).alias("quote"), "quote_start", "quote_end")


def checked(candidates: DataFrame) -> DataFrame:
    """candidates (doc_type, text, key, value, quote, quote_start, quote_end) with ok and reason: the quote is what the block
    says there, it states the value, and where the fact is of a contract it does not stop before what changes it."""
    cited = T.citation_failure(F.lit(0), F.lit(0), F.col("text"), F.col("quote"), F.col("quote_start"), F.col("quote_end"))
    scope = scoping.obligation_scope(F.col("doc_type"), F.col("doc_type") == "amendment")
    rows = candidates.withColumn("_cited", cited).withColumn("_said", grounding.grounded(F.col("key"), F.col("value"), F.col("quote"))["reason"])
    rows = rows.withColumn("_clause", grounding.contractual_clause(scope, F.col("text"), F.col("quote_start"), F.col("quote_end"))["reason"])
    reason = F.coalesce("_cited", "_said", "_clause")
    return rows.select(*candidates.columns, reason.isNull().alias("ok"), reason.alias("reason"))


def scoped(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """candidates with scope: clause and conditions of the sentence that each one's quote stands in, parties, dates and
    agreement of its document. Documents are read by a join; their scope is worked out once each."""
    whole = documents.select("document_id", scoping.scope(F.col("doc_type"), F.col("text"), F.lit(""), T.agreement_ref(F.col("text")), F.col("doc_type") == "amendment").alias("scope"))
    rows = candidates.join(whole, "document_id").withColumn("_sentence", scoping.sentence_around(F.col("text"), F.col("quote")))
    return rows.withColumn("scope", F.col("scope").withField("clause", scoping.clause(F.col("_sentence"))).withField("conditions", scoping.conditions(F.col("_sentence")))).drop("_sentence")


def with_context(blocks: DataFrame, by: int) -> DataFrame:
    """blocks with context: the texts of up to so many blocks before and after each, and its own between them; '' if by is 0.
    Documents are dealt out by id to as many tasks as the session has for shuffles, for what follows is work on texts."""
    if not by:
        return blocks.withColumn("context", F.lit(""))
    spark = blocks.sparkSession
    at = Window.partitionBy("document_id").orderBy("block_index")
    near = [F.lag("text", k).over(at) for k in range(by, 0, -1)] + [F.col("text")] + [F.lead("text", k).over(at) for k in range(1, by + 1)]
    return blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "document_id").withColumn("context", F.concat_ws("\n\n", *near))


def extract(blocks: DataFrame, extractor=None, most: int = MOST_REPAIRS) -> tuple[DataFrame, DataFrame]:
    """(facts, attempts) of blocks (document_id, block_index, doc_type, text) that may be extracted from.

    Every block is extracted and every candidate checked. A document with a candidate that does not hold is extracted again
    as a whole, with wider context, `most` times; the last attempt counts. attempts has document_id, attempt, n_candidates,
    n_invalid; facts the candidates of the last attempts with ok and reason: those that hold are stored, the others are what
    is abstained from. An extractor is a function of blocks (with attempt and context) to candidates: facts_of() by default.
    State is a table of the shared folder each round, and a round reads only documents that are still open.
    """
    spark = blocks.sparkSession
    take = extractor or (lambda rows: facts_of(rows, F.col("attempt") > 0))
    blocks, at = written(blocks, "blocks")
    pending, paths, tries, kept = blocks, [at], [], []
    for attempt in range(most + 1):
        asked = with_context(pending.withColumn("attempt", F.lit(attempt)), WIDER_BY if attempt else 0)
        found, at = written(checked(take(asked)), "candidates")
        paths.append(at)
        counted = found.groupBy("document_id").agg(F.count("*").alias("n_candidates"), F.count_if(~F.col("ok")).alias("n_invalid"))
        seen = pending.select("document_id").distinct().join(counted, "document_id", "left")
        seen, at = written(seen.select("document_id", F.lit(attempt).alias("attempt"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_candidates", "n_invalid")]), "attempts")
        paths.append(at)
        tries.append(seen)
        again = seen.where("n_invalid > 0").select("document_id")
        last = attempt == most or not again.take(1)
        kept.append(found if last else found.join(again, "document_id", "left_anti"))
        if last:
            break
        pending = blocks.join(again, "document_id", "left_semi")
    attempts, facts = tries[0], kept[0]
    for t, k in zip(tries[1:], kept[1:], strict=True):
        attempts, facts = attempts.unionByName(t), facts.unionByName(k)
    attempts, _ = written(attempts, "attempts")
    facts, _ = written(facts.drop("context"), "facts")
    for path in paths:
        drop_path(spark, path)
    return facts, attempts


def outcomes(attempts: DataFrame) -> DataFrame:
    """document_id, attempts, n_first, n_invalid_first, n_invalid, outcome: stored if the first attempt held, repaired if a
    later one did, abstained if none."""
    rows = attempts.groupBy("document_id").agg((F.max("attempt") + 1).alias("attempts"), F.min_by("n_candidates", "attempt").alias("n_first"), F.min_by("n_invalid", "attempt").alias("n_invalid_first"), F.max_by("n_invalid", "attempt").alias("n_invalid"))
    return rows.withColumn("outcome", F.when(F.col("n_invalid") > 0, "abstained").when(F.col("attempts") > 1, "repaired").otherwise("stored"))
