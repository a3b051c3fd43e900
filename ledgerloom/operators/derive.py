"""The value of each register key from the facts about it: agreed, disputed, superseded, ambiguous."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import scoping
from ledgerloom.operators import ranges
from ledgerloom.sources.shared import written

GROUP = ["collection_id", "agreement_id", "key"]
#: Rows of a side that is handed to all facts at most (a challenger is some hundred bytes); larger ones meet them by a shuffle.
BROADCAST_KEYS = 100_000
#: Facts are ordered from the oldest to the newest by these.
ORDER = ["ingested_at", "document_id", "line"]


def beside(rows: DataFrame, side: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows joined with a side that is worked out and counted first: keys are few where facts are many, and then the facts
    are not shuffled for them."""
    side, _ = written(side, "side")
    return rows.join(F.broadcast(side) if side.count() <= BROADCAST_KEYS else side, on, how)


def active(facts: DataFrame, new_document: str = "new_document_id") -> DataFrame:
    """The facts that decide each key: contract terms, or operational ones where there are no others; without those of
    documents that another than the run's own document has superseded, unless none would be left.

    With n_facts of the key, its challenger (a struct) and whether each fact is in the challenger's scope. The challenger
    is the newest fact of the run's document, else the newest of all. Comparability is not transitive, so facts are never
    grouped by scope: each is compared with the one challenger. Keys may hold most of the facts, so all steps are
    aggregates that combine before they shuffle and joins that adaptive execution can split.
    """
    contractual = F.col("obligation_scope") == "contractual"
    counts = facts.groupBy(*GROUP).agg(F.count("*").alias("n_facts"), F.bool_or(contractual).alias("_any"))
    rows = beside(facts, counts, GROUP).where(contractual | ~F.col("_any")).drop("_any")
    retired = rows.where(F.col("supersedes_id").isNotNull() & ~F.col("document_id").eqNullSafe(F.col(new_document))).select(*GROUP, F.col("supersedes_id").alias("document_id")).distinct().withColumn("_retired", F.lit(True))
    rows = rows.join(retired, [*GROUP, "document_id"], "left").withColumn("_stays", F.col("_retired").isNull()).drop("_retired")
    rows, _ = written(rows, "stays")  # read twice: for the challengers, and beside them
    return _against_challenger(rows, new_document)


def _against_challenger(rows: DataFrame, new_document: str) -> DataFrame:
    at = F.struct((F.col("document_id").eqNullSafe(F.col(new_document))).cast("int").alias("own"), *[F.col(c) for c in ORDER])
    side = F.struct("fact_id", "document_id", "value", "supersedes_id", "obligation_scope", "conditions", "doc_type", "parties")
    best = rows.groupBy(*GROUP).agg(F.bool_or("_stays").alias("_some"), F.max_by(side, F.when(F.col("_stays"), at)).alias("_live"), F.max_by(side, at).alias("_newest"))
    best = best.select(*GROUP, "_some", F.when(F.col("_some"), F.col("_live")).otherwise(F.col("_newest")).alias("challenger"))
    rows = beside(rows, best, GROUP).where(F.col("_stays") | ~F.col("_some")).drop("_stays", "_some")
    # facts of one key are of one agreement already
    scope = lambda at: F.struct(F.lit(None).cast("string").alias("agreement_id"), *[F.col(f"{at}{c}").alias(c) for c in ("parties", "obligation_scope", "conditions")])
    return rows.withColumn("in_scope", scoping.comparable(scope(""), scope("challenger.")))


def sides(facts: DataFrame, new_document: str = "new_document_id") -> DataFrame:
    """facts with their key's challenger and whether each is in its scope, whatever decides the key."""
    return _against_challenger(facts.withColumn("_stays", F.lit(True)), new_document)


def scoped(facts: DataFrame, run: DataFrame) -> DataFrame:
    """The active facts in their challenger's scope, written once for derive() and citations()."""
    if "parties" not in facts.columns:
        facts = facts.withColumn("parties", F.array().cast("array<string>"))
    rows = active(beside(facts, run, ["collection_id"], "left")).where("in_scope")
    return written(rows.select(*GROUP, *[c for c in ORDER if c not in GROUP], "fact_id", "value", "n_facts", "challenger", "new_document_id"), "active")[0]


def derive(facts: DataFrame, run: DataFrame, evidence: DataFrame | None = None, named: DataFrame | None = None, wanted: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """A row for each key: value, state, conflict_kind, incumbent_id, challenger_id, n_in_scope, n_parallel, reason.

    run gives each collection's new_document_id; evidence the keys (GROUP) for which the new document claims a
    replacement; named the number of agreements a collection names, which makes an unnamed contractual value
    ambiguous if there are two or more; wanted the keys that need a row, missing if no fact is about them; rows what
    scoped() gives, if it is there already.
    """
    rows = scoped(facts, run) if rows is None else rows
    at = F.struct(*[F.col(c) for c in ORDER])
    differs = F.col("value") != F.col("challenger.value")
    out = rows.groupBy(*GROUP).agg(
        F.count("*").alias("n_in_scope"),
        F.max("n_facts").alias("n_facts"),
        F.bool_or(differs).alias("differs"),
        F.max_by(F.struct("fact_id", "document_id", "value"), F.when(differs, at)).alias("rival"),
        F.min_by(F.struct("fact_id", "document_id", "value"), at).alias("oldest"),
        F.max_by("challenger", "fact_id").alias("challenger"),
        F.max("new_document_id").alias("new_document_id"),
    )
    out = out.join(evidence.select(*GROUP).distinct().withColumn("claimed", F.lit(True)), GROUP, "left") if evidence is not None else out.withColumn("claimed", F.lit(None).cast("boolean"))
    out = out.join(named, "collection_id", "left") if named is not None else out.withColumn("n_named", F.lit(0))
    incumbent = F.coalesce("rival", "oldest")
    ambiguous = (F.col("agreement_id") == "") & (F.coalesce("n_named", F.lit(0)) > 1) & (F.col("challenger.obligation_scope") == "contractual")
    superseding = F.coalesce("claimed", F.lit(False)) & F.col("challenger.document_id").eqNullSafe(F.col("new_document_id")) & F.coalesce(F.col("challenger.supersedes_id") == incumbent["document_id"], F.lit(False))
    case = lambda a, b, c, d: F.when(ambiguous, a).when(~F.col("differs"), b).when(superseding, c).otherwise(d)
    none = F.lit(None)
    parallel = F.col("n_facts") - F.col("n_in_scope")
    note = F.when(parallel > 0, F.concat(F.lit("; "), parallel.cast("string"), F.lit(" out of scope"))).otherwise("")
    out = out.select(
        *GROUP,
        case(none.cast("long"), F.col("oldest.value"), F.col("challenger.value"), incumbent["value"]).alias("value"),
        case(F.lit("ambiguous"), F.lit("supported"), F.lit("supported"), F.lit("disputed")).alias("state"),
        case(F.lit("ambiguous_scope"), none.cast("string"), F.lit("supersession_candidate"), F.lit("contradiction")).alias("conflict_kind"),
        case(F.col("oldest.fact_id"), none.cast("long"), incumbent["fact_id"], incumbent["fact_id"]).alias("incumbent_id"),
        case(F.col("challenger.fact_id"), none.cast("long"), F.col("challenger.fact_id"), F.col("challenger.fact_id")).alias("challenger_id"),
        "n_in_scope",
        parallel.alias("n_parallel"),
        F.concat(case(F.concat(F.lit("may be of "), F.col("n_named").cast("string"), F.lit(" agreements")), F.concat(F.col("n_in_scope").cast("string"), F.lit(" agree")), F.lit("claims to replace"), F.lit("differ without a claim")), note).alias("reason"),
    )
    if wanted is None:
        return out
    lost = wanted.select(*GROUP).distinct().join(out.select(*GROUP), GROUP, "left_anti")
    empty = {"state": F.lit("missing"), "reason": F.lit("no evidence"), "n_in_scope": F.lit(0).cast("long"), "n_parallel": F.lit(0).cast("long")}
    return out.unionByName(lost.select(*GROUP, *[empty.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in out.schema if f.name not in GROUP]))


def citations(facts: DataFrame, run: DataFrame, derived: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """GROUP, fact_id of what each derivation cites, one row each: all facts in scope, or those with the value that
    replaces another. rows as for derive()."""
    rows = (scoped(facts, run) if rows is None else rows).select(*GROUP, "fact_id", F.col("value").alias("_value"))
    cited = beside(rows, derived.select(*GROUP, "value", "conflict_kind"), GROUP)
    return cited.where((F.coalesce("conflict_kind", F.lit("")) != "supersession_candidate") | (F.col("_value") == F.col("value"))).select(*GROUP, "fact_id")


def parallel(facts: DataFrame, run: DataFrame) -> DataFrame:
    """GROUP, position, fact_id, document_id, value of the facts that stand beside each key's answer, of another scope than
    its challenger's, from the oldest to the newest: those that n_parallel counts and that decide about the key."""
    if "parties" not in facts.columns:
        facts = facts.withColumn("parties", F.array().cast("array<string>"))
    rows = active(beside(facts, run, ["collection_id"], "left")).where("not in_scope")
    placed = ranges.numbered(rows.select(*GROUP, *ORDER, "fact_id", "value"), GROUP, [*ORDER, "fact_id"], "_place")
    return placed.select(*GROUP, (F.col("_place") - 1).alias("position"), "fact_id", "document_id", "value")


def claims(facts: DataFrame, run: DataFrame, documents: DataFrame, quotes: DataFrame | None = None) -> DataFrame:
    """GROUP, evidence of the keys for which the run's new document claims a replacement: the sentence around the fact's own
    quote (quotes: fact_id, quote), or the line above it, else the first such sentence of the document (documents:
    document_id, text). Only new documents are read."""
    new = facts.join(run.select("collection_id", F.col("new_document_id").alias("document_id")), ["collection_id", "document_id"], "left_semi")
    newest = documents.join(run.select(F.col("new_document_id").alias("document_id")), "document_id", "left_semi")  # before texts are made
    rows = new.join(newest.select("document_id", F.col("text").alias("_text")), "document_id")
    own = F.lit(None).cast("string")
    if quotes is not None:
        rows, own = rows.join(quotes.select("fact_id", "quote"), "fact_id", "left"), scoping.supersession_near(F.col("_text"), F.col("quote"))
    said = scoping.supersession_evidence(F.col("_text"))
    found = rows.where(said.isNotNull()).withColumn("_said", F.coalesce(own, said))
    return found.groupBy(*GROUP).agg(F.max_by("_said", F.struct(*ORDER)).alias("evidence"))


def agreement_of(relations: DataFrame, declared: DataFrame) -> DataFrame:
    """document_id, agreement_id: what a document declares of itself, else the first agreement that it amends, else is
    governed by, else references, else supersedes; of each kind only the first relation counts, and '' names none."""
    rank = F.array_position(F.array(*map(F.lit, scoping.KIND_ORDER)), F.col("kind"))
    firsts = relations.groupBy("document_id", "kind").agg(F.min_by("target_ref", "place").alias("target_ref"))
    best = firsts.where("target_ref <> ''").groupBy("document_id").agg(F.min_by("target_ref", rank).alias("_related"))
    rows = declared.join(best, "document_id", "left")
    return rows.select("document_id", F.coalesce("agreement_ref", "_related", F.lit("")).alias("agreement_id"))


def supersession_target(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """document_id, target of every amendment: the document its relation names (targets: document_id, target), else the
    party's newest agreement or statement of work before it."""
    before = Window.partitionBy("party_id").orderBy("ingested_at", "document_id").rowsBetween(Window.unboundedPreceding, -1)
    base = F.last(F.when(F.col("doc_type").isin("master_agreement", "sow"), F.col("document_id")), ignorenulls=True).over(before)
    rows = documents.withColumn("_base", base).where("doc_type = 'amendment'").join(targets.withColumnRenamed("target", "_named"), "document_id", "left")
    return rows.select("document_id", F.coalesce("_named", "_base").alias("target"))


def resolve_agreement(named: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with bucket: the agreement they name, else the collection's only one, else ''."""
    n = named.groupBy("collection_id").agg(F.count_distinct("agreement_id").alias("n_named"), F.min("agreement_id").alias("only"))
    out = rows.join(n, "collection_id", "left")
    return out.select(rows["*"], F.when(F.col("agreement_id") != "", F.col("agreement_id")).when(F.col("n_named") == 1, F.col("only")).otherwise("").alias("bucket"), F.when((F.col("agreement_id") == "") & (F.col("n_named") > 1), F.col("n_named")).otherwise(0).alias("ambiguous_among"))
