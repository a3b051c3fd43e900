"""Reads over the register's tables: summaries, citations, resolution, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators import ranges

#: States of a run that is not over (fixed values).
OPEN = ("running", "awaiting_review", "committing", "blocked")


def collection_summary(collections: DataFrame, documents: DataFrame, register: DataFrame, runs: DataFrame) -> DataFrame:
    """Counts and last activity of each collection; each side is aggregated before the joins, so nothing fans out."""
    d = documents.groupBy("collection_id").agg(F.count("*").alias("n_documents"), F.max("ingested_at").alias("last_document"))
    r = register.groupBy("collection_id").agg(F.count("*").alias("n_rows"))
    o = runs.groupBy("collection_id").agg(F.count_if(F.col("status").isin(*OPEN)).alias("n_open_runs"), F.max("started_at").alias("last_run"))
    rows = collections.join(d, "collection_id", "left").join(r, "collection_id", "left").join(o, "collection_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("collection_id", "slug", zero("n_documents"), zero("n_rows"), zero("n_open_runs"), F.greatest("last_document", "last_run").alias("last_activity"))


def pages(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """documents with pages: at least 1, whatever blocks say."""
    n = blocks.groupBy("document_id").agg(F.count_distinct("page").alias("n"))
    return documents.join(n, "document_id", "left").select(documents["*"], F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).alias("pages"))


def cited(register: DataFrame, citations: DataFrame) -> DataFrame:
    """Register rows with their fact ids and sorted fingerprints; empty arrays, never null. For rows with few citations:
    all of a row's are one array (citation_counts and the long form have no such bound)."""
    c = citations.groupBy("item_id").agg(F.array_sort(F.collect_list("fact_id")).alias("fact_ids"), F.array_sort(F.collect_set("fingerprint")).alias("fingerprints"))
    return register.join(c, "item_id", "left").select(register["*"], F.coalesce("fact_ids", F.array().cast("array<bigint>")).alias("fact_ids"), F.coalesce("fingerprints", F.array().cast("array<string>")).alias("fingerprints"))


def citation_counts(register: DataFrame, citations: DataFrame) -> DataFrame:
    """Register rows with n_facts, n_fingerprints and first_fact of their citations, which stay rows of their own: a key may
    be cited by as many facts as there are documents."""
    c = citations.groupBy("item_id").agg(F.count("*").alias("n_facts"), F.count_distinct("fingerprint").alias("n_fingerprints"), F.min("fact_id").alias("first_fact"))
    rows = register.join(c, "item_id", "left")
    return rows.select(register["*"], F.coalesce("n_facts", F.lit(0)).alias("n_facts"), F.coalesce("n_fingerprints", F.lit(0)).alias("n_fingerprints"), "first_fact")


def cited_pages(register: DataFrame, citations: DataFrame, size: int = ranges.PAGE_SIZE) -> DataFrame:
    """The columns of register with page, n, fact_ids: its facts in order, so many a page at most; a row that nothing is cited
    for has one empty page."""
    pages = ranges.paged(citations.select("item_id", "fact_id"), ["item_id"], ["fact_id"], F.col("fact_id"), "fact_ids", size)
    rows = register.join(pages, "item_id", "left")
    return rows.select(register["*"], F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("fact_ids", F.array().cast("array<bigint>")).alias("fact_ids"))


def export_pages(register: DataFrame, citations: DataFrame, facts: DataFrame, size: int = ranges.PAGE_SIZE) -> DataFrame:
    """export() in pages: the columns of register with page, n and at most size quotes in order of fact."""
    quotes = citations.join(facts.select("fact_id", "document_id", "value"), "fact_id")
    pages = ranges.paged(quotes, ["item_id"], ["fact_id"], F.struct("fact_id", "document_id", "value"), "quotes", size)
    rows = register.join(pages, "item_id", "left")
    return rows.select(register["*"], F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("quotes", F.array().cast("array<struct<fact_id:bigint,document_id:bigint,value:bigint>>")).alias("quotes"))


def affected_keys(register: DataFrame, citations: DataFrame, facts: DataFrame, superseded: DataFrame, new: DataFrame) -> DataFrame:
    """agreement_id, key of rows that cite a superseded document's facts, and of new facts."""
    old = facts.join(superseded.select("document_id").distinct(), "document_id", "left_semi").select("fact_id")
    rows = register.join(citations.join(old, "fact_id", "left_semi").select("item_id").distinct(), "item_id", "left_semi")
    return rows.select("agreement_id", "key").unionByName(new.select("agreement_id", "key")).distinct()


def resolved(relations: DataFrame, documents: DataFrame) -> DataFrame:
    """relations with the document that declares their target; the last ingested wins, unresolved ones stay."""
    by_ref = documents.where("agreement_ref is not null").groupBy("collection_id", "agreement_ref").agg(F.max_by("document_id", F.struct("ingested_at", "document_id")).alias("target_document_id"))
    return relations.join(by_ref, (relations.collection_id == by_ref.collection_id) & (relations.target_ref == by_ref.agreement_ref), "left").select(relations["*"], "target_document_id")


def scoped_key(agreement="agreement_id", key="key"):
    return F.concat(F.col(agreement), F.lit("::"), F.col(key))


def parsed_key(scoped):
    """struct<agreement_id, key>: split at the first '::'; a bare key is in the unnamed bucket."""
    at = F.instr(scoped, "::")
    return F.struct(F.when(at > 0, F.substring(scoped, F.lit(1), at - 1)).otherwise("").alias("agreement_id"), F.when(at > 0, F.substring(scoped, at + 2, F.length(scoped))).otherwise(scoped).alias("key"))


def latest(frame: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group in the given order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return frame.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def export(register: DataFrame, citations: DataFrame, facts: DataFrame) -> DataFrame:
    """A row for each register row with its citations nested in order of fact; rows without one stay. For rows with few
    citations (whole_export has no such bound)."""
    c = citations.join(facts.select("fact_id", "document_id", "value"), "fact_id").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("fact_id", "document_id", "value"))).alias("quotes"))
    return register.join(c, "item_id", "left").select(register["*"], F.coalesce("quotes", F.array().cast("array<struct<fact_id:bigint,document_id:bigint,value:bigint>>")).alias("quotes"))


def matching(frame: DataFrame, order: list | None = None, **wanted) -> DataFrame:
    """Rows whose columns have the wanted values: one value, or any of a list (none of them for an empty one); None asks
    for nothing."""
    for name, value in wanted.items():
        if isinstance(value, (list, tuple, set)):
            frame = frame.where(F.col(name).isin(*value)) if value else frame.limit(0)
        elif value is not None:
            frame = frame.where(F.col(name) == value)
    return frame.orderBy(*order) if order else frame


def watched(collections: DataFrame) -> DataFrame:
    """Collections with a folder to watch, by name."""
    return collections.where("watch_path is not null and watch_path <> ''").orderBy("slug")


def active_facts(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """facts with their document's party, oldest first; facts of unknown documents go."""
    return facts.join(documents.select("document_id", "party_id"), "document_id").orderBy("ingested_at", "document_id", "line")


def committed_by(register: DataFrame, reviews: DataFrame) -> DataFrame:
    """register with n_reviews: the approved reviews (collection_id, state, payload) whose payload names its key."""
    named = reviews.where("state = 'approved'").select("collection_id", F.get_json_object("payload", "$.target_key").alias("_target")).groupBy("collection_id", "_target").agg(F.count("*").alias("_n"))
    rows = register.withColumn("_target", scoped_key()).join(named, ["collection_id", "_target"], "left")
    return rows.select(*register.columns, F.coalesce("_n", F.lit(0)).alias("n_reviews"))


def register_filter(register: DataFrame, agreement: str | None = None, state: str | None = None, key_part: str | None = None) -> DataFrame:
    """What a reader picks: an agreement ('' is the unnamed one), a state, a part of a key in any case."""
    rows = matching(register, agreement_id=agreement, state=state)
    return rows.where(F.contains(F.lower("key"), F.lit(key_part.lower()))) if key_part else rows


#: What rows of no agreement are listed under (a fixed value).
UNNAMED = "(no agreement named)"


def by_agreement(register: DataFrame) -> DataFrame:
    """label, n_rows, keys of each agreement, by label, the unnamed last."""
    label = F.when(F.col("agreement_id") == "", UNNAMED).otherwise(F.col("agreement_id"))
    rows = register.groupBy(label.alias("label")).agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_set("key")).alias("keys"))
    return rows.orderBy(F.col("label") == UNNAMED, "label")


#: In what order each kind of list is shown.
LISTS = {
    "runs": [F.desc, "started_at", "run_id"],
    "documents": [F.desc, "ingested_at", "document_id"],
    "register": [F.asc, "agreement_id", "key"],
    "findings": [F.asc, "kind", "target", "code"],
    "events": [F.asc, "run_id", "seq"],
    "relations": [F.asc, "document_id", "quote_start"],
    "stages": [F.asc, "created_at", "stage"],
    "reviews": [F.asc, "kind", "target"],
}


def listed(frame: DataFrame, kind: str) -> DataFrame:
    """A list in its order: the first column as the list wants it, ties by the others."""
    direction, first, *rest = LISTS[kind]
    return frame.orderBy(direction(first), *rest)


def existing(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent exists; others are not written."""
    return rows.join(parents.select(key).distinct(), key, "left_semi")


def looked_up(rows: DataFrame, table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with columns of the one row of a table that has their key, or nulls."""
    return rows.join(table.select(key, *columns), key, "left")


def with_decision(changes: DataFrame, decisions: DataFrame) -> DataFrame:
    """changes (batch_id, change_id) with decided: whether there is a decision (batch_id, change_id) on them."""
    known = decisions.select("batch_id", "change_id").distinct().withColumn("_known", F.lit(True))
    return changes.join(known, ["batch_id", "change_id"], "left").select(*changes.columns, F.coalesce("_known", F.lit(False)).alias("decided"))


def key_sets(new: DataFrame, old: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct keys of new with origin: 'new' if old lacks them, else 'both'."""
    known = old.select(*columns).distinct().withColumn("_known", F.lit(True))
    return new.select(*columns).distinct().join(known, columns, "left").select(*columns, F.when(F.col("_known"), "both").otherwise("new").alias("origin"))


def values_by_key(facts: DataFrame, by: list[str]) -> DataFrame:
    """Values of each key by their canonical JSON, with the facts that state each: n_facts, first_fact, last_fact. Long
    form, a row for each value, for a key may have as many facts as there are documents."""
    canonical = F.to_json(F.struct(F.col("value").alias("value")), {"ignoreNullFields": "false"})
    return facts.groupBy(*by, canonical.alias("canonical")).agg(F.count("*").alias("n_facts"), F.min("fact_id").alias("first_fact"), F.max("fact_id").alias("last_fact"))


def sets_of(rows: DataFrame, by: str, what: str) -> DataFrame:
    """The sorted set of what occurs in each group, as text, with its count of rows."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(what)), ",").alias(f"{what}_set"))


def document_text(blocks: DataFrame, separator: str = "\n\n") -> DataFrame:
    """document_id, n_blocks, text of documents put together from their blocks in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block_index", "text"))), lambda x: x["text"])
    return blocks.groupBy("document_id").agg(F.count("*").alias("n_blocks"), F.array_join(parts, separator).alias("text"))


def page_guard(uploads: DataFrame, chunks: str = "chunks", most_pages: int = 3, per_page: int = 12) -> DataFrame:
    """uploads with pages (of so many chunks each) and whether they are allowed."""
    pages = F.ceil(F.col(chunks) / F.lit(float(per_page))).cast("long")
    return uploads.withColumn("pages", pages).withColumn("allowed", F.col("pages") <= most_pages)


def whole_export(register: DataFrame, citations: DataFrame, facts: DataFrame, documents: DataFrame, findings: DataFrame, ruleset: DataFrame) -> DataFrame:
    """collection_id, section, place, body: the whole artifact in long form, a JSON body for each row of each section, in
    order, numbered by ranges; register rows carry the number of their quotes, which are rows of their own."""

    def section(name: str, frame: DataFrame, order: list[str], fields: list[str]) -> DataFrame:
        rows = ranges.numbered(frame, ["collection_id"], order, "place")
        return rows.select("collection_id", F.lit(name).alias("section"), "place", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("body"))

    quotes = citations.join(facts.select("fact_id", "document_id", "value"), "fact_id")
    counts = quotes.groupBy("item_id").agg(F.count("*").alias("n_quotes"))
    rows = register.join(counts, "item_id", "left").withColumn("n_quotes", F.coalesce("n_quotes", F.lit(0)))
    cited = quotes.join(register.select("item_id", "collection_id"), "item_id")
    parts = [
        section("register", rows, ["agreement_id", "key"], ["agreement_id", "key", "value", "state", "version", "n_quotes"]),
        section("quotes", cited, ["item_id", "fact_id"], ["item_id", "fact_id", "document_id", "value"]),
        section("documents", documents, ["document_id"], ["document_id", "doc_type"]),
        section("findings", findings, ["code", "target", "verdict"], ["code", "target", "verdict", "severity"]),
        section("ruleset", ruleset, ["code"], ["code", "rule_text", "severity", "scope"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merged_spans(spans: DataFrame, by: str) -> DataFrame:
    """by, s, e: spans (s, e) of each group with those that overlap or touch joined, by a running maximum."""
    before = Window.partitionBy(by).orderBy("s", "e")
    rows = spans.withColumn("_reach", F.max("e").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_group", F.sum(F.when(F.col("_reach").isNull() | (F.col("s") > F.col("_reach")), 1).otherwise(0)).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(by, "_group").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_group")
