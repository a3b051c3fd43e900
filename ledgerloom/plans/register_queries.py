"""Queries over facts, rules, runs and the register."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import hashing, injection
from ledgerloom.functions import text as T
from ledgerloom.operators import cost, derive, events, nested, register, relational, review, rules
from ledgerloom.plans import frames
from ledgerloom.plans.registry import query
from ledgerloom.sources.shared import written

# Runs are orders; those of a collection are open or over by order status.
_RUNS = "SELECT o_orderkey AS run_id, o_custkey % 5 AS collection_id, CASE o_orderstatus WHEN 'F' THEN 'committed' WHEN 'O' THEN 'running' ELSE 'blocked' END AS status, o_orderdate AS started_at FROM orders"
# The register holds each key's oldest value; a quarter of the rows have moved on since.
_REGISTER = "SELECT collection_id, agreement_id, key, min_by(value, ROW(ingested_at, document_id, line)) AS value, 'supported' AS state, count(*) % 4 + 1 AS version FROM facts GROUP BY ALL"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    o = frames.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 5).alias("collection_id"), F.when(F.col("o_orderstatus") == "F", "committed").when(F.col("o_orderstatus") == "O", "running").otherwise("blocked").alias("status"), F.col("o_orderdate").alias("started_at"))


def _hash(df: DataFrame) -> DataFrame:
    return df.withColumn("content_hash", F.sha2(F.concat_ws("|", F.coalesce(F.col("value").cast("string"), F.lit("")), "state"), 256))


def _register(spark: SparkSession, d: str, facts: DataFrame | None = None) -> DataFrame:
    f = facts or frames.facts(spark, d)
    return _hash(f.groupBy("collection_id", "agreement_id", "key").agg(F.min_by("value", F.struct("ingested_at", "document_id", "line")).alias("value"), F.lit("supported").alias("state"), (F.count("*") % 4 + 1).alias("version")))


_HASH = "sha256(coalesce(CAST(value AS VARCHAR), '') || '|' || state) AS content_hash"


@query("SELECT document_id, party_id, status FROM docs WHERE collection_id = 3 AND doc_type IN ('invoice', 'sow')", "docs")
def p1_p2_lookup(spark: SparkSession, d: str) -> DataFrame:
    return relational.matching(frames.documents(spark, d), collection_id=3, doc_type=["invoice", "sow"], party_id=None).select("document_id", "party_id", "status")


@query("SELECT slug, watch_path FROM collections WHERE watch_path IS NOT NULL AND watch_path <> ''", "collections")
def p4_watched_collections(spark: SparkSession, d: str) -> DataFrame:
    return relational.watched(frames.collections(spark, d)).select("slug", "watch_path")


@query("SELECT fact_id, agreement_id || '::' || key AS scoped_key, agreement_id AS parsed_agreement, key AS parsed_key FROM facts", "facts")
def p6_scoped_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = frames.facts(spark, d).select("fact_id", relational.scoped_key().alias("scoped_key"))
    parsed = relational.parsed_key(F.col("scoped_key"))
    return rows.select("fact_id", "scoped_key", parsed["agreement_id"].alias("parsed_agreement"), parsed["key"].alias("parsed_key"))


@query(f"SELECT agreement_id, key, count(*) AS n FROM ({_REGISTER}) WHERE contains(lower(key), 'pay') AND state = 'supported' GROUP BY ALL", "facts")
def p8_console_filter(spark: SparkSession, d: str) -> DataFrame:
    return relational.register_filter(_register(spark, d), state="supported", key_part="PAY").groupBy("agreement_id", "key").agg(F.count("*").alias("n"))


@query(f"""WITH runs AS ({_RUNS}), last AS (SELECT run_id, max_by(stage, ROW(ts, event_id)) AS current_stage FROM run_events GROUP BY run_id), pend AS (SELECT user_id AS run_id, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY user_id)
    SELECT runs.run_id, CASE WHEN status = 'running' AND coalesce(n, 0) > 0 THEN 'awaiting_review' ELSE status END AS status, current_stage, coalesce(n, 0) AS n_pending FROM runs LEFT JOIN last USING (run_id) LEFT JOIN pend USING (run_id)""".replace("WITH runs", "SELECT * FROM (WITH runs") + ")", "run_events")
def p10_run_status(spark: SparkSession, d: str) -> DataFrame:
    pending = frames.table(spark, d, "events").where("event_type = 'signup'").select(F.col("user_id").alias("run_id"))
    return events.status(_runs(spark, d), frames.run_events(spark, d), pending)


@query(f"""SELECT c.collection_id, slug, coalesce(nd, 0) AS n_documents, coalesce(nr, 0) AS n_rows, coalesce(no, 0) AS n_open_runs, greatest(last_document, last_run) AS last_activity FROM collections c
    LEFT JOIN (SELECT collection_id, count(*) AS nd, max(ingested_at) AS last_document FROM docs GROUP BY 1) USING (collection_id)
    LEFT JOIN (SELECT collection_id, count(*) AS nr FROM ({_REGISTER}) GROUP BY 1) USING (collection_id)
    LEFT JOIN (SELECT collection_id, count(*) FILTER (WHERE status IN ('running', 'blocked')) AS no, max(started_at) AS last_run FROM ({_RUNS}) GROUP BY 1) USING (collection_id)""", "collections", "docs", "facts")
def j1_a1_collection_summary(spark: SparkSession, d: str) -> DataFrame:
    return relational.collection_summary(frames.collections(spark, d), frames.documents(spark, d), _register(spark, d), _runs(spark, d))


@query("SELECT d.document_id, greatest(coalesce(n, 0), 1) AS pages FROM docs d LEFT JOIN (SELECT document_id, count(DISTINCT CASE WHEN block_index % 2 = 0 THEN block_index END) AS n FROM blocks GROUP BY 1) USING (document_id)", "docs", "blocks")
def j2_a2_document_pages(spark: SparkSession, d: str) -> DataFrame:
    b = frames.blocks(spark, d).select("document_id", F.when(F.col("block_index") % 2 == 0, F.col("block_index")).alias("page"))
    return relational.pages(frames.documents(spark, d), b).select("document_id", "pages")


@query("SELECT fact_id, f.doc_type, supersedes_id, party_id FROM facts f JOIN docs USING (document_id) WHERE supersedes_id IS NOT NULL", "facts", "docs")
def j3_active_facts(spark: SparkSession, d: str) -> DataFrame:
    rows = relational.active_facts(frames.facts(spark, d), frames.documents(spark, d))
    return rows.where("supersedes_id is not null").select("fact_id", "doc_type", "supersedes_id", "party_id")


# Register rows cite every fact of their key; items are named by collection and key.
_ITEM = "collection_id || '/' || agreement_id || '::' || key"


def _item():
    return F.concat(F.col("collection_id").cast("string"), F.lit("/"), F.col("agreement_id"), F.lit("::"), F.col("key"))


# Facts of each collection's newest document.
_NEWEST = "SELECT f.* FROM facts f JOIN (SELECT collection_id, max_by(document_id, ROW(ingested_at, document_id)) AS document_id FROM facts GROUP BY collection_id) USING (collection_id, document_id)"


@query(f"""WITH c AS (SELECT {_ITEM} AS item_id, f.* FROM facts f), gone AS (SELECT DISTINCT supersedes_id AS document_id FROM facts WHERE supersedes_id IS NOT NULL AND collection_id = 1)
    SELECT DISTINCT agreement_id, key FROM (SELECT agreement_id, key FROM c SEMI JOIN gone USING (document_id) UNION ALL SELECT agreement_id, key FROM ({_NEWEST}))""".replace("WITH c AS", "SELECT * FROM (WITH c AS") + ")", "facts")
def j4_affected_keys(spark: SparkSession, d: str) -> DataFrame:
    f = _facts(spark, d)
    items = f.withColumn("item_id", _item())
    gone = f.where("supersedes_id is not null and collection_id = 1").select(F.col("supersedes_id").alias("document_id"))
    rows = items.select("item_id", "agreement_id", "key").distinct()
    return relational.affected_keys(rows, items.select("item_id", "fact_id"), f, gone, _newest(spark, d, facts=f))


@query(f"""SELECT {_ITEM} AS item_id, count(*) AS n_facts, count(DISTINCT sha256(CAST(value AS VARCHAR))) AS n_fingerprints, min(fact_id) AS first_fact FROM facts GROUP BY {_ITEM}""", "facts")
def j5_a3_cited_register(spark: SparkSession, d: str) -> DataFrame:
    f = frames.facts(spark, d).withColumn("item_id", _item())
    return relational.citation_counts(f.select("item_id").distinct(), f.select("item_id", "fact_id", F.sha2(F.col("value").cast("string"), 256).alias("fingerprint")))


_FINDINGS = "SELECT code, severity, agreement_id || '::' || key AS target, collection_id, CASE WHEN value > 45 THEN 'violation' WHEN value % 10 = 0 THEN 'insufficient_evidence' ELSE 'pass' END AS verdict FROM facts JOIN rules ON len(target_keys) = 0 OR list_contains(target_keys, key) WHERE scope IN ('deliverable', 'both')"


def _findings(spark: SparkSession, d: str) -> DataFrame:
    f = frames.facts(spark, d)
    rows = rules.applicable(rules.for_stage(frames.rules(spark), "deliverable"), f)
    return rows.select("code", "severity", relational.scoped_key().alias("target"), "collection_id", F.when(F.col("value") > 45, "violation").when(F.col("value") % 10 == 0, "insufficient_evidence").otherwise("pass").alias("verdict"))


@query(f"SELECT severity, code, verdict, count(*) AS n FROM ({_FINDINGS}) GROUP BY ALL", "facts", "rules")
def j6_j11_findings_by_rule(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d).groupBy("severity", "code", "verdict").agg(F.count("*").alias("n"))


_REFS = "SELECT document_id, collection_id, ingested_at, doc_type, 'MSA-' || CAST(year(ingested_at) AS VARCHAR) || '-' || lpad(CAST(party_id % 1000 AS VARCHAR), 3, '0') AS ref FROM docs"


@query(f"""WITH r AS ({_REFS}), t AS (SELECT collection_id, ref, max_by(document_id, ROW(ingested_at, document_id)) AS target FROM r WHERE doc_type = 'master_agreement' GROUP BY ALL)
    SELECT document_id, r.ref AS target_ref, target AS target_document_id FROM r LEFT JOIN t USING (collection_id, ref) WHERE doc_type = 'amendment'""".replace("WITH r AS", "SELECT * FROM (WITH r AS") + ")", "docs")
def j7_j16_relation_targets(spark: SparkSession, d: str) -> DataFrame:
    docs = frames.documents(spark, d).withColumn("ref", T.agreement_ref(F.col("text")))
    declared = docs.where("doc_type = 'master_agreement'").withColumnRenamed("ref", "agreement_ref")
    claims = docs.where("doc_type = 'amendment'").select("document_id", "collection_id", F.col("ref").alias("target_ref"))
    return relational.resolved(claims, declared).select("document_id", "target_ref", "target_document_id")


@query(f"""SELECT r.collection_id, r.agreement_id, r.key, count(o.document_id) AS n_reviews FROM ({_REGISTER}) r LEFT JOIN (SELECT *, agreement_id || '::' || key AS target_key FROM facts WHERE line = 1) o
    ON o.target_key = r.agreement_id || '::' || r.key AND o.collection_id = r.collection_id GROUP BY ALL""", "facts")
def j8_committed_by(spark: SparkSession, d: str) -> DataFrame:
    payload = F.to_json(F.struct(relational.scoped_key().alias("target_key")))
    reviews = frames.facts(spark, d).select("collection_id", payload.alias("payload"), F.when(F.col("line") == 1, "approved").otherwise("rejected").alias("state"))
    return relational.committed_by(_register(spark, d), reviews).select("collection_id", "agreement_id", "key", "n_reviews")


_RUN = "SELECT collection_id, max_by(document_id, ROW(ingested_at, document_id)) AS new_document_id FROM facts GROUP BY collection_id"


def _run(spark: SparkSession, d: str, facts: DataFrame | None = None) -> DataFrame:
    return (facts or frames.facts(spark, d)).groupBy("collection_id").agg(F.max_by("document_id", F.struct("ingested_at", "document_id")).alias("new_document_id"))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts worked out once, for queries that read them again and again."""
    return written(frames.facts(spark, d), "facts")[0]


def _newest(spark: SparkSession, d: str, how: str = "left_semi", facts: DataFrame | None = None) -> DataFrame:
    """Facts of each collection's newest document, or by left_anti those of all others."""
    f = facts or frames.facts(spark, d)
    new = _run(spark, d, f).select("collection_id", F.col("new_document_id").alias("document_id"))
    return f.join(new, ["collection_id", "document_id"], how)


def _derived(spark: SparkSession, d: str, facts: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    f = facts or _facts(spark, d)
    run = _run(spark, d, f)
    named = f.where("agreement_id <> ''").groupBy("collection_id").agg(F.count_distinct("agreement_id").alias("n_named"))
    return derive.derive(f, run, derive.claims(f, run, frames.documents(spark, d)), named, rows=rows)


def _proposed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(register, proposals), written once for what is committed and proved of them."""
    f = _facts(spark, d)
    reg = written(_register(spark, d, f), "register")[0]
    return reg, written(register.proposals(_hash(_derived(spark, d, f)), reg), "proposals")[0]


def _approved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    reg, proposed = _proposed(spark, d)
    return reg, proposed.where("kind in ('conflict', 'register_update') and after % 3 <> 0")


DERIVED_STEPS = f"""WITH run AS ({_RUN}), f AS (SELECT facts.*, new_document_id FROM facts JOIN run USING (collection_id)),
    auth AS (SELECT * FROM (SELECT *, bool_or(obligation_scope = 'contractual') OVER g AS has_contract FROM f WINDOW g AS (PARTITION BY collection_id, agreement_id, key)) WHERE obligation_scope = 'contractual' OR NOT has_contract),
    ret AS (SELECT DISTINCT collection_id, agreement_id, key, supersedes_id AS document_id FROM auth WHERE supersedes_id IS NOT NULL AND document_id <> new_document_id),
    live AS MATERIALIZED (SELECT * FROM (SELECT *, bool_or(stays) OVER (PARTITION BY collection_id, agreement_id, key) AS any_stays FROM (SELECT a.*, r.document_id IS NULL AS stays FROM auth a LEFT JOIN ret r USING (collection_id, agreement_id, key, document_id))) WHERE stays OR NOT any_stays),
    ch AS (SELECT collection_id, agreement_id, key, max_by(fact_id, ROW(CAST(document_id = new_document_id AS INT), ingested_at, document_id, line)) AS challenger_id FROM live GROUP BY ALL),
    c AS MATERIALIZED (SELECT ch.*, l.value AS c_value, l.document_id AS c_doc, l.supersedes_id AS c_sup, l.obligation_scope AS c_scope, l.conditions AS c_cond, l.parties AS c_parties FROM ch JOIN live l ON l.fact_id = ch.challenger_id),
    s AS (SELECT l.*, c.challenger_id, c_value, c_doc, c_sup, c_scope FROM live l JOIN c USING (collection_id, agreement_id, key) WHERE l.obligation_scope = c_scope AND l.conditions = c_cond AND CASE WHEN len(l.parties) = 0 OR len(c_parties) = 0 THEN true ELSE l.parties = c_parties END)"""
_DERIVED = f"""SELECT * FROM ({DERIVED_STEPS},
    a AS (SELECT collection_id, agreement_id, key, count(*) AS n_in_scope, count(DISTINCT value) AS n_values, max_by(fact_id, ROW(ingested_at, document_id, line)) FILTER (WHERE value <> c_value) AS rival, min_by(fact_id, ROW(ingested_at, document_id, line)) AS oldest,
          any_value(challenger_id) AS challenger_id, any_value(c_value) AS c_value, any_value(c_doc) AS c_doc, any_value(c_sup) AS c_sup, any_value(c_scope) AS c_scope, any_value(new_document_id) AS nd FROM s GROUP BY ALL),
    n AS (SELECT collection_id, agreement_id, key, count(*) AS n_facts, bool_or(doc_type = 'amendment') AS claimed FROM f GROUP BY ALL),
    named AS (SELECT collection_id, count(DISTINCT agreement_id) AS n_named FROM facts WHERE agreement_id <> '' GROUP BY 1),
    j AS (SELECT a.*, n_facts, claimed, n_named, i.fact_id AS i_id, i.value AS i_value, i.document_id AS i_doc, o.value AS o_value, a.agreement_id = '' AND n_named > 1 AND c_scope = 'contractual' AS amb, coalesce(claimed AND c_doc = nd AND c_sup = i.document_id, false) AS sup
          FROM a JOIN n USING (collection_id, agreement_id, key) LEFT JOIN named USING (collection_id) JOIN live i ON i.fact_id = coalesce(rival, oldest) JOIN live o ON o.fact_id = oldest)
    SELECT collection_id, agreement_id, key, CASE WHEN amb THEN NULL WHEN n_values = 1 THEN o_value WHEN sup THEN c_value ELSE i_value END AS value,
      CASE WHEN amb THEN 'ambiguous' WHEN n_values = 1 THEN 'supported' WHEN sup THEN 'supported' ELSE 'disputed' END AS state,
      CASE WHEN amb THEN 'ambiguous_scope' WHEN n_values = 1 THEN NULL WHEN sup THEN 'supersession_candidate' ELSE 'contradiction' END AS conflict_kind,
      CASE WHEN amb THEN oldest WHEN n_values = 1 THEN NULL ELSE i_id END AS incumbent_id, CASE WHEN NOT amb AND n_values = 1 THEN NULL ELSE challenger_id END AS challenger_id, n_in_scope, n_facts - n_in_scope AS n_parallel,
      CASE WHEN amb THEN 'may be of ' || CAST(n_named AS VARCHAR) || ' agreements' WHEN n_values = 1 THEN CAST(n_in_scope AS VARCHAR) || ' agree' WHEN sup THEN 'claims to replace' ELSE 'differ without a claim' END || CASE WHEN n_facts > n_in_scope THEN '; ' || CAST(n_facts - n_in_scope AS VARCHAR) || ' out of scope' ELSE '' END AS reason FROM j)"""


@query(_DERIVED, "facts")
def d3_d6_g9_derived_register(spark: SparkSession, d: str) -> DataFrame:
    return _derived(spark, d)


@query("""SELECT fact_id, CASE WHEN agreement_id <> '' THEN agreement_id WHEN n = 1 THEN sole ELSE '' END AS bucket, CASE WHEN agreement_id = '' AND n > 1 THEN n ELSE 0 END AS ambiguous_among
    FROM facts LEFT JOIN (SELECT collection_id, count(DISTINCT agreement_id) AS n, min(agreement_id) AS sole FROM facts WHERE agreement_id <> '' GROUP BY 1) USING (collection_id)""", "facts")
def d1_resolved_agreement(spark: SparkSession, d: str) -> DataFrame:
    f = frames.facts(spark, d)
    return derive.resolve_agreement(f.where("agreement_id <> ''"), f).select("fact_id", "bucket", "ambiguous_among")


_PROPOSALS = f"""SELECT * FROM (WITH reg AS (SELECT *, {_HASH} FROM ({_REGISTER})), der AS (SELECT *, {_HASH} FROM ({_DERIVED}))
    SELECT collection_id, agreement_id, key, CASE WHEN der.state = 'ambiguous' THEN 'scope_question' WHEN der.value IS NULL THEN 'none' WHEN reg.content_hash = der.content_hash THEN 'unchanged' WHEN conflict_kind IS NOT NULL THEN 'conflict' ELSE 'register_update' END AS kind,
      reg.value AS before, der.value AS after, der.state AS state, der.content_hash AS content_hash, coalesce(reg.version, 0) AS base_version, reg.content_hash AS before_hash FROM der LEFT JOIN reg USING (collection_id, agreement_id, key))"""


@query(_PROPOSALS, "facts")
def d9_proposals(spark: SparkSession, d: str) -> DataFrame:
    return _proposed(spark, d)[1]


@query(f"""SELECT * FROM (WITH reg AS (SELECT *, {_HASH} FROM ({_REGISTER})), p AS (SELECT * FROM ({_PROPOSALS}) WHERE kind IN ('conflict', 'register_update') AND after % 3 <> 0)
    SELECT collection_id, agreement_id, key, coalesce(p.after, reg.value) AS value, coalesce(p.state, reg.state) AS state, coalesce(p.content_hash, reg.content_hash) AS content_hash, coalesce(reg.version, 0) + CASE WHEN p.content_hash IS NOT NULL THEN 1 ELSE 0 END AS version
    FROM reg FULL JOIN p USING (collection_id, agreement_id, key))""", "facts")
def d10_w6_committed_register(spark: SparkSession, d: str) -> DataFrame:
    reg, approved = _approved(spark, d)
    done = spark.createDataFrame([(0,)], "run_id long")
    return register.commit(1, reg, approved, done)["register"]


@query(f"""SELECT * FROM (WITH reg AS ({_REGISTER}), later AS (SELECT collection_id, agreement_id, key, version + CASE WHEN value % 5 = 0 THEN 1 ELSE 0 END AS version FROM reg WHERE value % 7 <> 0)
    SELECT collection_id, agreement_id, key, reg.version AS "then", later.version AS now FROM reg FULL JOIN later USING (collection_id, agreement_id, key) WHERE reg.version IS DISTINCT FROM later.version)""", "facts")
def d11_binding_drift(spark: SparkSession, d: str) -> DataFrame:
    reg = _register(spark, d)
    later = reg.where("value % 7 <> 0").withColumn("version", F.col("version") + F.when(F.col("value") % 5 == 0, 1).otherwise(0))
    return register.drift(reg, later)


@query("""SELECT document_id, CASE WHEN duplicate THEN 'duplicate_noop' WHEN party_id % 11 = 0 THEN 'nothing_to_rederive' WHEN party_id % 7 = 0 THEN 'stale' WHEN status = 'P' THEN 'blocked' WHEN party_id % 3 = 0 THEN 'unconfirmed' ELSE 'committed' END AS report
    FROM (SELECT *, row_number() OVER (PARTITION BY collection_id, sha256(text) ORDER BY ingested_at, document_id) > 1 AS duplicate FROM docs)""", "docs")
def d12_g2_report_status(spark: SparkSession, d: str) -> DataFrame:
    docs = frames.documents(spark, d)
    w = Window.partitionBy("collection_id", F.sha2("text", 256)).orderBy("ingested_at", "document_id")
    rows = docs.withColumn("duplicate", F.row_number().over(w) > 1).select("document_id", "duplicate", (F.col("party_id") % 11).alias("n_outstanding"), (F.col("party_id") % 7 == 0).cast("int").alias("n_stale"), (F.col("status") == "P").alias("blocked"), (F.col("party_id") % 3 != 0).alias("confirmed"))
    return register.report_status(rows).select("document_id", "report")


@query("SELECT code, scope FROM rules WHERE scope IN ('source', 'both')", "rules")
def r2_rules_for_stage(spark: SparkSession, d: str) -> DataFrame:
    return rules.for_stage(frames.rules(spark), "source").select("code", "scope")


# The documents of these tables are within the budget, so all their blocks are shown; tests have tighter budgets.
_FLAGGED = "regexp_matches(text, '(?i)\\bignore\\s+previous\\s+instructions\\b')"


@query(f"""SELECT document_id, code, row_number() OVER (PARTITION BY document_id, code ORDER BY block_index) - 1 AS position, block_index, length(text) AS n_chars FROM blocks, rules WHERE scope IN ('source', 'both') AND NOT {_FLAGGED}""", "blocks", "rules")
def t21_r3_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """The excerpts each source rule would see of each document, without blocks that speak to the reader's model."""
    e = rules.excerpted(review.quarantined(frames.blocks(spark, d)), frames.rules(spark))
    return e.select("document_id", "code", F.col("position").cast("long").alias("position"), "block_index", F.length("text").cast("long").alias("n_chars"))


_WORDS = lambda x: f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z]{{4,}}'), lambda w: NOT list_contains({rules.CONTENT_STOP!r}, w)))"
_LIMITS = "SELECT code, rule_text, CASE code WHEN 'LIA-01' THEN 'at_least' WHEN 'PAY-01' THEN 'at_most' END AS kind, CASE code WHEN 'LIA-01' THEN 250000 WHEN 'PAY-01' THEN 45 END AS bound, CASE code WHEN 'LIA-01' THEN 'liability' WHEN 'PAY-01' THEN 'payment' END AS subject FROM rules WHERE scope IN ('source', 'both')"
_MONEY, _DAYS = "regexp_extract(q, '(?:USD|US\\$|\\$)\\s*(\\d[\\d,]*(?:\\.\\d+)?)', 1)", "regexp_extract(q, '(?i)(\\d[\\d,]*)\\s*\\)?\\s*(?:[a-z]+\\s+){0,2}days?\\b', 1)"


@query(f"""SELECT * FROM (WITH s AS (SELECT document_id, block_index, i, trim(l[i]) AS q FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT document_id, block_index, string_split(regexp_replace(text, '([.!?])\\s+(["“(A-Z0-9])', '\\1' || chr(2) || '\\2', 'g'), chr(2)) AS l FROM blocks))),
    m AS (SELECT code, document_id, kind, bound, block_index, i, q, contains(lower(q), subject) AS has, len(list_intersect({_WORDS("rule_text")}, {_WORDS("q")})) AS overlap, CAST(replace(nullif(CASE code WHEN 'LIA-01' THEN {_MONEY} ELSE {_DAYS} END, ''), ',', '') AS DOUBLE) AS n FROM s, ({_LIMITS})),
    b AS (SELECT code, document_id, any_value(kind) AS kind, any_value(bound) AS bound, arg_min(ROW(n, q, block_index), ROW(NOT has, -overlap, block_index, i)) FILTER (WHERE kind IS NOT NULL AND (has OR overlap >= 3) AND n IS NOT NULL) AS f FROM m GROUP BY ALL)
    SELECT code, document_id AS target, CASE WHEN f IS NULL THEN 'insufficient_evidence' WHEN kind = 'at_least' AND f[1] < bound OR kind = 'at_most' AND f[1] > bound THEN 'violation' ELSE 'pass' END AS verdict, f[2] AS quote, f[3] AS block_index FROM b)""", "blocks", "rules")
def t25_r3_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Every source rule judged over every document's blocks by the threshold evaluator."""
    return rules.evaluate_all(frames.blocks(spark, d).withColumnRenamed("document_id", "target"), rules.for_stage(frames.rules(spark), "source"))


@query("""SELECT code, document_id AS target, CASE WHEN f IS NOT NULL AND v = 'violation' THEN 'insufficient_evidence' ELSE v END AS verdict, f AS failure, CASE WHEN f IS NULL THEN CAST(instr(text, q) - 1 AS BIGINT) END AS quote_start, CASE WHEN f IS NULL THEN CAST(instr(text, q) - 1 + length(q) AS BIGINT) END AS quote_end FROM
    (SELECT *, CASE WHEN q = '' THEN 'no quote was offered' WHEN text IS NULL THEN 'the excerpt was never offered' WHEN instr(text, q) = 0 THEN 'the quote is not verbatim in the excerpt' END AS f FROM
      (SELECT 'PAY-01' AS code, d.document_id, CASE WHEN d.document_id % 2 = 0 THEN 'violation' ELSE 'pass' END AS v, CASE d.document_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Payment' ELSE 'e' END AS q, b.text
       FROM docs d LEFT JOIN blocks b ON b.document_id = d.document_id AND b.block_index = d.document_id % 4))""", "docs", "blocks")
def r4_grounded_verdicts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("document_id")
    v = frames.documents(spark, d).select(F.lit("PAY-01").alias("code"), k.alias("target"), F.when(k % 2 == 0, "violation").otherwise("pass").alias("verdict"), F.when(k % 5 == 0, "").when(k % 5 == 1, "Payment").otherwise("e").alias("quote"), (k % 4).alias("excerpt"))
    e = frames.blocks(spark, d).select(k.alias("target"), F.col("block_index").alias("excerpt"), F.col("block_index").alias("block"), "text")
    return rules.ground(v, e)


@query(f"""SELECT code, CASE r WHEN 2 THEN 'violation' WHEN 1 THEN 'insufficient_evidence' ELSE 'pass' END AS verdict, n_judged, coalesce(targets, '') AS targets FROM
    (SELECT code, max(t) AS r, count(*) AS n_judged, string_agg(DISTINCT CASE WHEN k = t AND k > 0 THEN target END, ',' ORDER BY CASE WHEN k = t AND k > 0 THEN target END) AS targets FROM
      (SELECT *, max(k) OVER (PARTITION BY code) AS t FROM (SELECT *, CASE verdict WHEN 'violation' THEN 2 WHEN 'insufficient_evidence' THEN 1 ELSE 0 END AS k FROM ({_FINDINGS}))) GROUP BY code)""", "facts", "rules")
def a6_r7_worst_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return rules.worst(_findings(spark, d))


@query(f"""SELECT count(*) AS completed, count(*) FILTER (WHERE verdict = 'pass') AS pass, count(*) FILTER (WHERE verdict = 'violation') AS violation, count(*) FILTER (WHERE verdict = 'insufficient_evidence') AS insufficient_evidence, any_value(due) AS expected, count(*) = any_value(due) AS complete,
    count(*) = any_value(due) AND any_value(due) > 0 AND count(*) FILTER (WHERE verdict <> 'pass') = 0 AS clean FROM ({_FINDINGS}), (SELECT CAST(sum(n) AS BIGINT) AS due FROM (SELECT key, count(*) AS n FROM facts GROUP BY key) JOIN rules ON len(target_keys) = 0 OR list_contains(target_keys, key) WHERE scope <> 'source')""", "facts", "rules")
def a4_a5_rules_summary(spark: SparkSession, d: str) -> DataFrame:
    # expected comes from how many facts have each key, not from what was judged
    n = frames.facts(spark, d).groupBy("key").agg(F.count("*").alias("n"))
    expected = rules.applicable(rules.for_stage(frames.rules(spark), "deliverable"), n).agg(F.sum("n")).first()[0] or 0
    return rules.summary(_findings(spark, d), expected)


@query(f"""SELECT run_id, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM (SELECT collection_id AS run_id, * FROM ({_FINDINGS})) WHERE verdict = 'violation' AND severity = 'blocker' GROUP BY run_id""", "facts", "rules")
def p9_r10_upheld_blockers(spark: SparkSession, d: str) -> DataFrame:
    f = _findings(spark, d).select(F.col("collection_id").alias("run_id"), F.lit("finding").alias("kind"), F.when(F.col("verdict") == "violation", "approved").otherwise("rejected").alias("state"), "severity", "code")
    return rules.blockers(f)


# Millionths of a dollar, exactly: tokens times price in decimals, rounded once at the end.
_MICROS = "CASE WHEN tokens_in = 0 AND tokens_out = 0 THEN 0 ELSE coalesce(CAST(tokens_in AS DECIMAL(15, 0)) * price_in + CAST(tokens_out AS DECIMAL(15, 0)) * price_out, 0) END"
_UNPRICED = "NOT (tokens_in = 0 AND tokens_out = 0) AND price_in IS NULL"


def _usd(micros: str, places: int) -> str:
    return f"CAST(round(CAST({micros} AS DECIMAL(28, 4)) * CAST(0.000001 AS DECIMAL(7, 6)), {places}) AS DOUBLE)"


@query(f"SELECT e.event_id, {_usd(_MICROS, 9)} AS spend, {_UNPRICED} AS unpriced FROM run_events e LEFT JOIN prices USING (model)", "run_events", "prices")
def r11_event_cost(spark: SparkSession, d: str) -> DataFrame:
    return cost.priced(frames.run_events(spark, d), frames.prices(spark)).select("event_id", cost.usd(F.col("micros"), 9).alias("spend"), "unpriced")


_STAGE_COST = f"""SELECT e.run_id, e.stage, count(*) AS attempt_count, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, {_usd(f"sum({_MICROS})", 6)} AS spend_usd,
    bool_or({_UNPRICED}) AS unpriced_usage, string_agg(DISTINCT e.model, ',' ORDER BY e.model) AS models, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, count(*) FILTER (WHERE cache_hit) AS cache_hits, count(external_service) AS external_service_calls, any_value(replay_attempts) AS replay_attempts,
    any_value(replay_attempts) IS NOT NULL AS ledger_backed
    FROM run_events e LEFT JOIN prices USING (model) LEFT JOIN (SELECT run_id, stage, CAST(sum(greatest(attempts - 1, 0)) AS BIGINT) AS replay_attempts FROM ledger GROUP BY ALL) l ON l.run_id = e.run_id AND l.stage = e.stage GROUP BY e.run_id, e.stage"""


@query(_STAGE_COST, "run_events", "ledger", "prices")
def a7_a9_stage_cost(spark: SparkSession, d: str) -> DataFrame:
    s = cost.by_stage(frames.run_events(spark, d), frames.ledger(spark, d), frames.prices(spark))
    return s.select("run_id", "stage", "attempt_count", "duration_ms", cost.usd(F.col("micros"), 6).alias("spend_usd"), "unpriced_usage", F.array_join("models", ",").alias("models"), "tokens_in", "tokens_out", "cache_hits", "external_service_calls", "replay_attempts", "ledger_backed")


@query(f"SELECT run_id, stage, row_number() OVER (PARTITION BY run_id, stage ORDER BY ts, event_id) AS attempt, decision, duration_ms, model, tokens_in, tokens_out, {_usd(_MICROS, 6)} AS spend_usd, {_UNPRICED} AS unpriced, cache_hit, external_service FROM run_events LEFT JOIN prices USING (model)", "run_events", "prices")
def a7_stage_attempts(spark: SparkSession, d: str) -> DataFrame:
    """The attempts of each stage in order, one row each: a stage may have more than a row could hold nested."""
    return cost.attempts(frames.run_events(spark, d), frames.prices(spark))


@query(f"""SELECT run_id, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, {_usd(f"sum({_MICROS})", 6)} AS spend_usd, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out,
    bool_or({_UNPRICED}) AS has_unpriced_usage, count(*) AS attempts, coalesce(string_agg(DISTINCT model, ',' ORDER BY model) FILTER (WHERE {_UNPRICED}), '') AS unpriced_models FROM run_events LEFT JOIN prices USING (model) GROUP BY run_id""", "run_events", "prices")
def a8_run_cost(spark: SparkSession, d: str) -> DataFrame:
    return cost.totals(cost.by_stage(frames.run_events(spark, d), frames.ledger(spark, d), frames.prices(spark)))


# Review items are events: their kind by event type, their state by decision.
_REVIEWS = "SELECT event_id AS item, run_id, CASE stage WHEN 'purchase' THEN 'finding' WHEN 'signup' THEN 'classification' WHEN 'error' THEN 'conflict' ELSE 'register_update' END AS kind, CASE decision WHEN 'ok' THEN 'approved' WHEN 'failed' THEN 'rejected' ELSE 'pending' END AS state, model AS actor, ts FROM run_events"


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    e = frames.run_events(spark, d)
    kind = F.when(F.col("stage") == "purchase", "finding").when(F.col("stage") == "signup", "classification").when(F.col("stage") == "error", "conflict").otherwise("register_update")
    return e.select(F.col("event_id").alias("item"), "run_id", kind.alias("kind"), F.when(F.col("decision") == "ok", "approved").when(F.col("decision") == "failed", "rejected").otherwise("pending").alias("state"), F.col("model").alias("actor"), "ts")


@query(f"SELECT kind, state, count(*) AS n, count(DISTINCT run_id) AS n_runs FROM ({_REVIEWS}) GROUP BY ALL", "run_events")
def a12_reviews_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return review.review_counts(_reviews(spark, d))


@query(f"SELECT CASE agreement_id WHEN '' THEN '(no agreement named)' ELSE agreement_id END AS label, count(*) AS n_rows, string_agg(DISTINCT key, ',' ORDER BY key) AS keys FROM ({_REGISTER}) GROUP BY 1", "facts")
def a13_k7_register_by_agreement(spark: SparkSession, d: str) -> DataFrame:
    return relational.by_agreement(_register(spark, d)).withColumn("keys", F.array_join("keys", ","))


@query("SELECT event_id, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS seq FROM run_events", "run_events")
def a14_event_sequence(spark: SparkSession, d: str) -> DataFrame:
    return events.sequenced(frames.run_events(spark, d)).select("event_id", "seq")


@query("""SELECT run_id, CAST(sum(CASE WHEN tokens_in > 0 THEN duration_ms ELSE 0 END) AS BIGINT) AS model_time, count(*) FILTER (WHERE cache_hit) AS cache_hits, count(*) FILTER (WHERE model = 'mystery' AND tokens_in > 0) AS unpriced, count(*) FILTER (WHERE decision = 'failed') AS failed FROM run_events GROUP BY run_id""", "run_events")
def a15_dashboard(spark: SparkSession, d: str) -> DataFrame:
    return review.run_dashboard(frames.run_events(spark, d), (F.col("model") == "mystery") & (F.col("tokens_in") > 0))


@query("""SELECT collection_id, count(*) AS n_rows, count(DISTINCT sha256(text)) AS n_texts, count(*) - count(DISTINCT sha256(text)) AS n_repeats FROM docs GROUP BY collection_id""", "docs")
def a17_exactly_once_audit(spark: SparkSession, d: str) -> DataFrame:
    return review.exactly_once(frames.documents(spark, d), "collection_id", F.sha2("text", 256))


@query("""SELECT p_brand, p_partkey AS ruleset_id, p_size AS version FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey DESC) AS r FROM part) WHERE r = 1""")
def k1_g1_active_ruleset(spark: SparkSession, d: str) -> DataFrame:
    p = frames.table(spark, d, "part")
    return relational.latest(p, ["p_brand"], [F.desc("p_size"), F.desc("p_partkey")]).select("p_brand", F.col("p_partkey").alias("ruleset_id"), F.col("p_size").alias("version"))


# An amendment's relation names a target if a master agreement of its collection declares that reference.
_NAMED = "SELECT m.document_id AS target, a.document_id FROM (SELECT collection_id, ref, max_by(document_id, ROW(ingested_at, document_id)) AS document_id FROM r WHERE doc_type = 'master_agreement' GROUP BY ALL) m JOIN (SELECT * FROM r WHERE doc_type = 'amendment') a USING (collection_id, ref)"


def _targets(spark: SparkSession, d: str) -> DataFrame:
    docs = frames.documents(spark, d).withColumn("ref", T.agreement_ref(F.col("text")))
    declared = docs.where("doc_type = 'master_agreement'").withColumnRenamed("ref", "agreement_ref")
    claims = docs.where("doc_type = 'amendment'").select("document_id", "collection_id", F.col("ref").alias("target_ref"))
    return relational.resolved(claims, declared).where("target_document_id is not null").select("document_id", F.col("target_document_id").alias("target"))


@query(f"""SELECT * FROM (WITH r AS ({_REFS}), named AS ({_NAMED}) SELECT document_id, coalesce((SELECT max(n.target) FROM named n WHERE n.document_id = d.document_id),
    (SELECT max_by(m.document_id, ROW(m.ingested_at, m.document_id)) FROM docs m WHERE m.party_id = d.party_id AND m.doc_type IN ('master_agreement', 'sow') AND ROW(m.ingested_at, m.document_id) < ROW(d.ingested_at, d.document_id))) AS target FROM docs d WHERE doc_type = 'amendment')""", "docs")
def k2_d7_supersession_target(spark: SparkSession, d: str) -> DataFrame:
    docs = frames.documents(spark, d)
    return derive.supersession_target(docs, _targets(spark, d))


@query("""SELECT run_id, grp, any_value(stage) AS stage, count(*) AS attempts, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, coalesce(max(CASE WHEN change = 1 AND branched THEN 1 END), 0) AS depth FROM
    (SELECT *, CAST(sum(change) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS BIGINT) AS grp FROM (SELECT *, CASE WHEN lag(stage) OVER w = stage THEN 0 ELSE 1 END AS change, lag(decision) OVER w = 'branch' AS branched FROM run_events WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id))) GROUP BY run_id, grp""", "run_events")
def k4_attempt_groups(spark: SparkSession, d: str) -> DataFrame:
    return events.attempts(frames.run_events(spark, d))


@query("SELECT code, CASE severity WHEN 'blocker' THEN 1 WHEN 'major' THEN 2 WHEN 'minor' THEN 3 ELSE 4 END AS rank FROM rules", "rules")
def k6_severity_order(spark: SparkSession, d: str) -> DataFrame:
    return frames.rules(spark).select("code", review.severity_rank(F.col("severity")).alias("rank")).orderBy("rank", "code")


@query("SELECT document_id, collection_id, sha256(text) AS sha FROM (SELECT *, row_number() OVER (PARTITION BY collection_id, sha256(text) ORDER BY ingested_at, document_id) AS r FROM docs) WHERE r = 1", "docs")
def w1_g3_insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    new = frames.documents(spark, d).select("document_id", "collection_id", F.sha2("text", 256).alias("sha"), "ingested_at")
    stored, _ = register.insert_if_absent(new.limit(0), new, ["collection_id", "sha"], ["ingested_at", "document_id"])
    return stored.select("document_id", "collection_id", "sha")


@query("""SELECT c_custkey AS fact_key, c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS label FROM customer UNION ALL SELECT 1000000000 + s_suppkey, s_suppkey, 'new' FROM supplier""")
def w2_upsert(spark: SparkSession, d: str) -> DataFrame:
    c = frames.table(spark, d, "customer").select(F.col("c_custkey").alias("fact_key"), F.col("c_custkey").alias("id"), F.lit("old").alias("label"))
    n = c.where("fact_key % 3 = 0").select("fact_key", (F.col("id") + 7).alias("id"), F.lit("new").alias("label"))
    s = frames.table(spark, d, "supplier").select((F.lit(1_000_000_000) + F.col("s_suppkey")).alias("fact_key"), F.col("s_suppkey").alias("id"), F.lit("new").alias("label"))
    return register.upsert(c, n.unionByName(s), ["fact_key"], ["id"])


@query("""SELECT run_id, stage, tokens_in AS input, count(*) FILTER (WHERE NOT coalesce(completes, false)) AS attempts, max_by(status, ROW(ts, seq)) AS status, min_by(output, ROW(ts, seq)) FILTER (WHERE output IS NOT NULL) AS output FROM
    (SELECT *, lag(status) OVER (PARTITION BY run_id, stage, tokens_in ORDER BY ts, seq) = 'started' AND status = 'completed' AS completes FROM (SELECT *, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'started' ELSE 'completed' END AS status, CASE WHEN event_id % 2 = 1 THEN event_id END AS output FROM run_events)) GROUP BY run_id, stage, tokens_in""", "run_events")
def w3_ledger_fold(spark: SparkSession, d: str) -> DataFrame:
    e = frames.run_events(spark, d)
    odd = F.col("event_id") % 2
    return events.ledger_fold(e.select("run_id", "stage", F.col("tokens_in").alias("input"), "ts", F.col("event_id").alias("seq"), F.when(odd == 0, "started").otherwise("completed").alias("status"), F.when(odd == 1, F.col("event_id")).alias("output")))


@query("""SELECT run_id AS item, min_by(model, ROW(ts, event_id)) AS actor, min_by(CASE WHEN cache_hit THEN 'rejected' ELSE 'approved' END, ROW(ts, event_id)) AS decision FROM run_events GROUP BY run_id""", "run_events")
def w4_g11_decisions(spark: SparkSession, d: str) -> DataFrame:
    e = frames.run_events(spark, d)
    return events.decide(e.select(F.col("run_id").alias("item"), F.col("model").alias("actor"), F.when(F.col("cache_hit"), "rejected").otherwise("approved").alias("decision"), "ts", F.col("event_id").alias("seq")))[0]


@query("""SELECT * FROM (WITH RECURSIVE t AS (SELECT run_id, model AS owner, ts, event_id AS seq, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS r FROM run_events),
    f AS (SELECT run_id, seq, owner, true AS granted, owner AS holder, ts + INTERVAL 36000 SECOND AS until, r FROM t WHERE r = 1
      UNION ALL SELECT t.run_id, t.seq, t.owner, f.holder = t.owner OR f.until <= t.ts, CASE WHEN f.holder = t.owner OR f.until <= t.ts THEN t.owner ELSE f.holder END, CASE WHEN f.holder = t.owner OR f.until <= t.ts THEN t.ts + INTERVAL 36000 SECOND ELSE f.until END, t.r FROM f JOIN t ON t.run_id = f.run_id AND t.r = f.r + 1)
    SELECT run_id, seq, owner, granted FROM f)""", "run_events")
def w8_leases(spark: SparkSession, d: str) -> DataFrame:
    e = frames.run_events(spark, d)
    return events.leases(e.select("run_id", F.col("model").alias("owner"), "ts", F.col("event_id").alias("seq")), 36_000)


@query("""SELECT run_id AS request_key, count(DISTINCT stage) AS n_fingerprints, count(*) AS n_requests FROM run_events GROUP BY 1 HAVING count(DISTINCT stage) > 1""", "run_events")
def w10_idempotency_claims(spark: SparkSession, d: str) -> DataFrame:
    return events.claims(frames.run_events(spark, d).select(F.col("run_id").alias("request_key"), F.col("stage").alias("fingerprint")))


# A quarter of the documents is read with less confidence; people answer for some of them, not always with a type.
@query("""SELECT document_id, doc_type, confidence >= 0.7 AS proceeds, CASE WHEN confidence >= 0.7 THEN doc_type WHEN status = 'F' THEN 'sow' END AS final_type FROM
    (SELECT document_id, doc_type, status, CASE doc_type WHEN 'amendment' THEN 0.95 WHEN 'master_agreement' THEN 0.96 WHEN 'invoice' THEN 0.94 WHEN 'policy' THEN 0.91 ELSE 0.93 END - CASE WHEN document_id % 4 = 1 THEN 0.3 ELSE 0 END AS confidence FROM docs)""", "docs")
def g4_classification_gate(spark: SparkSession, d: str) -> DataFrame:
    docs = frames.documents(spark, d)
    said = docs.select("document_id", T.classify(F.col("text")).alias("c")).select("document_id", "c.doc_type", (F.col("c.confidence") - F.when(F.col("document_id") % 4 == 1, 0.3).otherwise(0.0)).alias("confidence"))
    answers = docs.where("status <> 'P'").select("document_id", F.when(F.col("status") == "F", "sow").otherwise("memo").alias("answer"))
    return review.classified(said, answers).select("document_id", "doc_type", "proceeds", "final_type")


@query("SELECT event_id AS id, 0 AS place, 'c' || CAST(event_id AS VARCHAR) AS change_id, 'b' || CAST(user_id AS VARCHAR) AS batch_id, CAST(2 AS BIGINT) AS batch_total FROM events WHERE event_id % 4 <> 3 UNION ALL SELECT event_id, 1, 'd' || CAST(event_id AS VARCHAR), 'own', 2 FROM events WHERE event_id % 4 = 0")
def n1_n4_nested_changes(spark: SparkSession, d: str) -> DataFrame:
    """Batches in four shapes: a wrapper, a wrapper in a string, a single change, and no JSON at all."""
    e = frames.table(spark, d, "events")
    i, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    one = F.concat(F.lit('{"change_id":"c'), i, F.lit('"'))
    wrap = F.concat(F.lit('{"batch_id":"b'), u, F.lit('","batch_total":2,"changes":['), one, F.lit("}"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit(',{"change_id":"d'), i, F.lit('","batch_id":"own"}'))).otherwise(""), F.lit("]}"))
    single = F.concat(one, F.lit(',"batch_id":"b'), u, F.lit('","batch_total":2}'))
    quoted = F.concat(F.lit('"'), F.replace(wrap, F.lit('"'), F.lit('\\"')), F.lit('"'))
    content = F.when(F.col("event_id") % 4 == 0, wrap).when(F.col("event_id") % 4 == 1, quoted).when(F.col("event_id") % 4 == 2, single).otherwise("not json")
    return nested.changes(e.select(F.col("event_id").alias("id"), content.alias("content"))).select("id", "place", "change_id", "batch_id", "batch_total")


@query("""SELECT * FROM (WITH RECURSIVE c AS (SELECT user_id, event_id AS k, CAST(event_id % 9 + 1 AS BIGINT) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id % 9, event_id) AS r FROM events),
    f AS (SELECT user_id, k, CAST(0 AS BIGINT) AS used_before, true AS allowed, n AS used, r FROM c WHERE r = 1
      UNION ALL SELECT c.user_id, c.k, f.used, f.used + c.n <= 60, f.used + CASE WHEN f.used + c.n <= 60 THEN c.n ELSE 0 END, c.r FROM f JOIN c ON c.user_id = f.user_id AND c.r = f.r + 1)
    SELECT user_id, k, used_before, allowed FROM f)""")
def n5_budget(spark: SparkSession, d: str) -> DataFrame:
    """Calls of each user in order of time against a budget; a fold, since a refused call uses nothing."""
    e = frames.table(spark, d, "events").select("user_id", "ts", F.col("event_id").alias("k"), (F.col("event_id") % 9 + 1).alias("n"))
    return nested.within_budget(e, 60, ["ts"], ["user_id"])


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def k9_first_of_each(spark: SparkSession, d: str) -> DataFrame:
    return nested.first_of_each(frames.table(spark, d, "events"), "user_id", ["event_id"]).select("user_id", "event_id")


@query("SELECT doc_id, source, lang, 'watch:sha256:' || sha256(text) AS watch_key FROM (SELECT *, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def st3_once_each(spark: SparkSession, d: str) -> DataFrame:
    from ledgerloom.functions import hashing

    x = frames.table(spark, d, "documents").withColumn("watch_key", hashing.watch_key(F.col("text").cast("binary")))
    return relational.latest(x, ["source", "watch_key"], ["doc_id"]).select("doc_id", "source", "lang", "watch_key")


@query("""SELECT event_id, coalesce(lag(size) OVER w = size AND lag(mtime) OVER w = mtime AND lag(poll) OVER w = poll - 1, false) AS stable FROM
    (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS poll, event_id % 3 AS size, event_id % 2 AS mtime FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY poll)""")
def st2_stable_sightings(spark: SparkSession, d: str) -> DataFrame:
    from ledgerloom.streaming import watch

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = frames.table(spark, d, "events").select("event_id", F.col("user_id").alias("path"), F.row_number().over(w).alias("poll"), (F.col("event_id") % 3).alias("size"), (F.col("event_id") % 2).alias("mtime"))
    return watch.stable(e).select("event_id", "stable")


@query(f"""SELECT collection_id, agreement_id, key, version, n AS n_quotes, first_fact, first_document FROM ({_REGISTER}) JOIN (SELECT collection_id, agreement_id, key, count(*) AS n, min(fact_id) AS first_fact, min_by(document_id, fact_id) AS first_document FROM facts GROUP BY ALL) USING (collection_id, agreement_id, key)""", "facts")
def o1_j17_register_export(spark: SparkSession, d: str) -> DataFrame:
    f = frames.facts(spark, d)
    reg = _register(spark, d).withColumn("item_id", _item())
    cited = f.groupBy(_item().alias("item_id")).agg(F.min_by("document_id", "fact_id").alias("first_document"))
    rows = relational.citation_counts(reg, f.select(_item().alias("item_id"), "fact_id", F.lit("").alias("fingerprint"))).join(cited, "item_id")
    return rows.select("collection_id", "agreement_id", "key", "version", F.col("n_facts").alias("n_quotes"), "first_fact", "first_document")


@query("SELECT event_id AS eventId, user_id AS userId, event_type AS eventType FROM events")
def io14_camel_case(spark: SparkSession, d: str) -> DataFrame:
    return nested.camel_names(frames.table(spark, d, "events").select("event_id", "user_id", "event_type"))


# Approved proposals as a register sees them later: by the parity of their value some rows have moved.
_APPROVED = f"SELECT * FROM ({_PROPOSALS}) WHERE kind IN ('conflict', 'register_update') AND after % 3 <> 0"


@query(f"""SELECT * FROM (WITH now AS (SELECT collection_id, agreement_id, key, version + CASE WHEN value % 2 = 0 THEN 1 ELSE 0 END AS actual_version, sha256(coalesce(CAST(value AS VARCHAR), '') || '|' || state) AS actual_hash FROM ({_REGISTER}))
    SELECT collection_id, agreement_id, key, base_version, actual_version FROM ({_APPROVED}) LEFT JOIN now USING (collection_id, agreement_id, key) WHERE before_hash IS DISTINCT FROM actual_hash OR base_version <> coalesce(actual_version, 0))""", "facts")
def j14_stale_proposals(spark: SparkSession, d: str) -> DataFrame:
    reg, approved = _approved(spark, d)
    moved = reg.withColumn("version", F.col("version") + F.when(F.col("value") % 2 == 0, 1).otherwise(0))
    return register.stale(approved, moved).select("collection_id", "agreement_id", "key", "base_version", "actual_version")


@query(f"SELECT collection_id, agreement_id, key, after FROM ({_APPROVED}) p ANTI JOIN (SELECT *, {_HASH} FROM ({_REGISTER})) r ON p.collection_id = r.collection_id AND p.agreement_id = r.agreement_id AND p.key = r.key AND p.content_hash = r.content_hash", "facts")
def j15_g14_outstanding(spark: SparkSession, d: str) -> DataFrame:
    reg, approved = _approved(spark, d)
    return register.outstanding(approved, reg).select("collection_id", "agreement_id", "key", "after")


@query(f"SELECT collection_id, agreement_id, key, before AS old_value, after AS new_value FROM ({_APPROVED}) WHERE before_hash IS DISTINCT FROM content_hash", "facts")
def j9_o2_change_log(spark: SparkSession, d: str) -> DataFrame:
    done = spark.createDataFrame([(0,)], "run_id long")
    reg, approved = _approved(spark, d)
    return register.commit(1, reg, approved, done)["changes"].drop("run_id")


@query(f"""SELECT collection_id, count(*) AS n_keys, count(*) FILTER (WHERE b = a) AS n_unchanged FROM
    (SELECT r.collection_id, r.content_hash AS b, coalesce(p.content_hash, r.content_hash) AS a FROM (SELECT *, {_HASH} FROM ({_REGISTER})) r LEFT JOIN ({_APPROVED}) p USING (collection_id, agreement_id, key)) GROUP BY 1""", "facts")
def d13_unchanged_proof(spark: SparkSession, d: str) -> DataFrame:
    before, approved = _approved(spark, d)
    after = register.candidate(before, approved).select("collection_id", "agreement_id", "key", F.col("content_hash").alias("after_hash"))
    rows = before.join(after, ["collection_id", "agreement_id", "key"])
    return rows.groupBy("collection_id").agg(F.count("*").alias("n_keys"), F.count_if(F.col("content_hash") == F.col("after_hash")).alias("n_unchanged"))


@query("""SELECT agreement_id, key, '{"value":' || CAST(value AS VARCHAR) || '}' AS canonical, count(*) AS n_facts, min(fact_id) AS first_fact, max(fact_id) AS last_fact FROM facts GROUP BY agreement_id, key, value""", "facts")
def a10_a11_values_by_key(spark: SparkSession, d: str) -> DataFrame:
    return relational.values_by_key(frames.facts(spark, d), ["agreement_id", "key"])


@query("SELECT doc_type, count(*) AS n, string_agg(DISTINCT m, ',' ORDER BY m) AS method_set FROM (SELECT doc_type, CASE WHEN block_index = 0 THEN 'native' WHEN length(text) % 3 = 0 THEN 'ocr' ELSE 'table' END AS m FROM blocks) GROUP BY doc_type", "blocks")
def a16_method_sets(spark: SparkSession, d: str) -> DataFrame:
    methods = frames.blocks(spark, d).select("doc_type", F.when(F.col("block_index") == 0, "native").when(F.length("text") % 3 == 0, "ocr").otherwise("table").alias("method"))
    return relational.sets_of(methods, "doc_type", "method")


@query("""SELECT collection_id, agreement_id, key, max_by(fact_id, ROW(CAST(document_id = nd AS INT), ingested_at, document_id, line)) AS challenger_id FROM facts JOIN (SELECT collection_id, max_by(document_id, ROW(ingested_at, document_id)) AS nd FROM facts GROUP BY 1) USING (collection_id) GROUP BY ALL""", "facts")
def k3_challenger(spark: SparkSession, d: str) -> DataFrame:
    f = _facts(spark, d)
    f = f.join(_run(spark, d, f), "collection_id")
    return derive.sides(f).select("collection_id", "agreement_id", "key", F.col("challenger.fact_id").alias("challenger_id")).distinct()


@query(f"SELECT code, target, verdict FROM ({_FINDINGS}) WHERE verdict <> 'pass'", "facts", "rules")
def p7_adverse_findings(spark: SparkSession, d: str) -> DataFrame:
    return review.adverse(_findings(spark, d)).select("code", "target", "verdict")


# Cached source verdicts: a document's key is known if an earlier document of the collection has the same text.
@query("""SELECT document_id, first_value(document_id) OVER (PARTITION BY collection_id, sha256(text) ORDER BY ingested_at, document_id) AS reused_from, row_number() OVER (PARTITION BY collection_id, sha256(text) ORDER BY ingested_at, document_id) > 1 AS hit FROM docs""", "docs")
def r5_w12_rule_cache(spark: SparkSession, d: str) -> DataFrame:
    docs = frames.documents(spark, d).withColumn("cache_key", hashing.source_rule_cache_key(F.col("collection_id"), F.sha2("text", 256), F.lit(None).cast("string")))
    return review.reused(docs, ["ingested_at", "document_id"]).select("document_id", "reused_from", "hit")


@query(f"""SELECT collection_id, agreement_id || '::' || key AS target, agreement_id || '::' || key || ' = {{"days":' || CAST(value AS VARCHAR) || '}} (' || state || ')' AS statement FROM ({_REGISTER}) SEMI JOIN (SELECT DISTINCT collection_id AS c, key AS k FROM ({_NEWEST})) n ON collection_id = n.c AND key = n.k""", "facts")
def r6_deliverable_targets(spark: SparkSession, d: str) -> DataFrame:
    return review.deliverable_targets(_register(spark, d), _newest(spark, d), ["collection_id", "key"])


@query(f"""SELECT c.collection_id, coalesce(n, 0) AS n_findings, CASE WHEN coalesce(n, 0) = 0 THEN 'deliverable_confirmation' ELSE 'findings' END AS gate FROM collections c LEFT JOIN (SELECT collection_id, count(*) AS n FROM ({_FINDINGS}) WHERE verdict = 'violation' AND severity = 'minor' GROUP BY 1) USING (collection_id)""", "collections", "facts", "rules")
def r8_gate_items(spark: SparkSession, d: str) -> DataFrame:
    found = _findings(spark, d)
    return review.gate_items(frames.collections(spark, d), found.where("verdict = 'violation' and severity = 'minor'"), found)


@query(f"""SELECT code, count(*) AS undecided FROM (SELECT code, target FROM ({_FINDINGS}) WHERE verdict <> 'pass' GROUP BY ALL) f ANTI JOIN (SELECT DISTINCT agreement_id || '::' || key AS target FROM facts WHERE document_id % 10 = 3 AND agreement_id <> '') d ON f.target = d.target GROUP BY code""", "facts", "rules")
def r9_undecided_items(spark: SparkSession, d: str) -> DataFrame:
    open_items = _findings(spark, d).where("verdict <> 'pass'").select("code", "target").distinct()
    decided = frames.facts(spark, d).where("document_id % 10 = 3 and agreement_id <> ''").select(relational.scoped_key().alias("target"))
    return review.undecided(open_items, decided, ["target"]).groupBy("code").agg(F.count("*").alias("undecided"))


@query("""SELECT * FROM (WITH RECURSIVE u AS (SELECT p_brand, p_partkey AS upload, p_type, CASE WHEN p_size % 3 > 0 THEN p_size % 4 END AS if_match, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part),
    f AS (SELECT p_brand, upload, p_type AS active, CAST(1 AS BIGINT) AS version, n, true AS changed, 'installed' AS outcome FROM u WHERE n = 1
      UNION ALL SELECT u.p_brand, u.upload, CASE WHEN u.p_type <> f.active AND if_match = version THEN u.p_type ELSE f.active END, f.version + CASE WHEN u.p_type <> f.active AND if_match = version THEN 1 ELSE 0 END, u.n, u.p_type <> f.active,
        CASE WHEN u.p_type = f.active THEN 'no_op' WHEN if_match = version THEN 'installed' ELSE 'stale' END FROM f JOIN u ON u.p_brand = f.p_brand AND u.n = f.n + 1)
    SELECT p_brand, upload, changed, version, outcome FROM f)""")
def w9_ruleset_install(spark: SparkSession, d: str) -> DataFrame:
    p = frames.table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("upload"), "p_type", F.when(F.col("p_size") % 3 > 0, (F.col("p_size") % 4).cast("long")).alias("if_match"))
    return review.install(p, "p_brand", "upload", "p_type")


@query(f"""SELECT collection_id, agreement_id, key, CASE value % 3 WHEN 0 THEN 'finding' WHEN 1 THEN 'proposal' ELSE 'classification' END AS kind, CASE value % 3 WHEN 1 THEN value % 4 = 0 WHEN 0 THEN value % 5 = 0 ELSE false END AS refused FROM ({_REGISTER})""", "facts")
def w11_decision_basis(spark: SparkSession, d: str) -> DataFrame:
    reg = written(_register(spark, d), "register")[0]
    basis = written(review.candidate_basis(reg, F.lit("r1")), "basis")[0]
    now = reg.join(basis, "collection_id").select("collection_id", "agreement_id", "key", "version", "content_hash", "basis")
    kind = F.when(F.col("value") % 3 == 0, "finding").when(F.col("value") % 3 == 1, "proposal").otherwise("classification")
    supplied = reg.join(basis, "collection_id").select("collection_id", "agreement_id", "key", kind.alias("kind"), F.when(F.col("value") % 4 == 0, F.col("version") - 1).otherwise(F.col("version")).alias("supplied_version"), F.col("content_hash").alias("supplied_hash"), F.when(F.col("value") % 5 == 0, "old").otherwise(F.col("basis")).alias("supplied_basis"))
    return review.basis_refused(supplied, now, ["collection_id", "agreement_id", "key"]).select("collection_id", "agreement_id", "key", "kind", "refused")


@query("""SELECT document_id, count(*) FILTER (WHERE contains(text, 'unless')) AS n_invalid, CASE WHEN count(*) FILTER (WHERE contains(text, 'unless')) = 0 THEN 'stored' WHEN count(*) FILTER (WHERE contains(text, 'without')) = 0 THEN 'repaired' ELSE 'abstained' END AS outcome FROM blocks GROUP BY document_id""", "blocks")
def g7_repair_outcomes(spark: SparkSession, d: str) -> DataFrame:
    b = frames.blocks(spark, d)
    # the first attempt quotes less than the clause, the second the whole block
    tries = b.select("document_id", F.lit(0).alias("attempt"), F.instr("text", "unless").alias("at"), "text").unionByName(b.select("document_id", F.lit(1).alias("attempt"), F.instr("text", "without").alias("at"), "text"))
    return review.repair(tries.select("document_id", "attempt", (F.col("at") == 0).alias("valid")))


@query("""SELECT party_id, max_by(doc_type, ROW(ingested_at, document_id)) AS doc_type, max_by(document_id, ROW(ingested_at, document_id)) FILTER (WHERE doc_type = 'amendment') AS last_amendment FROM docs GROUP BY party_id""", "docs")
def g19_latest_values(spark: SparkSession, d: str) -> DataFrame:
    u = frames.documents(spark, d).select("party_id", "ingested_at", "document_id", "doc_type", F.when(F.col("doc_type") == "amendment", F.col("document_id")).alias("last_amendment"))
    return review.lifecycle(u, "party_id", ["doc_type", "last_amendment"], ["ingested_at", "document_id"])


@query(f"""SELECT * FROM (WITH a AS (SELECT agreement_id, key FROM ({_NEWEST})), b AS (SELECT agreement_id, key FROM facts ANTI JOIN (SELECT DISTINCT collection_id, document_id FROM ({_NEWEST})) n USING (collection_id, document_id))
    SELECT agreement_id, key, 'new' AS origin FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT agreement_id, key, 'both' FROM (SELECT * FROM a INTERSECT SELECT * FROM b))""", "facts")
def s1_key_sets(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the newest documents against those of all documents before them."""
    f = _facts(spark, d)
    return relational.key_sets(_newest(spark, d, facts=f), _newest(spark, d, "left_anti", f), ["agreement_id", "key"])


