"""Queries over gates, decisions and recorded work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import scoping
from ledgerloom.operators import derive, extraction, relational, review
from ledgerloom.plans import frames
from ledgerloom.plans import register_queries as Q
from ledgerloom.plans import text_queries as X
from ledgerloom.plans.registry import query

# Findings with ids: one for each fact under a rule, decided by some people, about documents or register rows.
_FOUND = "SELECT code || '/' || CAST(fact_id AS VARCHAR) AS finding_id, collection_id AS run_id, code, severity, CASE WHEN line % 2 = 0 THEN 'document' ELSE 'register_item' END AS target_kind, CASE WHEN value > 45 THEN 'violation' WHEN value % 10 = 0 THEN 'insufficient_evidence' ELSE 'pass' END AS verdict, document_id FROM facts JOIN rules ON list_contains(target_keys, key) WHERE scope IN ('deliverable', 'both')"


def _found(spark: SparkSession, d: str) -> DataFrame:
    from ledgerloom.operators import rules

    playbook = rules.for_stage(frames.rules(spark), "deliverable").where(F.size("target_keys") > 0)
    rows = rules.applicable(playbook, frames.facts(spark, d))
    verdict = F.when(F.col("value") > 45, "violation").when(F.col("value") % 10 == 0, "insufficient_evidence").otherwise("pass")
    return rows.select(F.concat("code", F.lit("/"), F.col("fact_id").cast("string")).alias("finding_id"), F.col("collection_id").alias("run_id"), "code", "severity", F.when(F.col("line") % 2 == 0, "document").otherwise("register_item").alias("target_kind"), verdict.alias("verdict"), "document_id")


_DECIDED = f"SELECT finding_id, CASE document_id % 3 WHEN 0 THEN 'dismissed' ELSE 'upheld' END AS decision FROM ({_FOUND}) WHERE document_id % 5 <> 0"


def _decided(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).where("document_id % 5 <> 0").select("finding_id", F.when(F.col("document_id") % 3 == 0, "dismissed").otherwise("upheld").alias("decision"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click' ORDER BY event_id")
def p3_optional_filter(spark: SparkSession, d: str) -> DataFrame:
    e = frames.table(spark, d, "events")
    return relational.matching(e, ["event_id"], event_type="click", user_id=None).select("event_id", "user_id")


@query("SELECT event_id AS change_id, user_id AS batch_id, coalesce(event_id % 3 = 0 AND user_id % 4 > 0, false) AS decided FROM events")
def p11_decided_changes(spark: SparkSession, d: str) -> DataFrame:
    e = frames.table(spark, d, "events").select(F.col("event_id").cast("string").alias("change_id"), F.col("user_id").alias("batch_id"))
    yes = e.where("batch_id % 4 > 0 and cast(change_id as long) % 3 = 0").withColumn("decision", F.lit("approve"))
    return relational.with_decision(e, yes).select(F.col("change_id").cast("long").alias("change_id"), "batch_id", "decided")


@query(f"""SELECT CAST(collection_id AS VARCHAR) || '/' || agreement_id || '::' || key AS item_id, row_number() OVER (PARTITION BY collection_id, agreement_id, key ORDER BY fact_id) - 1 AS place, document_id, block_index, text FROM
    (SELECT * FROM facts WHERE doc_type = 'invoice') JOIN blocks b USING (document_id) WHERE block_index = line % 4 AND len({X._IMPERATIVES}) = 0""".replace("SELECT CAST(collection_id", "SELECT CAST(facts_collection").replace("PARTITION BY collection_id", "PARTITION BY facts_collection").replace("(SELECT * FROM facts", "(SELECT fact_id, document_id, collection_id AS facts_collection, agreement_id, key, line FROM facts"), "facts", "blocks")
def j12_rule_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """The blocks that back register rows, here rows about invoices; a block that is missing or flagged is passed over."""
    f = frames.facts(spark, d).where("doc_type = 'invoice'").withColumn("block_index", F.col("line") % 4)
    rows = f.groupBy(Q._item().alias("item_id")).agg(F.array_sort(F.collect_list("fact_id")).alias("fact_ids"))
    return review.register_excerpts(rows, f, review.quarantined(frames.blocks(spark, d)))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey")
def j13_existing_parents(spark: SparkSession, d: str) -> DataFrame:
    runs = frames.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return relational.existing(frames.table(spark, d, "lineitem"), runs, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT fact_id, doc_type AS found_type, status FROM (SELECT fact_id, document_id FROM facts) LEFT JOIN (SELECT document_id, doc_type, status FROM docs WHERE status <> 'P') USING (document_id)", "facts", "docs")
def j18_looked_up(spark: SparkSession, d: str) -> DataFrame:
    docs = frames.documents(spark, d).where("status <> 'P'").withColumnRenamed("doc_type", "found_type")
    return relational.looked_up(frames.facts(spark, d).select("fact_id", "document_id"), docs, "document_id", ["found_type", "status"]).drop("document_id")


@query(f"SELECT run_id, status FROM ({Q._RUNS}) ORDER BY started_at DESC, run_id")
def k8_listed_runs(spark: SparkSession, d: str) -> DataFrame:
    return relational.listed(Q._runs(spark, d), "runs").select("run_id", "status")


_REL = f"""SELECT document_id, kinds[k] AS kind, coalesce({X._ref("q")}, {X._ref("text")}, '') AS target_ref, row_number() OVER (PARTITION BY document_id ORDER BY i, k) AS place FROM (SELECT *, unnest(range(1, len(kinds) + 1)) AS k FROM (SELECT *, list_filter({X._CLAIMS}, lambda x: x IS NOT NULL) AS kinds FROM ({X._SENTENCES})))"""


@query(f"""SELECT document_id, coalesce(CASE WHEN doc_type IN ('master_agreement', 'sow') THEN {X._ref("text")} END, target_ref, '') AS agreement_id FROM docs LEFT JOIN
    (SELECT document_id, arg_min(target_ref, list_position(['amends', 'governed_by', 'references', 'supersedes'], kind)) AS target_ref FROM (SELECT document_id, kind, arg_min(target_ref, place) AS target_ref FROM ({_REL}) GROUP BY ALL) WHERE target_ref <> '' GROUP BY 1) USING (document_id)""", "docs")
def d8_agreement_order(spark: SparkSession, d: str) -> DataFrame:
    docs = frames.documents(spark, d)
    claims = extraction.relations_of(docs).select("document_id", "place", "kind", "target_ref")
    declared = docs.select("document_id", scoping.self_declared_ref(F.col("doc_type"), F.col("text")).alias("agreement_ref"))
    return derive.agreement_of(claims, declared)


@query(f"SELECT * FROM (WITH der AS ({Q._DERIVED}), want AS (SELECT collection_id, 'MSA-9' AS agreement_id, 'term_end_date' AS key FROM collections) SELECT collection_id, agreement_id, key, state, reason FROM der UNION ALL SELECT collection_id, agreement_id, key, 'missing', 'no evidence' FROM want)", "collections", "facts")
def d5_wanted_keys(spark: SparkSession, d: str) -> DataFrame:
    """Derivations of all keys and of one that no document is about."""
    f = Q._facts(spark, d)
    claims = f.where("doc_type = 'amendment'").select("collection_id", "agreement_id", "key")
    named = f.where("agreement_id <> ''").groupBy("collection_id").agg(F.count_distinct("agreement_id").alias("n_named"))
    wanted = frames.collections(spark, d).select("collection_id", F.lit("MSA-9").alias("agreement_id"), F.lit("term_end_date").alias("key")).unionByName(f.select("collection_id", "agreement_id", "key"))
    return derive.derive(f, Q._run(spark, d, f), claims, named, wanted).select("collection_id", "agreement_id", "key", "state", "reason")


@query(f"""SELECT f.finding_id, verdict, decision, coalesce(decision = 'dismissed' AND verdict <> 'pass', false) AS recheck FROM ({_FOUND}) f LEFT JOIN ({_DECIDED}) USING (finding_id)""", "facts", "rules")
def w5_finding_decisions(spark: SparkSession, d: str) -> DataFrame:
    return review.decided(_found(spark, d), _decided(spark, d)).select("finding_id", "verdict", "decision", "recheck")


@query(f"""SELECT document_id FROM (SELECT DISTINCT document_id FROM ({_FOUND})) ANTI JOIN (SELECT document_id FROM ({_FOUND}) WHERE document_id % 5 <> 0 AND document_id % 3 = 0 AND verdict <> 'pass') USING (document_id)""", "facts", "rules")
def w12_g11_cache_after_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Cached documents whose verdicts still hold: a dismissal takes its document's entry away."""
    found = Q.written(_found(spark, d), "found")[0].withColumn("cache_key", F.col("document_id"))
    rechecked = review.decided(found.select("finding_id", "verdict"), _decided(spark, d))
    return review.cache_of(found, found.select("cache_key").distinct(), rechecked).select(F.col("cache_key").alias("document_id"))


@query("SELECT document_id, fact_id, 'new' AS origin FROM facts WHERE document_id % 3 = 0 AND line = 1 UNION ALL SELECT document_id, fact_id, 'old' FROM facts WHERE document_id NOT IN (SELECT document_id FROM facts WHERE document_id % 3 = 0 AND line = 1)", "facts")
def w7_replaced_citations(spark: SparkSession, d: str) -> DataFrame:
    f = frames.facts(spark, d)
    new = f.where("document_id % 3 = 0 and line = 1").select("document_id", "fact_id", F.lit("new").alias("origin"))
    return review.replaced(f.select("document_id", "fact_id", F.lit("old").alias("origin")), new, "document_id")


@query(f"SELECT run_id, CASE WHEN run_id % 7 = 0 THEN 'conflicts' WHEN run_id % 3 = 0 THEN 'route' ELSE 'differences' END AS next FROM ({Q._RUNS})")
def g8_after_source(spark: SparkSession, d: str) -> DataFrame:
    runs = Q._runs(spark, d).select("run_id", (F.col("run_id") % 7 == 0).alias("rederive"), (F.col("run_id") % 3 == 0).alias("duplicate"))
    return review.route_after_source(runs).select("run_id", "next")


@query(f"SELECT r.document_id AS run_id, CASE WHEN a.document_id IS NULL THEN 'report' ELSE 'gate' END AS next FROM docs r LEFT JOIN (SELECT DISTINCT document_id FROM ({_FOUND}) WHERE verdict <> 'pass' AND target_kind = 'document') a USING (document_id)", "docs", "facts", "rules")
def g10_finding_router(spark: SparkSession, d: str) -> DataFrame:
    found = _found(spark, d).withColumn("run_id", F.col("document_id"))
    return review.route_findings(found, frames.documents(spark, d).select(F.col("document_id").alias("run_id")))


@query(f"""SELECT * FROM (WITH reg AS ({Q._REGISTER}), b AS (SELECT collection_id, sha256('{{"register":[' || string_agg('{{"key":"' || agreement_id || '::' || key || '","state":"supported","value":' || CAST(value AS VARCHAR) || ',"version":' || CAST(version AS VARCHAR) || '}}', ',' ORDER BY agreement_id || '::' || key) || '],"ruleset":"r1"}}') AS basis FROM reg GROUP BY 1)
    SELECT code, collection_id, basis, 'r1' AS ruleset_hash FROM collections LEFT JOIN b USING (collection_id), rules)""", "collections", "facts", "rules")
def g12_g13_bound_items(spark: SparkSession, d: str) -> DataFrame:
    """Gate items, one for each rule and collection, with what a decision on them is bound to."""
    from ledgerloom.operators import rules

    items = rules.applicable(frames.rules(spark).withColumn("target_keys", F.array().cast("array<string>")), frames.collections(spark, d).select("collection_id", F.lit("").alias("key"))).select("code", "collection_id")
    basis = review.candidate_basis(Q._register(spark, d), F.lit("r1"))
    return review.bound(items, basis, F.lit("r1"))


@query("""SELECT 'event' AS kind, run_id, count(*) AS n FROM run_events GROUP BY run_id UNION ALL SELECT 'ledger', run_id, count(*) FROM run_events WHERE event_id % 2 = 0 AND stage <> 'signup' GROUP BY run_id""", "run_events")
def g15_recorded(spark: SparkSession, d: str) -> DataFrame:
    """Every call leaves an event, those with an input hash a ledger row too: half were there before."""
    e = frames.run_events(spark, d).select("run_id", "stage", "event_id", F.when((F.col("event_id") % 2 == 0) & (F.col("stage") != "signup"), F.sha2("stage", 256)).alias("input_hash"))
    events, ledger = review.recorded(e.where("event_id % 4 < 2").select("run_id", "stage"), e.where("event_id % 4 < 2 and input_hash is not null").select("run_id", "input_hash"), e.where("event_id % 4 >= 2"))
    count = lambda kind, df: df.groupBy("run_id").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "run_id", "n")
    return count("event", events).unionByName(count("ledger", ledger))


@query(f"""SELECT * FROM (WITH b AS (SELECT DISTINCT document_id AS run_id FROM ({_FOUND}) WHERE verdict = 'violation' AND severity = 'blocker') SELECT run_id, CASE WHEN run_id % 4 = 1 THEN 'ann' END AS overridden_by, CASE WHEN run_id % 4 = 1 THEN 'overridden' ELSE 'blocked' END AS outcome FROM b)""", "facts", "rules")
def r10_g18_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Runs with upheld blockers: a reviewer's override with a reason lets them pass, others do not."""
    from ledgerloom.operators import rules

    found = _found(spark, d).select(F.col("document_id").alias("run_id"), F.lit("finding").alias("kind"), F.when(F.col("verdict") == "violation", "approved").otherwise("rejected").alias("state"), "severity", "code")
    blocked = rules.blockers(found)
    asked = blocked.select("run_id", F.when(F.col("run_id") % 4 == 1, "ann").otherwise("bot").alias("actor"), F.when(F.col("run_id") % 4 == 2, "service").otherwise("reviewer").alias("role"), F.when(F.col("run_id") % 4 == 3, " ").otherwise("known").alias("reason")).where("run_id % 4 > 0")
    return review.enforced(blocked, asked).drop("codes")


@query(f"""SELECT run_id, count(*) FILTER (WHERE NOT d) AS n_undecided, CASE WHEN count(*) FILTER (WHERE NOT d) > 0 THEN 'refused' WHEN bool_or(confirms AND declined) THEN 'blocked' ELSE 'confirmed' END AS outcome
    FROM (SELECT run_id, item % 40 <> 0 AS d, kind = 'conflict' AS confirms, item % 40 <> 0 AND state = 'rejected' AS declined FROM ({Q._REVIEWS})) GROUP BY run_id""", "run_events")
def r9_confirmed_runs(spark: SparkSession, d: str) -> DataFrame:
    items = Q._reviews(spark, d)
    decisions = items.where("item % 40 <> 0").select("run_id", "item", F.when(F.col("state") == "rejected", "rejected").otherwise("approved").alias("decision"))
    return review.confirmed(items.select("run_id", "item", F.when(F.col("kind") == "conflict", "deliverable_confirmation").otherwise("finding").alias("kind")), decisions)


@query("""SELECT user_id AS batch_id, CASE user_id % 4 WHEN 0 THEN 'names no change' WHEN 1 THEN 'names a change twice' WHEN 2 THEN 'names an unknown change' END AS problem FROM (SELECT DISTINCT user_id FROM events)""")
def n6_explicit_approval(spark: SparkSession, d: str) -> DataFrame:
    e = frames.table(spark, d, "events").select(F.col("user_id").alias("batch_id"), F.col("event_id").cast("string").alias("change_id"))
    one = e.groupBy("batch_id").agg(F.min("change_id").alias("c"))
    k = F.col("batch_id") % 4
    ids = F.when(k == 0, F.array(F.lit(" "))).when(k == 1, F.array("c", "c")).when(k == 2, F.array(F.lit("none"))).otherwise(F.array("c"))
    return review.approved_ids(one.select("batch_id", ids.alias("ids")), e).select("batch_id", "problem")


@query("""SELECT event_id, CASE WHEN event_type IN ('purchase', 'error') THEN user_id % 3 = 0 AND user_id % 2 = 1 ELSE user_id % 3 <= 1 END AS allowed FROM events""")
def u4_permitted_actions(spark: SparkSession, d: str) -> DataFrame:
    e = frames.table(spark, d, "events")
    role = F.when(F.col("user_id") % 3 == 0, "reviewer").when(F.col("user_id") % 3 == 1, "service").otherwise("guest")
    action = F.when(F.col("event_type") == "purchase", "decide").when(F.col("event_type") == "error", "override").otherwise("run")
    return review.permitted(e.select("event_id", role.alias("role"), F.when(F.col("user_id") % 2 == 0, "watcher").otherwise("ann").alias("actor"), action.alias("action"))).select("event_id", "allowed")


@query(f"""SELECT * FROM (WITH der AS ({Q._DERIVED}) SELECT collection_id, count(*) FILTER (WHERE der.state = 'disputed') AS disputed, count(*) FILTER (WHERE der.state = 'ambiguous') AS without_value, coalesce(any_value(n), 0) AS open_findings FROM der
    LEFT JOIN (SELECT run_id AS collection_id, count(*) AS n FROM ({_FOUND}) WHERE verdict <> 'pass' AND document_id % 5 = 0 GROUP BY 1) USING (collection_id) GROUP BY collection_id)""", "facts", "rules")
def a15_collection_dashboard(spark: SparkSession, d: str) -> DataFrame:
    found = _found(spark, d).select(F.col("run_id").alias("collection_id"), "verdict", F.when(F.col("document_id") % 5 == 0, "pending").otherwise("decided").alias("state"))
    return review.collection_dashboard(Q._derived(spark, d), found)


@query("""SELECT run_id, stage, tokens_in AS input, count(*) AS attempts, count(DISTINCT event_id % 3) <= 1 AS agree FROM run_events GROUP BY run_id, stage, tokens_in HAVING count(*) > 1""", "run_events")
def a17_agreeing_retries(spark: SparkSession, d: str) -> DataFrame:
    e = frames.run_events(spark, d).select("run_id", "stage", F.col("tokens_in").alias("input"), (F.col("event_id") % 3).alias("output"))
    return review.agreeing_retries(e)


@query(f"""SELECT * FROM (WITH reg AS ({Q._REGISTER}) SELECT collection_id, 'register' AS section, count(*) AS n, CAST(sum(length('{{"agreement_id":"' || agreement_id || '","key":"' || key || '","value":' || value || ',"state":"' || state || '","version":' || version || ',"n_quotes":' || m || '}}')) AS BIGINT) AS n_chars FROM reg JOIN (SELECT collection_id, agreement_id, key, count(*) AS m FROM facts GROUP BY ALL) USING (collection_id, agreement_id, key) GROUP BY 1
    UNION ALL SELECT collection_id, 'quotes', count(*), CAST(sum(length('{{"item_id":"' || collection_id || '/' || agreement_id || '::' || key || '","fact_id":' || fact_id || ',"document_id":' || document_id || ',"value":' || value || '}}')) AS BIGINT) FROM facts GROUP BY 1
    UNION ALL SELECT collection_id, 'documents', count(*), CAST(sum(length('{{"document_id":' || document_id || ',"doc_type":"' || doc_type || '"}}')) AS BIGINT) FROM docs GROUP BY 1
    UNION ALL SELECT run_id, 'findings', count(*), CAST(sum(length('{{"code":"' || code || '","target":' || document_id || ',"verdict":"' || verdict || '","severity":"' || severity || '"}}')) AS BIGINT) FROM ({_FOUND}) GROUP BY 1
    UNION ALL SELECT collection_id, 'ruleset', count(*), CAST(sum(length('{{"code":"' || code || '","rule_text":"' || rule_text || '","severity":"' || severity || '","scope":"' || scope || '"}}')) AS BIGINT) FROM collections, rules GROUP BY 1)""", "collections", "docs", "facts", "rules")
def o1_whole_export(spark: SparkSession, d: str) -> DataFrame:
    """The whole artifact of each collection by section: its rows and the length of their JSON."""
    from ledgerloom.operators import rules

    f = Q._facts(spark, d).withColumn("item_id", Q._item())
    every = rules.applicable(frames.rules(spark).withColumn("target_keys", F.array().cast("array<string>")), frames.collections(spark, d).select("collection_id", F.lit("").alias("key")))
    found = _found(spark, d).select(F.col("run_id").alias("collection_id"), "code", F.col("document_id").alias("target"), "verdict", "severity")
    out = relational.whole_export(Q._register(spark, d, f).withColumn("item_id", Q._item()), f.select("item_id", "fact_id"), f, frames.documents(spark, d), found, every)
    return out.groupBy("collection_id", "section").agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("n_chars"))


@query(f"""SELECT code, document_id AS target, CASE WHEN f IS NULL THEN 'insufficient_evidence' WHEN code = 'LIA-01' AND f < 250000 OR code = 'PAY-01' AND f > 45 THEN 'violation' ELSE 'pass' END AS verdict FROM
    (SELECT code, document_id, any_value(CASE WHEN code = 'LIA-01' AND regexp_matches(text, 'Liability') THEN CAST(replace(nullif(regexp_extract(text, '\\$(\\d[\\d,]*)', 1), ''), ',', '') AS DOUBLE) WHEN code = 'PAY-01' AND regexp_matches(text, '^Payment') THEN CAST(nullif(regexp_extract(text, '(\\d+)', 1), '') AS DOUBLE) END) AS f
     FROM blocks, rules WHERE scope IN ('source', 'both') AND len({X._IMPERATIVES}) = 0 GROUP BY code, document_id)""", "blocks", "rules")
def r3_assessed_documents(spark: SparkSession, d: str) -> DataFrame:
    """One finding for each document and source rule: excerpts, verdicts over them, and quotes held against them."""
    return review.assessed(frames.blocks(spark, d), frames.rules(spark)).select("code", "target", "verdict")


@query(f"""SELECT * FROM (WITH der AS ({Q._DERIVED}), c AS (SELECT collection_id, agreement_id, key, count(*) AS n FROM facts GROUP BY ALL) SELECT collection_id, agreement_id, key, n_in_scope AS n_cited FROM der WHERE coalesce(conflict_kind, '') <> 'supersession_candidate')""", "facts")
def d5_citations(spark: SparkSession, d: str) -> DataFrame:
    """How many facts each derivation cites, where none replaces another: all that are in scope."""
    f = Q._facts(spark, d)
    run = Q.written(Q._run(spark, d, f), "run")[0]
    active = derive.scoped(f, run)
    der = Q.written(Q._derived(spark, d, f, active), "derived")[0]
    cited = derive.citations(f, run, der, active)
    rows = der.where("coalesce(conflict_kind, '') <> 'supersession_candidate'").select("collection_id", "agreement_id", "key")
    return derive.beside(cited, rows, ["collection_id", "agreement_id", "key"]).groupBy("collection_id", "agreement_id", "key").agg(F.count("*").alias("n_cited"))


@query("""SELECT run_id AS item, actor, decision, seq FROM (SELECT run_id, model AS actor, CASE WHEN cache_hit THEN 'rejected' ELSE 'approved' END AS decision, event_id AS seq, row_number() OVER w AS n,
    first_value(model) OVER w AS a, first_value(CASE WHEN cache_hit THEN 'rejected' ELSE 'approved' END) OVER w AS d FROM run_events WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id)) WHERE n > 1 AND (actor <> a OR decision <> d)""", "run_events")
def w4_refused_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decisions that come after another's, or that say something else."""
    from ledgerloom.operators import events

    e = frames.run_events(spark, d)
    log = e.select(F.col("run_id").alias("item"), F.col("model").alias("actor"), F.when(F.col("cache_hit"), "rejected").otherwise("approved").alias("decision"), "ts", F.col("event_id").alias("seq"))
    return events.decide(log)[1].select("item", "actor", "decision", "seq")


@query("""SELECT document_id, collection_id FROM (SELECT *, row_number() OVER (PARTITION BY collection_id, sha256(text) ORDER BY CASE WHEN document_id % 2 = 0 THEN 0 ELSE 1 END, ingested_at, document_id) AS r FROM docs
    WHERE document_id % 2 = 1 OR document_id IN (SELECT min_by(document_id, ROW(ingested_at, document_id)) FROM docs WHERE document_id % 2 = 0 GROUP BY collection_id, sha256(text))) WHERE r = 1""", "docs")
def w1_into_stored(spark: SparkSession, d: str) -> DataFrame:
    """Documents of odd ids into a table that holds the even ones: what it has already is refused."""
    from ledgerloom.operators import register

    docs = frames.documents(spark, d).select("document_id", "collection_id", F.sha2("text", 256).alias("sha"), "ingested_at")
    key, order = ["collection_id", "sha"], ["ingested_at", "document_id"]
    even, _ = register.insert_if_absent(docs.limit(0), docs.where("document_id % 2 = 0"), key, order)
    return register.insert_if_absent(even, docs.where("document_id % 2 = 1"), key, order)[0].select("document_id", "collection_id")


@query("""SELECT document_id, duplicate, CASE WHEN duplicate THEN 'source_rules' ELSE 'extract' END AS branch FROM (SELECT document_id, row_number() OVER (PARTITION BY collection_id, sha256(text) ORDER BY ingested_at, document_id) > 1 AND party_id % 3 <> 0 AS duplicate FROM docs)""", "docs")
def g2_g3_ingested(spark: SparkSession, d: str) -> DataFrame:
    """Documents as runs take them in; a third of the runs had started on their text before."""
    docs = frames.documents(spark, d).select("document_id", "collection_id", F.sha2("text", 256).alias("sha"), F.col("document_id").alias("run_id"), "ingested_at", "party_id")
    return review.ingested(docs.drop("party_id"), docs.where("party_id % 3 = 0"), ["ingested_at", "document_id"]).select("document_id", "duplicate", "branch")


@query("""SELECT o_orderkey AS run_id, p_partkey AS ruleset_id, sha256(p_name) AS ruleset_hash FROM orders o ASOF LEFT JOIN (SELECT p_partkey % 7 AS c, p_partkey, p_name, TIMESTAMP '1992-01-01' + to_days(CAST(p_partkey AS INT)) AS at FROM part) p ON o.o_custkey % 7 = p.c AND o.o_orderdate >= p.at""")
def g1_pinned_rulesets(spark: SparkSession, d: str) -> DataFrame:
    """Runs with the playbook that was active when they began; one is installed each day, by turns of seven collections."""
    day = F.expr("timestamp_ntz'1992-01-01 00:00:00' + make_dt_interval(cast(p_partkey as int))")
    sets = frames.table(spark, d, "part").select((F.col("p_partkey") % 7).alias("collection_id"), day.alias("installed_at"), F.col("p_partkey").alias("ruleset_id"), F.col("p_name").alias("raw"))
    runs = frames.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 7).alias("collection_id"), F.col("o_orderdate").alias("started_at"))
    return review.pinned(runs, sets)


@query("""SELECT scope, sha256('{"name":"book","rules":[' || string_agg('{"code":"' || code || '","keys":[' || coalesce(array_to_string(list_transform(list_sort(target_keys), lambda k: '"' || k || '"'), ','), '') || '],"scope":"' || scope || '","severity":"' || severity || '","text":"' || rule_text || '"}', ',' ORDER BY code) || ']}') AS content_hash FROM rules GROUP BY scope""", "rules")
def h8_ruleset_content(spark: SparkSession, d: str) -> DataFrame:
    """Playbooks, one for each scope, by what they say: blanks and capitals around it make no difference."""
    r = frames.rules(spark).select(F.lit(" book").alias("name"), F.concat("code", F.lit(" ")).alias("code"), "rule_text", F.upper("severity").alias("severity"), "scope", F.reverse("target_keys").alias("target_keys"))
    return review.ruleset_content(r, "scope")


@query(f"""SELECT * FROM (WITH reg AS ({Q._REGISTER}), later AS (SELECT collection_id, agreement_id, key, version + CASE WHEN value % 5 = 0 THEN 1 ELSE 0 END AS version FROM reg WHERE value % 7 <> 0)
    SELECT collection_id, agreement_id || '::' || key AS what FROM reg FULL JOIN later USING (collection_id, agreement_id, key) WHERE reg.version IS DISTINCT FROM later.version
    UNION ALL SELECT collection_id, '(playbook)' FROM collections WHERE collection_id % 2 = 0)""", "collections", "facts")
def d11_binding_and_playbook(spark: SparkSession, d: str) -> DataFrame:
    reg = Q._register(spark, d)
    later = reg.where("value % 7 <> 0").withColumn("version", F.col("version") + F.when(F.col("value") % 5 == 0, 1).otherwise(0))
    sets = frames.collections(spark, d).select("collection_id", F.lit("r1").alias("bound_hash"), F.when(F.col("collection_id") % 2 == 0, "r2").otherwise("r1").alias("ruleset_hash"))
    return review.binding_drift(reg, later, sets)


@query("""SELECT run_id, event_id AS seq, i - 1 AS place, w[i] AS warning FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT run_id, event_id, string_split('block ' || CAST(duration_ms AS VARCHAR) || ' set aside; ' || stage || '; ', '; ') AS w FROM run_events WHERE event_id % 3 = 0)) WHERE w[i] <> ''""", "run_events")
def g14_carried_warnings(spark: SparkSession, d: str) -> DataFrame:
    e = frames.run_events(spark, d)
    reason = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("warnings: block "), F.col("duration_ms").cast("string"), F.lit(" set aside; "), "stage", F.lit("; "))).otherwise(F.lit("no warnings: x"))
    return review.carried_warnings(e.select("run_id", F.col("event_id").alias("seq"), reason.alias("reason")))


@query("""SELECT document_id AS id, CASE document_id % 3 WHEN 0 THEN 'violation' ELSE 'insufficient_evidence' END AS verdict, CASE document_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE 0.5 END AS confidence, rpad('r', 500, 'r') AS reason, 'notice_days' AS key, CASE WHEN document_id % 2 = 0 THEN '{"days":30}' ELSE '{"value":"30"}' END AS value,
    CASE WHEN instr(text, 'Payment') > 0 THEN instr(text, 'Payment') - 1 ELSE 0 END AS quote_start, CASE WHEN instr(text, 'Payment') > 0 THEN instr(text, 'Payment') + 6 ELSE 0 END AS quote_end FROM docs WHERE document_id % 5 <> 0""", "docs")
def t26_model_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers with words around them, too sure or not sure at all, with a fact nobody asked for and one without a value."""
    k = F.col("document_id")
    value = F.when(k % 2 == 0, F.lit('{"days":30}')).otherwise(F.lit("30"))
    fact = F.concat(F.lit('{"key":"notice_days","value":'), value, F.lit(',"quote":"Payment"},{"key":"colour","value":1},{"key":"liability_cap","value":null}'))
    verdict = F.when(k % 3 == 0, "VIOLATION").when(k % 3 == 1, "maybe").otherwise("insufficient_evidence")
    sure = F.when(k % 4 == 0, "7").when(k % 4 == 1, "-1").otherwise("0.5")
    content = F.concat(F.lit("Sure: {"), F.lit('"verdict":"'), verdict, F.lit('","confidence":'), sure, F.lit(',"reason":"'), F.lit("r" * 600), F.lit('","facts":['), fact, F.lit("]} done"))
    raw = frames.documents(spark, d).select(k.alias("id"), F.when(k % 5 == 0, "no answer").otherwise(content).alias("content"), "text")
    return review.answers(raw, ["notice_days", "liability_cap"])


@query(f"""SELECT * FROM (WITH now AS (SELECT collection_id, agreement_id, key, version + CASE WHEN value % 2 = 0 THEN 1 ELSE 0 END AS actual_version, sha256(coalesce(CAST(value AS VARCHAR), '') || '|' || state) AS actual_hash FROM ({Q._REGISTER})),
    j AS (SELECT *, before_hash IS DISTINCT FROM actual_hash OR base_version <> coalesce(actual_version, 0) AS moved FROM ({Q._APPROVED}) LEFT JOIN now USING (collection_id, agreement_id, key))
    SELECT CAST(1 AS INT) AS run_id, 'commit' AS stage, CASE WHEN count(*) FILTER (WHERE moved) > 0 THEN 'partial_commit' ELSE 'commit' END AS decision, count(*) FILTER (WHERE NOT moved AND before_hash IS DISTINCT FROM content_hash) AS n_changes, count(*) FILTER (WHERE moved) AS n_refused FROM j)""", "facts")
def g16_commit_event(spark: SparkSession, d: str) -> DataFrame:
    """What a run's commit leaves behind when some rows have moved since."""
    from ledgerloom.operators import register

    reg, approved = Q._approved(spark, d)
    moved = reg.withColumn("version", F.col("version") + F.when(F.col("value") % 2 == 0, 1).otherwise(0))
    return register.commit(1, moved, approved, spark.createDataFrame([(0,)], "run_id long"))["event"]


@query(f"SELECT finding_id, verdict FROM ({_FOUND}) WHERE verdict <> 'pass' AND target_kind = 'register_item'", "facts", "rules")
def p7_adverse_register_items(spark: SparkSession, d: str) -> DataFrame:
    return review.adverse(_found(spark, d), "register_item").select("finding_id", "verdict")
