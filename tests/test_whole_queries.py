"""Queries whose registered SQL reads a part of the facts, against SQL over all of them."""

import os

import duckdb
import pytest

from ledgerloom import catalog
from ledgerloom.plans import frames

FINDINGS = "SELECT code, severity, agreement_id || '::' || key AS target, collection_id, CASE WHEN value > 45 THEN 'violation' WHEN value % 10 = 0 THEN 'insufficient_evidence' ELSE 'pass' END AS verdict FROM facts JOIN rules ON len(target_keys) = 0 OR list_contains(target_keys, key) WHERE scope IN ('deliverable', 'both')"
RANK = "CASE verdict WHEN 'violation' THEN 2 WHEN 'insufficient_evidence' THEN 1 ELSE 0 END"

WHOLE = {
    "j6_j11_findings_by_rule": f"SELECT severity, code, verdict, count(*) AS n FROM ({FINDINGS}) GROUP BY ALL",
    "p7_adverse_findings": f"SELECT code, target, verdict FROM ({FINDINGS}) WHERE verdict <> 'pass'",
    "a4_a5_rules_summary": f"""SELECT count(*) AS completed, count(*) FILTER (WHERE verdict = 'pass') AS pass, count(*) FILTER (WHERE verdict = 'violation') AS violation, count(*) FILTER (WHERE verdict = 'insufficient_evidence') AS insufficient_evidence,
        (SELECT count(*) FROM facts, rules WHERE scope <> 'source' AND (target_keys = [] OR key IN (SELECT unnest(target_keys)))) AS expected, true AS complete, false AS clean FROM ({FINDINGS})""",
    "a6_r7_worst_verdicts": f"""SELECT code, CASE r WHEN 2 THEN 'violation' WHEN 1 THEN 'insufficient_evidence' ELSE 'pass' END AS verdict, n AS n_judged, coalesce(targets, '') AS targets FROM (SELECT code, any_value(top) AS r, count(*) AS n, string_agg(DISTINCT target, ',' ORDER BY target) FILTER (WHERE k = top AND k > 0) AS targets
        FROM (SELECT *, {RANK} AS k, max({RANK}) OVER (PARTITION BY code) AS top FROM ({FINDINGS})) GROUP BY code)""",
    "p9_r10_upheld_blockers": f"SELECT collection_id AS run_id, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM ({FINDINGS}) WHERE verdict = 'violation' AND severity = 'blocker' GROUP BY 1",
    "r8_gate_items": f"SELECT collection_id, coalesce(n, 0) AS n_findings, CASE WHEN n > 0 THEN 'findings' ELSE 'deliverable_confirmation' END AS gate FROM collections LEFT JOIN (SELECT collection_id, count(*) AS n FROM ({FINDINGS}) WHERE verdict = 'violation' AND severity = 'minor' GROUP BY 1) USING (collection_id)",
    "r9_undecided_items": f"SELECT code, count(DISTINCT target) AS undecided FROM ({FINDINGS}) WHERE verdict <> 'pass' AND target NOT IN (SELECT agreement_id || '::' || key FROM facts WHERE document_id % 10 = 3 AND agreement_id <> '') GROUP BY code",
}

NEWEST = "SELECT f.* FROM facts f WHERE NOT EXISTS (SELECT 1 FROM facts g WHERE g.collection_id = f.collection_id AND (g.ingested_at, g.document_id) > (f.ingested_at, f.document_id))"
WHOLE |= {
    "s1_key_sets": f"""SELECT agreement_id, key, CASE WHEN (agreement_id, key) IN (SELECT (agreement_id, key) FROM facts WHERE fact_id NOT IN (SELECT fact_id FROM ({NEWEST}))) THEN 'both' ELSE 'new' END AS origin FROM (SELECT DISTINCT agreement_id, key FROM ({NEWEST}))""",
    "j4_affected_keys": f"""SELECT agreement_id, key FROM ({NEWEST}) UNION SELECT r.agreement_id, r.key FROM facts r JOIN facts c ON c.collection_id = r.collection_id AND c.agreement_id = r.agreement_id AND c.key = r.key
        WHERE c.document_id IN (SELECT supersedes_id FROM facts WHERE collection_id = 1)""",
    "r6_deliverable_targets": f"""SELECT collection_id, agreement_id || '::' || key AS target, agreement_id || '::' || key || ' = {{"days":' || CAST(arg_min(value, ROW(ingested_at, document_id, line)) AS VARCHAR) || '}} (supported)' AS statement FROM facts f
        WHERE (collection_id, key) IN (SELECT (collection_id, key) FROM ({NEWEST})) GROUP BY collection_id, agreement_id, key""",
}


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_all_facts(spark, sf_dir, db, name):
    df = catalog.queries()[name](spark, sf_dir)
    want = db.sql(frames.sql(WHOLE[name], "collections", "facts", "rules")).to_df()[df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(map(tuple, want.astype(object).to_numpy().tolist()), key=repr)


def test_j4_takes_the_newest_document(spark, monkeypatch):
    rows = [(51, 5, 1, "MSA-1", "notice_days", 2, None), (41, 4, 1, "MSA-1", "liability_cap", 1, None), (42, 1001, 1, "MSA-2", "liability_cap", 1, None)]
    f = spark.createDataFrame(rows, "fact_id long, document_id long, collection_id long, agreement_id string, key string, ingested_at long, supersedes_id long")
    monkeypatch.setattr(frames, "facts", lambda *_: f)
    assert [tuple(r) for r in catalog.queries()["j4_affected_keys"](spark, "").collect()] == [("MSA-1", "notice_days")]


def test_t21_shows_every_block_that_fits_the_reference_budget(spark, sf_dir):
    shown = catalog.queries()["t21_r3_excerpts"](spark, sf_dir).groupBy("document_id", "code").count()
    master = frames.documents(spark, sf_dir).where("doc_type = 'master_agreement'").select("document_id")
    assert {r[0] for r in shown.join(master, "document_id").select("count").distinct().collect()} == {4}
