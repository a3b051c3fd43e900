"""Findings as runs carry them, by hand."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import findings, relational, review

DOCS = "document_id long, cache_key string, at int, code string"
FOUND = "document_id long, code string, verdict string, review_decision string, decided_by string, extra string"


def test_reused_verdicts_are_pending_and_dismissals_end_an_entry(spark):
    docs = spark.createDataFrame([(1, "a", 5, "x"), (2, "a", 3, "x"), (3, "a", 9, "x"), (4, "b", 1, "x"), (5, "b", 2, "x"), (6, None, 1, "x"), (7, None, 2, "x"), (8, "c", 1, "x"), (9, "c", 2, "x")], DOCS)
    rows = [(i, code, verdict, "pending", None, "e") for i in (1, 3, 5, 7, 9) for code, verdict in (("R1", "pass"), ("R2", "violation"))]
    rows += [(2, "R1", "pass", "dismissed", "ann", "e"), (2, "R2", "violation", "upheld", "ann", "e"), (4, "R1", "pass", "pending", None, "e"), (4, "R2", "violation", "dismissed", "bob", "e"), (6, "R1", "insufficient_evidence", "upheld", "ann", "e")]
    got = {(r.document_id, r.code): (r.verdict, r.origin, r.review_decision, r.decided_by) for r in findings.reuse(docs, spark.createDataFrame(rows, FOUND), ["at", "document_id"]).collect()}
    # 2 is the first of a; the dismissal of a pass changes nothing, and its decisions do not carry over
    assert got[2, "R2"] == ("violation", "evaluated", "upheld", "ann")
    assert got[1, "R2"] == got[3, "R2"] == ("violation", "reused", "pending", None) and got[1, "R1"] == ("pass", "reused", "pending", None)
    # 4 was dismissed, so 5 has its own
    assert got[4, "R2"] == ("violation", "evaluated", "dismissed", "bob") and got[5, "R2"] == ("violation", "evaluated", "pending", None)
    # a null key is a key; 8 was never evaluated, so 9 has its own
    assert got[7, "R1"] == ("insufficient_evidence", "reused", "pending", None) and (7, "R2") not in got
    assert got[9, "R1"][1] == "evaluated" and not any(d == 8 for d, _ in got) and len(got) == 14
    assert findings.reuse(docs.limit(0), spark.createDataFrame(rows, FOUND), ["at"]).count() == findings.reuse(docs, spark.createDataFrame([], FOUND), ["at"]).count() == 0


def test_everything_that_people_decide(spark):
    proposals = spark.createDataFrame([(1, "M", "k", "conflict"), (1, "M", "l", "unchanged"), (1, "", "m", "scope_question"), (2, "M", "k", "none"), (3, "M", "k", "unchanged")], "collection_id long, agreement_id string, key string, kind string")
    blocks = spark.createDataFrame([(1, 10, 0, True), (1, 10, 1, False), (4, 11, 2, True)], "collection_id long, document_id long, block_index long, flagged boolean")
    found = spark.createDataFrame([(1, 10, "R1", "document", "violation"), (1, 10, "R2", "document", "pass"), (1, 10, "R3", "register_item", "violation"), (4, 11, "R1", "document", "insufficient_evidence")], "collection_id long, document_id long, code string, target_kind string, verdict string")
    items = findings.review_items(proposals, blocks, found)
    got = sorted(((r.collection_id, r.kind, r.target_key, r.document_id) for r in items.collect() if r.force_review), key=str)
    assert got == sorted([(1, "conflict", "M::k", None), (1, "scope_question", "::m", None), (1, "injection_review", "block 0", 10), (4, "injection_review", "block 2", 11), (1, "finding", "R1", 10), (4, "finding", "R1", 11)], key=str)
    said = {r.collection_id: r for r in findings.assembled(items, proposals).collect()}
    assert (said[1].n_items, said[1].conflict, said[1].finding, said[1].unchanged, said[1].decision) == (4, 1, 1, 1, "continue")
    assert (said[2].n_items, said[2].decision, said[3].unchanged, said[3].decision, said[4].injection_review) == (0, "skip", 1, "skip", 1)


@pytest.mark.parametrize(
    ("run", "clean", "complete"),
    [
        (1, True, True),  # two passes, seen by a person
        (2, False, True),  # nothing was expected
        (3, False, False),  # a rule failed
        (4, False, True),  # a violation, dismissed or not
        (5, False, True),  # the extractor was not sure
        (6, False, True),  # nobody confirmed it
        (7, False, False),  # a verdict is missing
        (8, False, True),  # one of two people declined
    ],
)
def test_clean_is_a_claim_with_a_name(spark, run, clean, complete):
    runs = spark.createDataFrame([(1, 2, 2, 0), (2, 0, 0, None), (3, 2, 2, 1), (4, 2, 2, 0), (5, 1, 1, 0), (6, 1, 1, 0), (7, 2, 2, 0), (8, 1, 1, 0)], "run_id long, expected int, completed int, failed int")
    verdicts = {1: ["pass", "pass"], 3: ["pass", "pass"], 4: ["pass", "violation"], 5: ["pass"], 6: ["pass"], 7: ["pass"], 8: ["pass"]}
    found = spark.createDataFrame([(r, v, "dismissed") for r, vs in verdicts.items() for v in vs], "run_id long, verdict string, review_decision string")
    warnings = spark.createDataFrame([(5, "a page was read from an image"), (1, None)], "run_id long, warning string")
    signed = spark.createDataFrame([(r, "ann", True) for r in (1, 2, 3, 4, 5, 7, 8)] + [(8, "bob", False)], "run_id long, reviewed_by string, confirmed boolean")
    row = findings.run_summaries(runs, found, warnings, signed).where(F.col("run_id") == run).first()
    assert (row.clean, row.complete) == (clean, complete)
    assert row.dismissed == (1 if run == 4 else 0) and row.certain == (run != 5) and (row.reviewed_by is None) == (run == 6)


def test_approval_and_decisions_meet_changes_by_rows(spark):
    known = spark.createDataFrame([("b", "1"), ("b", "2"), ("b", "2"), (None, "3")], "batch_id string, change_id string")
    asked = spark.createDataFrame([("b", ["1", "2"]), ("b", ["1", "9"]), ("b", ["1", "1"]), ("b", []), ("b", None), ("b", ["1", None]), ("c", ["1"]), ("b", ["1", "2"])], "batch_id string, ids array<string>")
    got = [(r.batch_id, r.ids, r.problem) for r in review.approved_ids(asked, known).collect()]
    want = [("b", ["1", "2"], None), ("b", ["1", "9"], "names an unknown change"), ("b", ["1", "1"], "names a change twice"), ("b", [], "names no change"), ("b", None, "names no change"), ("b", ["1", None], "names no change"), ("c", ["1"], "names an unknown change"), ("b", ["1", "2"], None)]
    assert sorted(got, key=str) == sorted(want, key=str)
    decided = relational.with_decision(known, spark.createDataFrame([("b", "1", "x"), ("b", "1", "y")], "batch_id string, change_id string, decision string"))
    assert sorted(((r.change_id, r.decided) for r in decided.collect())) == [("1", True), ("2", False), ("2", False), ("3", False)]


def test_first_of_a_key_lends_its_verdicts(spark):
    docs = spark.createDataFrame([(1, "a", 5), (2, "a", 3), (3, None, 1), (4, None, 1)], "document_id long, cache_key string, at int")
    assert {r.document_id: (r.reused_from, r.hit) for r in review.reused(docs, ["at", "document_id"]).collect()} == {1: (2, True), 2: (2, False), 3: (3, False), 4: (3, True)}
