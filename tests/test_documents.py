"""From pages to facts: reading order, sentences around quotes, rows of facts and relations, repair."""

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import grounding, scoping
from ledgerloom.operators import extraction, layout

BOX = "path string, page int, kind string, x0 double, y0 double, x1 double, y1 double, text string, table_no int, page_area double"


def boxes(spark, rows):
    return spark.createDataFrame([("p", *r, 1_000.0) for r in rows], BOX)


def read(spark, rows):
    return [(r.kind, r.text_column, r.text) for r in layout.reading_order(boxes(spark, rows)).orderBy("page", "block_index").collect()]


def test_columns_are_read_one_after_the_other(spark):
    rows = [(1, "block", 300.0, 50.0, 500.0, 90.0, "right top", None), (1, "block", 10.0, 200.0, 210.0, 240.0, "left low", None), (1, "block", 10.0, 50.0, 210.0, 90.0, "left top", None), (1, "block", 305.0, 200.0, 500.0, 240.0, " right low ", None), (1, "block", 0.0, 0.0, 1.0, 1.0, "  ", None), (1, "image", 0.0, 0.0, 9.0, 9.0, None, None)]
    assert read(spark, rows) == [("block", 0, "left top"), ("block", 0, "left low"), ("block", 1, "right top"), ("block", 1, "right low")]
    # a box over the gutter makes one column, and so do few boxes
    assert [x[1] for x in read(spark, [*rows, (1, "block", 100.0, 10.0, 400.0, 40.0, "title", None)])] == [0] * 5
    assert [x[2] for x in read(spark, rows[:3])] == ["left top", "right top", "left low"]


def test_words_lines_paragraphs_and_tables(spark):
    words = [(1, "word", 10.0 + 40 * k, 10.0 + 12 * line + k * 0.5, 45.0 + 40 * k, 20.0 + 12 * line, f"w{line}{k}", None) for line in (0, 1, 4) for k in (2, 0, 1)]
    cells = [(1, "cell", 10.0 + 200 * c, 300.0 + 15 * r, 100.0 + 200 * c, 312.0 + 15 * r, f"c{r}{c}", 3) for r in (1, 0) for c in (1, 0)] + [(1, "cell", 110.0, 300.0, 10.0, 312.0, "x", 9)]
    assert read(spark, words + cells) == [("paragraph", 0, "w00 w01 w02\nw10 w11 w12"), ("paragraph", 0, "w40 w41 w42"), ("table", None, "c00 | c01\nc10 | c11"), ("table", None, "x")]
    page = layout.pages_of(boxes(spark, [*words, *cells, (1, "image", 0.0, 0.0, 25.0, 20.0, None, None), (2, "image", 0.0, 0.0, 5.0, 5.0, None, None)])).orderBy("page").collect()
    assert page[0].has_table and page[0].text.endswith("c10 | c11\n\nx") and page[0].image_share == 0.5
    assert (page[1].text, page[1].has_table) == ("", False)
    assert layout.reading_order(boxes(spark, [])).count() == 0


def islands_by_hand(spans, gap):
    out, reach, n = [], None, 0
    for s, e in sorted(spans):
        if reach is not None and s > reach + gap:
            n += 1
        reach = e if reach is None else max(reach, e)
        out.append((s, e, n))
    return Counter(out)


@pytest.mark.parametrize("gap", [20.0, 0.0, -2.0])
def test_islands(spark, gap):
    rng = random.Random(8)
    spans = [(float(s), float(s + rng.randint(0, 30))) for s in (rng.randint(0, 900) for _ in range(60))]
    frame = spark.createDataFrame([("p", 1, *s) for s in spans], "path string, page int, s double, e double")
    got = Counter((r.s, r.e, r.n) for r in layout.islands(frame, layout.PAGE, "s", "e", gap, "n").collect())
    assert got == islands_by_hand(spans, gap)


def around(text, quote):
    """By definition, in the unwrapped text."""
    one = lambda x: re.sub(r"\s*\n\s*", " ", x)
    line = one(text)
    at = len(one(text[: text.find(quote)])) if quote in text else line.find(one(quote))
    if at < 0:
        return text
    breaks = list(re.finditer(r"(?<=[.!?])\s+(?=[\"“(A-Z0-9])", line))
    start = max([m.end() for m in breaks if m.end() <= at], default=0)
    end = min([m.start() for m in breaks if m.start() > at], default=len(line))
    return line[start:end].strip()


def test_sentence_around(spark):
    text = "Intro ends. Section 4.2 Payment is due\n  within 30 days unless\n\nDisputed, e.g. in writing! (Late) fees apply.\nLast. One"
    quotes = ["Payment is due", "due\n  within 30", "due within 30 days", "30 days", "Intro", "fees", "One", "nowhere", "in writing!", "(Late)"]
    rows = [(text, q) for q in quotes] + [("no stop at all", "stop"), ("", "x"), ("Ein Satz. Über uns. 2 Dinge. \nNeu", "uns")]
    out = spark.createDataFrame(rows, "t string, q string").select("t", "q", scoping.sentence_around(F.col("t"), F.col("q")).alias("s")).collect()
    for r in out:
        assert r.s == around(r.t, r.q), r
    assert out[1].s.startswith("Section 4.2") and out[7].s == text
    assert spark.createDataFrame([(None, "x")], "t string, q string").select(scoping.sentence_around(F.col("t"), F.col("q"))).first()[0] is None


TEXTS = [
    "Payment is due within 30 calendar days of receipt unless disputed. Liability is capped at $1,000.",
    "Due within thirty (30) calendar days. Amount due: $12.50\nPayment due within 5 calendar days. payment due within 6 calendar days",
    "This Amendment amends Agreement No. AB-12 and replaces the payment provision.\n\nIssued under Contract Ref: ZZ-9. See No. 4 here.",
    "With reference to Agreement No. QQ-77, this Amendment supersedes it.  \n It is not amended. \u0001 odd \u0002 marks; subject to the terms of nothing.",
    "nothing at all",
    "",
    None,
]


def test_rows_of_relations_are_those_of_the_column(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "document_id long, text string")
    want = docs.select("document_id", F.posexplode_outer(scoping.relations(F.col("text"))).alias("place", "r")).where("r is not null").select("document_id", "place", "r.*")
    got = extraction.relations_of(docs)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(map(tuple, want.collect())) and want.count() >= 6


def test_rows_of_facts_are_those_of_the_column(spark):
    blocks = spark.createDataFrame([(k, 0, "policy", t) for k, t in enumerate(TEXTS)], "document_id long, block_index long, doc_type string, text string")
    want = blocks.select("document_id", F.explode_outer(grounding.extracted(F.col("text"))).alias("f")).where("f is not null").select("document_id", "f.*")
    got = extraction.facts_of(blocks)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(map(tuple, want.collect())) and want.count() == 6
    narrow = {(r.document_id, r.quote) for r in extraction.facts_of(blocks, False).collect()}
    assert (0, "Payment is due within 30 calendar days") in narrow


def test_long_blocks_end_soon(spark):
    text = " ".join(f"Payment is due within {k} calendar days of receipt." for k in range(5_000)) + " Numbers: " + " ".join(map(str, range(10_000)))
    began = time.time()
    rows = extraction.facts_of(spark.createDataFrame([(1, 0, "policy", text)], "document_id long, block_index long, doc_type string, text string"), False)
    assert rows.count() == 5_000 and time.time() - began < 60
    assert extraction.relations_of(spark.createDataFrame([(1, "It amends Agreement No. AB-1. " * 5_000)], "document_id long, text string")).count() == 10_000  # each amends and supersedes


def by_document(spark, rows):
    return spark.createDataFrame(rows, "document_id long, block_index long, doc_type string, text string")


def test_repair_takes_the_whole_document_again(spark):
    blocks = by_document(spark, [(1, 0, "policy", "Payment is due within 30 calendar days of receipt."), (1, 1, "policy", "Liability is capped at $5."), (2, 0, "policy", "Liability is capped at $7."), (3, 0, "policy", "Due within five (5) calendar days."), (4, 0, "policy", "No terms."), (3, 1, "policy", "Liability is capped at $9.")])
    facts, attempts = extraction.extract(blocks)
    got = {(r.document_id, r.block_index, r.quote, r.attempt, r.ok) for r in facts.collect()}
    assert (1, 0, "Payment is due within 30 calendar days of receipt.", 1, True) in got and (1, 1, "Liability is capped at $5", 1, True) in got
    assert (2, 0, "Liability is capped at $7", 0, True) in got and (3, 1, "Liability is capped at $9", 1, True) in got and sum(not x[4] for x in got) == 1
    out = {r.document_id: (r.attempts, r.n_invalid, r.outcome) for r in extraction.outcomes(attempts).collect()}
    assert out == {1: (2, 0, "repaired"), 2: (1, 0, "stored"), 3: (2, 1, "abstained"), 4: (1, 0, "stored")}
    assert extraction.extract(blocks, most=0)[1].where("attempt > 0").count() == 0
    assert extraction.extract(by_document(spark, []))[0].count() == 0


def test_an_extractor_of_ones_own_sees_wider_context(spark):
    blocks = by_document(spark, [(1, 0, "policy", "Caps apply."), (1, 1, "policy", "Liability is capped at $5."), (1, 2, "policy", "End.")])

    def take(rows):
        found = rows.where("block_index = 1").withColumn("key", F.lit("liability_cap")).withColumn("value", F.lit('{"amount":"$5","currency":"USD"}'))
        quote = F.when(F.contains("context", F.lit("Caps apply.")) & F.contains("context", F.lit("End.")), "Liability is capped at $5").otherwise("made up")
        return found.withColumn("quote", quote).withColumn("quote_start", F.lit(0)).withColumn("quote_end", F.length("quote"))

    facts, attempts = extraction.extract(blocks, take, most=3)
    assert [(r.quote, r.attempt, r.ok) for r in facts.collect()] == [("Liability is capped at $5", 1, True)]
    assert [(r.attempt, r.n_invalid) for r in attempts.orderBy("attempt").collect()] == [(0, 1), (1, 0)]


def test_candidates_are_scoped_by_their_own_sentence(spark):
    text = "Section 2.1 Liability is capped at $5 if sued by others. Section 3.4 Payment is due within 9 calendar days of receipt\nunless agreed otherwise. Plain."
    blocks = by_document(spark, [(1, 0, "policy", text)])
    docs = spark.createDataFrame([(1, "policy", "Agreement No. AB-12 between Acme Buyer LLC and Other Vendor.\n\n" + text)], "document_id long, doc_type string, text string")
    out = {r.key: r.scope for r in extraction.scoped(extraction.facts_of(blocks, False), docs).collect()}
    assert (out["liability_cap"].clause, out["liability_cap"].conditions) == ("2.1", ["if sued by others"])
    assert (out["payment_due_days"].clause, out["payment_due_days"].conditions) == ("3.4", ["unless agreed otherwise"])
    assert out["liability_cap"].agreement_id == "AB-12" and out["liability_cap"].parties == ["Acme Buyer LLC", "Other Vendor"]
