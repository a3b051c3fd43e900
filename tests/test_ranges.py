"""Numbers, pages, as-of, first-seen order, digests and rules by ranges against versions by definition."""

import datetime as dt
import hashlib
import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import derive, ranges, relational, review, rules


@pytest.fixture(scope="module")
def facts(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, rng.randint(0, 6)) for k in range(300)]
    return rows, spark.createDataFrame(rows, "k string, id long, value long").repartition(5)


def test_numbered_and_paged(spark, facts):
    rows, frame = facts
    by = defaultdict(list)
    for k, i, v in rows:
        by[k].append((v, i))
    want = {(k, v, i, n + 1) for k, x in by.items() for n, (v, i) in enumerate(sorted(x))}
    got = ranges.numbered(frame, ["k"], ["value", "id"], "place")
    assert {(r.k, r.value, r.id, r.place) for r in got.collect()} == want and got.columns == ["k", "id", "value", "place"]
    pages = ranges.paged(frame, ["k"], ["value", "id"], F.col("id"), "ids", 7).collect()
    assert all(r.n == len(r.ids) <= 7 for r in pages)
    assert {(r.k, r.page): r.ids for r in pages} == {(k, p // 7): [i for _, i in sorted(x)[p : p + 7]] for k, x in by.items() for p in range(0, len(x), 7)}
    assert ranges.numbered(frame.limit(0), ["k"], ["id"], "place").count() == 0
    assert sorted(r.place for r in ranges.numbered(frame, [], ["id"], "place").collect()) == list(range(1, 301))


def test_first_seen(spark, facts):
    rows, frame = facts
    want = defaultdict(list)
    for k, _, v in sorted(rows, key=lambda r: r[1]):
        if v not in want[k]:
            want[k].append(v)
    got = ranges.first_seen(frame, ["k"], "value", ["id"]).collect()
    assert {(r.k, r.position, r.value) for r in got} == {(k, n, v) for k, x in want.items() for n, v in enumerate(x)}


@pytest.mark.parametrize("span", [1, 30, 5_000])
def test_as_of(spark, span):
    rng = random.Random(10)
    day = lambda: dt.datetime(2020, 1, 1) + dt.timedelta(hours=rng.randint(0, 24 * 400))
    known = [(rng.choice(["a", "b", None]), day(), k) for k in range(60)] + [("a", None, 999), ("t", dt.datetime(2020, 5, 1), 1), ("t", dt.datetime(2020, 5, 1), 2)]
    asked = [(k, rng.choice(["a", "b", "c", None]), day()) for k in range(200)] + [(500, "a", None), (501, "t", dt.datetime(2020, 5, 1)), (502, "t", dt.datetime(2020, 4, 30)), (503, "t", dt.datetime(2021, 4, 30))]
    got = ranges.as_of(spark.createDataFrame(asked, "id long, k string, at timestamp"), spark.createDataFrame(known, "k string, at timestamp, value long"), ["k"], "at", "value", span)
    latest = lambda k, at: max(((a, v) for kk, a, v in known if kk == k and a and at and a <= at), default=(None, None))[1]
    assert {(r.id, r.value) for r in got.collect()} == {(i, latest(k, at)) for i, k, at in asked}


def tree(entries, page, rest):
    texts = [json.dumps(e, separators=(",", ":")) for e in entries]
    while len(texts) > page:
        texts = ['"' + hashlib.sha256(f"[{','.join(texts[i : i + page])}]".encode()).hexdigest() + '"' for i in range(0, len(texts), page)]
    return hashlib.sha256(f'{{"rows":[{",".join(texts)}],"set":"{rest}"}}'.encode()).hexdigest()


@pytest.mark.parametrize("page", [3, 50, 1_000])
def test_digest(spark, page):
    rows = [("big", k, k % 7) for k in range(200)] + [("one", 1, 1)] + [("few", k, 0) for k in range(5)]
    frame = spark.createDataFrame(rows, "c string, id long, v long").repartition(4)
    got = ranges.digest(frame, "c", ["id"], F.struct("id", "v"), "rows", {"set": F.lit('q"x')}, page)
    assert {r.c: r.basis for r in got.collect()} == {c: tree([{"id": i, "v": v} for cc, i, v in rows if cc == c], page, 'q\\"x') for c in ("big", "one", "few")}


@pytest.mark.parametrize(("name", "levels"), [("rows", 1), ("a", 1), ("z", 2)])
def test_digest_of_fixed_levels(spark, name, levels):
    rows = [(c, k, k % 7) for c, n in (("big", 2_000), ("more", 1_500), ("one", 1), ("few", 5)) for k in range(n)]
    frame = spark.createDataFrame(rows, "c string, id long, v long").repartition(4)
    got = ranges.digest(frame, "c", ["id"], F.struct("id", "v"), name, {"set": F.lit('q"x'), "b": F.lit(1)}, 3, levels)

    def whole(entries):
        texts = [json.dumps(e, separators=(",", ":")) for e in entries]
        for _ in range(levels):
            if len(texts) > 3:
                texts = ['"' + hashlib.sha256(f"[{','.join(texts[i : i + 3])}]".encode()).hexdigest() + '"' for i in range(0, len(texts), 3)]
        fields = {name: f"[{','.join(texts)}]", "set": '"q\\"x"', "b": "1"}
        return hashlib.sha256(("{" + ",".join(f'"{f}":{fields[f]}' for f in sorted(fields)) + "}").encode()).hexdigest()

    assert sorted((r.c, r.basis) for r in got.collect()) == sorted((c, whole([{"id": i, "v": v} for cc, i, v in rows if cc == c])) for c in ("big", "more", "one", "few"))


def test_a_register_of_one_page_has_the_digest_of_its_whole_text(spark):
    rows = [(1, "MSA", f"k{k}", "supported", k, 1) for k in range(5)]
    frame = spark.createDataFrame(rows, "collection_id long, agreement_id string, key string, state string, value long, version long")
    text = json.dumps({"register": [{"key": f"MSA::k{k}", "state": "supported", "value": k, "version": 1} for k in range(5)], "ruleset": "r1"}, separators=(",", ":"))
    assert review.candidate_basis(frame, F.lit("r1")).first().basis == hashlib.sha256(text.encode()).hexdigest()


def test_pages_of_citations_and_verdicts(spark):
    register = spark.createDataFrame([(1, "x"), (2, "y")], "item_id long, key string")
    cited = spark.createDataFrame([(1, k) for k in range(7)], "item_id long, fact_id long")
    got = {(r.item_id, r.page): (r.n, r.fact_ids) for r in relational.cited_pages(register, cited, 3).collect()}
    assert got == {(1, 0): (3, [0, 1, 2]), (1, 1): (3, [3, 4, 5]), (1, 2): (1, [6]), (2, 0): (0, [])}
    facts = spark.createDataFrame([(k, k * 10, 5) for k in range(7)], "fact_id long, document_id long, value long")
    whole, pages = relational.export(register, cited, facts), relational.export_pages(register, cited, facts, 3)
    assert {r.item_id: [tuple(q) for q in r.quotes] for r in whole.collect()} == {k: [tuple(q) for r in sorted(pages.where(F.col("item_id") == k).collect(), key=lambda r: r.page) for q in r.quotes] for k in (1, 2)}
    findings = spark.createDataFrame([("A", "violation", f"t{k}") for k in range(5)] + [("A", "pass", "z"), ("B", "pass", "t1"), ("A", "violation", "t1")], "code string, verdict string, target string")
    got = {(r.code, r.page): (r.verdict, r.n_judged, r.targets) for r in rules.worst_pages(findings, 3).collect()}
    assert got == {("A", 0): ("violation", 7, ["t0", "t1", "t2"]), ("A", 1): ("violation", 7, ["t3", "t4"]), ("B", 0): ("pass", 1, [])}


def test_rules_of_a_large_playbook(spark, monkeypatch):
    rng = random.Random(11)
    book = [(f"R{k}", "text", "major", "both", rng.sample(["p", "q", "r", "s"], rng.randint(1, 2)) if k % 50 else []) for k in range(5_000)] + [("twice", "t", "minor", "both", ["p", "p"])]
    targets = [(k, key) for k, key in enumerate(["p", "q", None, "other", "p", "p"])]
    want = Counter((i, key, b[0]) for i, key in targets for b in book if not b[4] or key in b[4])
    sets = spark.createDataFrame(book, "code string, rule_text string, severity string, scope string, target_keys array<string>")
    frame = spark.createDataFrame(targets, "id long, key string")
    out = rules.applicable(sets, frame)
    assert Counter((r.id, r.key, r.code) for r in out.collect()) == want and out.columns == ["id", "key", "code", "rule_text", "severity", "scope", "target_keys"]
    monkeypatch.setattr(rules, "BROADCAST_RULES", 10)
    assert Counter((r.id, r.key, r.code) for r in rules.applicable(sets, frame).collect()) == want
    assert rules.applicable(sets.where("size(target_keys) > 0"), frame).where("id = 3").count() == 0
    assert rules.applicable(sets.limit(0), frame).count() == 0


def test_rules_are_tallied_without_pairs(spark):
    rng = random.Random(12)
    book = [(f"R{k}", k, rng.sample(["p", "q", "r", "s"], rng.randint(1, 2)) if k % 50 else []) for k in range(1, 2_000)] + [("A", 7, ["p", "p"])]
    targets = [(k, key) for k, key in enumerate(["p", "q", None, "other", "p"])] + [(0, "p")]
    sets = spark.createDataFrame(book, "code string, n long, target_keys array<string>")
    frame = spark.createDataFrame(targets, "id long, key string")
    want = {t: [(c, n) for c, n, keys in book if not keys or t[1] in keys] * targets.count(t) for t in targets}
    got = rules.tallied(sets, frame, F.col("n"))
    assert {(r.id, r.key): (r.n_rules, r.first_rule, r.total) for r in got.collect()} == {t: (len(x), min(x)[0], sum(n for _, n in x)) for t, x in want.items()}
    few = rules.tallied(sets.where("size(target_keys) > 0"), frame, F.col("n")).collect()
    assert sorted(r.id for r in few) == [0, 1, 4] and rules.tallied(sets.limit(0), frame, F.col("n")).count() == 0
    # three billion pairs
    many = rules.tallied(spark.range(50_000).select(F.col("id").cast("string").alias("code"), F.col("id").alias("n"), F.array(F.lit("p")).alias("target_keys")), spark.range(60_000).select("id", F.lit("p").alias("key")), F.col("n"))
    assert many.agg(F.count("*"), F.sum("n_rules"), F.max("total")).first()[:] == (60_000, 3_000_000_000, 49_999 * 25_000)


def test_parallel_facts_and_claims(spark):
    day = lambda k: dt.datetime(2024, 1, k)
    schema = "fact_id long, collection_id long, agreement_id string, key string, document_id long, ingested_at timestamp, line long, value long, obligation_scope string, conditions string, supersedes_id long, doc_type string, parties array<string>"
    rows = [(k, 1, "A", "days", k, day(k), 1, v, "contractual", c, None, "policy", []) for k, v, c in ((1, 30, ""), (2, 40, "if late"), (3, 30, ""), (4, 50, "if late"), (5, 45, ""))]
    facts, run = spark.createDataFrame(rows, schema), spark.createDataFrame([(1, 5)], "collection_id long, new_document_id long")
    assert [(r.position, r.fact_id, r.value) for r in derive.parallel(facts, run).orderBy("position").collect()] == [(0, 2, 40), (1, 4, 50)]
    said = lambda text, quote: [r.evidence for r in derive.claims(facts, run, spark.createDataFrame([(5, text), (4, "It replaces all.")], "document_id long, text string"), spark.createDataFrame([(5, quote)], "fact_id long, quote string")).collect()]
    text = "Preface. It supersedes the cap.\nSection 4 is replaced as follows:\n45 days. End."
    assert said(text, "45 days") == ["Section 4 is replaced as follows: 45 days."] and said(text, "not there") == ["It supersedes the cap."]
    assert said("Nothing new. 45 days.", "45 days") == []
