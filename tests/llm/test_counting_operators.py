"""Source divergence, fill-in-middle and token counts against versions by definition."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import divergence, fim, tokencount

DOCS = "doc_id long, text string, lang string, source string, n long, row long, sid long, form string"
LOWER = {c: c + 32 for c in range(65, 91)}


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, 1, 2, 3, "x") for i, t, lang, s in rows], DOCS)


def audited(rows, min_docs):
    n, df = defaultdict(Counter), defaultdict(Counter)
    for _, t, lang, s in rows:
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
        n[lang or "", s or ""].update(words)
        df[lang or ""].update(set(words))
    out = []
    for lang in df:
        kept = {w for w, c in df[lang].items() if c >= min_docs}
        groups = {s: c for (of, s), c in n.items() if of == lang}

        def shares(c, kept=kept):
            total = sum(c[w] for w in kept) + 5 * len(kept)
            return {w: 1 + 10**9 * (c[w] + 5) // total for w in kept}

        q = shares(sum(groups.values(), Counter()))
        p = {s: shares(c) for s, c in groups.items()}
        for s in groups:
            found = {"pair": [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in groups if o != s], "term": [(p[s][w] - q[w], w) for w in kept if groups[s][w] and p[s][w] > q[w]]}
            for part, values in found.items():
                values.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(values[: 50 if part == "term" else None])]
    return Counter(out)


@pytest.fixture(scope="module")
def mixed_docs():
    rng = random.Random(3)
    words = ["Zoë", "zoë", "a", "B", "b", "über", "😀", "naïve", *(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200))]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 60))) + rng.choice(["", "!", "\0", "1x2"]), rng.choice(["en", "de", "", None]), rng.choice(["web", "web", "web", "b", "ä", None, ""])) for k in range(240)]
    return [*rows, rows[0], (None, "Zoë " * 40, "en", "one"), (901, None, "en", "two"), (902, "", "xx", "solo"), (903, "few words", "yy", "p"), (904, None, "yy", None)]


def test_divergence(spark, mixed_docs):
    want = audited(mixed_docs, 5)
    assert {("yy", "p", "pair", "", 0, 1), ("en", "two", "pair", "one", 0, 1)} & set(want) and any(x[2] == "term" for x in want)
    docs = frame(spark, mixed_docs).repartition(3)
    for size in ({}, {"chunk": 3, "block": 2}):
        out = divergence.audit(docs, 5, **size)
        assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert Counter(map(tuple, out.collect())) == want


def test_divergence_without_kept_terms_or_rows(spark, mixed_docs):
    assert Counter(map(tuple, divergence.audit(frame(spark, mixed_docs), 10_000).collect())) == audited(mixed_docs, 10_000)
    assert divergence.audit(frame(spark, [])).count() == 0


def test_shares_are_exact():
    rng = random.Random(4)
    totals = [rng.randint(1, 8 * 10**15) for _ in range(500)] + [1, 3, 7]
    counts = [rng.randint(0, t) for t in totals[:-3]] + [1, 3, 6]
    got = divergence.shares(np.array(counts), np.array(totals))
    assert got.tolist() == [1 + 10**9 * c // t for c, t in zip(counts, totals, strict=True)]


def test_long_text_is_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "_PIECE", 7)
    text = "alpha beta  gamma " * 5 + "x" * 40
    pieces = list(divergence._pieces(text))
    assert "".join(pieces) == text and len(pieces) > 5
    assert [w for p in pieces for w in divergence.TERM.findall(p)] == divergence.TERM.findall(text)


def cut_by_hand(i, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    x = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(z in text for z in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, text, text
    spm = h[3] % 100 < 20
    return i, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}", text


def fim_rows():
    rng = random.Random(5)
    parts = ["word", "x", " ", "\n", "é", "😀", "<", "S>", "<S", "P", "12", "\r\n", "\0", "<m>", "M>"]
    rows = [(k, "".join(rng.choices(parts, k=rng.randint(0, 40))), "en", "s") for k in range(400)]
    rows += [(1_000 + k, t, "en", "s") for k, t in enumerate(["", None, "<P>", "a<S>b", "<M", "only", "é", " " * 50, "q" * 9_000, ("longword" * 700 + " é") * 9, "ab 😀" * 30_000, "z" * 4_096 + "!", "." * 4_096 + "zz", "." * 4_095 + "zz.a"])]
    return [*rows, rows[3], rows[3], (rows[4][0], "another text", "en", "s"), (None, "some words here", "en", "s"), (None, "some words here", "en", "s")]


def test_fill_in_middle(spark):
    rows = fim_rows()
    want = Counter(cut_by_hand(i, t) for i, t, *_ in rows)
    assert {x[2] for x in want} == {"plain", "psm", "spm"}
    out = fim.transform(frame(spark, rows).repartition(3))
    back = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored(F.col("form"), F.col("output")).alias("restored"))
    assert Counter(map(tuple, back.collect())) == want
    assert fim.transform(frame(spark, [])).count() == 0


def test_fill_in_middle_shuffles_texts_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for many documents
    try:
        out = fim.transform(docs)
        assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
        out.collect()
        final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffles = [line for line in final.splitlines() if "Exchange hashpartitioning" in line and "Reused" not in line]
    assert final.count("FileScan") == 1 and len(shuffles) == 1 and "REPARTITION_BY_NUM" in shuffles[0]


@pytest.fixture(scope="module")
def both_counters():
    from tokenizers import Tokenizer

    with open(tokencount.default_path(), encoding="utf-8") as f:
        source = f.read()
    library = Tokenizer.from_str(source)
    return tokencount.Counter(source), lambda text: len(library.encode(text, add_special_tokens=False).ids)


def odd_texts():
    rng = random.Random(6)
    parts = ["a", "the", "ing", "</w>", "<|endoftext|>", "<|startoftext|>", "<|", " ", "\n", "é", "é", "́", "İ", "ΑΣ", "ß", "1", "٣", "'s", "'LL", "don't", "!!", "你好", "😀", " ", "　", "\x85", "\x1c", "​", "\0", "ﬁ", "K", "½", "_-"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 50))) for _ in range(1_500)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x10FFFF), rng.randint(32, 1_000)])) for _ in range(40)) for _ in range(1_500)]
    texts += ["a" * n for n in range(1, 30)]
    return [*texts, "a" * 5_000, "ab" * 4_001, "th" * 6_000, "".join(rng.choices("abcdefghij", k=20_000)), "".join(rng.choices(["aa", "a", "haha", "o"], k=6_000)), "!" * 6_001, "你好世界" * 2_000, "z" * 2_049]


def test_token_counts_equal_the_librarys(both_counters):
    own, library = both_counters
    texts = odd_texts()
    assert own.counts(texts).tolist() == [library(t) for t in texts]


def test_token_counts_in_pieces(both_counters, monkeypatch):
    own, library = both_counters
    monkeypatch.setattr(tokencount, "_PIECE", 50)
    monkeypatch.setattr(tokencount, "_CACHE", 10)
    texts = odd_texts()[:400]
    assert own.counts(texts).tolist() == [library(t) for t in texts]


def test_merges_must_follow_those_that_make_their_parts():
    with pytest.raises(ValueError, match="ranks before"):
        tokencount.Merges([(2, 0, 3), (0, 1, 2)], {0: 1, 1: 1, 2: 2, 3: 3})


def test_windows_agree_with_whole_sequences(both_counters):
    merges = both_counters[0].merges
    rng = random.Random(7)
    letters = [both_counters[0].vocab[c] for c in "abehnst"]
    for n in (2, 3, 50, 700):
        symbols = np.array(rng.choices(letters, k=n))
        assert merges._one_long(symbols) == merges.counts(symbols, np.array([n]))[0]


def test_token_counts_of_documents(spark, both_counters):
    rows = [(k, t, "en", "s") for k, t in enumerate([*odd_texts()[:200], None, "", "word " * 2_048, "word " * 2_049])] + [(None, "one two", None, None), (3, "again", "en", "s"), (3, "again", "en", "s")]
    want = Counter((i, len((t or "").encode()), both_counters[1](t or ""), both_counters[1](t or "") > 2_048) for i, t, *_ in rows)
    assert Counter(map(tuple, tokencount.token_counts(frame(spark, rows)).collect())) == want
    assert tokencount.token_counts(frame(spark, [])).count() == 0
