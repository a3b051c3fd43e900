import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import langid, linededup, mixing, packing, quality, simhash, suffixdedup

SPACE = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, lang string, source string, n_words long, kept boolean, h long"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, 1, False, 2) for i, t, s in rows], DOCS)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["th", "an", "in", "er", "on", "re", "ed"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    long = prose(1, 400)
    rows = [(1, long, "a"), (2, long, "a"), (3, long.upper(), None), (4, None, "b"), (5, "", None), (6, "\n \n\t", "b"), (7, "one", "c"), (7, "one", "c"), (None, long, "a"), (None, None, None), (8, "é😀 " * 60, "c"), (9, prose(2, 300) + " " + long[500:900], "a"), (10, "word " * 500, "b"), (11, (prose(3, 12) + "\n") * 8, "b"), (12, "\0\0" * 80 + long[100:400], "c"), (13, prose(4, 20_000), "a")]
    return rows, frame(spark, rows)


def test_empty_tables(spark):
    none = frame(spark, [])
    for f in (quality.quality, langid.identify, linededup.dedup, suffixdedup.dedup, simhash.near_duplicates, mixing.mix, packing.pack, quality.keep_good, simhash.one_of_each, mixing.mixed_documents):
        assert f(none).count() == 0


def by_hand(text):
    words = re.findall("[^ \t-\r]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = set()
    for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)):
        if windows[w] > 1:
            inside |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(SPACE):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), len(words) < 50 or 100 * len(inside) > 50 * len(words)


def test_quality(spark, odd, sf_dir):
    rows, docs = odd
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = Counter((i, *by_hand(t)) for i, t, _ in rows) + Counter((r.doc_id, *by_hand(r.text)) for r in real.collect())
    out = quality.quality(docs).unionByName(quality.quality(real)).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == want
    assert not any(r.kept and r.base_failed for r in out)
    assert {r.doc_id for r in quality.quality(docs).where("kept").collect()} >= {1, 2, 3}
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 10").count() == 0 and kept.where("doc_id = 1").count() == 1


def verdict_by_hand(text):
    """The largest share of word characters inside repeated windows, that of repeated lines, and whether both are allowed."""
    words = re.findall("[^ \t-\r]+", text or "")
    total = max(sum(map(len, words)), 1)
    worst, bad = 0.0, False
    for n, most in quality.COVERAGE.items():
        windows = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        often = Counter(windows)
        inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(n)}
        share = sum(len(words[i]) for i in inside) / total
        worst, bad = max(worst, share), bad or share > most
    seen, again, chars = set(), 0, 0
    for line in (text or "").split("\n"):
        chars += len(line.strip(SPACE))
        again += len(line.strip(SPACE)) if line in seen else 0
        seen.add(line)
    lines = again / max(chars, 1)
    return round(worst, 9), round(lines, 9), not (by_hand(text)[-1] or bad or lines > quality.LINE_COVERAGE)


def test_quality_verdict_by_hand(spark, odd, sf_dir):
    rows = [(i, t) for i, t, _ in odd[0]] + [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(500 + k, prose(k, 120) + " " + prose(k, 6 + k) + "\n" + "\n".join([prose(90, 20)] * (k % 4))) for k in range(30)]
    out = quality.quality(frame(spark, [(i, t, "s") for i, t in rows])).collect()
    got = Counter((r.doc_id, round(r.ngram_share, 9), round(r.dup_line_share, 9), r.kept) for r in out)
    assert got == Counter((i, *verdict_by_hand(t)) for i, t in rows)
    assert 20 < sum(r.kept for r in out) < len(out) - 20 and sum(not r.kept and not r.base_failed for r in out) > 5


def test_quality_labels(spark, sf_dir):
    """Clean documents stay."""
    labels = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    good = quality.quality(docs).where("not base_failed").join(labels.where("quality = 1"), "doc_id")
    assert good.where("kept").count() >= 0.97 * good.count()


def test_language(spark, odd, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id")
    held = out.where("held_out and lang is not null and lang_pred <> 'und'")
    assert held.where("lang = lang_pred").count() >= 0.95 * held.count() > 100
    assert out.where("score < 0 or score > 1").count() == 0
    got = {r.doc_id: r for r in langid.identify(odd[1]).collect()}
    assert got[4].lang_pred == got[5].lang_pred == got[6].lang_pred == "und" and got[4].score == 0 and got[1].lang_pred == "en"
    two = langid.LanguageFilter.build({"x": langid.grams(["abcabc"])[1][3][0], "y": langid.grams(["abcxyz"])[1][3][0]})
    has, counts = two.counts(["abc"])
    assert has[0] and counts[0][0] > 0 and counts[0][1] > 0


def test_language_by_hand(spark, sf_dir):
    """Everything by definition, with exact sets in place of the filter; what the filter adds is corrected."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs = spark.createDataFrame([*rows, *rows[:3], (None, "lost", "en"), (900_001, None, "xx")], "doc_id long, text string, lang string")
    order = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"))).collect()}
    sample, kept = 20, {2: 150, 3: 500}
    known = {i: (t, lang) for i, t, lang in rows if t is not None and lang is not None and zlib.crc32(str(i).encode()) % 3 != 1}

    def grams_of(text, n):
        line = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        return Counter(g for w in [re.sub(" +", " ", line)] for g in (w[i : i + n] for i in range(len(w) - n + 1)))

    best = {}
    for lang in sorted({x for _, x in known.values()}):
        ids = sorted((i for i, (_, x) in known.items() if x == lang), key=lambda i: (order[i], str(i)))[:sample]
        for n in kept:
            best[lang, n] = sum((grams_of(known[i][0], n) for i in ids), Counter())
    model = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))), sample, kept)
    assert model.langs == sorted({x for x, _ in best})
    texts = [t for _, t, _ in rows if t]
    has, counts = model.counts(texts)
    right = 0
    for j, t in enumerate(texts):
        exact = {}
        for lang in model.langs:
            exact[lang] = 0
            for n, most in kept.items():
                cut = sorted(best[lang, n].values(), reverse=True)[most - 1 : most]
                exact[lang] += sum(c for g, c in grams_of(t, n).items() if best[lang, n][g] > (cut[0] if cut else 0))
        right += bool(has[j]) and model.langs[int(np.argmax(counts[j]))] == max(exact, key=exact.get)
    assert right >= 0.98 * sum(map(bool, has))


def test_partial_counts_of_language_do_not_follow_the_partitions(spark, monkeypatch):
    """A gram has a row for each part of its language at most, and the sums are those of the texts."""
    rows = [(i, prose(i, 30) + "ab" * (i % 3), ("en", "fr")[i % 2]) for i in range(120)]
    want = Counter()
    for _, text, lang in rows:
        for n, (h, _) in langid.grams([text])[1].items():
            want.update((lang, n, x) for x in h.view(np.int64).tolist())
    monkeypatch.setattr(langid, "PART_IDS", 40)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for partitions in (2, 48):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            got = langid.partial_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(partitions)).collect()
            assert len(got) <= 2 * len(want)
            sums = Counter()
            for r in got:
                sums[r.lang, r.n, r.h] += r.c
            assert sums == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_partial_counts_are_given_out_when_a_task_holds_many(monkeypatch):
    monkeypatch.setattr(langid, "HELD_GRAMS", 8)
    counts, sums = langid._Counts(), Counter()
    for k in range(30):
        counts.add("en", 2, np.array([k, k, k + 1], np.uint64))
        if counts.merged > langid.HELD_GRAMS:
            for f in counts.given():
                sums.update(dict(zip(f["h"].tolist(), f["c"].tolist(), strict=True)))
            assert not counts.held
    for f in counts.given():
        sums.update(dict(zip(f["h"].tolist(), f["c"].tolist(), strict=True)))
    assert sums == Counter({0: 2, 30: 1} | {k: 3 for k in range(1, 30)})


def lines_by_hand(rows, least_docs=5):
    holders = defaultdict(set)
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    key = lambda line: lower(line.strip(SPACE))
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 40:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or len(holders[key(x)]) < least_docs or i == max(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return Counter(out)


def test_line_dedup(spark, odd):
    shared = [prose(50 + k, 14) for k in range(4)]
    rng = random.Random(5)
    rows = [(i, t) for i, t, _ in odd[0]] + [(100 + k, "\n".join([prose(k, 9), rng.choice(["  ", ""]) + rng.choice([str.upper, str.lower])(rng.choice(shared)), rng.choice(shared), "short"])) for k in range(40)]
    rows += [(200 + k, "É" * 41) for k in range(5)] + [(300 + k, "é" * 41) for k in range(4)]
    out = linededup.dedup(frame(spark, [(i, t, "s") for i, t in rows])).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in out) == lines_by_hand(rows)


def test_line_runs_are_disjoint_and_compacted(spark):
    runs = linededup.LineRuns(spark, fan=1)
    line = prose(9, 20)
    fresh = [runs.add(frame(spark, [(k, f"{line}\n{prose(k, 20)}", "s")])).count() for k in range(4)]
    assert fresh == [2, 1, 1, 1] and sum(df.count() for df in runs.runs()) == 5 and len(runs.levels) > 1
    assert [(r.max_doc) for r in runs.frequent(4).collect()] == [3]


def substrings_by_hand(docs):
    """By definition: a row for each (doc_id, bytes), whatever ids repeat."""
    first, out = {}, []
    for doc, data in sorted(docs):
        for i in range(len(data) - 49):
            first.setdefault(data[i : i + 50], doc)
    for doc, data in docs:
        gone, upto = bytearray(len(data)), 0
        for i in range(len(data) - 49):
            if first[data[i : i + 50]] < doc:
                gone[max(i, upto) : i + 50] = b"\1" * (i + 50 - max(i, upto))
                upto = i + 50
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        out.append((doc, len(data), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def least_by_hand(strings, docs):
    least = {}
    for s, d in zip(strings, docs, strict=True):
        for i in range(len(s) - 49):
            least[s[i : i + 50]] = min(least.get(s[i : i + 50], 999), d)
    return least


@pytest.mark.parametrize("seed", range(3))
def test_windows_by_merged_transforms(seed):
    rng = random.Random(seed)
    base = bytes(rng.choice(b"ab \xc3") for _ in range(300 + 500 * seed))
    strings = [base[a : a + 50 + rng.randrange(40)] for a in (rng.randrange(len(base) - 100) for _ in range(90))] + [b"z" * 300, b"abcab" * 50, b"z" * 200, b"short"]
    docs = np.array([rng.randrange(99) for _ in strings])
    least = least_by_hand(strings, docs)
    for n in (1, 2, 7):
        shard = np.sort(np.array([rng.randrange(n) for _ in strings]))
        symbols = [sum(len(s) + 1 for s, k in zip(strings, shard, strict=True) if k == j) for j in range(n)]
        made = np.split(suffixdedup.transform(strings, shard), np.cumsum(symbols)[:-1])
        got = suffixdedup.least_of_windows(made, [docs[shard == j] for j in range(n)])
        assert [g.tolist() for g in got] == [[least[s[i : i + 50]] for s, k in zip(strings, shard, strict=True) if k == j for i in range(len(s) - 49)] for j in range(n)]


def test_merged_transforms_keep_the_order_of_prefixes():
    strings = sorted({prose(k, 12).encode() + prose(k % 3, 12).encode() for k in range(12)})
    made = [suffixdedup.transform(strings[k::2], np.zeros(len(strings[k::2]), int)) for k in range(2)]
    shards = suffixdedup.Shards(made)
    place, begins = shards.windows()
    parted = [*strings[0::2], *strings[1::2]]
    windows = [parted[s][n - k : n - k + 50] for s, n, k in zip(shards.string[place].tolist(), shards.length[shards.string[place]].tolist(), shards.left[place].tolist(), strict=True)]
    assert windows == sorted(windows) and begins.tolist() == [True] + [a != b for a, b in zip(windows, windows[1:])]


def test_transform_of_one_string():
    text = b"mississippi"
    suffixes = sorted(text[i:] + b"\0" for i in range(len(text) + 1))
    want = [(b"\0" + text)[len(text) + 1 - len(s)] for s in suffixes]
    assert [max(x - 1, 0) for x in suffixdedup.transform([text], np.zeros(1, int)).tolist()] == want


@pytest.mark.parametrize("symbols", [4, 250])
def test_rounds_of_a_merge(symbols, monkeypatch):
    """As many pairs of symbols a round as fit: 25 rounds of one pair cost twice the time. Bytes of all kinds fit less."""
    rng = random.Random(symbols)
    strings = [bytes(rng.randrange(symbols) for _ in range(400)) for _ in range(200)]
    strings += [s[rng.randrange(300) :] for s in strings[:60]]
    docs = np.array([rng.randrange(99) for _ in strings])
    shard = np.arange(len(strings)) // 90
    made = np.split(suffixdedup.transform(strings, shard), np.cumsum([sum(len(s) + 1 for s, k in zip(strings, shard, strict=True) if k == j) for j in range(3)])[:-1])
    rounds, ordered = [], suffixdedup._ordered
    monkeypatch.setattr(suffixdedup, "_ordered", lambda key, bits: rounds.append(bits) or ordered(key, bits))
    got = suffixdedup.least_of_windows(made, [docs[shard == j] for j in range(3)])
    least = least_by_hand(strings, docs)
    assert [g.tolist() for g in got] == [[least[s[i : i + 50]] for s, k in zip(strings, shard, strict=True) if k == j for i in range(len(s) - 49)] for j in range(3)]
    assert len(rounds) == (5 if symbols == 4 else 13)


@pytest.mark.parametrize("bits", [9, 60])
def test_order_of_keys(bits):
    """Equal keys stay in order, whether places fit beside them or not."""
    key = np.random.default_rng(bits).integers(0, 300, 5_000).astype(np.uint64) << np.uint64(bits - 9)
    order, ordered = suffixdedup._ordered(key, bits)
    assert order.tolist() == np.argsort(key, kind="stable").tolist() and ordered.tolist() == sorted(key.tolist())


def digests(rows):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows if r.doc_id is not None)


@pytest.mark.parametrize("turned", [False, True])
@pytest.mark.parametrize("parts", [1, 3])
def test_substring_dedup_of_repeated_ids(spark, turned, parts):
    passage = prose(70, 20)
    rows = [(1, passage), (2, "other words " + passage), (2, "short"), (2, passage[5:] + " end"), (3, passage), (3, passage), (3, None)]
    rows = rows[::-1] if turned else rows
    docs = spark.createDataFrame([*rows, (None, passage), (None, None)], "doc_id long, text string").repartition(parts)
    out = suffixdedup.dedup(docs).collect()
    assert digests(out) == substrings_by_hand([(i, (t or "").encode()) for i, t in rows])
    assert sorted(r.n_bytes for r in out if r.doc_id is None and not r.n_removed) == [0, len(passage)]


@pytest.mark.parametrize("hot", [4_000_000, 2_000, 100])
def test_substring_dedup_splits_hot_minimisers(spark, hot):
    """Strings that differ around one passage: beyond a size their windows are dealt one by one."""
    rng = random.Random(3)
    passage = prose(70, 6)[:40]
    rows = [(300 - k, prose(k, 4) + passage + prose(k % 7 + 500, 4)) for k in range(120)] + [(400 + k, "ab" * rng.randrange(500)) for k in range(12)]
    assert digests(suffixdedup.dedup(frame(spark, [(i, t, "s") for i, t in rows]), hot=hot).collect()) == substrings_by_hand([(i, t.encode()) for i, t in rows])


def test_substring_dedup_of_a_text_of_megabytes(spark):
    long = prose(5, 180_000)
    assert len(long) > 4 * suffixdedup._CHUNK
    rows = [(9, long), (4, long[300_000:700_000]), (12, long[249_900:250_300]), (3, "x" * 600_000), (20, "x" * 500_000)]
    assert digests(suffixdedup.dedup(frame(spark, [(i, t, "s") for i, t in rows])).collect()) == substrings_by_hand([(i, t.encode()) for i, t in rows])


def test_substring_dedup(spark, odd, sf_dir):
    rng = random.Random(7)
    passage = prose(70, 60)
    rows = [(i, t) for i, t, _ in odd[0] if i is not None]
    rows += [(100 + k, prose(k, 30) + passage[rng.randrange(90) : rng.randrange(150, 380)] + "ü" * rng.randrange(60) + prose(k + 1, 5)) for k in range(40)]
    rows += [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = substrings_by_hand([(i, (t or "").encode()) for i, t in rows])
    out = suffixdedup.dedup(frame(spark, [(i, t, "s") for i, t in rows] + [(None, passage, "s")])).collect()
    assert len(out) == len(rows) + 1 and [r.n_removed for r in out if r.doc_id is None] == [0]
    assert digests(out) == want and sum(n for w, n in want.items() if w[2]) > 50


def fingerprint_by_hand(text):
    words = re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(rows, prints):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark, odd, sf_dir):
    rows = [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(i, t) for i, t, _ in odd[0] if i is not None] + [(500 + k, prose(80, 400) + " " + prose(k, 2)) for k in range(60)]
    prints = {i: fingerprint_by_hand(t) for i, t in rows}
    classes = components_by_hand(rows, prints)
    out = simhash.near_duplicates(frame(spark, [(i, t, "s") for i, t in rows])).collect()
    assert len(out) == len(rows)
    assert all(int(r.fingerprint, 16) == prints[r.doc_id] and len(r.fingerprint) == 16 for r in out)
    assert {r.doc_id: r.component_id for r in out} == classes and len({c for c in classes.values()}) < len(classes) - 50
    kept = simhash.one_of_each(frame(spark, [(i, t, "s") for i, t in rows] + [(None, "x", "s")]))
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(classes.values())) and kept.where("doc_id is null").count() == 1


def test_pigeonring_keys_miss_no_link():
    rng = np.random.default_rng(1)
    x = np.zeros(50_000, np.uint64)
    for _ in range(4):
        x |= np.uint64(1) << rng.integers(0, 64, x.size).astype(np.uint64)
    assert np.logical_or.reduce([((x & m) == 0) & simhash.linked(x, s) for s, m in simhash.KEYS]).all()


def test_links_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(2)
    near = {0}
    while len(near) < 120:
        near.add(rng.choice(sorted(near)) ^ (1 << rng.randrange(64)))
    far = [rng.getrandbits(64) for _ in range(200)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = [signed(x) for x in [*near, *far]]
    links = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 4
        root[find(r.a)] = find(r.b)
    assert len({find(signed(x)) for x in near}) == 1 and len(links) < 120 * 120
    ids = {x: k for k, x in enumerate(fps)}
    want = components_by_hand(None, {k: x & (1 << 64) - 1 for x, k in ids.items()})
    least = defaultdict(lambda: 10**9)
    for x, k in ids.items():
        least[find(x)] = min(least[find(x)], k)
    assert {k: least[find(x)] for x, k in ids.items()} == want


def test_pieces_leave_one_for_every_link():
    rng = random.Random(1)
    for _ in range(200):
        agreed = rng.getrandbits(64) & rng.getrandbits(64)
        parts = [int(p) for p in simhash.pieces(agreed)]
        assert sum(parts) == (1 << 64) - 1 - agreed and all(parts)
        x = sum(1 << b for b in rng.sample([b for b in range(64) if not agreed >> b & 1], 4))
        assert any(x & p == 0 for p in parts)


def test_mixing(spark, odd, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.unionByName(frame(spark, odd[0][:3]).select("doc_id", "text", "source").withColumnRenamed("source", "source"))
    out = [r.asDict() for r in mixing.mix(docs).collect()]
    again = [r.asDict() for r in mixing.mix(docs.repartition(7)).collect()]
    key = lambda r: (r["doc_id"] or -1, r["text_key"], r["copies"])
    assert sorted(map(key, out)) == sorted(map(key, again))
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 2
    total = sum(sizes.values())
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6 * total
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    free = [s for s in order if target[s] < 2 * sizes[s] - 1e-6]
    level = {target[s] / (3, 1, 2)[order.index(s) % 3] for s in free}
    assert max(level) - min(level) < 1e-6 * total and all(target[s] <= 2 * sizes[s] + 1e-6 for s in order)
    most = defaultdict(int)
    for r in out:
        most[r["source"]] = max(most[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= 2 * most[s] for s in order)
    table = mixing.mixed_documents(docs)
    assert table.columns == docs.columns and table.count() == sum(r["copies"] for r in out)


def test_mixing_odd_rows(spark, odd):
    out = mixing.mix(odd[1]).collect()
    words = lambda t: len(re.findall("[^ \t-\r]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in out) == Counter((i, words(t)) for i, t, _ in odd[0])
    whole, targets = targets_by_hand(Counter({s: sum(words(t) for _, t, x in odd[0] if x == s) for s in {x for _, _, x in odd[0]}}))
    source = {(i, words(t)): s for i, t, s in odd[0]}
    assert all(r.source_size == whole[source[r.doc_id, r.size]] and abs(r.target - targets[source[r.doc_id, r.size]]) < 1e-6 * sum(whole.values()) for r in out if r.doc_id is not None)


def targets_by_hand(sizes, share=1.5, cap=2):
    """Sizes and targets by source: what is above a cap is dealt again by weight, until nothing is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, out, free = share * sum(sizes.values()), {}, set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= cap * sizes[s]}
        for s in full or free:
            out[s] = min(level * weight[s], cap * sizes[s])
        if not full:
            break
        left -= sum(out[s] for s in full)
        free -= full
    return sizes, out


@pytest.mark.parametrize("seed", range(3))
def test_mixing_by_hand(spark, seed):
    """Targets by water filling, and what the mix takes of each source, to within its landing."""
    rng = random.Random(seed)
    rows = [(k, " ".join("w" for _ in range(rng.choice([0, 1, 3, 9, 40]))), rng.choice(["a", "a", "a", "b", "é", None, "z", "one"][: 5 + seed])) for k in range(400)]
    sizes, targets = targets_by_hand(Counter({s: sum(len(t.split()) for _, t, x in rows if x == s) for s in {x for _, _, x in rows}}))
    out = {r.doc_id: r for r in mixing.mix(frame(spark, rows)).collect()}
    taken = Counter()
    for i, t, s in rows:
        assert out[i].size == len(t.split()) and out[i].source_size == sizes[s] and abs(out[i].target - targets[s]) < 1e-6 * sum(sizes.values()) and out[i].copies in (0, 1, 2)
        taken[s] += out[i].copies * out[i].size
    assert all(abs(taken[s] - targets[s]) <= 80 for s in sizes)


def test_small_flights_keep_the_design():
    """Every end of a small flight is one that the two sums allow: no other set of ends has them."""
    for seed in range(20):
        rng = random.Random(seed)
        rows = [(k, rng.randrange(1, 6), rng.choice([0.25, 0.5, 0.75]), str(k)) for k in range(7)]
        out = dict(mixing.flight(rows, False))
        want = sum(p for _, _, p, _ in rows), sum(x * p for _, x, p, _ in rows)
        assert abs(sum(out.values()) - want[0]) < 1e-6 and abs(sum(out[k] * x for k, x, _, _ in rows) - want[1]) < 1e-6
        assert all(-1e-9 <= p <= 1 + 1e-9 for p in out.values()) and sum(1e-9 < p < 1 - 1e-9 for p in out.values()) <= 2


def test_flight_keeps_both_sums():
    rng = random.Random(4)
    rows = [(k, rng.randrange(1, 500), 0.37, str(k)) for k in range(2000)]
    out = dict(mixing.flight(rows, False))
    assert sum(0 < p < 1 for p in out.values()) <= 2
    assert abs(sum(out.values()) - 740) < 1e-6 and abs(sum(out[k] * x for k, x, _, _ in rows) - 0.37 * sum(x for _, x, _, _ in rows)) < 1e-5


def test_best_fit():
    rng = random.Random(6)
    lengths = [rng.randint(1, 64) for _ in range(500)]
    rows = packing.best_fit(lengths, 64)
    assert sorted(i for r in rows for i in r) == list(range(500)) and all(sum(lengths[i] for i in r) <= 64 for r in rows)
    space = []
    for i in sorted(range(500), key=lambda i: -lengths[i]):  # the same by searching all open rows
        fits = [k for k in range(len(space)) if space[k] >= lengths[i]]
        if fits:
            space[min(fits, key=lambda k: space[k])] -= lengths[i]
        else:
            space.append(64 - lengths[i])
    assert sorted(64 - sum(lengths[i] for i in r) for r in rows) == sorted(space)


def test_packing_round_trip(spark, odd):
    rows = packing.pack(odd[1], row=256, window=3_000).collect()
    with open(packing.VOCABULARY, "rb") as f:
        encoder = packing.Encoder(f.read())
    docs = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.input_ids), encoder.width)
        assert ids.size == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1] and (ids[r.n_tokens :] == packing.END).all()
        for k, (doc, at) in enumerate(zip(r.doc_ids, r.doc_offsets, strict=True)):
            docs[doc].append((at, ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]]))
    for i, t, _ in odd[0]:
        if i not in (None, 7):
            whole = np.concatenate([x for _, x in sorted(docs[i], key=lambda p: p[0])])
            assert whole[-1] == packing.END and encoder.encoding.decode(whole[:-1].tolist()) == (t or "")
            assert whole[:-1].tolist() == encoder.encoding.encode_ordinary(t or "")
    # every row is packed once, those that repeat an id or have none too
    ends = Counter(doc for r in rows for k, doc in enumerate(r.doc_ids) if np.frombuffer(bytes(r.input_ids), encoder.width)[r.cu_seqlens[k + 1] - 1] == packing.END)
    assert ends == Counter(i for i, _, _ in odd[0])
    total = sum(len(encoder.encoding.encode_ordinary(t or "")) + 1 for _, t, _ in odd[0])
    assert sum(r.n_tokens for r in rows) == total


def test_long_texts_are_encoded_in_pieces():
    with open(packing.VOCABULARY, "rb") as f:
        encoder = packing.Encoder(f.read())
    rng = random.Random(5)
    signs = ["a", "word", " ", "\n", " ", "it's", "\t", "é", "12", "!!", "  ", "日本", "\x1c", " "]
    for _ in range(3_000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 30)))
        assert b"".join(encoder.parts(text, rng.randint(1, 9))) == encoder.ids(text)
    assert b"".join(encoder.parts("x" * 50, 5)) == encoder.ids("x" * 50)


def test_packing_of_a_long_text_leaves_row_by_row(spark):
    text = " ".join(f"w{k % 997}" for k in range(600_000))
    rows = packing.pack(spark.createDataFrame([(1, text), (2, "a b"), (None, None)], "doc_id long, text string").coalesce(1), window=50_000).collect()
    with open(packing.VOCABULARY, "rb") as f:
        encoder = packing.Encoder(f.read())
    got = sorted((at, bytes(r.input_ids)[2 * r.cu_seqlens[k] : 2 * r.cu_seqlens[k + 1]]) for r in rows for k, (d, at) in enumerate(zip(r.doc_ids, r.doc_offsets, strict=True)) if d == 1)
    assert b"".join(x for _, x in got) == encoder.ids(text) + np.array([packing.END], "<u2").tobytes()
    assert len({r.pack_id.split("-")[1] for r in rows}) > 2


def test_matrices_hold_every_row(spark, odd):
    big = 2**53 + 1
    docs = odd[1].select("doc_id", "text").unionByName(spark.createDataFrame([(big, "one two three")], "doc_id long, text string"))
    packed = packing.pack(docs, row=256, window=3_000)
    rows, found = packed.collect(), packing.matrices(packed, rows=3, row=256).collect()
    assert Counter(bytes(r.input_ids) for r in rows) == Counter(bytes(m.input_ids)[512 * k : 512 * k + 512] for m in found for k in range(m.n_rows))
    for m in found:
        assert m.n_rows <= 3 and len(m.input_ids) == 512 * m.n_rows and m.cu_seqlens[0] == 0 and m.cu_seqlens[-1] == 256 * m.n_rows
        assert m.position_resets == m.cu_seqlens[:-1] and len(m.doc_ids) == len(m.doc_offsets) == len(m.position_resets)
        assert m.n_tokens == sum(b - a for a, b, at in zip(m.cu_seqlens, m.cu_seqlens[1:], m.doc_offsets) if at is not None)
    assert big in {d for m in found for d in m.doc_ids}
    rate = packing.fill_rate(packed, 256).first()
    assert rate.n_rows == len(rows) and rate.n_tokens == sum(r.n_tokens for r in rows) and 0 < rate.fill <= 1
    assert packing.matrices(packing.pack(docs.limit(0))).count() == 0 and packing.fill_rate(packing.pack(docs.limit(0))).first().fill is None


def test_language_of_long_texts_is_counted_in_pieces():
    rng = random.Random(7)
    signs = ["a", "B", ".", "é", "1", "zq", "İ"]
    for k in range(1_500):
        # a sigma's small form depends on its place, so there are some only where every piece's length has a blank
        own, most = (["Σ", *signs], 8) if k % 2 else (signs, 80)
        words = lambda: ["".join(rng.choice(own) for _ in range(rng.randint(0, most))) for _ in range(rng.randint(0, 9))]
        texts = [rng.choice([" ", "\n"]).join(words()) for _ in range(rng.randint(1, 4))]
        has, whole = langid.grams(texts)
        seen, pieces = np.zeros(len(texts), bool), {n: Counter() for n in whole}
        for s, some, found in langid.gram_batches(texts, batch=rng.randint(20, 30)):
            seen[s] |= some
            for n, (h, owner) in found.items():
                pieces[n].update(zip((owner + s.start).tolist(), h.tolist()))
        assert (seen == has).all() and all(Counter(zip(o.tolist(), h.tolist())) == pieces[n] for n, (h, o) in whole.items())


def test_language_works_in_little_memory():
    """Workers keep the most that they ever took, so what a batch takes must not follow its texts."""
    text = prose(3, 6_000)
    model = langid.LanguageFilter.build({"x": langid.grams([text])[1][3][0]})
    for texts in ([text] * 60, [text * 60]):
        tracemalloc.start()
        model.predict(texts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sum(map(len, texts)) > 1_500_000 and peak < 30e6
    rng = random.Random(8)
    for ahead in (5, 40):  # where no blank is near, a cut is made anyway
        long = "".join(rng.choice("aBé1 ") if rng.random() < 0.3 else "zq" for _ in range(900))
        whole, pieces = langid.grams([long])[1], [found for _, _, found in langid.gram_batches([long], batch=20, ahead=ahead)]
        assert len(pieces) > 10 and all(sorted(h.tolist()) == sorted(x for p in pieces for x in p[n][0].tolist()) for n, (h, _) in whole.items())


def test_language_sample_needs_no_files(spark, monkeypatch):
    """Each new file forks the executor; the sample is the same whether its rows are few or go through tables."""
    docs = spark.createDataFrame([(i % 300, f"a text {i}", ("en", "fr", "de")[i % 3]) for i in range(900)] + [(None, "x", "en"), (5, "x", None), (7, None, "es")], "doc_id long, text string, lang string")
    tables, write = [], langid.written
    monkeypatch.setattr(langid, "written", lambda df, tag: tables.append(tag) or write(df, tag))
    monkeypatch.setattr(langid, "PART_IDS", 20)
    few = sorted(map(tuple, langid._sampled(docs, 30).collect()))
    assert not tables
    order = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"))).collect() if r[0] is not None}
    ranked = {lang: sorted((i for i in range(300) if i % 3 == k), key=lambda i: (order[i], str(i)))[:30] for k, lang in enumerate(("en", "fr", "de"))}
    assert few == sorted((lang, str(i), at // 20) for lang, ids in ranked.items() for at, i in enumerate(ids))
    monkeypatch.setattr(langid, "BROADCAST_IDS", 2)
    assert sorted(map(tuple, langid._sampled(docs, 30).collect())) == few and tables == ["ends", "sample"]
