import gzip
import hashlib
import random
import re
from collections import Counter
from itertools import groupby

import duckdb
import pytest

from ledgerloom.llm import common, decontam, quotes, registry, warc

PAGE = "page_id long, url string, html string, digest string, value string"


def pages_by_hand(rows, least=100):
    first = {}
    for i, h in rows:
        if i is not None and len(h.encode()) >= least:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, h in rows:
        visit = i is not None and h in first and first[h] < i
        out.append((i, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "revisit" if visit else "response", first[h] if visit else None))
    return Counter(out)


@pytest.mark.parametrize("block", ["2000", "100m"])
def test_warc(spark, block):
    rng = random.Random(1)
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {}\r\n\r\n"
    body = lambda k: "".join(rng.choice(["<p>é😀", "\r\n\r\n", "\r\n", "\n", "text ", fake.format(rng.randrange(300)), "\r"]) for _ in range(k))
    rows = [(i, body(rng.randrange(30))) for i in range(25)]
    rows += [(100 + i, rows[i % 5][1] + "x" * 120) for i in range(10)] + [(200 + i, "short") for i in range(4)] + [(300, ""), (301, None), (None, "y" * 200), (302, "y" * 200), (303, "\r\n" * 60), (304, fake.format(0) * 9)]
    pages = spark.createDataFrame([(i, "http://a\r\nContent-Length: 1", h, "d", "v") for i, h in rows], PAGE)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        out = warc.round_trip(pages.coalesce(2), common.new_path(spark, "warc")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == pages_by_hand([(i, h or "") for i, h in rows])


def test_warc_payloads(spark):
    path = common.new_path(spark, "warc")
    pages = spark.createDataFrame([(1, "http://x/", "<p>\r\n\r\nWARC/1.1\r\n", "", ""), (2, None, "é", "", "")], PAGE)
    warc.write_archives(pages, path)
    got = {r.page_id: (r.target, bytes(r.payload).decode()) for r in warc.read_archives(spark, path).collect()}
    assert got == {1: ("http://x/", "<p>\r\n\r\nWARC/1.1\r\n"), 2: ("", "é")}
    assert warc.round_trip(pages.limit(0), common.new_path(spark, "warc")).count() == 0


def test_warc_records_are_whole(spark):
    """What the format asks of each record, and ids that are no other record's, though page ids repeat."""
    path, same = common.new_path(spark, "warc"), "x" * 150
    pages = spark.createDataFrame([(1, "http://a/", same, "", ""), (2, "http://b/", same, "", ""), (3, "", "y" * 200, "", ""), (3, "", "y" * 200, "", ""), (4, "", "y" * 200, "", ""), (None, None, None, "", "")], PAGE)
    warc.to_records(pages, date="2024-01-02T03:04:05Z").coalesce(1).write.option("lineSep", "\r\n\r\n").text(path)
    raw = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(path).orderBy("path").collect()).decode()
    heads = [dict(line.split(": ", 1) for line in head.split("\r\n")[1:]) for head in re.findall(r"WARC/1\.1\r\n.*?(?=\r\n\r\n)", raw, re.S)]
    assert len(heads) == 6 and all({"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(h) and h["WARC-Date"] == "2024-01-02T03:04:05Z" for h in heads)
    assert len({h["WARC-Record-ID"] for h in heads}) == 6 and all(re.fullmatch("<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", h["WARC-Record-ID"]) for h in heads)
    by = {h.get("X-Page-ID"): h for h in heads}
    assert by["2"]["WARC-Type"] == "revisit" and by["2"]["WARC-Profile"] == warc.PROFILE and by["2"]["WARC-Refers-To"] == by["1"]["WARC-Record-ID"]
    assert by["4"]["X-Refers-To-Page-ID"] == "3" and "WARC-Refers-To" not in by["4"]


def test_warc_of_others(spark, tmp_path):
    """Both versions in one file, fields in other case, and an archive compressed record by record."""
    def record(version, uri, body):
        return f"WARC/{version}\r\nwarc-type: response\r\nWARC-Record-ID: <urn:uuid:{uri}>\r\nWarc-Target-URI: {uri}\r\ncontent-length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    fake = b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    records = [record("1.0", "a", b"one " + fake), record("1.1", "b", b"WARC/1.2\r\nContent-Length: 1\r\n\r\n"), record("1.0", "c", b"")]
    (tmp_path / "x.warc").write_bytes(b"".join(records))
    (tmp_path / "y.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    out = warc.read_archives(spark, f"file://{tmp_path}").collect()
    assert Counter((r.file[-3:], r.target, bytes(r.payload), r.page_id) for r in out) == Counter((k, t, b, None) for k in ("arc", ".gz") for t, b in (("a", b"one " + fake), ("b", b"WARC/1.2\r\nContent-Length: 1\r\n\r\n"), ("c", b"")))


def shingles(text, size=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def contained_by_hand(docs, items):
    """Items of fewer than five words are one shingle, to be found anywhere."""
    out = {}
    for i, t in docs:
        for k, b in items:
            size = min(5, len((b or "").split()))
            want = shingles(b, size) if size else set()
            found = len(want & shingles(t, size)) if size else 0
            if want and found >= 0.8 * len(want) - 1e-9:
                out[i, k] = max(out.get((i, k), (0, 0, 0)), (round(found / len(want), 6), len(want), found))
    return out


@pytest.mark.parametrize("bound", [32_000_000, 0])
def test_decontamination(spark, monkeypatch, bound):
    """By broadcasting, and by shuffling where nothing is small enough."""
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", bound)
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop")
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(rng.randrange(5, 60))) for k in range(20)] + [(20, None), (21, ""), (22, "two words"), (23, "\x0b"), (0, "the same id again for five more words")]
    docs = []
    for i in range(120):
        words = items[rng.randrange(20)][1].split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = word()
        docs.append((i, text(rng.randrange(300)) + " " + rng.choice([" ", "\n"]).join(words).title() + " " + text(rng.randrange(50))))
    docs += [(200, None), (201, ""), (202, "Two  WORDS"), (203, text(3)), (206, "there are two words in here"), (207, "two\nwords"), (208, "wordstwo words"), (5, docs[6][1]), (204, text(20_000) + " " + items[3][1])]
    want = contained_by_hand(docs, items)
    d = spark.createDataFrame([(i, t, "w", 1) for i, t in [*docs, (None, items[4][1]), (None, items[4][1]), (None, "fine")]], "doc_id long, text string, key string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.contained(d, b).collect()
    assert {(r.doc_id, r.item_id): (r.containment, r.n_shingles, r.n_found) for r in out if r.doc_id is not None} == want and 40 < len(want) < 200
    assert [r.item_id for r in out if r.doc_id is None] == [4]
    left = decontam.clean(d, b)
    leaked = {i for i, _ in want}
    assert left.columns == d.columns
    rest = Counter(r.doc_id for r in left.collect())
    assert rest == Counter([i for i, _ in docs if i not in leaked] + [None])
    assert decontam.contained(d.limit(0), b).count() == 0 and decontam.clean(d, b.limit(0)).count() == d.count()


def test_signatures_miss_nothing(spark):
    """Each item less any of the shingles that it may lack still has enough of its signature."""
    rng = random.Random(6)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate([5, 6, 9, 14, 25, 60, 200, 3])]
    docs = []
    for k, t in items:
        words = t.split()
        for j in range(12):  # cut a fifth of the shingles off at either end, or break one place
            lost = int(0.2 * max(1, len(words) - 4) + 1e-9)
            a = rng.randrange(lost + 1)
            docs.append((100 * k + j, text(rng.randrange(5)) + " " + " ".join(words[a : len(words) - (lost - a)]) + " " + text(rng.randrange(400))))
    want = contained_by_hand(docs, items)
    assert len(want) == len(docs)
    out = decontam.contained(spark.createDataFrame([(*d, "", 1) for d in docs], "doc_id long, text string, key string, item_id int"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.containment, r.n_shingles, r.n_found) for r in out} == want


def test_decontamination_agrees_with_its_sql(spark, sf_dir):
    con = duckdb.connect()
    rng = random.Random(2)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()] + [(900, "two words"), (901, "One"), (902, None)]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [(10**6 + k, f"so {rng.choice(items)[1]} one two words") for k in range(30)]
    for name, columns, rows in (("documents", "doc_id BIGINT, text VARCHAR", docs), ("benchmark", "item_id BIGINT, text VARCHAR", items)):
        con.execute(f"CREATE TABLE {name} ({columns})")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    want = con.sql(registry.oracle_sql()["op5_decontamination"])
    out = decontam.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = Counter(map(tuple, out.select(*want.columns).collect()))
    assert got == Counter(want.fetchall()) and sum(k[want.columns.index("item_id")] == 900 for k in got) >= 30


TALK = "conv_id long, turn long, role string, text string, m string, level int"


def test_quotes(spark):
    rows = [
        (1, 0, "user", "How do I sort a list?\nIt has numbers."),
        (1, 1, "assistant", "> How do I SORT  a list?\n> It has numbers.\nCall sorted."),
        (1, 2, "user", "And a set?"),
        (1, 3, "user", "> > It has numbers.\n> Call sorted.\nThanks!"),
        (1, 4, "assistant", "> And a set?\nThe same."),
        (1, 5, "user", ">> never said\nso what"),
        (1, 6, "user", "> a later line\nearly"),
        (1, 7, "user", "a later line"),
        (2, 0, "user", "And a set?"),
        (None, 0, "user", "> And a set?"),
        (2, None, "user", None),
        (2, 1, None, ""),
        (2, 1, None, ""),
    ]
    out = quotes.link(spark.createDataFrame([(*r, "x", 1) for r in rows], TALK)).collect()
    one = {r.turn: r for r in out if r.conv_id == 1}
    assert {t: r.reply_to for t, r in one.items()} == {0: None, 1: 0, 2: None, 3: 1, 4: 2, 5: None, 6: None, 7: None}
    assert {t: r.thread for t, r in one.items()} == {0: 0, 1: 0, 2: 2, 3: 0, 4: 2, 5: 5, 6: 6, 7: 7}
    assert [r.turn for r in sorted(one.values(), key=lambda r: r.position)] == [0, 1, 3, 2, 4, 5, 6, 7]
    assert one[1].text == "Call sorted." and one[3].text == "Thanks!" and one[3].max_level == 2 and one[3].n_quotes == 2 and one[3].n_linked == 2
    assert len(out) == len(rows) and [r.text for r in out if r.conv_id is None] == [""]
    assert quotes.link(spark.createDataFrame([], TALK)).count() == 0


def linked_by_hand(rows):
    """Every field of distinct (conv_id, turn) messages, by definition."""
    def level(line):
        return (m := re.match("[ \t]*((?:>[ \t]?)+)", line)) and m[1].count(">") or 0

    def units(text):
        parts = [text, *re.split("\n[ \t]*\n", text), *text.split("\n")]
        return {" ".join(p.lower().split()) for p in parts} - {""}

    said, out = {}, {}
    for c, t, role, text in sorted(rows):
        lines = (text or "").split("\n")
        lines = [x for x, y in zip(lines, [*lines[1:], ""], strict=True) if not (level(y) and not level(x) and re.fullmatch("[ \t]*[Oo][Nn][ \t].*[ \t][Ww][Rr][Oo][Tt][Ee]:[ \t]*", x))]
        spans = [(k, "\n".join(re.sub("^[ \t]*(?:>[ \t]?)+", "", x) if k else x for x in part)) for k, part in groupby(lines, level)]
        votes, linked = Counter(), 0
        for k, passage in spans:
            found = [max(u for u in said if u[0] == c and h in said[u])[1] for h in units(passage) if any(u[0] == c and h in said[u] for u in said)] if k else []
            votes.update((k, f) for f in found)
            linked += bool(found)
        body = "\n".join(p for k, p in spans if not k)
        reply = min(votes, key=lambda v: (v[0], -votes[v], -v[1]))[1] if votes else None
        said[c, t] = units(body)
        out[c, t] = [role, reply, t if reply is None else out[c, reply][2], sum(k > 0 for k, _ in spans), linked, max([k for k, _ in spans], default=0), body]

    def path(c, t):
        return (path(c, out[c, t][1]) if out[c, t][1] is not None else ()) + (t,)

    for c in {c for c, _ in out}:
        for n, t in enumerate(sorted((t for x, t in out if x == c), key=lambda t: path(c, t)), 1):
            out[c, t].append(n)
    return out


def talk(seed):
    """Conversations whose messages quote earlier ones, some of them introduced, at up to four levels."""
    rng = random.Random(seed)
    rows = []
    for c in range(12):
        texts = []
        for t in range(12):
            lines = [rng.choice(["one", "Two  words", "three of them", "four", "", " five"]) for _ in range(rng.randrange(1, 4))]
            if texts and rng.random() < 0.7:
                intro = [rng.choice(["On Monday, Ann wrote:", " on 1 May he WROTE: ", "Only he wrote:"])] if rng.random() < 0.4 else []
                lines = intro + ["> " * rng.randrange(2) + ">" + x for x in rng.choice(texts).split("\n")[: rng.randrange(1, 4)]] + lines
            texts.append("\n".join([*lines, f"line {rng.randrange(30)}"]))
            rows.append((c, t * 3, rng.choice(["user", "assistant"]), texts[-1]))
    return rows


@pytest.mark.parametrize("span", [1, 5, 1024])
def test_quotes_by_hand(spark, span):
    rows = talk(span)
    want = linked_by_hand(rows)
    out = quotes.link(spark.createDataFrame([(*r, "x", 1) for r in rows], TALK).repartition(3), span).collect()
    got = {(r.conv_id, r.turn): [r.role, r.reply_to, r.thread, r.n_quotes, r.n_linked, r.max_level, r.text, r.position] for r in out}
    assert got == want and len(out) == len(rows)
    assert sum(v[1] is not None for v in want.values()) > 60 and max(v[5] for v in want.values()) > 2


def test_replies_come_before_later_branches(spark):
    rows = [(1, 0, "u", "first\nzero"), (1, 1, "a", "> zero\none"), (1, 2, "a", "> first\ntwo"), (1, 3, "u", "> one\nthree"), (1, 4, "u", "> two\nfour"), (1, 5, "u", "> three\nfive")]
    out = quotes.link(spark.createDataFrame([(*r, "x", 1) for r in rows], TALK)).orderBy("position").collect()
    assert [(r.turn, r.reply_to) for r in out] == [(0, None), (1, 0), (3, 1), (5, 3), (2, 0), (4, 2)]


def test_quotes_agree_with_their_sql(spark):
    rows = talk(9) + [(3, 40, "user", None), (3, 40, None, ""), (3, 41, "user", "> four\nagain"), (3, 41, "user", "> four\nagain"), (3, 41, "assistant", ">one\nother"), (None, 1, "user", "> one"), (None, None, None, "x"), (4, None, "user", "> one\ny"), (5, 50, "user", "> three of them\n" * 400)]
    out = quotes.link(spark.createDataFrame([(*r, "x", 1) for r in rows], TALK).repartition(4))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.sql(registry.oracle_sql()["op2_quotation_linking"])
    assert Counter(map(tuple, out.select(*want.columns).collect())) == Counter(want.fetchall())


def test_a_conversation_of_many_turns_and_a_long_chain(spark):
    """One conversation holds most rows: a chain of answers, and a message that very many answer."""
    rows = [(1, 0, "u", "the start")] + [(1, t, "u", f"> line {t - 1}\nline {t}" if t > 1 else "line 1") for t in range(1, 120)] + [(1, 200 + t, "a", "> the start\nyes") for t in range(150)] + [(2, 0, "u", "alone")]
    out = {(r.conv_id, r.turn): r for r in quotes.link(spark.createDataFrame([(*r, "x", 1) for r in rows], TALK), span=16).collect()}
    assert [out[1, t].thread for t in (119, 349)] == [1, 0] and out[1, 119].reply_to == 118
    order = sorted((r for k, r in out.items() if k[0] == 1), key=lambda r: r.position)
    assert [r.position for r in order] == list(range(1, 271)) and [r.turn for r in order] == [0, *range(200, 350), *range(1, 120)]


def test_quotes_use_functions_only(spark):
    out = quotes.link(spark.createDataFrame([(1, 0, "u", "a", "", 1)], TALK))
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


def test_components(spark):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[x] == find(x) for x in got) and set(got) == {x for e in edges if e[0] != e[1] for x in e}


def test_components_of_a_star_and_a_chain(spark):
    edges = [(0, k) for k in range(1, 3_000)] + [(k, k + 1) for k in range(10_000, 10_040)] + [(2_999, 10_020)]
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.root for r in got} == {0} and len(got) == 3_041

