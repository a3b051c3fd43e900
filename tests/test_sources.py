import json

import pytest

from ledgerloom.sources import files, shared, tables

TRUSTED = "This page holds quite enough letters to be trusted."


def test_pages_are_read_again_when_their_text_is_bad(spark):
    rows = [("a", 1, TRUSTED, 0.0, False, None), ("a", 2, "?", 0.0, False, bytearray(b"good")), ("a", 3, "?", 0.0, False, bytearray(b"bad")), ("a", 4, "?", 0.0, False, bytearray(b"fail"))]
    pages = spark.createDataFrame(rows, "path string, page int, text string, image_share double, has_table boolean, image binary")

    def reader(image, page):
        if image == b"fail":
            raise ValueError("no answer")
        return (TRUSTED if image == b"good" else "x"), {"model": "eye", "tokens_in": 5, "tokens_out": page}

    out = {r.page: r for r in files.read_pages(pages, reader).collect()}
    assert [out[k].method for k in (1, 2, 3, 4)] == ["native", "ocr", None, None] and out[2].text == TRUSTED and out[2].tokens_out == 2
    assert "nothing legible" in out[3].error and "no answer" in out[4].error
    assert sum("no page reader" in (r.error or "") for r in files.read_pages(pages).collect()) == 3
    runs = spark.createDataFrame([("a", 7)], "path string, run_id long")
    events = files.page_events(files.read_pages(pages, reader), runs).collect()
    assert len(events) == 3 and {e.external_service for e in events} == {"ocr"} and all(e.run_id == 7 for e in events)


def test_image_coverage(spark):
    boxes = spark.createDataFrame([("a", 1, "image", 0.0, 0.0, 5.0, 10.0, 100.0), ("a", 1, "text", 0.0, 0.0, 9.0, 9.0, 100.0), ("a", 2, "image", 0.0, 0.0, 20.0, 10.0, 100.0), ("a", 3, "text", 0.0, 0.0, 1.0, 1.0, 0.0)], "path string, page int, kind string, x0 double, y0 double, x1 double, y1 double, page_area double")
    assert {r.page: r.image_share for r in files.image_coverage(boxes).collect()} == {1: 0.5, 2: 1.0, 3: 0.0}


def test_files_become_runs_or_are_refused(spark):
    rows = [("/in/a.txt", 9, bytearray(b"one\n\ntwo")), ("/in/b.txt", 0, bytearray(b"")), ("/in/c.bin", 1, bytearray(b"x"))]
    runs, blocks, refused = files.runs_of(spark.createDataFrame(rows, "path string, length long, content binary"), "c", "2024-01-01")
    assert [(r.path, r.n_blocks, r.status) for r in runs.collect()] == [("/in/a.txt", 2, "running")] and blocks.count() == 2
    assert {r.path for r in refused.collect()} == {"/in/b.txt", "/in/c.bin"}


def test_a_reader_of_another_kind(spark):
    files.register_reader("pdf", lambda data: [(f"page of {len(data)}", 1, "pdf")])
    try:
        out = files.blocks_of(spark.createDataFrame([("/x.pdf", 3, bytearray(b"abc"))], "path string, length long, content binary")).first()
        assert out.text == "page of 3" and out.page == 1 and out.error is None
    finally:
        files._readers.pop("pdf")


def test_prices(spark):
    text = json.dumps({"version": "v1", "models": {"m": {"input_per_million_usd": 2.5, "output_per_million_usd": 10}}})
    assert tuple(files.price_table(spark, text).first()) == ("m", 2.5, 10.0, "v1")
    with pytest.raises(KeyError):
        files.price_table(spark, "{}")


def test_json_export(spark, tmp_path):
    tables.export_json(spark.createDataFrame([(1, None)], "a long, b string"), str(tmp_path / "x"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "x")).collect()] == [{"a": 1, "b": None}]


def test_no_folder_of_ones_own_on_a_cluster():
    class Conf:
        def get(self, _):
            return None

    class Context:
        master, applicationId = "local-cluster[2,1,1024]", "x"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="share"):
        shared.shared_dir(Session())


def keyed(spark, *rows):
    return spark.createDataFrame(rows, "k string, v long")


def test_compaction_keeps_what_is_stored(spark, tmp_path):
    path, seen = str(tmp_path / "t"), {}
    for batch in range(14):
        tables.append_new(keyed(spark, (f"k{batch}", batch), ("same", batch), (f"k{batch // 2}", -batch)), path, ["k"], batch, ["v"])
        seen.setdefault(f"k{batch}", batch)
        seen.setdefault("same", batch)
        tables.compact(spark, path, width=3)
        assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("batch=")]) <= 4
    got = {r.k: r.v for r in tables.stored(spark, path).collect()}
    assert tables.stored(spark, path).count() == len(got) == 15 and got["same"] == 0 and got["k0"] == 0 and got["k13"] == 13
    now = tables.manifest(spark, path)
    assert sorted(p.name for p in (tmp_path / "t" / "_levels").iterdir()) == sorted(now["folders"]) and {f[0] for f in now["folders"]} == {"1", "2"}
    # the latest batch may be run again
    tables.append_new(keyed(spark, ("k13", 13), ("k12", 5)), path, ["k"], 13, ["v"])
    assert tables.stored(spark, path).count() == 15


def test_a_compaction_that_stops_leaves_old_or_new(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    for batch in range(4):
        tables.append_new(keyed(spark, (f"k{batch}", batch)), path, ["k"], batch, ["v"])
    whole = {f"k{b}" for b in range(4)}
    keys = lambda: {r.k for r in tables.stored(spark, path).collect()}

    def stop(*_):
        raise RuntimeError("stopped")

    for step in ("_write_text", "sweep"):
        with monkeypatch.context() as m:
            m.setattr(tables, step, stop)
            with pytest.raises(RuntimeError):
                tables.compact(spark, path, width=3)
        assert keys() == whole and tables.stored(spark, path).count() == 4
    tables.sweep(spark, path)
    assert keys() == whole and [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("batch=")] == ["batch=3"]
