from ledgerloom.streaming import watch


def runs(spark, path):
    return sorted(r.path.rsplit("/", 1)[-1] for r in spark.read.parquet(path).collect())


def test_watch_once_each_over_restarts(spark, tmp_path):
    inbox, out, mark = tmp_path / "inbox", str(tmp_path / "runs"), str(tmp_path / "mark")
    inbox.mkdir()
    (inbox / "a.txt").write_text("same")
    (inbox / "b.part").write_text("partial")
    (inbox / ".hidden").write_text("hidden")
    watch.ingest(spark, str(inbox), "c", out, mark).awaitTermination(60)
    assert runs(spark, out) == ["a.txt"]
    (inbox / "copy.txt").write_text("same")
    (inbox / "d.txt").write_text("other")
    watch.ingest(spark, str(inbox), "c", out, mark).awaitTermination(60)
    assert runs(spark, out) == ["a.txt", "d.txt"]


def test_stable_sightings(spark):
    rows = [("a", 1, 5, 1), ("a", 2, 5, 1), ("a", 3, 6, 2), ("a", 5, 6, 2), ("b", 1, 1, 1)]
    got = {(r.path, r.poll): r.stable for r in watch.stable(spark.createDataFrame(rows, "path string, poll long, size long, mtime long")).collect()}
    assert got == {("a", 1): False, ("a", 2): True, ("a", 3): False, ("a", 5): False, ("b", 1): False}


def test_outcomes_are_recorded_once(spark, tmp_path):
    inbox, out, mark = tmp_path / "inbox", str(tmp_path / "runs"), str(tmp_path / "mark")
    inbox.mkdir()
    (inbox / "good.txt").write_text("one\n\ntwo")
    (inbox / "bad.txt").write_bytes(b"\xff\xfe\x00")
    (inbox / "what.exe").write_text("program")
    (inbox / "big.txt").write_text("x" * 5000)
    watch.ingest(spark, str(inbox), "c", out, mark, largest=1000).awaitTermination(60)
    got = {r.path.rsplit("/", 1)[-1]: (r.outcome, r.n_blocks) for r in spark.read.parquet(out).collect()}
    assert got == {"good.txt": ("new", 2), "bad.txt": ("unreadable", 0), "what.exe": ("unreadable", 0), "big.txt": ("oversize", 0)}
    (inbox / "bad again.txt").write_bytes(b"\xff\xfe\x00")
    watch.ingest(spark, str(inbox), "c", out, mark, largest=1000).awaitTermination(60)
    assert spark.read.parquet(out).count() == 4
    assert {r.outcome: r.n for r in watch.report(spark, out).collect()} == {"new": 1, "unreadable": 2, "oversize": 1}


def test_a_batch_run_twice_is_stored_once(spark, tmp_path):
    out = str(tmp_path / "runs")
    files = lambda *rows: spark.createDataFrame(rows, "path string, length long, content binary")
    first = files(("/a.txt", 1, bytearray(b"a")), ("/b.txt", 1, bytearray(b"b")), ("/gone.txt", 1, None))
    watch.sink(first, 0, out, "c")
    watch.sink(first, 0, out, "c")
    watch.sink(files(("/c.txt", 1, bytearray(b"a")), ("/gone.txt", 1, bytearray(b"z"))), 1, out, "c")
    assert sorted(r.path for r in spark.read.parquet(out).collect()) == ["/a.txt", "/b.txt", "/gone.txt"]


def test_stable_stream(spark, tmp_path):
    """Sightings of several sweeps; a file is taken when it holds still, and again after it has changed and does so."""
    rows = [("a", 1, 5, 1), ("a", 2, 5, 1), ("a", 3, 5, 1), ("a", 4, 6, 2), ("a", 5, 6, 2), ("b", 1, 1, 1), ("b", 2, 2, 1), ("c", 1, 1, 1), ("c", 3, 1, 1)]
    spark.createDataFrame(rows, "path string, poll long, size long, mtime long").write.parquet(str(tmp_path / "in"))
    stream = watch.stable_stream(spark.readStream.schema("path string, poll long, size long, mtime long").parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [("a", 5, 1), ("a", 6, 2)]


def test_run_states_and_waits(spark):
    rows = [(1, 1, "running"), (1, 2, "awaiting_review"), (2, 1, "running"), (2, 2, "committed"), (2, 3, "running"), (3, 1, "failed")]
    got = {r.run_id: (r.status, r.settled, r.n_events) for r in watch.run_states(spark.createDataFrame(rows, "run_id long, seq long, status string")).collect()}
    assert got == {1: ("awaiting_review", False, 2), 2: ("committed", True, 3), 3: ("failed", True, 1)}
    w = watch.waits()
    assert w[:3] == [2.0, 3.0, 4.5] and max(w) == 30.0 and sum(w) <= 300 < sum(w) + 30


def test_folders(spark):
    rows = spark.createDataFrame([("b", "/inbox/b"), ("a", "/inbox/a"), ("c", ""), ("d", None)], "slug string, watch_path string")
    assert watch.folders(rows) == [("a", "/inbox/a"), ("b", "/inbox/b")]


def swept(spark, tmp_path, **more):
    """One poll: a sweep and what the stream takes."""
    at = {k: str(tmp_path / k) for k in ("inbox", "runs", "mark", "seen", "blocks")}
    query = watch.ingest(spark, at["inbox"], "c", at["runs"], at["mark"], sightings=at["seen"], blocks_path=at["blocks"], **more)
    query.awaitTermination(30)
    taken = runs(spark, at["runs"]) if list((tmp_path / "runs").rglob("*.parquet")) else []
    return taken, states(spark, at["mark"], "last")


def states(spark, checkpoint, name):
    """How many keys a stream holds a state for."""
    with watch._state_store(spark):
        return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load().count()


def test_only_files_that_hold_still_are_taken(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.txt").write_text("one\n\ntwo")
    (inbox / "growing.txt").write_text("x")
    (inbox / "b.part").write_text("partial")
    assert swept(spark, tmp_path) == ([], 2)
    (inbox / "growing.txt").write_text("x and more")
    (inbox / "short.txt").write_text("gone soon")
    assert swept(spark, tmp_path) == (["a.txt"], 3)
    (inbox / "short.txt").unlink()
    (inbox / "copy.txt").write_text("one\n\ntwo")
    assert swept(spark, tmp_path) == (["a.txt", "growing.txt"], 3)
    (inbox / "a.txt").unlink()
    assert swept(spark, tmp_path) == (["a.txt", "growing.txt"], 2)
    (inbox / "short.txt").write_text("gone soon")  # begins anew
    assert swept(spark, tmp_path)[0] == ["a.txt", "growing.txt"]
    assert swept(spark, tmp_path) == (["a.txt", "growing.txt", "short.txt"], 3)
    blocks = spark.read.parquet(str(tmp_path / "blocks"))
    assert sorted((r.path.rsplit("/", 1)[-1], r.block_index, r.text) for r in blocks.collect()) == [("a.txt", 0, "one"), ("a.txt", 1, "two"), ("growing.txt", 0, "x and more"), ("short.txt", 0, "gone soon")]
    assert blocks.select("run_id").distinct().count() == 3


def test_state_of_files_not_seen_any_more_is_forgotten(spark, tmp_path):
    seen, mark, out = (str(tmp_path / x) for x in ("in", "mark", "out"))

    def poll(*rows):
        spark.createDataFrame(rows, watch.SIGHTING).coalesce(1).write.mode("append").parquet(seen)
        with watch._state_store(spark):
            stream = watch.held_still(spark.readStream.schema(watch.SIGHTING).parquet(seen), forget_ms=1)
            q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        q.awaitTermination(30)
        return states(spark, mark, "last")

    poll(("a", 1, 5, 1), ("b", 1, 5, 1))
    assert poll(("c", 2, 1, 1)) == 1
    assert poll(("a", 2, 5, 1)) == 1 and spark.read.parquet(out).count() == 0


def test_a_failed_sweep_is_done_again(spark, tmp_path):
    inbox, seen = tmp_path / "inbox", tmp_path / "seen"
    inbox.mkdir()
    (inbox / "a.txt").write_text("a")
    assert watch.sweep(spark, str(inbox), str(seen)) == 1
    (seen / "sweep-000000000002").mkdir()
    assert watch.stored_polls(spark, str(seen)) == [1] and watch.sweep(spark, str(inbox), str(seen)) == 2


def test_run_states_resume_and_drop_late_events(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    schema = "run_id long, seq long, status string, at timestamp"
    events, out, mark = (str(tmp_path / x) for x in ("events", "out", "mark"))

    def step(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(events)
        q = watch.keep_states(spark.readStream.schema(schema).parquet(events), out, mark)
        q.awaitTermination(30)
        return {r.run_id: (r.status, r.settled, r.n_events) for r in watch.latest_states(spark, out).collect()}, states(spark, mark, "run")

    got, _ = step((1, 1, "running", at(0)), (2, 1, "running", at(0)), (1, 3, "committed", at(2)))
    assert got == {1: ("committed", True, 2), 2: ("running", False, 1)}
    # what comes out of order but on time counts, also after a restart
    got, _ = step((1, 2, "awaiting_review", at(1)), (2, 2, "blocked", at(3)), (2, 3, "running", at(4)))
    assert got == {1: ("committed", True, 3), 2: ("blocked", True, 3)}
    every = spark.read.parquet(events)
    assert {r.run_id: (r.status, r.settled, r.n_events) for r in watch.run_states(every).collect()} == got
    got, _ = step((3, 1, "running", at(60)))
    got, held = step((1, 9, "running", at(5)), (3, 2, "awaiting_review", at(61)))
    assert got[1] == ("committed", True, 3) and got[3] == ("awaiting_review", False, 2) and held == 1
