"""WARC archives: written by the text sink, read back by following record lengths.

Every record ends in CR LF CR LF, so a sink with that line separator writes whole archives through any file
system Spark knows. The reader splits on the magic that begins each record (it does not overlap itself, so
blocks of a file agree on where it is) and knows each piece's offset, but a payload may hold the magic too.
Tasks therefore emit, for each piece, its offset and that of its successor by Content-Length, contracted to
the way out of the block; pointer jumping from each file's start keeps what is reachable, and only this is
read as records.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.common import drop_path, written

#: Payloads below this size are never revisits.
LEAST = 100
SEP = b"\r\n\r\n"
#: What begins each record, whatever its minor version; records are written as the last of VERSIONS.
MAGIC = b"WARC/1."
VERSIONS = (b"0\r\n", b"1\r\n")
#: What a revisit says about what it is equal to (a fixed value of the format).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Entries (one row for each block of a file) up to so many are broadcast to the blocks.
BROADCAST_ROWS = 200_000

RECORD = "file string, offset long, length long, page_id long, record_type string, refers_to long, declared_bytes long, declared_digest string, target string, payload binary, whole boolean, block long, at long"
_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*([^\r\n]*)", re.M)


def _record_id(name: Column) -> Column:
    """A record id of a name, which is no other record's."""
    h = F.md5(name)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), *[F.concat(F.lit("-"), F.substring(h, a, n)) for a, n in ((9, 4), (13, 4), (17, 4), (21, 12))], F.lit(">"))


def to_records(pages: DataFrame, least: int = LEAST, date: str | None = None) -> DataFrame:
    """value: a record for each page without its last separator; date (of today, by default) is that of the capture.

    Of equal payloads of at least `least` bytes, the smallest page_id is the response. Rows that repeat that
    page_id are all responses; rows without a page_id are responses and nothing refers to them. Null html is
    an empty payload.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]+", " ").alias("url"), body.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html"))
    firsts = rows.where((F.col("size") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select(F.col("digest").alias("_digest"), "first")
    firsts, _ = written(firsts, "payloads")
    rows = rows.join(firsts, F.col("digest") == F.col("_digest"), "left")
    # rows that repeat an id are records of their own, which nothing can name by that id
    repeated = pages.where("page_id is not null").groupBy(F.col("page_id").cast("long").alias("_again")).count().where("count > 1").select("_again")
    repeated, _ = written(repeated, "repeated")
    few = repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    again = F.broadcast(repeated) if few else repeated
    rows = rows.join(again, F.col("page_id") == F.col("_again"), "left").join(again.withColumnRenamed("_again", "_first"), F.col("first") == F.col("_first"), "left")
    own = F.when(F.col("_again").isNotNull() | F.col("page_id").isNull(), F.concat(F.lit("row:"), F.monotonically_increasing_id().cast("string"))).otherwise(F.concat(F.lit("page:"), F.col("page_id").cast("string")))
    when = F.lit(date) if date else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    visit = F.col("first") < F.col("page_id")
    kind = F.when(visit, "revisit").otherwise("response")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit((MAGIC + VERSIONS[-1]).decode()),
        line("WARC-Type", kind),
        line("WARC-Record-ID", _record_id(own)),
        line("WARC-Date", when),
        line("WARC-Target-URI", F.col("url")),
        F.when(visit, line("WARC-Profile", F.lit(PROFILE))).otherwise(""),
        F.when(visit & F.col("_first").isNull(), line("WARC-Refers-To", _record_id(F.concat(F.lit("page:"), F.col("first").cast("string"))))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("page_id").isNotNull(), line("X-Page-ID", F.col("page_id").cast("string"))).otherwise(""),
        F.when(visit, line("X-Refers-To-Page-ID", F.col("first").cast("string"))).otherwise(""),
        line("X-Payload-Length", F.col("size").cast("string")),
        line("Content-Type", F.lit("text/html")),
        F.concat(F.lit("Content-Length: "), F.when(visit, "0").otherwise(F.col("size").cast("string"))),
        F.lit(SEP.decode()),
    )
    return rows.select(F.concat(head, F.when(visit, "").otherwise(F.col("html"))).alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Archives of all pages below path, in any store Spark can write to."""
    to_records(pages, least).write.option("lineSep", SEP.decode()).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block, value: what lies between magics, in order within a block."""
    return spark.read.option("lineSep", MAGIC.decode()).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _field(head: bytes) -> dict[bytes, bytes]:
    return {k.lower(): v.strip() for k, v in _FIELD.findall(head)}


def _head(piece: bytes) -> tuple[dict[bytes, bytes], int, int] | None:
    """Fields, size with its separator and Content-Length of a record's head, or None if it is not one."""
    end = piece.find(SEP)
    if end < 0 or piece[:3] not in VERSIONS:
        return None
    fields = _field(piece[3:end])
    size = fields.get(b"content-length", b"")
    return (fields, end + len(SEP), int(size)) if size.isdigit() else None


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each block: its bytes, and its candidates' offsets with the way each leaves the block.

    A candidate's offset is that of its piece, behind the magic.
    """
    now, at, offs, succ = None, 0, [], []

    def row():
        place = {o: i for i, o in enumerate(offs)}
        out = list(succ)
        for i in range(len(offs) - 1, -1, -1):  # successors lie behind, so they are contracted already
            if succ[i] < at:
                out[i] = out[place[succ[i]]] if succ[i] in place else -1
        return pd.DataFrame({"file": [now[0]], "block": [now[1]], "total": [at], "offs": [np.array(offs, "int64")], "outs": [np.array(out, "int64")]})

    for batch in batches:
        for file, block, value in zip(batch["file"].tolist(), batch["block"].tolist(), batch["value"].tolist(), strict=True):
            if (file, block) != now:
                if now:
                    yield row()
                now, at, offs, succ = (file, block), 0, [], []
            value = bytes(value)
            if head := _head(value):
                offs.append(at)
                succ.append(at + head[1] + head[2] + len(SEP) + len(MAGIC))
            at += len(value) + len(MAGIC)
    if now:
        yield row()


def _jumped(nodes: DataFrame, longest: int) -> DataFrame:
    """file, off: the candidates reached from each file's first record, by pointer doubling over (file, off, out)."""
    jump, reached = nodes.select("file", "off", "out"), nodes.where(F.col("off") == len(MAGIC)).select("file", "off")
    made = []
    hops = 1
    while hops < longest:
        step = reached.join(jump, ["file", "off"]).select("file", F.col("out").alias("off"))
        reached = reached.unionByName(step.join(nodes.select("file", "off"), ["file", "off"], "left_semi")).distinct()
        jump = jump.select("file", "off", F.col("out").alias("_mid")).join(jump.select("file", F.col("off").alias("_mid"), "out"), ["file", "_mid"]).select("file", "off", "out")
        hops *= 2
        if hops < longest:
            (jump, a), (reached, b) = written(jump, "jump"), written(reached, "reached")
            made += [a, b]
    return reached


def _walked(batches: Iterator[pd.DataFrame], complete: bool) -> Iterator[pd.DataFrame]:
    """Records of each block from its entry on: those that end in it if complete, else the parts of those that don't."""
    columns = [c.split()[0] for c in RECORD.split(", ")]
    now, rows, held = None, [], 0
    at = base = entry = 0
    record: tuple | None = None
    need = 0
    parts: list[bytes] = []

    def emit(whole: bool):
        nonlocal record, parts, held
        if whole == complete:
            payload = b"".join(parts)
            rows.append((now[0], *record, payload[: record[1]], whole, now[1], record[0]))
            held += len(payload)
        record, parts = None, []

    def frame():
        return pd.DataFrame(rows, columns=columns).astype({k: "Int64" for k in ("offset", "length", "page_id", "refers_to", "declared_bytes", "block", "at")})

    def number(x: bytes) -> int | None:
        found = re.search(rb"-?\d+", x)
        return int(found[0]) if found else None

    for batch in batches:
        for file, block, value, b, e in zip(batch["file"].tolist(), batch["block"].tolist(), batch["value"].tolist(), batch["base"].tolist(), batch["entry"].tolist(), strict=True):
            if (file, block) != now:
                if record:
                    emit(False)
                now, at, base, entry = (file, block), 0, int(b), -1 if e is None or pd.isna(e) else int(e)
                expected = entry
            value = bytes(value)
            start, at = at, at + len(value) + len(MAGIC)
            if record is None and start == expected:
                f, size, length = _head(value)
                text = lambda k, f=f: f.get(k, b"").decode("utf-8", "replace")
                record = (base + start - len(MAGIC), length, number(f.get(b"x-page-id", b"")), text(b"warc-type"), number(f.get(b"x-refers-to-page-id", b"")), number(f.get(b"x-payload-length", b"")), text(b"warc-payload-digest").removeprefix("sha256:"), text(b"warc-target-uri"))
                need, value = length + len(SEP), value[size:]
                expected = start + size + need + len(MAGIC)
            elif record is None:
                if not complete and (entry < 0 or start < entry):  # of a record that begins in an earlier block
                    rows.append((now[0], *[None] * 8, value + MAGIC, False, now[1], base + start))
                    held += len(value)
                continue
            piece = (value + MAGIC)[:need]
            parts.append(piece)
            need -= len(piece)
            if not need:
                emit(True)
            if held > 8_000_000 or len(rows) > 5_000:
                yield frame()
                rows, held = [], 0
        if rows:
            yield frame()
            rows, held = [], 0
    if record:
        emit(False)
    if rows:
        yield frame()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, page_id, record_type, refers_to, declared_bytes, declared_digest, target, payload of each record.

    Records of versions 1.0 and 1.1 are those reachable from the first of each file, whatever their payloads hold. A
    record that a file's end cuts off has the payload that is there. Archives compressed by record (names that end
    in .gz) are read as one block each, and offsets are those of what they hold. Page ids are null in archives of others.
    """
    blocks, _ = written(_pieces(spark, path).mapInPandas(_candidates, "file string, block long, total long, offs array<long>, outs array<long>"), "blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    based = blocks.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0)))
    nodes, nodes_at = written(based.select("file", "block", "base", F.explode(F.arrays_zip("offs", "outs")).alias("z")).select("file", "block", "base", (F.col("base") + F.col("z.offs")).alias("off"), F.when(F.col("z.outs") >= 0, F.col("base") + F.col("z.outs")).otherwise(-1).alias("out")), "candidates")
    most = blocks.groupBy("file").count().agg(F.max("count")).first()[0] or 1
    reached = _jumped(nodes, most + 1)
    entries = nodes.join(reached, ["file", "off"], "left_semi").groupBy("file", "block").agg(F.min(F.col("off") - F.col("base")).alias("entry"))
    entries, _ = written(based.select("file", "block", "base").join(entries, ["file", "block"], "left"), "entries")
    drop_path(spark, nodes_at)
    few = entries.count() <= BROADCAST_ROWS
    pieces = _pieces(spark, path)
    if few:
        ready = pieces.join(F.broadcast(entries), ["file", "block"])
    else:  # in order again after the shuffle
        ready = pieces.withColumn("_n", F.monotonically_increasing_id()).join(entries, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "_n")
    ready = ready.select("file", "block", "value", "base", "entry")
    # two walks instead of a stored copy of all payloads: the second gives the few parts that cross a block's end
    whole, cut = (ready.mapInPandas(lambda batches, c=c: _walked(batches, c), RECORD) for c in (True, False))
    fields = ["page_id", "record_type", "refers_to", "declared_bytes", "declared_digest", "target"]
    whole = whole.select("file", "offset", *fields, "payload")
    last = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("offset", F.last("offset", ignorenulls=True).over(last))
    parts = cut.where("offset is not null").groupBy("file", "offset").agg(F.max("length").alias("length"), *[F.max(f).alias(f) for f in fields], F.array_sort(F.collect_list(F.struct("at", "payload"))).alias("_p"))
    joined = F.substring(F.aggregate("_p", F.lit(b""), lambda a, p: F.concat(a, p["payload"])), F.lit(1), F.col("length").cast("int")).alias("payload")
    return whole.unionByName(parts.select("file", "offset", *fields, joined))


def round_trip(pages: DataFrame, path: str, least: int = LEAST) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from archives of pages.

    Digest and size of a response are those of the payload that was read; a revisit holds its own in its
    header. No pages give no rows.
    """
    write_archives(pages, path, least)
    if not pages.sparkSession.read.format("binaryFile").load(path).where("length > 0").select("path").take(1):
        return pages.sparkSession.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    rows = read_archives(pages.sparkSession, path)
    full = F.col("record_type") == "response"
    return rows.select("page_id", F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("declared_bytes")).alias("payload_bytes"), F.when(full, F.sha2("payload", 256)).otherwise(F.col("declared_digest")).alias("payload_digest"), "record_type", "refers_to")
