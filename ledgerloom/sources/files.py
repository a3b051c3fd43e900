"""Files to blocks: text and word-processor sources, rejects with reasons, playbooks and prices."""

from __future__ import annotations

import io
import json
import re
import time
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as T

BLOCKS = "path string, kind string, block_index int, text string, page int, method string, error string"
#: Files beyond this size are refused unread (a fixed value).
LARGEST = 64 * 1024 * 1024
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

_readers: dict[str, Callable[[bytes], list[tuple[str, int | None, str]]]] = {}


def paragraphs(text: str) -> list[str]:
    return [re.sub(r"\n\s*\n+", "\n", p).strip() for p in re.split(r"\n\s*\n", text) if p.strip()]


def read_txt(data: bytes) -> list[tuple[str, int | None, str]]:
    """Strict UTF-8; a file without text is an error."""
    found = [(p, None, "txt") for p in paragraphs(data.decode("utf-8"))]
    if not found:
        raise ValueError("file contains no text")
    return found


def read_docx(data: bytes) -> list[tuple[str, int | None, str]]:
    """Paragraphs, then table rows with cells joined by ' | '."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_WORD}t"))
    found = [text(p).strip() for p in body.findall(f"{_WORD}p")]
    for row in body.iter(f"{_WORD}tr"):
        found.append(" | ".join(text(c).strip() for c in row.findall(f"{_WORD}tc")))
    found = [(x, None, "docx") for x in found if x.strip(" |")]
    if not found:
        raise ValueError("file contains no text")
    return found


def register_reader(kind: str, reader: Callable[[bytes], list[tuple[str, int | None, str]]]) -> None:
    """Add a reader for a kind that needs a library of its own, such as pdf or a page reader."""
    _readers[kind] = reader


_readers |= {"txt": read_txt, "docx": read_docx}


def blocks_of(files: DataFrame, largest: int = LARGEST) -> DataFrame:
    """Blocks of files (path, length, content, and maybe mime); a file that can't be read whole gives one row with
    its error, and no block of it."""
    mime = F.col("mime") if "mime" in files.columns else F.lit(None).cast("string")
    name = F.substring_index("path", "/", -1)
    rows = files.select("path", T.kind_of(name, mime).alias("kind"), "length", F.when(F.col("length") <= largest, F.col("content")).alias("content"))
    readers = dict(_readers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, kind, length, content in batch.itertuples(index=False, name=None):
                try:
                    if content is None:
                        raise ValueError(f"file of {length} bytes is too large")
                    if not len(content):
                        raise ValueError("uploaded file is empty")
                    if kind is None:
                        raise ValueError("unsupported document type")
                    if kind not in readers:
                        raise ValueError(f"no reader for {kind} is installed")
                    out += [(path, kind, i, t, p, m, None) for i, (t, p, m) in enumerate(readers[kind](bytes(content)))]
                except Exception as e:  # one file's failure must not stop the others
                    out.append((path, kind, None, None, None, None, str(e)[:300]))
            yield pd.DataFrame(out, columns=["path", "kind", "block_index", "text", "page", "method", "error"]).astype({"block_index": "Int32", "page": "Int32"})

    return rows.mapInPandas(run, BLOCKS)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return blocks_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content"))


def text_of(blocks: DataFrame) -> DataFrame:
    """path, text: a document's blocks in order, apart by blank lines."""
    good = blocks.where("error is null")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block_index", "text"))), lambda b: b["text"])
    return good.groupBy("path").agg(F.array_join(parts, "\n\n").alias("text"), F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"))


def price_table(spark: SparkSession, text: str) -> DataFrame:
    """model, price_in, price_out, version of a price list in JSON; malformed is an error."""
    data = json.loads(text)
    rows = [(m, float(p["input_per_million_usd"]), float(p["output_per_million_usd"]), str(data["version"])) for m, p in data["models"].items()]
    return spark.createDataFrame(rows, "model string, price_in double, price_out double, version string")


def columns_of(boxes: DataFrame, gap: float = 20.0, least: int = 4) -> DataFrame:
    """Left edges of each page's text columns from boxes (page, x0, x1): a column begins where no box before reaches.

    A running maximum over the sorted boxes; fewer than `least` boxes are one column.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy("page").orderBy("x0", "x1")
    before = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    n = F.count("*").over(Window.partitionBy("page"))
    rows = boxes.select("page", "x0", before.alias("reach"), n.alias("n"))
    return rows.groupBy("page").agg(F.when(F.max("n") < least, F.array(F.lit(0.0))).otherwise(F.array_sort(F.collect_list(F.when(F.col("reach").isNull() | (F.col("x0") > F.col("reach") + gap), F.col("x0"))))).alias("columns"))


def image_coverage(boxes: DataFrame) -> DataFrame:
    """path, page, image_share of pages from their boxes (path, page, kind, x0, y0, x1, y1, page_area): the area of image
    boxes in that of the page, 1 at most; a page without area has none."""
    area = F.when(F.col("kind") == "image", F.abs((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))).otherwise(0.0)
    rows = boxes.groupBy("path", "page").agg(F.sum(area).alias("covered"), F.max("page_area").alias("page_area"))
    return rows.select("path", "page", F.when(F.abs("page_area") > 0, F.least(F.col("covered") / F.abs("page_area"), F.lit(1.0))).otherwise(0.0).alias("image_share"))


PAGE = "path string, page int, text string, method string, error string, model string, tokens_in long, tokens_out long, duration_ms long"


def read_pages(pages: DataFrame, reader: Callable[[bytes, int], tuple[str, dict]] | None = None) -> DataFrame:
    """Pages (path, page, text, image_share, has_table, image) as PAGE: a page whose text cannot be trusted is read from
    its image by the reader, a function of the image and page number to a text and its usage; without one, or if that is
    no better, the page has an error. What each call used is kept beside the page."""
    rows = pages.select("path", "page", "text", "image", T.quality_reason(F.coalesce("text", F.lit("")), F.col("image_share"), F.col("has_table")).alias("problem"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, page, text, image, problem in batch.itertuples(index=False, name=None):
                if problem is None:
                    out.append((path, page, text, "native", None, None, 0, 0, 0))
                    continue
                if reader is None:
                    out.append((path, page, None, None, f"{problem}; no page reader is installed", None, 0, 0, 0))
                    continue
                began = time.perf_counter()
                try:
                    read, used = reader(bytes(image) if image is not None else b"", int(page))
                    error = None if sum(c.isalnum() for c in read) >= T.LEAST_ALNUM else f"{problem}; the page reader found nothing legible"
                except Exception as e:  # a page's failure is its own
                    read, used, error = None, {}, f"{problem}; the page reader failed: {e}"[:300]
                out.append((path, page, None if error else read, None if error else "ocr", error, used.get("model", "unknown"), used.get("tokens_in", 0), used.get("tokens_out", 0), int((time.perf_counter() - began) * 1000)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PAGE.split(", ")])

    return rows.mapInPandas(run, PAGE)


def page_events(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """What page readers used, as events of the run (path, run_id) that the file became."""
    rows = pages.where("model is not null").join(runs.select("path", "run_id"), "path")
    reason = F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(" read by "), "model")
    return rows.select("run_id", F.lit("ingest").alias("stage"), F.lit("external_call").alias("decision"), reason.alias("reason"), "duration_ms", "tokens_in", "tokens_out", "model", F.lit("ocr").alias("external_service"))


def runs_of(files: DataFrame, collection: str, started_at) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, blocks, refused) of files (path, length, content): the one way from bytes to a run. A file becomes a run with
    all its blocks, or is refused with its error and becomes none. The id is that of collection and content."""
    from ledgerloom.functions import hashing

    read = blocks_of(files)
    refused = read.where("error is not null").select("path", "error")
    blocks = read.where("error is null").drop("error")
    key = F.concat(F.lit(f"{collection}:"), F.sha2("content", 256))
    named = files.select("path", hashing.name_uuid(key).alias("run_id"), F.sha2("content", 256).alias("sha"))
    runs = blocks.groupBy("path").agg(F.count("*").alias("n_blocks")).join(named, "path")
    return runs.select("run_id", F.lit(collection).alias("collection"), "path", "sha", "n_blocks", F.lit("running").alias("status"), F.lit(started_at).alias("started_at")), blocks, refused
