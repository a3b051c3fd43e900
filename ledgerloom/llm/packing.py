"""Token ids packed into rows of one length: best fit decreasing, with a segment tree over free space."""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import as_texts

#: Where the rank file of the vocabulary lies by default; it is read, never copied.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before the merges of that vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The id that ends each document and fills rows: free in that vocabulary.
END = 50_256
ROW = 2_048
#: Documents of a task are packed in windows of about so many ids, so its memory is bounded.
WINDOW = 2_000_000
SCHEMA = "pack_id string, n_tokens int, n_segments int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_offsets array<long>"

#: Texts longer than so many characters are encoded in pieces, cut before a blank between two words.
PIECE = 1_000_000
_CUT = re.compile(r"\S (?=\S)")


class Encoder:
    """Bytes of little-endian 16- or 32-bit ids for a text."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.code = "H" if max(table.values()) < 65_535 else "I"
        self.width = np.dtype("<u2" if self.code == "H" else "<u4")
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> bytes:
        out = array(self.code, self.encoding.encode_ordinary(text))
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def parts(self, text: str, piece: int = PIECE) -> Iterator[bytes]:
        """The ids of a text in order, by pieces of about so many characters."""
        at = 0
        while len(text) - at > piece and (cut := _CUT.search(text, at + piece)):
            yield self.ids(text[at : cut.start() + 1])
            at = cut.start() + 1
        yield self.ids(text[at:])


_encoders: dict[tuple[int, str], Encoder] = {}


class FreeSpace:
    """Open rows by their free space: a segment tree of counts gives the least space that fits."""

    def __init__(self, row: int):
        self.size = 1 << row.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(row + 1)]

    def add(self, space: int, row: int) -> None:
        self.rows[space].append(row)
        i = space + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(space, row) of the fullest row with room for need, no more an open one."""
        i, count = need + self.size, self.count
        while not count[i]:
            while i & 1:  # right children have nothing further right below their parent
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.size:
            i <<= 1
            if not count[i]:
                i += 1
        space = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return space, self.rows[space].pop()


def best_fit(lengths: list[int], row: int) -> list[list[int]]:
    """Indices of lengths (1 to row each) by row, placed from the longest to the shortest, ties in order."""
    out: list[list[int]] = []
    free = FreeSpace(row)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = free.take(lengths[i])
        space, at = found or (row, len(out))
        if found is None:
            out.append([])
        out[at].append(i)
        if space > lengths[i]:
            free.add(space - lengths[i], at)
    return out


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, end: int = END, row: int = ROW, window: int = WINDOW) -> DataFrame:
    """Rows of ids of every document: see SCHEMA.

    input_ids holds row ids, little-endian (16 bits if the vocabulary allows), filled up with end;
    cu_seqlens the bounds of its segments, position_resets where positions begin at 0 again, doc_ids and
    doc_offsets the document of each segment and the segment's first id in it. Every document ends with
    end, so a null or empty one is that id alone; one longer than a row is split and loses nothing.
    Repeated rows and null ids are packed like others. Tasks pack what they read, without a shuffle. Long texts are
    encoded in pieces and leave a task row by row, so a task holds a text, its window and little more.
    """
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())  # of one vocabulary's size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoders.setdefault((hash(ranks.value), pattern), None) or Encoder(ranks.value, pattern)
        _encoders[hash(ranks.value), pattern] = encoder
        width, part, turn = encoder.width, TaskContext.get().partitionId(), 0
        fill = np.array([end], dtype=width).tobytes()
        step = row * width.itemsize
        segments: list[tuple] = []
        held = 0

        def flush() -> pd.DataFrame:
            nonlocal segments, held, turn
            rows = []
            for k, members in enumerate(best_fit([len(s[2]) // width.itemsize for s in segments], row)):
                parts = [segments[i] for i in members]
                bounds = np.cumsum([0, *(len(p[2]) // width.itemsize for p in parts)]).astype("int32")
                rows.append((f"{part}-{turn}-{k}", int(bounds[-1]), len(parts), b"".join(p[2] for p in parts) + fill * (row - int(bounds[-1])), bounds, bounds[:-1], [p[0] for p in parts], [p[1] for p in parts]))
            segments, held, turn = [], 0, turn + 1
            return pd.DataFrame(rows, columns=["pack_id", "n_tokens", "n_segments", "input_ids", "cu_seqlens", "position_resets", "doc_ids", "doc_offsets"])

        for batch in batches:
            for doc_id, text in zip(batch["_id"].tolist(), as_texts(batch["text"]), strict=True):
                doc = None if doc_id is None else int(doc_id)
                rest, start = b"", 0
                for ids in chain(encoder.parts(text), (fill,)):
                    rest += ids
                    whole = len(rest) // step * step
                    segments += [(doc, (start + at) // width.itemsize, rest[at : at + step]) for at in range(0, whole, step)]
                    held += whole // width.itemsize
                    rest, start = rest[whole:], start + whole
                    if held >= window:
                        yield flush()
                if rest:
                    segments.append((doc, start // width.itemsize, rest))
                    held += len(rest) // width.itemsize
                    if held >= window:
                        yield flush()
        if segments:
            yield flush()

    return docs.select(docs["doc_id"].cast("string").alias("_id"), docs["text"].alias("text")).mapInPandas(run, SCHEMA)


MATRIX = "matrix_id string, n_rows int, n_tokens long, input_ids binary, cu_seqlens array<long>, position_resets array<long>, doc_ids array<long>, doc_offsets array<long>"


def matrices(packed: DataFrame, rows: int = 512, row: int = ROW) -> DataFrame:
    """Rows of pack as id matrices of at most so many rows: see MATRIX; a task's rows stay together, without a shuffle.

    input_ids is the matrix by rows. cu_seqlens has the bounds of all segments in it, where what fills a row up is a
    segment of its own, so they cover the matrix; position_resets is where positions begin at 0 again. doc_ids and
    doc_offsets have null for what fills up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, turn = TaskContext.get().partitionId(), 0
        held: list[dict] = []

        def flush() -> pa.RecordBatch:
            nonlocal held, turn
            bounds, docs, offsets = [0], [], []
            for k, r in enumerate(held):
                bounds += [k * row + n for n in r["cu_seqlens"][1:]]
                docs += r["doc_ids"]
                offsets += r["doc_offsets"]
                if bounds[-1] < (k + 1) * row:
                    bounds.append((k + 1) * row)
                    docs.append(None)
                    offsets.append(None)
            out = {
                "matrix_id": f"{part}-{turn}",
                "n_rows": len(held),
                "n_tokens": sum(r["n_tokens"] for r in held),
                "input_ids": b"".join(r["input_ids"] for r in held),
                "cu_seqlens": bounds,
                "position_resets": bounds[:-1],
                "doc_ids": docs,
                "doc_offsets": offsets,
            }
            held, turn = [], turn + 1
            return pa.RecordBatch.from_pylist([out], schema)

        for batch in batches:
            for r in batch.to_pylist():
                held.append(r)
                if len(held) == rows:
                    yield flush()
        if held:
            yield flush()

    longs = pa.list_(pa.int64())
    schema = pa.schema({"matrix_id": pa.string(), "n_rows": pa.int32(), "n_tokens": pa.int64(), "input_ids": pa.binary(), "cu_seqlens": longs, "position_resets": longs, "doc_ids": longs, "doc_offsets": longs})
    return packed.select("input_ids", "n_tokens", "cu_seqlens", "doc_ids", "doc_offsets").mapInArrow(run, MATRIX)


def fill_rate(packed: DataFrame, row: int = ROW) -> DataFrame:
    """n_rows, n_tokens and fill, the share of all places that hold a document's ids (null without rows)."""
    return packed.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("long").alias("n_tokens")).withColumn("fill", F.when(F.col("n_rows") > 0, F.col("n_tokens") / (F.col("n_rows") * row)))
