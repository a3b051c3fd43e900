"""SimHash near-dedup with the pigeonring filter.

A fingerprint is cut into SEGMENTS on a ring. If two differ in at most REACH bits, then from some segment on
every chain of l consecutive segments differs in at most l * REACH / SEGMENTS bits. A chain of six segments
so allows two bits: its first two segments agree, at most one of the next two and at most two of the last
four differ. Each fingerprint is keyed by every start and every choice of the segments that may differ; what
shares a key is checked for the chain of every length, then for the full distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ledgerloom.llm.common import as_texts, connected_components, drop_path, mixed, slices, written

REACH, SEGMENTS, CHAIN, SHINGLE, SEED = 4, 9, 6, 4, 42
#: Fingerprints of one key that are compared at once; larger sets are dealt out by further bits.
BLOCK = 4_096

_BATCH = 1_000_000
_WIDTHS = [7] * 8 + [8]
_MASKS = [np.uint64(((1 << w) - 1) << sum(_WIDTHS[:i])) for i, w in enumerate(_WIDTHS)]


def _allowed(length: int) -> int:
    return length * REACH // SEGMENTS


def _wild() -> list[tuple[int, ...]]:
    """Largest sets of places in a chain whose segments may differ."""
    sets = [s for n in range(_allowed(CHAIN) + 1) for s in combinations(range(CHAIN), n) if all(sum(p < k for p in s) <= _allowed(k) for k in range(1, CHAIN + 1))]
    return [s for s in sets if not any(set(s) < set(t) for t in sets)]


#: (start, mask of the bits that must agree) for each kind of key.
KEYS = [(i, np.bitwise_or.reduce([_MASKS[(i + p) % SEGMENTS] for p in range(CHAIN) if p not in w])) for i, w in product(range(SEGMENTS), _wild())]


def fingerprints(texts: list[str]) -> np.ndarray:
    """The uint64 fingerprint of each text."""
    counts, hashes = [], []
    h = xxhash.xxh64_intdigest
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        n = len(words) - SHINGLE + 1
        if not words:
            counts.append(0)
        elif n <= 1:
            counts.append(1)
            hashes.append(h(b" ".join(words), SEED))
        else:
            joined = b" ".join(words)
            size = np.fromiter(map(len, words), np.int64, len(words)) + 1
            start = np.concatenate([[0], np.cumsum(size)])
            counts.append(n)
            hashes += [h(joined[a:b], SEED) for a, b in zip(start[:n].tolist(), (start[SHINGLE:] - 1).tolist(), strict=True)]
    counts = np.array(counts, dtype=np.int64)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if some.size:
        all_hashes = np.array(hashes, dtype="<u8")
        starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
        sums = np.zeros((some.size, 64), np.int64)
        for bit in range(64):
            sums[:, bit] = np.add.reduceat((all_hashes >> np.uint64(bit)) & np.uint64(1), starts).astype(np.int64)
        ones = 2 * sums > counts[some][:, None]
        out[some] = np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel()
    return out


@F.pandas_udf(LongType())
def fingerprint(text: pd.Series) -> pd.Series:
    texts = as_texts(text)
    parts = [fingerprints(texts[s]) for s in slices([len(t) for t in texts], _BATCH)]
    return pd.Series(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64))


def chained(x: np.ndarray, start: int) -> np.ndarray:
    """Which differences x keep within the budget of every chain from start."""
    total, ok = np.zeros(x.shape, np.uint8), np.ones(x.shape, bool)
    for k in range(SEGMENTS):
        total = total + np.bitwise_count(x & _MASKS[(start + k) % SEGMENTS])
        ok &= total <= _allowed(k + 1)
    return ok


def linked(x: np.ndarray, start: int) -> np.ndarray:
    """The chain first, which prunes; then the full distance."""
    ok = chained(x, start)
    ok[ok] = np.bitwise_count(x[ok]) <= REACH
    return ok


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 20_000):
            fp = batch["fp"].to_numpy()[at : at + 20_000].view(np.uint64)
            for k, (_, mask) in enumerate(KEYS):
                yield pd.DataFrame({"key": (mixed(fp & mask) & ~np.uint64(63) | np.uint64(k)).view(np.int64), "agreed": np.int64(0), "fp": fp.view(np.int64)})


def _spanning(nodes: np.ndarray, start: int | None) -> list[tuple[int, int]]:
    """Links that join the same members as all links do; without a start by the distance alone."""
    left = np.ones(len(nodes), bool)
    out = []
    while left.any():
        root = int(np.argmax(left))
        left[root] = False
        front = [root]
        while front:
            at = front.pop()
            others = np.flatnonzero(left)
            x = nodes[others] ^ nodes[at]
            near = others[np.bitwise_count(x) <= REACH if start is None else linked(x, start)]
            left[near] = False
            out += [(at, int(j)) for j in near]
            front += near.tolist()
    return out


def pieces(agreed: int) -> list[np.uint64]:
    """The bits that are not agreed, cut into one piece more than may differ: linked fingerprints agree on one of them."""
    free = [b for b in range(64) if not agreed >> b & 1]
    return [np.uint64(sum(1 << b for b in free[i :: REACH + 1])) for i in range(REACH + 1)]


_LINKS = "a long, b long, key long, agreed long, fp long"


def _compared(block: int):
    """Rows sorted by key and fp to links (a, b). What has a key in common with more than block others goes on instead,
    under a key for each piece of the bits that this key does not fix (key, agreed, fp)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, hot = None, [], False
        a: list[int] = []
        b: list[int] = []

        def again(fp: np.ndarray) -> Iterator[pd.DataFrame]:
            key, agreed = now
            mask = np.uint64(agreed & 0xFFFFFFFFFFFFFFFF) if agreed else KEYS[key & 63][1]
            for i, piece in enumerate(pieces(int(mask))):
                new = mixed(np.full(fp.size, np.uint64(key & 0xFFFFFFFFFFFFFFFF)) ^ mixed((fp & piece) + np.uint64(i + 1)))
                rows = pd.DataFrame({"key": new.view(np.int64), "agreed": np.array(mask | piece, np.uint64).view(np.int64), "fp": fp.view(np.int64)})
                yield rows.assign(a=None, b=None)[["a", "b", "key", "agreed", "fp"]].astype({"a": "Int64", "b": "Int64"})

        def finish() -> Iterator[pd.DataFrame]:
            nonlocal held
            fp = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held = []
            if hot and fp.size:
                yield from again(fp)
            elif fp.size > 1:
                nodes = fp.view(np.int64)
                for i, j in _spanning(fp, None if now[1] else KEYS[now[0] & 63][0]):
                    a.append(int(nodes[i]))
                    b.append(int(nodes[j]))

        def frame() -> pd.DataFrame:
            out = pd.DataFrame({"a": a, "b": b}, dtype="Int64").assign(key=None, agreed=None, fp=None).astype({"key": "Int64", "agreed": "Int64", "fp": "Int64"})
            a.clear()
            b.clear()
            return out

        for batch in batches:
            key, agreed, fp = batch["key"].to_numpy(), batch["agreed"].to_numpy(), batch["fp"].to_numpy().view(np.uint64)
            if not len(key):
                continue
            edge = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (agreed[1:] != agreed[:-1])) + 1, [len(key)]])
            size = np.diff(edge)
            # sets of one are passed over, but for those at the ends, which may go on in other batches
            for i in np.flatnonzero((size > 1) | (np.arange(size.size) == 0) | (np.arange(size.size) == size.size - 1)).tolist():
                this, part = (int(key[edge[i]]), int(agreed[edge[i]])), fp[edge[i] : edge[i + 1]]
                if this != now:
                    yield from finish()
                    now, hot = this, False
                held.append(part.copy())
                hot = hot or sum(map(len, held)) > block
                if hot and sum(map(len, held)) > 20_000:
                    yield from finish()
            if len(a) > 100_000:
                yield frame()
        yield from finish()
        if a:
            yield frame()

    return run


def links(prints: DataFrame, block: int | None = None) -> DataFrame:
    """a, b: links between distinct fingerprints (fp) that join the same groups as all links do.

    A set with one key is spanned in its task, not written out as all its pairs. A set larger than block is dealt out
    again, by pieces of what its key leaves open, until sets are small: after some rounds a key fixes all but a few bits
    (block must be 16 or more: sets that a key leaves four bits are never larger).
    """
    rows, found = prints.select("fp").mapInPandas(_keyed, "key long, agreed long, fp long"), None
    while True:
        table, _ = written(rows.repartition("key").sortWithinPartitions("key", "agreed", "fp").mapInPandas(_compared(block or BLOCK), _LINKS), "links")
        new = table.where("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        found = new if found is None else found.unionByName(new)
        rows = table.where("a is null").select("key", "agreed", "fp").distinct()
        if not rows.take(1):
            return found.distinct()  # a link may be found under several keys


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every document.

    Words are those of the text with A-Z lower-cased; fewer than four are one shingle, none (or null) is
    fingerprint zero, which links like any other. component_id is the least id reachable (nulls only if no
    id is). Repeated rows and null ids get a row each; other columns are ignored. No rows give no rows.
    """
    rows, _ = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint(F.col("text")).alias("fp")), "prints")
    prints, prints_at = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = connected_components(links(prints)).withColumnRenamed("node", "fp")
    placed = prints.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    placed, placed_at = written(placed, "placed")
    # written first: adaptive execution splits a join by a common root only if neither side is aggregated in its stage
    least, least_at = written(placed.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    table, _ = written(placed.join(least, "root").select("fp", "component_id"), "classes")
    for path in (prints_at, placed_at, least_at):
        drop_path(docs.sparkSession, path)
    # a fingerprint may be that of a third of all rows: adaptive execution splits this join
    return rows.join(table, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents whose id is their component's, once each, and those without an id; columns as they were."""
    stay = near_duplicates(docs).where("doc_id = component_id").select(F.col("doc_id").alias("_stays")).distinct()
    names = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), docs["doc_id"].cast("long").alias("_id"))
    with_id = rows.where("_id is not null").join(stay, F.col("_id") == F.col("_stays"), "left_semi")
    return with_id.dropDuplicates(["_id"]).select("_row.*").unionByName(rows.where("_id is null").select("_row.*"))
