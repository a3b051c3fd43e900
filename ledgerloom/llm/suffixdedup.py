"""Exact substring dedup by merging the Burrows-Wheeler transforms of shards.

1. Each text is cut into runs of windows of LEAST bytes that have the same least k-mer hash (minimiser). Equal
   windows have equal minimisers, so only runs whose minimiser is also in another document can repeat.
2. Documents are dealt into groups. A group's different strings of one bucket of minimisers are a shard: its
   suffixes are sorted once, where its texts are, and only its transform and the least doc_id of each string travel.
3. Where a bucket's shards meet, their transforms alone are merged. A transform says what stands before each of its
   suffixes and where that longer suffix lies, so an interleave of all shards by h symbols becomes one by h + 2 k by
   a stable distribution on the k pairs of symbols before; suffixes are not sorted again. Neighbours that a round leaves
   in one block have a common prefix of h + 2 k; the intervals that are left at LEAST symbols are the repeated windows.
4. An interval's least doc_id goes back to the shards, whose documents lose what a smaller one has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import as_texts, mixed, slices

#: Bytes of a repeated string, and of the k-mers that minimisers are the least of.
LEAST, KMER = 50, 20
#: Windows of a run at most; a longer one of a text that repeats itself is several.
LONGEST = 256
#: Text bytes for each group of documents and each bucket of minimisers: this bounds what a task holds.
GROUP_BYTES = 16_000_000
#: Parts of a bucket, merged one by one.
PARTS = 16
#: Minimisers with more bytes of strings than this are split: their windows are dealt one by one, by their own hash.
HOT_BYTES = 4_000_000

_CHUNK, _SORTED = 62_500, 400_000
#: Pairs of symbols that a round of the merge takes at most.
_PAIRS = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    """Powers of the base of string hashes, and of its inverse."""
    if not _powers:
        n = _CHUNK + LEAST
        for base in (int(_ODD), pow(int(_ODD), -1, 1 << 64)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _powers.append(np.cumprod(table))
    return _powers


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Minimiser hash, text index, first window, count of windows and string hash of each run of equal minimisers.

    Texts longer than a chunk are cut into overlapping pieces, so arrays stay small whatever a text's length.
    """
    pieces = [(k, a) for k, t in enumerate(texts) for a in range(0, len(t) - LEAST + 1, _CHUNK)]
    parts = [(np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64))]
    for s in slices([min(len(texts[k]) - a, _CHUNK + LEAST - 1) for k, a in pieces], _CHUNK):
        own = pieces[s]
        h, piece, at, count, string = _runs([texts[k][a : a + _CHUNK + LEAST - 1] for k, a in own])
        k, a = np.array(own, np.int64).T
        parts.append((h, k[piece], at + a[piece], count, string))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.cumsum(size) - size
    code = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)
    n, top, h = 1, 1 << 64, code
    grown: list[tuple[np.ndarray, int]] = [(h, 1)]
    while 2 * n <= KMER:  # polynomials over windows of n bytes: n doubles, then what is missing is added
        h = h[:-n] * np.uint64(pow(int(_ODD), n, top)) + h[n:]
        n *= 2
        grown.append((h, n))
    rest = KMER - n
    for part, size_of in reversed(grown):
        if size_of <= rest:
            h = h[: h.size - size_of] * np.uint64(pow(int(_ODD), size_of, top)) + part[n : n + h.size - size_of]
            n, rest = n + size_of, rest - size_of
    least, n = mixed(h), 1
    width = LEAST - KMER + 1
    while n < width:
        step = min(n, width - n)
        least = np.minimum(least[: least.size - step], least[step:])
        n += step
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    at = np.flatnonzero(owner[: least.size] == owner[LEAST - 1 :])
    least = least[at]
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (np.diff(at) != 1)])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, at.size))
    if count.max() > LONGEST:
        new[(np.arange(at.size) - np.repeat(first, count)) % LONGEST == 0] = True
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, at.size))
    power, inverse = _power_tables()
    total = np.concatenate([[np.uint64(0)], np.cumsum(code * power[: code.size])])
    a = at[first]
    string = mixed((total[a + count + LEAST - 1] - total[a]) * inverse[a])
    return least[first], owner[a].astype(np.int64), a - start[owner[a]], count, string


def _window_hashes(data: bytes) -> np.ndarray:
    power, inverse = _power_tables()
    total = np.concatenate([[np.uint64(0)], np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * power[: len(data)])])
    return mixed((total[LEAST:] - total[:-LEAST]) * inverse[: len(data) - LEAST + 1])


def _numbered(pair: np.ndarray) -> tuple[np.ndarray, int]:
    """16-bit values as numbers in their order without gaps, and the bits these take."""
    there = np.bincount(pair, minlength=1 << 16) > 0
    number = np.cumsum(there, dtype=np.uint64)
    return (number - np.uint64(1))[pair], int(number[-1] - np.uint64(1)).bit_length()


def _ordered(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of keys of so many bits, and the keys in it. Sorting values is several times faster than sorting
    places by them, so a place goes below its key where both fit in 64 bits."""
    low = max(1, key.size - 1).bit_length()
    if bits + low > 64:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    key = key << np.uint64(low) | np.arange(key.size, dtype=np.uint64)
    key.sort()
    return (key & np.uint64((1 << low) - 1)).astype(np.int64), key >> np.uint64(low)


def transform(strings: list[bytes], piece: np.ndarray) -> np.ndarray:
    """The transform of the strings of each piece, pieces (ascending) one after the other.

    Symbols are bytes plus one; 0 ends a string, and ends of equal suffixes stand in the order of their strings.
    Suffixes are sorted by eight symbols, or as many of these as fit beside a place, then by doubling among those that
    are still equal.
    """
    size = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
    codes = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8) + np.uint8(1)  # no UTF-8 text has 0xff
    n = codes.size
    at = np.arange(n)
    left = np.repeat(np.cumsum(size) - 1, size) - at
    pair = codes.astype(np.uint16) << np.uint16(8)
    pair[:-1] |= codes[1:]
    pair[left == 0] = 0  # nothing follows an end
    key, bits = _numbered(pair)
    width = 2
    while width < 8 and 2 * bits + n.bit_length() <= 64:
        ahead = np.zeros(n, np.uint64)
        ahead[:-width] = key[width:]
        ahead[left < width] = 0
        key = key << np.uint64(bits) | ahead
        width, bits = 2 * width, 2 * bits
    order, key = _ordered(key, bits)
    new = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    length, half = width, n.bit_length()
    still = order[~(new & np.append(new[1:], True))]
    still = still[left[still] >= length]
    while still.size:
        order, key = _ordered((rank[still] << half | rank[still + length]).view(np.uint64), 2 * half)
        still, key = still[order], key.view(np.int64)
        place = np.arange(still.size)
        new = np.concatenate([[True], key[1:] != key[:-1]])
        block = np.concatenate([[True], key[1:] >> half != key[:-1] >> half])
        rank[still] = (key >> half) + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(block, place, 0))
        length *= 2
        still = still[~(new & np.append(new[1:], True))]
        still = still[left[still] >= length]
    if n < 1 << 24 and piece[-1] - piece[0] < 1 << 15:
        order = np.sort(np.repeat(piece - piece[0], size) << 48 | rank << 24 | at) & ((1 << 24) - 1)
    else:
        order = np.lexsort((at, rank, np.repeat(piece, size)))
    return codes[order - 1]


class Shards:
    """The transforms of several shards: what stands before each suffix, and where the suffix one longer lies."""

    def __init__(self, transforms: list[np.ndarray]):
        size = [t.size for t in transforms]
        self.before = np.concatenate(transforms)
        n = self.before.size
        start = np.cumsum(size) - size
        self.longer = np.empty(n, np.int64)
        for t, at in zip(transforms, start.tolist(), strict=True):
            self.longer[at + np.argsort(t, kind="stable")] = np.arange(at, at + t.size)
        # each string is walked from its end, which stand first in their shard
        ends = np.array([np.count_nonzero(t == 0) for t in transforms], np.int64)
        now = np.repeat(start - (np.cumsum(ends) - ends), ends) + np.arange(ends.sum())
        self.n_strings, who = ends, np.arange(now.size, dtype=np.int32)
        self.string, self.left, self.length = np.empty(n, np.int32), np.empty(n, np.int32), np.zeros(now.size, np.int64)
        step = 0
        while now.size:
            self.string[now], self.left[now] = who, step
            more = self.before[now] > 0
            if not more.all():
                self.length[who[~more]] = step
                now, who = now[more], who[more]
            now = self.longer[now]
            step += 1

    def windows(self, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
        """(places, begins): where windows of `least` (an even number) symbols begin, in the merged order of all shards,
        and whether each is the first of an interval whose windows have all of them in common.

        A round's blocks are the suffixes with h symbols in common; the next round's are derived from these and the
        symbols before, as many pairs of these as fit, numbered in their order, in 64 bits beside a place. Only suffixes
        that lead to a window are carried: those `least` - h symbols behind its start.
        """
        place = np.flatnonzero(self.left <= self.length[self.string] - least)
        begins = np.ones(place.size, bool)
        if not place.size:
            return place, begins
        pair = self.before[self.longer].astype(np.uint16) << np.uint16(8) | self.before
        one, width = _numbered(pair)
        twice = self.longer[self.longer]
        most = max(1, min(least // 2, (64 - place.size.bit_length()) // max(width, 1), _PAIRS))
        rounds, rest = divmod(least // 2, most)
        symbols, longer = one, twice
        steps = {1: (symbols, longer)}
        for k in range(2, most + 1):
            symbols, longer = symbols[twice] << np.uint64(width) | one, longer[twice]
            if k in (most, rest):
                steps[k] = symbols, longer
        block = np.zeros(place.size, np.int32)
        for k in [most] * rounds + [rest] * (rest > 0):
            symbols, longer = steps[k]
            order, key = _ordered(symbols[place], k * width)
            place, block = longer[place[order]], block[order]
            begins[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
            block = np.cumsum(begins, dtype=np.int32)
        return place, begins


def least_of_windows(transforms: list[np.ndarray], docs: list[np.ndarray]) -> list[np.ndarray]:
    """For each shard, the least of the docs of all strings of all shards that have a window: its windows string by string."""
    shards = Shards(transforms)
    own = np.concatenate(docs)
    count = np.maximum(shards.length - LEAST + 1, 0)
    begin = np.cumsum(count) - count
    place, begins = shards.windows()
    string = shards.string[place]
    out = np.empty(place.size, np.int64)
    if place.size:
        first = np.flatnonzero(begins)
        least = np.minimum.reduceat(own[string], first)
        out[begin[string] + shards.length[string] - shards.left[place]] = np.repeat(least, np.diff(np.append(first, place.size)))
    per_shard = np.add.reduceat(np.append(count, 0), np.minimum(np.cumsum(shards.n_strings) - shards.n_strings, count.size)) if len(docs) else []
    return np.split(out, np.cumsum(per_shard)[:-1])


def _pack(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _bytes(x: np.ndarray, kind: str) -> bytes:
    """Packed by byte planes: high bytes that are all alike take no room."""
    return _pack(np.ascontiguousarray(x.astype(kind)).view(np.uint8).reshape(x.size, -1).T.tobytes())


def _array(x: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(_unpack(bytes(x)), np.uint8).reshape(width, -1).T).view(kind).ravel()


def _starts(*sorted_arrays: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins."""
    new = np.zeros(sorted_arrays[0].size, bool)
    new[:1] = True
    for x in sorted_arrays:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _cuts(start: np.ndarray, size: int) -> list[tuple[int, int]]:
    return list(zip(start.tolist(), [*start[1:].tolist(), size], strict=True)) if start.size else []


class _Group:
    """The rows of one group in an order that does not depend on how they came, and their runs by minimiser and string.

    Rows are told apart by their place in it, never by their id, which may repeat.
    """

    def __init__(self, docs: pd.DataFrame, buckets: int):
        ids, hashes, z = docs["id"].tolist(), docs["th"].tolist(), docs["z"].tolist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, int(ids[i] or 0), hashes[i]))
        self.ids = [ids[i] for i in order]
        self.texts = [_unpack(bytes(z[i])) for i in order]
        named = sum(i is not None for i in self.ids)
        self.own = np.array([int(i) for i in self.ids[:named]], np.int64)
        h, doc, at, count, string = runs(self.texts[:named])
        key = ((h % np.uint64(buckets)) << np.uint64(32) | (h // np.uint64(buckets)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        order, ordered = _ordered(key.view(np.uint64), 32 + (buckets - 1).bit_length())
        tied = np.append(ordered[1:] == ordered[:-1], False)
        tied = np.flatnonzero(tied | np.append(False, tied[:-1])) if tied.size else tied
        some = order[tied]
        order[tied] = some[np.lexsort((some, string[some], key[some]))]
        self.doc, self.at, self.count, self.key = doc[order], at[order], count[order], key[order]
        string = string[order]
        #: First run of each minimiser and of each different string; runs stay in the order of doc_id within a string.
        self.minimisers, self.strings = _starts(self.key), _starts(self.key, string)
        self.string = np.repeat(np.arange(self.strings.size), np.diff(np.append(self.strings, key.size)))
        #: By minimiser: what bucket it belongs to, and its share of each.
        self.bucket = self.key[self.minimisers] >> 32
        self.shares = _cuts(_starts(self.bucket), self.bucket.size)

    def offered(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each bucket the minimisers, whether two ids or more have each here, and the bytes of its strings."""
        if not self.key.size:
            return
        own = self.own[self.doc]
        shared = np.minimum.reduceat(own, self.minimisers) < np.maximum.reduceat(own, self.minimisers)
        size = self.count[self.strings] + LEAST
        size = np.minimum(np.add.reduceat(size, np.searchsorted(self.strings, self.minimisers)), 0xFFFF)
        for a, b in self.shares:
            yield int(self.bucket[a]), self.key[self.minimisers[a:b]] & 0xFFFFFFFF, shared[a:b], size[a:b]

    def items(self, codes: dict[int, np.ndarray], buckets: int) -> None:
        """Fixes what this group sends to buckets: the strings of shared minimisers, those of hot ones window by window."""
        code = np.concatenate([codes[int(self.bucket[a])] for a, _ in self.shares]) if self.shares else np.zeros(0, np.uint8)
        code = code[np.searchsorted(self.minimisers, self.strings, "right") - 1]
        doc, at, size = self.doc[self.strings], self.at[self.strings], self.count[self.strings] + LEAST - 1
        whole, hot = np.flatnonzero(code == 1), np.flatnonzero(code == 2)
        self.whole, self.hot = whole, hot
        bucket, low = self.key[self.strings[whole]] >> 32, self.key[self.strings[whole]] & 0xFFFFFFFF
        self.item_bucket, self.item_part = bucket, low % PARTS
        self.item_doc, self.item_at, self.item_size = doc[whole], at[whole], size[whole]
        self.item_least = self.own[doc[whole]]
        self.window_item = np.zeros(0, np.int64)
        if hot.size:
            h = np.concatenate([_window_hashes(self.texts[d][a : a + n]) for d, a, n in zip(doc[hot].tolist(), at[hot].tolist(), size[hot].tolist(), strict=True)])
            count = size[hot] - LEAST + 1
            d, a = np.repeat(doc[hot], count), np.repeat(at[hot] - (np.cumsum(count) - count), count) + np.arange(h.size)
            order = np.lexsort((self.own[d], h))
            first = _starts(h[order])
            self.window_item = np.empty(h.size, np.int64)
            self.window_item[order] = np.repeat(np.arange(first.size), np.diff(np.append(first, h.size)))
            h, d, a = h[order[first]], d[order[first]], a[order[first]]
            own = [(h % np.uint64(buckets)).astype(np.int64), (h // np.uint64(buckets) % np.uint64(PARTS)).astype(np.int64), d, a, np.full(h.size, LEAST), self.own[d]]
            for name, x in zip(("bucket", "part", "doc", "at", "size", "least"), own, strict=True):
                setattr(self, f"item_{name}", np.concatenate([getattr(self, f"item_{name}"), x]))
        self.order = np.lexsort((np.arange(self.item_bucket.size), self.item_part, self.item_bucket))

    def sent(self) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
        """For each bucket the transforms of this shard's parts, their sizes and the least doc_id of each string."""
        o = self.order
        bucket, part, size = self.item_bucket[o], self.item_part[o], self.item_size[o] + 1
        pieces = _starts(bucket, part)
        symbols = np.add.reduceat(size, pieces) if pieces.size else np.zeros(0, np.int64)
        ends = np.append(pieces[1:], o.size)
        made = []
        for s in slices(symbols.tolist(), _SORTED):
            a, b = int(pieces[s.start]), int(ends[s.stop - 1])
            texts = [self.texts[d][x : x + n] for d, x, n in zip(self.item_doc[o[a:b]].tolist(), self.item_at[o[a:b]].tolist(), self.item_size[o[a:b]].tolist(), strict=True)]
            out = transform(texts, np.repeat(np.arange(s.start, s.stop), ends[s] - pieces[s]))
            made += np.split(out, np.cumsum(symbols[s])[:-1])
        for a, b in _cuts(_starts(bucket[pieces]), pieces.size):
            sizes = np.zeros(PARTS, np.int64)
            sizes[part[pieces[a:b]]] = symbols[a:b]
            yield int(bucket[pieces[a]]), b"".join(x.tobytes() for x in made[a:b]), sizes, self.item_least[o[pieces[a] : ends[b - 1]]]

    def spans(self, told: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, end) of what goes, given for each bucket the least doc_id of each window sent to it."""
        o = self.order
        none = (np.zeros(0, np.int64),) * 3
        if not o.size:
            return none
        sent = np.concatenate([told[k] for k in np.unique(self.item_bucket).tolist()])
        count = self.item_size - LEAST + 1
        begin = np.empty(o.size, np.int64)
        begin[o] = np.cumsum(count[o]) - count[o]
        # windows of each string that is asked for, in one array: those of whole strings, then those of hot ones
        n_whole = self.whole.size
        at = np.repeat(begin[:n_whole] - (np.cumsum(count[:n_whole]) - count[:n_whole]), count[:n_whole]) + np.arange(count[:n_whole].sum())
        windows = np.concatenate([sent[at], sent[begin[n_whole:]][self.window_item]])
        kept = np.concatenate([self.whole, self.hot])
        size = self.count[self.strings[kept]]
        first = np.cumsum(size) - size
        low, high = np.minimum.reduceat(windows, first), np.maximum.reduceat(windows, first)
        index = np.full(self.strings.size, -1)
        index[kept] = np.arange(kept.size)
        k = index[self.string]
        own = self.own[self.doc]
        all_of = (k >= 0) & (own > high[k])
        row, start, end = [self.doc[all_of]], [self.at[all_of]], [self.at[all_of] + self.count[all_of] + LEAST - 1]
        some = np.flatnonzero((k >= 0) & ~all_of & (own > low[k]))
        for s in slices(self.count[some].tolist(), 4_000_000):
            r = some[s]
            n = self.count[r]
            which = np.repeat(np.arange(r.size), n)
            within = np.arange(which.size) - np.repeat(np.cumsum(n) - n, n)
            gone = windows[first[k[r]][which] + within] < own[r][which]
            edge = np.flatnonzero(gone & ((within == 0) | ~np.append(False, gone[:-1])))
            last = np.flatnonzero(gone & ((within == n[which] - 1) | ~np.append(gone[1:], False)))
            row.append(self.doc[r][which[edge]])
            start.append(self.at[r][which[edge]] + within[edge])
            end.append(self.at[r][which[last]] + within[last] + LEAST)
        return tuple(np.concatenate(x) for x in (row, start, end))


def _offers(buckets: int):
    def run(key: tuple, docs: pd.DataFrame) -> pd.DataFrame:
        rows = [(b, int(key[0]), _bytes(h, "<u4"), _bytes(shared, "u1"), _bytes(size, "<u2")) for b, h, shared, size in _Group(docs, buckets).offered()]
        return pd.DataFrame(rows, columns=["bucket", "g", "h", "shared", "size"])

    return run


def _judged(hot: int):
    """Which of the minimisers a group offered are in two documents or more (1), and which of these are hot (2).

    A bucket holds each group's different minimisers once, so one that is in all documents is as many entries as
    there are groups.
    """

    def finish(rows: list[tuple]) -> pd.DataFrame:
        h, shared, size = (np.concatenate([_array(r[k], kind) for r in rows]) for k, kind in ((2, "<u4"), (3, "u1"), (4, "<u2")))
        order = np.argsort(h, kind="stable")
        first = _starts(h[order])
        count = np.diff(np.append(first, h.size))
        many = (count > 1) | (np.maximum.reduceat(shared[order], first) > 0)
        code = np.empty(h.size, np.uint8)
        code[order] = np.repeat(np.where(many, np.where(np.add.reduceat(size[order].astype(np.int64), first) > hot, 2, 1), 0), count)
        end = np.cumsum([_array(r[3], "u1").size for r in rows])
        return pd.DataFrame([(r[1], r[0], _bytes(c, "u1")) for r, c in zip(rows, np.split(code, end[:-1]), strict=True)], columns=["g", "bucket", "code"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                if held and row[0] != held[0][0]:
                    yield finish(held)
                    held = []
                held.append(row)
        if held:
            yield finish(held)

    return run


def _codes(judged: pd.DataFrame) -> dict[int, np.ndarray]:
    return {int(b): _array(c, "u1") for b, c in zip(judged["bucket"].tolist(), judged["code"].tolist(), strict=True)}


def _shards(buckets: int):
    def run(key: tuple, docs: pd.DataFrame, judged: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(docs):
            group = _Group(docs, buckets)
            group.items(_codes(judged), buckets)
            rows = [(b, int(key[0]), _pack(t), _bytes(n, "<u4"), _bytes(least, "<i8")) for b, t, n, least in group.sent()]
        return pd.DataFrame(rows, columns=["bucket", "g", "transforms", "sizes", "docs"])

    return run


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each shard of a bucket, the least doc_id of each of its windows, as runs of equal values."""

    def finish(rows: list[tuple]) -> pd.DataFrame:
        sizes = [_array(r[3], "<u4").astype(np.int64) for r in rows]
        shards = [np.split(np.frombuffer(_unpack(bytes(r[2])), np.uint8), np.cumsum(n)[:-1]) for r, n in zip(rows, sizes, strict=True)]
        docs = [np.split(_array(r[4], "<i8"), np.cumsum([np.count_nonzero(t == 0) for t in ts])[:-1]) for r, ts in zip(rows, shards, strict=True)]
        out: list[list[np.ndarray]] = [[] for _ in rows]
        for part in range(PARTS):
            some = [k for k, n in enumerate(sizes) if n[part]]
            if some:
                for k, least in zip(some, least_of_windows([shards[k][part] for k in some], [docs[k][part] for k in some]), strict=True):
                    out[k].append(least)
        told = []
        for r, parts in zip(rows, out, strict=True):
            least = np.concatenate(parts)
            first = _starts(least)
            told.append((r[1], r[0], _bytes(least[first], "<i8"), _bytes(np.diff(np.append(first, least.size)), "<u4")))
        return pd.DataFrame(told, columns=["g", "bucket", "least", "n"])

    held: list[tuple] = []
    for batch in batches:
        for row in batch.itertuples(index=False, name=None):
            if held and row[0] != held[0][0]:
                yield finish(held)
                held = []
            held.append(row)
    if held:
        yield finish(held)


def removed(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of data, the bytes that go and the runs they form."""
    if not len(start):
        return data, 0, 0
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.concatenate([[True], start[1:] > end[:-1]])
    a, b = start[first], end[np.append(np.flatnonzero(first)[1:] - 1, len(end) - 1)]
    kept = b"".join(data[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(data)], strict=True))
    return kept, len(data) - len(kept), len(a)


def _cut(buckets: int):
    def run(key: tuple, docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        columns = ["id", "n_bytes", "n_removed", "n_spans", "kept"]
        if not len(docs):
            return pd.DataFrame([], columns=columns)
        group = _Group(docs, buckets)
        judged = told[told["code"].notna()]
        told = told[told["code"].isna()]
        group.items(_codes(judged), buckets)
        row, start, end = group.spans({int(b): np.repeat(_array(v, "<i8"), _array(n, "<u4")) for b, v, n in zip(told["bucket"].tolist(), told["least"].tolist(), told["n"].tolist(), strict=True)})
        order = np.argsort(row, kind="stable")
        row, start, end = row[order], start[order], end[order]
        edge = np.searchsorted(row, np.arange(len(group.ids) + 1))
        rows = []
        for i, (doc, data, a, b) in enumerate(zip(group.ids, group.texts, edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
            kept, size, k = removed(data, start[a:b], end[a:b])
            group.texts[i] = b""
            rows.append((doc, len(data), size, k, kept))
        return pd.DataFrame(rows, columns=columns)

    return run


def dedup(docs: DataFrame, group_bytes: int = GROUP_BYTES, hot: int = HOT_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every document.

    A byte goes if a string of LEAST bytes that covers it also starts in a document with a smaller doc_id.
    Null texts are empty. Rows without an id lose nothing and take nothing from others; rows that repeat an
    id, whatever their texts, are not smaller than one another and are each judged alone. No rows give no rows.

    Texts are dealt out once, compressed, by group of documents; all three steps that read them share that
    exchange. What travels between groups and buckets is packed: minimisers, transforms, least doc_ids. In a group,
    strings are one if minimiser and string hash (96 bits) agree. Tasks hold one group or one bucket: about
    group_bytes of text, and for each minimiser at most one entry of each group. Their number is the square of what
    group_bytes divides the text into, so very large inputs want larger groups (100 TB: about 256 MB).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-total // group_bytes))
    # equal rows of one partition meet, those of several need not
    group = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(buckets)).cast("int")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"g": batch["g"], "id": batch["id"], "th": batch["th"], "z": [_pack(t.encode("utf-8", "surrogatepass")) for t in as_texts(batch["text"])]})

    dealt = docs.select(group.alias("g"), F.col("doc_id").cast("string").alias("id"), F.xxhash64("text").alias("th"), "text").mapInPandas(packed, "g int, id string, th long, z binary")
    offers = dealt.groupBy("g").applyInPandas(_offers(buckets), "bucket int, g int, h binary, shared binary, size binary")
    judged = offers.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_judged(hot), "g int, bucket int, code binary")
    shards = dealt.groupBy("g").cogroup(judged.groupBy("g")).applyInPandas(_shards(buckets), "bucket int, g int, transforms binary, sizes binary, docs binary")
    least = shards.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_merged, "g int, bucket int, least binary, n binary")
    none = F.lit(None).cast("binary")
    told = least.withColumn("code", none).unionByName(judged.select("g", "bucket", none.alias("least"), none.alias("n"), "code"))
    out = dealt.groupBy("g").cogroup(told.groupBy("g")).applyInPandas(_cut(buckets), "id string, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(F.col("id").cast("long").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
