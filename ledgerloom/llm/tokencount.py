"""Token counts: byte-pair merges applied rank by rank to whole batches of pre-tokens held as ragged arrays.

A tokenizer file names specials, a normaliser, a pre-tokeniser and ranked merges. Pre-tokens never cross white space, so
words are counted once each: the new words of a batch lie in one array of symbols, every round merges each word's pair of
lowest rank wherever it occurs, and what is left over are its tokens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import as_texts

#: The tokenizer file by default, by its name in the package of public tokenizers; it is read, never copied.
TOKENIZER = "word_bpe_49k.json"
#: A document with more tokens is over the limit.
LIMIT = 2_048
SCHEMA = "n_bytes long, n_tokens long, over_limit boolean"

_NONE = np.int64(2**62)
#: Characters of a text that are split at once, words whose counts are remembered, and how long those may be.
_PIECE, _CACHE, _WORD_CHARS = 1_000_000, 300_000, 64
#: Symbols from which a pre-token is merged by windows of its own.
_LONG = 2_048
_SPACE = re.compile("[ \t-\r]")
_WORD = re.compile("[^ \t-\r]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class Merges:
    """Ranked merges of symbol ids, and how many symbols a sequence of ids comes to.

    A merge must rank behind those that make its parts (as trained merges do): then all places of a sequence's lowest pair
    can be merged at once.
    """

    def __init__(self, ranked: list[tuple[int, int, int]], width: dict[int, int]):
        """ranked: (left, right, merged) ids in order of rank; width: base symbols of each id."""
        left, right, made = (np.array([m[k] for m in ranked], dtype=np.int64) for k in range(3))
        self.base = int(max([0, *left, *right, *made])) + 1
        born = np.full(self.base, -1)
        born[made[::-1]] = np.arange(len(made))[::-1]
        if (np.maximum(born[left], born[right]) >= np.arange(len(made))).any():
            raise ValueError("a merge ranks before one that makes its parts")
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made
        self.reach = max(width.values(), default=1)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NONE if it never merges."""
        if not self.keys.size:
            return np.full(a.size, _NONE)
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def counts(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Symbols left of each sequence; symbols holds the sequences (of one symbol or more) one after the other."""
        out = lengths.copy()
        long = lengths > _LONG
        ends = np.cumsum(lengths)
        for i in np.flatnonzero(long):
            out[i] = self._one_long(symbols[ends[i] - lengths[i] : ends[i]])
        owner = np.repeat(np.arange(lengths.size), np.where(long, 0, lengths))
        symbols = symbols[np.repeat(~long, lengths)]
        while symbols.size > 1:
            rank = np.where(owner[1:] == owner[:-1], self.rank(symbols[:-1], symbols[1:]), _NONE)
            rank = np.append(rank, _NONE)
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, symbols.size))
            done = least == _NONE
            out[owner[starts[done]]] = sizes[done]
            here = np.repeat(least, sizes)
            go = ~np.repeat(done, sizes)
            take = _alternate((rank == here) & go)
            symbols = np.where(take, self.made[np.where(take, rank, 0)], symbols) if self.made.size else symbols
            keep = go & ~np.append(False, take[:-1])
            symbols, owner = symbols[keep], owner[keep]
        out[owner] = 1  # a single symbol may be what is left
        return out

    def _one_long(self, symbols: np.ndarray) -> int:
        """The same for one long sequence: a pair is merged where none of lower rank is within the longest token's reach,
        for nothing farther off can come to touch it before."""
        while symbols.size > 1:
            rank = self.rank(symbols[:-1], symbols[1:])
            free = (rank != _NONE) & (rank == _least_within(rank, self.reach))
            if not free.any():
                break
            # a pair that overlaps its like waits for the one to its left
            like = np.append(False, (rank[1:] == rank[:-1]) & (rank[1:] != _NONE))
            run = np.cumsum(~like)
            held = np.cumsum(~free)
            first = np.flatnonzero(~like)
            start_held = held[first][run - 1] - (~free[first])[run - 1]
            take = _alternate(free & (held == start_held), run)
            new = np.where(take, self.made[np.where(take, rank, 0)], symbols[:-1])
            symbols = np.append(new, symbols[-1])[~np.append(False, take)]
        return symbols.size


def _alternate(hit: np.ndarray, run: np.ndarray | None = None) -> np.ndarray:
    """Of hits that stand side by side (in one run) every other one, from the first."""
    begins = hit & ~np.append(False, hit[:-1])
    if run is not None:
        begins |= hit & np.append(True, run[1:] != run[:-1])
    at = np.arange(hit.size)
    start = np.maximum.accumulate(np.where(begins, at, 0))
    return hit & ((at - start) % 2 == 0)


def _least_within(x: np.ndarray, reach: int) -> np.ndarray:
    """The least value within reach places to either side."""
    pad = np.full(reach, _NONE)
    out, have, want = np.concatenate([pad, x, pad]), 1, 2 * reach + 1
    while have < want:
        step = min(have, want - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _ascii_pattern(spec: dict) -> re.Pattern | None:
    """What splits lower-cased ASCII words as the file's steps would, if these are the usual ones: composing and white
    space do nothing to such words, and classes of letters and numbers are plain ranges."""
    steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    parts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or spec["normalizer"]["normalizers"][1]["pattern"] != {"Regex": r"\s+"}:
        return None
    if [p["type"] for p in parts] != ["Split", "ByteLevel"] or parts[1]["use_regex"] or parts[1]["add_prefix_space"] or not parts[0]["invert"] or parts[0]["behavior"] != "Removed":
        return None
    pattern = parts[0]["pattern"].get("Regex", "")
    for unicode, plain in ((r"\p{L}", "a-zA-Z"), (r"\p{N}", "0-9"), (r"\s", r" \t-\r")):
        pattern = re.sub(rf"\[{re.escape(unicode)}\]", lambda _, p=plain: f"[{p}]", pattern).replace(unicode, plain)
    return None if re.search(r"\\(?![tr])|\(", pattern) else re.compile(pattern, re.ASCII)


class Counter:
    """Counts tokens as the tokenizer of a file would give them, without begin, end or added special tokens."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        spec = json.loads(source)
        model = spec["model"]
        unfit = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or unfit or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"only plain byte-pair tokenizers with plain specials are counted here: {unfit}")
        library = Tokenizer.from_str(source)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials)) or r"(?!)")
        self.vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        plain = lambda token: token[: -len(self.end)] if self.end and token.endswith(self.end) else token
        self.merges = Merges([(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs], {i: len(plain(t)) for t, i in self.vocab.items()})
        self.ascii = _ascii_pattern(spec)
        self.known: dict[str, int] = {}

    def _pre_tokens(self, word: str) -> tuple[int, list[str]]:
        """Specials in a word, and the pre-tokens of what is between them."""
        if self.ascii and word.isascii() and not self.special.search(word):
            low = word.lower()
            # other control characters are bytes that the last step renames
            if low.isprintable():
                return 0, [low] if low.isalpha() else self.ascii.findall(low)
        parts = self.special.split(word)
        found = []
        for part in parts:
            if part:
                clean = self.normalizer.normalize_str(part) if self.normalizer else part
                found += [p for p, _ in self.splitter.pre_tokenize_str(clean)] if self.splitter else [clean]
        return len(parts) - 1, found

    def _words(self, words: list[str]) -> np.ndarray:
        """Tokens of each word."""
        ids: dict[str, int] = {}
        specials, owners, at = np.zeros(len(words), np.int64), [], []
        for i, word in enumerate(words):
            specials[i], found = self._pre_tokens(word)
            for p in found:
                owners.append(i)
                at.append(ids.setdefault(p, len(ids)))
        if not at:
            return specials
        pieces = list(ids)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        vocab, end = self.vocab, self.end
        symbols = np.fromiter((vocab[c] for p in pieces for c in (*p[:-1], p[-1] + end)), np.int64, int(lengths.sum()))
        each = self.merges.counts(symbols, lengths)
        return specials + np.bincount(owners, weights=each[at], minlength=len(words)).astype(np.int64)

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        held: list[tuple[int, list[str]]] = []

        def settle() -> None:
            """Counts the new words of all held pieces at once."""
            new = [w for w in dict.fromkeys(w for _, words in held for w in words) if w not in self.known]
            if new:
                self.known |= zip(new, self._words(new).tolist(), strict=True)
            for doc, words in held:
                out[doc] += sum(map(self.known.__getitem__, words))
            held.clear()
            if len(self.known) > _CACHE:
                self.known.clear()
            for w in new:
                if len(w) > _WORD_CHARS:
                    self.known.pop(w, None)

        size = 0
        for doc, piece in _pieces(texts):
            held.append((doc, _WORD.findall(piece)))
            size += len(piece)
            if size >= _PIECE:
                settle()
                size = 0
        settle()
        return out


def _pieces(texts: list[str]) -> Iterator[tuple[int, str]]:
    """(index, piece) of texts, cut at white space into pieces of bounded length as far as they have any."""
    for i, text in enumerate(texts):
        start = 0
        while start < len(text):
            end = len(text)
            if end - start > _PIECE:
                cut = _SPACE.search(text, start + _PIECE)
                end = cut.start() if cut else end
            yield i, text[start:end]
            start = end


_counters: dict[int, Counter] = {}


def counted(text, source):
    """A column of SCHEMA without the limit for a text column; source is a broadcast tokenizer file."""

    @F.pandas_udf("n_bytes long, n_tokens long")
    def of(series: pd.Series) -> pd.DataFrame:
        key = hash(source.value)
        if key not in _counters:
            _counters[key] = Counter(source.value)
        texts = as_texts(series)
        return pd.DataFrame({"n_bytes": np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64), "n_tokens": _counters[key].counts(texts)})

    return of(text)


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document, by the tokenizer file (the default's if none is named).

    Special strings inside a text count as the library's default has it, one token each. A null text is empty and has no
    tokens. Repeated rows and null ids get a row each; other columns of docs are ignored, whatever their names. A text is
    split in pieces of a million characters at white space, so memory is bounded by its longest word.
    """
    with open(tokenizer or default_path(), encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())  # of one vocabulary's size
    rows = docs.select(docs["doc_id"], counted(docs["text"], source).alias("_c"))
    return rows.select("doc_id", "_c.n_bytes", "_c.n_tokens", (F.col("_c.n_tokens") > limit).alias("over_limit"))
