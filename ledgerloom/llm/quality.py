"""Quality rules: how much of a text lies inside n-grams and lines that it repeats."""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import SPACE, as_texts, mixed, slices

#: Words per window and the share of a text's word characters that such repeated windows may cover.
COVERAGE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: The share of characters in lines that equal an earlier line.
LINE_COVERAGE = 0.20
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_share double, ngram_share double, base_failed boolean, kept boolean"

_WORD = re.compile("[^ \t-\r]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BATCH = 2_000_000


def _covered(h: np.ndarray, ok: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in a valid window of n whose hash occurs twice or more."""
    valid = h[ok]
    order = np.sort(valid)
    again = np.unique(order[1:][order[1:] == order[:-1]])
    hit = np.zeros(words + 1, dtype=np.int64)
    if again.size:
        at = np.flatnonzero(ok)
        near = np.minimum(np.searchsorted(again, valid), again.size - 1)
        starts = at[again[near] == valid]
        np.add.at(hit, starts, 1)
        np.add.at(hit, starts + n, -1)
    return np.cumsum(hit[:-1]) > 0


def measure(texts: list[str], coverage: dict[int, float] = COVERAGE, line_coverage: float = LINE_COVERAGE) -> pd.DataFrame:
    """One row of SCHEMA per text; the windows of all texts of a batch are hashed together, apart by text."""
    words = [_WORD.findall(t) for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for ws in words for w in ws]
    total = len(flat)
    doc = np.repeat(np.arange(len(texts)), n)
    chars = np.fromiter(map(len, flat), np.int64, total)
    end = np.repeat(np.cumsum(n), n)  # the first word after the text
    one = mixed(np.fromiter(map(hash, flat), np.int64, total).view(np.uint64) ^ mixed(doc.astype(np.uint64) + _STEP))
    per_doc = lambda x: np.bincount(doc, weights=x, minlength=len(texts))
    word_chars = per_doc(chars).astype(np.int64)
    h, place = one, np.arange(total)
    repeat_words = np.zeros(len(texts), np.int64)
    worst, failed = np.zeros(len(texts)), np.zeros(len(texts), bool)
    for k in range(2, max([3, *coverage]) + 1):
        h = h[:-1] * _STEP + one[k - 1 :] if total >= k else h[:0]
        if k != 3 and k not in coverage:
            continue
        ok = place[: h.size] + k <= end[: h.size]
        inside = _covered(mixed(h), ok, k, total)
        if k == 3:
            repeat_words = per_doc(inside).astype(np.int64)
        if k in coverage:
            share = per_doc(inside * chars) / np.maximum(word_chars, 1)
            worst, failed = np.maximum(worst, share), failed | (share > coverage[k])
    dup_lines, dup_share, symbols = [], [], []
    for t in texts:
        seen, again, dup_chars, all_chars = set(), 0, 0, 0
        for line in t.split("\n"):
            if size := len(line.strip(SPACE)):
                all_chars += size
                if line in seen:
                    again, dup_chars = again + 1, dup_chars + size
                else:
                    seen.add(line)
        dup_lines.append(again)
        dup_share.append(dup_chars / max(all_chars, 1))
        symbols.append(len(_SYMBOL.findall(t)))
    base = (n < 50) | (100 * repeat_words > 50 * n)
    dup_share = np.array(dup_share, dtype=float)
    kept = ~base & ~failed & (dup_share <= line_coverage)
    return pd.DataFrame({"n_words": n, "word_chars": word_chars, "n_symbols": np.array(symbols, np.int64), "n_dup_lines": np.array(dup_lines, np.int64), "n_repeat_words": repeat_words, "dup_line_share": dup_share, "ngram_share": worst, "base_failed": base, "kept": kept})


def measured(text, coverage: dict[int, float] = COVERAGE, line_coverage: float = LINE_COVERAGE):
    """A column of SCHEMA for a text column."""

    @F.pandas_udf(SCHEMA)
    def of(series: pd.Series) -> pd.DataFrame:
        texts = as_texts(series)
        parts = [measure(texts[s], c, line) for s, c, line in zip(slices([len(t) for t in texts], _BATCH), repeat(coverage), repeat(line_coverage), strict=False)]
        return pd.concat(parts, ignore_index=True) if parts else measure([])

    return of(text)


def quality(docs: DataFrame, coverage: dict[int, float] = COVERAGE, line_coverage: float = LINE_COVERAGE) -> DataFrame:
    """doc_id and the measures of each document.

    A null or empty text has no words, fails the base rule and is not kept. Repeated rows and null ids get
    a row each; other columns of docs are ignored, whatever their names. No rows give no rows.
    """
    return docs.select("doc_id", measured(F.col("text"), coverage, line_coverage).alias("_m")).select("doc_id", "_m.*")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns as they were."""
    return docs.where(measured(docs["text"])["kept"])
