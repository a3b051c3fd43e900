"""Language ID by bit-sliced Bloom filters of character n-grams.

Each slot of one filter holds a bit for every language; the bits left after and-ing an n-gram's slots name
all languages that contain it. A text's bits are counted by language, each count is corrected for the
filter's false positives in that language's slice, and the largest decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.common import as_texts, mixed, slices, written

#: Labelled ids of each language to learn from at most: those with the least hash.
SAMPLE = 400
#: Grams kept for each length and language, by frequency; equal for all languages, so none is favoured.
GRAMS = {2: 700, 3: 4_000, 4: 8_000}
SLOTS, HASHES = 1 << 19, 3
#: Bits of the slices that hashes of ids are counted by, and rows up to which the slices' ends and the sample are broadcast.
SLICE_BITS, BROADCAST_IDS = 12, 100_000
#: Ids of a language whose texts are counted together, and about how many different grams a task holds before it gives them out.
PART_IDS, HELD_GRAMS = 200, 1_000_000

_P = np.uint64(0x100000001B3)
#: Characters worked on at once: a worker keeps the most memory that it ever took, so this bounds what all of them hold.
#: A blank is looked for so many more characters on before a text is cut without one.
_BATCH, _AHEAD = 1 << 16, 1_000_000
_BLANK = re.compile(r"\s")
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _plain(low: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of lower-cased texts with one space for each run of others than letters, the indices of their texts,
    and whether each text has a letter."""
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(low)), np.fromiter(map(len, low), np.int64, len(low)))
    alpha = letters()[codes]
    has = np.bincount(owner[alpha], minlength=len(low)) > 0
    before = np.concatenate([[False], alpha[:-1]])
    keep = alpha | before
    keep[np.flatnonzero(np.diff(owner, prepend=-1))] = True
    return np.where(alpha, codes, 32)[keep].astype(np.uint64), owner[keep], has


def _windows(codes: np.ndarray, owner: np.ndarray, lengths, known: int = 0) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, the hashes of the n-grams with their texts' indices, but for those among the first known symbols."""
    out, h = {}, codes + np.uint64(1)
    for n in range(2, max(lengths) + 1):
        h = h[:-1] * _P + codes[n - 1 :] + np.uint64(1) if codes.size >= n else h[:0]
        if n in lengths:
            inside = owner[: h.size] == owner[n - 1 :] if h.size else np.zeros(0, bool)
            inside[: max(0, known - n + 1)] = False
            out[n] = mixed(h[inside] * np.uint64(2 * n + 1)), owner[: h.size][inside]
    return out


def grams(texts: list[str], lengths=tuple(GRAMS)) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Whether each text has a letter, and by length the hashes of the n-grams with their texts' indices.

    Texts are lower-cased, and each run of other characters becomes one space.
    """
    codes, owner, has = _plain([f" {t.lower()} " for t in texts])
    return has, _windows(codes, owner, lengths)


def _cuts(text: str, piece: int, ahead: int) -> Iterator[str]:
    """A text in pieces of about so many characters, cut behind white space, so lower-casing does not see the cut; where
    there is none in so many more ahead, a cut is made anyway, which only the form of a Greek sigma there can show."""
    at = 0
    while len(text) - at > piece:
        found = _BLANK.search(text, at + piece, at + piece + ahead)
        end = found.end() if found else at + piece + ahead
        yield text[at:end]
        at = end
    yield text[at:]


def gram_batches(texts: list[str], lengths=tuple(GRAMS), batch: int = _BATCH, ahead: int = _AHEAD) -> Iterator[tuple[slice, np.ndarray, dict]]:
    """What grams gives for consecutive slices of texts of about batch characters; a longer text comes as several pieces,
    each with the last symbols of the one before, so that every n-gram is there once."""
    sizes = [len(t) for t in texts]
    for s in slices(sizes, batch):
        if sum(sizes[s]) <= batch:
            yield s, *grams(texts[s], lengths)
            continue
        for i in range(s.start, s.stop):
            tail = np.zeros(0, np.uint64)
            for k, piece in enumerate(chain(_cuts(texts[i], batch, ahead), (" ",))):
                codes, _, has = _plain([piece.lower() if k else " " + piece.lower()])
                if tail.size and codes.size and tail[-1] == codes[0] == 32:
                    codes = codes[1:]
                codes = np.concatenate([tail, codes])
                yield slice(i, i + 1), has, _windows(codes, np.zeros(codes.size, np.int64), lengths, tail.size)
                tail = codes[max(0, codes.size - max(lengths) + 1) :]


def slots(h: np.ndarray) -> list[np.ndarray]:
    return [((h >> np.uint64(21 * k)) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]


@dataclass
class LanguageFilter:
    """langs in code point order; table has a row of slots for each 64 languages."""

    langs: list[str]
    table: np.ndarray = field(default_factory=lambda: np.zeros((1, SLOTS), np.uint64))
    false: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def build(cls, found: dict[str, np.ndarray]) -> LanguageFilter:
        """found: the gram hashes of each language."""
        langs = sorted(found)
        table = np.zeros((max(1, -(-len(langs) // 64)), SLOTS), np.uint64)
        rates = []
        for i, lang in enumerate(langs):
            bit = np.uint64(1) << np.uint64(i % 64)
            for at in slots(found[lang]):
                table[i // 64, at] |= bit
            rates.append((np.count_nonzero(table[i // 64] & bit) / SLOTS) ** HASHES)
        return cls(langs, table, np.array(rates))

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Whether each text has a letter; its corrected counts by language."""
        hits = np.zeros((len(texts), len(self.langs)))
        total = np.zeros(len(texts))
        has = np.zeros(len(texts), bool)
        for s, some, found in gram_batches(texts):
            n = s.stop - s.start
            has[s] |= some
            for h, owner in found.values():
                total[s] += np.bincount(owner, minlength=n)
                at = slots(h)
                for w, table in enumerate(self.table):
                    bits = table[at[0]] & table[at[1]] & table[at[2]]
                    for i in range(64 * w, min(64 * w + 64, len(self.langs))):
                        hits[s, i] += np.bincount(owner[(bits >> np.uint64(i % 64) & np.uint64(1)).astype(bool)], minlength=n)
        corrected = (hits - total[:, None] * self.false) / np.maximum(1 - self.false, 1e-9)
        return has, np.clip(corrected, 0, None)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its share of all languages' counts; ties go to the first, und has no letter."""
        has, c = self.counts(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        best, sums = np.argmax(c, axis=1), c.sum(axis=1)
        scores = np.where(has & (sums > 0), c[np.arange(len(texts)), best] / np.where(sums > 0, sums, 1), 0.0)
        return [self.langs[k] if some else "und" for k, some in zip(best, has, strict=True)], scores


def _small(df: DataFrame, tag: str) -> DataFrame:
    """df worked out once: up to BROADCAST_IDS rows as a broadcast without a file, more as a table in the shared folder."""
    rows = df.limit(BROADCAST_IDS + 1).toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if rows.num_rows <= BROADCAST_IDS else written(df, tag)[0]


def _sampled(labelled: DataFrame, sample: int) -> DataFrame:
    """lang, doc_id, part of the ids to learn from: at most sample of each language, those with the least hash.

    A language's parts have PART_IDS ids each but for the last. Chosen by ids alone. Hashes are counted by slice, which tells
    how many slices a language needs; only what is in these is ranked. Ids are read twice rather than written: on a local
    file system Hadoop forks the executor for each new file's mode, and the child counts as the executor once more.
    """
    key = [F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").cast("string").alias("lang")]
    ids = labelled.where("doc_id is not null and lang is not null and text is not null").select(*key).withColumn("_h", F.xxhash64("doc_id")).withColumn("_slice", F.shiftright("_h", 64 - SLICE_BITS))
    before = Window.partitionBy("lang").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = ids.distinct().groupBy("lang", "_slice").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # a language may be that of most rows: the few ends go to them
    ends = _small(counts.where(F.col("_before") < sample).groupBy("lang").agg(F.max("_slice").alias("_end")), "ends")
    few = ids.join(ends, "lang").where("_slice <= _end").select("lang", "doc_id", "_h").distinct()
    rank = Window.partitionBy("lang").orderBy("_h", "doc_id")
    return _small(few.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= sample).select("lang", "doc_id", F.floor((F.col("_rank") - 1) / PART_IDS).cast("int").alias("part")), "sample")


class _Counts:
    """Grams counted so far, by language and length."""

    def __init__(self):
        self.held: dict[tuple, list] = {}
        self.size = self.merged = 0

    def add(self, lang: str, n: int, h: np.ndarray) -> None:
        h, c = np.unique(h, return_counts=True)
        self.held.setdefault((lang, n), []).append((h, c.astype(np.int64)))
        self.size += h.size
        if self.size > 2 * self.merged + HELD_GRAMS // 4:
            self.merge()

    def merge(self) -> None:
        for key, found in self.held.items():
            h, at = np.unique(np.concatenate([h for h, _ in found]), return_inverse=True)
            c = np.zeros(h.size, np.int64)
            np.add.at(c, at, np.concatenate([c for _, c in found]))
            self.held[key] = [(h, c)]
        self.size = self.merged = sum(found[0][0].size for found in self.held.values())

    def given(self) -> Iterator[pd.DataFrame]:
        self.merge()
        for (lang, n), [(h, c)] in self.held.items():
            yield pd.DataFrame({"lang": lang, "n": n, "h": h.view(np.int64), "c": c})
        self.__init__()


def partial_counts(labelled: DataFrame, sample: int = SAMPLE, kept: dict[int, int] = GRAMS) -> DataFrame:
    """lang, n, h, c: how often each gram is in the texts to learn from, to be summed.

    Texts are dealt out by language and part, so a gram has a row for each part of its language at most, however many
    partitions there are, but where a task finds more than HELD_GRAMS.
    """
    texts = labelled.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").where("text is not null")
    rows = texts.join(_sampled(labelled, sample), ["lang", "doc_id"]).groupBy("lang", "part", "doc_id").agg(F.min("text").alias("text"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = _Counts()
        for batch in batches:
            for lang, group in batch.groupby("lang"):
                for _, _, found in gram_batches(as_texts(group["text"]), tuple(kept)):
                    for n, (h, _) in found.items():
                        counts.add(lang, n, h)
                    if counts.merged > HELD_GRAMS:
                        yield from counts.given()
        yield from counts.given()

    return rows.repartition("lang", "part").select("lang", "text").mapInPandas(counted, "lang string, n int, h long, c long")


def learn(labelled: DataFrame, sample: int = SAMPLE, kept: dict[int, int] = GRAMS) -> LanguageFilter:
    """A filter from doc_id, text and lang of the rows that have all three.

    At most sample ids of a language are read, with whole texts; of rows that repeat an id and language the least text
    counts. Grams are counted in every task and summed; each language sends the driver its most frequent ones,
    sum(kept) 64-bit hashes at most.
    """
    counts = partial_counts(labelled, sample, kept).groupBy("lang", "n", "h").agg(F.sum("c").alias("c"))
    best = counts.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("c"), "h")))
    limit = F.lit(0)
    for n, most in kept.items():
        limit = F.when(F.col("n") == n, most).otherwise(limit)
    found = best.where(F.col("_rank") <= limit).groupBy("lang").agg(F.collect_list("h").alias("grams")).collect()
    return LanguageFilter.build({r["lang"]: np.array(r["grams"], np.int64).view(np.uint64) for r in found})


def predicted(model: LanguageFilter, text):
    """struct<lang_pred, score> of a text column."""

    @F.pandas_udf("lang_pred string, score double")
    def of(series: pd.Series) -> pd.DataFrame:
        langs, scores = model.predict(as_texts(series))
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return of(text)


def held_out(doc_id):
    """The rows that are not learned from: crc32 of the id as text leaves 1 when divided by 3. Null ids are neither."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from those that are not held out.

    A null text or one without a letter is und with score 0, as is every text if nothing can be learned.
    Repeated rows and null ids get a row each; other columns are ignored.
    """
    out = held_out(docs["doc_id"])
    model = learn(docs.where(~out & docs["doc_id"].isNotNull()), sample)
    return docs.select(docs["doc_id"], out.alias("held_out"), predicted(model, docs["text"]).alias("_p")).select("doc_id", "held_out", "_p.lang_pred", "_p.score")
