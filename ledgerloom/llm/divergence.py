"""Source divergence audit: how far the sources of a language are from one another and from the language, by terms.

Terms are integers: sorted arrays of the kept terms of a range give ids by search, so ids keep the order of UTF-8, and
counts of a group are dense vectors of a chunk of ids. All chunks of a language together hold every kept term once; what
they give (sums of differences of two sources, the largest terms of one) is added up or merged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.common import as_texts, drop_path, slices, written

#: Documents of a language that a kept term is in at least, what is added to each count, and the terms reported of a group.
MIN_DOCS, ADDED, TOP = 30, 5, 50
#: Shares are whole numbers of so many.
UNIT = 1_000_000_000
#: Terms of a chunk and sources of a block: a task holds two blocks' counts of a chunk, 64 MB.
CHUNK, BLOCK = 4_096, 1_024

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
_NO_TERM = re.compile("[\x00-\x40\x5b-\x60\x7b-\x7f]")
_LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
#: Characters whose terms are counted at once, and terms a task remembers before it hands on what it counted.
_PIECE, _KNOWN = 1_000_000, 500_000


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of bounded length, cut where no term is."""
    start = 0
    while start < len(text):
        end = len(text)
        if end - start > _PIECE:
            cut = _NO_TERM.search(text, start + _PIECE)
            end = cut.start() if cut else end
        yield text[start:end]
        start = end


class _Held:
    """Counts of a task: ids of the terms met, and for each group how often and in how many documents they occur."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.groups: dict[tuple[str, str], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

    def add(self, group: tuple[str, str], ids: np.ndarray, counts: np.ndarray, docs: np.ndarray) -> None:
        self.groups.setdefault(group, []).append((ids, counts, docs))

    def rows(self) -> Iterator[pd.DataFrame]:
        terms = np.array(list(self.ids), dtype=object)
        for (lang, source), parts in self.groups.items():
            ids, counts, docs = (np.concatenate([p[k] for p in parts]) for k in range(3))
            n = np.bincount(ids, weights=counts, minlength=terms.size)
            d = np.bincount(ids, weights=docs, minlength=terms.size)
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "source": source, "term": terms[at], "n": n[at].astype(np.int64), "docs": d[at].astype(np.int64)})


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = _Held()
    for batch in batches:
        texts = as_texts(batch["text"])
        lang, source = as_texts(batch["lang"]), as_texts(batch["source"])
        codes = pd.Series(list(zip(lang, source, strict=True))).factorize()
        for s in slices([len(t) for t in texts], _PIECE):
            flat: list[np.ndarray] = []
            size = []
            for text in texts[s]:
                n = 0
                for piece in _pieces(text):
                    words = TERM.findall(piece.translate(_LOWER))
                    known = held.ids
                    for w in set(words):
                        known.setdefault(w, len(known))
                    flat.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
                    n += len(words)
                size.append(n)
            if not sum(size):
                continue
            ids, owner = np.concatenate(flat), np.repeat(np.arange(len(size)), size)
            pair, times = np.unique(owner * len(held.ids) + ids, return_counts=True)
            owner, ids = pair // len(held.ids), pair % len(held.ids)
            group = codes[0][s][owner]
            for g in np.unique(group):
                mine = group == g
                one, back, docs = np.unique(ids[mine], return_inverse=True, return_counts=True)
                held.add(codes[1][g], one, np.bincount(back, weights=times[mine]), docs)
            if len(held.ids) > _KNOWN or sum(p[0].size for parts in held.groups.values() for p in parts) > 8 * _KNOWN:
                yield from held.rows()
                held = _Held()
    yield from held.rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: how often and in how many rows a term occurs in a group. Tasks count what they read;
    what they counted is dealt out by language and term alone, so all groups of a term meet."""
    rows = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counted = rows.mapInPandas(_counted, "lang string, source string, term string, n long, docs long")
    return counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _kept(counts: DataFrame, min_docs: int) -> DataFrame:
    """lang, term, source, n, lang_n of the terms that at least min_docs documents of a language hold."""
    of_term = Window.partitionBy("lang", "term")
    both = counts.withColumn("lang_n", F.sum("n").over(of_term)).withColumn("lang_docs", F.sum("docs").over(of_term))
    return both.where(F.col("lang_docs") >= min_docs).select("lang", "term", "source", "n", "lang_n")


def _encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by language and term, with their term's number among those of the language that the task has."""
    now, last, n = None, None, 0
    for batch in batches:
        for lang, rows in batch.groupby("lang", sort=False):
            if lang != now:
                now, last, n = lang, None, 0
            terms = rows["term"].to_numpy()
            kept = np.unique(terms)
            first = n - (kept[0] == last)  # a term may go on from the batch before
            yield rows.assign(id=first + np.searchsorted(kept, terms))
            last, n = kept[-1], first + kept.size


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * counts / total), exactly, for counts up to total and totals below 9e15; total is 1 at least."""
    whole, rest = counts // total, counts % total
    for _ in range(3):  # UNIT is 1,000 three times over
        whole, rest = whole * 1_000 + rest * 1_000 // total, rest * 1_000 % total
    return whole + 1


def _chunk(entries: pd.DataFrame, groups: pd.DataFrame, size: int) -> pd.DataFrame:
    """What one chunk adds: sums of differences for the pairs of two blocks of sources, and the top terms of a block's own."""
    out = []
    if len(groups):
        first = groups.iloc[0]
        n_terms, lo, hi = int(first["n_terms"]), int(first["lo"]), int(first["hi"])
        groups = groups.sort_values("sid")
        sids, names = groups["sid"].to_numpy(), groups["source"].to_numpy()
        totals = groups["total"].to_numpy()[:, None]
        m = np.bincount(np.searchsorted(sids, entries["sid"].to_numpy()) * n_terms + entries["id"].to_numpy(), weights=entries["n"].to_numpy(), minlength=sids.size * n_terms).astype(np.int64).reshape(sids.size, n_terms)
        p = shares(m + ADDED, totals) if n_terms else m
        block = sids // size
        for a in np.flatnonzero(block == lo):
            others = np.flatnonzero(block == hi)
            others = others[others > a] if lo == hi else others
            if others.size:
                out.append(pd.DataFrame({"part": "pair", "source": names[a], "item": names[others], "value": np.abs(p[others] - p[a]).sum(axis=1)}))
        if lo == hi and n_terms:
            q, terms = np.zeros(n_terms, np.int64), np.full(n_terms, "", dtype=object)
            ids = entries["id"].to_numpy()
            q[ids] = shares(entries["lang_n"].to_numpy() + ADDED, int(first["lang_total"]))
            terms[ids] = entries["term"].to_numpy()
            more = np.where(m > 0, p - q, 0)
            for a in range(sids.size):
                best = np.argsort(-more[a], kind="stable")[:TOP]
                best = best[more[a][best] > 0]
                if best.size:
                    out.append(pd.DataFrame({"part": "term", "source": names[a], "item": terms[best], "value": more[a][best]}))
        if out:
            return pd.concat(out, ignore_index=True).assign(lang=first["lang"])[["lang", "part", "source", "item", "value"]]
    return pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("lang", object), ("part", object), ("source", object), ("item", object), ("value", np.int64))})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank of every group of language and source.

    part pair: item is another source of the language, value the sum over kept terms of the two shares' difference. part
    term: item is a kept term that the group has and holds more of than its language, value by how much; the TOP largest.
    A null text, lang or source is ''. Every row counts as a document, so repeated rows and ids count again. A language
    without kept terms has pairs of value 0. Other columns are ignored; no rows give no rows. Groups and chunks of terms are
    joined by shuffling, chunks hold equally many terms however the ranges fall, and no task holds more than two blocks of sources by one chunk of terms.
    """
    spark = docs.sparkSession
    kept, kept_at = written(_kept(term_counts(docs), min_docs), "kept_terms")
    named = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    ranged = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term", "source")
    schema = "lang string, term string, source string, n long, lang_n long, id long"
    ranged, ranged_at = written(ranged.mapInPandas(_encoded, schema).withColumn("part", F.spark_partition_id()), "encoded")
    # one row for each language of each range: what its numbers begin at
    parts = ranged.groupBy("lang", "part").agg((F.max("id") + 1).alias("terms"))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("lang", "part", F.coalesce(F.sum("terms").over(before), F.lit(0)).alias("base"))
    encoded = ranged.join(bases, ["lang", "part"]).withColumn("id", F.col("base") + F.col("id")).withColumn("chunk", F.floor(F.col("id") / chunk)).withColumn("id", F.col("id") % chunk)
    of_lang = parts.groupBy("lang").agg(F.sum("terms").alias("terms")).join(of_group.groupBy("lang").agg(F.sum("group_n").alias("lang_n")), "lang")
    # one row for each source: its number in its language and its totals
    ordered = Window.partitionBy("lang").orderBy("source")
    groups = named.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").withColumn("sid", F.row_number().over(ordered) - 1).withColumn("last", F.floor((F.count("*").over(Window.partitionBy("lang")) - 1) / block))
    extra = F.coalesce("terms", F.lit(0)) * ADDED
    groups, groups_at = written(groups.select("lang", "source", F.col("sid").cast("long").alias("sid"), "last", F.coalesce("terms", F.lit(0)).alias("terms"), (F.coalesce("group_n", F.lit(0)) + extra).alias("total"), (F.coalesce("lang_n", F.lit(0)) + extra).alias("lang_total")), "groups")
    mine = F.floor(F.col("sid") / block)
    units = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda other: F.struct(F.least(mine, other).alias("lo"), F.greatest(mine, other).alias("hi")))).alias("_u")
    placed = groups.select("lang", "source", "sid", "terms", "total", "lang_total", units).select("lang", "source", "sid", "terms", "total", "lang_total", "_u.*")
    # every chunk of the language; one without kept terms has one chunk of none
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("terms") - 1, F.lit(0)) / chunk))).alias("chunk")
    headers = placed.select("lang", chunks, "lo", "hi", "source", "sid", "total", "lang_total", "terms").withColumn("n_terms", F.least(F.col("terms") - F.col("chunk") * chunk, F.lit(chunk)))
    again = placed.select(*[F.col(c).alias(c) for c in ("lang", "source", "sid", "lo", "hi")])  # columns of its own
    entries = encoded.join(again, ["lang", "source"]).select("lang", "chunk", "lo", "hi", "sid", "id", "n", "lang_n", "term")
    key = ["lang", "chunk", "lo", "hi"]
    found, found_at = written(entries.groupBy(*key).cogroup(headers.groupBy(*key)).applyInPandas(lambda counts, sources: _chunk(counts, sources, block), "lang string, part string, source string, item string, value long"), "differences")
    for path in (kept_at, ranged_at, groups_at):
        drop_path(spark, path)
    one_way = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = one_way.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("_p"), "value").select("lang", "_p.source", F.lit("pair").alias("part"), "_p.item", "value")
    terms = found.where("part = 'term'").select("lang", "source", "part", "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= TOP))
