"""Benchmark decontamination: BM25 retrieval of test items by block-max WAND, then verified overlap.

Every document is cut into overlapping passages; each passage is a query of its distinct words against an inverted
index of the test items. An item's score is BM25 with its own text as 1, so one threshold fits short and long items.
Items are numbered into blocks. First the block maxima alone bound the score of every passage and block, for all
passages at once; where a bound reaches the threshold, WAND walks the postings of that block, moving past every item
that the maxima of the terms at its pivot rule out. Retrieved pairs are verified: enough of the item's five-word
shingles, and of its question and answer words, must stand in the passage.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batch_of, bound_batches, keyed, stored, tidy

K1, B = 1.2, 0.75
#: Part of an item's own score that a passage must reach, and of its shingles and words that must stand in the passage.
THRESHOLD, OVERLAP, SHINGLE = 0.6, 0.8, 5
#: Least overlap of passages in words, blocks of the bound over all passages, least items of a block.
STRIDE, BLOCKS, BLOCK_ITEMS = 64, 32, 8
#: Bytes of test items in one index, which is about eight times as large in memory; more items make more indexes, which take turns.
INDEX_BYTES = 8 << 20
TOKENS = 1 << 18
#: Terms in at least this part of the items, and three, are common: their bound is the most that an item of the block has from all.
COMMON = 0.02

_BREAK = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_FOLD = bytes.maketrans(bytes(range(65, 91)) + _BREAK, bytes(range(97, 123)) + b" " * len(_BREAK))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _parts(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item: its last sentence is the answer; with one sentence, both are the whole."""
    sentences = [x for x in (words_of(s) for s in re.split(rb"[.?!\n]+", text)) if x]
    if len(sentences) < 2:
        return words_of(text), words_of(text)
    return [w for s in sentences[:-1] for w in s], sentences[-1]


def _shingles(words: list[bytes], size: int = SHINGLE) -> set[tuple[bytes, ...]]:
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


@dataclass
class Statistics:
    """What scores depend on: of all items, whichever index they are in. `held` may leave out words of other indexes."""

    items: int
    mean: float
    longest: int
    held: dict[bytes, int]


class ItemIndex:
    """Inverted index of test items with block maxima. Size and cost are those of the items, not of the corpus.

    Postings lie in arrays, by term and block; of an item only the text is kept beside them. `statistics` are those of all
    items where this index holds a part of them.
    """

    def __init__(self, items: list[tuple[int, bytes]], threshold: float = THRESHOLD, overlap: float = OVERLAP, statistics: Statistics | None = None) -> None:
        self.threshold, self.overlap = threshold, overlap
        rows = [(i, t) for i, t in sorted(items) if words_of(t)]
        self.ids, self.texts = [i for i, _ in rows], [t for _, t in rows]
        bags = [Counter(words_of(t)) for t in self.texts]
        sizes = [sum(bag.values()) for bag in bags]
        if statistics is None:
            statistics = Statistics(len(rows), sum(sizes) / max(1, len(rows)), max(sizes, default=0), Counter(w for bag in bags for w in bag))
        n_items, mean = statistics.items, statistics.mean
        self.stride = max(STRIDE, math.ceil(1.25 * statistics.longest))
        held = {w: statistics.held[w] for bag in bags for w in bag}
        self.terms = {w: k + 1 for k, w in enumerate(sorted(held))}
        self.block = max(BLOCK_ITEMS, -(-len(rows) // BLOCKS))
        self.blocks = max(1, -(-len(rows) // self.block))
        scarce = np.array([False, *(held[w] < max(3, COMMON * n_items) for w in self.terms)])
        n = sum(map(len, bags))
        term, item, impact = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n)
        lo = 0
        for i, bag in enumerate(bags):
            norm = K1 * (1 - B + B * sizes[i] / mean)
            hi = lo + len(bag)
            df = np.array([held[w] for w in bag], float)
            tf = np.array(list(bag.values()), float)
            x = np.log(1 + (n_items - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + norm)
            term[lo:hi], item[lo:hi], impact[lo:hi] = [self.terms[w] for w in bag], i, x / x.sum()
            lo = hi
        cell = term.astype(np.int64) * self.blocks + item // self.block
        order = np.lexsort((item, cell))
        self.item, self.impact = item[order], impact[order]
        self.first = np.searchsorted(cell[order], np.arange((len(self.terms) + 1) * self.blocks + 1))
        maxima = np.zeros((len(self.terms) + 1) * self.blocks, np.float32)
        np.maximum.at(maxima, cell, impact.astype(np.float32))
        self.maxima = maxima.reshape(-1, self.blocks) * scarce[:, None]
        usual = np.bincount(item, np.where(scarce[term], 0.0, impact), len(rows)) if n else np.zeros(len(rows))
        self.scarce = self.maxima.any(axis=1)
        self.maxima *= np.float32(1.00001)  # the bounds stay bounds whatever the order of summation
        self.usual = np.array([usual[k : k + self.block].max() for k in range(0, len(rows), self.block)] or [0.0], np.float32) + np.float32(1e-5)

    def words(self, item: int) -> list[bytes]:
        return words_of(self.texts[item])

    def shingles(self, item: int) -> set[tuple[bytes, ...]]:
        return _shingles(self.words(item))

    def postings(self, term: int, block: int) -> list[tuple[int, float]]:
        """(item, impact) of a term in a block, by item."""
        lo, hi = self.first[term * self.blocks + block : term * self.blocks + block + 2]
        return list(zip(self.item[lo:hi].tolist(), self.impact[lo:hi].tolist(), strict=True))

    def wand(self, terms: set[int], block: int) -> list[tuple[int, float]]:
        """Items of the block that score at least the threshold for a query of distinct terms."""
        lists = [p for t in sorted(terms) if (p := self.postings(t, block))]
        tops = [max(x for _, x in p) for p in lists]
        at = [0] * len(lists)
        out = []
        while True:
            live = sorted((lists[k][at[k]][0], k) for k in range(len(lists)) if at[k] < len(lists[k]))
            bound, pivot = 0.0, None
            for item, k in live:
                bound += tops[k]
                if bound >= self.threshold - 1e-9:
                    pivot = item
                    break
            if pivot is None:
                return out
            if live[0][0] == pivot:
                score = sum(lists[k][at[k]][1] for item, k in live if item == pivot)
                if score >= self.threshold - 1e-9:
                    out.append((pivot, score))
                for item, k in live:
                    if item == pivot:
                        at[k] += 1
            else:
                for item, k in live:
                    if item < pivot:
                        while at[k] < len(lists[k]) and lists[k][at[k]][0] < pivot:
                            at[k] += 1

    def verify(self, item: int, passage: list[bytes]) -> float | None:
        """The part of the item's shingles that stands in the passage, if that and both word overlaps suffice."""
        words = self.words(item)
        size, own = min(SHINGLE, len(words)), _shingles(words)
        held = _shingles(passage, size) if len(passage) >= size else set()
        part = len(own & held) / len(own)
        there = set(passage)
        if part < self.overlap or any(len(p & there) < self.overlap * len(p) for p in map(set, _parts(self.texts[item]))):
            return None
        return part

    def candidates(self, docs: list[list[bytes]]) -> Iterator[tuple[int, int, int]]:
        """(document, first word, block) of all passages and blocks whose bound reaches the threshold."""
        get = self.terms.get
        stride = self.stride
        ids = [np.fromiter((get(w, 0) for w in words), np.int32, len(words)) for words in docs]
        lo = 0
        while lo < len(docs):
            hi, size = lo, 0
            while hi < len(docs) and (size == 0 or size + len(ids[hi]) <= TOKENS):
                size += len(ids[hi])
                hi += 1
            starts, owner = [], []
            for d in range(lo, hi):
                n = -(-len(ids[d]) // stride)
                owner += [d] * n
                starts += range(0, len(ids[d]), stride)
            if starts:
                owner_, starts_ = np.array(owner), np.array(starts)
                base = np.concatenate([[0], np.cumsum([len(x) for x in ids[lo:hi]])])
                flat = np.concatenate(ids[lo:hi])
                known = np.flatnonzero(self.scarce[flat])
                cuts = np.searchsorted(known, starts_ + base[owner_ - lo])
                sums = np.zeros((len(starts_), self.maxima.shape[1]), np.float32)
                full = np.flatnonzero(np.diff(np.r_[cuts, len(known)]) > 0)
                if len(full):
                    sums[full] = np.add.reduceat(self.maxima[flat[known]], cuts[full], axis=0)
                bound = sums.copy()
                follows = np.flatnonzero(owner_[1:] == owner_[:-1])
                bound[follows] += sums[follows + 1]
                for p, b in zip(*np.nonzero(bound + self.usual[None, :] >= self.threshold), strict=True):
                    yield int(owner_[p]), int(starts_[p]), int(b)
            lo = hi

    def search(self, docs: list[list[bytes]]) -> list[tuple[int, int, float, float, int]]:
        """(document, item id, score, shingle part, first word of the passage): the best passage of each verified pair."""
        best: dict[tuple[int, int], tuple[float, float, int]] = {}
        for d, start, block in self.candidates(docs):
            passage = docs[d][start : start + 2 * self.stride]
            terms = {t for w in passage if (t := self.terms.get(w))}
            for item, score in self.wand(terms, block):
                part = self.verify(item, passage)
                if part is not None:
                    key = (d, self.ids[item])
                    best[key] = max(best.get(key, (0.0, 0.0, 0)), (part, min(score, 1.0), -start))
        return [(d, i, score, part, -start) for (d, i), (part, score, start) in sorted(best.items())]


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> Iterator[ItemIndex]:
    """One index, or several in turn where the items are more than INDEX_BYTES: none larger reaches driver or executors."""
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).filter("i IS NOT NULL AND t IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-size // INDEX_BYTES))
    if parts == 1:
        yield ItemIndex([(r["i"], r["t"].encode()) for r in items.collect()], threshold, overlap)
        return
    bound_batches(items.sparkSession)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [x for x in (len(words_of(t)) for t in as_bytes(batch.column(0))) if x]
            yield batch_of(["items", "words", "longest"], [[len(n)], [sum(n)], [max(n, default=0)]], [pa.int64()] * 3)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, w) for p, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True) for w in set(words_of(t))]
            for lo in range(0, len(rows), 100_000):
                yield batch_of(["p", "w"], list(map(list, zip(*rows[lo : lo + 100_000], strict=True))), [pa.int32(), pa.binary()])

    total = items.select("t").mapInArrow(tidy(lengths), "items long, words long, longest long").agg(F.sum("items"), F.sum("words"), F.max("longest")).first()
    number = F.pmod(F.xxhash64("i"), F.lit(parts)).cast("int")
    by_part = items.select(number.alias("p"), "t").mapInArrow(tidy(words), "p int, w binary").groupBy("p", "w").agg(F.count("*").alias("n"))
    by_part = stored(by_part, "item-words")
    held = stored(by_part.join(by_part.groupBy("w").agg(F.sum("n").alias("_all")), "w").select("p", "w", "_all"), "item-frequencies")
    for k in range(parts):
        frequencies = {bytes(r["w"]): r["_all"] for r in held.filter(F.col("p") == k).collect()}
        statistics = Statistics(total[0] or 0, (total[1] or 0) / max(1, total[0] or 0), total[2] or 0, frequencies)
        yield ItemIndex([(r["i"], r["t"].encode()) for r in items.filter(number == k).collect()], threshold, overlap, statistics)


def leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, overlap, first_word): one row for each row of df and test item that it contains.

    overlap is the part of the item's five-word shingles in the best passage, score its BM25 as a part of the item's
    own, first_word where that passage begins. Null and empty texts and items contain nothing. Repeated rows give
    repeated rows; a null doc_id stays null; other columns are not read; empty tables give no rows.
    """
    bound_batches(df.sparkSession)
    names, types = ["doc_id", "item_id", "score", "overlap", "first_word"], [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]

    def scan(index: ItemIndex) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
                for lo in range(0, len(texts), 500):
                    rows = [(ids[lo + d], *rest) for d, *rest in index.search([words_of(x) for x in texts[lo : lo + 500]])]
                    if rows:
                        yield batch_of(names, list(map(list, zip(*rows, strict=True))), types)

        return keyed(df, id_col, text_col).mapInArrow(tidy(run), "doc_id long, item_id long, score double, overlap double, first_word long")

    out = None
    for index in indexes(benchmark):
        out = scan(index) if out is None else out.union(scan(index))
    return out


def drop_leaked(df: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """df without the rows that contain a test item; all columns as they were, whatever their names.

    Null and empty texts and items contain nothing, so such rows stay; repeated rows are judged alike; empty tables drop
    nothing.
    """
    bound_batches(df.sparkSession)
    at, schema = df.columns.index(text_col), df.schema

    def without(rows: DataFrame, index: ItemIndex) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    texts, keep = as_bytes(batch.column(at)), np.ones(batch.num_rows, bool)
                    for lo in range(0, len(texts), 500):
                        for d, *_ in index.search([words_of(x) for x in texts[lo : lo + 500]]):
                            keep[lo + d] = False
                    yield batch.filter(pa.array(keep))

        return rows.mapInArrow(tidy(run), schema)

    for index in indexes(benchmark):
        df = without(df, index)
    return df
