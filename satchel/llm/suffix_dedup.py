"""Removal of bytes that repeated 200-byte strings cover, by suffix arrays of the places where repeats can be.

Every window of SPAN bytes belongs to its anchor, the least hashed CORE-byte string in it (leftmost of equals), so equal
windows have equal anchors at equal offsets. Neighbouring windows with one anchor form a context. Contexts are brought
together by the anchor's hash. A context that occurs twice is repeated as a whole. Different contexts of one anchor are
compared by a suffix array, built by linear grouping: suffixes are grouped by their Lyndon prefixes, groups taken in
descending order through previous-smaller pointers, then every group's order is emitted, without recursive renaming.
Before that the bytes that all contexts of an anchor share around it become one symbol, and what lies beyond the
longest match on either side is cut, neither of which changes any comparison. An anchor that very many different
contexts have would be too much for one task: each window of its contexts is a context of its own then, brought together
by its own hash, and such a context is only ever repeated as a whole. Which anchors are so common is seen in a part of the
texts; it decides where strings meet, not which are found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batch_of, bound_batches, join_dealt, stored

#: A repeated string has SPAN bytes; anchors have CORE. Symbols that one suffix array takes, about.
SPAN, CORE = 200, 80
SYMBOLS = 1 << 16
#: Bytes of a text hashed at once (positions have 24 bits), and contexts that a task combines at once.
SLICE, LOT = 1 << 22, 200_000
#: Every SEEN-th text is looked at for common anchors: those of COMMON different contexts there, MOST_COMMON at most.
SEEN, COMMON, MOST_COMMON = 50, 6, 100_000

_B = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 24) - 1)
_powers: list[np.ndarray] = []


def suffix_array(s: list[int]) -> list[int]:
    """Suffix array of s, whose last symbol is its only least one, by linear grouping.

    First phase: groups of suffixes, at first by symbol, are taken from the highest down. Of each suffix of the group the
    previous one of a lower group is found; those previous suffixes move to new groups just above their old ones, the
    higher the more suffixes point to them. Second phase: from the least suffix on, each placed suffix brings the one
    before it and its chain of previous suffixes to the front of their groups.
    """
    n = len(s)
    order = sorted(range(n), key=s.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for k, i in enumerate(order):
        if s[i] != s[order[start]]:
            start = k
        place[i] = k
        group[i] = start
        size[start] += 1
    prev = list(range(-1, n - 1))
    end = n - 1
    while end >= 0:
        own = group[order[end]]
        if own == end:
            i = order[end]
            j = i - 1
            while j >= 0 and group[j] >= own:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                g = group[j]
                left = size[g] - 1
                if left:
                    last = g + left
                    at, other = place[j], order[last]
                    order[at], order[last] = other, j
                    place[other], place[j] = at, last
                    size[g] = left
                    size[last] = 1
                    group[j] = last
            end -= 1
            continue
        votes: dict[int, int] = {}
        for i in order[own : end + 1]:
            j = i - 1
            while j >= 0 and group[j] >= own:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                votes[j] = votes.get(j, 0) + 1
        by_votes: dict[int, list[int]] = {}
        for j, v in votes.items():
            by_votes.setdefault(v, []).append(j)
        for v in sorted(by_votes, reverse=True):
            moved: dict[int, int] = {}
            for j in by_votes[v]:
                g = group[j]
                size[g] -= 1
                last = g + size[g]
                at, other = place[j], order[last]
                order[at], order[last] = other, j
                place[other], place[j] = at, last
                moved[g] = moved.get(g, 0) + 1
            above = {g: g + size[g] for g in moved}
            for j in by_votes[v]:
                group[j] = above[group[j]]
            for g, m in moved.items():
                size[above[g]] = m
        end = own - 1
    out, front, done = [0] * n, list(range(n)), [False] * n
    out[0] = n - 1
    done[n - 1] = True
    for k in range(n):
        i = out[k] - 1
        while i >= 0 and not done[i]:
            g = group[i]
            out[front[g]] = i
            front[g] += 1
            done[i] = True
            i = prev[i]
    return out


def longest_matches(s: list[int]) -> list[int]:
    """For each suffix of s, the most symbols that it shares with the beginning of any other suffix."""
    sa = suffix_array(s)
    n = len(s)
    rank = [0] * n
    for k, i in enumerate(sa):
        rank[i] = k
    best, h = [0] * n, 0
    for i in range(n):
        if rank[i]:
            j = sa[rank[i] - 1]
            while s[i + h] == s[j + h]:
                h += 1
            if h > best[i]:
                best[i] = h
            if h > best[j]:
                best[j] = h
            if h:
                h -= 1
        else:
            h = 0
    return best


def _hashes(b: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of `size` bytes in b, from prefix sums of a polynomial modulo 2**64."""
    n = len(b)
    if not _powers or len(_powers[0]) <= n:
        most = max(n + 1, 1 << 16)
        up, down = np.full(most, _B), np.full(most, np.uint64(pow(int(_B), -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    up, down = _powers
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * down[:n], out=sums[1:])
    h = (sums[size:] - sums[:-size]) * up[: n - size + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def contexts(text: bytes, span: int = SPAN, core: int = CORE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, first window, number of windows, anchor's offset from the first window) of all contexts of a text."""
    width = span - core + 1
    step = SLICE - span + 1
    for lo in range(0, max(0, len(text) - span + 1), step):
        b = np.frombuffer(text, np.uint8, min(SLICE, len(text) - lo), lo)
        h = _hashes(b, core)
        least = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        at = (least[first] & _LOW).astype(np.int64)
        yield h[at].view(np.int64), first + lo, np.diff(np.r_[first, len(least)]), at - first


def resolve(groups: list[list[tuple[bytes, int, int]]], span: int = SPAN, core: int = CORE) -> list[list[tuple[int, int] | None]]:
    """For contexts (bytes, windows, anchor offset) in groups by anchor: the first and last window that recurs in another
    context of its group, or None. All windows of a context contain its anchor, so what they cover is one run."""
    symbols: list[int] = []
    plans: list[list[tuple[int, int, int, int]]] = []
    for number, group in enumerate(groups):
        lefts = [x[:a][::-1] for x, _, a in group]
        rights = [x[a + core :] for x, _, a in group]
        cut = []
        for sides in (lefts, rights):
            shared = len(commonprefix([min(sides), max(sides)]))
            ordered = sorted(sides)
            longest = max((len(commonprefix([p, q])) for p, q in zip(ordered, ordered[1:], strict=False)), default=0)
            cut.append((shared, longest + 1))
        (ls, lm), (rs, rm) = cut
        plan = []
        for left, right in zip(lefts, rights, strict=True):
            l, r = left[ls:lm][::-1], right[rs:rm]
            plan.append((len(symbols), len(l), ls, rs))
            symbols += [c + 1 for c in l]
            symbols.append(257 + number)
            symbols += [c + 1 for c in r]
            symbols.append(257 + len(groups) + len(symbols))  # a symbol of its own ends each context
        plans.append(plan)
    best = longest_matches([*symbols, 0])
    out = []
    for group, plan in zip(groups, plans, strict=True):
        found: list[tuple[int, int] | None] = []
        for (_, windows, a), (at, n_left, ls, rs) in zip(group, plan, strict=True):
            hits = []
            for w in range(windows):  # the window has a - w bytes left of the anchor
                before, after = max(0, a - w - ls), max(0, span - core - (a - w) - rs)
                if before <= n_left and best[at + n_left - before] >= before + 1 + after:
                    hits.append(w)
            found.append((hits[0], hits[-1]) if hits else None)
        out.append(found)
    return out


def _named(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids and texts with a 128-bit name of the text; null texts are empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumns({"ka": F.xxhash64("text"), "kb": F.xxhash64(F.reverse("text"))})


_EMIT = "key long, late int, h long, c long, ka long, kb long, at int, n int, a int, whole boolean"


def _combine(x: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of rows (h, c, ..., whole) those that occur twice and were not known to, and one of each with what is known now."""
    order = np.lexsort((x[1], x[0]))
    x = [y[order] for y in x]
    first = np.flatnonzero(np.r_[True, (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1])])
    counts = np.diff(np.r_[first, len(order)])
    told = np.repeat(counts > 1, counts) & ~x[7]
    one = [y[first] for y in x]
    one[7] = (counts > 1) | np.logical_or.reduceat(x[7], first)
    return [y[told] for y in x], one


def _windows(rows: list[np.ndarray], texts: list[bytes]) -> list[np.ndarray]:
    """Each window of the contexts as a context of its own."""
    out: list[list] = [[] for _ in rows]
    xx = xxhash.xxh64_intdigest
    for _, _, ka, kb, at, n, _, whole, number in zip(*(y.tolist() for y in rows), strict=True):
        view = memoryview(texts[number])[at : at + n + SPAN - 1]
        parts = [view[k : k + SPAN] for k in range(n)]
        values = ([xx(v, 1) for v in parts], [xx(v, 2) for v in parts], [ka] * n, [kb] * n, range(at, at + n), [1] * n, [0] * n, [whole] * n, [number] * n)
        for y, v in zip(out, values, strict=True):
            y.extend(v)
    signed = [np.array(out[k], np.uint64).view(np.int64) for k in range(2)]
    return signed + [np.array(y, x.dtype) for x, y in zip(rows[2:], out[2:], strict=True)]


def _contexts_of(texts: list[bytes], ka: list[int], kb: list[int]) -> list[np.ndarray]:
    """(h, c, ka, kb, at, n, a, whole, number of the text) of all contexts of the texts."""
    held = []
    for number, text in enumerate(texts):
        for h, first, n, a in contexts(text):
            view, xx = memoryview(text), xxhash.xxh64_intdigest
            ends = (first + n + SPAN - 1).tolist()
            c = np.array([xx(view[i:j], d) for i, j, d in zip(first.tolist(), ends, a.tolist(), strict=True)], np.uint64).view(np.int64)
            full = lambda v, k=len(h): np.full(k, v, np.int64)
            held.append((h, c, full(ka[number]), full(kb[number]), first.astype(np.int32), n.astype(np.int32), a.astype(np.int32), np.zeros(len(h), bool), full(number)))
    kinds = (np.int64,) * 4 + (np.int32,) * 3 + (bool, np.int64)
    return [np.concatenate(y) for y in zip(*held, strict=True)] if held else [np.zeros(0, k) for k in kinds]


def common_anchors(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of anchors that many different contexts have, as seen in a part of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _contexts_of(as_bytes(batch.column(2)), batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield batch_of(["h", "c"], [pa.array(x[0]), pa.array(x[1])], [pa.int64(), pa.int64()])

    seen = docs.filter(F.pmod("ka", F.lit(SEEN)) == 0).select("ka", "kb", "text").mapInArrow(run, "h long, c long")
    counts = seen.distinct().groupBy("h").count().filter(F.col("count") >= COMMON)
    return np.sort(counts.orderBy(F.col("count").desc(), "h").limit(MOST_COMMON).select("h").toArrow().column("h").to_numpy())


def _emit(batches: Iterator[pa.RecordBatch], common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Contexts of all texts of a task; equal texts of one task give theirs once.

    A context that a task meets twice is repeated, so its runs are told at once (late 0, dealt by text) and one row of it
    goes on as repeated. What goes to an anchor's group is then one row for each different context and lot of a task.
    """
    names = [x.split()[0] for x in _EMIT.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
    seen: set[tuple[int, int]] = set()

    def combined(lot: list[tuple[bytes, int, int]]) -> Iterator[pa.RecordBatch]:
        texts, ka, kb = map(list, zip(*lot, strict=True))
        told, one = _combine(_contexts_of(texts, ka, kb))
        hot = np.isin(one[0], common)
        parts = [(told, 0), ([y[~hot] for y in one], 1)]
        if hot.any():
            told, one = _combine(_windows([y[hot] for y in one], texts))
            parts += [(told, 0), (one, 1)]
        for x, late in parts:
            key = x[0] if late else x[2] ^ x[4].astype(np.int64)
            for lo in range(0, len(key), 100_000):
                rows = [y[lo : lo + 100_000] for y in (key, np.full(len(key), late, np.int32), *x[:7], x[7] | (late == 0))]
                yield batch_of(names, [pa.array(y) for y in rows], types)

    lot: list[tuple[bytes, int, int]] = []
    size = 0
    for batch in batches:
        for x, y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
            if len(text) >= SPAN and (x, y) not in seen:
                seen.add((x, y))
                lot.append((text, x, y))
                size += len(text) // 60  # about as many contexts
                if size > LOT:
                    yield from combined(lot)
                    lot, size = [], 0
    if lot:
        yield from combined(lot)


_MEET = "ka long, kb long, lo int, hi int, h long, n int, a int, whole boolean"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _emit sorted by (late, h, c). Contexts that occur twice give the run that they cover (h null); of anchors with several
    different contexts, one of each goes on to comparison. Only one row of each context is held."""
    names = ["ka", "kb", "lo", "hi", "h", "n", "a", "whole"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
    held = None

    def compared(x: list[np.ndarray]) -> pa.RecordBatch | None:
        h = x[0]
        if not len(h):
            return None
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        many = np.repeat(np.diff(np.r_[first, len(h)]) > 1, np.diff(np.r_[first, len(h)]))
        if not many.any():
            return None
        h, _, ka, kb, at, n, a, whole = (y[many] for y in x)
        return batch_of(names, [pa.array(y) for y in (ka, kb, at, at + n + SPAN - 1, h, n, a, whole)], types)

    def told(rows: list[np.ndarray]) -> pa.RecordBatch:
        _, _, ka, kb, at, n, _, _ = rows
        zero = pa.array(np.zeros(len(ka), np.int32))
        runs = [pa.array(ka), pa.array(kb), pa.array(at), pa.array((at + n + SPAN - 1).astype(np.int32))]
        return batch_of(names, [*runs, pa.nulls(len(ka), pa.int64()), zero, zero, pa.array(np.ones(len(ka), bool))], types)

    for batch in batches:
        new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, 10)]
        late = batch.column(1).to_numpy() > 0
        if not late.all():
            yield told([y[~late] for y in new])
            new = [y[late] for y in new]
        x = new if held is None else [np.concatenate(p) for p in zip(held, new, strict=True)]
        if not len(x[0]):
            continue
        first = np.flatnonzero(np.r_[True, (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1])])
        counts = np.diff(np.r_[first, len(x[0])])
        twice = np.repeat(counts > 1, counts)
        out = twice & ~x[7]
        if out.any():
            yield told([y[out] for y in x])
        x[7] = x[7] | twice
        x = [y[first] for y in x]
        cut = int(np.searchsorted(x[0], x[0][-1], "left"))
        if (ready := compared([y[:cut] for y in x])) is not None:
            yield ready
        held = [y[cut:] for y in x]
    if held is not None and (ready := compared(held)) is not None:
        yield ready


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, ka, kb, at, n, a, whole, bytes) sorted by h: compare the contexts of each anchor, many anchors at once."""
    names, types = ["ka", "kb", "lo", "hi"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    groups: list[list[tuple]] = []
    size, last = 0, None

    def settle() -> pa.RecordBatch | None:
        found = resolve([[(x[6], x[3], x[4]) for x in g] for g in groups])
        rows = [(x[0], x[1], x[2] + r[0], x[2] + r[1] + SPAN) for g, rs in zip(groups, found, strict=True) for x, r in zip(g, rs, strict=True) if r and not x[5]]
        return batch_of(names, list(map(list, zip(*rows, strict=True))), types) if rows else None

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != last:
                if size > SYMBOLS:
                    if (out := settle()) is not None:
                        yield out
                    groups.clear()
                    size = 0
                last = row[0]
                groups.append([])
            groups[-1].append(row[1:])
            size += min(len(row[7]), 40)
    if groups and (out := settle()) is not None:
        yield out


def removed_runs(docs: DataFrame) -> DataFrame:
    """(ka, kb, lo, hi): runs of bytes that repeated strings cover, of each different text of _named's rows."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    common = common_anchors(docs)
    emitted = docs.select("ka", "kb", "text").mapInArrow(lambda b: _emit(b, common), _EMIT)
    met = stored(emitted.repartition(n, "key").sortWithinPartitions("late", "h", "c").mapInArrow(_meet, _MEET), "contexts")
    asked = met.filter("h IS NOT NULL")
    text = F.encode("text", "UTF-8")
    once = docs.select("ka", "kb", "text").dropDuplicates(["ka", "kb"])  # equal texts are one before they meet what is asked
    fetched = once.join(asked, ["ka", "kb"]).select("h", "ka", "kb", F.col("lo").alias("at"), "n", "a", "whole", F.substring(text, F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("x"))
    fetched = fetched.dropDuplicates(["h", "ka", "kb", "at"])  # contexts that several tasks have met
    settled = fetched.repartition(n, "h").sortWithinPartitions("h").mapInArrow(_settle, "ka long, kb long, lo int, hi int")
    copies = docs.groupBy("ka", "kb").agg(F.count("*").alias("copies"), F.max(F.octet_length("text")).alias("hi")).filter(f"copies > 1 AND hi >= {SPAN}")
    return met.filter("h IS NULL").select("ka", "kb", "lo", "hi").union(stored(settled, "runs")).union(copies.select("ka", "kb", F.lit(0), "hi"))


def _keep(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_text
    for batch in batches:
        rows = []
        for doc_id, text, runs in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            merged: list[list[int]] = []
            for lo, hi in sorted((x["lo"], x["hi"]) for x in runs or ()):
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            edges = [0, *(x for m in merged for x in m), len(text)]
            kept = b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
            rows.append((doc_id, len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest()) + ((kept,) if with_text else ()))
        if rows:
            yield batch_of(names, list(map(list, zip(*rows, strict=True))), types)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]): a row for each row of df, on UTF-8 bytes.

    Null texts are empty; texts under SPAN bytes lose nothing; of equal texts of SPAN bytes or more, all lose all their
    bytes. A null id stays null, repeated rows count as copies, other columns are not read, an empty table stays empty.
    """
    bound_batches(df.sparkSession)
    docs = _named(df, id_col, text_col)
    runs = removed_runs(docs).groupBy("ka", "kb").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    joined = join_dealt(docs, runs, ["ka", "kb"], F.monotonically_increasing_id(), docs.count(), "left").select("doc_id", "text", "runs")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return joined.mapInArrow(lambda b: _keep(b, with_text), schema)
