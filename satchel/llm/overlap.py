"""All pairs of texts whose word shingles have a Jaccard similarity of at least 0.8, exactly: what SimHash leaves.

Equal sets of shingles count as one. The shingles of a set stand in one order for all sets: those seen often last, then by
hash. Two sets of n and k shingles that are similar enough share at least 4/9 (n + k) of them, so their first shared
shingle stands among the first n - ceil(0.8 n) + 1 of either: sets meet at those. Links that are known join sets into
components, and only pairs of different components are looked at: first every set with the head that it meets most
often, then, with what that has joined, all others. The head of what meets at one place is the set that holds most shingles
seen often: near copies of one text differ from it less than from each other, and in shingles of their own, so it is that text. A pair is a candidate if its sizes allow the similarity and so do
the numbers of its shingles in each of BINS parts of the hash space, then of as many parts as it has shingles, which bound what
it shares from above. Where sets
meet, the parities of these numbers tell most of this already: each part in which they differ holds a shingle of one set
alone. Every candidate is verified on the whole sets. Neither the order nor the bounds lose a pair.

Pairs are looked at in cells: what meets at one place, or about one set, lies together, and what a set is known by comes
to a cell once for all of its pairs there, not once for each pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import HOT_KEYS
from .common import as_bytes, batch_of, bound_batches, fresh_name, join_dealt, lots, release, stored, tidy
from .components import components

SHINGLE, SEED = 5, 42
#: Pairs that a task looks at, and shingles that it counts, at once.
PAIRS, COUNTED = 1 << 17, 1 << 20
#: Shingles in at least OFTEN sets of one count go last; of these, the most frequent COMMON. Others keep the order of their hashes.
OFTEN, COMMON = 4, 1 << 17
#: Sets at one meeting point that a task takes, about; parts of the hash space in which shingles are counted.
MEETING, BINS, MOST = 2000, 256, 255
#: Bytes of texts that a task cuts into shingles at once.
LOT_BYTES = 1 << 20
#: Pairs that a task holds before it drops those that it has twice.
HELD = 1 << 20
#: Pairs of a cell: about a quarter of a task's, within these bounds; larger cells are cut into squares.
CELL = (100, 512)


def shingle_hashes(text: bytes, size: int, seed: int = SEED) -> np.ndarray:
    """Hashes of the word shingles in order, repeats included. No word: none. Fewer words: one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    size = min(size, len(words))
    stops = ends[size - 1 :].tolist()
    starts = [0, *(ends[: len(words) - size] + 1).tolist()]
    xx = xxhash.xxh64_intdigest
    return np.array([xx(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64)


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles, as signed numbers."""
    return np.unique(shingle_hashes(text, size).view(np.int64))


def digest(hashes: np.ndarray) -> int:
    """A signed long that stands for the set; zero for the empty one alone."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64)) or 1 if len(hashes) else 0


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of at least 0.8."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def bins(hashes: np.ndarray) -> bytes:
    """How many of the hashes lie in each part of the hash space, MOST standing for any larger number."""
    return np.minimum(np.bincount(hashes.view(np.uint64) >> np.uint64(56), minlength=BINS), MOST).astype(np.uint8).tobytes()


def possible(size_a: np.ndarray, size_b: np.ndarray, bins_a: np.ndarray, bins_b: np.ndarray) -> np.ndarray:
    """Which pairs of sets may have the similarity, by their sizes and by the most that they can share in each part."""
    shared = np.minimum(bins_a, bins_b)
    ok = (9 * shared.sum(axis=1, dtype=np.int64) >= 4 * (size_a + size_b)) | (shared == MOST).any(axis=1)
    return ok & of_a_size(size_a, size_b)


def fine(hashes: np.ndarray) -> bytes:
    """As bins, in about as many parts as there are hashes: an eighth of their bytes."""
    bits = max(1, len(hashes).bit_length() - 1)
    return np.minimum(np.bincount(hashes.view(np.uint64) >> np.uint64(64 - bits), minlength=1 << bits), MOST).astype(np.uint8).tobytes()


def near_fine(a: bytes, b: bytes) -> bool:
    """Whether two sets may have the similarity, by the most that they can share in each part; MOST or more is any number."""
    x, y = sorted((np.frombuffer(c, np.uint8).astype(np.int64) for c in (a, b)), key=len)
    if max(x.max(), y.max()) == MOST:
        return True
    y = y.reshape(len(x), -1).sum(axis=1)
    return bool(9 * np.minimum(x, y).sum() >= 4 * (x.sum() + y.sum()))


def of_a_size(size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    return 5 * np.minimum(size_a, size_b) >= 4 * np.maximum(size_a, size_b)


PARITIES = [f"p{k}" for k in range(BINS // 64)]


def parities(bins_: np.ndarray) -> np.ndarray:
    """BINS bits of each row of numbers: which of them are odd, as rows of longs."""
    return np.packbits(bins_ & 1, axis=1).view(np.int64)


def near_parities(size_a: np.ndarray, size_b: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sets may have the similarity by the parities of their numbers; a number of MOST or more has any parity."""
    odd = sum(np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int64) for x, y in zip(a, b, strict=True))
    return 9 * (odd - size_a // MOST - size_b // MOST) <= size_a + size_b


def _bins_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


@dataclass
class Marked:
    """A stored table of texts with more columns: digest, size and bins of each text's set, fingerprint, row number, rank."""

    rows: DataFrame
    text: str
    group: str
    size: str
    bins: str
    fp: str
    row: str
    rank: str


def marked(df: DataFrame, id_col: str, text_col: str, shingle: int, sketch: Callable[[np.ndarray], int]) -> Marked:
    group, size, parts, fp, row, rank = (fresh_name(df, x) for x in ("set", "size", "bins", "fp", "row", "rank"))
    at = df.columns.index(text_col)
    bound_batches(df.sparkSession)
    zero = F.lit(0).cast("long")
    schema = df.withColumns({group: zero, size: zero, parts: F.lit(b""), fp: zero}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in lots(whole.column(at), LOT_BYTES):
                batch = whole.slice(lo, hi - lo)
                hashes = [shingle_hashes(x, shingle) for x in as_bytes(batch.column(at))]
                sets = [np.unique(h.view(np.int64)) for h in hashes]
                columns = [([digest(x) for x in sets], pa.int64()), ([len(x) for x in sets], pa.int64()), ([bins(x) for x in sets], pa.binary()), ([sketch(h) for h in hashes], pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(*x) for x in columns)], names=[*batch.schema.names, group, size, parts, fp])

    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).cast("long").alias("id"))
    rows = df.mapInArrow(tidy(run), schema).withColumn(row, F.monotonically_increasing_id()).withColumn(rank, order)
    return Marked(stored(rows, "marked"), text_col, group, size, parts, fp, row, rank)


def picked(rows: DataFrame, row: str, wanted: DataFrame) -> DataFrame:
    """The rows whose number is among those of wanted (row), where they lie: 64 numbers are the bits of one broadcast word.

    What the result reads besides rows is in its `read`.
    """
    block, word = fresh_name(rows, "block"), fresh_name(rows, "word")
    bit = f"cast(`{row}` & 63 as int)"
    bits = stored(wanted.groupBy(F.shiftright(row, 6).alias(block)).agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias(word)), "bits")
    out = rows.withColumn(block, F.shiftright(row, 6)).join(F.broadcast(bits), block).filter(F.expr(f"getbit(`{word}`, {bit}) = 1")).drop(block, word)
    out.read = (bits,)
    return out


def one_a_set(m: Marked) -> DataFrame:
    """(id, rank, row, fp, size, bins): one row for each different set, of the row of the least rank that has it; stored."""
    first = F.min(F.struct(m.rank, m.row)).alias("first")
    sets = m.rows.groupBy(F.col(m.group).alias("id")).agg(first, F.min(m.fp).alias("fp"), F.min(m.size).alias("size"), F.min(m.bins).alias("bins"))
    return stored(sets.select("id", F.col(f"first.{m.rank}").alias("rank"), F.col(f"first.{m.row}").alias("row"), "fp", "size", "bins"), "sets")


def _sets_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(digest, hashes) of the rows (digest, text) of a task, equal sets once, without the empty one."""
    seen = {0}
    for batch in batches:
        for k, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            if k not in seen:
                seen.add(k)
                yield k, shingles(text, size)


def common_shingles(texts: DataFrame, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of shingles seen often, by hash: a bounded number, for the order and the dealing alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size_ = [], 0

        def settle() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= OFTEN
            return batch_of(["h", "n"], [pa.array(values[often]), pa.array(counts[often])], [pa.int64(), pa.int64()])

        for _, hashes in _sets_of(batches, size):
            held.append(hashes)
            size_ += len(hashes)
            if size_ >= COUNTED:
                yield settle()
                held, size_ = [], 0
        if held:
            yield settle()

    counts = texts.mapInArrow(tidy(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.col("n").desc(), "h").limit(COMMON).toArrow()
    values, counts = (top.column(k).to_numpy() for k in ("h", "n"))
    order = np.argsort(values)
    return values[order], counts[order]


def prefix(hashes: np.ndarray, values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of the set, in the order of all sets, that a similar set must share one of, and their counts."""
    weight = np.zeros(len(hashes), np.int64)
    if len(values):
        at = np.minimum(np.searchsorted(values, hashes), len(values) - 1)
        weight = np.where(values[at] == hashes, counts[at], 0)
    first = np.lexsort((hashes, weight))[: len(hashes) - -(-4 * len(hashes) // 5) + 1]
    return hashes[first], weight[first]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, deal, id) sorted by key and deal, equal ids together: those of keys that are dealt or that several sets hold,
    with the first id that is there as the least.

    Nothing is held but the last row.
    """
    last = None  # the last (key, deal, id, least id of its group) and whether it has been given out
    for batch in batches:
        if not batch.num_rows:
            continue
        key, deal, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        if last is not None:
            key, deal, ids = np.r_[last[0], key], np.r_[last[1], deal], np.r_[last[2], ids]
        once = np.r_[True, (key[1:] != key[:-1]) | (deal[1:] != deal[:-1]) | (ids[1:] != ids[:-1])]
        key, deal, ids = key[once], deal[once], ids[once]
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (deal[1:] != deal[:-1])])
        sizes = np.diff(np.r_[first, len(key)])
        least = np.repeat(ids[first], sizes)
        if last is not None:
            least[: sizes[0]] = last[3]
        given = np.repeat(sizes > 1, sizes) | (deal >= 0) | (least != ids)
        out = given.copy()
        out[0] &= last is None or not last[4]
        if out.any():
            yield batch_of(["key", "id", "least"], [pa.array(key[out]), pa.array(ids[out]), pa.array(least[out])], [pa.int64()] * 3)
        last = (key[-1:], deal[-1:], ids[-1:], least[-1], bool(given[-1]))


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v, hub) of sets of like sizes and parities from rows (hub, key, deal, root, main, id, size, parities) sorted by hub, key, deal and root.

    Of each group of one key and deal, pairs of different roots; those without the main root are given by deal 0 alone.
    """
    found: list[np.ndarray] = []

    def settle() -> Iterator[pa.RecordBatch]:
        once = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((3, 0), np.int64)
        found.clear()
        for k in range(0, once.shape[1], 50_000):
            yield batch_of(["u", "v", "hub"], [pa.array(x[k : k + 50_000]) for x in once], [pa.int64()] * 3)

    def pairs(x: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hub, key, deal, root, main, ids, size, *odd = x
        new = np.r_[True, (key[1:] != key[:-1]) | (deal[1:] != deal[:-1])]
        stop = np.r_[np.flatnonzero(new)[1:], len(key)][np.cumsum(new) - 1]
        other = np.r_[True, new[1:] | (root[1:] != root[:-1])]
        after = np.r_[np.flatnonzero(other)[1:], len(key)][np.cumsum(other) - 1]
        n = stop - after
        ends = np.cumsum(n)
        lo = 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
            own = n[lo:hi]
            left = np.repeat(np.arange(lo, hi), own)
            right = np.repeat(after[lo:hi], own) + np.arange(len(left)) - np.repeat(np.cumsum(own) - own, own)
            ok = (deal[left] == 0) | (root[left] == main[left]) | (root[right] == main[right])
            ok &= of_a_size(size[left], size[right])
            left, right = left[ok], right[ok]
            ok = near_parities(size[left], size[right], [p[left] for p in odd], [p[right] for p in odd])
            u, v = ids[left[ok]], ids[right[ok]]
            found.append(np.unique(np.stack([np.minimum(u, v), np.maximum(u, v), hub[left[ok]]]), axis=1))
            if sum(y.shape[1] for y in found) > HELD:
                found[:] = [np.unique(np.concatenate(found, axis=1), axis=1)]
                if found[0].shape[1] > HELD // 2:
                    yield from settle()
            lo = hi

    held: list[list] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(7 + len(PARITIES))])
        if (held[0][1][0], held[0][2][0]) != (held[-1][1][-1], held[-1][2][-1]):
            joined = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.flatnonzero((joined[1] != joined[1][-1]) | (joined[2] != joined[2][-1]))[-1]) + 1
            yield from pairs([x[:cut] for x in joined])
            held = [[x[cut:] for x in joined]]
    if held:
        yield from pairs([np.concatenate(x) for x in zip(*held, strict=True)])
    yield from settle()


class Rest:
    """Joins what candidates found by other means leave apart. `sets` is what one_a_set gives."""

    def __init__(self, rows: Marked, sets: DataFrame, shingle: int = SHINGLE) -> None:
        self.marked, self.sets, self.shingle = rows, sets, shingle
        self.spark = sets.sparkSession
        self.partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        bound_batches(self.spark)

    def _met(self) -> DataFrame:
        """(key, id, least): sets at their meeting points, those that meet no other left out; least is one of the ids there.

        It is that of the set with most shingles seen often among its first ones, of several the least. A shingle that many
        sets hold is dealt to several groups, each with one of its own.
        """
        texts = self.marked.rows.select(self.marked.group, self.marked.text)
        values, counts = common_shingles(texts, self.shingle)
        shingle = self.shingle

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def settle(rows: list) -> pa.RecordBatch:
                keys, weights = (np.concatenate(x) for x in zip(*((k, w) for _, k, w in rows), strict=True))
                ids = np.repeat([i for i, *_ in rows], [len(k) for _, k, _ in rows])
                deals = np.maximum(1, weights // MEETING)
                mixed = (ids.view(np.uint64) >> np.uint64(20)).astype(np.int64)
                deal = np.where(deals > 1, mixed % deals, -1).astype(np.int32)
                often = np.repeat(np.array([np.count_nonzero(w) for *_, w in rows], np.int32), [len(k) for _, k, _ in rows])
                return batch_of(["key", "deal", "often", "id"], [pa.array(keys), pa.array(deal), pa.array(often), pa.array(ids)], [pa.int64(), pa.int32(), pa.int32(), pa.int64()])

            held, size = [], 0
            for k, hashes in _sets_of(batches, shingle):
                held.append((k, *prefix(hashes, values, counts)))
                size += len(held[-1][1])
                if size >= 50_000:
                    yield settle(held)
                    held, size = [], 0
            if held:
                yield settle(held)

        placed = texts.mapInArrow(tidy(place), "key long, deal int, often int, id long").repartition(self.partitions, "key", "deal")
        headed = placed.sortWithinPartitions("key", "deal", F.desc("often"), "id").select("key", "deal", "id")
        return stored(headed.mapInArrow(tidy(_meet), "key long, id long, least long"), "met")

    def _at_cells(self, pairs: DataFrame, table: DataFrame, names: list[str], test: Callable[[pa.Table, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
        """The pairs (u, v, cell) of a stored table that the test passes, by columns `names` of table (id, ...).

        test takes rows of table and, for each pair, the places of its two sets there. What the result reads is in its `read`.
        """
        total = pairs.count()
        most = max(min(max(CELL[0], total // (4 * self.partitions)), CELL[1]), total // HOT_KEYS)
        large = pairs.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("cell", F.ceil(F.sqrt(F.col("n") / most)).cast("long").alias("side"))
        side = F.coalesce("side", F.lit(1).cast("long"))
        at = F.xxhash64("cell", F.pmod(F.xxhash64("u"), side), F.pmod(F.xxhash64("v"), side))
        placed = stored(pairs.join(F.broadcast(large), "cell", "left").select(at.alias("at"), "u", "v", "cell"), "placed")
        needs = stored(placed.select("at", F.col("u").alias("id")).union(placed.select("at", "v")).distinct(), "needs")
        known = join_dealt(needs, table.select("id", *names), ["id"], F.col("at"), needs.count())
        none = F.lit(None).cast("long")
        rows = known.select("at", F.lit(False).alias("pair"), F.col("id").alias("u"), none.alias("v"), none.alias("cell"), *names)
        rows = rows.union(placed.select("at", F.lit(True), "u", "v", "cell", *[F.lit(None).cast(table.schema[x].dataType) for x in names]))

        def settle(whole: pa.Table) -> Iterator[pa.RecordBatch]:
            pair = whole.column("pair").to_numpy()
            own, asked = whole.filter(pa.array(~pair)), whole.filter(pa.array(pair))
            place = {x: k for k, x in enumerate(zip(own.column("at").to_pylist(), own.column("u").to_pylist(), strict=True))}
            cells = asked.column("at").to_pylist()
            u, v = (np.array([place[x] for x in zip(cells, asked.column(end).to_pylist(), strict=True)], int) for end in ("u", "v"))
            yield from asked.select(["u", "v", "cell"]).filter(pa.array(test(own, u, v), pa.bool_())).combine_chunks().to_batches()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                held.append(batch)
                cells = batch.column(0).to_numpy()
                if held[0].column(0)[0].as_py() != cells[-1]:
                    cut = sum(x.num_rows for x in held[:-1]) + int(np.r_[-1, np.flatnonzero(cells != cells[-1])][-1]) + 1
                    whole = pa.Table.from_batches(held)
                    yield from settle(whole.slice(0, cut))
                    held = whole.slice(cut).to_batches()
            if held:
                yield from settle(pa.Table.from_batches(held))

        out = rows.repartition(self.partitions, "at").sortWithinPartitions("at", "pair").mapInArrow(tidy(run), "u long, v long, cell long")
        out.read = (placed, needs)
        return out

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) of a stored table (u, v, cell) whose sets are similar, stored: first by sizes and bins, then by finer bins, then by the sets."""
        shingle, m = self.shingle, self.marked

        def may(sets: pa.Table, u: np.ndarray, v: np.ndarray) -> np.ndarray:
            size, parts = sets.column("size").to_numpy(), _bins_of(sets.column("bins"))
            return possible(size[u], size[v], parts[u], parts[v])

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo, hi in lots(whole.column(1), LOT_BYTES):
                    batch = whole.slice(lo, hi - lo)
                    sets = [shingles(x, shingle) for x in as_bytes(batch.column(1))]
                    yield batch_of(["id", "fine", "hashes"], [batch.column(0), [fine(x) for x in sets], sets], [pa.int64(), pa.binary(), pa.list_(pa.int64())])

        def close(sets: pa.Table, u: np.ndarray, v: np.ndarray) -> np.ndarray:
            parts = sets.column("fine").to_pylist()
            return np.array([near_fine(parts[a], parts[b]) for a, b in zip(u, v, strict=True)], bool)

        def same(sets: pa.Table, u: np.ndarray, v: np.ndarray) -> np.ndarray:
            hashes = [x.values.to_numpy() for x in sets.column("hashes")]
            return np.array([similar(hashes[a], hashes[b]) for a, b in zip(u, v, strict=True)], bool)

        first = self._at_cells(pairs, self.sets, ["size", "bins"], may)
        left = stored(first, "possible")
        nodes = left.select(F.col("u").alias("id")).union(left.select("v")).distinct()
        found = picked(m.rows.select(m.group, m.text, m.row), m.row, self.sets.join(nodes, "id", "left_semi").select(F.col("row").alias(m.row)))
        texts = found.select(F.col(m.group).alias("id"), m.text)
        hashes = stored(texts.mapInArrow(tidy(hashed), "id long, fine binary, hashes array<long>"), "hashes")
        second = self._at_cells(left, hashes, ["fine"], close)
        few = stored(second, "close")
        last = self._at_cells(few, hashes, ["hashes"], same)
        out = stored(last.select("u", "v"), "verified")
        for x in (pairs, left, few, hashes, *found.read, *first.read, *second.read, *last.read):
            release(x)
        return out

    def components(self, candidates: DataFrame) -> DataFrame:
        """(node, root) of all sets that are similar to another, directly or by steps; candidates (u, v) are tried first."""
        links = self._verified(stored(candidates.select("u", "v", F.col("v").alias("cell")), "tried"))
        release(candidates)
        met = self._met()
        least = met.groupBy("key").agg(F.min("least").alias("_all"))
        # Of each set one pair, with the head that it meets most often: as many as sets, however many share a passage.
        often = met.filter("id <> least").groupBy("id", "least").agg(F.count("*").alias("n"))
        stars = often.groupBy(F.col("id").alias("u")).agg(F.max_by("least", F.struct("n", "least")).alias("v"))
        across = met.select("key", "least").distinct().join(least, "key").filter("least <> _all").select(F.col("least").alias("u"), F.col("_all").alias("v"))
        apart = self._apart(stored(stars.union(across).distinct(), "stars"), stored(components(links), "roots"))
        links = stored(links.union(self._verified(stored(apart, "apart"))), "links")
        roots = stored(components(links), "roots")
        last = self._verified(stored(self._pairs(met, roots), "pairs"))
        out = stored(components(links.union(last)), "components")
        for x in (met, links, roots, last):
            release(x)
        return out

    def _apart(self, pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """The pairs (u, v) that no component joins, in the cells of v."""
        total = pairs.count()
        out = join_dealt(pairs, roots.select(F.col("node").alias("u"), F.col("root").alias("_a")), ["u"], F.col("v"), total, "left")
        out = join_dealt(out, roots.select(F.col("node").alias("v"), F.col("root").alias("_b")), ["v"], F.col("u"), total, "left")
        return out.filter("coalesce(_a, u) <> coalesce(_b, v)").select("u", "v", F.col("v").alias("cell"))

    def _odd(self) -> DataFrame:
        """(id, size, parities) of all sets."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    bits = parities(_bins_of(batch.column(2)))
                    yield batch_of(["id", "size", *PARITIES], [batch.column(0), batch.column(1), *(pa.array(x) for x in bits.T)], [pa.int64()] * (2 + len(PARITIES)))

        return self.sets.select("id", "size", "bins").mapInArrow(tidy(run), f"id long, size long, {', '.join(f'{p} long' for p in PARITIES)}")

    def _pairs(self, met: DataFrame, roots: DataFrame) -> DataFrame:
        """Candidates (u, v, cell), u < v, of different components that share a meeting point."""
        total = met.count()
        rooted = join_dealt(met.select("key", "id", "least"), roots.withColumnRenamed("node", "id"), ["id"], F.col("key"), total, "left")
        rooted = stored(rooted.withColumn("root", F.coalesce("root", "id")), "rooted")
        sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("n"), F.min("least").alias("hub"))
        mixed = sizes.groupBy("key").agg(F.max_by("root", "n").alias("main"), F.sum("n").alias("n"), F.min("hub").alias("hub"), F.min("root").alias("_lo"), F.max("root").alias("_hi"))
        mixed = mixed.filter("_lo <> _hi").select("key", "hub", "main", F.ceil(F.col("n") / MEETING).cast("int").alias("deals"))
        rows = join_dealt(rooted.drop("least"), mixed, ["key"], F.col("id"), total)
        rows = join_dealt(rows, self._odd(), ["id"], F.col("key"), total)
        own = F.array(F.pmod(F.xxhash64("id"), F.col("deals")).cast("int"))
        rows = rows.withColumn("deal", F.explode(F.when(F.col("root") == F.col("main"), own).otherwise(F.sequence(F.lit(0), F.col("deals") - 1))))
        # Texts that share one shingle often share many: what has one hub lies together, so its pairs are told once.
        rows = rows.select("hub", "key", "deal", "root", "main", "id", "size", *PARITIES).repartition(self.partitions, "hub", "deal").sortWithinPartitions("hub", "key", "deal", "root")
        return rows.mapInArrow(tidy(_across), "u long, v long, hub long").groupBy("u", "v").agg(F.min("hub").alias("cell"))
