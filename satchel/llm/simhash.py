"""SimHash near-duplicates by anchor-point covering.

A document's fingerprint holds, for each of 64 bits, the majority of its word shingles' hashes. Fingerprints that differ
in at most THRESHOLD bits link. Cut into `blocks` blocks, two such fingerprints differ in at most t = THRESHOLD //
blocks bits of some block. The anchors of a block are the words of a covering code: a perfect Hamming code, times all
values of the bits left over; its covering radius is one. A fingerprint has its home at the anchor nearest to it and is
replicated to every anchor within radius + t; whatever it links to in that block is at home in one of those. Per
anchor, homes are compared with replicas on all 64 bits, and only a spanning forest of the links found leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import overlap
from .common import as_bytes, batch_of, bound_batches, join_dealt, keyed, map_batches, stored, tidy
from .components import components

BITS, THRESHOLD, SHINGLE, SEED = 64, 4, 4, 42
BLOCKS = 3
#: Pairs that a task compares at once, and rows of an anchor from which its homes are dealt out to several groups.
PAIRS, HOT_ROWS = 1 << 19, 100_000


def majority(hashes: np.ndarray) -> int:
    """64 bits as a signed number: set where over half of the hashes have the bit; zero for none."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits: set where over half of the shingle hashes have the bit. No word: zero. Fewer words: one shingle."""
    return majority(overlap.shingle_hashes(text, shingle, seed))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long, a row for each row of df."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch_of(["doc_id", "fp"], [batch.column(0), [fingerprint(x) for x in as_bytes(batch.column(1))]], [pa.int64(), pa.int64()])

    return map_batches(keyed(df, id_col, text_col), run, "doc_id long, fp long")


@cache
def _block(width: int, reach: int) -> tuple[np.ndarray, list[np.ndarray], int]:
    """(column syndromes, flips to every anchor within reach by syndrome, number of code bits) of blocks of that width."""
    order = (width + 1).bit_length() - 1
    code = (1 << order) - 1  # a perfect Hamming code of that length; bit k has syndrome k + 1
    near: list[list[int]] = [[] for _ in range(code + 1)]
    for n in range(reach + 1):
        for flips in combinations(range(width), n):
            syndrome, mask = 0, 0
            for k in flips:
                mask |= 1 << k
                if k < code:
                    syndrome ^= k + 1
            near[syndrome].append(mask)
    return np.arange(1, code + 1), [np.array(x, np.int64) for x in near], code


def anchors(fps: np.ndarray, blocks: int = BLOCKS, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, home) of every placement of the fingerprints; exactly one home a block and fingerprint."""
    keys, rows, homes = [], [], []
    low = 0
    for b in range(blocks):
        width = BITS // blocks + (b < BITS % blocks)
        columns, near, code = _block(width, 1 + threshold // blocks)
        value = ((fps >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
        syndrome = np.zeros(len(fps), np.int64)
        for k in range(code):
            syndrome ^= ((value >> k) & 1) * columns[k]
        home = np.where(syndrome > 0, value ^ (np.int64(1) << np.maximum(syndrome - 1, 0)), value)
        keys.append(home * blocks + b)
        rows.append(np.arange(len(fps)))
        homes.append(np.ones(len(fps), bool))
        for s in range(code + 1):
            at = np.flatnonzero(syndrome == s)
            if len(at) and len(near[s]):
                keys.append(((value[at, None] ^ near[s][None, :]) * blocks + b).ravel())
                rows.append(np.repeat(at, len(near[s])))
                homes.append(np.zeros(len(at) * len(near[s]), bool))
        low += width
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(homes)


class Forest:
    """Spanning edges of the links seen so far: bounded by the nodes, whatever the number of links."""

    def __init__(self) -> None:
        self.u = self.v = np.zeros(0, np.int64)

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        if not len(u):
            return
        u, v = np.concatenate([self.u, u]), np.concatenate([self.v, v])
        nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = index[: len(u)], index[len(u) :]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            while (new[new] != new).any():
                new = new[new]
            if (new == root).all():
                break
            root = new
        moved = root != np.arange(len(nodes))
        self.u, self.v = nodes[moved], nodes[root[moved]]


def _compare(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, home) sorted by key: compare homes and replicas of each key, a bounded number of pairs at once."""
    forest, held = Forest(), []

    def settle(keys: np.ndarray, fps: np.ndarray, home: np.ndarray) -> None:
        edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[edges, len(keys)])
        group = np.repeat(np.arange(len(edges)), sizes)
        replicas = np.flatnonzero(~home)
        counts = np.bincount(group[replicas], minlength=len(edges))
        first = np.r_[0, np.cumsum(counts)[:-1]]
        own = np.flatnonzero(home & (counts[group] > 0))
        todo = counts[group[own]]
        ends = np.cumsum(todo)
        lo = 0
        while lo < len(own):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
            part, n = own[lo:hi], todo[lo:hi]
            left = np.repeat(fps[part], n)
            within = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
            right = fps[replicas[np.repeat(first[group[part]], n) + within]]
            hit = (np.bitwise_count(left ^ right) <= threshold) & (left < right)
            forest.add(left[hit].view(np.int64), right[hit].view(np.int64))
            lo = hi

    for batch in batches:
        held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
        keys = held[-1][0]
        if len(keys) and held[0][0][0] != keys[-1]:
            joined = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(joined[0], joined[0][-1], "left"))
            settle(joined[0][:cut], joined[1][:cut].view(np.uint64), joined[2][:cut])
            held = [[x[cut:] for x in joined]]
    if held:
        joined = [np.concatenate(x) for x in zip(*held, strict=True)]
        if len(joined[0]):
            settle(joined[0], joined[1].view(np.uint64), joined[2])
    for k in range(0, len(forest.u), 50_000):
        yield batch_of(["u", "v"], [pa.array(forest.u[k : k + 50_000]), pa.array(forest.v[k : k + 50_000])], [pa.int64(), pa.int64()])


def links(fps: DataFrame, threshold: int = THRESHOLD, blocks: int = BLOCKS) -> DataFrame:
    """Spanning links (u, v) of distinct fingerprints (fp): those of all pairs within threshold have the same components.

    An anchor with more than HOT_ROWS rows has its homes dealt out to several groups, each with all of its replicas.
    """
    spark = fps.sparkSession
    bound_batches(spark)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(values), 2000):
                part = values[lo : lo + 2000]
                key, row, home = anchors(part.view(np.uint64), blocks, threshold)
                yield batch_of(["key", "fp", "home"], [pa.array(key), pa.array(part[row]), pa.array(home)], [pa.int64(), pa.int64(), pa.bool_()])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _compare(batches, threshold)

    placed = fps.select("fp").mapInArrow(tidy(place), "key long, fp long, home boolean")
    sizes = stored(placed.groupBy("key").count().filter(F.col("count") > HOT_ROWS), "hot-anchors")
    if not sizes.isEmpty():
        deals = sizes.select("key", F.ceil(F.col("count") / HOT_ROWS).cast("int").alias("deals"))
        salted = placed.join(deals, "key", "left").withColumn("deals", F.coalesce("deals", F.lit(1)))
        one = F.array(F.pmod(F.xxhash64("fp"), F.col("deals")).cast("int"))
        salted = salted.withColumn("deal", F.explode(F.when(F.col("home"), one).otherwise(F.sequence(F.lit(0), F.col("deals") - 1))))
        placed = salted.select(F.when(F.col("deals") == 1, F.col("key")).otherwise(F.xxhash64("key", "deal")).alias("key"), "fp", "home")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(tidy(compare), "u long, v long")


def group_fingerprints(fps: DataFrame, threshold: int = THRESHOLD, blocks: int = BLOCKS) -> DataFrame:
    """(fp, root) of every distinct fingerprint that links to another one."""
    return components(links(fps, threshold, blocks)).withColumnRenamed("node", "fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of df; component_id is the least doc_id reachable.

    Null and empty texts have fingerprint zero and link like any other. Null ids are kept; a component of null ids alone
    has a null component_id. Other columns are not read. An empty table gives an empty table.
    """
    own = stored(fingerprints(df, id_col, text_col), "fingerprints")
    distinct = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    total = own.count()
    roots = stored(group_fingerprints(distinct, threshold), "roots")
    rooted = stored(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    named = join_dealt(rooted, rooted.groupBy("root").agg(F.min("first").alias("component_id")), ["root"], F.col("fp"), total).select("fp", "component_id")
    joined = join_dealt(own, named, ["fp"], F.monotonically_increasing_id(), total)
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, shingle: int = overlap.SHINGLE) -> DataFrame:
    """df with one row of each group of near-duplicates: that of the least id, nulls last, ties by place. Columns stay.

    Texts are near-duplicates if their shingles of `shingle` words have a Jaccard similarity of 0.8 or more, directly or
    by steps. Anchor-point covering brings together texts whose fingerprints differ in at most `threshold` bits, and every
    such link is verified on the shingles. Similar texts often differ in more bits than any anchor can cover (about ten
    of 64 at 0.8), so what is still apart is then joined by `overlap`, which finds every pair that is left.

    Null and empty texts are one group. Repeated rows are copies. An empty table gives an empty table. Columns of any name
    may be there; of rows with one id and equal texts, the one that stands first in the table stays.
    """
    marked = overlap.marked(df, id_col, text_col, shingle, majority)
    sets = overlap.one_a_set(marked)
    full = sets.filter("id <> 0")
    by_fp = stored(full.groupBy("fp").agg(F.min("id").alias("least")), "by-fingerprint")
    equal = join_dealt(full.select("fp", F.col("id").alias("u")), by_fp.withColumnRenamed("least", "v"), ["fp"], F.col("u"), full.count()).select("u", "v")
    close = stored(links(by_fp.select("fp"), threshold), "links")
    n = close.count()
    for end, other in (("u", "v"), ("v", "u")):
        close = join_dealt(close, by_fp.select(F.col("fp").alias(end), F.col("least").alias(f"_{end}")), [end], F.col(other), n)
    close = close.select(F.col("_u").alias("u"), F.col("_v").alias("v"))
    candidates = stored(equal.filter("u <> v").union(close), "candidates")
    roots = overlap.Rest(marked, sets, shingle).components(candidates)
    rooted = sets.select("id", "rank", "row").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    best = rooted.groupBy("root").agg(F.min(F.struct("rank", "row")).alias("best")).select(F.col("best.row").alias(marked.row))
    return overlap.picked(marked.rows, marked.row, best).select(*df.columns)
