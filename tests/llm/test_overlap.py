"""The near-duplicate stage against the similarity of all pairs."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from satchel.llm import overlap
from tests.llm.test_operators import prose


def brute_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    sets = [brute_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {rows[k][0] for k in range(len(rows)) if find(k) == k}


@pytest.mark.parametrize("meeting", [2000, 3])
def test_stage_drops_every_copy_of_similarity_of_four_fifths(spark, tmp_path, monkeypatch, meeting):
    monkeypatch.setattr(overlap, "PAIRS", 50)
    monkeypatch.setattr(overlap, "MEETING", meeting)
    monkeypatch.setattr(overlap, "OFTEN", 2)
    r = random.Random(8)
    common = prose(r, 12)
    texts = [None, "", "one two", "one two", "one  TWO three", *(common + " " + prose(r, r.randint(3, 40)) for _ in range(30))]
    for n in (45, 60, 120, 240):
        for changed in (1, 2, 3, 4, 5):
            words = prose(r, n).split()
            texts.append(" ".join(words))
            for k in range(changed):
                words[(k * n) // changed + 3] = f"other{k}"
            texts.append(" ".join(words))
        texts.append(" ".join(words[: -n // 7]))
    base = prose(r, 60).split()
    for k in range(25):  # a group of near copies
        words = list(base)
        words[r.randrange(60)] = f"copy{k}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "src") for i, t in rows], "doc_id long, text string, source string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    found = {x.doc_id for x in kept.collect()}
    assert found == brute_kept(rows) and kept.count() == len(found) < len(rows) - 8


def test_stage_of_odd_rows(spark, odd, none):
    assert corpus_pipeline.drop_near_duplicates(spark, none, "").count() == 0
    got = corpus_pipeline.drop_near_duplicates(spark, odd, "").collect()
    assert sorted(x.doc_id or 0 for x in got) == [0, 1, 3, 4, 6, 7]


def test_meeting_points_of_any_batches():
    r = np.random.default_rng(3)
    rows = sorted({(int(k), -1 if k % 2 else int(d), int(i)) for k, d, i in zip(r.integers(0, 30, 300), r.integers(0, 3, 300), r.integers(0, 12, 300), strict=True)})
    rows = sorted(rows + rows[::7])
    groups = {}
    for k, d, i in rows:
        groups.setdefault((k, d), set()).add(i)
    want = sorted((k, i, min(ids)) for (k, d), ids in groups.items() for i in ids if d >= 0 or len(ids) > 1)
    for size in (1, 2, 5, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[lo : lo + size], strict=True), (pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["key", "deal", "id"]) for lo in range(0, len(rows), size)]
        assert sorted(x for b in overlap._meet(batches) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)) == want


def test_parities_lose_no_similar_pair_and_part_others():
    r = np.random.default_rng(6)
    near, far = [], []
    for n in (1, 5, 40, 300, 1000, 60_000):
        for _ in range(20):
            a = np.unique(r.integers(-(1 << 63), 1 << 63, n))
            changed = r.integers(0, n // 9 + 1)
            near.append((a, np.unique(np.r_[a[changed:], r.integers(-(1 << 63), 1 << 63, changed)])))
            far.append((a, np.unique(r.integers(-(1 << 63), 1 << 63, n))))
    one_part = r.integers(0, 1 << 50, 400)  # more in one part than are counted
    near.append((np.unique(one_part), np.unique(one_part[20:])))
    for pairs in (near, far):
        sizes = [np.array([len(p[k]) for p in pairs]) for k in (0, 1)]
        odd = [list(overlap.parities(np.array([np.frombuffer(overlap.bins(p[k]), np.uint8) for p in pairs])).T) for k in (0, 1)]
        may, are = overlap.near_parities(*sizes, *odd), np.array([overlap.similar(*p) for p in pairs])
        assert (may | ~are).all()
        if pairs is far:
            assert not may[(sizes[0] >= 40) & (sizes[0] <= 300)].any()
        else:
            assert are.all()


def test_fine_bins_lose_no_similar_pair_and_part_others():
    r = np.random.default_rng(7)
    for n in (1, 2, 5, 40, 300, 1023, 1024, 5000, 20_000):
        a = np.unique(r.integers(-(1 << 63), 1 << 63, n))
        for changed in {0, n // 18, n // 9}:
            b = np.unique(np.r_[a[changed:], r.integers(-(1 << 63), 1 << 63, changed)])
            assert overlap.similar(a, b) and overlap.near_fine(overlap.fine(a), overlap.fine(b))
        shorter = np.unique(r.choice(a, -(-4 * n // 5), replace=False))
        assert overlap.similar(a, shorter) and overlap.near_fine(overlap.fine(shorter), overlap.fine(a))
        b = np.unique(np.r_[a[: n // 2], r.integers(-(1 << 63), 1 << 63, n - n // 2)])
        assert n < 40 or not overlap.near_fine(overlap.fine(a), overlap.fine(b))
    near = r.integers(0, 1 << 40, 5000)  # more in one part than are counted
    assert overlap.near_fine(overlap.fine(np.unique(near)), overlap.fine(np.unique(near[100:])))


def test_rows_are_picked_where_they_lie(spark, monkeypatch):
    rows = spark.range(0, 5000, 1, 7).selectExpr("id + (id % 3 << 33) as _row", "'text' as _block")
    want = [r[0] for r in rows.select("_row").collect() if r[0] % 5 == 0 or r[0] % 64 in (0, 63)]
    monkeypatch.setattr(overlap, "stored", lambda df, name: spark.createDataFrame(df.collect(), df.schema))
    got = overlap.picked(rows, "_row", spark.createDataFrame([(x,) for x in want + want[:9]], "_row long"))
    assert sorted(r[0] for r in got.collect()) == sorted(want) and got.columns == rows.columns
    assert "hashpartitioning" not in got._jdf.queryExecution().toString()


def test_pairs_of_a_family_grow_as_its_copies(spark, tmp_path, monkeypatch):
    r = random.Random(5)
    made = []
    stored = overlap.stored
    monkeypatch.setattr(overlap, "stored", lambda df, name: made.append((name, stored(df, name).count())) or stored(df, name))
    base = prose(r, 200).split()
    texts = [" ".join(base)]
    for k in range(60):  # close to the text itself, too far from each other
        words = list(base)
        for at in r.sample(range(0, 200, 8), 4):
            words[at] = f"copy{k}at{at}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert kept == brute_kept(list(enumerate(texts))) == {0}
    assert sum(n for name, n in made if name == "pairs") <= 3 * len(texts)


@pytest.mark.parametrize("cell", [(1, 3), (100, 512)])
def test_sets_come_to_a_cell_once_for_all_of_its_pairs(spark, tmp_path, monkeypatch, cell):
    monkeypatch.setattr(overlap, "CELL", cell)
    monkeypatch.setattr(overlap, "HOT_KEYS", 10**9)
    ids = list(range(-30, 30))
    sets = overlap.stored(spark.createDataFrame([(i, [i, i + 1]) for i in ids], "id long, hashes array<long>"), "sets")
    every = [(u, v, (u + v) % 2) for u, v in itertools.combinations(ids, 2)]
    pairs = overlap.stored(spark.createDataFrame(every, "u long, v long, cell long").repartition(3), "pairs")
    brought, stored = [], overlap.stored
    monkeypatch.setattr(overlap, "stored", lambda df, name: brought.append((name, stored(df, name))) or brought[-1][1])
    rest = object.__new__(overlap.Rest)
    rest.partitions = 2

    def test(known, u, v):
        first = [x[0].as_py() for x in known.column("hashes")]
        return np.array([(first[a] * first[b]) % 3 == 1 for a, b in zip(u, v, strict=True)], bool)

    batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = [tuple(r) for r in rest._at_cells(pairs, sets, ["hashes"], test).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batches)
    assert sorted(got) == sorted(x for x in every if (x[0] * x[1]) % 3 == 1)
    n = sum(df.count() for name, df in brought if name == "needs")
    assert n <= (2 * len(every) if cell[1] == 3 else len(every) / 2)
