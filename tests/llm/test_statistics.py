"""Scores of test items do not depend on the number of indexes."""

import random

from satchel.llm import decontaminate
from tests.llm.test_operators import prose


def test_scores_are_those_of_one_index(spark, monkeypatch):
    r = random.Random(10)
    items = [(k, prose(r, r.randint(8, 70))) for k in range(60)]
    texts = []
    for k in range(0, 60, 2):
        words = items[k][1].split()
        texts.append((k, prose(r, 30) + " " + " ".join(words[: len(words) - k % 4]) + " " + prose(r, 30)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 3000)
    assert len(list(decontaminate.indexes(bench))) > 2
    split = sorted(map(tuple, decontaminate.leaks(docs, bench).collect()))
    assert len(whole) > 15 and [x[:2] + x[3:] for x in split] == [x[:2] + x[3:] for x in whole]
    assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(split, whole, strict=True))
