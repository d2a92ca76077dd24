import pytest
from pyspark.sql import Row

#: Names that operators use inside or give their results: as extra columns of the input they must not matter.
CLASHING = ("score", "fp", "h", "ka", "length", "piece", "spans", "media", "component_id", "_n", "page_id2", "_fp", "_RANK", "_key", "_new", "_spans", "run", "rank", "_set", "_row", "_size", "_bins", "_deal", "_deals", "_text", "_t", "_id", "_y", "id", "u", "v", "root", "node", "candidate", "before", "after", "path", "start", "_first", "item_id", "at", "_at", "base")


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty texts, a null id, repeated rows, a very long text, ties and clashing column names."""
    long = " ".join(f"word{k % 977} idiot{k % 13}" for k in range(60_000))
    texts = [(1, None), (2, ""), (None, "a text without an id released under the MIT license"), (3, "twice the same row, twice the same row"), (3, "twice the same row, twice the same row"), (4, long), (5, "   \n\t "), (6, "café 东京 \U0001f600 naïve"), (7, "x" * 5000)]
    rows = [Row(doc_id=i, text=t, lang=None, source="src", n_chars=None if t is None else len(t), **dict.fromkeys(CLASHING, "clash")) for i, t in texts]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame(rows, kind)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
