"""The pipeline on a small table with one planted case for each stage."""

import random

import corpus_pipeline
from tests.llm.test_operators import prose, toxic_corpus


def test_stages_take_effect(spark, odd, none, tmp_path):
    r = random.Random(1)
    item = prose(r, 30)
    rows = [(i, t, y) for i, t, y in toxic_corpus()]
    base = [(1000, "clean " + prose(r, 120)), (1001, None), (1003, prose(r, 50) + " " + item), (1004, f"{prose(r, 30)} password=b7db7aa4a5fcc78305 {prose(r, 30)}")]
    base.append((1002, base[0][1]))
    docs = [(i, t, "en", "src", len(t or "")) for i, t, *_ in [*rows, *base]]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == now.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        ids.append({x.doc_id for x in now.collect()})
    toxic = {i for i, _, y in rows if y}
    assert len(ids[0] & toxic) <= 0.05 * len(toxic) and len(ids[0] - toxic) == len(docs) - len(toxic)
    assert 1000 in ids[1] and 1002 not in ids[1] and 1001 in ids[1]
    assert 1003 in ids[1] and 1003 not in ids[2] and ids[3] == ids[2]
    text = now.filter("doc_id = 1004").first()
    assert "b7db7aa4a5fcc78305" not in text.text and text.n_chars == len(text.text)
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert {x.doc_id for x in packed.collect()} == ids[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()
    blank = spark.createDataFrame([], kind)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, blank, str(tmp_path)).count() == 0, name
    rows = sorted(map(str, odd.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, str(tmp_path))
        assert out.schema.names == odd.schema.names, name
        kept = sorted(map(str, out.collect()))
        assert set(kept) <= set(rows) and len(kept) >= 6, name
    assert {x.doc_id for x in corpus_pipeline.STAGES[-1][1](spark, odd, str(tmp_path)).collect()} == {x.doc_id for x in odd.select("doc_id").collect()}
