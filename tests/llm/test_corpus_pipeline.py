import numpy as np
import pytest

import corpus_pipeline
from ledgerloom.llm import decontam, packing, quality, simhash
from ledgerloom.llm.common import new_path


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        path = new_path(spark, "test")
        stage(spark, docs, sf_dir).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_take_effect(spark, sf_dir, stages):
    assert all(list(map(str, out.dtypes)) == list(map(str, docs.dtypes)) for docs, out in stages[:-1])
    (d0, q), (_, s), (_, c), (_, m), (_, rows) = stages
    assert ids(q) == ids(quality.quality(d0).where("kept"))
    assert ids(s) == sorted({r.component_id for r in simhash.near_duplicates(q).collect()})
    leaks = {r.doc_id for r in decontam.contained(s, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert ids(c) == [i for i in ids(s) if i not in leaks] and leaks
    assert set(ids(m)) <= set(ids(c)) and max(map(ids(m).count, set(ids(m)))) <= 2
    words = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    assert abs(words(m) / words(c) - 1.5) < 0.1
    with open(packing.VOCABULARY, "rb") as f:
        encoder = packing.Encoder(f.read())
    want = sum(len(encoder.ids(r.text)) // 2 + 1 for r in m.collect())
    packed = rows.collect()
    assert sum(r.n_tokens for r in packed) == want and all(np.frombuffer(bytes(r.input_ids), "<u2").size == packing.ROW for r in packed)


def test_run(spark, sf_dir, stages):
    assert corpus_pipeline.run(spark, sf_dir).count() == stages[-1][1].count()


def test_clean_documents_stay(spark, sf_dir):
    """Of documents that are neither copies nor short nor leaked, the rules keep nearly all good ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    good = quality.quality(docs).where("not base_failed").join(labels, "doc_id", "left_semi")
    assert good.where("kept").count() >= 0.95 * good.count()
