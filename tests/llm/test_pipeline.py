import pytest

from sitewright.llm import packing, secret_scans, toxicity
from tests.llm.fixtures import as_rows, docs
from tests.llm.test_simhash_dedup import copy_classes
from tests.llm.test_toxicity import corpus

pipeline = pytest.importorskip("corpus_pipeline")


def inputs(spark, tmp_path):
    rows, labels = corpus(300)
    rows += [(1000, None), (1001, ""), (1002, "token: abcdefghijkl " + rows[1][1]), (1003, rows[2][1]), (1003, rows[2][1])]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, y) for d, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows, dict(labels)


def test_stages_against_plain_versions(spark, tmp_path):
    rows, toxic = inputs(spark, tmp_path)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [name for name, _ in pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "secrets", "packing"]
    first = pipeline.drop_toxic(spark, frame, str(tmp_path))
    model = toxicity.fit(frame, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    good = [(d, t) for d, t in rows if toxicity.probability(model.curve, toxicity.features(toxicity.folded(t or ""), model.automaton())) < 0.5]
    assert as_rows(first, "doc_id", "text") == sorted(good, key=repr) and first.columns == frame.columns
    assert not any(toxic.get(d) for d, _ in good)
    first.write.parquet(f"{tmp_path}/1")
    second = pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{tmp_path}/1"), str(tmp_path))
    texts = dict(good)
    keep = set(copy_classes(texts).values())
    assert as_rows(second, "doc_id") == sorted([(d,) for d in keep], key=repr) and second.columns == frame.columns
    second.write.parquet(f"{tmp_path}/2")
    third = pipeline.redact_secrets(spark, spark.read.parquet(f"{tmp_path}/2"), str(tmp_path))
    found = {r.doc_id: r for r in third.collect()}
    assert set(found) == keep and third.schema == frame.schema
    for d in keep:
        text = texts[d]
        assert found[d].text == (text and secret_scans.without_secrets(text, {})) and found[d].n_chars == (None if text is None else len(found[d].text))
    third.write.parquet(f"{tmp_path}/3")
    last = pipeline.pack(spark, spark.read.parquet(f"{tmp_path}/3"), str(tmp_path)).collect()
    assert sum(r.part_units for r in last) == sum(len((r.text or "").encode()) for r in found.values()) and {r.doc_id for r in last} == keep
    assert all(r.bin_offset + r.part_units <= packing.CAPACITY for r in last if r.bin is not None)


def test_run(spark, tmp_path):
    inputs(spark, tmp_path)
    assert pipeline.run(spark, str(tmp_path)).count() > 0 and pipeline.ORACLE_SQL is None
    docs(spark).where("false").write.parquet(f"{tmp_path}/e/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/e/labels.parquet")
    assert pipeline.run(spark, f"{tmp_path}/e").count() == 0
