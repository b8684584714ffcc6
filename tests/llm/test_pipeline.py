"""The pipeline's stages on awkward documents, and its effect on planted cases."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.fixtures import documents, empty, texts, words


def write(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    rows = [(i, 1, 0) for i, _ in texts() if i is not None]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(words(13, 101)[30:70]))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_keep_columns_and_rows(spark, tmp_path):
    sf_dir = write(spark, tmp_path / "a", documents(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.count()
    counts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts[name] = docs.count()
    # One class of labels: no text is toxic. Three rows of texts without words and three near copies go, then one leak.
    assert counts == {"toxicity": before, "near_dedup": before - 6, "substring_dedup": before - 6, "decontamination": before - 7}
    after = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len((after[30] or "").split()) == 100 and 3 not in after  # the shared passage is cut out, the leak is gone
    untouched = dict(texts())
    assert all(after[k] == untouched[k] for k in (0, 1, 2, 4, 5))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_columns_of_any_name_survive(spark, tmp_path):
    odd = {"toxic_score": "toxic_score", "a`b": "a`b", "a.b": "a.b", "own": "own", "_key": "_key", "root": "root", "hashes": "hashes"}
    docs = documents(spark).drop("own").withColumns({k: F.lit(v) for k, v in odd.items()})
    sf_dir = write(spark, tmp_path / "odd", docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        assert out.columns == docs.columns and rows and all(r[k] == v for r in rows for k, v in odd.items()), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count()


def test_real_ids_stay_before_null_ones(spark):
    rows = [(None, ""), (None, "one two three"), (40, " "), (41, None), (7, "one two  three"), (None, "alone here")]
    left = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == [(0, "alone here"), (7, "one two  three"), (40, " ")]


def test_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path / "e", empty(spark))).count() == 0


def test_run_equals_its_stages(spark, tmp_path):
    sf_dir = write(spark, tmp_path / "r", documents(spark))
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    whole = Counter(r["doc_id"] for r in rows if r["start"] == 0)
    assert whole[20] == 1 and 21 not in whole and 3 not in whole
