import os

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from causeway.llm import bpe, pii, quality_classifier, registry, simhash

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clash = docs.selectExpr("*", "1 AS score", "2 AS size", "3 AS _id")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clash, SF).persist()
        assert out.columns == clash.columns, name
        clash = out
    assert 0 < clash.count()
    assert not any(any(v) for r in clash.collect() for v in pii.base_spans(r.text or "").values())


def test_stages_equal_their_operators(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = corpus_pipeline.quality(spark, docs, SF)
    good = {r.doc_id for r in quality_classifier.scored(docs, labels).filter("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == good
    one = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert {r.doc_id for r in one.collect()} == {r.component_id for r in simhash.near_duplicates(docs).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == pii.redact_text(text[r.doc_id]) for r in corpus_pipeline.personal_data(spark, docs, SF).collect())
    assert {tuple(r) for r in corpus_pipeline.byte_bpe(spark, docs, SF).collect()} == {tuple(r) for r in bpe.digests(docs).collect()}


def test_run_repeats_itself_and_bears_empty_tables(spark, tmp_path):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) for _ in range(2))
    assert a == b and len(a) > 50
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLES[name]).df()
    cols = sorted(got.columns)
    order = lambda d: d[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)
