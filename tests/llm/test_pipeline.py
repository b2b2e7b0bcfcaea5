"""The pipeline: each stage's effect on its own input, and the whole against the stages done by hand."""

import re

from corpus_pipeline import STAGES, run
from tests.llm.cases import DOCS
from tests.llm.test_copies import brute
from tests.llm.test_packing import ids_of

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, named = docs.columns, dict(STAGES)
    good = named["quality"](spark, docs, SF)
    assert good.columns == columns and 0.6 * docs.count() < good.count() < docs.count()
    single = named["exact_dedup"](spark, good, SF)
    bodies = [re.sub(r"[\x20\x09-\x0D]", "", r["text"]) for r in good.collect()]
    assert single.count() == len(set(bodies)) and single.columns == columns
    data = [tuple(r) for r in single.collect()]
    near = named["near_dedup"](spark, single, SF)
    assert {r["doc_id"] for r in near.collect()} == {i for i, _, c in brute(data, 5, 80) if i == c} and near.columns == columns
    clean = named["pii"](spark, near, SF)
    assert clean.columns == columns and not clean.where("text like '%@mail%.example.com%'").count() and clean.count() == near.count()
    packed = named["packing"](spark, clean, SF).collect()
    assert {i for r in packed for i in r["doc_ids"]} == {r["doc_id"] for r in clean.collect()}
    assert sorted(i for r in packed for i in r["ids"]) == sorted(i for r in clean.collect() for i in ids_of(r["text"]))


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, SF)
    key = lambda r: (r["shard"], r["bin"])
    got = run(spark, SF)
    assert got.columns == ["shard", "bin", "n_tokens", "doc_ids", "pieces", "starts", "ids"]
    assert sorted(got.collect(), key=key) == sorted(docs.collect(), key=key)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert run(spark, str(tmp_path)).collect() == []
