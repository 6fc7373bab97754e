"""Registered queries against their SQL, and the pipeline against its stages."""

import pytest
from compare import difference

import corpus_pipeline
from innings.llm.oracles import ORACLES
from innings.llm.queries import QUERIES
from innings.plans.registry import Entry


@pytest.mark.parametrize("name", ORACLES)
def test_agrees_with_sql(name, spark, duck, sf):
    message, _ = difference(spark, duck, Entry(name, QUERIES[name], ORACLES[name]), sf)
    assert message == ""


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith(("op6_", "op7_", "op10_", "op13_"))])
def test_native_queries_run_no_python(name, spark, sf):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(k in plan for k in ("Python", "Arrow", "Pandas"))


def test_registered(spark):
    import __spark_entry__ as driver

    assert {*QUERIES, "pipeline"} <= set(driver.queries())
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_pipeline(spark, sf):
    """Every stage keeps the columns and loses only what it is there for."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns
        if name in ("language_id", "near_dedup", "decontaminate"):
            assert 0 < docs.count() <= before
            assert docs.select("doc_id").distinct().count() == docs.count()
        before = docs.count()
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert placed.count() == before
    spark.catalog.clearCache()
