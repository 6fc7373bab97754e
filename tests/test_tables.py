import json

import pytest
from pyspark.sql import functions as F

from innings.operators import audit as A
from innings.operators import keyed as K
from innings.sources import schemas, tables


def test_upsert_is_idempotent_and_partial(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "k string, innings int, runs int")
    new = spark.createDataFrame([("b", 9, 99), ("c", 3, 30)], "k string, innings int, runs int")
    once = K.upsert(old, new, ["k"], ["runs"])
    want = [("a", 1, 10), ("b", 2, 99), ("c", 3, 30)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, K.upsert(once, new, ["k"], ["runs"]).collect())) == want


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    assert tables.read_current(spark, root) is None
    tables.write_version(spark.range(3).toDF("id"), root)
    current = tables.read_current(spark, root)
    tables.write_version(K.upsert(current, spark.range(2, 5).toDF("id"), ["id"], []), root)
    assert sorted(r[0] for r in tables.read_current(spark, root).collect()) == [0, 1, 2, 3, 4]
    assert current.count() == 3


def test_keys_and_columns(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y")], "id int, other string")
    with pytest.raises(ValueError):
        K.assert_key(df, ["id"])
    assert K.assert_key(df, ["id", "other"]) is df
    kept, dropped = tables.project_known(df, ["id"])
    assert kept.columns == ["id"] and dropped == ["other"]
    assert set(schemas.KEYS) == set(schemas.SCHEMAS)


def test_partition_overwrite(spark, tmp_path):
    path = str(tmp_path / "p")
    tables.write_table(spark.createDataFrame([(1, 2020), (2, 2021)], "v int, season int"), path, ["season"])
    tables.write_table(spark.createDataFrame([(3, 2021)], "v int, season int"), path, ["season"])
    assert sorted(map(tuple, spark.read.parquet(path).select("v", "season").collect())) == [(1, 2020), (3, 2021)]


def test_json_records(spark, tmp_path):
    docs = schemas.conform(spark.createDataFrame([("d1", "venue_analysis", "text\nmore")], "doc_id string, doc_type string, text string"), schemas.DOCUMENT)
    tables.write_docs(docs, str(tmp_path / "docs"))
    assert tables.read_docs(spark, str(tmp_path / "docs")).collect() == docs.collect()
    (tmp_path / "qa.json").write_text(json.dumps([{"question": "q", "ground_truth": "a"}, {"question": "r", "ground_truth": "b"}], indent=1))
    assert tables.read_golden(spark, str(tmp_path / "qa.json")).count() == 2
    (tmp_path / "m.json").write_text(json.dumps({"faithfulness": 0.9, "total_questions": 51}))
    m = tables.read_metrics(spark, str(tmp_path / "m.json")).first()
    assert (m["faithfulness"], m["context_recall"], m["last_evaluated"], m["total_questions"]) == (0.9, 0.0, "", 51)


def test_audit_details(spark):
    m = spark.createDataFrame([(1, "Deccan Chargers", "A", None, "2019-01-01"), (1, "A", "B", 2020, "x"), (None, "B", None, None, None)],
                              "id int, team1 string, team2 string, season int, date string")
    assert [r[0] for r in A.coverage(m).collect()] == [2019, 2020]
    assert A.audit_duplicates(m, ["id"]).first()[0] == 1
    assert [r[0] for r in A.team_variants(m).collect()] == ["Deccan Chargers"]
    nulls = {r[0]: r[1] for r in A.audit_nulls(m, A.CRITICAL_MATCH_COLS).collect()}
    assert nulls == {"id": 1, "team2": 1, "season": 2, "date": 1}
    df = spark.range(1000)
    assert sorted(A.bounded_sample(df, ["id"], 10).collect()) == sorted(A.bounded_sample(df.orderBy(F.rand()), ["id"], 10).collect())
    assert A.bounded_sample(df, ["id"], 5000).count() == 1000


def test_both_loads_of_a_reload_read_stored_balls(spark, sf, monkeypatch):
    """Balls are numbered and joined once; neither load does it again."""
    from innings.plans import stores

    plans, replace = [], stores.tables.replace_tables

    def seen(root, matches, deliveries):
        plans.append(deliveries._jdf.queryExecution().executedPlan().toString())
        return replace(root, matches, deliveries)

    monkeypatch.setattr(stores.tables, "replace_tables", seen)
    assert stores.store_reload(spark, sf).count() > 0
    assert len(plans) == 2 and not any("Window" in p or "Join" in p for p in plans)
