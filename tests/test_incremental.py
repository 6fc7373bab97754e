"""Keyed stores and the record book: replays, lost batches, untouched buckets."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from innings.operators import career as C
from innings.operators.incremental import RecordBook
from innings.sources import tables
from innings.sources.adapter import deliveries, matches
from innings.sources.keyed_store import KeyedStore, adding

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("name", T.StringType()), T.StructField("n", T.LongType())])


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_batch_counts_once_and_leaves_other_buckets(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), SCHEMA, ["k"], 8)
    assert rows(store.read()) == [] and store.applied() == []
    assert store.apply(spark.createDataFrame([(i, "a", i) for i in range(40)], SCHEMA), 0)
    before = store._places()
    assert store.apply(spark.createDataFrame([(3, "b", 30), (100, None, 1)], SCHEMA), 4)
    assert not store.apply(spark.createDataFrame([(3, "c", 99)], SCHEMA), 4)
    want = sorted([(i, "a", i) for i in range(40) if i != 3] + [(3, "b", 30), (100, None, 1)])
    assert rows(store.read()) == want and store.applied() == [0, 4]
    after = store._places()
    assert 1 <= sum(after[b] != before[b] for b in before) <= 2


def test_a_batch_that_broke_off_does_not_show_and_is_repeated(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), SCHEMA, ["k", "name"], 4, by=["k"])
    store.apply(spark.createDataFrame([(1, "a", 1), (2, None, 2)], SCHEMA), 1, adding)
    changes = spark.createDataFrame([(1, "a", 10), (1, "b", 5)], SCHEMA)
    half = changes.limit(1).withColumn("bucket", F.lit(0))  # written, but never entered in the ledger
    half.write.partitionBy("bucket").parquet(f"{tmp_path}/data/batch=2")
    assert rows(store.read().where("k = 1")) == [(1, "a", 1)]
    assert store.apply(changes, 2, adding)
    assert rows(store.read().where("k = 1")) == [(1, "a", 11), (1, "b", 5)]
    assert store.read().where("k = 2").first()["n"] == 2


def test_two_writers_take_two_versions(spark, tmp_path):
    root = str(tmp_path)
    tables.write_version(spark.range(1), root)
    assert tables.claim(spark, f"{root}/v00000002/_claimed")  # another writer is at work
    assert tables.write_version(spark.range(3), root).endswith("v00000003")
    assert tables.read_current(spark, root).count() == 3 and not tables.claim(spark, f"{root}/v00000002/_claimed")


def test_book_after_each_batch_and_after_a_lost_one(spark, sf, tmp_path):
    balls, games = deliveries(spark, sf).cache(), matches(spark, sf)
    book = RecordBook(spark, str(tmp_path), 8)
    some = balls.where("match_id % 3 = 0")
    book.apply(some, games, 7)
    assert rows(book.h2h()) == rows(C.h2h_records(some))
    # The second batch reaches the pairs and breaks off before the log: the repetition must not add them twice.
    new = balls.join(some.select("match_id").distinct(), "match_id", "left_anti")
    book.pair_sums.apply(C.h2h_fold(new), 8, adding)
    book.apply(balls, games, 8)
    book.apply(balls, games, 9)
    assert rows(book.h2h()) == rows(C.h2h_records(balls))
    assert sorted(map(str, rows(book.batting()))) == sorted(map(str, rows(C.batting_career(balls, games))))
    assert sorted(map(str, rows(book.bowling()))) == sorted(map(str, rows(C.bowling_career(balls, games))))
    assert book.log.read().count() == balls.select("match_id").distinct().count()
    balls.unpersist()
