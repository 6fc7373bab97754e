"""Stored records that take matches in batches; the result must be that of a computation from scratch."""

from __future__ import annotations

from pyspark.sql import functions as F

from innings.operators.career import with_match
from innings.operators.incremental import RecordBook
from innings.plans.registry import query
from innings.plans.sql import sql
from innings.session import new_folder
from innings.sources import tables
from innings.sources.adapter import deliveries, matches

LATER, AGAIN = 2000, 1999  # seasons from LATER on come in the second batch, with those of AGAIN sent once more


def _book(spark, sf) -> RecordBook:
    """Two batches and a replay of the second. A batch reads the folders of its seasons only."""
    games, root = matches(spark, sf), new_folder(spark, "book")
    tables.write_table(with_match(deliveries(spark, sf), games), f"{root}/incoming", ["season"])
    incoming = spark.read.parquet(f"{root}/incoming")
    book = RecordBook(spark, f"{root}/book")
    book.apply(incoming.where(F.col("season") < LATER), games, 1)
    for _ in range(2):
        book.apply(incoming.where(F.col("season") >= AGAIN), games, 2)
    return book


@query("incremental_batting", sql("bat", "SELECT * FROM bat"))
def incremental_batting(spark, sf):
    return _book(spark, sf).batting()


@query("incremental_bowling", sql("bowl", "SELECT * FROM bowl"))
def incremental_bowling(spark, sf):
    return _book(spark, sf).bowling()


@query("incremental_h2h", sql("h", "SELECT * FROM h"))
def incremental_h2h(spark, sf):
    return _book(spark, sf).h2h()
