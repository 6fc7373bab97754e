"""Quantiles and distinct counts from sketches that are stored per day and merged when they are read.

A day's sketch is made once, from that day's rows; a report over any days and
groups merges a few kilobytes each and reads no rows. Errors are bounded: a
quantile lies within ``RANK_ERROR`` of the wanted rank, a distinct count within
``COUNT_ERROR`` (three standard errors).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 400  # size parameter of the quantile sketch
RANK_ERROR = 0.01
LG = 14  # logarithm of the size of the distinct sketch
COUNT_ERROR = 0.03


def daily_sketches(rows: DataFrame, day: str, by: list[str], value: str, counted: str) -> DataFrame:
    """``day, by, n, quantiles, distinct``: one row per day and group."""
    return rows.groupBy(F.to_date(day).alias("day"), *by).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(K)).alias("quantiles"),
        F.hll_sketch_agg(counted, F.lit(LG)).alias("distinct"))


def report(sketches: DataFrame, by: list[str], ranks: list[float]) -> DataFrame:
    """Merged per group: rows, estimated distinct values, and one column ``p<percent>`` per rank."""
    merged = sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("quantiles").alias("_q"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("n_distinct"))
    return merged.select(*by, "n", "n_distinct", *[
        F.kll_sketch_get_quantile_double("_q", F.lit(r)).alias(f"p{round(r * 100)}") for r in ranks])
