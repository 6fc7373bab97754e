"""Sessions of a stored event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _split(df: DataFrame, by: list[str], start: str, end: str, gap_us: int) -> DataFrame:
    """``_sid`` counts the starts of a session inside ``by``: rows whose distance to what came before is the gap or more."""
    window = Window.partitionBy(*by).orderBy(start, end)
    seen = F.max(end).over(window.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col(start) - seen < gap_us, 0).otherwise(1)
    return df.withColumn("_fresh", fresh).withColumn("_sid", F.sum("_fresh").over(window)).drop("_fresh")


def sessionize(events: DataFrame, key: str, ts: str, gap_seconds: int, slices: int = 64) -> DataFrame:
    """Sessions per key with their event count.

    A key's events are first folded to partial sessions inside slices of
    time, so even a key with a third of all events is spread over many tasks;
    only the partial sessions (at most one per gap of time) meet in one.
    """
    gap_us = gap_seconds * 1_000_000
    rows = events.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t")).withColumn(
        "_slice", F.expr(f"_t div {gap_us * slices}"))
    inner = _split(rows.withColumn("_u", F.col("_t")), [key, "_slice"], "_t", "_u", gap_us)
    parts = inner.groupBy(key, "_slice", "_sid").agg(
        F.min("_t").alias("_start"), F.max("_t").alias("_end"), F.count(F.lit(1)).alias("_n")).drop("_sid")
    joined = _split(parts, [key], "_start", "_end", gap_us)
    return joined.groupBy(key, "_sid").agg(
        F.timestamp_micros(F.min("_start")).alias("session_start"),
        F.timestamp_micros(F.max("_end") + gap_us).alias("session_end"), F.sum("_n").alias("n")).drop("_sid")
