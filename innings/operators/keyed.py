"""Keyed tables: de-duplication, upsert, uniqueness, top rows per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innings.operators.ordered import last_n


def dedup_keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key in an explicit load order."""
    return last_n(df, keys, [F.col(c).desc() for c in order], 1, "_rn").drop("_rn")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], set_cols: list[str]) -> DataFrame:
    """New keys are inserted whole; known keys take only ``set_cols`` from the update."""
    t, u = target.alias("t"), updates.alias("u")
    known = F.col(f"t.{keys[0]}").isNotNull()
    updated = F.col(f"u.{keys[0]}").isNotNull()
    joined = t.join(u, on=[F.col(f"t.{k}") == F.col(f"u.{k}") for k in keys], how="full_outer")
    columns = []
    for c in target.columns:
        old, new = F.col(f"t.{c}"), F.col(f"u.{c}")
        if c in keys:
            value = F.coalesce(old, new)
        elif c in set_cols:
            value = F.when(updated, new).otherwise(old)
        else:
            value = F.when(known, old).otherwise(new)
        columns.append(value.alias(c))
    return joined.select(*columns)


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def assert_key(df: DataFrame, keys: list[str]) -> DataFrame:
    bad = key_violations(df, keys).limit(5).collect()
    if bad:
        raise ValueError(f"duplicate key {keys}: {[tuple(r) for r in bad]}")
    return df


def top_per_group(df: DataFrame, group: list[str], measure: str, ties: list[str], k: int = 1) -> DataFrame:
    return last_n(df, group, [F.col(measure).desc(), *[F.col(t) for t in ties]], k, "rn")


def mode_per_group(df: DataFrame, group: list[str], col: str) -> DataFrame:
    """Most frequent non-null value; the smallest one on a tie."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(*group, col).agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(counts, group, "n", [col]).drop("rn")


def distinct_sorted(df: DataFrame, col: str | Column) -> DataFrame:
    return df.select(col).dropna().distinct().orderBy(col)
