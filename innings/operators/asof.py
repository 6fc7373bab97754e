"""As-of join: for every row the latest version of a keyed figure before (or at) its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICE_BITS = 12  # 4,096 units of time a slice


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str], strict: bool = True,
              slice_bits: int = SLICE_BITS) -> DataFrame:
    """``left`` with ``values`` of the last row of ``right`` with the same ``keys`` before its ``at`` (a whole number).

    ``strict`` leaves out versions of the same time. Both tables are put together and ordered by time once; a key's
    rows are cut into slices of time, so a hot key is many windows. What a slice inherits is one row per key and
    slice, found from the last version of each. Null keys meet nothing; without a version the values are null; of
    several versions of one key and time the greatest counts.
    """
    side = 2 if strict else 0  # where a version lies among rows of its time: behind them, or before
    version = F.struct(*values)
    cut = lambda df: df.withColumn("_slice", F.shiftright(F.col(at).cast("long"), slice_bits))
    kept = left.columns
    rows = cut(left.withColumn("_row", F.struct(*kept)).select(*keys, at, "_row")).withColumn("_side", F.lit(1))
    versions = right.dropna(subset=[*keys, at]).groupBy(*keys, at).agg(F.max(version).alias("_v"))
    versions = cut(versions).withColumn("_side", F.lit(side))
    both = rows.unionByName(versions, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_slice").orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    local = both.withColumn("_v", F.last("_v", ignorenulls=True).over(inside)).where("_side = 1")
    # One row per key and slice, also of slices that hold rows only.
    ends = both.groupBy(*keys, "_slice").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(at))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_s"),
                          F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    same = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)] + [F.col("_slice") == F.col("_s")]
    found = F.coalesce(F.col("_v"), F.col("_carry"))
    return local.join(carried, same, "left").select(
        *[F.col(f"_row.{c}").alias(c) for c in kept], *[found[v].alias(v) for v in values])
