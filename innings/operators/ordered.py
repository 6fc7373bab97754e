"""Order-dependent operators that stay parallel inside one hot group.

A plain window puts a whole group into one task. When a single match, batter
or pair can hold a large part of all rows that task becomes the job. The
operators here split every group into *chunks* along its order:

* rows are shuffled by (group, chunk) and a local window runs inside a chunk;
* one row per (group, chunk) is aggregated first (map-side partial sums) and
  a small window over those rows gives what happened before the chunk;
* the two are joined on (group, chunk), reusing the shuffle of the first step.

Matches are cut only when they are hot (see ``hot_keys``). On ordinary data
the second step has no input and adaptive execution removes it, which leaves
the plain window. A chunk must be a non-decreasing function of the order. Levels may be nested,
so the window over chunks is itself chunked when a group has very many.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innings.session import stored

CHUNK_BITS = 16  # positions of a hot match per chunk: 65,536
BLOCK_BITS = 12  # matches per chunk when a group spans matches: 4,096
HOT_ROWS = 1 << 20  # a match with fewer rows is never hot
HOT_SHARE = 1e-5  # nor one that holds a smaller share of all rows
TASK_ROWS = 1 << 17  # balls that one task of a shuffle takes, on average


def match_block(match_id: str = "match_id") -> Column:
    return F.shiftright(F.col(match_id).cast("long"), BLOCK_BITS)


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE, floor: int = HOT_ROWS) -> DataFrame:
    """Keys that hold more than ``share`` of all rows (and more than ``floor`` rows).

    By construction there are fewer than ``1 / share`` of them, so the result
    is safe to broadcast whatever the input size. On ordinary data it is
    empty, and adaptive execution then drops every join that depends on it.
    """
    # Written (a row per key), so that the table is read once for both the counts and their total.
    counts = stored(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), "key-counts")
    total = counts.agg((F.sum("_n") * share).alias("_t"))
    return counts.filter(F.col("_n") > F.greatest(F.lit(float(floor)), total.scalar())).select(key)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` shuffled by ``keys`` into as many parts as ``rows`` need, so a task's memory does not grow with the input.

    Windows whose groups hold all of ``keys`` run in these parts without another shuffle.
    """
    spark = df.sparkSession
    cores = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(max(cores, -(-rows // TASK_ROWS)), *keys)


@dataclass(frozen=True)
class Sequenced:
    """Balls in order.

    ``rows`` carries ``seq`` (position in the match) and ``chunk`` (a slice of
    65,536 positions in a hot match, 0 in every other match); ``hot`` holds
    the rows of the hot matches only, with the same columns; ``plain`` is the
    input for aggregates that need no order. ``size`` is the number of balls
    when no match is hot: ``rows`` is then dealt by match, and windows inside
    a match need no further shuffle. It is None if some match is hot.
    """

    rows: DataFrame
    hot: DataFrame
    plain: DataFrame
    size: int | None = None

    @classmethod
    def of(cls, balls: DataFrame | Sequenced, share: float = HOT_SHARE, floor: int = HOT_ROWS) -> Sequenced:
        """From a table that already has ``seq``."""
        if isinstance(balls, Sequenced):
            return balls
        ids = hot_keys(balls, "match_id", share, floor)
        if ids.isEmpty():
            size = balls.count()
            return cls.ordinary(dealt(balls, size, "match_id"), balls, size)
        hot = F.broadcast(ids.withColumn("_hot", F.lit(True)))
        return cls(
            rows=with_chunk(balls.join(hot, "match_id", "left")),
            hot=with_chunk(balls.join(hot, "match_id")),
            plain=balls,
        )

    @classmethod
    def ordinary(cls, placed: DataFrame, plain: DataFrame, size: int) -> Sequenced:
        """Balls dealt by match of which no match is hot; the planner knows that the steps for hot ones are empty."""
        rows = placed.withColumn("chunk", F.lit(0).cast("long"))
        return cls(rows=rows, hot=rows.where(F.lit(False)), plain=plain, size=size)

    def with_rows(self, rows: DataFrame) -> Sequenced:
        return replace(self, rows=rows)


def with_chunk(balls: DataFrame, flag: str = "_hot") -> DataFrame:
    """``chunk`` from ``seq`` in the rows flagged as hot."""
    piece = F.shiftright(F.col("seq").cast("long"), CHUNK_BITS)
    return balls.withColumn("chunk", F.when(F.col(flag), piece).otherwise(F.lit(0).cast("long"))).drop(flag)


def running(df: DataFrame, keys: list[str], order: list[str], levels: list[list[str]], sums: dict[str, Column],
            prior: bool = False, source: DataFrame | None = None) -> DataFrame:
    """Running sums inside ``keys`` along ``order``; ``prior`` leaves the row itself out.

    ``levels`` lists chunk columns from fine to coarse. With ``source`` only
    the groups found there are cut into chunks (every other group must lie in
    one chunk); without it the chunk totals come from ``df`` itself. Every
    sum is a long or double and never null: an empty prefix gives zero.
    """
    end = -1 if prior else Window.currentRow
    by = keys + (levels[0] if levels else [])
    window = Window.partitionBy(*by) if by else Window.partitionBy()
    window = window.orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    kept = [c for c in df.columns if c not in sums]
    local = {n: F.coalesce(F.sum(c).over(window), F.lit(0)) for n, c in sums.items()}
    if not levels:
        return df.select(*kept, *[value.alias(n) for n, value in local.items()])

    fine, coarser = levels[0], levels[1:]
    every = by + [c for level in coarser for c in level if c not in by]
    totals = (df if source is None else source).groupBy(*every).agg(*[F.sum(c).alias(f"_c_{n}") for n, c in sums.items()])
    carry = running(totals, keys, fine, coarser, {f"_p_{n}": F.col(f"_c_{n}") for n in sums}, prior=True)
    carry = carry.select(*[F.col(k).alias(f"_k_{k}") for k in by], *[f"_p_{n}" for n in sums])
    joined = df.join(carry, [F.col(k) == F.col(f"_k_{k}") for k in by], "inner" if source is None else "left")
    return joined.select(
        *kept, *[(value + F.coalesce(f"_p_{n}", F.lit(0))).alias(n) for n, value in local.items()]
    )


def trailing(df: DataFrame, keys: list[str], order: list[str], chunk: str, value: str, k: int,
             total: str, count: str, source: DataFrame | None = None) -> DataFrame:
    """Sum and number of the ``k`` rows before each row of its group."""
    by = [*keys, chunk]
    window = Window.partitionBy(*by).orderBy(*order)
    local = df.withColumns({
        "_pos": F.row_number().over(window),
        "_sum": F.coalesce(F.sum(value).over(window.rowsBetween(-k, -1)), F.lit(0)),
    })
    # At most k rows of a chunk have fewer than k successors in it.
    ends = (df if source is None else source).select(
        *by, F.row_number().over(window).alias("_pos"), F.lead(F.lit(1), k).over(window).alias("_more"),
        F.col(value).cast("long").alias("_v"),
    )
    tails = (
        ends.filter(F.col("_more").isNull()).groupBy(*by)
        .agg(F.array_sort(F.collect_list(F.struct("_pos", "_v"))).alias("_t"))
        .withColumn("_t", F.col("_t._v"))
    )
    chunks_before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(-k, -1)
    carry = (
        tails.withColumn("_carry", F.flatten(F.collect_list("_t").over(chunks_before)))
        .filter(F.size("_carry") > 0)
        .select(*[F.col(c).alias(f"_k_{c}") for c in by], "_carry")
    )
    joined = local.join(carry, on=[F.col(c) == F.col(f"_k_{c}") for c in by], how="left")
    missing = F.greatest(F.lit(k) - (F.col("_pos") - 1), F.lit(0))
    size = F.coalesce(F.array_size("_carry"), F.lit(0))
    take = F.least(missing, size)
    extra = F.when(take > 0, F.slice("_carry", size - take + 1, take))
    borrowed = F.aggregate(extra, F.lit(0).cast("long"), lambda s, x: s + x)
    return joined.select(
        *df.columns,
        (F.col("_sum") + F.coalesce(borrowed, F.lit(0))).alias(total),
        (F.least(F.col("_pos") - 1, F.lit(k)) + take).alias(count),
    )


def last_n(df: DataFrame, partition: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """First ``n`` rows per partition in the given order.

    The filter on the rank lets Spark cut each input partition to ``n`` rows
    per group before the shuffle, so a hot group never reaches one task whole.
    """
    window = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def cumulative_by_value(df: DataFrame, value: str, counts: dict[str, Column]) -> DataFrame:
    """Per distinct value: its counts, and the counts of all smaller values (``<name>_below``).

    Equal values collapse in a map-side aggregate first, so repeated values
    cannot make a hot task. The distinct values are then range-partitioned
    (Spark samples the bounds) and stored, which fixes their partition.
    """
    per_value = df.groupBy(value).agg(*[F.sum(c).cast("long").alias(n) for n, c in counts.items()])
    placed = stored(per_value.repartitionByRange(value).withColumn("_bucket", F.spark_partition_id()), "by-value")
    below = running(placed, [], [value], [["_bucket"]], {f"{n}_below": F.col(n) for n in counts}, prior=True)
    return below.drop("_bucket")
