"""Ball-by-ball windows: innings progress, bowler spells, batter form, chase pressure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innings.functions.scalars import even_round
from innings.operators.career import batter_innings, innings_totals
from innings.operators.ordered import Sequenced, match_block, running, trailing


def innings_progress(deliveries: DataFrame | Sequenced, prior: bool = False) -> DataFrame:
    """Runs, balls and wickets of the innings so far; ``prior`` stops before the ball."""
    balls = Sequenced.of(deliveries)
    return running(
        balls.rows, ["match_id", "inning"], ["seq"], [["chunk"]],
        {"cum_runs": F.col("total_runs"), "cum_balls": F.lit(1), "cum_wickets": F.col("is_wicket").cast("int")},
        prior, balls.hot,
    )


def with_rates(progress: DataFrame) -> DataFrame:
    rate = even_round(F.col("cum_runs") / F.col("cum_balls") * 6)
    return progress.withColumns({
        "current_rr": F.when(F.col("cum_balls") > 0, rate).otherwise(0.0),
        "wickets_remaining": 10 - F.col("cum_wickets"),
    })


def with_required_rate(progress: DataFrame, factor: float = 1.1) -> DataFrame:
    """Placeholder requirement: a fixed factor over the current rate."""
    out = progress.withColumn("required_rr", F.col("current_rr") * F.lit(factor))
    return out.withColumn("pressure_index", even_round(F.abs(F.col("required_rr") - F.col("current_rr"))))


def chase_target(deliveries: DataFrame) -> DataFrame:
    """Runs the second side needs: one more than the first innings."""
    first = innings_totals(deliveries.filter(F.col("inning") == 1))
    return first.select(F.col("match_id").alias("_m"), (F.col("inn_runs") + 1).alias("target"))


def with_chase_rate(balls: DataFrame, left: Column) -> DataFrame:
    need = (F.col("target") - F.col("cum_runs")) / F.greatest(left / F.lit(6.0), F.lit(0.1))
    chasing = (F.col("inning") == 2) & F.col("target").isNotNull()
    rated = balls.withColumn("required_rr", F.when(chasing, even_round(need)).otherwise(0.0))
    return rated.withColumn("pressure_index", even_round(F.abs(F.col("required_rr") - F.col("current_rr"))))


def balls_left() -> Column:
    return (F.lit(20) - F.col("over")) * 6 - F.col("ball")


def chase_pressure(deliveries: DataFrame | Sequenced) -> DataFrame:
    """Second-innings balls with the rate still required to pass the first innings."""
    balls = Sequenced.of(deliveries)
    second = balls.with_rows(balls.rows.filter(F.col("inning") == 2))
    chase = with_rates(innings_progress(second))
    joined = chase.join(chase_target(balls.plain), F.col("match_id") == F.col("_m")).drop("_m")
    return with_chase_rate(joined, balls_left())


def spell_sums(balls: Sequenced, prior: bool = False) -> DataFrame:
    return running(
        balls.rows, ["match_id", "bowler"], ["seq"], [["chunk"]],
        {"bowler_spell_balls": F.lit(1), "bowler_spell_runs": F.col("total_runs")}, prior, balls.hot,
    )


def with_economy(out: DataFrame) -> DataFrame:
    economy = even_round(F.col("bowler_spell_runs") / F.col("bowler_spell_balls") * 6)
    return out.withColumn("bowler_economy", F.when(F.col("bowler_spell_balls") > 0, economy).otherwise(0.0))


def bowler_spell(deliveries: DataFrame | Sequenced, prior: bool = False) -> DataFrame:
    return with_economy(spell_sums(Sequenced.of(deliveries), prior))


def bowler_last3(deliveries: DataFrame | Sequenced, n: int = 3) -> DataFrame:
    balls = Sequenced.of(deliveries)
    return trailing(
        balls.rows, ["match_id", "bowler"], ["seq"], "chunk", "total_runs", n, "bowler_last3_runs", "_n", balls.hot
    ).drop("_n")


def batter_form(deliveries: DataFrame, n: int = 5, default: float = 20.0) -> DataFrame:
    """Runs per (batter, match) with the mean of the ``n`` innings before it."""
    innings = batter_innings(deliveries).withColumn("_block", match_block())
    out = trailing(innings, ["batter"], ["match_id"], "_block", "inn_runs", n, "_sum", "_n")
    mean = F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n")).otherwise(default)
    return out.select("batter", "match_id", "inn_runs", mean.alias("prev_avg"))
