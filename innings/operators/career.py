"""Player aggregates: careers, head-to-head records, innings totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innings.functions.scalars import intent_label, pct, ratio

NOT_CREDITED = ("run out", "retired hurt")  # fixed values: dismissals no bowler is credited with


def count_if(cond: Column) -> Column:
    return F.count_if(cond)


def _own_dismissal() -> Column:
    return F.col("dismissal_kind").isNotNull() & (F.col("player_dismissed") == F.col("batter"))


def _batting_dot() -> Column:
    return (F.col("batsman_runs") == 0) & (F.col("extra_runs") == 0)


def with_match(deliveries: DataFrame, matches: DataFrame, cols: tuple[str, ...] = ("season",)) -> DataFrame:
    """Match attributes on every ball.

    No broadcast hint: the planner broadcasts while the match side is below
    its threshold, and otherwise sorts and splits skewed matches.
    """
    side = matches.select(F.col("id").alias("_id"), *[c for c in cols])
    kept = deliveries.drop(*[c for c in cols if c in deliveries.columns])
    return kept.join(side, kept.match_id == side._id).drop("_id")


def batting_fold(deliveries: DataFrame) -> DataFrame:
    """A row per match, batter and phase: what careers need of the balls, before anything is joined."""
    return deliveries.filter(F.col("batter").isNotNull()).groupBy(
        "match_id", F.col("batter").alias("player"), "phase").agg(
        F.sum("batsman_runs").alias("runs"), F.count(F.lit(1)).alias("balls"),
        count_if(_own_dismissal()).alias("outs"), count_if(_batting_dot()).alias("dots"))


def bowling_fold(deliveries: DataFrame, not_credited=NOT_CREDITED) -> DataFrame:
    """A row per match, bowler and phase."""
    credited = F.col("dismissal_kind").isNotNull() & ~F.col("dismissal_kind").isin(list(not_credited))
    return deliveries.filter(F.col("bowler").isNotNull()).groupBy(
        "match_id", F.col("bowler").alias("player"), "phase").agg(
        F.sum("total_runs").alias("runs"), F.count(F.lit(1)).alias("balls"), count_if(credited).alias("wickets"),
        count_if(F.col("total_runs") == 0).alias("dots"))


def batting_career(deliveries: DataFrame, matches: DataFrame) -> DataFrame:
    """The fold has one row per match, so its rows are the innings."""
    balls, runs = F.sum("balls"), F.sum("runs")
    return (
        with_match(batting_fold(deliveries), matches)
        .groupBy("player", "season", F.lit("batsman").alias("role"), "phase")
        .agg(
            F.count("match_id").alias("innings"),
            runs.alias("runs"),
            balls.alias("balls_faced"),
            pct(runs, balls).alias("strike_rate"),
            ratio(runs, F.sum("outs")).alias("average"),
            F.lit(0).cast("long").alias("wickets"),
            F.lit(0.0).alias("economy"),
            pct(F.sum("dots"), balls).alias("dot_pct"),
        )
    )


def bowling_career(deliveries: DataFrame, matches: DataFrame, not_credited=NOT_CREDITED) -> DataFrame:
    balls = F.sum("balls")
    return (
        with_match(bowling_fold(deliveries, not_credited), matches)
        .groupBy("player", "season", F.lit("bowler").alias("role"), "phase")
        .agg(
            F.count("match_id").alias("innings"),
            F.lit(0).cast("long").alias("runs"),
            F.lit(0).cast("long").alias("balls_faced"),
            F.lit(0.0).alias("strike_rate"),
            F.lit(0.0).alias("average"),
            F.sum("wickets").alias("wickets"),
            ratio(F.sum("runs"), balls, 6).alias("economy"),
            pct(F.sum("dots"), balls).alias("dot_pct"),
        )
    )


def career_stats(deliveries: DataFrame, matches: DataFrame) -> DataFrame:
    return batting_career(deliveries, matches).unionByName(bowling_career(deliveries, matches))


def h2h_records(deliveries: DataFrame) -> DataFrame:
    balls = F.count(F.lit(1))
    runs = F.sum("batsman_runs")
    return (
        deliveries.filter(F.col("batter").isNotNull() & F.col("bowler").isNotNull())
        .groupBy("batter", "bowler", "phase")
        .agg(
            balls.alias("balls"),
            runs.alias("runs"),
            count_if(_own_dismissal()).alias("wickets"),
            pct(runs, balls).alias("strike_rate"),
            pct(count_if(_batting_dot()), balls).alias("dot_pct"),
            pct(count_if(F.col("batsman_runs") >= 4), balls).alias("boundary_pct"),
        )
    )


def h2h_fold(deliveries: DataFrame) -> DataFrame:
    """The sums behind a head-to-head record; they add up over matches."""
    known = F.col("batter").isNotNull() & F.col("bowler").isNotNull()
    return deliveries.filter(known).groupBy("batter", "bowler", "phase").agg(
        F.count(F.lit(1)).alias("balls"), F.sum("batsman_runs").alias("runs"),
        count_if(_own_dismissal()).alias("wickets"), count_if(_batting_dot()).alias("dots"),
        count_if(F.col("batsman_runs") >= 4).alias("boundaries"))


def innings_totals(deliveries: DataFrame) -> DataFrame:
    return deliveries.groupBy("match_id", "inning").agg(F.sum("total_runs").alias("inn_runs"))


def batter_innings(deliveries: DataFrame) -> DataFrame:
    return deliveries.groupBy("batter", "match_id").agg(F.sum("batsman_runs").alias("inn_runs"))


def global_h2h_sr(deliveries: DataFrame) -> DataFrame:
    return deliveries.groupBy("batter", "bowler").agg(
        (F.sum("batsman_runs") * 100.0 / F.count(F.lit(1))).alias("h2h_sr_global")
    )


def intent_distribution(deliveries: DataFrame) -> DataFrame:
    return deliveries.groupBy(intent_label().alias("intent")).agg(F.count(F.lit(1)).alias("n"))


def matchup_confidence(h2h: DataFrame, min_balls: int = 30) -> DataFrame:
    balls = F.sum("balls")
    return h2h.groupBy("batter", "bowler").agg(
        balls.alias("balls_total"),
        (balls < min_balls).alias("low_sample"),
        F.when(balls < min_balls, 0.6).otherwise(0.88).alias("confidence"),
    )
