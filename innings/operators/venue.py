"""Venue profiles per season and over all seasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innings.functions.scalars import mean_of_cents, pct, ratio


def _phase_rates() -> list:
    phases = {"powerplay": "avg_powerplay_rr", "middle": "avg_middle_rr", "death": "avg_death_rr"}
    return [
        ratio(F.sum(f"{p}_runs"), F.sum(f"{p}_balls"), 6).alias(name) for p, name in phases.items()
    ]


def _per_innings(deliveries: DataFrame) -> DataFrame:
    """One row per (match, innings); every venue measure derives from it."""
    parts = []
    for p in ("powerplay", "middle", "death"):
        inside = F.col("phase") == p
        parts += [
            F.sum(F.when(inside, F.col("total_runs")).otherwise(0)).alias(f"{p}_runs"),
            F.count_if(inside).alias(f"{p}_balls"),
        ]
    return deliveries.groupBy("match_id", "inning").agg(
        F.sum("total_runs").alias("inn_runs"), F.count(F.lit(1)).alias("balls"), *parts
    )


def _joined(deliveries: DataFrame, matches: DataFrame) -> DataFrame:
    known = matches.filter(F.col("venue").isNotNull() & F.col("season").isNotNull())
    innings = _per_innings(deliveries)
    return known.join(innings, known.id == innings.match_id)


def venue_stats(deliveries: DataFrame, matches: DataFrame) -> DataFrame:
    """Ball-weighted profile: every innings counts once per ball bowled in it.

    Balls are folded to innings before the match join, so the join and the
    final aggregate see one row per innings instead of one per ball.
    """
    chose_first = ((F.col("winner") == F.col("team1")) & (F.col("toss_decision") == "bat")) | (
        (F.col("winner") == F.col("team2")) & (F.col("toss_decision") == "field")
    )
    first = F.col("inning") == 1
    return (
        _joined(deliveries, matches)
        .groupBy("venue", "season")
        .agg(
            ratio(
                F.sum(F.when(first, F.col("inn_runs") * F.col("balls"))), F.sum(F.when(first, F.col("balls")))
            ).alias("avg_first_inn"),
            pct(F.sum(F.when(chose_first, F.col("balls")).otherwise(0)), F.count_distinct("id"))
            .alias("win_bat_first_pct"),
            *_phase_rates(),
        )
    )


def venue_stats_corrected(deliveries: DataFrame, matches: DataFrame) -> DataFrame:
    """Innings-weighted averages and the share of decided matches won by the side batting first."""
    first = F.col("inning") == 1
    other = F.when(F.col("toss_winner") == F.col("team1"), F.col("team2")).otherwise(F.col("team1"))
    batted_first = F.when(F.col("toss_decision") == "bat", F.col("toss_winner")).otherwise(other)
    decided = first & F.col("winner").isNotNull()
    return (
        _joined(deliveries, matches)
        .groupBy("venue", "season")
        .agg(
            ratio(F.sum(F.when(first, F.col("inn_runs"))), F.count_if(first)).alias("avg_first_inn"),
            pct(F.count_if(decided & (F.col("winner") == batted_first)), F.count_if(decided))
            .alias("win_bat_first_pct"),
            *_phase_rates(),
        )
    )


def venue_profile(venue: DataFrame) -> DataFrame:
    """All seasons of a venue: means of the season rows, missing ones as zero."""
    def mean(col: str, nd: int):
        return F.coalesce(mean_of_cents(col, nd), F.lit(0.0))

    return venue.groupBy("venue").agg(
        mean("avg_first_inn", 1).alias("avg_score"),
        F.least(mean("win_bat_first_pct", 1), F.lit(100.0)).alias("bat_first_win"),
        mean("avg_powerplay_rr", 2).alias("pp_rr"),
        mean("avg_middle_rr", 2).alias("mid_rr"),
        mean("avg_death_rr", 2).alias("death_rr"),
    )


def season_avg_score(venue: DataFrame) -> DataFrame:
    """Unweighted mean over venues of the average first innings."""
    return venue.groupBy("season").agg(
        F.coalesce(mean_of_cents("avg_first_inn", 1), F.lit(0.0)).alias("avg_score")
    )
