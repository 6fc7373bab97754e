"""Team form, rivalries, season summaries and team profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innings.functions.scalars import ratio
from innings.operators.keyed import mode_per_group, top_per_group
from innings.operators.ordered import last_n
from innings.operators.venue import season_avg_score


def both_sides(matches: DataFrame) -> DataFrame:
    """Two rows per match, one from each team's view, in a single scan."""
    margin = F.col("win_by_runs") + F.col("win_by_wickets") * 10
    sides = F.array(
        *[
            F.struct(
                F.col(t).alias("team"),
                F.coalesce((F.col("winner") == F.col(t)).cast("int"), F.lit(0)).alias("won"),
            )
            for t in ("team1", "team2")
        ]
    )
    decided = F.col("winner").isNotNull()
    return matches.select("id", "season", margin.alias("margin"), decided.alias("decided"), F.explode(sides).alias("s")
                          ).select("id", "season", "margin", "decided", "s.team", "s.won")


def team_form(matches: DataFrame, last: int = 5) -> DataFrame:
    """Last ``last`` matches per team and season; the rating divides by ``last`` even when fewer were played."""
    sides = both_sides(matches).filter(F.col("team").isNotNull() & F.col("season").isNotNull())
    recent = last_n(sides, ["team", "season"], [F.col("id").desc()], last)
    return recent.groupBy("team", "season").agg(
        F.sum("won").alias("last5_wins"),
        F.sum(1 - F.col("won")).alias("last5_losses"),
        ratio(F.sum("margin"), F.count("margin")).alias("avg_rr_diff"),
        ratio(F.sum("won"), F.lit(last), 100).alias("form_rating"),
    )


def pair_win_pct(matches: DataFrame) -> DataFrame:
    wins = F.count_if(F.col("winner") == F.col("team1"))
    return matches.groupBy("team1", "team2").agg(
        wins.alias("team1_wins"),
        F.count(F.lit(1)).alias("total"),
        (wins / F.count(F.lit(1))).alias("h2h_win_pct"),
    )


def rivalry_all_pairs(matches: DataFrame) -> DataFrame:
    """Every unordered pair and season; a normalised pair replaces the two-way OR."""
    lo, hi = F.least("team1", "team2"), F.greatest("team1", "team2")
    known = matches.filter(F.col("team1").isNotNull() & F.col("team2").isNotNull())
    return known.groupBy(lo.alias("t1"), hi.alias("t2"), "season").agg(
        F.count_if(F.col("winner") == lo).alias("t1_wins"),
        F.count_if(F.col("winner") == hi).alias("t2_wins"),
        F.count(F.lit(1)).alias("matches"),
    )


def rivalry_by_season(matches: DataFrame, team1: str, team2: str) -> DataFrame:
    lo, hi = sorted([team1, team2])
    same_pair = (F.least("team1", "team2") == lo) & (F.greatest("team1", "team2") == hi)
    return (
        matches.filter(same_pair)
        .groupBy("season")
        .agg(
            F.count_if(F.col("winner") == team1).alias("t1_wins"),
            F.count_if(F.col("winner") == team2).alias("t2_wins"),
            F.count(F.lit(1)).alias("matches"),
        )
        .orderBy("season")
    )


def season_summary(matches: DataFrame, career: DataFrame, venue: DataFrame) -> DataFrame:
    """Champion (most wins), runner-up (other finalist), leaders and averages of every season."""
    played = matches.filter(F.col("season").isNotNull())
    seasons = played.groupBy("season").agg(F.count(F.lit(1)).alias("total_matches"))
    champion = mode_per_group(played, ["season"], "winner").select("season", F.col("winner").alias("champion"))
    finals = last_n(played.filter(F.col("match_type") == "Final"), ["season"], [F.col("id")], 1).select(
        "season", F.col("team1").alias("f1"), F.col("team2").alias("f2"), F.col("winner").alias("final_winner")
    )

    def leader(role: str, measure: str, name: str, total: str) -> DataFrame:
        sums = career.filter(F.col("role") == role).groupBy("season", "player").agg(F.sum(measure).alias(total))
        return top_per_group(sums, ["season"], total, ["player"]).select(
            "season", F.col("player").alias(name), total
        )

    champ = F.coalesce(F.col("champion"), F.lit("Unknown"))
    return (
        seasons.join(champion, "season", "left")
        .join(finals, "season", "left")
        .join(leader("batsman", "runs", "top_scorer", "top_runs"), "season", "left")
        .join(leader("bowler", "wickets", "top_bowler", "top_wickets"), "season", "left")
        .join(season_avg_score(venue), "season", "left")
        .select(
            "season",
            champ.alias("champion"),
            F.when(F.col("f1") != champ, F.col("f1")).when(F.col("f2") != champ, F.col("f2"))
            .otherwise("Unknown").alias("runner_up"),
            "final_winner",
            F.coalesce("top_scorer", F.lit("N/A")).alias("top_scorer"),
            F.coalesce("top_runs", F.lit(0)).alias("top_runs"),
            F.coalesce("top_bowler", F.lit("N/A")).alias("top_bowler"),
            F.coalesce("top_wickets", F.lit(0)).alias("top_wickets"),
            "total_matches",
            F.coalesce("avg_score", F.lit(0.0)).alias("avg_score"),
        )
    )


def primary_team(deliveries: DataFrame) -> DataFrame:
    """The side a batter faced most balls for."""
    return mode_per_group(deliveries, ["batter"], "batting_team").select(
        F.col("batter").alias("player"), F.col("batting_team").alias("team"), F.col("n").alias("balls")
    )


def team_profile(matches: DataFrame, deliveries: DataFrame, top: int = 3) -> DataFrame:
    """All-time record of a team: seasons, results, titles and its leading run scorers."""
    record = both_sides(matches).filter(F.col("team").isNotNull()).groupBy("team").agg(
        F.count_distinct("season").alias("seasons"),
        F.sum("won").alias("wins"),
        F.count_if(F.col("decided") & (F.col("won") == 0)).alias("losses"),
    )
    titles = mode_per_group(matches.filter(F.col("season").isNotNull()), ["season"], "winner")
    titles = titles.groupBy(F.col("winner").alias("team")).agg(F.count(F.lit(1)).alias("titles"))
    runs = deliveries.groupBy(F.col("batting_team").alias("team"), "batter").agg(F.sum("batsman_runs").alias("runs"))
    best = top_per_group(runs, ["team"], "runs", ["batter"], top).groupBy("team").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rn", "batter"))), lambda s: s["batter"]), ", "
        ).alias("top_players")
    )
    return record.join(titles, "team", "left").join(best, "team", "left").select(
        "team", "seasons", F.coalesce("titles", F.lit(0)).alias("titles"), "wins", "losses",
        F.coalesce("top_players", F.lit("N/A")).alias("top_players"),
    )
