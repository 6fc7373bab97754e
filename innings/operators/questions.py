"""Named questions over the aggregate tables, in single and batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innings.functions.scalars import pct
from innings.operators.career import with_match
from innings.operators.ordered import last_n


def matchup(h2h: DataFrame, batter: str, bowler: str) -> DataFrame:
    return h2h.filter((F.col("batter") == batter) & (F.col("bowler") == bowler)).orderBy(F.col("balls").desc(), "phase")


def matchup_lookup(h2h: DataFrame, requests: DataFrame) -> DataFrame:
    """Many pairs at once: requests(request_id, batter, bowler), phases ranked by balls."""
    found = requests.join(h2h, ["batter", "bowler"])
    return last_n(found, ["request_id"], [F.col("balls").desc(), F.col("phase")], 3, "position")


def top_batters(career: DataFrame, n: int = 100) -> DataFrame:
    return (
        career.filter(F.col("role") == "batsman").groupBy("player").agg(F.sum("runs").alias("runs"))
        .orderBy(F.col("runs").desc(), "player").limit(n)
    )


def top_opponents(h2h: DataFrame, k: int = 5) -> DataFrame:
    return last_n(h2h, ["batter"], [F.col("balls").desc(), F.col("bowler"), F.col("phase")], k, "position")


def top_wickets(career: DataFrame, phase: str, season: int, n: int = 5) -> DataFrame:
    return (
        career.filter((F.col("role") == "bowler") & (F.col("phase") == phase) & (F.col("season") == season))
        .groupBy("player").agg(F.sum("wickets").alias("total_wickets"))
        .orderBy(F.col("total_wickets").desc(), "player").limit(n)
    )


def best_economy(career: DataFrame, phase: str, season: int, min_innings: int = 5, n: int = 10) -> DataFrame:
    return (
        career.filter(
            (F.col("role") == "bowler") & (F.col("phase") == phase) & (F.col("season") == season)
            & (F.col("innings") >= min_innings)
        )
        .select("player", "economy").orderBy("economy", "player").limit(n)
    )


def venue_latest(venue: DataFrame) -> DataFrame:
    return venue.groupBy("venue").agg(
        F.max("season").alias("season"), F.max_by("win_bat_first_pct", "season").alias("win_bat_first_pct")
    )


def player_sr_at_venue(career: DataFrame, matches: DataFrame, player: str, venue: str) -> DataFrame:
    """Distinct strike rates of the seasons in which the venue was used."""
    seasons = matches.filter(F.col("venue") == venue).select("season").distinct()
    rows = career.filter((F.col("player") == player) & (F.col("role") == "batsman"))
    return rows.join(seasons, "season", "left_semi").select("player", "strike_rate").distinct()


def player_sr_by_venue(deliveries: DataFrame, matches: DataFrame) -> DataFrame:
    """The venue-specific rate, from the balls actually bowled there."""
    balls = F.count(F.lit(1))
    return with_match(deliveries, matches, ("venue",)).groupBy(F.col("batter").alias("player"), "venue").agg(
        balls.alias("balls"), pct(F.sum("batsman_runs"), balls).alias("strike_rate")
    )


def prediction_requests(requests: DataFrame, venue: DataFrame, form: DataFrame) -> DataFrame:
    """Features of matches yet to be played; unknown keys take neutral values."""
    v = venue.select(
        "venue", "season", (F.col("win_bat_first_pct") / 100).alias("_pct"), F.col("avg_first_inn").alias("_avg")
    )
    f1 = form.select(F.col("team").alias("team1"), "season", (F.col("form_rating") / 100).alias("_f1"))
    f2 = form.select(F.col("team").alias("team2"), "season", (F.col("form_rating") / 100).alias("_f2"))
    return (
        requests.join(v, ["venue", "season"], "left")
        .join(f1, ["team1", "season"], "left")
        .join(f2, ["team2", "season"], "left")
        .withColumns({
            "h2h_win_pct": F.lit(0.5),
            "venue_bat_first_pct": F.coalesce("_pct", F.lit(0.5)),
            "venue_avg_score": F.coalesce("_avg", F.lit(160.0)),
            "team1_form": F.coalesce("_f1", F.lit(0.5)),
            "team2_form": F.coalesce("_f2", F.lit(0.5)),
            "team1_toss": F.coalesce((F.col("toss_winner") == F.col("team1")).cast("int"), F.lit(0)),
            "team1_strength": F.lit(0.5),
            "team2_strength": F.lit(0.5),
        })
        .drop("_pct", "_avg", "_f1", "_f2")
    )
