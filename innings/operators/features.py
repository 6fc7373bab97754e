"""Feature matrices of the two models, with and without outcome leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from innings.functions.scalars import INTENT_CLASSES, intent_label, phase_enc
from innings.operators import windows as W
from innings.operators.career import global_h2h_sr, with_match
from innings.operators.ordered import Sequenced, dealt, match_block, running
from innings.operators.teams import pair_win_pct, team_form

WIN_FEATURES = [
    "h2h_win_pct", "venue_bat_first_pct", "venue_avg_score", "team1_form", "team2_form", "team1_toss",
    "team1_strength", "team2_strength",
]

# Names the features carry at scoring time: fixed values of the event format.
SERVING_NAMES = {"ball": "ball_num", "h2h_sr_global": "h2h_sr"}

INTENT_FEATURES = [
    "over", "ball_num", "phase_enc", "current_rr", "required_rr", "pressure_index", "wickets_remaining",
    "cum_runs", "cum_balls", "h2h_sr", "bowler_last3_runs", "bowler_economy", "bowler_spell_balls",
    "batter_last5_avg", "bowler_type_enc", "inning", "extra_runs", "total_runs", "season",
]

# Without the outcome of the ball itself.
PRIOR_FEATURES = [c for c in INTENT_FEATURES if c not in ("extra_runs", "total_runs")]


def join_both_sides(matches: DataFrame, by_team: DataFrame, col: str, names: tuple[str, str], default: float) -> DataFrame:
    """The same team table joined once per side."""
    out = matches
    for side, name in zip(("team1", "team2"), names):
        right = by_team.select(F.col("team").alias(side), "season", F.col(col).alias("_v"))
        out = out.join(right, [side, "season"], "left").withColumn(
            name, F.coalesce(F.col("_v"), F.lit(default)) / 100.0
        ).drop("_v")
    return out


def match_features(matches: DataFrame, venue: DataFrame, form: DataFrame | None = None,
                   strength: DataFrame | None = None) -> DataFrame:
    """One row per decided match. The pair ratio is over the ordered pair and includes the match itself."""
    form = team_form(matches) if form is None else form
    pairs = pair_win_pct(matches).select("team1", "team2", "h2h_win_pct")
    grounds = venue.select(
        "venue", "season", F.col("win_bat_first_pct").alias("_pct"), F.col("avg_first_inn").alias("_avg")
    )
    base = matches.filter(F.col("winner").isNotNull()).select(
        "id", "season", "venue", "team1", "team2", "toss_winner", "toss_decision", "winner"
    )
    out = base.join(pairs, ["team1", "team2"], "left").join(grounds, ["venue", "season"], "left")
    out = join_both_sides(out, form, "form_rating", ("team1_form", "team2_form"), 50.0)
    if strength is None:
        out = out.withColumns({"team1_strength": F.lit(0.5), "team2_strength": F.lit(0.5)})
    else:
        out = join_both_sides(out, strength, "strength_index", ("team1_strength", "team2_strength"), 50.0)
    return out.withColumns({
        "h2h_win_pct": F.coalesce("h2h_win_pct", F.lit(0.5)),
        "venue_bat_first_pct": F.coalesce("_pct", F.lit(50.0)) / 100.0,
        "venue_avg_score": F.coalesce("_avg", F.lit(160.0)),
        "team1_toss": F.coalesce((F.col("toss_winner") == F.col("team1")).cast("int"), F.lit(0)),
        "target": (F.col("winner") == F.col("team1")).cast("int"),
    }).select(*base.columns, *WIN_FEATURES, "target")


def temporal_split(df: DataFrame, col: str, cutoff: int) -> tuple[DataFrame, DataFrame]:
    """Everything before the cut-off season, and that season; later rows are in neither."""
    return df.filter(F.col(col) < cutoff), df.filter(F.col(col) == cutoff)


def attach(df: DataFrame, aggregate: DataFrame, on: list[str], defaults: dict) -> DataFrame:
    """Group figures back on their rows; a skewed group is split by the adaptive join."""
    return df.join(aggregate, on, "left").fillna(defaults)


def serving_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in SERVING_NAMES.items() if k in df.columns})


def _labelled(balls: Sequenced, matches: DataFrame) -> Sequenced:
    return balls.with_rows(with_match(balls.rows, matches).withColumns({
        "season": F.coalesce("season", F.lit(2023)), "phase_enc": phase_enc("phase"), "intent": intent_label(),
    }))


def intent_features(deliveries: DataFrame | Sequenced, matches: DataFrame) -> DataFrame:
    """Per-ball matrix of the after-the-ball figures (they include the ball's own outcome)."""
    balls = _labelled(Sequenced.of(deliveries), matches)
    innings = W.with_required_rate(W.with_rates(W.innings_progress(balls)))
    bowled = W.bowler_last3(balls.with_rows(W.bowler_spell(balls.with_rows(innings))))
    pairs = attach(bowled, global_h2h_sr(balls.plain), ["batter", "bowler"], {"h2h_sr_global": 100.0})
    runs = balls.plain.groupBy("batter", "match_id").agg(
        F.sum("batsman_runs").cast("double").alias("batter_last5_avg")
    )
    out = attach(pairs, runs, ["batter", "match_id"], {"batter_last5_avg": 20.0})
    out = serving_names(out.withColumn("bowler_type_enc", F.lit(0)))
    return out.select("match_id", "seq", *INTENT_FEATURES, "intent")


def _prior_pair_rate(balls: Sequenced) -> DataFrame:
    """Strike rate of the pair before the ball: earlier matches plus this match so far."""
    pair = ["batter", "bowler"]
    per_match = balls.plain.groupBy(*pair, "match_id").agg(
        F.sum("batsman_runs").alias("_r"), F.count(F.lit(1)).alias("_b")
    ).withColumn("_block", match_block())
    earlier = running(per_match, pair, ["match_id"], [["_block"]],
                      {"_er": F.col("_r"), "_eb": F.col("_b")}, prior=True).select(*pair, "match_id", "_er", "_eb")
    inside = running(balls.rows, [*pair, "match_id"], ["seq"], [["chunk"]],
                     {"_ir": F.col("batsman_runs"), "_ib": F.lit(1)}, True, balls.hot)
    runs, faced = F.col("_ir") + F.col("_er"), F.col("_ib") + F.col("_eb")
    rated = inside.join(earlier, [*pair, "match_id"], "left").withColumns({
        "h2h_balls": faced, "h2h_sr_global": F.when(faced > 0, runs * 100.0 / faced).otherwise(100.0),
    })
    return rated.drop("_ir", "_ib", "_er", "_eb")


def _history(balls: DataFrame, plain: DataFrame, size: int) -> DataFrame:
    """``balls`` with the pair's and the batter's record before each ball, by windows over a batter's block of matches.

    What a ball needs from elsewhere comes in as rows of their own in front of it (the pair's sums before the block, the
    batter's form before the match), so no ball is moved for a join.
    """
    pair = ["batter", "bowler"]
    known = plain.filter(F.col("batter").isNotNull())
    sums = known.filter(F.col("bowler").isNotNull()).groupBy(*pair, match_block().alias("_block")).agg(
        F.sum("batsman_runs").alias("_r"), F.count(F.lit(1)).alias("_b"))
    pairs = running(sums, pair, ["_block"], [], {"_runs": F.col("_r"), "_faced": F.col("_b")}, prior=True).select(
        *pair, "_block", "_runs", "_faced")
    # A batter's balls of a match meet in one part, so no task holds more innings than balls dealt to it.
    form = W.batter_form(dealt(known.select("batter", "match_id", "batsman_runs"), size, "match_id")).select(
        "batter", match_block().alias("_block"), F.col("match_id").alias("_at"), F.col("prev_avg").alias("_form"))

    rows = balls.withColumns({
        "_block": match_block(), "_at": F.col("match_id"), "_runs": F.col("batsman_runs"), "_faced": F.lit(1), "_ball": F.lit(True),
    }).unionByName(pairs, allowMissingColumns=True).unionByName(form, allowMissingColumns=True)
    rows = dealt(rows, size, "batter", "_block")
    of_batter = Window.partitionBy("batter", "_block").orderBy("_at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    of_pair = Window.partitionBy(*pair, "_block").orderBy("_at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("batter_last5_avg", F.coalesce(F.last("_form", ignorenulls=True).over(of_batter), F.lit(20.0)))
    rows = rows.withColumns({n: F.coalesce(F.sum(n).over(of_pair), F.lit(0)) for n in ("_runs", "_faced")})
    faced = F.when(F.col("batter").isNotNull() & F.col("bowler").isNotNull(), F.col("_faced"))
    return rows.filter("_ball").withColumns({
        "h2h_balls": faced, "h2h_sr_global": F.when(faced > 0, F.col("_runs") * 100.0 / faced).otherwise(100.0)})


def intent_features_prior(deliveries: DataFrame | Sequenced, matches: DataFrame) -> DataFrame:
    """Per-ball matrix of what was known before the ball, for training and scoring.

    Balls are shuffled twice: by match, and by batter and block of matches. Rates are derived behind the second shuffle,
    which moves their counts only. With hot matches the figures come by joins.
    """
    balls = Sequenced.of(deliveries)
    if balls.size is None:
        return _prior_by_joins(balls, matches)
    match = Window.partitionBy("match_id")
    target = F.sum(F.when(F.col("inning") == 1, F.col("total_runs"))).over(match) + 1
    rows = balls.with_rows(balls.rows.withColumn("target", target))
    rows = balls.with_rows(W.innings_progress(rows, prior=True))
    rows = W.bowler_last3(balls.with_rows(W.spell_sums(rows, prior=True)))
    games = matches.select(F.col("id").alias("_id"), F.coalesce("season", F.lit(2023)).alias("season"), F.lit(True).alias("_known"))
    rows = rows.drop("season").join(games, F.col("match_id") == F.col("_id"), "left").select(
        "match_id", "seq", "batter", "bowler", "inning", "over", "ball", "batsman_runs", "target", "cum_runs", "cum_balls",
        "cum_wickets", "bowler_spell_balls", "bowler_spell_runs", "bowler_last3_runs", "season", "_known",
        phase_enc("phase").alias("phase_enc"), intent_label().alias("intent"))
    out = _history(rows, balls.plain, balls.size).filter("_known")
    out = W.with_economy(W.with_chase_rate(W.with_rates(out), W.balls_left() + 1))
    out = serving_names(out.withColumn("bowler_type_enc", F.lit(0)))
    return out.select("match_id", "seq", *PRIOR_FEATURES, "h2h_balls", "target", "intent")


def _prior_by_joins(balls: Sequenced, matches: DataFrame) -> DataFrame:
    """The same rows where matches may be hot: figures of a hot match run in its chunks, the others are joined."""
    balls = _labelled(balls, matches)
    innings = W.with_rates(W.innings_progress(balls, prior=True))
    innings = innings.join(W.chase_target(balls.plain), F.col("match_id") == F.col("_m"), "left").drop("_m")
    innings = W.with_chase_rate(innings, W.balls_left() + 1)
    bowled = W.bowler_last3(balls.with_rows(W.bowler_spell(balls.with_rows(innings), prior=True)))
    rated = _prior_pair_rate(balls.with_rows(bowled))
    form = W.batter_form(balls.plain).select("batter", "match_id", F.col("prev_avg").alias("batter_last5_avg"))
    out = attach(rated, form, ["batter", "match_id"], {"batter_last5_avg": 20.0})
    out = serving_names(out.withColumn("bowler_type_enc", F.lit(0)))
    return out.select("match_id", "seq", *PRIOR_FEATURES, "h2h_balls", "target", "intent")


def serving_features(events: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Model inputs of a live event: derived where the event lacks them, neutral where they cannot be known."""
    def given(name: str):
        return F.col(name) if name in events.columns else F.lit(None)

    balls = F.when(given("cum_balls") != 0, given("cum_balls"))
    values = {
        "wickets_remaining": F.coalesce(given("wickets_remaining").cast("int"), 10 - F.col("wickets_fallen")),
        "cum_balls": F.coalesce(balls.cast("int"), F.col("over") * 6 + F.col("ball_num")),
        # Neutral inputs for what is unknown before the ball.
        "extra_runs": F.coalesce(given("extra_runs").cast("double"), F.lit(0.0)),
        "total_runs": F.coalesce(given("total_runs").cast("double"), F.lit(1.0)),
        "h2h_sr": F.coalesce(given("h2h_sr").cast("double"), given("h2h_sr_global").cast("double"), F.lit(100.0)),
    }
    return events.withColumns(values)


def schema_drift(features: list[str], df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Missing model inputs, and the frame with them filled by zero."""
    missing = [c for c in features if c not in df.columns]
    return (df.withColumns({c: F.lit(0.0) for c in missing}) if missing else df), missing


__all__ = ["INTENT_CLASSES", "INTENT_FEATURES", "PRIOR_FEATURES", "WIN_FEATURES"]
