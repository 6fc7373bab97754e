"""Model training and scoring on the derived matches.

Both models are searched over their full ranges: ``WIN_TRIALS`` random settings in five stratified folds with early stopping,
``INTENT_TRIALS`` in three. ``INTENT_POINT`` is a small forest for the queries that only need some model.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from innings.functions.scalars import INTENT_CLASSES, encode_label
from innings.operators import features as X
from innings.operators import models as M
from innings.operators import quality as Qy
from innings.operators import questions as Q
from innings.operators import teams as T
from innings.plans.aggregates import venue_table, win_requests
from innings.plans.registry import query
from innings.plans.sql import sql
from innings.session import new_folder, stored
from innings.sources.adapter import matches, sequenced

CUTOFF = 2001
WIN_TRIALS, WIN_FOLDS = 100, 5
_FOUND: dict[tuple, tuple] = {}  # the search of a folder of tables, done once per session
INTENT_POINT = {"numTrees": 10, "maxDepth": 5, "subsamplingRate": 0.8}
INTENT_TRIALS, INTENT_FOLDS = 50, 3


def win_rows(spark, sf):
    rows = X.match_features(matches(spark, sf), venue_table(spark, sf)).withColumn("label", F.col("target"))
    return X.temporal_split(rows, "season", CUTOFF)


def intent_rows(spark, sf):
    """Both sides of the split from one table, so the features are made once, not for every pass over either."""
    rows = X.intent_features_prior(sequenced(spark, sf, by_match=True), matches(spark, sf))
    rows = stored(rows.where(F.col("season") <= CUTOFF).withColumn("label", encode_label("intent")), "intent-rows")
    return X.temporal_split(rows, "season", CUTOFF)


def searched(spark, sf):
    """Model and settings of the search, with the training rows and the hold-out season."""
    train, test = win_rows(spark, sf)
    at = (spark.sparkContext.applicationId, sf)
    if at not in _FOUND:
        _FOUND[at] = M.train_win_model(train, M.sample_grid(M.WIN_RANGES, WIN_TRIALS), WIN_FOLDS)
    return *_FOUND[at], train, test


def _calibration(train, best):
    """Isotonic map from scores that no row's own model has seen."""
    scores = M.out_of_fold_scores(train, {**best["params"], "maxIter": best["rounds"]}, WIN_FOLDS)
    return M.calibrate(scores), scores


@query("win_model")
def win_model(spark, sf):
    """Cross-validated AUC of the chosen settings, and hold-out AUC of their calibrated probabilities."""
    model, best, train, test = searched(spark, sf)
    scored = M.calibrated(_calibration(train, best)[0], M.score(model, test, X.WIN_FEATURES))
    auc = Qy.auc_rank(scored.drop("score"), "calibrated", "label")
    return auc.withColumns({"cv_auc": F.lit(round(best["score"], 6)), "max_depth": F.lit(best["params"]["maxDepth"]),
                            "rounds": F.lit(best["rounds"])})


@query("win_calibration")
def win_calibration(spark, sf):
    """Raw against calibrated probability in tenths of the score."""
    _, best, train, _ = searched(spark, sf)
    model, scores = _calibration(train, best)
    both = M.calibrated(model, scores)
    return both.groupBy(F.floor(F.col("score") * 10).alias("tenth")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean_score"),
        F.round(F.avg("calibrated"), 4).alias("mean_calibrated"), F.round(F.avg("label"), 4).alias("win_share"))


def _requests(spark, sf):
    return Q.prediction_requests(win_requests(spark, sf), venue_table(spark, sf), T.team_form(matches(spark, sf)))


@query("win_predictions")
def win_predictions(spark, sf):
    model, best, train, _ = searched(spark, sf)
    return M.predict_win(model, _requests(spark, sf), _calibration(train, best)[0]).select(
        "request_id", "team1", "team2", "team1_win_prob", "team2_win_prob")


@query("win_attribution")
def win_attribution(spark, sf):
    """The three features that count most for every request, by their share of the margin."""
    return M.attribution(searched(spark, sf)[0], _requests(spark, sf))


@query("stored_model", sql("d m", f"""
SELECT match_id, seq, TRUE AS same FROM d JOIN m ON m.id = d.match_id WHERE m.season = {CUTOFF}"""))
def stored_model(spark, sf):
    """A forest stored and read back scores the hold-out season as it did before."""
    train, test = intent_rows(spark, sf)
    model, _ = M.train_intent_model(train, X.PRIOR_FEATURES, [{"numTrees": 3, "maxDepth": 4}], folds=2)
    path = new_folder(spark, "model")
    M.save_model(model, X.PRIOR_FEATURES, path)
    again, features = M.load_model(path)
    before = M.score_intent(model, test, X.PRIOR_FEATURES, "h2h_balls").select(
        "match_id", "seq", F.map_values("probabilities").alias("p"))
    after = M.score_intent(again, test, features, "h2h_balls").select(
        "match_id", "seq", F.map_values("probabilities").alias("q"))
    return before.join(after, ["match_id", "seq"]).select("match_id", "seq", (F.col("p") == F.col("q")).alias("same"))


@query("intent_model")
def intent_model(spark, sf):
    """Per-class report of the chosen settings on the hold-out season."""
    train, test = intent_rows(spark, sf)
    grid = M.sample_grid(M.INTENT_RANGES, INTENT_TRIALS)
    model, _ = M.search_intent_model(train, X.PRIOR_FEATURES, grid, INTENT_FOLDS)
    scored = M.score_intent(model, test, X.PRIOR_FEATURES, "h2h_balls")
    return Qy.classification_report(scored, "intent", "predicted_intent")


@query("intent_scores")
def intent_scores(spark, sf):
    train, test = intent_rows(spark, sf)
    model, _ = M.train_intent_model(train, X.PRIOR_FEATURES, [INTENT_POINT], folds=2)
    scored = M.score_intent(model, test, X.PRIOR_FEATURES, "h2h_balls")
    return scored.select(
        "match_id", "seq", "predicted_intent", "confidence_flag",
        *[F.col("probabilities")[c].alias(f"p_{c}") for c in INTENT_CLASSES])
