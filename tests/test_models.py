import pytest
from pyspark.sql import functions as F

from innings.functions.scalars import INTENT_CLASSES, decode_label, encode_label
from innings.operators import features as X
from innings.operators import models as M


def test_feature_lists():
    assert len(X.WIN_FEATURES) == len(set(X.WIN_FEATURES)) == 8
    assert len(X.INTENT_FEATURES) == len(set(X.INTENT_FEATURES)) == 19
    assert INTENT_CLASSES == sorted(INTENT_CLASSES) and len(INTENT_CLASSES) == 4
    assert set(X.PRIOR_FEATURES) == set(X.INTENT_FEATURES) - {"extra_runs", "total_runs"}


def test_labels_round_trip(spark):
    df = spark.createDataFrame([(c,) for c in INTENT_CLASSES], "intent string")
    rows = df.select("intent", encode_label("intent").alias("i")).withColumn("back", decode_label("i")).collect()
    assert all(r["intent"] == r["back"] and INTENT_CLASSES[r["i"]] == r["intent"] for r in rows)


def test_grid_stays_in_range():
    for point in M.sample_grid(M.WIN_RANGES, 50):
        for name, (low, high) in M.WIN_RANGES.items():
            assert low <= point[name] <= high
    assert M.sample_grid(M.INTENT_RANGES, 3) == M.sample_grid(M.INTENT_RANGES, 3)


def test_schema_drift(spark):
    filled, missing = X.schema_drift(["id", "x"], spark.range(1))
    assert missing == ["x"] and filled.first()["x"] == 0.0


@pytest.fixture(scope="module")
def wins(spark):
    n = F.xxhash64("id")
    df = spark.range(200).select("id", *[(F.pmod(n + i, F.lit(100)) / 100).alias(c) for i, c in enumerate(X.WIN_FEATURES)])
    return df.withColumn("label", (F.col("team1_form") > 0.5).cast("int"))


def test_win_model_search_calibration_and_attribution(spark, wins, tmp_path):
    grid = [{"maxIter": 3, "maxDepth": 2, "featureSubset": 0.9}, {"maxIter": 2, "maxDepth": 1}]
    model, best = M.train_win_model(wins, grid, folds=2)
    assert best["score"] > 0.9 and best["params"] in grid and 1 <= best["rounds"] <= best["params"]["maxIter"]
    scores = M.out_of_fold_scores(wins, {"maxIter": 2, "maxDepth": 2}, folds=2)
    assert scores.count() == 200
    iso = M.calibrate(scores)
    mapped = M.calibrated(iso, scores).orderBy("score").collect()
    assert all(a["calibrated"] <= b["calibrated"] + 1e-9 for a, b in zip(mapped, mapped[1:]))
    asked = wins.withColumnRenamed("id", "request_id")
    for r in M.predict_win(model, asked, iso).collect():
        assert 0 <= r["team1_win_prob"] <= 1 and r["team1_win_prob"] + r["team2_win_prob"] == pytest.approx(1, abs=1e-6)
    top = M.attribution(model, asked).collect()
    assert len(top) == 600 and all(r["feature"] == "team1_form" for r in top if r["position"] == 1 and r["magnitude"] > 0.2)
    M.save_model(model, X.WIN_FEATURES, str(tmp_path / "m"))
    again, names = M.load_model(str(tmp_path / "m"))
    assert names == X.WIN_FEATURES
    assert M.score(again, wins, names).orderBy("id").collect() == M.score(model, wins, names).orderBy("id").collect()


def test_folds_hold_equal_parts_of_every_class(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 == 0, 1).when(F.col("id") < 37, None).otherwise(0).alias("label"))
    got = M.with_folds(df.repartition(5), ["id"], 5).cache()
    n = {(r["label"], r["fold"]): r["count"] for r in got.groupBy("label", "fold").count().collect()}
    for label in (0, 1, None):
        parts = [n.get((label, f), 0) for f in range(5)]
        assert max(parts) - min(parts) <= 1
    assert got.count() == 3000 and got.columns == ["id", "label", "fold"]
    again = {r["id"]: r["fold"] for r in M.with_folds(df.repartition(2), ["id"], 5).collect()}
    assert again == {r["id"]: r["fold"] for r in got.collect()}


def test_training_rows_lie_in_as_few_parts_as_their_number_needs(spark, wins, monkeypatch):
    few = M.in_few_parts(wins.repartition(50))
    assert few.rdd.getNumPartitions() == 1 and sorted(few.collect()) == sorted(wins.collect())
    assert M.in_few_parts(wins.where("id < 0")).count() == 0
    monkeypatch.setattr(M, "TASK_ROWS", 30)
    some = M.in_few_parts(wins.repartition(50))
    assert some.rdd.getNumPartitions() == 7 and some.count() == 200


def test_early_stopping_ends_a_search_of_many_rounds(spark, wins):
    noise = wins.withColumn("label", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(2)).cast("int"))
    _, best = M.train_win_model(noise, [{"maxIter": 200, "maxDepth": 2}], folds=2)
    assert best["rounds"] < 60


def test_contributions_against_all_subsets(spark, wins):
    """Shapley values by their definition: every set of known features, unknown ones weighted by training rows."""
    from itertools import combinations
    from math import factorial

    import numpy as np

    from innings.operators import contributions as K

    mixed = wins.withColumn("label", ((F.col("team1_form") + F.col("team2_form") * F.col("h2h_win_pct")) > 0.7).cast("int"))
    model, _ = M.train_win_model(mixed, [{"maxIter": 4, "maxDepth": 4}], folds=2)
    every = K.leaves(model)
    rows = mixed.orderBy("id").limit(12).toPandas()
    x = rows[X.WIN_FEATURES].to_numpy(float)

    def value(row, known):
        total = 0.0
        for leaf in every:
            part = leaf.value
            for f, low, high, share in zip(leaf.features, leaf.low, leaf.high, leaf.share):
                part *= float(low < row[f] <= high) if f in known else share
            total += part
        return total

    n = len(X.WIN_FEATURES)
    got = K.shapley(every, x)
    for row, values in zip(x[:4], got[:4]):
        worth = {s: value(row, s) for k in range(n + 1) for s in combinations(range(n), k)}
        for f in range(n):
            want = sum(factorial(len(s)) * factorial(n - len(s) - 1) / factorial(n)
                       * (worth[tuple(sorted((*s, f)))] - w) for s, w in worth.items() if f not in s)
            assert values[f] == pytest.approx(want, abs=1e-9)
    scored = model.transform(spark.createDataFrame(rows)).orderBy("id").collect()
    margins = [r["rawPrediction"][1] for r in scored]
    assert K.base(every) + got.sum(1) == pytest.approx(margins, abs=1e-9)
    told = K.contributions(model, mixed, X.WIN_FEATURES, ["id"]).groupBy("id").agg(F.sum("value"), F.first("margin"))
    assert all(r[1] + K.base(every) == pytest.approx(r[2]) for r in told.collect())


def test_intent_rows_are_made_once(spark, sf):
    """Both sides of the split are read from one stored table: no window or shuffle runs again for a pass over them."""
    from innings.plans.models import CUTOFF, intent_rows

    train, test = intent_rows(spark, sf)
    for side in (train, test):
        plan = side._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Exchange" not in plan
    assert train.where(f"season >= {CUTOFF}").isEmpty() and test.where(f"season <> {CUTOFF}").isEmpty()
    assert train.count() > 0 and test.count() > 0


def test_forest_search_keeps_one_copy_of_its_rows(spark):
    """The settings with the best mean over the folds win, and no fit adds a cached copy of the rows."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    kept = []

    class Watching(MulticlassClassificationEvaluator):
        def evaluate(self, dataset):
            kept.append(spark._jsparkSession.sharedState().cacheManager().numCachedEntries())
            return super().evaluate(dataset)

    df = spark.range(300).select("id", (F.col("id") % 20).alias("a"), (F.col("id") % 20 >= 10).cast("int").alias("label"))
    before = spark._jsparkSession.sharedState().cacheManager().numCachedEntries()
    grid = [{"numTrees": 1, "maxDepth": 0}, {"numTrees": 3, "maxDepth": 3}]
    model, best = M._search(df, RandomForestClassifier(seed=1), grid, ["a"], ["id"], 3, 1, Watching(metricName="accuracy"))
    assert best["params"] == grid[1] and best["score"] > 0.95
    assert len(kept) == 6 and set(kept) == {before + 1}
    assert spark._jsparkSession.sharedState().cacheManager().numCachedEntries() == before
    assert model.transform(df.withColumn("a", F.col("a").cast("double"))).where("prediction <> label").isEmpty()


def test_intent_scores(spark):
    n = F.xxhash64("seq")
    df = spark.range(400).select(F.lit(1).alias("match_id"), F.col("id").alias("seq"), F.lit(10).alias("h2h_balls")).withColumns({
        "over": F.pmod(n, F.lit(20)), "inning": F.lit(1)}).withColumn("label", F.expr("over div 5"))
    model, _ = M.train_intent_model(df, ["over", "inning"], [{"numTrees": 3, "maxDepth": 3}], folds=2)
    rows = M.score_intent(model, df.drop("inning"), ["over", "inning"], "h2h_balls").collect()
    assert all(sum(r["probabilities"].values()) == pytest.approx(1, abs=1e-3) and r["confidence_flag"] for r in rows)
    assert sum(INTENT_CLASSES.index(r["predicted_intent"]) == r["label"] for r in rows) > 360


def test_win_search_tries_all_settings_over_all_folds(spark, wins, monkeypatch):
    """A hundred settings of the full ranges, five folds each, and no core idle while fits are left."""
    from innings.plans import models

    asked = {}

    def train(rows, grid, folds):
        asked.update(grid=grid, folds=folds)
        return None, {}

    monkeypatch.setattr(models, "win_rows", lambda spark, sf: (wins, wins))
    monkeypatch.setattr(models, "_FOUND", {})
    monkeypatch.setattr(M, "train_win_model", train)
    models.searched(spark, "none")
    assert asked["grid"] == M.sample_grid(M.WIN_RANGES, 100) and asked["folds"] == 5
    cores = spark.sparkContext.defaultParallelism
    assert M._fits_at_once(wins.coalesce(1)) == cores and M._fits_at_once(wins.repartition(cores + 1)) == 1


def test_small_steps_go_on_while_the_left_out_fold_gains(spark, wins):
    _, best = M.train_win_model(wins, [{"maxIter": 12, "maxDepth": 2, "stepSize": 0.01}], folds=2)
    assert best["rounds"] == 12
