"""Hot groups: results must not depend on how a group is cut."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from innings.operators import features as X
from innings.operators import ordered as O
from innings.operators import windows as W
from innings.operators.quality import auc_rank, latency_summary
from innings.operators.sessions import sessionize
from innings.sources.adapter import matches, sequenced


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or sorted(df.columns))).collect()), key=repr)


@pytest.fixture()
def skewed(spark):
    """One match holds a third of all balls, with few bowlers and out-of-order rows."""
    hot = spark.range(600).select(F.lit(7).cast("long").alias("match_id"), (F.col("id") + 1).alias("seq"))
    rest = spark.range(1200).select((F.col("id") % 30 + 100).alias("match_id"), (F.expr("id div 30") + 1).alias("seq"))
    n = F.xxhash64("match_id", "seq")
    return hot.unionByName(rest).select(
        "match_id", "seq",
        F.when(F.col("seq") <= 300, 1).otherwise(2).alias("inning"),
        F.pmod(F.expr("seq div 6"), F.lit(20)).cast("int").alias("over"),
        (F.pmod("seq", F.lit(6)) + 1).cast("int").alias("ball"),
        F.concat(F.lit("W"), F.pmod(n, F.lit(3)).cast("string")).alias("bowler"),
        F.concat(F.lit("B"), F.pmod(n, F.lit(4)).cast("string")).alias("batter"),
        F.pmod(n, F.lit(7)).cast("int").alias("batsman_runs"), F.pmod(n, F.lit(2)).cast("int").alias("extra_runs"),
        (F.pmod(n, F.lit(7)) + F.pmod(n, F.lit(2))).cast("int").alias("total_runs"),
        (F.pmod(n, F.lit(11)) == 0).alias("is_wicket"),
        F.when(F.pmod(n, F.lit(11)) == 0, "caught").alias("dismissal_kind"),
        F.lit("middle").alias("phase"),
    ).orderBy(F.rand(3))


@pytest.fixture()
def small_chunks(monkeypatch):
    monkeypatch.setattr(O, "CHUNK_BITS", 3)
    monkeypatch.setattr(O, "BLOCK_BITS", 1)


def test_hot_keys_are_few_and_right(skewed):
    hot = O.hot_keys(skewed, "match_id", share=0.1, floor=100)
    assert [r[0] for r in hot.collect()] == [7]
    assert O.hot_keys(skewed, "match_id").count() == 0


def test_hot_match_windows_equal_plain_windows(skewed, small_chunks):
    balls = O.Sequenced.of(skewed, share=0.1, floor=100)
    assert balls.hot.count() == 600 and balls.rows.select("chunk").distinct().count() > 50
    w = Window.partitionBy("match_id", "inning").orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    plain = skewed.select(
        "match_id", "seq", F.sum("total_runs").over(w).alias("cum_runs"),
        F.count(F.lit(1)).over(w).alias("cum_balls"), F.sum(F.col("is_wicket").cast("int")).over(w).alias("cum_wickets"))
    assert rows(W.innings_progress(balls), *plain.columns) == rows(plain, *plain.columns)
    prior = skewed.select("match_id", "seq", F.coalesce(F.sum("total_runs").over(before), F.lit(0)).alias("cum_runs"))
    assert rows(W.innings_progress(balls, prior=True), "match_id", "seq", "cum_runs") == rows(
        prior, "match_id", "seq", "cum_runs")
    b = Window.partitionBy("match_id", "bowler").orderBy("seq")
    last3 = skewed.select("match_id", "seq", F.coalesce(F.sum("total_runs").over(b.rowsBetween(-3, -1)), F.lit(0)).alias("v"))
    assert rows(W.bowler_last3(balls), "match_id", "seq", "bowler_last3_runs") == rows(last3, "match_id", "seq", "v")
    spell = skewed.select("match_id", "seq", F.count(F.lit(1)).over(b).alias("n"), F.sum("total_runs").over(b).alias("r"))
    assert rows(W.bowler_spell(balls), "match_id", "seq", "bowler_spell_balls", "bowler_spell_runs") == rows(
        spell, "match_id", "seq", "n", "r")


def test_batter_form_across_blocks(skewed, small_chunks):
    totals = skewed.groupBy("batter", "match_id").agg(F.sum("batsman_runs").alias("inn_runs"))
    w = Window.partitionBy("batter").orderBy("match_id").rowsBetween(-5, -1)
    plain = totals.select("batter", "match_id", "inn_runs", F.coalesce(F.avg("inn_runs").over(w), F.lit(20.0)).alias("prev_avg"))
    assert rows(W.batter_form(skewed), *plain.columns) == rows(plain, *plain.columns)


def test_prior_features_do_not_depend_on_cuts(spark, skewed, small_chunks):
    games = skewed.select("match_id").distinct().select(F.col("match_id").alias("id"), F.lit(1999).alias("season"))
    cut = X.intent_features_prior(O.Sequenced.of(skewed, share=0.1, floor=100), games)
    whole = X.intent_features_prior(O.Sequenced.of(skewed), games)
    assert rows(cut) == rows(whole)


def test_prior_features_move_balls_twice(spark, sf, monkeypatch):
    """By match, and by batter and block; parts grow in number, not in size."""
    monkeypatch.setattr(O, "TASK_ROWS", 500)
    balls = sequenced(spark, sf, by_match=True)
    n = -(-balls.plain.count() // 500)
    assert balls.size == balls.plain.count() and balls.rows.rdd.getNumPartitions() == n
    df = X.intent_features_prior(balls, matches(spark, sf))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "cum_runs" in plan and plan.count(f", {n}), REPARTITION_BY_NUM") <= 4  # and innings, twice
    assert len(rows(df)) == balls.size


def test_prior_features_of_odd_balls(spark, small_chunks):
    """Nulls, unknown matches and matches without a first innings, with cuts and without."""
    facts = [(m, s, b, w, i, s // 6, 1 + s % 6, (s * 7 + (m or 0)) % 5) for m in (1, 2, 5, 9, 40, 41, None)
             for s, (b, w, i) in enumerate([("a", "x", 1), ("b", None, 1), (None, "x", 1), ("a", "x", 2), ("a", "y", 2), ("b", "x", 3)] * 4, 1)
             if m != 5 or i > 1]
    balls = spark.createDataFrame(facts, "match_id long, seq long, batter string, bowler string, inning int, over int, ball int, "
                                  "batsman_runs int").selectExpr(
        "*", "0 as extra_runs", "batsman_runs as total_runs", "cast(null as string) as dismissal_kind", "'middle' as phase",
        "seq % 5 = 0 as is_wicket")
    games = spark.createDataFrame([(1, 1999), (2, None), (5, 2000), (40, 2001), (41, 2001)], "id long, season int")
    whole = O.Sequenced.of(balls)
    assert whole.size == balls.count()
    assert rows(X.intent_features_prior(whole, games)) == rows(X._prior_by_joins(whole, games))


def test_numbering_of_a_hot_match(spark, sf, monkeypatch):
    cut, whole = sequenced(spark, sf, share=0.0, floor=150), sequenced(spark, sf)
    assert cut.hot.count() > 0
    assert rows(cut.rows.drop("chunk")) == rows(whole.rows.drop("chunk"))
    assert rows(cut.hot.drop("chunk")) == rows(whole.rows.drop("chunk").join(cut.hot.select("match_id").distinct(), "match_id", "left_semi"))


def test_input_order_does_not_matter(spark, sf):
    games = matches(spark, sf)
    balls = sequenced(spark, sf).rows.drop("chunk")
    a = X.intent_features(balls.orderBy(F.rand(1)), games)
    b = X.intent_features(balls.orderBy(F.rand(2)), games)
    assert rows(a) == rows(b)


def test_running_with_nested_levels(spark):
    df = spark.range(500).select(
        F.pmod("id", F.lit(2)).alias("k"), F.col("id").alias("t"), F.expr("id div 10").alias("a"), F.expr("id div 100").alias("b"))
    out = O.running(df, ["k"], ["t"], [["a"], ["b"]], {"s": F.col("t")})
    w = Window.partitionBy("k").orderBy("t")
    assert rows(out, "k", "t", "s") == rows(df.select("k", "t", F.sum("t").over(w).alias("s")), "k", "t", "s")


def test_rank_statistics_with_ties(spark):
    data = [(0.1, 0), (0.4, 0), (0.4, 1), (0.4, 1), (0.8, 1), (0.8, 0), (0.9, 1)] * 5
    df = spark.createDataFrame(data, "score double, label int")
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc_rank(df, "score", "label").first()["auc"] == pytest.approx(want, abs=1e-6)
    same = spark.createDataFrame([(0.5, i % 2) for i in range(10)], "score double, label int")
    assert auc_rank(same, "score", "label").first()["auc"] == 0.5


def test_latency_summary_of_one_hot_value(spark):
    df = spark.createDataFrame([(5.0,)] * 90 + [(float(i),) for i in range(100, 110)], "v double")
    r = latency_summary(df, "v", 300).first()
    assert (r["n"], r["min"], r["p50"], r["p95"], r["within_limit"]) == (100, 5.0, 5.0, 105.0, True)


def test_sessions_across_slices(spark):
    times = [(1, t) for t in (0, 100, 1899, 3698, 9000)] + [(2, 50)] + [(3, i * 10) for i in range(300)]
    df = spark.createDataFrame(times, "u int, s long").withColumn("ts", F.timestamp_seconds("s"))
    for slices in (1, 3, 1000):
        got = sorted((r["u"], r["n"]) for r in sessionize(df, "u", "ts", 1800, slices).collect())
        assert got == [(1, 1), (1, 4), (2, 1), (3, 300)]
