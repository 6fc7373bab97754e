"""Ordered windows and feature matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from innings.functions import scalars as S
from innings.operators import features as X
from innings.operators import windows as W
from innings.operators.asof import asof_join
from innings.operators.ordered import match_block, running
from innings.plans.aggregates import venue_table
from innings.plans.registry import query
from innings.plans.sql import add_block, even, isum, sql
from innings.sources.adapter import deliveries, matches, sequenced, table, with_teams

_INN = "(PARTITION BY match_id, inning ORDER BY seq)"
_BOWL = "(PARTITION BY match_id, bowler ORDER BY seq)"

add_block("prog", f"""
prog AS (
 SELECT *, {even('cum_runs / cum_balls * 6')} AS current_rr, 10 - cum_wickets AS wickets_remaining FROM (
  SELECT d.*, CAST(SUM(total_runs) OVER {_INN} AS BIGINT) AS cum_runs,
   CAST(COUNT(*) OVER {_INN} AS BIGINT) AS cum_balls,
   CAST(SUM(CASE WHEN dismissal_kind IS NOT NULL THEN 1 ELSE 0 END) OVER {_INN} AS BIGINT) AS cum_wickets
  FROM d) q)""", ["d"])

_PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _prior(expr: str, by: str, order: str = "seq") -> str:
    return f"CAST(COALESCE(SUM({expr}) OVER (PARTITION BY {by} ORDER BY {order} {_PRIOR}), 0) AS BIGINT)"


add_block("last3", f"""
last3 AS (
 SELECT match_id, seq, CAST(COALESCE(SUM(total_runs) OVER (PARTITION BY match_id, bowler ORDER BY seq
   ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bowler_last3_runs,
  CAST(COUNT(*) OVER {_BOWL} AS BIGINT) AS bowler_spell_balls,
  CAST(SUM(total_runs) OVER {_BOWL} AS BIGINT) AS bowler_spell_runs FROM d)""", ["d"])

add_block("bi", """
bi AS (
 SELECT batter, match_id, inn_runs, COALESCE(AVG(inn_runs) OVER (PARTITION BY batter ORDER BY match_id
   ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 20.0) AS prev_avg
 FROM (SELECT batter, match_id, CAST(SUM(batsman_runs) AS BIGINT) AS inn_runs FROM d GROUP BY 1, 2) q)""", ["d"])

add_block("mf", """
mf AS (
 SELECT m.id, m.season, m.venue, m.team1, m.team2, m.toss_winner, m.toss_decision, m.winner,
  COALESCE(CAST(p.wins AS DOUBLE) / NULLIF(p.total, 0), 0.5) AS h2h_win_pct,
  COALESCE(v.win_bat_first_pct, 50.0) / 100.0 AS venue_bat_first_pct,
  COALESCE(v.avg_first_inn, 160.0) AS venue_avg_score,
  COALESCE(f1.form_rating, 50.0) / 100.0 AS team1_form, COALESCE(f2.form_rating, 50.0) / 100.0 AS team2_form,
  CASE WHEN m.toss_winner = m.team1 THEN 1 ELSE 0 END AS team1_toss,
  0.5::DOUBLE AS team1_strength, 0.5::DOUBLE AS team2_strength,
  CASE WHEN m.winner = m.team1 THEN 1 ELSE 0 END AS target
 FROM m LEFT JOIN (SELECT team1, team2, SUM(CASE WHEN winner = team1 THEN 1 ELSE 0 END) AS wins, COUNT(*) AS total
                   FROM m GROUP BY 1, 2) p ON p.team1 = m.team1 AND p.team2 = m.team2
  LEFT JOIN v ON v.venue = m.venue AND v.season = m.season
  LEFT JOIN form f1 ON f1.team = m.team1 AND f1.season = m.season
  LEFT JOIN form f2 ON f2.team = m.team2 AND f2.season = m.season
 WHERE m.winner IS NOT NULL)""", ["m", "v", "form"])

add_block("fx", f"""
fx AS (
 SELECT prog.match_id, prog.seq, over, ball AS ball_num,
  CASE phase WHEN 'powerplay' THEN 0 WHEN 'death' THEN 2 ELSE 1 END AS phase_enc,
  current_rr, current_rr * 1.1::DOUBLE AS required_rr,
  {even('abs(current_rr * 1.1::DOUBLE - current_rr)')} AS pressure_index,
  wickets_remaining, cum_runs, cum_balls, h2h_sr, bowler_last3_runs,
  {even('bowler_spell_runs / bowler_spell_balls * 6')} AS bowler_economy, bowler_spell_balls,
  CAST(inn_runs AS DOUBLE) AS batter_last5_avg, 0 AS bowler_type_enc, inning, extra_runs, total_runs, m.season, intent
 FROM prog JOIN m ON m.id = prog.match_id
  JOIN last3 ON last3.match_id = prog.match_id AND last3.seq = prog.seq
  JOIN (SELECT batter, bowler, SUM(batsman_runs) * 100.0::DOUBLE / COUNT(*) AS h2h_sr FROM d GROUP BY 1, 2) g
   ON g.batter = prog.batter AND g.bowler = prog.bowler
  JOIN bi ON bi.batter = prog.batter AND bi.match_id = prog.match_id)""", ["prog", "last3", "bi", "m"])

add_block("fp", f"""
fp AS (
 SELECT match_id, seq, over, ball AS ball_num,
  CASE phase WHEN 'powerplay' THEN 0 WHEN 'death' THEN 2 ELSE 1 END AS phase_enc,
  current_rr, required_rr, {even('abs(required_rr - current_rr)')} AS pressure_index,
  10 - cw AS wickets_remaining, cum_runs, cum_balls,
  CASE WHEN h2h_balls > 0 THEN h2h_runs * 100.0::DOUBLE / h2h_balls ELSE 100.0 END AS h2h_sr, bowler_last3_runs,
  CASE WHEN sb > 0 THEN {even('sr / sb * 6')} ELSE 0.0 END AS bowler_economy, sb AS bowler_spell_balls,
  prev_avg AS batter_last5_avg, 0 AS bowler_type_enc, inning, season, h2h_balls, target, intent
 FROM (SELECT q.*, CASE WHEN inning = 2 AND target IS NOT NULL THEN
    {even('(target - cum_runs) / greatest(((20 - over) * 6 - ball + 1) / 6.0::DOUBLE, 0.1::DOUBLE)')}
    ELSE 0.0 END AS required_rr,
    CASE WHEN cum_balls > 0 THEN {even('cum_runs / cum_balls * 6')} ELSE 0.0 END AS current_rr
  FROM (SELECT d.*, m.season, bi.prev_avg, t.target, l.bowler_last3_runs,
    {_prior('d.total_runs', 'd.match_id, d.inning', 'd.seq')} AS cum_runs,
    {_prior('1', 'd.match_id, d.inning', 'd.seq')} AS cum_balls,
    {_prior('CASE WHEN d.dismissal_kind IS NOT NULL THEN 1 ELSE 0 END', 'd.match_id, d.inning', 'd.seq')} AS cw,
    {_prior('1', 'd.match_id, d.bowler', 'd.seq')} AS sb, {_prior('d.total_runs', 'd.match_id, d.bowler', 'd.seq')} AS sr,
    {_prior('d.batsman_runs', 'd.batter, d.bowler', 'd.match_id, d.seq')} AS h2h_runs,
    {_prior('1', 'd.batter, d.bowler', 'd.match_id, d.seq')} AS h2h_balls
   FROM d JOIN m ON m.id = d.match_id JOIN bi ON bi.batter = d.batter AND bi.match_id = d.match_id
    JOIN last3 l ON l.match_id = d.match_id AND l.seq = d.seq
    LEFT JOIN (SELECT match_id, CAST(SUM(total_runs) + 1 AS BIGINT) AS target FROM d WHERE inning = 1 GROUP BY 1) t
     ON t.match_id = d.match_id) q) z)""", ["d", "m", "bi", "last3"])


@query("intent_labels", sql("d", """
SELECT match_id, seq, batsman_runs, extra_runs, total_runs, dismissal_kind IS NOT NULL AS is_wicket, intent FROM d"""))
def intent_labels(spark, sf):
    return sequenced(spark, sf).rows.select(
        "match_id", "seq", "batsman_runs", "extra_runs", "total_runs", "is_wicket", S.intent_label().alias("intent"))


@query("innings_progress", sql("prog", """
SELECT match_id, seq, inning, cum_runs, cum_balls, cum_wickets, current_rr, wickets_remaining FROM prog"""))
def innings_progress(spark, sf):
    return W.with_rates(W.innings_progress(sequenced(spark, sf))).select(
        "match_id", "seq", "inning", "cum_runs", "cum_balls", "cum_wickets", "current_rr", "wickets_remaining")


@query("chase_pressure", sql("prog inn", f"""
SELECT match_id, seq, target, cum_runs, current_rr, required_rr, {even('abs(required_rr - current_rr)')} AS pressure_index
FROM (SELECT prog.match_id, seq, CAST(t.inn_runs + 1 AS BIGINT) AS target, cum_runs, current_rr,
 {even('(t.inn_runs + 1 - cum_runs) / greatest(((20 - over) * 6 - ball) / 6.0::DOUBLE, 0.1::DOUBLE)')} AS required_rr
 FROM prog JOIN inn t ON t.match_id = prog.match_id AND t.inning = 1 WHERE prog.inning = 2) q"""))
def chase_pressure(spark, sf):
    return W.chase_pressure(sequenced(spark, sf)).select(
        "match_id", "seq", "target", "cum_runs", "current_rr", "required_rr", "pressure_index")


@query("bowler_last3", sql("last3", "SELECT match_id, seq, bowler_last3_runs FROM last3"))
def bowler_last3(spark, sf):
    return W.bowler_last3(sequenced(spark, sf)).select("match_id", "seq", "bowler_last3_runs")


@query("bowler_spell", sql("last3", f"""
SELECT match_id, seq, bowler_spell_balls, bowler_spell_runs,
 {even('bowler_spell_runs / bowler_spell_balls * 6')} AS bowler_economy FROM last3"""))
def bowler_spell(spark, sf):
    return W.bowler_spell(sequenced(spark, sf)).select(
        "match_id", "seq", "bowler_spell_balls", "bowler_spell_runs", "bowler_economy")


@query("batter_form", sql("bi", "SELECT * FROM bi"))
def batter_form(spark, sf):
    return W.batter_form(deliveries(spark, sf))


@query("intent_features", sql("fx", "SELECT * FROM fx"))
def intent_features(spark, sf):
    return X.intent_features(sequenced(spark, sf), matches(spark, sf))


@query("intent_features_prior", sql("fp", "SELECT * FROM fp"))
def intent_features_prior(spark, sf):
    return X.intent_features_prior(sequenced(spark, sf, by_match=True), matches(spark, sf))


@query("match_features", sql("mf", "SELECT * FROM mf"))
def match_features(spark, sf):
    return X.match_features(matches(spark, sf), venue_table(spark, sf))


@query("temporal_split", sql("mf", f"""
SELECT CASE WHEN season < 2001 THEN 'train' ELSE 'test' END AS part, season, COUNT(*) AS n, {isum('target')} AS wins
FROM mf WHERE season <= 2001 GROUP BY 1, 2"""))
def temporal_split(spark, sf):
    rows = X.match_features(matches(spark, sf), venue_table(spark, sf))
    train, test = X.temporal_split(rows, "season", 2001)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part", "season").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("wins"))


def events_from_deliveries(spark, sf):
    """Live events as a scorer would send them: the state before each ball."""
    before = W.innings_progress(sequenced(spark, sf), prior=True)
    return with_teams(before, matches(spark, sf)).selectExpr(
        "cast(match_id as string) as match_id", "seq", "batter", "bowler", "non_striker", "over", "ball as ball_num",
        "batting_team", "bowling_team", "inning", "cast(cum_runs as int) as cum_runs",
        "cast(cum_wickets as int) as wickets_fallen", "if(inning = 2, 160, 0) as target",
    )


add_block("ev", f"""
ev AS (
 SELECT CAST(d.match_id AS STRING) AS match_id, seq, over, ball AS ball_num, inning,
  CASE WHEN inning = 2 THEN 160 ELSE 0 END AS target,
  {_prior('total_runs', 'd.match_id, inning')} AS cum_runs,
  {_prior('CASE WHEN dismissal_kind IS NOT NULL THEN 1 ELSE 0 END', 'd.match_id, inning')} AS wickets_fallen
 FROM d)""", ["d"])

_CRR = "cum_runs / greatest((over * 6 + ball_num) / 6.0::DOUBLE, 0.1::DOUBLE)"
_RRR = ("CASE WHEN target > 0 THEN (target - cum_runs) / greatest(((20 - over) * 6 - ball_num) / 6.0::DOUBLE, "
        "0.1::DOUBLE) ELSE 0.0 END")


@query("live_rates", sql("ev", f"""
SELECT match_id, seq, over * 6 + ball_num AS balls_elapsed, {even(_CRR)} AS current_rr, {even(_RRR)} AS required_rr,
 round(abs({_RRR} - {_CRR}), 6) AS pressure_index FROM ev"""))
def live_rates(spark, sf):
    return S.with_live_rates(events_from_deliveries(spark, sf)).select(
        "match_id", "seq", "balls_elapsed", "current_rr", "required_rr", F.round("pressure_index", 6).alias("pressure_index"))


@query("serving_features", sql("ev", """
SELECT match_id, seq, CAST(10 - wickets_fallen AS INT) AS wickets_remaining, over * 6 + ball_num AS cum_balls,
 0.0::DOUBLE AS extra_runs, 1.0::DOUBLE AS total_runs, 100.0::DOUBLE AS h2h_sr FROM ev"""))
def serving_features(spark, sf):
    return X.serving_features(events_from_deliveries(spark, sf)).select(
        "match_id", "seq", "wickets_remaining", "cum_balls", "extra_runs", "total_runs", "h2h_sr")


@query("numeric_coercion", """
SELECT CAST(COALESCE(trunc(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)), 0) AS INT) AS k_int,
 CAST(COALESCE(trunc(TRY_CAST(event_type AS DOUBLE)), 0) AS INT) AS type_int, CAST(trunc(value) AS INT) AS value_int,
 COUNT(*) AS n FROM events GROUP BY 1, 2, 3""")
def numeric_coercion(spark, sf):
    events = table(spark, sf, "events")
    return events.groupBy(
        S.to_int0(F.get_json_object("props", "$.k")).alias("k_int"), S.to_int0(F.col("event_type")).alias("type_int"),
        S.to_int0(F.col("value")).alias("value_int"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("season_from_date", """
SELECT CAST(year(CAST(o_orderdate AS DATE)) AS INT) AS season, COUNT(*) AS n,
 CAST(MIN(CAST(o_orderdate AS DATE)) AS DATE) AS first_day FROM orders GROUP BY 1
UNION ALL SELECT NULL, COUNT(*), NULL FROM customer""")
def season_from_date(spark, sf):
    """Dates as text, plus unreadable ones that must come out as null."""
    dates = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    bad = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("date"))
    return S.with_season(dates.unionByName(bad)).groupBy("season").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_day"))


@query("team_normalise", sql("m", """
, old AS (SELECT id, CASE team1 WHEN 'Team 0' THEN 'Deccan Chargers' WHEN 'Team 1' THEN 'Delhi Daredevils'
  ELSE team1 END AS t FROM m)
SELECT id, CASE t WHEN 'Deccan Chargers' THEN 'Sunrisers Hyderabad' WHEN 'Delhi Daredevils' THEN 'Delhi Capitals'
 ELSE t END AS team1 FROM old"""))
def team_normalise(spark, sf):
    old = S.literal_map({"Team 0": "Deccan Chargers", "Team 1": "Delhi Daredevils"})
    named = matches(spark, sf).select("id", F.coalesce(F.try_element_at(old, F.col("team1")), "team1").alias("team1"))
    return S.normalise_teams(named, ["team1"])


@query("asof_h2h", sql("d", f"""
, ver AS (SELECT batter, bowler, match_id, SUM(SUM(batsman_runs)) OVER w AS runs, SUM(COUNT(*)) OVER w AS balls FROM d
  GROUP BY 1, 2, 3 WINDOW w AS (PARTITION BY batter, bowler ORDER BY match_id))
SELECT d.match_id, d.seq, CAST(v.runs AS BIGINT) AS runs, CAST(v.balls AS BIGINT) AS balls
FROM d ASOF LEFT JOIN ver v ON v.batter = d.batter AND v.bowler = d.bowler AND v.match_id < d.match_id"""))
def asof_h2h(spark, sf):
    """The pair's record as it stood before the match, looked up in the versions that each match left."""
    balls = deliveries(spark, sf)
    per_match = balls.groupBy("batter", "bowler", "match_id").agg(
        F.sum("batsman_runs").alias("r"), F.count(F.lit(1)).alias("b")).withColumn("_block", match_block())
    versions = running(per_match, ["batter", "bowler"], ["match_id"], [["_block"]],
                       {"runs": F.col("r"), "balls": F.col("b")})
    asked = sequenced(spark, sf).rows.select("batter", "bowler", "match_id", "seq")
    return asof_join(asked, versions, ["batter", "bowler"], "match_id", ["runs", "balls"]).select(
        "match_id", "seq", "runs", "balls")
