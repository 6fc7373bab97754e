"""Aggregates, rankings, joins and named questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from innings.functions import scalars as S
from innings.operators import career as C
from innings.operators import keyed as K
from innings.operators import questions as Q
from innings.operators import teams as T
from innings.operators import venue as V
from innings.plans.registry import query
from innings.plans.sql import isum, isum_if, r, sql
from innings.sources.adapter import deliveries, matches, table


def venue_table(spark, sf):
    return V.venue_stats(deliveries(spark, sf), matches(spark, sf))


def career_table(spark, sf):
    return C.career_stats(deliveries(spark, sf), matches(spark, sf))


def h2h_table(spark, sf):
    return C.h2h_records(deliveries(spark, sf))


@query("h2h_records", sql("h", "SELECT * FROM h"))
def h2h_records(spark, sf):
    return h2h_table(spark, sf)


@query("batting_career", sql("bat", "SELECT * FROM bat"))
def batting_career(spark, sf):
    return C.batting_career(deliveries(spark, sf), matches(spark, sf))


@query("bowling_career", sql("bowl", "SELECT * FROM bowl"))
def bowling_career(spark, sf):
    return C.bowling_career(deliveries(spark, sf), matches(spark, sf))


@query("career_rollup", sql("d m", f"""
SELECT batter AS player, m.season, phase, COUNT(*) AS balls, {isum('batsman_runs')} AS runs,
 {r('SUM(batsman_runs)', 'COUNT(*)', 100)} AS strike_rate
FROM d JOIN m ON m.id = d.match_id GROUP BY GROUPING SETS ((1, 2, 3), (1, 2), (1))"""))
def career_rollup(spark, sf):
    """Batting totals per phase, per season and over a career in one pass."""
    balls, runs = F.sum("balls"), F.sum("runs")
    return (
        C.with_match(C.batting_fold(deliveries(spark, sf)), matches(spark, sf))
        .groupingSets([["player", "season", "phase"], ["player", "season"], ["player"]], "player", "season", "phase")
        .agg(balls.alias("balls"), runs.alias("runs"), S.pct(runs, balls).alias("strike_rate"))
    )


@query("innings_totals", sql("inn", "SELECT match_id, inning, CAST(inn_runs AS BIGINT) AS inn_runs FROM inn"))
def innings_totals(spark, sf):
    return C.innings_totals(deliveries(spark, sf))


@query("venue_stats", sql("v", "SELECT * FROM v"))
def venue_stats(spark, sf):
    return venue_table(spark, sf)


@query("venue_stats_corrected", sql("d m inn", f"""
, ph AS (SELECT m.venue, m.season,
  {r("SUM(CASE WHEN phase='powerplay' THEN total_runs END)", "COUNT(CASE WHEN phase='powerplay' THEN 1 END)", 6)} AS pp,
  {r("SUM(CASE WHEN phase='middle' THEN total_runs END)", "COUNT(CASE WHEN phase='middle' THEN 1 END)", 6)} AS mid,
  {r("SUM(CASE WHEN phase='death' THEN total_runs END)", "COUNT(CASE WHEN phase='death' THEN 1 END)", 6)} AS dea
  FROM m JOIN d ON m.id = d.match_id GROUP BY 1, 2),
bf AS (SELECT id, venue, season, winner,
  CASE WHEN toss_decision = 'bat' THEN toss_winner WHEN toss_winner = team1 THEN team2 ELSE team1 END AS batted_first
  FROM m),
fi AS (SELECT bf.venue, bf.season, {r('SUM(inn_runs)', 'COUNT(*)')} AS avg_first_inn,
  {r('SUM(CASE WHEN winner = batted_first THEN 1 ELSE 0 END)',
     'SUM(CASE WHEN winner IS NOT NULL THEN 1 ELSE 0 END)', 100)} AS win_bat_first_pct
  FROM bf JOIN inn ON inn.match_id = bf.id AND inn.inning = 1 GROUP BY 1, 2)
SELECT ph.venue, ph.season, avg_first_inn, win_bat_first_pct, pp AS avg_powerplay_rr, mid AS avg_middle_rr,
 dea AS avg_death_rr FROM ph LEFT JOIN fi ON fi.venue = ph.venue AND fi.season = ph.season"""))
def venue_stats_corrected(spark, sf):
    return V.venue_stats_corrected(deliveries(spark, sf), matches(spark, sf))


@query("venue_profile", sql("vp", "SELECT * FROM vp"))
def venue_profile(spark, sf):
    return V.venue_profile(venue_table(spark, sf))


@query("team_form", sql("form", "SELECT * FROM form"))
def team_form(spark, sf):
    return T.team_form(matches(spark, sf))


@query("pair_win_pct", sql("m", f"""
SELECT team1, team2, {isum_if('winner = team1')} AS team1_wins, COUNT(*) AS total,
 CAST(SUM(CASE WHEN winner = team1 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS h2h_win_pct FROM m GROUP BY 1, 2"""))
def pair_win_pct(spark, sf):
    return T.pair_win_pct(matches(spark, sf))


@query("rivalry_by_season", sql("m", f"""
SELECT season, {isum_if("winner = 'Team 3'")} AS t1_wins, {isum_if("winner = 'Team 5'")} AS t2_wins,
 COUNT(*) AS matches FROM m
WHERE (team1 = 'Team 3' AND team2 = 'Team 5') OR (team1 = 'Team 5' AND team2 = 'Team 3') GROUP BY 1"""))
def rivalry_by_season(spark, sf):
    return T.rivalry_by_season(matches(spark, sf), "Team 3", "Team 5")


@query("rivalry_all_pairs", sql("m", f"""
SELECT LEAST(team1, team2) AS t1, GREATEST(team1, team2) AS t2, season,
 {isum_if('winner = LEAST(team1, team2)')} AS t1_wins, {isum_if('winner = GREATEST(team1, team2)')} AS t2_wins,
 COUNT(*) AS matches FROM m GROUP BY 1, 2, 3"""))
def rivalry_all_pairs(spark, sf):
    return T.rivalry_all_pairs(matches(spark, sf))


@query("season_summary", sql("ss", "SELECT * FROM ss"))
def season_summary(spark, sf):
    return T.season_summary(matches(spark, sf), career_table(spark, sf), venue_table(spark, sf))


@query("team_profile", sql("d m", """
, sides AS (SELECT season, team1 AS team, winner FROM m UNION ALL SELECT season, team2, winner FROM m),
rec AS (SELECT team, COUNT(DISTINCT season) AS seasons,
  CAST(SUM(CASE WHEN winner = team THEN 1 ELSE 0 END) AS BIGINT) AS wins,
  CAST(SUM(CASE WHEN winner <> team THEN 1 ELSE 0 END) AS BIGINT) AS losses FROM sides GROUP BY 1),
ch AS (SELECT season, winner, row_number() OVER (PARTITION BY season ORDER BY COUNT(*) DESC, winner) AS rn
  FROM m WHERE winner IS NOT NULL GROUP BY 1, 2),
ti AS (SELECT winner AS team, COUNT(*) AS titles FROM ch WHERE rn = 1 GROUP BY 1),
tp AS (SELECT batting_team AS team, batter,
  row_number() OVER (PARTITION BY batting_team ORDER BY SUM(batsman_runs) DESC, batter) AS rn FROM d GROUP BY 1, 2)
SELECT rec.team, seasons, COALESCE(titles, 0) AS titles, wins, losses,
 (SELECT string_agg(batter, ', ' ORDER BY rn) FROM tp WHERE tp.team = rec.team AND rn <= 3) AS top_players
FROM rec LEFT JOIN ti ON ti.team = rec.team"""))
def team_profile(spark, sf):
    return T.team_profile(matches(spark, sf), deliveries(spark, sf, teams=True))


@query("intent_distribution", sql("d", "SELECT intent, COUNT(*) AS n FROM d GROUP BY 1"))
def intent_distribution(spark, sf):
    return C.intent_distribution(deliveries(spark, sf))


@query("label_counts", sql("d", """
SELECT CAST(CASE intent WHEN 'aggressive' THEN 0 WHEN 'defensive' THEN 1 WHEN 'neutral' THEN 2 ELSE 3 END AS INT)
 AS label, intent AS decoded, COUNT(*) AS n FROM d GROUP BY 1, 2"""))
def label_counts(spark, sf):
    labelled = deliveries(spark, sf).select(S.encode_label(S.intent_label()).alias("label"))
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("decoded", S.decode_label("label"))


@query("phase_counts", sql("d", """
SELECT phase, CASE phase WHEN 'powerplay' THEN 0 WHEN 'death' THEN 2 ELSE 1 END AS phase_enc, COUNT(*) AS balls
FROM d GROUP BY 1, 2"""))
def phase_counts(spark, sf):
    return deliveries(spark, sf).groupBy("phase").agg(F.count(F.lit(1)).alias("balls")).withColumn(
        "phase_enc", S.phase_enc("phase"))


@query("matchup_confidence", sql("h", f"""
SELECT batter, bowler, {isum('balls')} AS balls_total, SUM(balls) < 30 AS low_sample,
 CASE WHEN SUM(balls) < 30 THEN 0.6::DOUBLE ELSE 0.88::DOUBLE END AS confidence FROM h GROUP BY 1, 2"""))
def matchup_confidence(spark, sf):
    return C.matchup_confidence(h2h_table(spark, sf))


@query("batter_innings", sql("d", f"""
SELECT batter, match_id, {isum('batsman_runs')} AS inn_runs FROM d GROUP BY 1, 2"""))
def batter_innings(spark, sf):
    return C.batter_innings(deliveries(spark, sf))


@query("matchup_lookup", sql("h", """
, ranked AS (SELECT h.*, row_number() OVER (PARTITION BY batter, bowler ORDER BY balls DESC, phase) AS position FROM h),
req AS (SELECT DISTINCT concat('B', CAST(p_partkey % 60 AS STRING)) AS batter,
  concat('W', CAST(p_size % 40 AS STRING)) AS bowler FROM part)
SELECT concat(batter, '-', bowler) AS request_id, batter, bowler, phase, balls, runs, wickets, strike_rate, dot_pct,
 boundary_pct, position FROM ranked JOIN req USING (batter, bowler) WHERE position <= 3"""))
def matchup_lookup(spark, sf):
    """A batch of requested pairs (from ``part``) against the head-to-head table."""
    requests = table(spark, sf, "part").selectExpr(
        "concat('B', cast(p_partkey % 60 as string)) as batter", "concat('W', cast(p_size % 40 as string)) as bowler"
    ).distinct().withColumn("request_id", F.concat_ws("-", "batter", "bowler"))
    return Q.matchup_lookup(h2h_table(spark, sf), requests)


@query("matchup_pair", sql("h", "SELECT * FROM h WHERE batter = 'B7' AND bowler = 'W3'"))
def matchup_pair(spark, sf):
    return Q.matchup(h2h_table(spark, sf), "B7", "W3")


@query("top_batters", sql("bat", f"""
SELECT player, {isum('runs')} AS runs FROM bat GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100"""))
def top_batters(spark, sf):
    return Q.top_batters(C.batting_career(deliveries(spark, sf), matches(spark, sf)))


@query("top_opponents", sql("h", """
SELECT * FROM (SELECT h.*, row_number() OVER (PARTITION BY batter ORDER BY balls DESC, bowler, phase) AS position
 FROM h) q WHERE position <= 5"""))
def top_opponents(spark, sf):
    return Q.top_opponents(h2h_table(spark, sf))


@query("primary_team", sql("d", """
SELECT player, team, balls FROM (SELECT batter AS player, batting_team AS team, COUNT(*) AS balls,
 row_number() OVER (PARTITION BY batter ORDER BY COUNT(*) DESC, batting_team) AS rn FROM d GROUP BY 1, 2) q
WHERE rn = 1"""))
def primary_team(spark, sf):
    return T.primary_team(deliveries(spark, sf, teams=True))


@query("top_wickets_phase", sql("bowl", f"""
SELECT player, {isum('wickets')} AS total_wickets FROM bowl WHERE phase = 'powerplay' AND season = 1997
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""))
def top_wickets_phase(spark, sf):
    return Q.top_wickets(C.bowling_career(deliveries(spark, sf), matches(spark, sf)), "powerplay", 1997)


@query("best_death_economy", sql("bowl", """
SELECT player, economy FROM bowl WHERE phase = 'death' AND season = 1998 AND innings >= 5
ORDER BY economy, player LIMIT 10"""))
def best_death_economy(spark, sf):
    return Q.best_economy(C.bowling_career(deliveries(spark, sf), matches(spark, sf)), "death", 1998)


@query("venue_latest", sql("v", """
SELECT venue, season, win_bat_first_pct FROM (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY season DESC) AS rn
 FROM v) q WHERE rn = 1"""))
def venue_latest(spark, sf):
    return Q.venue_latest(venue_table(spark, sf))


@query("player_sr_at_venue", sql("bat m", """
SELECT DISTINCT player, strike_rate FROM bat WHERE player = 'B7'
 AND season IN (SELECT season FROM m WHERE venue = 'Venue 3')"""))
def player_sr_at_venue(spark, sf):
    career = C.batting_career(deliveries(spark, sf), matches(spark, sf))
    return Q.player_sr_at_venue(career, matches(spark, sf), "B7", "Venue 3")


@query("player_sr_by_venue", sql("d m", f"""
SELECT batter AS player, venue, COUNT(*) AS balls, {r('SUM(batsman_runs)', 'COUNT(*)', 100)} AS strike_rate
FROM d JOIN m ON m.id = d.match_id GROUP BY 1, 2"""))
def player_sr_by_venue(spark, sf):
    return Q.player_sr_by_venue(deliveries(spark, sf), matches(spark, sf))


@query("prediction_requests", sql("v form m", """
, req AS (SELECT o_orderkey AS request_id, concat('Venue ', CAST(o_custkey % 14 AS STRING)) AS venue,
  CAST(year(o_orderdate) AS INT) AS season, concat('Team ', CAST(o_custkey % 9 AS STRING)) AS team1,
  concat('Team ', CAST((o_custkey + 3) % 9 AS STRING)) AS team2,
  concat('Team ', CAST((o_custkey + 3 * (o_orderkey % 2)) % 9 AS STRING)) AS toss_winner FROM orders)
SELECT req.*, 0.5::DOUBLE AS h2h_win_pct, COALESCE(win_bat_first_pct / 100, 0.5) AS venue_bat_first_pct,
 COALESCE(avg_first_inn, 160.0) AS venue_avg_score, COALESCE(f1.form_rating / 100, 0.5) AS team1_form,
 COALESCE(f2.form_rating / 100, 0.5) AS team2_form,
 CASE WHEN toss_winner = team1 THEN 1 ELSE 0 END AS team1_toss, 0.5::DOUBLE AS team1_strength,
 0.5::DOUBLE AS team2_strength
FROM req LEFT JOIN v ON v.venue = req.venue AND v.season = req.season
 LEFT JOIN form f1 ON f1.team = req.team1 AND f1.season = req.season
 LEFT JOIN form f2 ON f2.team = req.team2 AND f2.season = req.season"""))
def prediction_requests(spark, sf):
    """Every order is a request; some name venues and teams nobody has seen."""
    return Q.prediction_requests(win_requests(spark, sf), venue_table(spark, sf), T.team_form(matches(spark, sf)))


def win_requests(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey as request_id",
        "concat('Venue ', cast(o_custkey % 14 as string)) as venue",
        "year(o_orderdate) as season",
        "concat('Team ', cast(o_custkey % 9 as string)) as team1",
        "concat('Team ', cast((o_custkey + 3) % 9 as string)) as team2",
        "concat('Team ', cast((o_custkey + 3 * (o_orderkey % 2)) % 9 as string)) as toss_winner",
    )


@query("upsert_career_stats", sql("d m", f"""
, lo AS (SELECT batter AS player, m.season, phase, COUNT(DISTINCT match_id) AS innings, {isum('batsman_runs')} AS runs,
   COUNT(*) AS balls_faced FROM d JOIN m ON m.id = d.match_id WHERE d.inning = 1 GROUP BY 1, 2, 3),
up AS (SELECT batter AS player, m.season, phase, COUNT(DISTINCT match_id) AS innings, {isum('batsman_runs')} AS runs,
   COUNT(*) AS balls_faced FROM d JOIN m ON m.id = d.match_id WHERE m.season >= 1999 GROUP BY 1, 2, 3)
SELECT COALESCE(lo.player, up.player) AS player, COALESCE(lo.season, up.season) AS season,
 COALESCE(lo.phase, up.phase) AS phase, COALESCE(lo.innings, up.innings) AS innings,
 COALESCE(up.runs, lo.runs) AS runs, COALESCE(up.balls_faced, lo.balls_faced) AS balls_faced
FROM lo FULL OUTER JOIN up ON lo.player = up.player AND lo.season = up.season AND lo.phase = up.phase"""))
def upsert_career_stats(spark, sf):
    """First-innings figures as the stored table, later seasons' full figures as the update."""
    def figures(balls, games):
        return C.with_match(balls, games).groupBy(F.col("batter").alias("player"), "season", "phase").agg(
            F.count_distinct("match_id").alias("innings"), F.sum("batsman_runs").alias("runs"),
            F.count(F.lit(1)).alias("balls_faced"))

    d, m = deliveries(spark, sf), matches(spark, sf)
    stored = figures(d.filter(F.col("inning") == 1), m)
    update = figures(d, m.filter(F.col("season") >= 1999))
    return K.upsert(stored, update, ["player", "season", "phase"], ["runs", "balls_faced"])


@query("key_violations", """
SELECT l_orderkey, l_linenumber, COUNT(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1""")
def key_violations(spark, sf):
    return K.key_violations(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("dedup_keep_last", """
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
 ORDER BY ts DESC, event_id DESC) AS rn FROM events) q WHERE rn = 1""")
def dedup_keep_last(spark, sf):
    events = table(spark, sf, "events")
    return K.dedup_keep_last(events, ["user_id", "event_type"], ["ts", "event_id"]).select(
        "user_id", "event_type", "event_id", "value")
