"""Documents rendered from the aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from innings.operators import documents as D
from innings.operators import teams as T
from innings.operators import venue as V
from innings.plans.aggregates import career_table, h2h_table, venue_table
from innings.plans.registry import query
from innings.plans.sql import add_block, sql
from innings.sources.adapter import deliveries, matches, table

_COLS = "doc_id, doc_type, season, team, player, venue, text"

add_block("sdocs", """
sdocs AS (
 SELECT concat('season_', season) AS doc_id, 'season_summary' AS doc_type, season, CAST(NULL AS STRING) AS team,
  CAST(NULL AS STRING) AS player, CAST(NULL AS STRING) AS venue,
  concat('Season ', season, ' in summary', chr(10), 'Champion: ', champion, chr(10), 'Runner-up: ', runner_up, chr(10),
   'Matches: ', total_matches, chr(10), 'Mean first innings: ', printf('%.1f', avg_score), chr(10),
   'Most runs: ', top_scorer, ' with ', top_runs, chr(10), 'Most wickets: ', top_bowler, ' with ', top_wickets, chr(10),
   champion, ' took the ', season, ' title ahead of ', runner_up, ', with ', top_scorer, ' leading the batting and ',
   top_bowler, ' the bowling.') AS text FROM ss)""", ["ss"])

add_block("vdocs", """
vdocs AS (
 SELECT concat('venue_', replace(replace(venue, ' ', '_'), ',', '')) AS doc_id, 'venue_analysis' AS doc_type,
  CAST(NULL AS INT) AS season, CAST(NULL AS STRING) AS team, CAST(NULL AS STRING) AS player, venue,
  concat('Venue profile of ', venue, chr(10), 'Mean first innings: ', printf('%.1f', avg_score), chr(10),
   'Won batting first: ', printf('%.1f', bat_first_win), '%', chr(10), 'Runs per over: powerplay ',
   printf('%.2f', pp_rr), ', middle ', printf('%.2f', mid_rr), ', death ', printf('%.2f', death_rr), chr(10),
   CASE WHEN bat_first_win > 50 THEN concat('Sides batting first win ', printf('%.1f', bat_first_win),
     '% here: setting a target pays at ', venue, '.')
    ELSE concat('Sides batting first win only ', printf('%.1f', bat_first_win), '% here: chasing pays at ', venue, '.')
   END) AS text FROM vp)""", ["vp"])

_PH = "CASE phase WHEN 'powerplay' THEN 0 WHEN 'middle' THEN 1 ELSE 2 END"
add_block("pdocs", f"""
pt AS (SELECT player FROM bat GROUP BY player ORDER BY SUM(runs) DESC, player LIMIT 100),
pb AS (SELECT player, string_agg(concat('  ', season, ' ', phase, ': ', runs, ' runs, strike rate ',
   COALESCE(CAST(strike_rate AS STRING), 'N/A'), ', average ', COALESCE(CAST(average AS STRING), 'N/A')), chr(10)
   ORDER BY season, {_PH}) AS t FROM bat GROUP BY player),
pw AS (SELECT player, string_agg(concat('  ', season, ' ', phase, ': ', wickets, ' wickets, economy ',
   COALESCE(CAST(economy AS STRING), 'N/A')), chr(10) ORDER BY season, {_PH}) AS t FROM bowl GROUP BY player),
pr AS (SELECT batter AS player, string_agg(concat('  ', bowler, ' in the ', phase, ': ', balls, ' balls, strike rate ',
   CAST(strike_rate AS STRING), ', out ', wickets, ' times'), chr(10) ORDER BY rn) AS t
  FROM (SELECT h.*, row_number() OVER (PARTITION BY batter ORDER BY balls DESC, bowler, phase) AS rn FROM h) q
  WHERE rn <= 5 GROUP BY batter),
pp AS (SELECT batter AS player, batting_team AS team, row_number() OVER (PARTITION BY batter
   ORDER BY COUNT(*) DESC, batting_team) AS rn FROM d GROUP BY batter, batting_team),
pdocs AS (
 SELECT concat('player_', replace(pt.player, ' ', '_')) AS doc_id, 'player_profile' AS doc_type,
  CAST(NULL AS INT) AS season, pp.team, pt.player, CAST(NULL AS STRING) AS venue,
  concat('Player profile of ', pt.player, chr(10), 'Team: ', pp.team, chr(10), 'Role: batsman', chr(10), 'Batting:',
   chr(10), pb.t, chr(10), 'Bowling:', chr(10), CASE WHEN pw.t IS NULL THEN '' ELSE concat(pw.t, chr(10)) END,
   'Closest rivals:', chr(10), pr.t, chr(10), pt.player, ' bats for ', pp.team, ' and scores through all phases.') AS text
 FROM pt JOIN pb ON pb.player = pt.player LEFT JOIN pw ON pw.player = pt.player JOIN pr ON pr.player = pt.player
  JOIN pp ON pp.player = pt.player AND pp.rn = 1)""", ["bat", "bowl", "h", "d"])


def season_docs_table(spark, sf):
    summary = T.season_summary(matches(spark, sf), career_table(spark, sf), venue_table(spark, sf))
    return D.season_docs(summary)


def player_docs_table(spark, sf):
    return D.player_docs(career_table(spark, sf), h2h_table(spark, sf), deliveries(spark, sf, teams=True))


def venue_docs_table(spark, sf):
    return D.venue_docs(V.venue_profile(venue_table(spark, sf)))


@query("season_docs", sql("sdocs", f"SELECT {_COLS} FROM sdocs"))
def season_docs(spark, sf):
    return season_docs_table(spark, sf)


@query("venue_docs", sql("vdocs", f"SELECT {_COLS} FROM vdocs"))
def venue_docs(spark, sf):
    return venue_docs_table(spark, sf)


@query("player_docs", sql("pdocs", f"SELECT {_COLS} FROM pdocs"))
def player_docs(spark, sf):
    return player_docs_table(spark, sf)


@query("team_docs", sql("d m", """
, s AS (SELECT season, team1 AS team, winner FROM m UNION ALL SELECT season, team2, winner FROM m),
ch AS (SELECT season, winner, row_number() OVER (PARTITION BY season ORDER BY COUNT(*) DESC, winner) AS rn
  FROM m WHERE winner IS NOT NULL GROUP BY 1, 2),
tp AS (SELECT batting_team AS team, batter,
  row_number() OVER (PARTITION BY batting_team ORDER BY SUM(batsman_runs) DESC, batter) AS rn FROM d GROUP BY 1, 2),
tt AS (SELECT team, string_agg(batter, ', ' ORDER BY rn) AS best FROM tp WHERE rn <= 3 GROUP BY 1)
SELECT concat('team_', replace(s.team, ' ', '_')) AS doc_id, 'team_profile' AS doc_type, CAST(NULL AS INT) AS season,
 s.team, CAST(NULL AS STRING) AS player, CAST(NULL AS STRING) AS venue,
 concat('Team profile of ', s.team, chr(10), 'Seasons: ', COUNT(DISTINCT season), chr(10), 'Titles: ',
  (SELECT COUNT(*) FROM ch WHERE ch.winner = s.team AND rn = 1), chr(10), 'Wins: ',
  SUM(CASE WHEN winner = s.team THEN 1 ELSE 0 END), ', losses: ', SUM(CASE WHEN winner <> s.team THEN 1 ELSE 0 END),
  chr(10), 'Leading players: ', MAX(tt.best)) AS text
FROM s JOIN tt ON tt.team = s.team GROUP BY s.team"""))
def team_docs(spark, sf):
    return D.team_docs(T.team_profile(matches(spark, sf), deliveries(spark, sf, teams=True)))


@query("doc_corpus", sql("sdocs pdocs vdocs", f"""
SELECT {_COLS} FROM sdocs UNION ALL SELECT {_COLS} FROM pdocs UNION ALL SELECT {_COLS} FROM vdocs"""))
def doc_corpus(spark, sf):
    return D.doc_corpus(season_docs_table(spark, sf), player_docs_table(spark, sf), venue_docs_table(spark, sf))


@query("index_records", """
SELECT replace(replace(concat(source, '/', lang, ' ', d.doc_id), ' ', '_'), '/', '_') AS id,
 concat(source, '/', lang, ' ', d.doc_id) AS doc_id, COALESCE(CASE WHEN lang <> 'de' THEN lang END, 'unknown') AS doc_type,
 CASE WHEN n_chars % 7 <> 0 THEN CAST(n_chars % 7 AS INT) END AS season, source AS team, '' AS player, '' AS venue,
 length(text) AS n_text, COALESCE(len(embedding), 64) AS dim,
 round(COALESCE(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 0.0), 6) AS mass
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def index_records(spark, sf):
    """The document table as index records; half of the documents have no vector."""
    key = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit(" "), F.col("doc_id").cast("string"))
    docs = table(spark, sf, "documents").select(
        key.alias("doc_id"), F.when(F.col("lang") != "de", F.col("lang")).alias("doc_type"),
        (F.col("n_chars") % 7).alias("season"), F.col("source").alias("team"), F.lit(None).cast("string").alias("player"),
        F.lit(None).cast("string").alias("venue"), "text", F.col("doc_id").alias("n"))
    vectors = docs.select("doc_id", "n").join(
        table(spark, sf, "embeddings"), F.col("n") == F.col("vec_id")).select("doc_id", "embedding")
    records = D.to_index_records(docs.drop("n"), vectors, 64)
    mass = F.aggregate(F.transform("text_vector", lambda x: F.abs(x.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return records.select(
        "id", "doc_id", "doc_type", "season", "team", "player", "venue", F.length("text").alias("n_text"),
        F.size("text_vector").alias("dim"), F.round(mass, 6).alias("mass"))


