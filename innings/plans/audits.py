"""Data-quality checks and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from innings.operators import audit as A
from innings.operators import quality as Qy
from innings.operators import sketches as Sk
from innings.operators.keyed import distinct_sorted
from innings.plans.registry import query
from innings.plans.sql import isum, isum_if, sql
from innings.session import stored
from innings.sources import raw
from innings.sources.adapter import deliveries, matches, sequenced, table, with_teams

_OLD_NAMES = """
, old AS (SELECT id, CASE team1 WHEN 'Team 0' THEN 'Deccan Chargers' WHEN 'Team 1' THEN 'Delhi Daredevils'
  ELSE team1 END AS team1, CASE team2 WHEN 'Team 0' THEN 'Deccan Chargers' WHEN 'Team 1' THEN 'Delhi Daredevils'
  ELSE team2 END AS team2 FROM m)"""


def _with_old_names(m):
    def old(c):
        return F.when(F.col(c) == "Team 0", "Deccan Chargers").when(F.col(c) == "Team 1", "Delhi Daredevils").otherwise(
            F.col(c))

    return m.withColumns({"team1": old("team1"), "team2": old("team2")})


@query("audit_nulls", sql("m d", f"""
SELECT * FROM (SELECT 'winner' AS column_name, {isum_if('winner IS NULL')} AS nulls FROM m
 UNION ALL SELECT 'dismissal_kind', {isum_if('dismissal_kind IS NULL')} FROM d) q WHERE nulls > 0"""))
def audit_nulls(spark, sf):
    return A.audit_nulls(matches(spark, sf), A.CRITICAL_MATCH_COLS).unionByName(
        A.audit_nulls(deliveries(spark, sf), A.CRITICAL_DELIVERY_COLS))


@query("audit_duplicates", """
SELECT CAST(COUNT(*) - COUNT(DISTINCT (l_orderkey, l_linenumber)) AS BIGINT) AS duplicates FROM lineitem""")
def audit_duplicates(spark, sf):
    return A.audit_duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("team_variants", sql("m", _OLD_NAMES + """
SELECT team1 AS name FROM old WHERE team1 IN ('Deccan Chargers', 'Delhi Daredevils', 'Kings XI Punjab')
UNION SELECT team2 FROM old WHERE team2 IN ('Deccan Chargers', 'Delhi Daredevils', 'Kings XI Punjab')"""))
def team_variants(spark, sf):
    return A.team_variants(_with_old_names(matches(spark, sf)))


@query("coverage", sql("m", "SELECT DISTINCT season FROM m WHERE season IS NOT NULL"))
def coverage(spark, sf):
    return A.coverage(matches(spark, sf))


@query("distinct_venues", sql("m", "SELECT DISTINCT venue FROM m WHERE venue IS NOT NULL"))
def distinct_venues(spark, sf):
    return distinct_sorted(matches(spark, sf), "venue")


@query("audit_outliers", "SELECT CAST(COALESCE(SUM(CASE WHEN value > 300 THEN 1 ELSE 0 END), 0) AS BIGINT) AS outliers "
                         "FROM events")
def audit_outliers(spark, sf):
    return A.audit_outliers(table(spark, sf, "events").withColumnRenamed("value", "total_runs"), 300)


@query("audit_counts", sql("d", """
SELECT COUNT(*) AS total_deliveries, COUNT(DISTINCT batter) AS unique_batters FROM d"""))
def audit_counts(spark, sf):
    return A.audit_counts(deliveries(spark, sf))


_SAMPLE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("audit_sample", f"""
SELECT * FROM lineitem ORDER BY md5(concat_ws('|', {', '.join(_SAMPLE_KEY)}, '42')), {', '.join(_SAMPLE_KEY)} LIMIT 50000""")
def audit_sample(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz"))
    return A.bounded_sample(rows, _SAMPLE_KEY)


def _profile(col: str, numeric: bool = True) -> str:
    stats = (f"CAST(MIN({col}) AS DOUBLE) AS min_value, CAST(MAX({col}) AS DOUBLE) AS max_value, "
             f"round(AVG({col}), 4) AS mean_value, round(stddev_samp({col}), 4) AS std_value" if numeric else
             "NULL AS min_value, NULL AS max_value, NULL AS mean_value, NULL AS std_value")
    return (f"SELECT '{col}' AS column_name, COUNT(*) AS n_rows, {isum_if(f'{col} IS NULL')} AS nulls, "
            f"COUNT(DISTINCT {col}) AS n_distinct, {stats} FROM src")


_LINEITEM = {
    "l_orderkey": True, "l_partkey": True, "l_suppkey": True, "l_linenumber": True, "l_quantity": True,
    "l_extendedprice": True, "l_discount": True, "l_tax": True, "l_returnflag": False, "l_linestatus": False,
    "l_shipdate": False,
}


@query("column_profile", "WITH src AS (SELECT * FROM lineitem) " + " UNION ALL ".join(
    _profile(c, numeric) for c, numeric in _LINEITEM.items()))
def column_profile(spark, sf):
    return A.column_profile(table(spark, sf, "lineitem"))


@query("audit_report", sql("m d", _OLD_NAMES + f"""
SELECT * FROM (SELECT 'match_nulls' AS check_name, 'winner' AS subject, {isum_if('winner IS NULL')} AS value FROM m) q
 WHERE value > 0
UNION ALL SELECT 'match_duplicate_ids', 'id', CAST(COUNT(*) - COUNT(DISTINCT id) AS BIGINT) FROM m
UNION ALL SELECT 'team_name_variant', name, 1 FROM (SELECT DISTINCT t AS name FROM
  (SELECT team1 AS t FROM old UNION ALL SELECT team2 FROM old) z WHERE t IN ('Deccan Chargers', 'Delhi Daredevils')) y
UNION ALL SELECT 'season_covered', CAST(season AS STRING), 1 FROM (SELECT DISTINCT season FROM m) s
UNION ALL SELECT * FROM (SELECT 'delivery_nulls', 'dismissal_kind', {isum_if('dismissal_kind IS NULL')} AS v FROM d) q
 WHERE v > 0
UNION ALL SELECT 'total_deliveries', 'deliveries', COUNT(*) FROM d
UNION ALL SELECT 'unique_batters', 'batter', COUNT(DISTINCT batter) FROM d
UNION ALL SELECT 'runs_above_7', 'total_runs', {isum_if('total_runs > 7')} FROM d"""))
def audit_report(spark, sf):
    return A.audit_report(_with_old_names(matches(spark, sf)), deliveries(spark, sf))


@query("match_index", sql("d m", """
, f AS (SELECT match_id, batting_team, MIN(seq) AS s FROM d GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY s) AS rn FROM f)
SELECT m.id, m.date, m.venue, a.batting_team AS team1, b.batting_team AS team2, m.winner, m.toss_winner, m.toss_decision,
 0 AS win_by_runs, 0 AS win_by_wickets, 0 AS target_runs
FROM m JOIN r a ON a.match_id = m.id AND a.rn = 1 LEFT JOIN r b ON b.match_id = m.id AND b.rn = 2"""))
def match_index(spark, sf):
    """The match table rebuilt from balls that carry their match facts."""
    games = matches(spark, sf)
    balls = with_teams(sequenced(spark, sf).rows, games)
    facts = games.select("id", "date", "venue", "winner", "toss_winner", "toss_decision")
    return raw.build_match_index(balls.join(facts, balls.match_id == facts.id).drop("id"), "date")


@query("source_overlap_cut", sql("m", """
SELECT id, season, 'first' AS source FROM m WHERE season < 1998
UNION ALL SELECT id, season, 'second' FROM m WHERE year(date) >= 1998"""))
def source_overlap_cut(spark, sf):
    """The first source ends before 1998; the second covers everything and is cut to 1998 on."""
    games = matches(spark, sf).select("id", "season", "date")
    first = games.filter(F.col("season") < 1998).withColumn("source", F.lit("first"))
    second = raw.since_year(games, "date", 1998).withColumn("source", F.lit("second"))
    return raw.union_sources(first, second).drop("date")


@query("classification_report", sql("d", """
, c AS (SELECT intent AS l, CASE WHEN over < 6 THEN 'defensive' WHEN over < 15 THEN 'neutral' ELSE 'aggressive' END AS p
  FROM d), k AS (SELECT l AS class FROM c UNION SELECT p FROM c),
n AS (SELECT class, CAST((SELECT COUNT(*) FROM c WHERE l = class) AS BIGINT) AS support,
  (SELECT COUNT(*) FROM c WHERE p = class) AS pred, (SELECT COUNT(*) FROM c WHERE l = class AND p = class) AS tp FROM k)
SELECT class, round(COALESCE(tp / NULLIF(pred, 0), 0.0), 6) AS precision,
 round(COALESCE(tp / NULLIF(support, 0), 0.0), 6) AS recall,
 round(COALESCE(2.0::DOUBLE * tp / NULLIF(pred + support, 0), 0.0), 6) AS f1, support,
 round((SELECT AVG(CASE WHEN l = p THEN 1.0::DOUBLE ELSE 0.0 END) FROM c), 6) AS accuracy FROM n"""))
def classification_report(spark, sf):
    """The phase as a naive guess of the intent."""
    from innings.functions.scalars import intent_label

    guess = F.when(F.col("over") < 6, "defensive").when(F.col("over") < 15, "neutral").otherwise("aggressive")
    pred = deliveries(spark, sf).select(intent_label().alias("label"), guess.alias("guess"))
    return Qy.classification_report(pred, "label", "guess")


@query("latency_summary", """
WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, COUNT(*) OVER () AS n FROM events)
SELECT CAST(MAX(n) AS BIGINT) AS n, round(MIN(value), 1) AS min, round(MAX(value), 1) AS max, round(AVG(value), 1) AS mean,
 round(median(value), 1) AS p50, round(MAX(CASE WHEN i = CAST(floor(n * 0.95) AS BIGINT) THEN value END), 1) AS p95,
 MAX(CASE WHEN i = CAST(floor(n * 0.95) AS BIGINT) THEN value END) < 300 AS within_limit FROM s""")
def latency_summary(spark, sf):
    return Qy.latency_summary(table(spark, sf, "events"), "value", 300.0)


@query("auc_rank", """
WITH s AS (SELECT n_chars AS score, quality AS y FROM documents JOIN labels USING (doc_id)),
r AS (SELECT y, score, rank() OVER (ORDER BY score) + (COUNT(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rk FROM s)
SELECT CAST(SUM(y) AS BIGINT) AS positives, CAST(SUM(1 - y) AS BIGINT) AS negatives,
 round((SUM(CASE WHEN y = 1 THEN rk END) - SUM(y) * (SUM(y) + 1) / 2.0::DOUBLE) / (SUM(y) * SUM(1 - y)), 6) AS auc
FROM r""")
def auc_rank(spark, sf):
    """Text length as a score of document quality."""
    scored = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return Qy.auc_rank(scored.select(F.col("n_chars").cast("double").alias("score"), "quality"), "score", "quality")


@query("events_tumbling", f"""
SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, COUNT(*) AS n,
 round({isum('CAST(round(value * 100) AS BIGINT)')} / 100.0::DOUBLE, 2) AS total
FROM events GROUP BY 1, 2""")
def events_tumbling(spark, sf):
    from innings.streaming.live import tumbling

    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    return tumbling(events, "ts", "1 hour", ["event_type"], [
        F.count(F.lit(1)).alias("n"), F.round(cents / F.lit(100.0), 2).alias("total")
    ]).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@query("events_sessions", """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1
  END AS fresh FROM events),
s AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, MIN(ts) AS session_start, MAX(ts) + INTERVAL '30 minutes' AS session_end, COUNT(*) AS n
FROM s GROUP BY user_id, sid""")
def events_sessions(spark, sf):
    from innings.operators.sessions import sessionize

    return sessionize(table(spark, sf, "events"), "user_id", "ts", 1800).select(
        "user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"),
        F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


_RANKS = [0.5, 0.95]


@query("sketch_report", f"""
SELECT event_type, COUNT(*) AS n, TRUE AS p50_within, TRUE AS p95_within, TRUE AS users_within FROM events GROUP BY 1""")
def sketch_report(spark, sf):
    """Daily sketches, stored, merged per event type; every figure is held against the exact ranks and counts."""
    events = table(spark, sf, "events")
    days = stored(Sk.daily_sketches(events, "ts", ["event_type"], "value", "user_id"), "sketches")
    found = stored(Sk.report(days, ["event_type"], _RANKS), "sketch-report")
    sides = events.join(found, "event_type").groupBy("event_type").agg(
        F.first("n").alias("n"), F.first("n_distinct").alias("guess"), F.count_distinct("user_id").alias("users"),
        *[F.avg((F.col("value") < F.col(p)).cast("double")).alias(f"{p}_below") for p in ("p50", "p95")],
        *[F.avg((F.col("value") <= F.col(p)).cast("double")).alias(f"{p}_upto") for p in ("p50", "p95")])
    within = [((F.col(f"p{round(r * 100)}_below") <= r + Sk.RANK_ERROR) & (F.col(f"p{round(r * 100)}_upto") >= r - Sk.RANK_ERROR))
              .alias(f"p{round(r * 100)}_within") for r in _RANKS]
    return sides.select("event_type", "n", *within, (
        F.abs(F.col("guess") - F.col("users")) <= F.greatest(F.lit(1.0), F.col("users") * Sk.COUNT_ERROR)).alias("users_within"))
