"""The way in and back: raw files through the ingest job, and stored tables loaded, replaced and read."""

from __future__ import annotations

from pyspark.sql import functions as F

from innings.operators import features as X
from innings.plans.registry import query
from innings.plans.sql import isum, sql
from innings.plans.texts import doc_corpus
from innings.session import new_folder, stored
from innings.sources import ingest, schemas, tables
from innings.sources.adapter import matches, sequenced, table, with_teams

CUT = 2000  # the per-match files count from this year on

_BALLS = "match_id, seq, inning, over, ball, batter, bowler, non_striker, batting_team, bowling_team, player_dismissed"


def _raw_files(spark, sf):
    """The derived matches as a main source, and as per-match files in another layout with its own spellings.

    A match lies in one file, in order; missing values have the spellings that sources use.
    """
    games = matches(spark, sf)
    balls = stored(with_teams(sequenced(spark, sf).rows, games), "raw-balls")
    root = new_folder(spark, "raw")
    early = games.where(F.year("date") < CUT)
    early.write.option("header", True).csv(f"{root}/main/matches_main.csv")
    lines = balls.join(early.select(F.col("id").alias("match_id")), "match_id", "left_semi")
    # Whole numbers with decimals, and a word where nothing happened.
    lines.repartition("match_id").sortWithinPartitions("match_id", "seq").select(
        "match_id", "inning", "over", "ball", "batter", "bowler", "non_striker", "batting_team", "bowling_team",
        F.col("batsman_runs").cast("double").alias("batsman_runs"), "extra_runs",
        F.coalesce("dismissal_kind", F.lit("NA")).alias("dismissal_kind"), "player_dismissed",
        F.col("extra_runs").cast("double").alias("wides"), F.lit("x").alias("unknown_column"),
    ).write.option("header", True).csv(f"{root}/main/deliveries_main.csv")
    facts = games.select(F.col("id").alias("match_id"), F.col("date").alias("start_date"), "venue", "winner",
                         "toss_winner", "toss_decision")
    every = balls.join(facts, "match_id").repartition("match_id").sortWithinPartitions("match_id", "seq")
    every.select(
        "match_id", "start_date", "venue", F.col("inning").alias("innings"),
        F.concat_ws(".", "over", "ball").alias("ball"), "batting_team", "bowling_team",
        F.col("batter").alias("striker"), "non_striker", "bowler", F.col("batsman_runs").alias("runs_off_bat"),
        F.col("extra_runs").alias("extras"), F.col("dismissal_kind").alias("wicket_type"), "player_dismissed", "winner",
        "toss_winner", "toss_decision",
    ).write.option("header", True).csv(f"{root}/games")
    return root


def _built(spark, sf):
    root = _raw_files(spark, sf)
    games, balls = ingest.ingest(spark, f"{root}/main", f"{root}/games", CUT)
    dropped = tables.replace_tables(f"{root}/clean", games, balls)
    assert "unknown_column" in dropped["deliveries"]
    return f"{root}/clean"


@query("ingest_matches", sql("m", f"""
SELECT id, season, date, venue, team1, team2, winner, toss_winner, toss_decision,
 CASE WHEN year(date) < {CUT} THEN win_by_runs ELSE 0 END AS win_by_runs FROM m"""))
def ingest_matches(spark, sf):
    clean = tables.load_table(spark, f"{_built(spark, sf)}/matches", "matches")
    return clean.select("id", "season", "date", "venue", "team1", "team2", "winner", "toss_winner", "toss_decision",
                        "win_by_runs")


@query("ingest_deliveries", sql("m d", f"""
SELECT {_BALLS}, m.season, batsman_runs, extra_runs, batsman_runs + extra_runs AS total_runs, dismissal_kind, intent, phase,
 dismissal_kind IS NOT NULL AS is_wicket, CASE WHEN year(m.date) < {CUT} THEN extra_runs END AS wides
FROM d JOIN m ON m.id = d.match_id"""))
def ingest_deliveries(spark, sf):
    clean = tables.load_table(spark, f"{_built(spark, sf)}/deliveries", "deliveries")
    return clean.select(*_BALLS.split(", "), "season", "batsman_runs", "extra_runs", "total_runs", "dismissal_kind",
                        "intent", "phase", "is_wicket", "wides")


@query("store_reload", sql("m d", f"""
SELECT m.season, COUNT(*) AS balls, {isum('total_runs')} AS runs FROM d JOIN m ON m.id = d.match_id WHERE m.season >= 1998
GROUP BY 1"""))
def store_reload(spark, sf):
    """All seasons are stored, then only the later ones: nothing of the others may stay."""
    games = matches(spark, sf)
    balls = stored(with_teams(sequenced(spark, sf).rows, games, ["season"]), "balls")
    root = new_folder(spark, "store")
    tables.replace_tables(root, games, balls)
    late = F.col("season") >= 1998
    tables.replace_tables(root, games.where(late), balls.where(late))
    return tables.load_table(spark, f"{root}/deliveries", "deliveries").groupBy("season").agg(
        F.count(F.lit(1)).alias("balls"), F.sum("total_runs").alias("runs"))


@query("stored_documents", sql("sdocs pdocs vdocs", " UNION ALL ".join(
    f"SELECT doc_id, doc_type, season, team, player, venue, text FROM {x}" for x in ("sdocs", "pdocs", "vdocs"))))
def stored_documents(spark, sf):
    """The corpus as JSON lines and back."""
    path = f"{new_folder(spark, 'docs')}/corpus"
    tables.write_docs(schemas.conform(doc_corpus(spark, sf), schemas.DOCUMENT), path)
    return tables.read_docs(spark, path)


@query("feature_drift", sql("d", f"""
SELECT match_id, seq, CAST(over AS DOUBLE) AS over, 0.0::DOUBLE AS phase_enc FROM d"""))
def feature_drift(spark, sf):
    """A feature that the events lack is filled with zero."""
    filled, missing = X.schema_drift(["over", "phase_enc"], sequenced(spark, sf).rows.select("match_id", "seq", "over"))
    assert missing == ["phase_enc"]
    return filled.select("match_id", "seq", F.col("over").cast("double").alias("over"),
                         F.col("phase_enc").cast("double").alias("phase_enc"))


@query("golden_questions", "SELECT text AS question, 'item ' || item_id AS ground_truth FROM benchmark")
def golden_questions(spark, sf):
    """Questions as arrays of a few JSON files, read back."""
    items = table(spark, sf, "benchmark").select((F.col("item_id") % 4).alias("part"), F.struct(
        F.col("text").alias("question"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("ground_truth")).alias("q"))
    path = new_folder(spark, "golden")
    arrays = items.groupBy("part").agg(F.to_json(F.collect_list("q")).alias("value"))
    arrays.repartition("part").write.partitionBy("part").text(path)
    return tables.read_golden(spark, f"{path}/*/")


@query("metric_records", """
SELECT 0.0::DOUBLE AS faithfulness, 0.0::DOUBLE AS answer_relevancy, round(AVG(quality), 6) AS context_precision,
 round(AVG(toxic), 6) AS context_recall, source AS last_evaluated,
 CAST(COUNT(*) AS INTEGER) AS total_questions
FROM labels JOIN documents USING (doc_id) WHERE source IS NOT NULL GROUP BY source""")
def metric_records(spark, sf):
    """A record per source that lacks some figures; absent ones read as zero."""
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").where("source is not null")
    figures = joined.groupBy("source").agg(
        F.round(F.avg("quality"), 6).alias("context_precision"), F.round(F.avg("toxic"), 6).alias("context_recall"),
        F.count(F.lit(1)).alias("total_questions"))
    path = new_folder(spark, "metrics")
    figures.withColumn("last_evaluated", F.col("source")).repartition("source").write.partitionBy("source").json(path)
    return tables.read_metrics(spark, f"{path}/*/")
