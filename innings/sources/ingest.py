"""The ingest job: raw files in, clean tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from innings.operators.ordered import CHUNK_BITS
from innings.session import stored
from innings.sources import raw, tables
from innings.sources.schemas import MATCHES, conform



def _in_load_order(df: DataFrame) -> DataFrame:
    """``seq``, 1 to n in each match, in load order: source first, then position in the source.

    A match holds a few hundred balls; one with a large share of all rows is
    numbered in slices of its positions.
    """
    order = ["_source", "_pos"]
    cut = df.withColumn("_slice", F.struct(F.col("_source"), F.shiftright(F.col("_pos"), CHUNK_BITS)))
    sizes = cut.groupBy("match_id", "_slice").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("match_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("match_id", "_slice", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("match_id", "_slice").orderBy(*order))
    numbered = cut.withColumn("_in", inside).join(before, ["match_id", "_slice"])
    return numbered.withColumn("seq", (F.col("_before") + F.col("_in")).cast("long")).drop("_slice", "_in", "_before")


def ingest(spark: SparkSession, folder: str, match_files: str | None = None,
           cut_year: int = 2021) -> tuple[DataFrame, DataFrame]:
    """Clean matches and labelled deliveries.

    ``folder`` holds the main source (``*matches*.csv``, ``*deliveries*.csv``);
    ``match_files`` a folder of per-match files, used from ``cut_year`` on.
    Their lines are parsed once; matches are stored, since balls take their season.
    """
    match_sources = raw.read_raw(spark, f"{folder}/*matches*.csv", "match")
    ball_sources = raw.read_raw(spark, f"{folder}/*deliveries*.csv", "delivery")
    if match_files:
        extra = raw.since_year(raw.read_match_files(spark, match_files), "start_date", cut_year)
        extra = raw.parsed_once(extra.withColumns({"_source": F.lit(len(ball_sources)), "_pos": F.col("seq")}), "balls")
        ball_sources.append(extra)
        index = raw.build_match_index(extra)
        match_sources.append(index.withColumns({"_source": F.lit(len(match_sources)), "_pos": F.lit(0).cast("long")}))
    matches = conform(raw.numeric_key(raw.clean_matches(match_sources), "id").drop("_source", "_pos"), MATCHES)
    matches = stored(matches, "clean-matches")
    balls = _in_load_order(raw.numeric_key(raw.clean_deliveries(ball_sources), "match_id"))
    seasons = matches.select(F.col("id").alias("_id"), F.col("season").alias("_season"))
    balls = balls.drop("season").join(seasons, F.col("match_id") == F.col("_id"), "left")
    balls = balls.withColumnRenamed("_season", "season").drop("_id", "_source", "_pos")
    return matches, balls


def build(spark: SparkSession, folder: str, out: str, match_files: str | None = None) -> dict[str, list[str]]:
    matches, balls = ingest(spark, folder, match_files)
    return tables.replace_tables(out, matches, balls)
