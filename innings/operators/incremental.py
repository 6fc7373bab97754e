"""Career and head-to-head records kept up to date match by match.

The stored rows hold sums, which add up over matches; rates are derived when
they are read. A batch takes only matches that the log of applied matches does
not have, so a match sent again changes nothing, and only the buckets of its
players are rewritten. The log is written last and under the same number: a
batch that broke off is repeated, and the stores that have it already skip it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innings.functions.scalars import pct, ratio
from innings.operators.career import batting_fold, bowling_fold, h2h_fold, with_match
from innings.sources.keyed_store import KeyedStore, adding

_BATTING = ["innings", "runs", "balls", "outs", "dots"]
_BOWLING = ["innings", "runs", "balls", "wickets", "dots"]
_PAIRS = ["balls", "runs", "wickets", "dots", "boundaries"]


def _schema(keys: dict[str, T.DataType], sums: list[str]) -> T.StructType:
    return T.StructType([*(T.StructField(k, t) for k, t in keys.items()), *(T.StructField(s, T.LongType()) for s in sums)])


class RecordBook:
    """Batting, bowling and pair sums below a folder, with the log of the matches that they hold."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 32):
        s, i, n = T.StringType(), T.IntegerType(), T.LongType()

        def store(name: str, keys: dict, sums: list[str]) -> KeyedStore:
            return KeyedStore(spark, f"{root.rstrip('/')}/{name}", _schema(keys, sums), list(keys), buckets)

        self.batting_sums = store("batting", {"player": s, "season": i, "phase": s}, _BATTING)
        self.bowling_sums = store("bowling", {"player": s, "season": i, "phase": s}, _BOWLING)
        self.pair_sums = store("pairs", {"batter": s, "bowler": s, "phase": s}, _PAIRS)
        self.log = store("matches", {"match_id": n}, ["balls"])

    def apply(self, deliveries: DataFrame, matches: DataFrame, batch: int) -> None:
        """Adds the matches of ``deliveries`` that are not in the log yet. A match comes whole, in one batch."""
        known = self.log.read().select("match_id")
        new = deliveries.join(known, "match_id", "left_anti")

        def career(fold: DataFrame, sums: list[str]) -> DataFrame:
            # A fold has one row per match, so its rows are the innings.
            return with_match(fold, matches).groupBy("player", "season", "phase").agg(
                F.count("match_id").alias("innings"), *[F.sum(c).alias(c) for c in sums[1:]])

        self.batting_sums.apply(career(batting_fold(new), _BATTING), batch, adding)
        self.bowling_sums.apply(career(bowling_fold(new), _BOWLING), batch, adding)
        self.pair_sums.apply(h2h_fold(new), batch, adding)
        self.log.apply(new.groupBy("match_id").agg(F.count(F.lit(1)).alias("balls")), batch)

    def batting(self) -> DataFrame:
        zero = F.lit(0).cast("long")
        return self.batting_sums.read().select(
            "player", "season", F.lit("batsman").alias("role"), "phase", "innings", "runs",
            F.col("balls").alias("balls_faced"), pct(F.col("runs"), F.col("balls")).alias("strike_rate"),
            ratio(F.col("runs"), F.col("outs")).alias("average"), zero.alias("wickets"), F.lit(0.0).alias("economy"),
            pct(F.col("dots"), F.col("balls")).alias("dot_pct"))

    def bowling(self) -> DataFrame:
        zero = F.lit(0).cast("long")
        return self.bowling_sums.read().select(
            "player", "season", F.lit("bowler").alias("role"), "phase", "innings", zero.alias("runs"),
            zero.alias("balls_faced"), F.lit(0.0).alias("strike_rate"), F.lit(0.0).alias("average"), "wickets",
            ratio(F.col("runs"), F.col("balls"), 6).alias("economy"),
            pct(F.col("dots"), F.col("balls")).alias("dot_pct"))

    def h2h(self) -> DataFrame:
        balls = F.col("balls")
        return self.pair_sums.read().select(
            "batter", "bowler", "phase", "balls", "runs", "wickets", pct(F.col("runs"), balls).alias("strike_rate"),
            pct(F.col("dots"), balls).alias("dot_pct"), pct(F.col("boundaries"), balls).alias("boundary_pct"))
