"""Matches and deliveries derived from the ``orders`` and ``lineitem`` tables.

Fifty consecutive order keys form a match, its first order gives the match its
attributes, and every line of those orders is a ball.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innings.functions.scalars import is_wicket, phase
from innings.operators.ordered import HOT_ROWS, HOT_SHARE, Sequenced, dealt, hot_keys, running, with_chunk
from innings.session import stored

# The full row order of a match; rows of the line table are all distinct on it.
ROW_ORDER = [
    "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice",
    "l_discount", "l_tax", "l_quantity", "l_returnflag", "l_linestatus",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _team(code: str) -> str:
    return f"concat('Team ', cast({code} as string))"


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per block of fifty orders, described by the block's first order.

    The attributes are reduced to numbers before the aggregate so that it
    runs as a hash aggregate with map-side partial results.
    """
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey div 50 as id",
        "o_orderkey as k",
        "o_custkey as cust",
        "cast(floor(o_totalprice) as bigint) as price",
        "datediff(cast(o_orderdate as date), date'1970-01-01') as day",
        "o_orderstatus = 'F' as closed",
        "o_orderpriority = '1-URGENT' as urgent",
    )
    first = orders.groupBy("id").agg(*[
        F.min_by(c, "k").alias(c) for c in ("cust", "price", "day", "closed", "urgent")
    ])
    sides = first.selectExpr(
        "id", "cust", "price", "closed", "urgent",
        "date_add(date'1970-01-01', day) as date",
        "cust % 8 as a",
        "(cust % 8 + 1 + id % 7) % 8 as b",
    )
    return sides.selectExpr(
        "id",
        "year(date) as season",
        "date",
        "concat('Venue ', cast(cust % 12 as string)) as venue",
        "if(urgent, 'Final', 'League') as match_type",
        f"{_team('a')} as team1",
        f"{_team('b')} as team2",
        f"if(price % 2 = 0, {_team('a')}, {_team('b')}) as toss_winner",
        "if(closed, 'bat', 'field') as toss_decision",
        f"case when price % 25 = 0 then null when price % 3 < 2 then {_team('a')} else {_team('b')} end as winner",
        "cast(if(closed, price % 80, 0) as int) as win_by_runs",
        "cast(if(closed, 0, 1 + price % 10) as int) as win_by_wickets",
    )


_CUTS = ["_cut_order", "_cut_line", "_cut_day"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("match_id", F.expr("l_orderkey div 50"))


def _cut(lines: DataFrame) -> DataFrame:
    """Slices of a hot match along the row order: its orders, their lines, and days."""
    whole = F.lit(-1)
    return lines.withColumns({
        "_cut_order": F.when(F.col("_hot"), F.col("l_orderkey")).otherwise(whole),
        "_cut_line": F.when(F.col("_hot"), F.col("l_linenumber")).otherwise(whole),
        "_cut_day": F.when(F.col("_hot"), F.unix_date(F.col("l_shipdate").cast("date"))).otherwise(whole),
    })


def _balls(lines: DataFrame, extra: list[str]) -> DataFrame:
    return lines.selectExpr(
        "match_id",
        *extra,
        "cast(1 + (l_orderkey % 50) div 25 as int) as inning",
        "cast(((l_orderkey % 25) * 20) div 25 as int) as over",
        "cast(1 + (l_linenumber - 1) % 6 as int) as ball",
        "concat('B', cast(l_partkey % 60 as string)) as batter",
        "concat('B', cast((l_partkey + 7) % 60 as string)) as non_striker",
        "concat('W', cast(l_suppkey % 40 as string)) as bowler",
        "case cast(l_quantity as int) % 8 when 3 then 1 when 4 then 1 when 5 then 2 when 6 then 4 when 7 then 6"
        " else 0 end as batsman_runs",
        "if(l_tax >= 0.075, 1, 0) as extra_runs",
        "case when cast(floor(l_extendedprice) as bigint) % 20 = 0 then"
        " case l_linenumber % 4 when 0 then 'caught' when 1 then 'bowled' when 2 then 'run out' else 'lbw' end"
        " end as dismissal_kind",
    ).withColumns({
        "total_runs": F.col("batsman_runs") + F.col("extra_runs"),
        "player_dismissed": F.when(F.col("dismissal_kind") == "run out", F.col("non_striker"))
        .when(F.col("dismissal_kind").isNotNull(), F.col("batter")),
        "phase": phase("over"),
        "is_wicket": is_wicket(),
    })


def with_teams(balls: DataFrame, games: DataFrame, facts: list[str] | None = None) -> DataFrame:
    """Both sides of every ball, and ``facts`` of its match by the same join."""
    sides = games.select("id", "team1", "team2", *(facts or []))
    first = F.col("inning") == 1
    return balls.join(sides, balls.match_id == sides.id).withColumns({
        "batting_team": F.when(first, F.col("team1")).otherwise(F.col("team2")),
        "bowling_team": F.when(first, F.col("team2")).otherwise(F.col("team1")),
    }).drop("id", "team1", "team2")


def deliveries(spark: SparkSession, sf_dir: str, teams: bool = False) -> DataFrame:
    """One row per ball, without an order: a scan, and one join when ``teams`` are wanted."""
    balls = _balls(_lines(spark, sf_dir), [])
    return with_teams(balls, matches(spark, sf_dir)) if teams else balls


_HOT: dict[tuple, DataFrame] = {}


def _hot_matches(spark: SparkSession, sf_dir: str, share: float, floor: int) -> DataFrame:
    """The hot matches of a folder of tables: counted once per session and stored, then shared by all queries."""
    at = (spark.sparkContext.applicationId, sf_dir, share, floor)
    if at not in _HOT:
        _HOT[at] = stored(hot_keys(_lines(spark, sf_dir), "match_id", share, floor), "hot-matches")
    return _HOT[at]


def sequenced(spark: SparkSession, sf_dir: str, share: float = HOT_SHARE, floor: int = HOT_ROWS,
              by_match: bool = False) -> Sequenced:
    """Balls with their position in the match.

    An ordinary match is numbered by one window. A match that holds a large
    share of all lines is cut into slices, numbered inside each slice and
    shifted by the size of the slices before it. With ``by_match``, and no hot
    match, balls are dealt by match into parts of bounded size.
    """
    lines = _lines(spark, sf_dir)
    if by_match and _hot_matches(spark, sf_dir, share, floor).isEmpty():
        size = lines.count()
        placed = running(dealt(lines, size, "match_id"), ["match_id"], ROW_ORDER, [], {"seq": F.lit(1)})
        return Sequenced.ordinary(_balls(placed, ["seq"]), _balls(lines, []), size)
    hot = F.broadcast(_hot_matches(spark, sf_dir, share, floor).withColumn("_hot", F.lit(True)))
    some = _cut(lines.join(hot, "match_id"))

    def numbered(cut: DataFrame) -> DataFrame:
        placed = running(cut, ["match_id"], ROW_ORDER, [_CUTS], {"seq": F.lit(1)}, source=some)
        return with_chunk(_balls(placed, ["seq", "_hot"]))

    return Sequenced(
        rows=numbered(_cut(lines.join(hot, "match_id", "left"))),
        hot=numbered(some),
        plain=_balls(lines, []),
    )
