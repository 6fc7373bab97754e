"""Data-quality checks, each one pass over its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innings.functions.scalars import parse_date

# The columns whose nulls are reported.
CRITICAL_MATCH_COLS = ["id", "season", "team1", "team2", "winner", "venue", "date"]
CRITICAL_DELIVERY_COLS = [
    "match_id", "inning", "over", "ball", "batter", "bowler", "batsman_runs", "total_runs", "dismissal_kind",
]
# Names that have to be normalised.
KNOWN_TEAM_VARIANTS = [
    "Deccan Chargers", "SunRisers Hyderabad", "Delhi Daredevils", "Kings XI Punjab", "Rising Pune Supergiant",
    "Rising Pune Supergiants",
]


def _tall(one_row: DataFrame, names: list[str], key: str, value: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias(key), F.col(n).alias(value)) for n in names])
    return one_row.select(F.explode(pairs).alias("_p")).select(f"_p.{key}", f"_p.{value}")


def audit_nulls(df: DataFrame, cols: list[str]) -> DataFrame:
    """Critical columns that have nulls, with how many."""
    present = [c for c in cols if c in df.columns]
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in present])
    return _tall(counts, present, "column_name", "nulls").filter(F.col("nulls") > 0)


def audit_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of their key (a null key counts as a key)."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def known_variants(df: DataFrame, cols: list[str], known: list[str]) -> DataFrame:
    """Values of the columns that occur in a known list, filtered before the distinct."""
    values = df.select(F.explode(F.array(*cols)).alias("name"))
    return values.filter(F.col("name").isin(known)).distinct()


def team_variants(matches: DataFrame, known: list[str] | None = None) -> DataFrame:
    return known_variants(matches, ["team1", "team2"], known or KNOWN_TEAM_VARIANTS)


def coverage(matches: DataFrame) -> DataFrame:
    """Seasons present, from the date where the season is missing."""
    year = F.year(parse_date(F.col("date"))) if "date" in matches.columns else F.lit(None).cast("int")
    season = F.coalesce(F.col("season").cast("int"), year) if "season" in matches.columns else year
    return matches.select(season.alias("season")).dropna().distinct().orderBy("season")


def audit_outliers(deliveries: DataFrame, max_runs: int = 7) -> DataFrame:
    return deliveries.agg(F.count_if(F.col("total_runs") > max_runs).alias("outliers"))


def audit_counts(deliveries: DataFrame) -> DataFrame:
    batter = "batter" if "batter" in deliveries.columns else "batsman"
    return deliveries.agg(
        F.count(F.lit(1)).alias("total_deliveries"), F.count_distinct(batter).alias("unique_batters"))


def bounded_sample(df: DataFrame, key: list[str], n: int = 50_000, seed: int = 42) -> DataFrame:
    """The ``n`` rows with the smallest seeded digest of the key; the same rows on every run.

    A count per slice of the digests finds the slices that hold the first
    ``n`` rows, so only about that many rows are sorted, however large the
    table is.
    """
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    hashed = df.withColumn("_h", digest).withColumn("_slice", F.substring("_h", 1, 4))
    counts = hashed.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))  # at most 65,536 rows
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter(F.col("_before") < n)
    last = needed.agg(F.max("_slice").alias("_last")).scalar()
    return hashed.filter(F.col("_slice") <= last).orderBy("_h", *key).limit(n).drop("_h", "_slice")


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: counts, distinct values and, for numbers, range, mean and deviation.

    Each column is read on its own and counted per value with map-side parts,
    so no row is turned into cells.
    """
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    parts = []
    for c in df.columns:
        per_value = df.groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        parts.append(per_value.agg(
            F.lit(c).alias("column_name"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
            F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
            F.count("v").alias("n_distinct")))
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.unionByName(p)
    if not numeric:
        none = F.lit(None).cast("double")
        return counts.withColumns({c: none for c in ("min_value", "max_value", "mean_value", "std_value")})
    stats = df.agg(*[
        F.struct(
            F.min(c).cast("double").alias("min_value"), F.max(c).cast("double").alias("max_value"),
            F.round(F.avg(c), 4).alias("mean_value"), F.round(F.stddev_samp(c), 4).alias("std_value"),
        ).alias(c) for c in numeric
    ])
    tall = _tall(stats, numeric, "column_name", "s").select("column_name", "s.*")
    return counts.join(tall, "column_name", "left")


def _issues(one_row: DataFrame, entries: list[tuple[str, Column, Column]]) -> DataFrame:
    """(check, subject, value) rows from the columns of a one-row aggregate."""
    rows = F.array(*[F.struct(F.lit(check).alias("check_name"), subject.cast("string").alias("subject"),
                              value.cast("long").alias("value")) for check, subject, value in entries])
    return one_row.select(F.explode(rows).alias("r")).select("r.*")


def audit_report(matches: DataFrame, deliveries: DataFrame) -> DataFrame:
    """All checks as (check, subject, value), from one aggregate over each table.

    Seasons and known variants are sets of bounded size.
    """
    year = F.year(parse_date(F.col("date"))) if "date" in matches.columns else F.lit(None).cast("int")
    season = F.coalesce(F.col("season").cast("int"), year) if "season" in matches.columns else year
    m_cols = [c for c in CRITICAL_MATCH_COLS if c in matches.columns]
    d_cols = [c for c in CRITICAL_DELIVERY_COLS if c in deliveries.columns]
    batter = "batter" if "batter" in deliveries.columns else "batsman"
    known = [F.collect_set(F.when(F.col(t).isin(KNOWN_TEAM_VARIANTS), F.col(t))) for t in ("team1", "team2")]
    m = matches.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in m_cols],
        # A null key counts as a key.
        (F.count(F.lit(1)) - F.count_distinct("id") - F.coalesce(F.max(F.col("id").isNull().cast("int")), F.lit(0)))
        .alias("duplicates"),
        F.array_union(*known).alias("variants"), F.collect_set(season).alias("seasons"))
    d = deliveries.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in d_cols], F.count(F.lit(1)).alias("total"),
        F.count_distinct(batter).alias("batters"), F.count_if(F.col("total_runs") > 7).alias("outliers"))

    def nulls(row: DataFrame, check: str, cols: list[str]) -> DataFrame:
        return _issues(row, [(check, F.lit(c), F.col(f"nulls_{c}")) for c in cols]).where("value > 0")

    def listed(check: str, values: str) -> DataFrame:
        each = m.select(F.explode(values).alias("v"))
        return each.select(F.lit(check).alias("check_name"), F.col("v").cast("string").alias("subject"),
                           F.lit(1).cast("long").alias("value"))

    parts = [
        nulls(m, "match_nulls", m_cols), _issues(m, [("match_duplicate_ids", F.lit("id"), F.col("duplicates"))]),
        listed("team_name_variant", "variants"), listed("season_covered", "seasons"),
        nulls(d, "delivery_nulls", d_cols),
        _issues(d, [("total_deliveries", F.lit("deliveries"), F.col("total")),
                    ("unique_batters", F.lit("batter"), F.col("batters")),
                    ("runs_above_7", F.lit("total_runs"), F.col("outliers"))]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
