"""Row-level expressions. Everything here is a built-in Column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Old franchise names and the names they are reported under.
# Names that are already current fall through unchanged.
TEAM_RENAMES = {
    "Deccan Chargers": "Sunrisers Hyderabad",
    "SunRisers Hyderabad": "Sunrisers Hyderabad",
    "Delhi Daredevils": "Delhi Capitals",
    "Kings XI Punjab": "Punjab Kings",
    "Rising Pune Supergiant": "Rising Pune Supergiants",
    "Royal Challengers Bangalore": "Royal Challengers Bengaluru",
}

# Intent classes in alphabetical order; the position is the class index.
INTENT_CLASSES = ["aggressive", "defensive", "neutral", "pressure_error"]

# Phase codes.
PHASE_CODES = {"powerplay": 0, "middle": 1, "death": 2}

# The spellings a CSV reader treats as missing.
NULL_SPELLINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def literal_map(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


# ---- coercion -------------------------------------------------------------

def null_spellings_to_null(col: Column) -> Column:
    return F.when(~F.trim(col).isin(NULL_SPELLINGS), col)


def to_int0(col: Column) -> Column:
    """Number or numeric text to int; anything unreadable becomes 0, fractions are cut."""
    number = col.cast("string").try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number).try_cast("int"), F.lit(0))


def parse_date(col: Column) -> Column:
    return F.coalesce(
        col.cast("string").try_cast("date"),
        F.try_to_timestamp(col.cast("string"), F.lit("dd/MM/yyyy")).cast("date"),
        F.try_to_timestamp(col.cast("string"), F.lit("yyyy/MM/dd")).cast("date"),
    )


def with_season(df: DataFrame, date: str = "date") -> DataFrame:
    """Parsed date plus the season it belongs to; unreadable dates give null for both."""
    return df.withColumn(date, parse_date(F.col(date))).withColumn("season", F.year(date))


def normalise_teams(df: DataFrame, cols: list[str], renames: dict | None = None) -> DataFrame:
    table = literal_map(TEAM_RENAMES if renames is None else renames)
    return df.withColumns({
        c: F.coalesce(F.try_element_at(table, F.col(c)), F.col(c)) for c in cols if c in df.columns
    })


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    missing = {c: v for c, v in defaults.items() if c not in df.columns}
    return df.withColumns({c: F.lit(v) for c, v in missing.items()}) if missing else df


def with_total_runs(df: DataFrame) -> DataFrame:
    if "total_runs" in df.columns:
        return df
    parts = [to_int0(F.col(c)) if c in df.columns else F.lit(0) for c in ("batsman_runs", "extra_runs")]
    return df.withColumn("total_runs", parts[0] + parts[1])


# ---- labels ---------------------------------------------------------------

def intent_label(runs: str = "batsman_runs", extras: str = "extra_runs", dismissal: str = "dismissal_kind") -> Column:
    return (
        F.when(F.col(dismissal).isNotNull(), "pressure_error")
        .when(F.col(runs) >= 4, "aggressive")
        .when((F.col(runs) == 0) & (F.col(extras) == 0), "defensive")
        .otherwise("neutral")
    )


def phase(over: str | Column = "over") -> Column:
    over = F.col(over) if isinstance(over, str) else over
    return F.when(over < 6, "powerplay").when(over < 15, "middle").otherwise("death")


def phase_enc(name: str | Column = "phase") -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return F.coalesce(F.try_element_at(literal_map(PHASE_CODES), name), F.lit(1))


def is_wicket(dismissal: str = "dismissal_kind") -> Column:
    return F.col(dismissal).isNotNull()


def encode_label(label: str | Column = "intent") -> Column:
    label = F.col(label) if isinstance(label, str) else label
    return F.try_element_at(literal_map({c: i for i, c in enumerate(INTENT_CLASSES)}), F.trim(label))


def decode_label(code: str | Column) -> Column:
    code = F.col(code) if isinstance(code, str) else code
    return F.get(F.array(*[F.lit(c) for c in INTENT_CLASSES]), code.cast("int"))


# ---- ratios and rounding --------------------------------------------------

def ratio(num: Column, den: Column, scale: int = 1, nd: int = 2) -> Column:
    """``round(scale * num / den, nd)`` for whole numbers, half away from zero.

    The quotient is exact decimal, so ties never depend on binary fractions.
    A zero denominator gives null.
    """
    top = (num * F.lit(scale)).cast("decimal(20,0)")
    bottom = F.nullif(den, F.lit(0)).cast("decimal(20,0)")
    return F.round(top / bottom, nd).cast("double")


def pct(num: Column, den: Column, nd: int = 2) -> Column:
    return ratio(num, den, 100, nd)


def mean_of_cents(col: str | Column, nd: int) -> Column:
    """Exact mean of a column that carries two decimals, rounded to ``nd``."""
    col = F.col(col) if isinstance(col, str) else col
    cents = F.round(col * 100).cast("long")
    top = F.sum(cents).cast("decimal(20,0)")
    return F.round(top / (F.nullif(F.count(cents), F.lit(0)) * 100).cast("decimal(20,0)"), nd).cast("double")


def even_round(col: Column, nd: int = 2) -> Column:
    """Array-library rounding: scale, nearest even, scale back."""
    factor = float(10 ** nd)
    return F.rint(col * factor) / factor


# ---- text -----------------------------------------------------------------

def fixed(col: Column, nd: int) -> Column:
    """Number as text with ``nd`` decimals."""
    return F.format_string(f"%.{nd}f", col.cast("double"))


def clean_stat(col: Column) -> Column:
    return F.when(col.isNull() | F.isnan(col.cast("double")), "N/A").otherwise(F.round(col.cast("double"), 2).cast("string"))


def slug(col: Column, separators: str = " ", dropped: str = "") -> Column:
    """Separators become underscores, dropped characters vanish."""
    return F.translate(col, separators + dropped, "_" * len(separators))


def clip(col: Column, n: int) -> Column:
    return F.substring(col, 1, n)


# ---- live rates -----------------------------------------------------------

def with_live_rates(df: DataFrame, over: str = "over", ball: str = "ball_num", runs: str = "cum_runs",
                    target: str = "target") -> DataFrame:
    """Current rate, required rate and their gap from the state carried by an event."""
    elapsed = F.col(over) * 6 + F.col(ball)
    left = (F.lit(20) - F.col(over)) * 6 - F.col(ball)
    current = F.col(runs) / F.greatest(elapsed / F.lit(6.0), F.lit(0.1))
    required = F.when(
        F.col(target) > 0, (F.col(target) - F.col(runs)) / F.greatest(left / F.lit(6.0), F.lit(0.1))
    ).otherwise(F.lit(0.0))
    return df.withColumns({
        "balls_elapsed": elapsed,
        "current_rr": even_round(current),
        "required_rr": even_round(required),
        "pressure_index": F.abs(required - current),
    })
