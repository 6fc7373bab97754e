"""Raw match and delivery files: scans, clean-up and the ingest job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innings.functions import scalars as S
from innings.operators.keyed import dedup_keep_last
from innings.operators.ordered import last_n
from innings.session import stored

# The columns that a ball file must have.
REQUIRED_BALL_COLUMNS = ["innings", "ball", "batting_team", "bowling_team", "striker"]
# The match facts taken from a companion info file.
INFO_KEYS = ["winner", "venue", "city", "toss_winner", "toss_decision", "player_of_match", "date"]

# The spellings under which the sources carry each column.
DELIVERY_ALIASES = {
    "match_id": ["match_id", "id"],
    "inning": ["inning", "innings"],
    "batter": ["batter", "striker", "batsman"],
    "batsman_runs": ["batsman_runs", "runs_off_bat"],
    "extra_runs": ["extra_runs", "extras"],
    "dismissal_kind": ["dismissal_kind", "wicket_type"],
}
MATCH_ALIASES = {"id": ["id", "match_id"]}
# What an absent match column holds.
MATCH_DEFAULTS = {
    "target_runs": 0, "win_by_runs": 0, "win_by_wickets": 0, "player_of_match": None, "dl_applied": False,
    "city": None, "venue": None, "toss_decision": None,
}


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in (found or []))


def union_sources(*frames: DataFrame) -> DataFrame:
    """Rows of all sources; a column missing in one of them is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def require_columns(df: DataFrame, cols: list[str]) -> bool:
    return set(cols) <= set(df.columns)


def read_source(spark: SparkSession, path: str, number: int = 0, multi_line: bool = False) -> DataFrame:
    """One CSV source as text columns, with missing spellings as null and the load order kept.

    With ``multi_line`` quoted fields may hold line breaks; such a file cannot be read in parts.
    """
    raw = spark.read.option("header", True).option("multiLine", multi_line).csv(path)
    clean = raw.select(*[S.null_spellings_to_null(F.col(f"`{c}`")).alias(c.strip()) for c in raw.columns])
    return clean.withColumns({"_source": F.lit(number), "_pos": F.monotonically_increasing_id()})


def read_raw(spark: SparkSession, pattern: str, kind: str, multi_line: bool = False) -> list[DataFrame]:
    """Every file that matches, in name order; sources stay apart until their columns are canonical."""
    files = list_files(spark, pattern)
    if not files:
        raise FileNotFoundError(f"no {kind} files match {pattern}")
    return [read_source(spark, f, i, multi_line) for i, f in enumerate(files)]


def _canonical(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    for name, spellings in aliases.items():
        present = [c for c in spellings if c in df.columns]
        if present:
            df = df.withColumn(name, F.coalesce(*[F.col(c) for c in present])).drop(
                *[c for c in present if c != name])
    return df


def canonicalise_deliveries(df: DataFrame) -> DataFrame:
    """Common names, and ``over``/``ball`` from a decimal ball such as 3.2."""
    out = _canonical(df, DELIVERY_ALIASES)
    if "over" not in out.columns and "ball" in out.columns:
        parts = F.split(F.col("ball").cast("string"), r"\.")
        out = out.withColumns({"over": parts.getItem(0), "ball": F.coalesce(F.get(parts, F.lit(1)), F.lit("0"))})
    return out


def canonicalise_matches(df: DataFrame) -> DataFrame:
    return _canonical(df, MATCH_ALIASES)


def clean_matches(sources: list[DataFrame]) -> DataFrame:
    """Typed matches of all sources, the last row per id; each source is typed before the union."""
    numbers = ("target_runs", "win_by_runs", "win_by_wickets")
    typed = []
    for source in sources:
        df = S.with_defaults(S.with_season(canonicalise_matches(source)), MATCH_DEFAULTS)
        typed.append(df.withColumns({c: S.to_int0(F.col(c)) for c in numbers}).withColumn("id", F.col("id").cast("string")))
    df = S.normalise_teams(union_sources(*typed), ["team1", "team2", "winner", "toss_winner"])
    return dedup_keep_last(df, ["id"], ["_source", "_pos"])


def clean_deliveries(sources: list[DataFrame]) -> DataFrame:
    """Canonical, typed and labelled balls of all sources."""
    numbered = []
    for source in sources:
        df = S.with_total_runs(canonicalise_deliveries(source))
        df = S.with_defaults(df, {"batsman_runs": 0, "extra_runs": 0, "dismissal_kind": None})
        numbers = ["batsman_runs", "extra_runs", "total_runs", "over", "ball", "inning"]
        numbered.append(df.withColumns({c: S.to_int0(F.col(c)) for c in numbers if c in df.columns}))
    df = S.normalise_teams(union_sources(*numbered), ["batting_team", "bowling_team"])
    return df.withColumns({
        "dismissal_kind": S.null_spellings_to_null(F.col("dismissal_kind").cast("string")),
        "phase": S.phase("over"),
    }).withColumns({"intent": S.intent_label(), "is_wicket": S.is_wicket()})


def numeric_key(df: DataFrame, col: str) -> DataFrame:
    number = F.col(col).cast("string").try_cast("double").try_cast("long")
    return df.withColumn(col, F.coalesce(number, F.lit(0).cast("long")))


def since_year(df: DataFrame, col: str, year: int) -> DataFrame:
    return df.filter(F.year(S.parse_date(F.col(col))) >= year)


def parsed_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored under neutral column names, so that text is parsed once whatever its columns are called."""
    kept = stored(df.toDF(*[f"c{i}" for i in range(len(df.columns))]), name)
    return kept.toDF(*df.columns)


def read_match_files(spark: SparkSession, folder: str) -> DataFrame:
    """One file per match, with facts in a companion ``*_info.csv`` or inline.

    The whole folder is one text scan. Every ball meets the header line of its
    own file, and a wanted column is looked up by its name there; so neither
    the number of files nor of layouts changes the plan. Header lines and
    facts are stored first, so their real size decides how balls meet them.
    Only the distinct column names come to the driver. Files that lack a
    required column are left out; of two columns of one name the first counts.
    """
    lines = spark.read.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).text(folder).select(
        "value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")
    ).withColumn("stem", F.regexp_replace("file", r"(_info)?\.csv$", ""))
    is_info = F.startswith(F.col("value"), F.lit("info,"))
    companion = F.endswith(F.col("file"), F.lit("_info.csv"))

    parts = F.split("value", ",", 3)
    facts = lines.filter(is_info & (F.size(parts) == 3)).select(
        "stem", F.trim(parts[1]).alias("key"), F.trim(parts[2]).alias("fact"),
        F.struct(companion.alias("companion"), "at").alias("rank"),
    )
    info = facts.groupBy("stem").pivot("key", INFO_KEYS).agg(F.max_by("fact", "rank"))
    info = stored(info.withColumnsRenamed({k: f"_info_{k}" for k in INFO_KEYS}), "match-facts")

    balls = lines.filter(~is_info & ~companion)
    names = F.transform(F.split("head", ","), lambda c: F.trim(F.translate(c, '"', "")))
    # The places alone are aggregated by hash; a smallest-by of text would sort all lines.
    firsts = stored(balls.groupBy(F.col("file").alias("_file")).agg(F.min("at").alias("first")), "first-lines")
    heads = stored(balls.join(firsts, (F.col("file") == F.col("_file")) & (F.col("at") == F.col("first"))).select(
        "file", "first", F.col("value").alias("head")), "headers")
    heads = heads.select("file", "first", names.alias("names")).filter(
        F.size(F.array_except(F.array(*map(F.lit, REQUIRED_BALL_COLUMNS)), "names")) == 0)
    known = sorted(r[0] for r in heads.select(F.explode("names")).distinct().collect())
    if not known:
        raise ValueError(f"no usable match files in {folder}")
    width = heads.agg(F.max(F.size("names"))).first()[0]
    schema = ", ".join(f"c{i} STRING" for i in range(width))
    # Names are looked up once per file: the place of every known name in it, -1 where it has none.
    heads = heads.withColumn("places", F.transform(
        F.array(*map(F.lit, known)), lambda n: F.array_position("names", n).cast("int") - 1))
    # A generator of one row keeps what it makes from being copied into every expression that reads one of its cells.
    rows = balls.join(heads, "file").filter(F.col("at") > F.col("first")).select(
        "stem", (F.col("at") - F.col("first")).alias("seq"), "names", "places",
        F.explode(F.array(F.from_csv("value", schema))).alias("c"))
    rows = rows.select("stem", "seq", "names", "places",
                       F.explode(F.array(F.array(*[F.col(f"c.c{i}") for i in range(width)]))).alias("cells"))
    placed = F.transform(F.transform("places", lambda p: F.get("cells", p)), S.null_spellings_to_null)
    rows = rows.select("stem", "seq", "names", F.explode(F.array(placed)).alias("values"))

    cells = {n: F.get("values", F.lit(i)) for i, n in enumerate(known)}
    # A fact of the companion file stands in where the file has no such column at all.
    for k in INFO_KEYS:
        has = F.array_contains("names", F.lit(k))
        cells[k] = F.when(has, cells[k]).otherwise(F.col(f"_info_{k}")) if k in cells else F.col(f"_info_{k}")
    stem = F.regexp_extract("stem", r"([^/]*)$", 1)
    own = F.array_contains("names", F.lit("match_id"))
    cells["match_id"] = F.when(own, cells["match_id"]).otherwise(stem) if "match_id" in cells else stem
    return rows.join(info, "stem", "left").select("seq", *[c.alias(n) for n, c in cells.items() if n])


def build_match_index(deliveries: DataFrame, date: str = "start_date") -> DataFrame:
    """Match table from balls: the facts of its first ball and its first two batting sides."""
    facts = [date, "venue", "winner", "toss_winner", "toss_decision"]
    present = [c for c in facts if c in deliveries.columns]
    starts = stored(deliveries.groupBy(F.col("match_id").alias("_m")).agg(F.min("seq").alias("_first")), "match-starts")
    opening = deliveries.join(starts, F.col("match_id").eqNullSafe(F.col("_m")) & (F.col("seq") == F.col("_first")))
    first = opening.groupBy("match_id").agg(*[F.min_by(c, "seq").alias(f"_f_{c}") for c in present])
    sides = deliveries.filter(F.col("batting_team").isNotNull()).groupBy("match_id", "batting_team").agg(
        F.min("seq").alias("_s"))
    ranked = last_n(sides, ["match_id"], [F.col("_s")], 2, "_rn")
    teams = ranked.groupBy("match_id").agg(*[
        F.max(F.when(F.col("_rn") == i, F.col("batting_team"))).alias(f"team{i}") for i in (1, 2)
    ])

    def fact(c: str):
        return F.col(f"_f_{c}") if c in present else F.lit(None).cast("string")

    return first.join(teams, "match_id", "left").select(
        F.col("match_id").alias("id"), fact(date).alias("date"), fact("venue").alias("venue"), "team1", "team2",
        fact("winner").alias("winner"), fact("toss_winner").alias("toss_winner"),
        fact("toss_decision").alias("toss_decision"),
        F.lit(0).alias("win_by_runs"), F.lit(0).alias("win_by_wickets"), F.lit(0).alias("target_runs"),
    )
