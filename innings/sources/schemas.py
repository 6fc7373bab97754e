"""Declared schemas of the stored tables and of the live event."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _schema(fields: dict, required: tuple[str, ...] = ()) -> T.StructType:
    return T.StructType([T.StructField(n, t, n not in required) for n, t in fields.items()])


MATCHES = _schema({
    "id": _L, "season": _I, "date": T.DateType(), "city": _S, "venue": _S, "match_type": _S, "team1": _S,
    "team2": _S, "toss_winner": _S, "toss_decision": _S, "winner": _S, "win_by_runs": _I, "win_by_wickets": _I,
    "player_of_match": _S, "dl_applied": _B, "target_runs": _I, "result": _S,
    "result_margin": T.DecimalType(10, 2), "target_overs": T.DecimalType(6, 2), "super_over": _S, "method": _S,
    "umpire1": _S, "umpire2": _S,
})

DELIVERIES = _schema({
    "match_id": _L, "seq": _L, "inning": _I, "batting_team": _S, "bowling_team": _S, "over": _I, "ball": _I,
    "batter": _S, "bowler": _S, "non_striker": _S, "batsman_runs": _I, "extra_runs": _I, "total_runs": _I,
    "is_wicket": _B, "dismissal_kind": _S, "player_dismissed": _S, "fielder": _S, "intent": _S, "phase": _S,
    "extras_type": _S, "wides": _I, "noballs": _I, "byes": _I, "legbyes": _I, "penalty": _I,
    "other_wicket_type": _S, "other_player_dismissed": _S, "season": _I, "start_date": _S, "venue": _S,
})

CAREER = _schema({
    "player": _S, "season": _I, "role": _S, "phase": _S, "innings": _L, "runs": _L, "balls_faced": _L,
    "strike_rate": _D, "average": _D, "wickets": _L, "economy": _D, "dot_pct": _D,
})

H2H = _schema({
    "batter": _S, "bowler": _S, "phase": _S, "balls": _L, "runs": _L, "wickets": _L, "strike_rate": _D,
    "dot_pct": _D, "boundary_pct": _D,
})

VENUE = _schema({
    "venue": _S, "season": _I, "avg_first_inn": _D, "win_bat_first_pct": _D, "avg_powerplay_rr": _D,
    "avg_middle_rr": _D, "avg_death_rr": _D,
})

FORM = _schema({
    "team": _S, "season": _I, "last5_wins": _L, "last5_losses": _L, "avg_rr_diff": _D, "form_rating": _D,
})

STRENGTH = _schema({"team": _S, "season": _I, "strength_index": _D})

DOCUMENT = _schema({
    "doc_id": _S, "doc_type": _S, "season": _I, "team": _S, "player": _S, "venue": _S, "text": _S,
})

GOLDEN = _schema({"question": _S, "ground_truth": _S})

METRICS = _schema({
    "faithfulness": _D, "answer_relevancy": _D, "context_precision": _D, "context_recall": _D,
    "last_evaluated": _S, "total_questions": _I,
})

# Fixed values of the event format: required fields, then optional ones with their defaults.
EVENT_REQUIRED = {
    "match_id": _S, "batter": _S, "bowler": _S, "non_striker": _S, "over": _I, "ball_num": _I,
    "batting_team": _S, "bowling_team": _S,
}
EVENT_DEFAULTS = {
    "cum_runs": (_I, 0), "wickets_fallen": (_I, 0), "current_rr": (_D, 0.0), "required_rr": (_D, 0.0),
    "target": (_I, 0), "bowler_spell_balls": (_I, 0), "bowler_spell_runs": (_I, 0), "bowler_last3_runs": (_D, 0.0),
    "h2h_sr": (_D, 100.0), "h2h_balls_total": (_I, 0), "batter_last5_avg": (_D, 25.0), "bowler_economy": (_D, 8.0),
    "bowler_type_enc": (_I, 0), "pressure_index": (_D, 0.0), "phase_enc": (_I, 1), "inning": (_I, 1),
    "season": (_I, 2025),
}
# What a stream adds: order, time, the ball's outcome once known, and the second spelling of the pair rate.
EVENT_EXTRA = {
    "seq": _L, "ts": T.TimestampType(), "total_runs": _I, "is_wicket": _B, "h2h_sr_global": _D,
}
EVENT = T.StructType(
    [T.StructField(n, t) for n, t in EVENT_REQUIRED.items()]
    + [T.StructField(n, t) for n, (t, _) in EVENT_DEFAULTS.items()]
    + [T.StructField(n, t) for n, t in EVENT_EXTRA.items()]
)

SCHEMAS = {
    "matches": MATCHES, "deliveries": DELIVERIES, "player_career_stats": CAREER, "h2h_records": H2H,
    "venue_stats": VENUE, "team_form": FORM, "squad_strength": STRENGTH,
}
KEYS = {
    "matches": ["id"], "deliveries": ["match_id", "seq"], "player_career_stats": ["player", "season", "role", "phase"],
    "h2h_records": ["batter", "bowler", "phase"], "venue_stats": ["venue", "season"],
    "team_form": ["team", "season"], "squad_strength": ["team", "season"],
}


def conform(df, schema: T.StructType):
    """Declared columns in order and type; absent ones become null."""
    from pyspark.sql import functions as F

    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ])


def declared(df, schema: T.StructType):
    """The columns that the schema knows in their declared types, the others as they are; what can't be read is null.

    Text that holds a whole number with decimals (``1.0``) is read as that number.
    """
    from pyspark.sql import functions as F

    def typed(name: str, kind: T.DataType):
        col = F.col(f"`{name}`")
        if isinstance(kind, T.IntegralType) and not isinstance(df.schema[name].dataType, T.IntegralType):
            col = col.cast("string").try_cast("double")
        return col.try_cast(kind).alias(name)

    kinds = {f.name: f.dataType for f in schema}
    return df.select(*[typed(c, kinds[c]) if c in kinds else F.col(f"`{c}`") for c in df.columns])
