"""Table and feed schemas, and fitting a DataFrame to one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The runner table's columns, in the order they are saved.
RUNNERS = """
  date DATE, venue STRING, state STRING, race INT, race_id STRING, race_name STRING, distance INT,
  prize_money DOUBLE, going STRING, track_grading STRING, rail_position STRING, start_time STRING,
  race_shape_early DOUBLE, race_shape_mid DOUBLE, race_shape_late DOUBLE, has_first_starter BOOLEAN,
  run_id STRING, tab_number INT, barrier INT, horse STRING, jockey STRING, trainer STRING, runs_with_wpr INT,
  wpr_nett DOUBLE, wpr_rank INT, wpr_last1 DOUBLE, wpr_avg_last3 DOUBLE, wpr_trend DOUBLE, wpr_consistency DOUBLE,
  wpr_peak_rank_1yr INT, wpr_dist DOUBLE, wpr_going DOUBLE,
  avg_settled_pos DOUBLE, avg_800m_pos DOUBLE, avg_400m_pos DOUBLE, early_speed_score DOUBLE,
  mid_speed_score DOUBLE, late_speed_score DOUBLE, total_speed_score DOUBLE,
  rating DOUBLE, rating_price DOUBLE, speed_rating DOUBLE,
  fixed_win_price DOUBLE, jockey_win_pct_90d DOUBLE, trainer_win_pct_365d DOUBLE,
  jockey_rating DOUBLE, trainer_rating DOUBLE, jt_combo_win_pct DOUBLE, jt_combo_rides INT,
  weight_trend DOUBLE, wins_at_dist INT, starts_at_dist INT, places_at_dist INT,
  going_breakdown MAP<STRING, STRUCT<starts: INT, wins: INT, places: INT>>, form_string STRING,
  weight_carried DOUBLE, starting_price_sp DOUBLE, price_top DOUBLE,
  finish_position INT, won INT, placed INT, resulted INT,
  ext_ai_rank INT, ext_ai_price DOUBLE, ext_ai_score DOUBLE, ext_class_rank INT, ext_tac_class_rank INT,
  ext_time_rank INT, ext_early_time_rank INT, ext_last600_rank INT, ext_last400_rank INT, ext_last200_rank INT,
  ext_run_style STRING, ext_class_change DOUBLE, ext_reliable BOOLEAN
"""

# Columns the ingest adds after the fixed ones, and the two that stand in for row position.
RUNNER_EXTRAS = """
  wpr_dist_n INT, sect_early DOUBLE, speed_rank_in_race INT, pace_scenario STRING, contested_pace BOOLEAN,
  settling STRING, ingest_seq BIGINT, row_pos INT
"""

PRICE_HISTORY = "run_id STRING, race_id STRING, snapshot_time TIMESTAMP, fixed_win_price DOUBLE"

# The pick table's columns, in order.
PICKS = """
  date DATE, venue STRING, race INT, race_id STRING, start_time STRING, model STRING, model_label STRING,
  model_desc STRING, run_id STRING, horse STRING, jockey STRING, trainer STRING, tab_number INT, barrier INT,
  rating_rank INT, early_rank INT, mid_rank INT, late_rank INT, total_rank INT, wpr_rank INT,
  ext_ai_rank INT, ext_ai_price DOUBLE, ext_ai_score DOUBLE, ext_class_rank INT, ext_last600_rank INT,
  ext_last400_rank INT, ext_last200_rank INT, ext_run_style STRING, ext_class_change DOUBLE,
  weight_trend DOUBLE, wins_at_dist INT, fixed_win_price DOUBLE, starting_price_sp DOUBLE, price_top DOUBLE,
  finish_position INT, won INT, placed INT, resulted INT
"""

CALENDAR_RACE = """STRUCT<raceId: BIGINT, number: INT, name: STRING, distance: INT, prizeMoney: DOUBLE,
  startTime: STRING, scheduledTime: STRING, raceTime: STRING, startAt: STRING, time: STRING, jumpTime: STRING,
  isAbandoned: BOOLEAN, isBarrierTrial: BOOLEAN>"""
CALENDAR = f"""
  date STRING, meetings ARRAY<STRUCT<venue: STRING, state: STRING, going: STRING, railPosition: STRING,
    trackGrading: STRING, isTrialMeeting: BOOLEAN, isJumpout: BOOLEAN, races: ARRAY<{CALENDAR_RACE}>>>
"""

DETAIL = """
  raceId BIGINT, runners ARRAY<STRUCT<runId: BIGINT, isScratched: BOOLEAN, tabNumber: INT, barrier: INT,
    horse: STRING, jockey: STRING, trainer: STRING, rating: DOUBLE, ratingPrice: DOUBLE, speed: DOUBLE,
    fixedWinPrice: STRING, sectEarly: DOUBLE, weightCarried: DOUBLE>>
"""

NET_RATINGS = """
  raceId BIGINT, runAdjustments ARRAY<STRUCT<runId: BIGINT,
    defaults: STRUCT<wprBase: DOUBLE, wprAdjustment: DOUBLE>, adjustments: STRUCT<wprAdjustment: DOUBLE>>>
"""

FORM = """
  runId BIGINT,
  form ARRAY<STRUCT<formNumber: INT, date: STRING, wpr: DOUBLE, isBarrierTrial: BOOLEAN, distance: INT,
    going: STRING, positionFinish: INT, positionSettled: INT, position800m: INT, position400m: INT,
    margin800m: DOUBLE, margin600m: DOUBLE, margin400m: DOUBLE, margin200m: DOUBLE, marginFinish: DOUBLE,
    raceShapeEarly: DOUBLE, raceShapeMid: DOUBLE, raceShapeLate: DOUBLE, weightCarried: DOUBLE>>,
  peak ARRAY<STRUCT<domain: STRUCT<period: STRING, jumpsOrFlats: STRING, distances: STRING>, peak1FormNumber: INT>>
"""

_STAT_DOMAIN = "domain: STRUCT<region: STRING, startingPrice: STRING, periodDays: INT, jumpsOrFlats: STRING>"
_STAT = f"ARRAY<STRUCT<{_STAT_DOMAIN}, winPercent: DOUBLE>>"
_COMBO = f"ARRAY<STRUCT<{_STAT_DOMAIN}, winPercent: DOUBLE, rides: INT, starts: INT>>"

# The names a feed may give the combined jockey and trainer figures, in order of preference.
COMBO_ARRAYS = ("jockeyTrainerStats", "jockeyTrainerComboStats", "comboStats", "jtComboStats", "jtStats")
COMBO_SCALARS = ("jtComboWinPct", "jt_combo_win_pct", "comboWinPct", "jockeyTrainerWinPct")

STATS = (
    f"runId BIGINT, jockeyRating DOUBLE, trainerRating DOUBLE, jockeyStats {_STAT}, trainerStats {_STAT}, "
    + ", ".join(f"{name} {_COMBO}" for name in COMBO_ARRAYS)
    + ", "
    + ", ".join(f"{name} DOUBLE" for name in COMBO_SCALARS)
)

RESULTS = """
  raceId BIGINT, runners ARRAY<STRUCT<runId: BIGINT, positionFinish: INT, priceStarting: DOUBLE, priceTop: DOUBLE>>
"""

MEETINGS = """
  meetingId STRING, tabMeeting BOOLEAN, isBarrierTrial BOOLEAN, railPosition STRING, stage STRING,
  expectedCondition STRING, formUpdated STRING, ratingsUpdated STRING, hasSectionals BOOLEAN,
  track STRUCT<name: STRING, trackId: STRING, state: STRING, country: STRING, abbrev: STRING, surface: STRING>
"""

# The second provider's record blocks and their column prefixes, and its performance blocks.
RECORD_BLOCKS = {
    "trackRecord": "track_rec",
    "distanceRecord": "dist_rec",
    "trackDistRecord": "trackdist_rec",
    "goodRecord": "good_rec",
    "softRecord": "soft_rec",
    "heavyRecord": "heavy_rec",
    "firstUpRecord": "first_up",
    "secondUpRecord": "second_up",
}
PERFORMANCE_BLOCKS = (
    "trainerA2E_Career",
    "jockeyA2E_Career",
    "trainerJockeyA2E_Career",
    "trainerA2E_Last100",
    "jockeyA2E_Last100",
    "trainerJockeyA2E_Last100",
)


def nested_ddl(fields: dict) -> str:
    """The fields of a struct type; a value is a type's name or the fields of a nested struct."""
    return ", ".join(f"{k}: {t if isinstance(t, str) else f'STRUCT<{nested_ddl(t)}>'}" for k, t in fields.items())


FIELD_RUNNER = {
    "runnerId": "STRING", "name": "STRING", "tabNo": "INT", "barrier": "INT", "weight": "DOUBLE", "weightTotal": "DOUBLE",
    "handicap": "DOUBLE", "age": "INT", "sex": "STRING", "country": "STRING",
    "trainer": {"trainerId": "STRING", "fullName": "STRING", "location": "STRING"},
    "jockey": {"jockeyId": "STRING", "fullName": "STRING", "claim": "DOUBLE", "isApprentice": "BOOLEAN"},
    "priceSP": "DOUBLE", "last10": "STRING", "winPct": "DOUBLE", "placePct": "DOUBLE", "careerStarts": "INT",
    "careerWins": "INT", "prizeMoney": "DOUBLE", "emergencyIndicator": "BOOLEAN", "gearChanges": "STRING",
    "prepRuns": "INT", "formId": "STRING",
    **{b: {"starts": "INT", "firsts": "INT", "seconds": "INT", "thirds": "INT"} for b in RECORD_BLOCKS},
    **{
        b: {"a2E": "DOUBLE", "poT": "DOUBLE", "strikeRate": "DOUBLE", "wins": "INT", "runners": "INT"}
        for b in PERFORMANCE_BLOCKS
    },
}
FIELD_RACE = {
    "raceId": "STRING", "number": "INT", "name": "STRING", "distance": "INT", "raceClass": "STRING", "prizeMoney": "STRING",
    "startTime": "STRING",
}
FIELDS = (
    f"meetingId STRING, races ARRAY<STRUCT<{nested_ddl(FIELD_RACE)}, runners: ARRAY<STRUCT<{nested_ddl(FIELD_RUNNER)}>>>>"
)

RATING_ITEM = """
  raceId STRING, runnerId STRING, raceNo INT, runnerName STRING, aiRank INT, aiPrice DOUBLE, aiScore DOUBLE,
  weightClassRank INT, timeAdjustedWeightClassRank INT, timeRank INT, earlyTimeRank INT, last600TimeRank INT,
  last400TimeRank INT, last200TimeRank INT, runStyle STRING, classChange DOUBLE, isReliable BOOLEAN
"""
RATINGS = f"""
  {RATING_ITEM}, ext_date DATE, ext_meeting_id STRING, ext_venue STRING, ext_race_id STRING, ext_race_number INT
"""

# The ratings taken over from the second provider, and the runner columns they fill.
RATING_COLUMNS = {
    "aiRank": "ext_ai_rank",
    "aiPrice": "ext_ai_price",
    "aiScore": "ext_ai_score",
    "weightClassRank": "ext_class_rank",
    "timeAdjustedWeightClassRank": "ext_tac_class_rank",
    "timeRank": "ext_time_rank",
    "earlyTimeRank": "ext_early_time_rank",
    "last600TimeRank": "ext_last600_rank",
    "last400TimeRank": "ext_last400_rank",
    "last200TimeRank": "ext_last200_rank",
    "runStyle": "ext_run_style",
    "classChange": "ext_class_change",
    "isReliable": "ext_reliable",
}

SECTIONAL_KEYS = ("runnerId", "RunnerId", "runner_id")


def struct_type(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], struct_type(ddl))


def conform(df: DataFrame, ddl: str, keep_extras: bool = True) -> DataFrame:
    """The schema's columns in its order, missing ones as NULL, then any others as they come.

    A text column read for a nested type is parsed as JSON; a value that cannot be cast is NULL.
    """
    wanted = struct_type(ddl)
    have = dict(df.dtypes)
    out = []
    for field in wanted:
        target = field.dataType.simpleString()
        if field.name not in have:
            c = F.lit(None).cast(field.dataType)
        elif have[field.name] == target:
            c = F.col(f"`{field.name}`")
        elif isinstance(field.dataType, T.StructType | T.ArrayType | T.MapType):
            c = F.from_json(F.col(f"`{field.name}`"), field.dataType) if have[field.name] == "string" else F.col(f"`{field.name}`").cast(field.dataType)
        elif isinstance(field.dataType, T.IntegralType) and have[field.name] in ("string", "double", "float"):
            c = F.col(f"`{field.name}`").try_cast("double").try_cast(field.dataType)
        else:
            c = F.col(f"`{field.name}`").try_cast(field.dataType)
        if isinstance(field.dataType, T.FractionalType) and field.name in have:
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(field.name))
    names = set(wanted.fieldNames())
    extras = [F.col(f"`{c}`") for c in df.columns if c not in names] if keep_extras else []
    return df.select(*out, *extras)
