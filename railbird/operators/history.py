"""Features of a runner's past runs, most recent first, without looking past the race's date.

``form_features`` reads the nested ``form`` array of each row: no shuffle, nothing crosses rows.
``run_features`` does the same for a flat table with one past run per row: one shuffle on the runner.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railbird.functions.scalars import (
    GOING_CATEGORIES,
    as_column,
    first_truthy,
    going_category,
    half_even,
    half_even_sql,
    is_true,
    truthy,
)
from railbird.operators.groups import Groups, attach, per_group
from railbird.sources.schemas import COMBO_ARRAYS, COMBO_SCALARS

RECENT = 5
IN_STRING = 4
UNKNOWN = -1

# The domain of the peak that counts, and the filter of the strike rates used.
PEAK_DOMAIN = {"period": "1 year", "jumpsOrFlats": "flatsOnly", "distances": "all"}
STAT_FILTER = {"region": "all", "startingPrice": "all", "jumpsOrFlats": "flatsOnly"}

FEATURES = (
    "wpr_last1", "wpr_avg_last3", "wpr_trend", "wpr_consistency", "wpr_peak_rank_1yr", "runs_with_wpr",
    "wpr_dist", "wpr_dist_n", "wpr_going", "avg_settled_pos", "avg_800m_pos", "avg_400m_pos",
    "early_speed_score", "mid_speed_score", "late_speed_score", "total_speed_score", "weight_trend",
    "wins_at_dist", "starts_at_dist", "places_at_dist", "going_breakdown", "form_string",
)


def _usable(wpr: Column, trial: Column, run_date: Column, race_date: Column) -> Column:
    """A run counts when rated, not a trial, and before the race; without a race date any date will do."""
    before = race_date.isNull() | (run_date < race_date)
    return truthy(wpr).isNotNull() & ~is_true(trial) & F.coalesce(before, F.lit(False))


def _near(distance: Column, race_distance: Column) -> Column:
    today = truthy(race_distance)
    near = truthy(distance).between(today * 0.9, today * 1.1)
    return F.coalesce(near, F.lit(False))


def _same_going(going: Column, race_going: Column) -> Column:
    return F.coalesce(F.lower(truthy(going, "")) == F.lower(truthy(race_going, "")), F.lit(False))


def _finish_mark(finish: Column) -> Column:
    return F.when(finish.isNull(), F.lit("?")).when((finish == 0) | (finish > 9), F.lit("x")).otherwise(
        finish.cast("string")
    )


def _phases(run) -> dict[str, Column]:
    """Margin gained in each phase less the race's tempo in it; ``run`` maps a field to its column."""

    def field(name):
        return F.coalesce(run(name), F.lit(0.0))

    m800, m400, finish = field("margin800m"), field("margin400m"), field("marginFinish")
    early, mid, late = field("raceShapeEarly"), field("raceShapeMid"), field("raceShapeLate")
    return {
        "early": -m800 - early,
        "mid": (m800 - m400) - mid,
        "late": (m400 - finish) - late,
        "total": (m800 - finish) - (early + mid + late),
    }


# the same over one element r of a form, as SQL: building thousands of columns one by one takes longer than the work on them
_USABLE = (
    "nullif(r.wpr, 0) IS NOT NULL AND NOT coalesce(r.isBarrierTrial, false) "
    "AND coalesce(_day IS NULL OR try_cast(r.date AS DATE) < _day, false)"
)
_FACTS = {
    "near": "coalesce(nullif(r.distance, 0) BETWEEN nullif(_metres, 0) * 0.9D AND nullif(_metres, 0) * 1.1D, false)",
    "going": "coalesce(lower(nullif(r.going, '')) = lower(nullif(_surface, '')), false)",
    "cat": "CASE " + " ".join(f"WHEN startswith(lower(r.going), '{c}') THEN '{c}'" for c in GOING_CATEGORIES) + " END",
    "won": "coalesce(CAST(r.positionFinish = 1 AS INT), 0)",
    "placed": "coalesce(CAST(r.positionFinish BETWEEN 1 AND 3 AS INT), 0)",
    "wpr": "CAST(r.wpr AS DOUBLE)",
}
# sums s over all runs: what each begins with, and when and by how much one fact f adds to it
_SUMS = {
    "near_n": ("0", "f.near", "1"),
    "near_wins": ("0", "f.near", "f.won"),
    "near_places": ("0", "f.near", "f.placed"),
    "near_sum": ("0.0D", "f.near", "f.wpr"),
    "going_n": ("0", "f.going", "1"),
    "going_sum": ("0.0D", "f.going", "f.wpr"),
    **{
        f"{c}_{k}": ("0", f"f.cat <=> '{c}'", value)
        for c in GOING_CATEGORIES
        for k, value in (("starts", "1"), ("wins", "f.won"), ("places", "f.placed"))
    },
}
_FIELD = "coalesce(r.{}, 0.0D)"
_M800, _M400, _FINISH = (_FIELD.format(c) for c in ("margin800m", "margin400m", "marginFinish"))
_EARLY, _MID, _LATE = (_FIELD.format(c) for c in ("raceShapeEarly", "raceShapeMid", "raceShapeLate"))
_BLEND = {
    "early": f"-{_M800} - {_EARLY}",
    "mid": f"({_M800} - {_M400}) - {_MID}",
    "late": f"({_M400} - {_FINISH}) - {_LATE}",
    "total": f"({_M800} - {_FINISH}) - ({_EARLY} + {_MID} + {_LATE})",
}


def _struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def _mean(array: str) -> str:
    return f"aggregate({array}, 0.0D, (a, v) -> a + v) / nullif(size({array}), 0)"


PHASES = ("early", "mid", "late", "total")


def form_features(
    df: DataFrame,
    form: str = "form",
    peak: str | None = "peak",
    race_date: str | Column = "race_date",
    race_distance: str | Column = "race_distance",
    race_going: str | Column = "race_going",
) -> DataFrame:
    """Add the ``FEATURES`` of the nested form to each row."""
    sources = [form, *([peak] if peak else [])]
    kept = [c for c in df.columns if c not in sources]

    def step(df: DataFrame, added: dict[str, str]) -> DataFrame:
        return df.selectExpr("*", *[f"{sql} AS {name}" for name, sql in added.items()])

    target = {"_day": as_column(race_date), "_metres": as_column(race_distance), "_surface": as_column(race_going)}
    df = df.withColumns(target)
    df = step(df, {"_runs": f"filter(coalesce(`{form}`, array()), r -> {_USABLE})"})
    # each run is judged once, and one fold adds up what runs near the distance, on the going and of each category did
    df = step(
        df,
        {
            "_recent": f"slice(_runs, 1, {RECENT})",
            "_facts": f"transform(_runs, r -> {_struct(_FACTS)})",
        },
    )
    zeros = _struct({k: zero for k, (zero, _, _) in _SUMS.items()})
    added = _struct({k: f"IF({when}, s.{k} + {value}, s.{k})" for k, (_, when, value) in _SUMS.items()})
    positions = {"settled": "positionSettled", "800m": "position800m", "400m": "position400m"}
    df = step(
        df,
        {
            "_sums": f"aggregate(_facts, {zeros}, (s, f) -> {added})",
            "_wpr": "transform(_recent, r -> CAST(r.wpr AS DOUBLE))",
            "_phases": "transform(filter(_recent, r -> r.margin800m IS NOT NULL AND r.marginFinish IS NOT NULL), "
            f"r -> {_struct(_BLEND)})",
            "_weights": "filter(transform(_recent, r -> r.weightCarried), w -> w IS NOT NULL)",
            **{
                f"_at_{k}": f"filter(transform(_recent, r -> CAST(r.{field} AS DOUBLE)), v -> v IS NOT NULL)"
                for k, field in positions.items()
            },
        },
    )
    # rounding reads its value many times, so values are worked out one step before
    df = step(
        df,
        {
            "_older": "slice(_wpr, 2, 2)",
            "_three": "slice(_wpr, 1, 3)",
            "_lighter": f"slice(_weights, 2, {RECENT})",
            "_blend": f"transform(_phases, x -> {_struct({k: half_even_sql(f'x.{k}', 2) for k in PHASES})})",
            "_mean": _mean("_wpr"),
        },
    )
    df = step(
        df,
        {
            "_v_wpr_avg_last3": _mean("_three"),
            "_v_wpr_trend": f"IF(size(_runs) >= 2, get(_wpr, 0) - {_mean('_older')}, NULL)",
            "_v_wpr_consistency": "IF(size(_runs) >= 3, "
            "sqrt(aggregate(_wpr, 0.0D, (a, v) -> a + (v - _mean) * (v - _mean)) / (size(_wpr) - 1)), NULL)",
            "_v_wpr_dist": "_sums.near_sum / nullif(_sums.near_n, 0)",
            "_v_wpr_going": "_sums.going_sum / nullif(_sums.going_n, 0)",
            **{f"_v_avg_{k}_pos": _mean(f"_at_{k}") for k in positions},
            **{f"_v_{p}_speed_score": _mean(f"_blend.{p}") for p in PHASES},
            "_v_weight_trend": f"IF(size(_weights) >= 3, get(_weights, 0) - {_mean('_lighter')}, NULL)",
        },
    )
    places = {"wpr_avg_last3": 1, "wpr_trend": 1, "wpr_consistency": 1, "wpr_dist": 1, "wpr_going": 1, "avg_settled_pos": 1,
              "avg_800m_pos": 1, "avg_400m_pos": 1, **{f"{p}_speed_score": 2 for p in PHASES}, "weight_trend": 1}
    tallies = ", ".join(
        f"struct('{c}', {_struct({k: f'_sums.{c}_{k}' for k in ('starts', 'wins', 'places')})})" for c in GOING_CATEGORIES
    )
    mark = "CASE WHEN r.positionFinish IS NULL THEN '?' WHEN r.positionFinish = 0 OR r.positionFinish > 9 THEN 'x' "
    mark += "ELSE CAST(r.positionFinish AS STRING) END"
    out = {
        **{name: half_even_sql(f"_v_{name}", digits) for name, digits in places.items()},
        "wpr_last1": "get(_recent, 0).wpr",
        "runs_with_wpr": "size(_runs)",
        "wpr_dist_n": "_sums.near_n",
        "wins_at_dist": "IF(nullif(_metres, 0) IS NOT NULL, _sums.near_wins, NULL)",
        "starts_at_dist": "IF(nullif(_metres, 0) IS NOT NULL, _sums.near_n, NULL)",
        "places_at_dist": "_sums.near_places",
        "going_breakdown": f"map_from_entries(filter(array({tallies}), e -> e.col2.starts > 0))",
        "form_string": f"nullif(array_join(transform(slice(_runs, 1, {IN_STRING}), r -> {mark}), '-'), '')",
    }
    if peak is None:
        out["wpr_peak_rank_1yr"] = "CAST(NULL AS INT)"
    else:
        df = df.withColumn("_peak", peak_form_number(F.col(peak)))
        out["wpr_peak_rank_1yr"] = "get(filter(_runs, r -> r.formNumber = _peak), 0).positionFinish"
    # a feature the runner table already has is replaced
    return df.select(*[c for c in kept if c not in out], *[F.expr(f"{out[name]} AS {name}") for name in FEATURES])


def peak_form_number(peaks: Column) -> Column:
    """The form number of the first peak of the wanted domain."""

    def wanted(p):
        match = F.lit(True)
        for name, value in PEAK_DOMAIN.items():
            match = match & p["domain"][name].eqNullSafe(F.lit(value))
        return match

    return F.get(F.filter(peaks, wanted), 0)["peak1FormNumber"]


def run_features(
    runs: DataFrame,
    targets: DataFrame,
    run: str = "run_id",
    order: Sequence[str] = ("form_pos",),
    max_rows: int | None = None,
) -> DataFrame:
    """The ``FEATURES`` of each target from a flat table of past runs.

    ``runs`` has one past run per row, with the fields of the nested form and ``order`` giving its
    place, most recent first. ``targets`` has one row per runner: ``run``, ``race_date``,
    ``race_distance``, ``race_going`` and ``peak_form_number``. Every target comes out, with the
    counts at zero where it has no usable run.
    """
    marks = range(1, IN_STRING + 1)

    def features(df: DataFrame, groups: Groups) -> DataFrame:
        # joined here, after runners with very many runs were set apart, so that their join can be split
        df = df.join(targets, run).where(
            _usable(F.col("wpr"), F.col("isBarrierTrial"), F.col("date").try_cast("date"), F.col("race_date"))
        )
        df = groups.numbers(df, {"_n": [F.col(c) if isinstance(c, str) else c for c in order]})
        df = df.withColumns({f"_v_{p}": c for p, c in _phases(lambda name: F.col(name)).items()})
        df = df.withColumns({f"_{p}": half_even(f"_v_{p}", 2) for p in PHASES})
        nth = F.col("_n")
        recent = nth <= RECENT
        wpr, finish = F.col("wpr"), F.col("positionFinish")
        near = _near(F.col("distance"), F.col("race_distance"))
        category = going_category(F.col("going"))
        blended = recent & F.col("margin800m").isNotNull() & F.col("marginFinish").isNotNull()
        weight = F.when(recent, F.col("weightCarried"))

        def mean_if(condition: Column, value: Column, digits: int) -> Column:
            return half_even(F.avg(F.when(condition, value)), digits)

        counted = df.groupBy(run).agg(
            F.max(F.when(nth == 1, wpr)).alias("wpr_last1"),
            mean_if(nth <= 3, wpr, 1).alias("wpr_avg_last3"),
            F.avg(F.when(nth.between(2, 3), wpr)).alias("_older"),
            F.when(F.count("*") >= 3, half_even(F.stddev_samp(F.when(recent, wpr)), 1)).alias("wpr_consistency"),
            F.min_by(finish, F.when(F.col("formNumber") == F.col("peak_form_number"), nth)).alias("wpr_peak_rank_1yr"),
            F.count("*").cast("int").alias("runs_with_wpr"),
            mean_if(near, wpr, 1).alias("wpr_dist"),
            F.count_if(near).cast("int").alias("wpr_dist_n"),
            mean_if(_same_going(F.col("going"), F.col("race_going")), wpr, 1).alias("wpr_going"),
            mean_if(recent, F.col("positionSettled"), 1).alias("avg_settled_pos"),
            mean_if(recent, F.col("position800m"), 1).alias("avg_800m_pos"),
            mean_if(recent, F.col("position400m"), 1).alias("avg_400m_pos"),
            *[mean_if(blended, F.col(f"_{p}"), 2).alias(f"{p}_speed_score") for p in PHASES],
            F.min_by(weight, F.when(weight.isNotNull(), nth)).alias("_weight"),
            F.sum(weight).alias("_weights"),
            F.count(weight).alias("_weighed"),
            F.count_if(near & (finish == 1)).cast("int").alias("wins_at_dist"),
            F.count_if(near & finish.between(1, 3)).cast("int").alias("places_at_dist"),
            *[F.max(F.when(nth == i, F.coalesce(finish, F.lit(UNKNOWN)))).alias(f"_mark{i}") for i in marks],
            *[
                F.struct(
                    F.count_if(category == cat).cast("int").alias("starts"),
                    F.count_if((category == cat) & (finish == 1)).cast("int").alias("wins"),
                    F.count_if((category == cat) & finish.between(1, 3)).cast("int").alias("places"),
                ).alias(f"_{cat}")
                for cat in GOING_CATEGORIES
            ],
        )
        return counted

    counted = per_group(runs, [run], features, max_rows=max_rows)
    out = targets.join(counted, run, "left")
    known_distance = truthy(F.col("race_distance")).isNotNull()
    runs_n = F.coalesce(F.col("runs_with_wpr"), F.lit(0))
    near_n = F.coalesce(F.col("wpr_dist_n"), F.lit(0))
    return out.select(
        *targets.columns,
        F.col("wpr_last1"),
        F.col("wpr_avg_last3"),
        half_even(F.col("wpr_last1") - F.col("_older"), 1).alias("wpr_trend"),
        F.col("wpr_consistency"),
        F.col("wpr_peak_rank_1yr"),
        runs_n.alias("runs_with_wpr"),
        F.col("wpr_dist"),
        near_n.alias("wpr_dist_n"),
        *[F.col(c) for c in FEATURES[8:16]],
        F.when(
            F.col("_weighed") >= 3,
            half_even(F.col("_weight") - (F.col("_weights") - F.col("_weight")) / (F.col("_weighed") - 1), 1),
        ).alias("weight_trend"),
        F.when(known_distance, F.coalesce(F.col("wins_at_dist"), F.lit(0))).alias("wins_at_dist"),
        F.when(known_distance, near_n).alias("starts_at_dist"),
        F.coalesce(F.col("places_at_dist"), F.lit(0)).alias("places_at_dist"),
        F.map_from_entries(
            F.filter(
                F.array(*[F.struct(F.lit(cat).alias("col1"), F.col(f"_{cat}").alias("col2")) for cat in GOING_CATEGORIES]),
                lambda entry: entry["col2"]["starts"] > 0,
            )
        ).alias("going_breakdown"),
        truthy(
            F.array_join(
                F.array_compact(
                    F.array(
                        *[
                            F.when(F.col(f"_mark{i}").isNotNull(), _finish_mark(F.nullif(F.col(f"_mark{i}"), F.lit(UNKNOWN))))
                            for i in marks
                        ]
                    )
                ),
                "-",
            ),
            "",
        ).alias("form_string"),
    )


def net_ratings(caches: DataFrame) -> DataFrame:
    """Race-cache rows to (race_id, run_id, wpr_nett, row_pos): base plus the first non-zero adjustment."""
    entries = caches.select(F.col("raceId").cast("string").alias("race_id"), F.posexplode("runAdjustments").alias("row_pos", "e"))
    adjustment = F.coalesce(
        first_truthy(F.col("e.adjustments.wprAdjustment"), F.col("e.defaults.wprAdjustment"), falsy=0.0), F.lit(0.0)
    )
    return entries.select(
        "race_id",
        F.col("e.runId").cast("string").alias("run_id"),
        half_even(F.col("e.defaults.wprBase") + adjustment, 1).alias("wpr_nett"),
        "row_pos",
    )


def first_stat(stats: Column, days: int) -> Column:
    """The first entry of the wanted domain and period, names compared without case."""

    def matches(s):
        match = s["domain"]["periodDays"].eqNullSafe(F.lit(days))
        for name, value in STAT_FILTER.items():
            match = match & F.lower(s["domain"][name]).eqNullSafe(F.lit(value.lower()))
        return match

    return F.get(F.filter(stats, matches), 0)


def runner_stats(stats: DataFrame) -> DataFrame:
    """Strike rates and ratings of each run's jockey and trainer, and of the two together.

    The combined figures come from the first combo array that is not empty (its entry for a year,
    else its first one); where those give no rate, from the first scalar that is set.
    """
    have = set(stats.columns)
    combo = F.lit(None)
    for name in reversed([c for c in COMBO_ARRAYS if c in have]):
        entry = F.coalesce(first_stat(F.col(name), 365), F.get(F.col(name), 0))
        found = F.struct(entry["winPercent"].alias("rate"), first_truthy(entry["rides"], entry["starts"]).alias("rides"))
        combo = F.when(F.size(F.col(name)) > 0, found).otherwise(combo)
    scalars = [F.col(c) for c in COMBO_SCALARS if c in have]
    with_combo = stats.withColumn("_combo", combo.cast("struct<rate:double,rides:int>"))
    return with_combo.select(
        F.col("runId").cast("string").alias("run_id"),
        first_stat(F.col("jockeyStats"), 90)["winPercent"].alias("jockey_win_pct_90d"),
        first_stat(F.col("trainerStats"), 365)["winPercent"].alias("trainer_win_pct_365d"),
        F.col("jockeyRating").alias("jockey_rating"),
        F.col("trainerRating").alias("trainer_rating"),
        F.coalesce(F.col("_combo.rate"), *scalars).alias("jt_combo_win_pct"),
        F.col("_combo.rides").alias("jt_combo_rides"),
    )
