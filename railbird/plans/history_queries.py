"""Queries over past runs: flat and nested form, net ratings, strike rates."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railbird.functions.scalars import GOING_CATEGORIES
from railbird.operators import history
from railbird.operators.groups import InTask
from railbird.plans import star
from railbird.plans.catalog import query, rounded

SCALARS = [c for c in history.FEATURES if c != "going_breakdown"]
TALLIES = ("starts", "wins", "places")

USABLE = "wpr IS NOT NULL AND wpr <> 0 AND NOT coalesce(isBarrierTrial, false) AND (race_date IS NULL OR CAST(date AS DATE) < race_date)"


def _mean(condition: str, value: str, digits: int) -> str:
    chosen = f"CASE WHEN {condition} THEN {value} END"
    return rounded(f"sum({chosen} ORDER BY n) / nullif(count({chosen}), 0)", digits)


def features_sql(source: str, targets: str) -> str:
    """The features of ``history`` over ``source`` (usable runs with their number ``n``) for all ``targets``."""
    near = "(distance <> 0 AND race_distance <> 0 AND distance BETWEEN race_distance * 0.9e0 AND race_distance * 1.1e0)"
    same = "(going <> '' AND race_going <> '' AND lower(going) = lower(race_going))"
    blend = "(n <= 5 AND margin800m IS NOT NULL AND marginFinish IS NOT NULL)"
    m4, se, sm, sl = (f"coalesce({c}, 0)" for c in ("margin400m", "raceShapeEarly", "raceShapeMid", "raceShapeLate"))
    phases = {
        "early": f"-margin800m - {se}",
        "mid": f"margin800m - {m4} - {sm}",
        "late": f"{m4} - marginFinish - {sl}",
        "total": f"margin800m - marginFinish - ({se} + {sm} + {sl})",
    }
    mark = (
        "CASE WHEN positionFinish IS NULL THEN '?' WHEN positionFinish = 0 OR positionFinish > 9 THEN 'x' "
        "ELSE CAST(positionFinish AS STRING) END"
    )
    older = "avg(wpr) FILTER (WHERE n IN (2, 3))"
    weights = "list(weightCarried ORDER BY n) FILTER (WHERE n <= 5 AND weightCarried IS NOT NULL)"
    parts = [
        "max(wpr) FILTER (WHERE n = 1) AS wpr_last1",
        f"{_mean('n <= 3', 'wpr', 1)} AS wpr_avg_last3",
        f"{rounded(f'max(wpr) FILTER (WHERE n = 1) - {older}', 1)} AS wpr_trend",
        f"CASE WHEN count(*) >= 3 THEN {rounded('stddev_samp(wpr) FILTER (WHERE n <= 5)', 1)} END AS wpr_consistency",
        "arg_min(CASE WHEN positionFinish IS NULL THEN -1 ELSE positionFinish END, n) FILTER (WHERE formNumber = peak_form_number) AS peak",
        "CAST(count(*) AS INT) AS runs_with_wpr",
        f"{_mean(near, 'wpr', 1)} AS wpr_dist",
        f"CAST(count(*) FILTER (WHERE {near}) AS INT) AS wpr_dist_n",
        f"{_mean(same, 'wpr', 1)} AS wpr_going",
        f"{_mean('n <= 5', 'positionSettled', 1)} AS avg_settled_pos",
        f"{_mean('n <= 5', 'position800m', 1)} AS avg_800m_pos",
        f"{_mean('n <= 5', 'position400m', 1)} AS avg_400m_pos",
        *[f"{_mean(blend, rounded(e, 2), 2)} AS {p}_speed_score" for p, e in phases.items()],
        f"CASE WHEN len({weights}) >= 3 THEN {rounded(f'({weights})[1] - list_avg(({weights})[2:])', 1)} END AS weight_trend",
        f"CAST(count(*) FILTER (WHERE {near} AND positionFinish = 1) AS INT) AS near_wins",
        f"CAST(count(*) FILTER (WHERE {near} AND positionFinish BETWEEN 1 AND 3) AS INT) AS near_places",
        f"string_agg(CASE WHEN n <= 4 THEN {mark} END, '-' ORDER BY n) AS form_string",
    ]
    for cat in GOING_CATEGORIES:
        is_cat = f"lower(going) LIKE '{cat}%'"
        conditions = {"starts": is_cat, "wins": f"{is_cat} AND positionFinish = 1", "places": f"{is_cat} AND positionFinish BETWEEN 1 AND 3"}
        parts += [f"CAST(nullif(count(*) FILTER (WHERE {is_cat}), 0) * 0 + count(*) FILTER (WHERE {c}) AS INT) AS {cat}_{t}" for t, c in conditions.items()]
    counted = f"counted AS (SELECT run_id, {', '.join(parts)} FROM {source} GROUP BY run_id)"
    known = "race_distance <> 0"
    chosen = {
        "wpr_peak_rank_1yr": "nullif(peak, -1)",
        "runs_with_wpr": "coalesce(runs_with_wpr, 0)",
        "wpr_dist_n": "coalesce(wpr_dist_n, 0)",
        "wins_at_dist": f"CASE WHEN {known} THEN coalesce(near_wins, 0) END",
        "starts_at_dist": f"CASE WHEN {known} THEN coalesce(wpr_dist_n, 0) END",
        "places_at_dist": "coalesce(near_places, 0)",
    }
    cols = [f"{chosen.get(c, c)} AS {c}" for c in SCALARS] + [f"{cat}_{t}" for cat in GOING_CATEGORIES for t in TALLIES]
    return f"{counted} SELECT run_id, {', '.join(cols)} FROM {targets} LEFT JOIN counted USING (run_id)"


def flat_features(df: DataFrame) -> DataFrame:
    return df.select(
        "run_id",
        *SCALARS,
        *[F.col("going_breakdown")[cat][t].alias(f"{cat}_{t}") for cat in GOING_CATEGORIES for t in TALLIES],
    )


@query(
    "history_runs",
    f"WITH {star.RUNS_SQL}, {star.TARGETS_SQL}, usable AS (SELECT *, row_number() OVER "
    f"(PARTITION BY run_id ORDER BY shipped DESC, ok, ln, sk) AS n FROM runs JOIN targets USING (run_id) WHERE {USABLE}), "
    + features_sql("usable", "targets"),
)
def history_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features from the flat table of past runs."""
    order = [F.col("shipped").desc(), "ok", "ln", "sk"]
    return flat_features(history.run_features(star.runs(spark, sf_dir), star.targets(spark, sf_dir), order=order))


# A vector's values, in order, as the past runs of one runner: ``i`` is the place, ``e`` the value.
NESTED_RUN = {
    "formNumber": "CAST(i AS INT)",
    "date": "CAST(CAST({day} AS DATE) AS STRING)",
    "wpr": "CASE WHEN i % 13 = 0 THEN NULL ELSE floor(abs(e) * 400.0e0) END",
    "isBarrierTrial": "CASE WHEN i % 7 = 0 THEN NULL ELSE e < -0.25e0 END",
    "distance": "CAST(CASE WHEN i % 11 = 0 THEN NULL ELSE 1000 + i % 6 * 200 END AS INT)",
    "going": "CASE WHEN i % 5 = 0 THEN 'FIRM 1' WHEN i % 5 = 1 THEN 'Good 4' WHEN i % 5 = 2 THEN 'Heavy 9' WHEN i % 5 = 3 THEN 'Synthetic' END",
    "positionFinish": "CAST(CASE WHEN i % 9 = 0 THEN NULL ELSE floor(abs(e) * 80.0e0) END AS INT)",
    "positionSettled": "CAST(CASE WHEN e > 0.2e0 THEN NULL ELSE floor(abs(e) * 50.0e0) END AS INT)",
    "position800m": "CAST(CASE WHEN e < -0.2e0 THEN NULL ELSE floor(abs(e) * 40.0e0) END AS INT)",
    "position400m": "CAST(floor(abs(e) * 30.0e0) AS INT)",
    "margin800m": "CASE WHEN i % 6 = 0 THEN NULL ELSE floor(e * 100.0e0) / 8 END",
    "margin600m": "CAST(NULL AS DOUBLE)",
    "margin400m": "CASE WHEN i % 4 = 0 THEN NULL ELSE floor(e * 60.0e0) / 4 END",
    "margin200m": "CAST(NULL AS DOUBLE)",
    "marginFinish": "CASE WHEN i % 10 = 0 THEN NULL ELSE floor(e * 40.0e0) / 4 END",
    "raceShapeEarly": "CASE WHEN i % 3 = 0 THEN NULL ELSE floor(e * 20.0e0) / 8 END",
    "raceShapeMid": "floor(e * 30.0e0) / 8",
    "raceShapeLate": "floor(e * 10.0e0) / 16",
    "weightCarried": "CASE WHEN i % 8 = 0 THEN NULL ELSE 50 + floor(abs(e) * 40.0e0) / 4 END",
}
NESTED_TARGET = {
    "race_date": "CASE WHEN vec_id % 10 = 0 THEN NULL ELSE {day} END",
    "race_distance": "CAST(CASE WHEN label = 3 THEN 0 ELSE 1000 + label * 150 END AS INT)",
    "race_going": "CASE WHEN label % 2 = 0 THEN 'good 4' WHEN label % 3 = 0 THEN 'firm 1' END",
}
_SPARK_DAY = "date_sub(DATE '2024-01-01', CAST(i * 7 AS INT))"
_SQL_DAY = "CAST(DATE '2024-01-01' - CAST(i * 7 AS INT) AS DATE)"
_SPARK_TODAY = "date_sub(DATE '2024-01-01', CAST(label * 14 AS INT))"
_SQL_TODAY = "CAST(DATE '2024-01-01' - CAST(label * 14 AS INT) AS DATE)"


def nested_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = star.table(spark, sf_dir, "embeddings")
    # inside the lambda the two names are fields of its argument
    fields = [(k, re.sub(r"\b([ei])\b", r"p.\1", v.replace("{day}", _SPARK_DAY))) for k, v in NESTED_RUN.items()]
    body = ", ".join(f"'{k}', {v}" for k, v in fields)
    cells = "transform(embedding, (x, n) -> struct(CAST(x AS DOUBLE) AS e, n + 1 AS i))"
    runs = f"transform({cells}, p -> named_struct({body}))"
    domain = "named_struct('period', {p}, 'jumpsOrFlats', 'flatsOnly', 'distances', 'all')"
    peaks = (
        f"array(named_struct('domain', {domain.format(p=repr('career'))}, 'peak1FormNumber', 1), "
        f"named_struct('domain', {domain.format(p=repr('1 year'))}, 'peak1FormNumber', CAST(vec_id % 64 AS INT)), "
        f"named_struct('domain', {domain.format(p=repr('1 year'))}, 'peak1FormNumber', 2))"
    )
    return vectors.select(
        F.col("vec_id").alias("run_id"),
        *[F.expr(e.replace("{day}", _SPARK_TODAY)).alias(k) for k, e in NESTED_TARGET.items()],
        F.expr(runs).alias("form"),
        F.expr(peaks).alias("peak"),
    )


@query(
    "history_nested",
    "WITH targets AS (SELECT vec_id AS run_id, CAST(vec_id % 64 AS INT) AS peak_form_number, "
    + ", ".join(f"{e.replace('{day}', _SQL_TODAY)} AS {k}" for k, e in NESTED_TARGET.items())
    + " FROM embeddings), cells AS (SELECT vec_id AS run_id, CAST(unnest(embedding) AS DOUBLE) AS e, "
    "generate_subscripts(embedding, 1) AS i FROM embeddings), runs AS (SELECT run_id, i, "
    + ", ".join(f"{e.replace('{day}', _SQL_DAY)} AS {k}" for k, e in NESTED_RUN.items())
    + " FROM cells), usable AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY i) AS n "
    f"FROM runs JOIN targets USING (run_id) WHERE {USABLE}), " + features_sql("usable", "targets"),
)
def history_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features from nested form: every row is worked on where it lies."""
    return flat_features(history.form_features(nested_form(spark, sf_dir)))


_ADJUSTED = {
    1: ("o_totalprice / 1000", "CAST(o_custkey % 4 AS DOUBLE)", "CAST(o_custkey % 3 AS DOUBLE)"),
    2: ("CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice / 1500 END", "CAST(NULL AS DOUBLE)", "CAST(o_custkey % 2 AS DOUBLE)"),
    3: ("o_totalprice / 1000 + 1", "0.0e0", "CAST(o_custkey % 5 AS DOUBLE) - 2"),
}


@query(
    "net_ratings",
    "WITH entries AS ("
    + " UNION ALL ".join(
        f"SELECT o_orderkey AS race, {k} AS place, {base} AS base, {adj} AS adj, {dflt} AS dflt FROM orders"
        for k, (base, adj, dflt) in _ADJUSTED.items()
    )
    + f"), nett AS (SELECT race, place, {rounded('base + coalesce(nullif(adj, 0), nullif(dflt, 0), 0)', 1)} AS wpr_nett FROM entries) "
    "SELECT CAST(race AS STRING) AS race_id, CAST(race * 10 + place AS STRING) AS run_id, wpr_nett, CASE WHEN wpr_nett IS NOT NULL THEN "
    "row_number() OVER (PARTITION BY race ORDER BY wpr_nett DESC NULLS LAST, place) END AS wpr_rank FROM nett",
)
def net_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base plus adjustment of each run, ranked in its race."""
    entry = (
        "named_struct('runId', o_orderkey * 10 + {k}, 'defaults', named_struct('wprBase', {base}, "
        "'wprAdjustment', {dflt}), 'adjustments', named_struct('wprAdjustment', {adj}))"
    )
    entries = ", ".join(entry.format(k=k, base=b, adj=a, dflt=d) for k, (b, a, d) in _ADJUSTED.items())
    caches = star.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("raceId"), F.expr(f"array({entries})").alias("runAdjustments")
    )
    # one cache record holds a whole race, so its entries are few
    rated = history.net_ratings(caches)
    ranked = InTask(["race_id"]).numbers(
        rated, {"wpr_rank": [F.col("wpr_nett").desc_nulls_last(), F.col("row_pos")]}
    )
    return ranked.select(
        "race_id", "run_id", "wpr_nett", F.when(F.col("wpr_nett").isNotNull(), F.col("wpr_rank")).alias("wpr_rank")
    )


def _stat(region: str, days: str, rate: str, extra: str = "") -> str:
    return (
        f"named_struct('domain', named_struct('region', {region}, 'startingPrice', 'ALL', 'periodDays', {days}, "
        f"'jumpsOrFlats', 'flatsOnly'), 'winPercent', {rate}{extra})"
    )


@query(
    "strike_rates",
    """SELECT CAST(c_custkey AS STRING) AS run_id,
      CASE WHEN c_nationkey % 3 = 0 THEN c_acctbal / 100 END AS jockey_win_pct_90d,
      CASE WHEN c_nationkey % 2 = 0 THEN c_acctbal / 50 END AS trainer_win_pct_365d,
      CASE WHEN c_nationkey % 5 = 0 THEN c_acctbal / 10 WHEN c_nationkey % 5 = 1 THEN c_acctbal / 20
           WHEN c_nationkey % 5 = 2 THEN 7.5e0 ELSE 9.5e0 END AS jt_combo_win_pct,
      CASE WHEN c_nationkey % 5 = 0 THEN 11 WHEN c_nationkey % 5 = 1 THEN 22 END AS jt_combo_rides
      FROM customer""",
)
def strike_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strike rates from nested statistics: domain matches, combo arrays and scalars."""
    jockey = f"array({_stat(repr('vic'), '90', '1.0e0')}, {_stat('IF(c_nationkey % 3 = 0, ' + repr('All') + ', ' + repr('nsw') + ')', '90', 'c_acctbal / 100')})"
    trainer = f"array({_stat(repr('all'), '90', '2.0e0')}, {_stat(repr('all'), 'IF(c_nationkey % 2 = 0, 365, 30)', 'c_acctbal / 50')})"
    empty = f"slice(array({_stat(repr('all'), '1', '0.0e0', ', ' + repr('rides') + ', 1, ' + repr('starts') + ', 1')}), 1, 0)"
    year = _stat(repr("all"), "365", "c_acctbal / 10", ", 'rides', 11, 'starts', 99")
    first = _stat(repr("vic"), "30", "c_acctbal / 20", ", 'rides', 0, 'starts', 22")
    null_rate = _stat(repr("all"), "365", "CAST(NULL AS DOUBLE)", ", 'rides', CAST(NULL AS INT), 'starts', 0")
    stats = star.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("runId"),
        F.lit(1.0).alias("jockeyRating"),
        F.lit(2.0).alias("trainerRating"),
        F.expr(jockey).alias("jockeyStats"),
        F.expr(trainer).alias("trainerStats"),
        F.expr(f"CASE WHEN c_nationkey % 5 = 0 THEN array({first}, {year}) ELSE {empty} END").alias("jockeyTrainerStats"),
        F.expr(
            f"CASE WHEN c_nationkey % 5 = 1 THEN array({first}) WHEN c_nationkey % 5 = 2 THEN array({null_rate}) END"
        ).alias("comboStats"),
        F.expr("CASE WHEN c_nationkey % 5 = 2 THEN 7.5e0 WHEN c_nationkey % 5 > 2 THEN NULL ELSE 1.5e0 END").alias("jtComboWinPct"),
        F.lit(9.5).alias("jockeyTrainerWinPct"),
    )
    return history.runner_stats(stats).drop("jockey_rating", "trainer_rating")
