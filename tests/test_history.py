"""Cases worked by hand, on nested form, and the flat form must agree."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from railbird.operators import history
from railbird.sources.schemas import FORM, COMBO_ARRAYS, STATS, struct_type

DAY = dt.date(2024, 5, 1)


def run(n, date="2024-04-01", wpr=50.0, **more):
    return {"formNumber": n, "date": date, "wpr": wpr, **more}


def peak(period, number):
    return {"domain": {"period": period, "jumpsOrFlats": "flatsOnly", "distances": "all"}, "peak1FormNumber": number}


def features(spark, form, peaks=(), distance=1000, going="Good 4", day=DAY):
    schema = struct_type(f"{FORM}, race_date DATE, race_distance INT, race_going STRING")
    row = {"runId": 1, "form": form, "peak": list(peaks), "race_date": day, "race_distance": distance, "race_going": going}
    nested = history.form_features(spark.createDataFrame([row], schema)).first().asDict(recursive=True)
    runs = spark.createDataFrame([{"run_id": 1, "form_pos": i, **r} for i, r in enumerate(form)] or [{"run_id": 9}],
                                 "run_id INT, form_pos INT, " + _RUN_DDL)
    targets = spark.createDataFrame(
        [(1, day, distance, going)], "run_id int, race_date date, race_distance int, race_going string"
    ).withColumn("peak_form_number", history.peak_form_number(F.lit(None).cast(_PEAK_TYPE)))
    chosen = next((p["peak1FormNumber"] for p in peaks if p["domain"]["period"] == "1 year"), None)
    targets = targets.withColumn("peak_form_number", F.lit(chosen).cast("int"))
    flat = history.run_features(runs, targets).first().asDict(recursive=True)
    assert {k: flat[k] for k in history.FEATURES} == {k: nested[k] for k in history.FEATURES}
    return nested


_RUN_DDL = """formNumber INT, date STRING, wpr DOUBLE, isBarrierTrial BOOLEAN, distance INT, going STRING, positionFinish INT,
  positionSettled INT, position800m INT, position400m INT, margin800m DOUBLE, margin400m DOUBLE, marginFinish DOUBLE,
  raceShapeEarly DOUBLE, raceShapeMid DOUBLE, raceShapeLate DOUBLE, weightCarried DOUBLE"""
_PEAK_TYPE = "array<struct<domain:struct<period:string,jumpsOrFlats:string,distances:string>,peak1FormNumber:int>>"


def test_no_form(spark):
    f = features(spark, [])
    assert f["runs_with_wpr"] == 0 and f["wpr_dist_n"] == 0 and f["places_at_dist"] == 0
    assert f["starts_at_dist"] == 0 and f["going_breakdown"] == {}
    assert f["wpr_last1"] is None and f["form_string"] is None and f["wpr_trend"] is None


def test_look_ahead_trials_and_unrated_runs_do_not_count(spark):
    form = [
        run(1, "2024-05-02"), run(2, "2024-05-01"), run(3, None), run(4, isBarrierTrial=True), run(5, wpr=0.0),
        run(6, wpr=None), run(7, "2024-04-30", wpr=61.0),
    ]
    f = features(spark, form)
    assert f["runs_with_wpr"] == 1 and f["wpr_last1"] == 61.0
    # without a race day every rated run counts
    assert features(spark, form, day=None)["runs_with_wpr"] == 4


@pytest.mark.parametrize(
    ("wprs", "last3", "trend", "sd"),
    [
        ([50], 50.0, None, None),
        ([50, 44], 47.0, 6.0, None),
        ([50, 44, 47], 47.0, 4.5, 3.0),
        ([50, 44, 47, 10, 20, 90], 47.0, 4.5, 18.0),
    ],
)
def test_levels_and_trend(spark, wprs, last3, trend, sd):
    f = features(spark, [run(i, wpr=float(w)) for i, w in enumerate(wprs)])
    assert (f["wpr_avg_last3"], f["wpr_trend"], f["wpr_consistency"]) == (last3, trend, sd)
    assert f["runs_with_wpr"] == len(wprs)


def test_distance_band_is_inclusive(spark):
    form = [
        run(1, distance=900, wpr=40.0, positionFinish=1), run(2, distance=1100, wpr=50.0, positionFinish=3),
        run(3, distance=899), run(4, distance=1101), run(5, distance=None), run(6, distance=0),
    ]
    f = features(spark, form)
    assert (f["wpr_dist"], f["wpr_dist_n"], f["starts_at_dist"], f["wins_at_dist"], f["places_at_dist"]) == (45.0, 2, 2, 1, 2)
    for unknown in (None, 0):
        f = features(spark, form, distance=unknown)
        assert (f["wpr_dist"], f["wpr_dist_n"], f["starts_at_dist"], f["wins_at_dist"], f["places_at_dist"]) == (None, 0, None, None, 0)


def test_going(spark):
    form = [
        run(1, going="GOOD 4", wpr=40.0, positionFinish=1), run(2, going="good 4", wpr=45.0, positionFinish=3),
        run(3, going="Good 3", positionFinish=4), run(4, going="Heavy 8", positionFinish=2), run(5, going="dirt"), run(6, going=""),
    ]
    f = features(spark, form)
    assert f["wpr_going"] == 42.5
    assert f["going_breakdown"] == {"good": {"starts": 3, "wins": 1, "places": 2}, "heavy": {"starts": 1, "wins": 0, "places": 1}}
    assert features(spark, form, going=None)["wpr_going"] is None


def test_form_string(spark):
    form = [run(i, positionFinish=p) for i, p in enumerate([None, 0, 1, 9, 10])]
    assert features(spark, form)["form_string"] == "?-x-1-9"
    assert features(spark, form[3:])["form_string"] == "9-x"


def test_peak_must_lie_in_the_form(spark):
    form = [run(1, positionFinish=4), run(2, "2024-05-03", positionFinish=1)]
    assert features(spark, form, [peak("career", 2), peak("1 year", 1)])["wpr_peak_rank_1yr"] == 4
    assert features(spark, form, [peak("1 year", 2), peak("1 year", 1)])["wpr_peak_rank_1yr"] is None


def test_positions_sectionals_and_weight(spark):
    form = [
        run(1, positionSettled=2, margin800m=1.0, margin400m=2.0, marginFinish=0.5, raceShapeEarly=0.25, weightCarried=57.0),
        run(2, positionSettled=5, margin800m=3.0, marginFinish=1.0, raceShapeLate=-0.5, weightCarried=None),
        run(3, position800m=4, margin800m=None, marginFinish=1.0, weightCarried=55.0),
        run(4, weightCarried=54.0), run(5, weightCarried=56.0), run(6, positionSettled=20, weightCarried=90.0),
    ]
    f = features(spark, form)
    assert (f["avg_settled_pos"], f["avg_800m_pos"], f["avg_400m_pos"]) == (3.5, 4.0, None)
    # early -1.25 and -3.0; mid -1.0 and 3.0; late 1.5 and -0.5; total 0.25 and 2.5
    assert (f["early_speed_score"], f["mid_speed_score"], f["late_speed_score"]) == (-2.12, 1.0, 0.5)
    assert f["total_speed_score"] == 1.38
    assert f["weight_trend"] == 2.0


def test_net_rating_falls_through_zero(spark):
    ddl = "raceId BIGINT, runAdjustments ARRAY<STRUCT<runId: BIGINT, defaults: STRUCT<wprBase: DOUBLE, wprAdjustment: DOUBLE>, adjustments: STRUCT<wprAdjustment: DOUBLE>>>"
    entries = [(1, (50.0, 2.0), (0.0,)), (2, (50.0, 2.0), (-1.0,)), (3, (None, 2.0), (1.0,)), (4, (50.0, None), None)]
    got = history.net_ratings(spark.createDataFrame([(7, entries)], ddl)).collect()
    assert [r["wpr_nett"] for r in got] == [52.0, 49.0, None, 50.0]


def test_stats(spark):
    def stat(region, days, rate, **more):
        return {"domain": {"region": region, "startingPrice": "all", "periodDays": days, "jumpsOrFlats": "FlatsOnly"}, "winPercent": rate, **more}

    rows = [
        {"runId": 1, "jockeyStats": [stat("vic", 90, 1.0), stat("All", 90, 2.0)], "trainerStats": [stat("all", 90, 3.0)],
         "comboStats": [stat("vic", 30, 4.0, rides=0, starts=8)], "jtComboWinPct": 9.0},
        {"runId": 2, "jockeyTrainerStats": [], "jtStats": [stat("vic", 1, 5.0), stat("all", 365, None, rides=3)], "jtComboWinPct": 6.0},
        {"runId": 3, "jockeyTrainerWinPct": 7.0},
    ]
    got = history.runner_stats(spark.createDataFrame(rows, struct_type(STATS))).orderBy("run_id").collect()
    assert COMBO_ARRAYS[0] == "jockeyTrainerStats"
    assert [(r["jockey_win_pct_90d"], r["trainer_win_pct_365d"]) for r in got] == [(2.0, None), (None, None), (None, None)]
    assert [(r["jt_combo_win_pct"], r["jt_combo_rides"]) for r in got] == [(4.0, 8), (6.0, 3), (7.0, None)]


def test_a_runner_with_very_many_runs(spark):
    """A runner set apart for its size gets the same features."""
    runs = spark.range(400).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 0 ELSE CAST(id % 40 AS INT) END AS run_id", "CAST(id AS INT) AS form_pos", "CAST(id AS INT) AS formNumber",
        "CAST(date_add(DATE '2023-01-01', CAST(id * 7 % 600 AS INT)) AS STRING) AS date", "CAST(id % 50 AS DOUBLE) AS wpr", "false AS isBarrierTrial",
        "CAST(800 + id % 9 * 100 AS INT) AS distance", "IF(id % 2 = 0, 'Good 4', 'Soft 5') AS going", "CAST(id % 12 AS INT) AS positionFinish",
        "CAST(id % 10 AS INT) AS positionSettled", "CAST(id % 8 AS INT) AS position800m", "CAST(id % 7 AS INT) AS position400m",
        "id % 5 / 4 AS margin800m", "id % 3 / 2 AS margin400m", "id % 4 / 8 AS marginFinish", "0.25D AS raceShapeEarly", "0.5D AS raceShapeMid",
        "CAST(NULL AS DOUBLE) AS raceShapeLate", "50 + id % 6 / 2 AS weightCarried",
    ).repartition(5)
    targets = spark.range(40).selectExpr(
        "CAST(id AS INT) AS run_id", "DATE '2024-05-01' AS race_date", "1000 AS race_distance", "'good 4' AS race_going",
        "CAST(id * 3 AS INT) AS peak_form_number",
    )
    plain = sorted(history.run_features(runs, targets).collect(), key=lambda r: r["run_id"])
    split = sorted(history.run_features(runs, targets, max_rows=50).collect(), key=lambda r: r["run_id"])
    assert plain[0]["runs_with_wpr"] > 100 and split == plain
