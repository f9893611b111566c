"""Ratings, results and prices brought to runners, and the races due for them."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import rows
from railbird.operators import merge, prices
from railbird.sources.schemas import RATINGS, struct_type
from test_races import runners

DAY = dt.date(2024, 5, 1)
NOW = dt.datetime(2024, 5, 1, 4, 0)


def ratings(spark, *given):
    ddl = struct_type(f"{RATINGS}, ingest_seq BIGINT, row_pos INT")
    return spark.createDataFrame([{"ext_date": DAY, "raceNo": 5, "ingest_seq": 1, "row_pos": i, **g} for i, g in enumerate(given)], ddl)


def test_ratings_join(spark):
    df = runners(
        spark,
        {"date": DAY, "race": 5, "horse": "Blue Hat ", "venue": "Park", "ext_ai_rank": 9},
        {"date": DAY, "race": 5, "horse": "Red Hat", "ext_ai_rank": 8, "ext_run_style": "x"},
        {"date": DAY, "race": 6, "horse": "Blue Hat"},
        {"date": DAY, "race": None, "horse": "Blue Hat"},
    )
    side = ratings(
        spark,
        {"runnerName": "BLUE HAT", "aiRank": 1, "runStyle": "bm      ", "ext_venue": "Park-Inner"},
        {"runnerName": " blue hat", "aiRank": 2, "runStyle": None, "ext_venue": "Park-Inner"},
        {"runnerName": None, "aiRank": 3},
    )
    joined = merge.join_ratings(df, side)
    # the later of two ratings counts, a missing style stays NULL, and old values go without a match
    assert rows(joined.select("run_id", "ext_ai_rank", "ext_run_style")) == [("0", 2, None), ("1", None, None), ("2", None, None), ("3", None, None)]
    assert rows(merge.join_ratings(joined, side).select("run_id", "ext_ai_rank")) == rows(joined.select("run_id", "ext_ai_rank"))
    assert tuple(merge.rating_match_stats(df, side, joined).first()) == (4, 1, 0.25, 1)
    nothing = merge.join_ratings(df, ratings(spark))
    assert set(joined.columns) == set(nothing.columns) == set(df.columns)
    assert nothing.where("ext_ai_rank IS NOT NULL").count() == 0


def test_results_and_scratchings(spark):
    df = runners(spark, {"race_id": "a"}, {"race_id": "a"}, {"race_id": "a"}, {"race_id": "b"})
    results = spark.createDataFrame(
        [("a", "0", 1, 2.5, 3.0, 0), ("a", "1", 3, 5.0, None, 1)], "race_id string, run_id string, finish int, sp double, top double, row_pos int"
    )
    done = merge.apply_results(df, results)
    want = [("0", 1, 2.5, 3.0, 1, 1, 1), ("1", 3, 5.0, None, 0, 1, 1), ("2", None, None, None, None, None, 1), ("3", None, None, None, None, None, 0)]
    columns = ("run_id", "finish_position", "starting_price_sp", "price_top", "won", "placed", "resulted")
    assert rows(done.select(*columns)) == want
    assert rows(merge.apply_results(done, results).select(*columns)) == want


def test_price_updates(spark):
    df = runners(spark, {"fixed_win_price": None}, {"fixed_win_price": 4.0}, {"fixed_win_price": 4.0}, {"fixed_win_price": 4.0})
    new = spark.createDataFrame([("0", 3.0), ("1", 4.0005), ("2", 4.1), ("9", 2.0)], "run_id string, price double")
    out = merge.apply_prices(df, new, changed="moved")
    assert rows(out.select("run_id", "fixed_win_price", "moved")) == [("0", 3.0, True), ("1", 4.0005, False), ("2", 4.1, True), ("3", 4.0, False)]
    assert tuple(merge.price_stats(df, new).first()) == (4, 2)
    again = merge.apply_prices(out.drop("moved"), new, changed="moved")
    assert again.where("moved").count() == 0


def test_upcoming_window(spark):
    def at(minutes, seconds=0):
        return (NOW + dt.timedelta(minutes=minutes, seconds=seconds)).isoformat()

    starts = [at(-31), at(-30), at(120), at(120, 1), at(30) + "Z", "2024-05-01T14:30:00+10:00", "no time", None]
    df = runners(spark, *[{"race_id": f"r{i}", "start_time": s, "date": DAY} for i, s in enumerate(starts)])
    late_first = runners(spark, {"race_id": "x", "start_time": None, "date": DAY}, {"race_id": "x", "start_time": "05:00", "date": DAY})
    resulted = runners(spark, {"race_id": "y", "start_time": at(10), "resulted": 1}, {"race_id": "z", "start_time": at(10), "resulted": None})
    found = merge.upcoming_races(df.unionByName(late_first).unionByName(resulted), NOW)
    assert rows(found.select("race_id")) == [("r1",), ("r2",), ("r4",), ("r5",), ("x",), ("z",)]


def test_result_races(spark):
    cases = {
        "tomorrow": {"date": DAY + dt.timedelta(1)}, "old": {"date": DAY - dt.timedelta(15)}, "edge": {"date": DAY - dt.timedelta(14)},
        "run": {"date": DAY, "start_time": "03:54"}, "buffer": {"date": DAY, "start_time": "03:56"}, "exact": {"date": DAY, "start_time": "03:55"},
        "unclear": {"date": DAY, "start_time": "noon"}, "undated": {"date": None}, "iso": {"date": DAY, "start_time": "2024-05-01T06:00:00Z"},
        "done": {"date": DAY, "resulted": 1},
    }
    df = runners(spark, *[{"race_id": k, **v} for k, v in cases.items()])
    got = dict(rows(merge.result_races(df, NOW)))
    assert got == {
        "tomorrow": "future", "old": "old", "edge": "due", "run": "due", "buffer": "future", "exact": "due", "unclear": "due",
        "undated": "due", "iso": "future",
    }


def test_snapshot(spark):
    df = runners(
        spark, {"fixed_win_price": 1.0}, {"fixed_win_price": 1.01}, {"fixed_win_price": None}, {"fixed_win_price": 5.0, "resulted": 1},
        {"fixed_win_price": 5.0, "resulted": None},
    )
    got = prices.snapshot(df, NOW)
    assert rows(got.select("run_id", "fixed_win_price")) == [("1", 1.01), ("4", 5.0)]
    assert got.schema["snapshot_time"].dataType.typeName() == "timestamp"


def test_days_change_at_local_midnight_also_when_clocks_do(spark):
    # Melbourne is at +11 until 2024-04-07 03:00 local time, then at +10
    times = ["2024-04-05 12:59:59", "2024-04-05 13:00:00", "2024-04-06 12:30:00", "2024-04-06 13:30:00", "2024-04-07 13:59:59", "2024-04-07 14:00:00"]
    df = spark.createDataFrame([("a", t, float(i)) for i, t in enumerate(times, 1)], "run_id string, t string, fixed_win_price double")
    df = df.select("run_id", F.to_timestamp("t").alias("snapshot_time"), "fixed_win_price")
    want = [("a", 5, 1.0, 1.0, 1), ("a", 6, 2.0, 3.0, 2), ("a", 7, 4.0, 5.0, 2), ("a", 8, 6.0, 6.0, 1)]
    for got in (prices.open_recent(df), prices.days_from_hours(prices.hourly(df))):
        assert rows(got.select("run_id", F.day("local_date"), "open_price", "recent_price", "n")) == want
        assert got.where("open_time > recent_time").count() == 0
    one = prices.open_recent(df, day=dt.date(2024, 4, 7))
    assert one.count() == 1 and prices.attach_prices(runners(spark, {"run_id": "a"}), one, dt.date(2024, 4, 7)).first()["price_points"] == 2
