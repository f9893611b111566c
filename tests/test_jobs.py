"""Landing files to tables and records, and the streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from railbird.operators import prices
from railbird.plans import jobs
from railbird.sources import landing, schemas
from railbird.sources.store import Store
from railbird.streaming import prices as streams

NOW = dt.datetime(2024, 5, 1, 2, 0)
DAY = "2024-05-01"


def land(root, feed, *records, name="f.json"):
    folder = root / feed
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(json.dumps(list(records)))


def land_day(root, results=(), price="4.5"):
    race = {"raceId": 1, "number": 5, "name": "Plate", "distance": 1000, "prizeMoney": 30000.0, "scheduledTime": "2024-05-01T03:00:00Z"}
    small = {"raceId": 2, "number": 6, "prizeMoney": 999.0}
    meeting = {"venue": "Park", "going": "Good 4", "races": [race, small]}
    trial = {"venue": "Yard", "isTrialMeeting": True, "races": [{**race, "raceId": 3}]}
    land(root, "calendar", {"date": DAY, "meetings": [meeting, trial]}, {"date": "2024-05-02", "meetings": [meeting]})
    entry = {"tabNumber": 1, "barrier": 3, "horse": "Blue Hat", "theirRating": 90.0, "speed": 70.0, "fixedWinPrice": price}
    land(root, "detail", {"raceId": 1, "runners": [
        {"runId": 11, **entry}, {"runId": 12, **entry, "horse": "Red Hat", "theirRating": 80.0, "fixedWinPrice": "n/a"},
        {"runId": 13, "isScratched": True, "horse": "Gone"}]})
    land(root, "caches", {"raceId": 1, "runAdjustments": [
        {"runId": 11, "defaults": {"wprBase": 50.0, "wprAdjustment": 1.0}, "adjustments": {"wprAdjustment": 0}}, {"runId": 12, "defaults": {"wprBase": 40.0}}]})
    form = [{"formNumber": 1, "date": "2024-04-01", "wpr": 48.0, "positionFinish": 1, "distance": 1000, "going": "good 4", "margin800m": 1.0, "margin400m": 1.0, "marginFinish": 0.0}]
    land(root, "forms", {"runId": 11, "form": form}, {"runId": 12, "form": [{**form[0], "margin400m": 0.5}]})
    land(root, "stats", {"runId": 11, "jockeyRating": 7.0})
    land(root, "results", *results)


def land_provider(root):
    folder = root / "provider"
    folder.mkdir(parents=True, exist_ok=True)
    track = {"name": "Park-Inner", "state": "VIC"}
    meetings = [{"meetingId": "m1", "tabMeeting": True, "track": track}, {"meetingId": "m2", "tabMeeting": None, "track": track}]
    (folder / f"meetings_{DAY}.json").write_text(json.dumps(meetings))
    runner = {"runnerId": "x", "name": "Blue Hat", "trackRecord": {"starts": 3}, "jockeyA2E_Last100": {"poT": 1.5}}
    races = [{"raceId": "p5", "number": 5, "prizeMoney": "20000", "runners": [runner]}, {"raceId": "p6", "prizeMoney": "19999", "runners": [runner]},
             {"raceId": "p7", "prizeMoney": None, "runners": [runner]}]
    (folder / "fields.json").write_text(json.dumps([{"meetingId": "m1", "races": races}]))
    items = [{"raceId": "p5", "runnerId": "x", "raceNo": 5, "runnerName": "BLUE HAT", "theirRank": 1, "weightClassRank": 1, "last600TimeRank": 1, "runStyle": "bm   "}, 7]
    (folder / f"ratings_{DAY}_m1.json").write_text(json.dumps(items))


def provider_feeds(spark, root):
    path = str(root / "provider")
    return jobs.ProviderFeeds(
        meetings=landing.read_meetings(spark, f"{path}/meetings_*.json"),
        fields=landing.read_feed(spark, f"{path}/fields.json", schemas.FIELDS),
        ratings=landing.read_ratings(spark, f"{path}/ratings_*.json", {"aiRank": "theirRank"}),
    )


@pytest.fixture(scope="module")
def played(spark, tmp_path_factory):
    """Provider ingest twice, a daily run, a refresh, and a daily run after the race."""
    root = tmp_path_factory.mktemp("day")
    store = Store(spark, str(root / "tables"))
    names = {"rating": "theirRating"}
    land_day(root / "one")
    land_provider(root)
    out = {"store": store}
    out["added"] = jobs.provider_ingest(store, provider_feeds(spark, root), NOW)
    out["again"] = jobs.provider_ingest(store, provider_feeds(spark, root), NOW + dt.timedelta(hours=1))
    reports = jobs.daily(store, jobs.Feeds.read(spark, str(root / "one"), names), NOW)
    out["first"] = {k: [r.asDict() for r in v.collect()] for k, v in reports.items()}
    out["runners"] = {r["run_id"]: r.asDict(recursive=True) for r in store.read("runners").collect()}
    out["picks"] = rows(store.latest("picks").select("run_id", "model", "rating_rank"))
    land_day(root / "two", price="4.0")
    detail = jobs.Feeds.read(spark, str(root / "two"), names).detail
    out["dry"] = tuple(jobs.refresh(store, detail, NOW, dry_run=True).first())
    out["refreshed"] = tuple(jobs.refresh(store, detail, NOW + dt.timedelta(minutes=5), records=False).first())
    result = {"raceId": 1, "runners": [{"runId": 11, "positionFinish": 1, "priceStarting": 4.2}]}
    land_day(root / "three", [result])
    later = NOW + dt.timedelta(hours=3)
    feeds = jobs.Feeds.read(spark, str(root / "three"), names)
    jobs.daily(store, feeds, later, again=True, since=dt.date(2024, 4, 20))
    out["after"] = {r["run_id"]: r.asDict(recursive=True) for r in store.read("runners").collect()}
    out["record"] = store.latest("races").collect()
    out["prices"] = rows(store.read("prices").select("run_id", "fixed_win_price"))
    out["history"] = jobs.cull_prices(store, later + dt.timedelta(days=7, hours=-2))
    return out


def test_provider_ingest_is_insert_only(played):
    assert played["added"] == {"ext_meetings": 1, "ext_runners": 2, "ext_ratings": 1}
    assert played["again"] == {"ext_meetings": 0, "ext_runners": 0, "ext_ratings": 0}
    wide = played["store"].read("ext_runners")
    row = wide.where("race_id = 'p5'").first()
    assert (row["track_rec_starts"], row["jockeyA2E_Last100_pot"], row["ext_venue"]) == (3, 1.5, "Park-Inner")
    assert len([c for c in wide.columns if c not in ("row_pos", "ingest_seq", "batch")]) == 102


def test_daily_ingest(played):
    got = played["runners"]
    assert set(got) == {"11", "12"}
    best = got["11"]
    assert (best["race"], best["prize_money"], best["start_time"], best["venue"]) == (5, 30000.0, "2024-05-01T03:00:00Z", "Park")
    assert (best["rating"], best["wpr_nett"], best["wpr_rank"], best["fixed_win_price"], best["jockey_rating"]) == (90.0, 51.0, 1, 4.5, 7.0)
    assert (best["runs_with_wpr"], best["wins_at_dist"], best["form_string"], best["going_breakdown"]["good"]["wins"]) == (1, 1, "1", 1)
    assert (best["ext_ai_rank"], best["ext_run_style"], got["12"]["ext_ai_rank"], got["12"]["fixed_win_price"]) == (1, "bm", None, None)
    assert (best["resulted"], best["finish_position"], best["speed_rank_in_race"], best["settling"]) == (0, None, 1, "leader")


def test_daily_reports_and_picks(played):
    assert played["picks"] == [("11", "loose", 1), ("11", "main", 1)]
    first = played["first"]
    assert sorted((r["model"], r["picks"]) for r in first["summary"]) == [("loose", 1), ("main", 1)]
    assert first["counts"] == [{"races": 1, "resulted": 0, "pending": 1, "primary_picks": 1}]
    assert first["ratings"][0]["matched"] == 1


def test_refresh(played):
    assert played["dry"] == played["refreshed"] == (1, 1)
    assert played["prices"] == [("11", 4.0), ("11", 4.5)]


def test_results_survive_a_second_read_of_the_day(played):
    after = played["after"]
    assert (after["11"]["won"], after["11"]["starting_price_sp"], after["11"]["resulted"]) == (1, 4.2, 1)
    assert (after["12"]["won"], after["12"]["finish_position"], after["12"]["resulted"]) == (None, None, 1)
    record = played["record"][0]
    assert (record["done"], record["fs"], record["race_id"], record["prize"]) == (1, 2, "1", 30000)
    assert [r["rid"] for r in record["runners"]] == ["11", "12"] and record["runners"][0]["csg"]


def test_culled_history(played):
    # the snapshot of 02:00 is too old by then, that of 02:05 as well: seven days before 03:00
    assert played["history"].count() == 0


def test_all_is_published(played):
    store = played["store"]
    picked = {(r["race_id"], m): [p["run_id"] for p in ps] for r in store.latest("race_picks").collect() for m, ps in r["picks"].items()}
    assert picked == {("1", "loose"): ["11"], ("1", "main"): ["11"]} or picked == {}
    assert sorted(r["model"] for r in store.latest("models").collect()) == ["loose", "main"]
    assert [(r["run_id"], r["open_price"], r["recent_price"]) for r in store.latest("day_prices").collect()] == [("11", 4.5, 4.0)]
    assert [(r["model"], r["run_id"], r["place"]) for r in played["first"]["shown"]] == [("loose", "11", 1), ("main", "11", 1)]


def test_emptied_partitions_are_gone(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    day = lambda d: F.lit(d).cast("date").alias("date")
    first = spark.range(3).select("id", day("2024-05-01")).union(spark.range(3, 5).select("id", day("2024-05-02")))
    first = first.union(spark.range(9, 10).select("id", day(None)))
    table = store.overwrite_partitions("t", first, "date")
    moved = table.where("id < 3").withColumn("date", F.lit("2024-05-02").cast("date"))
    store.overwrite_partitions("t", moved, "date", instead_of=table.where("id <> 9"))
    got = rows(store.read("t").select("id", F.col("date").cast("string")))
    assert got == [(0, "2024-05-02"), (1, "2024-05-02"), (2, "2024-05-02"), (9, None)]
    store.overwrite_partitions("t", store.read("t").where("id < 0"), "date", instead_of=store.read("t"))
    assert store.read("t", "id BIGINT, date DATE").count() == 0


def test_a_run_that_moves_to_another_day_is_there_once(spark, tmp_path):
    """The day read again has no such race any more; it lies on the day after."""
    store, names = Store(spark, str(tmp_path / "tables")), {"rating": "theirRating"}
    land_day(tmp_path / "one")
    jobs.daily(store, jobs.Feeds.read(spark, str(tmp_path / "one"), names), NOW)
    land_day(tmp_path / "two")
    land(tmp_path / "two", "calendar", {"date": DAY, "meetings": []}, {"date": "2024-05-02", "meetings": [
        {"venue": "Park", "going": "Good 4", "races": [{"raceId": 1, "number": 5, "prizeMoney": 30000.0}]}]})
    feeds = jobs.Feeds.read(spark, str(tmp_path / "two"), names)
    jobs.daily(store, feeds, NOW, last=dt.date(2024, 5, 2), again=True)
    assert rows(store.read("runners").select("run_id", F.col("date").cast("string"))) == [("11", "2024-05-02"), ("12", "2024-05-02")]


def test_retention_drops_old_prices(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    old = [("a", "r", f"2024-04-{d} {t}", 2.0) for d in ("20", "24") for t in ("01:00:00", "03:00:00")]
    history = points(spark, *old).withColumn("snapshot_date", F.col("snapshot_time").cast("date"))
    store.append("prices", history, ["snapshot_date"])
    now = spark.createDataFrame([("b", "r", 3.0, 0), ("c", "r", 0.5, 0)], "run_id string, race_id string, fixed_win_price double, resulted int")
    jobs.record_prices(store, now.where("fixed_win_price < 1"), NOW)
    assert store.read("prices").count() == 4
    jobs.record_prices(store, now, NOW)
    got = rows(store.read("prices").select("run_id", F.date_format("snapshot_time", "dd HH")))
    assert got == [("a", "24 03"), ("b", "01 02")]


def test_newest_landing_counts(spark, tmp_path):
    import os

    for name, price, runners in (("a", "2.0", [11, 12]), ("b", "3.0", [11])):
        land(tmp_path, "detail", {"raceId": 1, "runners": [{"runId": r, "fixedWinPrice": price} for r in runners]}, name=f"{name}.json")
        os.utime(tmp_path / "detail" / f"{name}.json", (1_000_000_000 + ord(name),) * 2)
    from railbird.operators import flatten

    detail = landing.read_feed(spark, str(tmp_path / "detail"), schemas.DETAIL)
    assert rows(flatten.live_prices(detail)) == [("11", 3.0)]
    assert flatten.detail_runners(detail).count() == 1


def test_two_documents_of_a_race_in_one_file_give_one(spark, tmp_path):
    from railbird.operators import flatten

    def document(price):
        return {"raceId": 1, "runners": [{"runId": 11, "fixedWinPrice": price}]}

    other = {"raceId": 2, "runners": [{"runId": 21, "fixedWinPrice": "5.0"}]}
    land(tmp_path, "detail", document("2.0"), other, document("3.0"))
    (tmp_path / "detail" / "single.json").write_text(json.dumps({"raceId": 3, "runners": [{"runId": 31, "fixedWinPrice": "7.0"}]}))
    (tmp_path / "detail" / "broken.json").write_text('{"raceId": 4, "runners": [')
    detail = landing.read_feed(spark, str(tmp_path / "detail"), schemas.DETAIL)
    assert rows(flatten.live_prices(detail)) == [("11", 3.0), ("21", 5.0), ("31", 7.0)]
    assert flatten.detail_runners(detail).count() == 3
    # nested columns are in no window
    plan = flatten.detail_runners(detail)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join LeftSemi" in plan


def test_exports_name_no_file_in_the_plan(spark, tmp_path):
    from railbird.operators import merge

    for folder, rank in (("a", 1), ("b", 2), ("c", 3)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.csv").write_text(f"ext_date,raceNo,runnerName,aiRank\n2024-05-01,1,Blue,9\n2024-05-01,1,Blue,{rank}\n")
    side = merge.rating_side(landing.load_ratings(spark, str(tmp_path / "*"), csv=True))
    assert rows(side.select("_horse", "ext_ai_rank")) == [("blue", 3)]
    assert "x.csv" not in side._jdf.queryExecution().optimizedPlan().toString()
    runners = [("a", 7), ("b", 8)]
    for folder, barrier in runners:
        (tmp_path / folder / "r.csv").write_text("run_id,race_id,barrier\n" + "".join(f"{i},1,{barrier}\n" for i in (3, 1, 2)))
    got = landing.load_runners(spark, str(tmp_path / "*" / "r.csv"), csv=True)
    assert [(r["run_id"], r["barrier"], r["ingest_seq"]) for r in got.orderBy("row_pos").collect()] == [("3", 8, 0), ("1", 8, 0), ("2", 8, 0)]


def test_unusable_prices_do_not_count(spark):
    given = [("a", "r", "2024-04-06 12:00:00", 0.0), ("a", "r", "2024-04-06 12:01:00", 5.0), ("a", "r", "2024-04-06 12:02:00", None),
             ("a", "r", "2024-04-06 12:03:00", float("nan"))]
    got = prices.open_recent(points(spark, *given)).collect()
    assert [(r["open_price"], r["recent_price"], r["n"]) for r in got] == [(5.0, 5.0, 1)]
    assert [(r["open_price"], r["recent_price"], r["n"]) for r in prices.hourly(points(spark, *given)).collect()] == [(5.0, 5.0, 1)]


def test_the_last_row_of_the_last_file_counts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("run_id,race_id,barrier\n" + "1,1,3\n")
    (tmp_path / "b.csv").write_text("run_id,race_id,barrier\n" + "".join(f"{i},1,4\n" for i in range(1, 5000)) + "1,1,9\n")
    got = landing.load_runners(spark, str(tmp_path / "*.csv"), csv=True)
    assert got.where("run_id = '1'").first()["barrier"] == 9 and got.count() == 4999


def test_places_do_not_collide(spark):
    """More than a thousand runners in a race, and a race after it."""
    from railbird.operators import flatten

    races = [{"raceId": "p", "prizeMoney": None, "runners": [{"runnerId": str(i)} for i in range(1500)]},
             {"raceId": "q", "prizeMoney": "100", "runners": [{"runnerId": "z"}]},
             {"raceId": "r", "prizeMoney": None, "runners": [{"runnerId": "x"}]}]
    text = spark.createDataFrame([(json.dumps({"meetingId": "m", "races": races}),)], "value string")
    meetings = spark.createDataFrame([("m", dt.date(2024, 5, 1))], "meetingId string, date date").withColumn(
        "track", F.struct(F.lit("n").alias("name"), F.lit("s").alias("state"), F.lit("t").alias("surface"))
    )
    got = flatten.field_runners(meetings, landing.parse_feed(text, "value", schemas.FIELDS))
    assert sorted(r["row_pos"] for r in got.select("row_pos").collect()) == [*range(1500), 1501]


def test_envelopes(spark):
    texts = ['{"payLoad":{"a":1},"error":null,"errors":[]}', '{"payLoad":{"a":1},"error":"x"}', '{"a":1}', '[1,2]', '{"payLoad":', '{"error":"kept"}', '{"payLoad":[],"errors":["x"]}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")
    got = [(r["payload"], r["failed"]) for r in landing.payloads(df).orderBy("i").collect()]
    assert got == [('{"a":1}', False), (None, True), ('{"a":1}', False), ("[1,2]", False), (None, True), ('{"error":"kept"}', False), (None, True)]


def test_missing_files_give_empty_tables(spark, tmp_path):
    missing = str(tmp_path / "none")
    assert landing.load_runners(spark, missing).count() == 0 and "wpr_nett" in landing.load_runners(spark, missing, csv=True).columns
    assert landing.load_ratings(spark, missing).count() == 0 and landing.load_prices(spark, missing).count() == 0


def test_csv_exports(spark, tmp_path):
    (tmp_path / "runners.csv").write_text(
        'run_id,race_id,barrier,resulted,going_breakdown,note\n007,1,3.0,,"{""good"": {""starts"": 2, ""wins"": 1, ""places"": 1}}",a\n007,1,4.0,1,{},b\n'
    )
    row = landing.load_runners(spark, str(tmp_path / "runners.csv"), csv=True).collect()
    assert len(row) == 1 and (row[0]["run_id"], row[0]["barrier"], row[0]["resulted"], row[0]["note"]) == ("007", 4, 1, "b")
    (tmp_path / "prices.csv").write_text(
        "run_id,race_id,snapshot_time,fixed_win_price\n1,2,2024-05-01T00:00:00+00:00,3.5\n1,2,never,3.5\n1,2,2024-05-01T00:00:00+00:00,0\n1,2,2024-05-01T00:00:00+00:00,\n"
    )
    assert landing.load_prices(spark, str(tmp_path / "prices.csv"), csv=True).count() == 1


def points(spark, *given):
    df = spark.createDataFrame(list(given), "run_id string, race_id string, t string, fixed_win_price double")
    return df.select("run_id", "race_id", F.to_timestamp("t").alias("snapshot_time"), "fixed_win_price")


def test_streams_over_several_batches_equal_the_batch_result(spark, tmp_path):
    source = str(tmp_path / "updates")
    batches = [
        points(spark, ("a", "r", "2024-04-06 12:10:00", 3.0), ("b", "r", "2024-04-06 13:10:00", 9.0), ("a", "r", "2024-04-06 12:40:00", 3.5)),
        points(spark, ("a", "r", "2024-04-06 12:20:00", 2.5), ("a", "r", "2024-04-06 16:20:00", 2.0), ("b", "r", "2024-04-06 13:10:00", 9.0)),
        points(spark, ("a", "r", "2024-04-06 12:05:00", 4.0), ("b", "r", "2024-04-06 14:00:00", 1.0)),
    ]
    for i, b in enumerate(batches):
        b.coalesce(1).write.mode("append").parquet(source)
    store = Store(spark, str(tmp_path / "tables"))
    everything = spark.read.parquet(source)
    read = lambda: streams.read_updates(spark, source, per_trigger=1)
    streams.to_hours(read(), store, str(tmp_path / "c1")).awaitTermination()
    days = prices.days_from_hours(store.read("price_hours", streams.HOURS))
    columns = ("run_id", "local_date", "open_price", "open_time", "recent_price", "recent_time", "n")
    assert rows(days.select(*columns)) == rows(prices.open_recent(everything).select(*columns))
    streams.to_current(read(), store, str(tmp_path / "c2")).awaitTermination()
    assert rows(streams.current_prices(store).select("run_id", "fixed_win_price")) == [("a", 2.0), ("b", 9.0)]
    streams.to_history(streams.without_repeats(read()), store, str(tmp_path / "c3")).awaitTermination()
    assert store.read("prices").count() == 6
    # started again with nothing new, nothing changes
    streams.to_history(streams.without_repeats(read()), store, str(tmp_path / "c3")).awaitTermination()
    assert store.read("prices").count() == 6


def test_gate(spark):
    races = points(spark, ("x", "r", "2024-04-06 12:00:00", 1.0)).select("race_id", F.col("snapshot_time").alias("start"))
    given = [("a", "r", f"2024-04-06 {t}", 2.0) for t in ("09:59:59", "10:00:00", "12:30:00", "12:30:01")] + [("a", "q", "2024-04-06 12:00:00", 2.0)]
    got = streams.gate(points(spark, *given), races)
    assert rows(got.select(F.date_format("snapshot_time", "HH:mm:ss"))) == [("10:00:00",), ("12:30:00",)]
