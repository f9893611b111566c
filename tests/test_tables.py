import datetime as dt

from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import rows
from railbird.operators import tables
from railbird.sources.schemas import conform
from railbird.sources.store import Store

DDL = "k string, v string, ingest_seq bigint, row_pos int"


def test_keep_last_goes_by_batch_then_position(spark):
    df = spark.createDataFrame([("a", "old", 1, 9), ("a", "new", 2, 0), ("a", "newest", 2, 1), (None, "x", 1, 0), (None, "y", 1, 1)], DDL)
    assert rows(tables.keep_last(df, ["k"]).select("k", "v")) == [("a", "newest"), (None, "y")]


def test_insert_only(spark):
    old = spark.createDataFrame([("a", "old", 1, 0), (None, "none", 1, 1)], DDL)
    new = spark.createDataFrame(
        [("a", "ignored", 2, 0, 1), ("b", "first", 2, 1, 2), ("b", "second", 2, 2, 3), (None, "ignored", 2, 3, 4)], DDL + ", extra int"
    )
    once = tables.insert_only(old, new, ["k"])
    assert once.columns == ["k", "v", "ingest_seq", "row_pos", "extra"]
    want = [("a", "old", None), ("b", "first", 2), (None, "none", None)]
    assert rows(once.select("k", "v", "extra")) == want
    # a second time changes nothing
    assert rows(tables.insert_only(once, new, ["k"]).select("k", "v", "extra")) == want


def test_upsert_and_preference(spark):
    ddl = "k string, v string, resulted int"
    old = spark.createDataFrame([("a", "done", 1), ("b", "pending", 0), ("c", "kept", None)], ddl)
    new = spark.createDataFrame([("a", "fresh", 0), ("b", "fresh", 0)], ddl)
    assert rows(tables.upsert(old, new, ["k"]).select("k", "v")) == [("a", "fresh"), ("b", "fresh"), ("c", "kept")]
    merged = tables.upsert(old, new, ["k"], prefer=F.col("resulted") == 1)
    assert rows(merged.select("k", "v")) == [("a", "done"), ("b", "fresh"), ("c", "kept")]
    assert rows(tables.upsert(merged, new, ["k"], prefer=F.col("resulted") == 1)) == rows(merged)


def test_race_that_no_longer_qualifies_loses_its_picks(spark):
    picks = spark.createDataFrame([("r1", "x"), ("r2", "y")], "race_id string, run_id string")
    evaluated = spark.createDataFrame([("r1",), ("r1",), ("r3",)], "race_id string")
    assert rows(tables.remove_evaluated(picks, evaluated)) == [("r2", "y")]


def test_drop_pending_keeps_results_and_other_days(spark):
    day, other = dt.date(2024, 5, 1), dt.date(2024, 5, 2)
    df = spark.createDataFrame([(day, 1, "a"), (day, 0, "b"), (day, None, "c"), (other, 0, "d"), (None, 0, "e")], "date date, resulted int, r string")
    assert rows(tables.drop_pending(df, day).select("r")) == [("a",), ("d",), ("e",)]


def test_days_to_load(spark):
    have = spark.createDataFrame([(dt.date(2024, 5, 2),)], "date date")
    first, last = dt.date(2024, 5, 1), dt.date(2024, 5, 3)
    assert [r[0].day for r in tables.days_to_load(have, first, last).collect()] == [1, 3]
    assert [r[0].day for r in tables.days_to_load(have, first, last, again=True).collect()] == [1, 2, 3]


def test_retain_is_inclusive(spark):
    now = dt.datetime(2024, 5, 8, 12)
    times = [now - dt.timedelta(days=7), now - dt.timedelta(days=7, seconds=1), now]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp")
    assert tables.retain(df, "t", now).count() == 2


def test_conform_orders_casts_and_keeps_extras(spark):
    df = spark.createDataFrame([("7.0", float("nan"), "x", '{"good":{"starts":1}}')], "n string, d double, more string, m string")
    out = conform(df, "d DOUBLE, n INT, missing DATE, m MAP<STRING, STRUCT<starts: INT>>")
    assert out.columns == ["d", "n", "missing", "m", "more"]
    row = out.first()
    assert row["d"] is None and row["n"] == 7 and row["missing"] is None and row["m"]["good"]["starts"] == 1
    assert conform(df, "n INT", keep_extras=False).columns == ["n"]


def test_store_replaces_without_overwriting(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.current("t", "a INT").count() == 0
    first = store.replace("t", spark.createDataFrame([(1,)], "a int"))
    # the new version is made from the old one, and readers of that one still can
    second = store.replace("t", first.union(spark.createDataFrame([(2,)], "a int")))
    assert rows(first) == [(1,)] and rows(second) == [(1,), (2,)] == rows(store.current("t", "a INT"))


def test_store_overwrites_only_touched_partitions_of_a_table_it_reads(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "p int, v string")
    table = store.overwrite_partitions("t", df, ["p"])
    table = store.overwrite_partitions("t", table.where("p = 2").withColumn("v", F.upper("v")), ["p"])
    assert rows(table.select("p", "v")) == [(1, "a"), (2, "B")]
    store.append("d", df.drop("v"), ())
    store.append("d", df, ())
    assert rows(store.read("d").select("p", "v")) == [(1, "a"), (1, None), (2, "b"), (2, None)]


def test_documents_of_a_file_in_one_piece_are_dealt_to_all_tasks(spark, tmp_path):
    from railbird.plans import feed_queries

    spark.range(40).selectExpr("id AS p_partkey", "CAST(id % 9 AS INT) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    docs = feed_queries.documents(spark, str(tmp_path), "part", "named_struct('k', p_partkey)", "p_size AS n")
    assert docs.rdd.getNumPartitions() == 4
    assert sorted((r["n"], r["value"]) for r in docs.collect()) == sorted((i % 9, f'{{"k":{i}}}') for i in range(40))


def test_a_filter_on_a_document_does_not_parse_it_again(spark):
    from railbird.sources import landing

    docs = spark.range(3).selectExpr("to_json(named_struct('raceId', id, 'runners', array(id, id + 1))) AS value")
    feed = landing.parse_feed(docs, "value", "raceId BIGINT, runners ARRAY<BIGINT>")
    found = feed.select("raceId", F.explode("runners").alias("r")).where("raceId > 0")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
    assert rows(found) == [(1, 1), (1, 2), (2, 2), (2, 3)]


def _planned(spark, name, folder):
    return entry.queries()[name](spark, str(folder))._jdf.queryExecution().executedPlan().toString()


def test_no_document_of_a_race_is_sent_to_the_driver(spark, tmp_path):
    spark.range(40).selectExpr(
        "id AS o_orderkey", "id AS o_custkey", "'O' AS o_orderstatus", "1e6D AS o_totalprice", "TIMESTAMP '1996-01-01' AS o_orderdate",
        "'1-URGENT' AS o_orderpriority",
    ).write.parquet(f"{tmp_path}/orders.parquet")
    plan = _planned(spark, "runner_rows", tmp_path)
    # the files are small, what is parsed from them is not
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_no_fields_of_a_meeting_are_sent_to_the_driver(spark, tmp_path):
    spark.range(40).selectExpr(
        "id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type", "CAST(id AS INT) AS p_size", "900.0D AS p_retailprice"
    ).write.parquet(f"{tmp_path}/part.parquet")
    plan = _planned(spark, "field_runners", tmp_path)
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
