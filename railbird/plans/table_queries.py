"""Queries over whole tables: maintenance, joins, result and price updates, price history."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railbird.functions.scalars import half_even
from railbird.operators import merge, prices, tables
from railbird.plans import star
from railbird.plans.catalog import query, rounded, with_runners
from railbird.plans.star import TIE
from railbird.sources.schemas import conform

# The day the star schema's jobs run on.
AS_OF = dt.datetime(2001, 7, 25, 12, 30)
AS_OF_SQL = "TIMESTAMP '2001-07-25 12:30:00'"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"),
        F.col("event_type").alias("race_id"),
        F.col("ts").cast("timestamp").alias("snapshot_time"),
        F.col("value").alias("fixed_win_price"),
        F.col("event_id").alias("ingest_seq"),
    )


EVENTS_SQL = (
    "prices AS (SELECT CAST(user_id AS STRING) AS run_id, event_type AS race_id, ts AS snapshot_time, "
    "value AS fixed_win_price, event_id FROM events)"
)


@query(
    "keep_last",
    f"""WITH {EVENTS_SQL} SELECT run_id, race_id, fixed_win_price FROM (SELECT *, row_number() OVER
      (PARTITION BY run_id, race_id ORDER BY snapshot_time DESC, event_id DESC) AS n FROM prices) WHERE n = 1""",
)
def keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = tables.keep_last(events(spark, sf_dir), ["run_id", "race_id"], ["snapshot_time", "ingest_seq"])
    return kept.select("run_id", "race_id", "fixed_win_price")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.table(spark, sf_dir, "orders").select(
        F.expr("nullif(o_custkey, 7)").alias("cust"),
        F.col("o_orderpriority").alias("prio"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderkey").alias("ingest_seq"),
        F.lit(0).alias("row_pos"),
        F.col("o_totalprice").alias("price"),
    )


ORDERS_SQL = "o AS (SELECT nullif(o_custkey, 7) AS cust, o_orderpriority AS prio, o_orderstatus AS status, o_orderkey AS k, o_totalprice AS price FROM orders)"


@query(
    "insert_only",
    f"""WITH {ORDERS_SQL}, fresh AS (SELECT cust, prio, price, status AS note, row_number() OVER (PARTITION BY cust, prio ORDER BY k) AS n
          FROM o WHERE status <> 'F')
      SELECT cust, prio, price, CAST(NULL AS STRING) AS note FROM o WHERE status = 'F'
      UNION ALL SELECT cust, prio, price, note FROM fresh f WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM o e
        WHERE e.status = 'F' AND e.cust IS NOT DISTINCT FROM f.cust AND e.prio IS NOT DISTINCT FROM f.prio)""",
)
def insert_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New keys added to a table that lacks one of the incoming columns; NULL is a key like any other."""
    orders = _orders(spark, sf_dir)
    existing = orders.where("status = 'F'").drop("status")
    incoming = orders.where("status <> 'F'").withColumnRenamed("status", "note")
    return tables.insert_only(existing, incoming, ["cust", "prio"]).select("cust", "prio", "price", "note")


@query(
    "upsert",
    f"""WITH {ORDERS_SQL} SELECT cust, prio, price FROM (SELECT *, row_number() OVER (PARTITION BY cust, prio
      ORDER BY status = 'F' DESC, status = 'P' DESC, k DESC) AS n FROM o) WHERE n = 1""",
)
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished rows win over others, then incoming ones over existing ones, then the latest."""
    orders = _orders(spark, sf_dir)
    existing, incoming = orders.where("status <> 'P'"), orders.where("status = 'P'")
    merged = tables.upsert(existing, incoming, ["cust", "prio"], tables.ROW_ORDER, prefer=F.col("status") == "F")
    return merged.select("cust", "prio", "price")


@query(
    "remove_evaluated",
    "SELECT l_orderkey AS race_id, count(*) AS picks FROM lineitem WHERE l_orderkey NOT IN "
    "(SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY l_orderkey",
)
def remove_evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = star.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("race_id"))
    evaluated = star.table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("race_id"))
    return tables.remove_evaluated(old, evaluated).groupBy("race_id").agg(F.count("*").alias("picks"))


@query(
    "drop_pending",
    with_runners(
        select="""SELECT race_id, run_id, date FROM runners WHERE NOT (date = DATE '2001-07-25' AND coalesce(resulted, 0) <> 1)"""
    ),
)
def drop_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table before a day is read again: that day's pending rows are gone."""
    return tables.drop_pending(star.runners(spark, sf_dir), AS_OF.date()).select("race_id", "run_id", "date")


@query(
    "days_to_load",
    """SELECT d AS date FROM (SELECT CAST(unnest(generate_series(DATE '2001-07-20', DATE '2001-08-10', INTERVAL 1 DAY)) AS DATE) AS d)
      WHERE d NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)""",
)
def days_to_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a backfill range that the table does not have yet."""
    have = star.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    return tables.days_to_load(have, dt.date(2001, 7, 20), dt.date(2001, 8, 10))


@query(
    "conform_runners",
    with_runners(
        select="SELECT CAST(race_id AS STRING) AS race_id, run_id, date, going, wpr_rank, rating, ext_ai_rank, "
        "CAST(NULL AS BOOLEAN) AS ext_reliable, CAST(NULL AS BOOLEAN) AS has_first_starter, ln, pk, sk FROM runners"
    ),
)
def conform_runners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runner schema fitted to a table read as text: ids stay text, the rest is cast, gaps are NULL."""
    from railbird.sources.schemas import RUNNERS

    rows = star.runners(spark, sf_dir)
    text = rows.select(*[F.col(c).cast("string").alias(c) if c not in TIE else F.col(c) for c in rows.columns])
    return conform(text, RUNNERS).select(
        "race_id", "run_id", "date", "going", "wpr_rank", "rating", "ext_ai_rank", "ext_reliable", "has_first_starter", *TIE
    )


# A second provider's rating per line, under padded names in capitals; those of returned lines are of another horse.
RATING = {
    "ext_date": "CAST(o_orderdate AS DATE)",
    "raceNo": "CAST(o_custkey % 12 + 1 AS INT)",
    "runnerName": "concat(' ', upper(p_name), CASE WHEN l_returnflag = 'R' OR l_tax <= 0.02 THEN ' II' ELSE '  ' END)",
    "aiRank": "CAST(l_suppkey % 9 AS INT)",
    "aiPrice": "l_extendedprice / 100",
    "aiScore": "l_quantity",
    "weightClassRank": "CAST(l_partkey % 9 AS INT)",
    "timeRank": "CAST(l_linenumber AS INT)",
    "runStyle": "concat(l_returnflag, '      ')",
    "classChange": "l_tax",
    "isReliable": "l_quantity > 20",
    "ok": "l_orderkey",
    "ln": "l_linenumber",
    "pk": "l_partkey",
    "sk": "l_suppkey",
}
RATINGS_SQL = f"ratings AS (SELECT {star.sql_columns(RATING)} FROM {star.RUNNER_FROM})"
RATING_ORDER = ("ok", "ln", "pk", "sk")


def _ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders, parts = (star.table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    joined = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(parts, F.col("p_partkey") == F.col("l_partkey"))
    return joined.select(*star.columns(RATING))


_KEYED = "lower(trim(runnerName)) AS horse_key, ext_date, raceNo"


@query(
    "ratings_join",
    with_runners(
        RATINGS_SQL,
        f"last AS (SELECT * FROM (SELECT *, {_KEYED.split(',')[0]}, row_number() OVER (PARTITION BY ext_date, raceNo, lower(trim(runnerName)) "
        "ORDER BY ok DESC, ln DESC, pk DESC, sk DESC) AS n FROM ratings) WHERE n = 1)",
        select="""SELECT r.race_id, r.run_id, horse, aiRank AS ext_ai_rank, aiPrice AS ext_ai_price, weightClassRank AS ext_class_rank,
          CAST(NULL AS INT) AS ext_last600_rank, trim(runStyle) AS ext_run_style, isReliable AS ext_reliable
          FROM runners r LEFT JOIN last ON ext_date = date AND raceNo = race AND horse_key = lower(trim(horse))""",
    ),
)
def ratings_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings brought to the runners by day, race and horse; earlier values are replaced, also by NULL."""
    ratings = _ratings(spark, sf_dir)
    joined = merge.join_ratings(star.runners(spark, sf_dir), ratings, RATING_ORDER)
    return joined.select(
        "race_id", "run_id", "horse", "ext_ai_rank", "ext_ai_price", "ext_class_rank",
        F.col("ext_last600_rank").cast("int"), "ext_run_style", "ext_reliable",
    )


@query(
    "rating_match_stats",
    with_runners(
        RATINGS_SQL,
        "keys AS (SELECT ext_date, raceNo, lower(trim(runnerName)) AS h, count(*) AS c FROM ratings GROUP BY ALL)",
        select=f"""SELECT count(*) AS runners, count(c) AS matched, {rounded('count(c) / count(*)', 4)} AS match_rate,
          (SELECT CAST(sum(c - 1) AS BIGINT) FROM keys) AS collisions
          FROM runners LEFT JOIN keys ON ext_date = date AND raceNo = race AND h = lower(trim(horse))""",
    ),
)
def rating_match_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    runners, ratings = star.runners(spark, sf_dir), _ratings(spark, sf_dir)
    joined = merge.join_ratings(runners, ratings, RATING_ORDER)
    stats = merge.rating_match_stats(runners, ratings, joined)
    return stats.withColumn("match_rate", half_even("match_rate", 4))


# Results of the lines with status F, except every fourth one, of orders whose customer key is even.
RESULTS_SQL = (
    "results AS (SELECT race_id, run_id, ln AS finish, ln, pk, sk, rating / 500 AS sp, rating / 400 AS top FROM runners "
    "JOIN orders ON o_orderkey = race_id WHERE o_custkey % 2 = 0 AND finish_position IS NOT NULL AND sk % 4 <> 0)"
)
PENDING = {"finish_position": "int", "starting_price_sp": "double", "price_top": "double", "won": "int", "placed": "int"}


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = star.table(spark, sf_dir, "orders").where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("race_id"))
    return (
        star.runners(spark, sf_dir)
        .join(even, "race_id")
        .where("finish_position IS NOT NULL AND sk % 4 <> 0")
        .select("race_id", "run_id", F.col("ln").alias("finish"), (F.col("rating") / 500).alias("sp"),
                (F.col("rating") / 400).alias("top"), *TIE)
    )


@query(
    "apply_results",
    with_runners(
        RESULTS_SQL,
        "done AS (SELECT DISTINCT race_id FROM results)",
        select="""SELECT r.race_id, r.run_id, finish AS finish_position, sp AS starting_price_sp, s.top AS price_top,
          CASE WHEN finish IS NOT NULL THEN CASE WHEN finish = 1 THEN 1 ELSE 0 END END AS won,
          CASE WHEN finish IS NOT NULL THEN CASE WHEN finish <= 3 THEN 1 ELSE 0 END END AS placed,
          CASE WHEN d.race_id IS NOT NULL THEN 1 ELSE 0 END AS resulted
          FROM runners r LEFT JOIN results s USING (race_id, run_id) LEFT JOIN done d ON d.race_id = r.race_id""",
    ),
)
def apply_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results brought to runners without any; scratched runners of resulted races are marked only."""
    runners = star.runners(spark, sf_dir).withColumns(
        {**{c: F.lit(None).cast(t) for c, t in PENDING.items()}, "resulted": F.lit(0)}
    )
    out = merge.apply_results(runners, _results(spark, sf_dir), TIE)
    return out.select("race_id", "run_id", *PENDING, "resulted")


STATUS_SQL = f"""
  firsts AS (SELECT race_id, date, start_time, row_number() OVER (PARTITION BY race_id ORDER BY ln, pk, sk) AS n,
      bool_or(coalesce(resulted, 0) <> 1) OVER (PARTITION BY race_id) AS pending FROM runners),
  statuses AS (SELECT race_id, CASE WHEN date > DATE '2001-07-25' THEN 'future' WHEN date < DATE '2001-07-11' THEN 'old'
      WHEN date = DATE '2001-07-25' AND CAST(concat(date, ' ', start_time, ':00') AS TIMESTAMP) > {AS_OF_SQL} - INTERVAL 5 MINUTE
      THEN 'future' ELSE 'due' END AS status FROM firsts WHERE n = 1 AND pending)"""


@query("result_races", with_runners(STATUS_SQL, select="SELECT race_id, status FROM statuses"))
def result_races(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.result_races(star.runners(spark, sf_dir), AS_OF, TIE)


@query(
    "result_stats",
    with_runners(
        STATUS_SQL, RESULTS_SQL,
        select="""SELECT (SELECT count(*) FROM results) AS updated, count(*) FILTER (WHERE status = 'due') AS due,
          count(*) FILTER (WHERE status = 'future') AS skipped_future, count(*) FILTER (WHERE status = 'old') AS skipped_old FROM statuses""",
    ),
)
def result_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    runners = star.runners(spark, sf_dir)
    return merge.result_stats(runners, _results(spark, sf_dir), merge.result_races(runners, AS_OF, TIE))


@query(
    "upcoming_races",
    with_runners(
        f"""known AS (SELECT race_id, CAST(concat(date, ' ', start_time, ':00') AS TIMESTAMP) AS start,
             row_number() OVER (PARTITION BY race_id ORDER BY ln, pk, sk) AS n FROM runners
             WHERE coalesce(resulted, 0) <> 1 AND start_time IS NOT NULL)""",
        select=f"""SELECT race_id, CAST(epoch(start) AS BIGINT) AS start FROM known WHERE n = 1
          AND start BETWEEN {AS_OF_SQL} - INTERVAL 30 MINUTE AND {AS_OF_SQL} + INTERVAL 72 HOUR""",
    ),
)
def upcoming_races(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending races of the next three days."""
    races = merge.upcoming_races(star.runners(spark, sf_dir), AS_OF, 72.0, TIE)
    return races.select("race_id", F.col("start").cast("bigint").alias("start"))


UPDATES_SQL = (
    "updates AS (SELECT CASE WHEN CAST(run_id AS INT) % 7 = 0 THEN concat('x', run_id) ELSE run_id END AS run_id, fixed_win_price AS price "
    "FROM (SELECT *, row_number() OVER (PARTITION BY run_id "
    "ORDER BY snapshot_time DESC, event_id DESC) AS n FROM prices WHERE fixed_win_price > 1) WHERE n = 1)"
)
QUOTED_SQL = (
    "quoted AS (SELECT CAST(c_custkey AS STRING) AS run_id, CASE WHEN c_custkey % 5 = 0 THEN NULL "
    "WHEN c_custkey % 3 = 0 THEN coalesce(price, 2) + 0.0005 ELSE c_acctbal / 100 END AS fixed_win_price "
    "FROM customer LEFT JOIN updates ON run_id = CAST(c_custkey AS STRING))"
)


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = events(spark, sf_dir).where("fixed_win_price > 1")
    last = tables.keep_last(usable, ["run_id"], ["snapshot_time", "ingest_seq"])
    # every seventh is of a run that no table knows
    run = F.expr("CASE WHEN CAST(run_id AS INT) % 7 = 0 THEN concat('x', run_id) ELSE run_id END")
    return last.select(run.alias("run_id"), F.col("fixed_win_price").alias("price"))


def _quoted(spark: SparkSession, sf_dir: str, updates: DataFrame) -> DataFrame:
    customers = star.table(spark, sf_dir, "customer")
    keyed = customers.select(F.col("c_custkey").cast("string").alias("run_id"), "c_custkey", "c_acctbal")
    return keyed.join(updates, "run_id", "left").select(
        "run_id",
        F.expr(
            "CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN coalesce(price, 2) + 0.0005 ELSE c_acctbal / 100 END"
        ).alias("fixed_win_price"),
    )


@query(
    "apply_prices",
    f"""WITH {EVENTS_SQL}, {UPDATES_SQL}, {QUOTED_SQL} SELECT run_id, {rounded('coalesce(price, fixed_win_price)', 4)} AS fixed_win_price,
      price IS NOT NULL AND (fixed_win_price IS NULL OR abs(fixed_win_price - price) > 0.001) AS changed
      FROM quoted LEFT JOIN updates USING (run_id)""",
)
def apply_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last price of each user's events brought to the customers."""
    updates = _updates(spark, sf_dir)
    out = merge.apply_prices(_quoted(spark, sf_dir, updates), updates, changed="changed")
    return out.withColumn("fixed_win_price", half_even("fixed_win_price", 4))


@query(
    "price_stats",
    f"""WITH {EVENTS_SQL}, {UPDATES_SQL}, {QUOTED_SQL} SELECT count(*) AS updates, count(*) FILTER (WHERE q.run_id IS NOT NULL
      AND (fixed_win_price IS NULL OR abs(fixed_win_price - price) > 0.001)) AS changed FROM updates LEFT JOIN quoted q USING (run_id)""",
)
def price_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = _updates(spark, sf_dir)
    return merge.price_stats(_quoted(spark, sf_dir, updates), updates)


@query(
    "price_snapshot",
    with_runners(
        select="SELECT run_id, race_id, fixed_win_price FROM runners WHERE coalesce(resulted, 0) <> 1 AND fixed_win_price > 1"
    ),
)
def price_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.snapshot(star.runners(spark, sf_dir), AS_OF).select("run_id", "race_id", "fixed_win_price")


@query(
    "price_retention",
    f"WITH {EVENTS_SQL} SELECT run_id, race_id, fixed_win_price FROM prices "
    "WHERE snapshot_time >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 7 DAY",
)
def price_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = tables.retain(events(spark, sf_dir), "snapshot_time", dt.datetime(2024, 1, 20, 12), prices.KEEP_DAYS)
    return kept.select("run_id", "race_id", "fixed_win_price")


# some prices are missing, zero or no number
MESSY = "CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 0 WHEN event_id % 23 = 0 THEN {nan} ELSE value END"


def messy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.expr(MESSY.format(nan="double('NaN')"))
    raw = star.table(spark, sf_dir, "events").withColumn("value", price)
    return raw.select(
        F.col("user_id").cast("string").alias("run_id"),
        F.col("ts").cast("timestamp").alias("snapshot_time"),
        F.col("value").alias("fixed_win_price"),
    )


# the data lies in January, when Melbourne is eleven hours ahead
OPEN_SQL = f"""
  messy AS (SELECT CAST(user_id AS STRING) AS run_id, ts AS snapshot_time, {MESSY.format(nan="'NaN'::DOUBLE")} AS fixed_win_price FROM events),
  days AS (SELECT *, CAST(snapshot_time + INTERVAL 11 HOUR AS DATE) AS local_date FROM messy
      WHERE fixed_win_price > 0 AND NOT isnan(fixed_win_price) AND snapshot_time IS NOT NULL),
  opened AS (SELECT run_id, local_date, arg_min(fixed_win_price, snapshot_time) AS open_price, epoch_us(min(snapshot_time)) AS open_us,
      arg_max(fixed_win_price, snapshot_time) AS recent_price, epoch_us(max(snapshot_time)) AS recent_us, count(*) AS n
      FROM days GROUP BY run_id, local_date)"""


def days_flat(df: DataFrame) -> DataFrame:
    return df.select(
        "run_id", "local_date", "open_price", F.unix_micros("open_time").alias("open_us"), "recent_price",
        F.unix_micros("recent_time").alias("recent_us"), "n",
    )


@query("price_open_recent", f"WITH {EVENTS_SQL}, {OPEN_SQL} SELECT * FROM opened")
def price_open_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return days_flat(prices.open_recent(messy_events(spark, sf_dir)))


@query("price_days_from_hours", f"WITH {EVENTS_SQL}, {OPEN_SQL} SELECT * FROM opened")
def price_days_from_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by way of hourly partial sums, as the stream keeps them."""
    return days_flat(prices.days_from_hours(prices.hourly(messy_events(spark, sf_dir))))


@query(
    "price_attach",
    f"""WITH {EVENTS_SQL}, {OPEN_SQL} SELECT CAST(c_custkey AS STRING) AS run_id, open_price, recent_price, n AS price_points
      FROM customer LEFT JOIN opened ON run_id = CAST(c_custkey AS STRING) AND local_date = DATE '2024-01-16'""",
)
def price_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One day's open and latest price beside every runner."""
    runners = star.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("run_id"))
    opened = prices.open_recent(messy_events(spark, sf_dir))
    out = prices.attach_prices(runners, opened, dt.date(2024, 1, 16))
    return out.select("run_id", "open_price", "recent_price", "price_points")
