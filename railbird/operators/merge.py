"""Joins that bring ratings, results and prices to the runners, and the races due for them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railbird.functions.scalars import null_if_nan, number, start_instant, whole
from railbird.operators.groups import attach
from railbird.operators.tables import ROW_ORDER, is_pending, keep_last
from railbird.sources.schemas import RATING_COLUMNS

# How far back results are still asked for, and how long after the start at the earliest.
RESULT_DAYS = 14
RESULT_DELAY = dt.timedelta(minutes=5)
JUST_RUN = dt.timedelta(minutes=30)
LOOKAHEAD_HOURS = 2.0
PRICE_MOVED = 0.001


def horse_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def rating_side(ratings: DataFrame, order: Sequence[str | Column] = ROW_ORDER) -> DataFrame:
    """One rating per day, race number and horse: the last in ``order``. Missing columns are NULL."""
    have = set(ratings.columns)
    columns = [
        (F.col(theirs) if theirs in have else F.lit(None)).alias(ours) for theirs, ours in RATING_COLUMNS.items()
    ]
    positions = [c for c in order if isinstance(c, str)]
    side = ratings.select(
        F.col("ext_date").try_cast("date").alias("_date"),
        whole("raceNo").alias("_race"),
        horse_key(F.col("runnerName")).alias("_horse"),
        *columns,
        *positions,
    ).withColumn("ext_run_style", F.trim(F.col("ext_run_style").cast("string")))
    # a rating without a full key can match no runner
    side = side.where(F.col("_date").isNotNull() & F.col("_race").isNotNull() & F.col("_horse").isNotNull())
    return keep_last(side, ["_date", "_race", "_horse"], order).drop(*positions)


def join_ratings(runners: DataFrame, ratings: DataFrame, order: Sequence[str | Column] = ROW_ORDER) -> DataFrame:
    """Bring the second provider's ratings to the runners by day, race number and horse.

    The venue is no part of the key: the providers name tracks differently. Rating columns the
    runners already have are replaced, by NULL where there is no match.
    """
    base = runners.drop(*RATING_COLUMNS.values()).withColumns(
        {"_date": F.col("date").cast("date"), "_race": whole("race"), "_horse": horse_key(F.col("horse"))}
    )
    return base.join(rating_side(ratings, order), ["_date", "_race", "_horse"], "left").drop("_date", "_race", "_horse")


def rating_match_stats(runners: DataFrame, ratings: DataFrame, joined: DataFrame) -> DataFrame:
    """One row: runners, runners with a rating, the share of them, and ratings sharing a key."""
    keyed = ratings.select(
        F.col("ext_date").try_cast("date").alias("d"), whole("raceNo").alias("r"), horse_key(F.col("runnerName")).alias("h")
    )
    per_key = keyed.groupBy("d", "r", "h").agg((F.count("*") - 1).alias("extra"))
    collisions = per_key.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("collisions"))
    matched = joined.agg(F.count("*").alias("runners"), F.count("ext_ai_rank").alias("matched"))
    rate = F.col("matched") / F.nullif(F.col("runners"), F.lit(0))
    # both sides are single rows
    return matched.withColumn("match_rate", rate).withColumn("_one", F.lit(1)).join(
        collisions.withColumn("_one", F.lit(1)), "_one"
    ).drop("_one")


def apply_results(runners: DataFrame, results: DataFrame, order: Sequence[str] = ("row_pos",)) -> DataFrame:
    """Bring finishes and prices to the runners of races that have results.

    ``results`` has one row per finished runner (``result_rows``). A runner of such a race that is
    not among them was scratched: it is marked resulted and nothing else. Other races stay.
    """
    last = keep_last(results, ["race_id", "run_id"], list(order)).select(
        "race_id",
        "run_id",
        F.col("finish").alias("_finish"),
        F.col("sp").alias("_sp"),
        F.col("top").alias("_top"),
    )
    done = results.select("race_id").distinct().withColumn("_done", F.lit(True))
    joined = runners.join(done, "race_id", "left").join(last, ["race_id", "run_id"], "left")
    found = F.col("_finish").isNotNull()
    updates = {
        "finish_position": F.when(found, F.col("_finish")).otherwise(F.col("finish_position")),
        "starting_price_sp": F.when(found, F.col("_sp")).otherwise(F.col("starting_price_sp")),
        "price_top": F.when(found, F.col("_top")).otherwise(F.col("price_top")),
        "won": F.when(found, (F.col("_finish") == 1).cast("int")).otherwise(F.col("won")),
        "placed": F.when(found, (F.col("_finish") <= 3).cast("int")).otherwise(F.col("placed")),
        "resulted": F.when(F.col("_done"), F.lit(1)).otherwise(F.col("resulted")),
    }
    return joined.select(*[updates[c].alias(c) if c in updates else F.col(c) for c in runners.columns])


def result_stats(before: DataFrame, results: DataFrame, eligible: DataFrame) -> DataFrame:
    """One row: runners given a finish, and races asked for, not yet run, and too old."""
    last = results.select("race_id", "run_id").distinct()
    updated = before.join(last, ["race_id", "run_id"], "left_semi").agg(F.count("*").alias("updated"))
    races = eligible.agg(
        F.count_if(F.col("status") == "due").alias("due"),
        F.count_if(F.col("status") == "future").alias("skipped_future"),
        F.count_if(F.col("status") == "old").alias("skipped_old"),
    )
    return updated.withColumn("_one", F.lit(1)).join(races.withColumn("_one", F.lit(1)), "_one").drop("_one")


def price_moved(old: Column, new: Column) -> Column:
    return new.isNotNull() & (null_if_nan(old).isNull() | (F.abs(old - new) > PRICE_MOVED))


def apply_prices(
    runners: DataFrame, prices: DataFrame, run: str = "run_id", price: str = "fixed_win_price", changed: str | None = None
) -> DataFrame:
    """Replace the win price of runners with an update (``run_id``, ``price``, one row per run).

    Updates of unknown runs are ignored. ``changed`` names a flag for prices that moved.
    """
    updates = prices.select(F.col("run_id").alias(run), F.col("price").cast("double").alias("_new"))
    joined = runners.join(updates, run, "left")
    flag = [price_moved(F.col(price), F.col("_new")).alias(changed)] if changed else []
    return joined.select(
        *[F.coalesce("_new", price).alias(price) if c == price else F.col(c) for c in runners.columns], *flag
    )


def price_stats(runners: DataFrame, prices: DataFrame, run: str = "run_id", price: str = "fixed_win_price") -> DataFrame:
    """One row: updates received, and those that moved a known runner's price."""
    known = prices.join(runners.select(F.col(run).alias("run_id"), F.col(price).alias("_old")), "run_id", "left")
    seen = runners.select(F.col(run).alias("run_id"), F.lit(True).alias("_seen"))
    known = known.join(seen.distinct(), "run_id", "left")
    moved = F.coalesce(F.col("_seen"), F.lit(False)) & price_moved(F.col("_old"), F.col("price"))
    return known.agg(F.count("*").alias("updates"), F.count_if(moved).alias("changed"))


def result_races(
    runners: DataFrame, as_of: dt.datetime, tie: Sequence[str] = ROW_ORDER
) -> DataFrame:
    """The pending races and whether their results are due: ``due``, ``future`` or ``old``.

    A race's day and start are those of its first row. A race of the day is due five minutes after
    its start; one whose day or start is not known is due at once.
    """
    first = runners.where(F.col("race_id").isNotNull()).groupBy("race_id").agg(
        F.min_by(F.struct("date", "start_time"), F.struct(*tie)).alias("_f"),
        F.max(is_pending()).alias("_pending"),
    )
    day, today = F.col("_f.date"), F.lit(as_of.date())
    start = start_instant(F.col("_f.start_time"), day)
    status = (
        F.when(day > today, F.lit("future"))
        .when(day < F.date_sub(today, RESULT_DAYS), F.lit("old"))
        .when((day == today) & (start > F.lit(as_of - RESULT_DELAY)), F.lit("future"))
        .otherwise(F.lit("due"))
    )
    return first.where("_pending").select("race_id", status.alias("status"))


def upcoming_races(
    runners: DataFrame, as_of: dt.datetime, lookahead_hours: float = LOOKAHEAD_HOURS, tie: Sequence[str] = ROW_ORDER
) -> DataFrame:
    """Pending races that start within the look-ahead, or did so in the last half hour: (race_id, start)."""
    known = F.col("start_time").isNotNull()
    first = runners.where(is_pending()).groupBy("race_id").agg(
        F.min_by(F.struct("start_time", "date"), F.when(known, F.struct(*tie))).alias("_f")
    )
    races = first.select("race_id", start_instant(F.col("_f.start_time"), F.col("_f.date")).alias("start"))
    return races.where(in_window(F.col("start"), as_of, lookahead_hours))


def in_window(start: Column, as_of: dt.datetime, lookahead_hours: float = LOOKAHEAD_HOURS) -> Column:
    return start.between(F.lit(as_of - JUST_RUN), F.lit(as_of + dt.timedelta(hours=lookahead_hours)))


def days_in_window(as_of: dt.datetime, lookahead_hours: float = LOOKAHEAD_HOURS, day: str = "date") -> Column:
    """The days a race that starts in the window can be of: those of the window in any zone, and none at all.

    A race's own day may be a day before or after that of its start in UTC, not more.
    """
    one = dt.timedelta(days=1)
    first, last = (as_of - JUST_RUN - one).date(), (as_of + dt.timedelta(hours=lookahead_hours) + one).date()
    return F.col(day).between(F.lit(first), F.lit(last)) | F.col(day).isNull()


def only_races(df: DataFrame, races: DataFrame) -> DataFrame:
    return attach(df, races.select("race_id"), ["race_id"], "left_semi")
