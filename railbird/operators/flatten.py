"""Nested feeds to flat rows. Filters come before the next explode, so dropped branches are never expanded."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railbird.functions.scalars import first_truthy, is_true, number, truthy, whole
from railbird.operators.groups import InTask, attach
from railbird.operators.history import form_features, net_ratings, runner_stats
from railbird.operators.tables import keep_last
from railbird.sources.schemas import PERFORMANCE_BLOCKS, RECORD_BLOCKS

# The fields a start time may be in, the least prize listed at all and the least one bet on.
START_FIELDS = ("startTime", "scheduledTime", "raceTime", "startAt", "time", "jumpTime")
LISTED_PRIZE = 1000
BET_PRIZE = 20000


def dealt(other: DataFrame) -> DataFrame:
    """The other side of a join with parsed documents: both sides are dealt out by key, and neither is sent to the driver.

    Spark judges by its size check that a table is small enough to be broadcast. That goes by the bytes of the file a document was
    made or parsed from, of which a document and its entries may take hundreds of times as many.
    """
    return other.hint("merge")


def newest(df: DataFrame, key: str, landed: str = "landed") -> DataFrame:
    """The document of each key that landed last, where the feed says when they did.

    The last mark of each key is found on the marks alone; documents are then joined to it, and none is sorted or held for
    that. ``landed`` tells documents apart, also two of one file.
    """
    if landed not in df.columns:
        return df
    last = df.groupBy(key).agg(F.max(landed).alias(landed))
    return attach(df, dealt(last), [key, landed], "left_semi").drop(landed)


def calendar_races(calendar: DataFrame, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """Calendar days to races: no trials, no abandoned races, prize at least ``LISTED_PRIZE``."""
    days = newest(calendar, "date").withColumn("date", F.col("date").try_cast("date"))
    if first is not None:
        days = days.where(F.col("date") >= F.lit(first))
    if last is not None:
        days = days.where(F.col("date") <= F.lit(last))
    meetings = days.select("date", F.explode("meetings").alias("m")).where(
        ~is_true(F.col("m.isTrialMeeting")) & ~is_true(F.col("m.isJumpout"))
    )
    races = meetings.select("date", "m", F.explode("m.races").alias("r")).where(
        ~is_true(F.col("r.isAbandoned")) & ~is_true(F.col("r.isBarrierTrial")) & (F.col("r.prizeMoney") >= LISTED_PRIZE)
    )
    return races.select(
        "date",
        F.coalesce("m.venue", F.lit("")).alias("venue"),
        F.col("m.state").alias("state"),
        F.col("r.number").alias("race"),
        F.col("r.raceId").cast("string").alias("race_id"),
        F.col("r.name").alias("race_name"),
        F.col("r.distance").alias("distance"),
        F.col("r.prizeMoney").alias("prize_money"),
        F.col("m.going").alias("going"),
        F.col("m.trackGrading").alias("track_grading"),
        F.col("m.railPosition").alias("rail_position"),
        first_truthy(*[F.col(f"r.{name}") for name in START_FIELDS], falsy="").alias("start_time"),
    )


def detail_runners(detail: DataFrame) -> DataFrame:
    """Race detail to one row per runner that was not scratched, in the order listed."""
    rows = newest(detail, "raceId").select(
        F.col("raceId").cast("string").alias("race_id"), F.posexplode("runners").alias("row_pos", "d")
    ).where(~is_true(F.col("d.isScratched")))
    return rows.select(
        "race_id",
        F.col("d.runId").cast("string").alias("run_id"),
        F.col("d.tabNumber").alias("tab_number"),
        F.col("d.barrier").alias("barrier"),
        F.col("d.horse").alias("horse"),
        F.col("d.jockey").alias("jockey"),
        F.col("d.trainer").alias("trainer"),
        F.col("d.rating").alias("rating"),
        F.col("d.ratingPrice").alias("rating_price"),
        F.col("d.speed").alias("speed_rating"),
        number("d.fixedWinPrice").alias("fixed_win_price"),
        F.col("d.sectEarly").alias("sect_early"),
        F.col("d.weightCarried").alias("weight_carried"),
        "row_pos",
    )


def runner_rows(
    races: DataFrame, detail: DataFrame, caches: DataFrame, forms: DataFrame, stats: DataFrame
) -> DataFrame:
    """Runner rows of the given races: race and runner attributes, net rating, form features, strike rates.

    Of documents that landed several times the last counts. Lookups that miss leave NULLs. Net ratings are ranked over all entries of a race's cache.
    """
    runners = detail_runners(detail).join(dealt(races), "race_id")
    # a race's cache is one record, so its entries are few
    by_rating = [F.col("wpr_nett").desc_nulls_last(), F.col("row_pos")]
    nett = InTask(["race_id"]).numbers(net_ratings(newest(caches, "raceId")), {"_n": by_rating})
    nett = keep_last(nett, ["race_id", "run_id"], ["row_pos"]).select(
        "race_id", "run_id", "wpr_nett", F.when(F.col("wpr_nett").isNotNull(), F.col("_n")).alias("wpr_rank")
    )
    rows = runners.join(dealt(nett), ["race_id", "run_id"], "left")
    rows = rows.join(dealt(runner_stats(newest(stats, "runId"))), "run_id", "left")
    known = newest(forms, "runId").select(F.col("runId").cast("string").alias("run_id"), "form", "peak")
    rows = rows.join(dealt(known), "run_id", "left").withColumn("_known", F.col("form").isNotNull())
    kept = rows.columns
    featured = form_features(rows, race_date="date", race_distance="distance", race_going="going")
    added = [c for c in featured.columns if c not in kept]
    featured = featured.select(
        *[c for c in kept if c not in ("form", "peak", "_known")],
        *[F.when(F.col("_known"), F.col(c)).alias(c) for c in added],
    )
    nothing = {"finish_position": "int", "starting_price_sp": "double", "price_top": "double", "won": "int", "placed": "int"}
    shapes = ("race_shape_early", "race_shape_mid", "race_shape_late")
    return featured.withColumns(
        {
            **{c: F.lit(None).cast("double") for c in shapes},
            **{c: F.lit(None).cast(t) for c, t in nothing.items()},
            "resulted": F.lit(0),
        }
    )


def live_prices(detail: DataFrame) -> DataFrame:
    """Win prices above 1 of runners not scratched; the last one listed for a run."""
    rows = (
        newest(detail, "raceId").select(F.posexplode("runners").alias("row_pos", "d"))
        .where(~is_true(F.col("d.isScratched")) & F.col("d.runId").isNotNull())
        .select(F.col("d.runId").cast("string").alias("run_id"), number("d.fixedWinPrice").alias("price"), "row_pos")
        .where(F.col("price") > 1)
    )
    return keep_last(rows, ["run_id"], ["row_pos"]).select("run_id", "price")


def result_rows(results: DataFrame) -> DataFrame:
    """Result feed to finished runners; entries without a run or a finish are dropped."""
    rows = newest(results, "raceId").select(F.col("raceId").cast("string").alias("race_id"), F.posexplode("runners").alias("row_pos", "r"))
    return rows.where(F.col("r.runId").isNotNull() & truthy(F.col("r.positionFinish")).isNotNull()).select(
        "race_id",
        F.col("r.runId").cast("string").alias("run_id"),
        F.col("r.positionFinish").alias("finish"),
        F.col("r.priceStarting").alias("sp"),
        F.col("r.priceTop").alias("top"),
        "row_pos",
    )


def bet_meetings(meetings: DataFrame) -> DataFrame:
    """The second provider's meetings that take bets; mixed cards with jumps races stay in."""
    return meetings.where(F.col("tabMeeting").eqNullSafe(F.lit(True)) & ~is_true(F.col("isBarrierTrial")))


def meeting_rows(meetings: DataFrame, date: str | Column = "date") -> DataFrame:
    return meetings.select(
        F.col(date).alias("date") if isinstance(date, str) else date.alias("date"),
        F.col("meetingId").alias("meeting_id"),
        F.col("track.name").alias("venue"),
        F.col("track.trackId").alias("track_id"),
        F.col("track.state").alias("state"),
        F.col("track.country").alias("country"),
        F.col("track.abbrev").alias("abbrev"),
        F.col("track.surface").alias("surface"),
        F.col("railPosition").alias("rail_position"),
        F.col("stage").alias("stage"),
        F.col("tabMeeting").alias("tab_meeting"),
        F.col("expectedCondition").alias("expected_condition"),
        F.col("formUpdated").alias("form_updated"),
        F.col("ratingsUpdated").alias("ratings_updated"),
        F.col("hasSectionals").alias("has_sectionals"),
    )


# The scalar columns of a flattened runner and where each comes from.
RUNNER_PATHS = {
    "ext_date": "date",
    "ext_meeting_id": "meetingId",
    "ext_venue": "track.name",
    "ext_state": "track.state",
    "ext_surface": "track.surface",
    "race_id": "race.raceId",
    "race_number": "race.number",
    "race_name": "race.name",
    "race_distance": "race.distance",
    "race_class": "race.raceClass",
    "race_prize": "race.prizeMoney",
    "race_start_time": "race.startTime",
    "runner_id": "runner.runnerId",
    "horse": "runner.name",
    "tab_no": "runner.tabNo",
    "barrier": "runner.barrier",
    "weight": "runner.weight",
    "weight_total": "runner.weightTotal",
    "handicap": "runner.handicap",
    "age": "runner.age",
    "sex": "runner.sex",
    "country": "runner.country",
    "trainer_id": "runner.trainer.trainerId",
    "trainer": "runner.trainer.fullName",
    "trainer_loc": "runner.trainer.location",
    "jockey_id": "runner.jockey.jockeyId",
    "jockey": "runner.jockey.fullName",
    "jockey_claim": "runner.jockey.claim",
    "jockey_apprentice": "runner.jockey.isApprentice",
    "price_sp": "runner.priceSP",
    "last10": "runner.last10",
    "win_pct": "runner.winPct",
    "place_pct": "runner.placePct",
    "career_starts": "runner.careerStarts",
    "career_wins": "runner.careerWins",
    "prize_money_total": "runner.prizeMoney",
    "emergency": "runner.emergencyIndicator",
    "gear_changes": "runner.gearChanges",
    "prep_runs": "runner.prepRuns",
    "form_id": "runner.formId",
}
RECORD_FIELDS = ("starts", "firsts", "seconds", "thirds")
PERFORMANCE_FIELDS = {"a2e": "a2E", "pot": "poT", "sr": "strikeRate", "wins": "wins", "runners": "runners"}


def record_columns(blocks: Mapping[str, str] = RECORD_BLOCKS) -> list[Column]:
    return [
        F.col(f"runner.{block}.{name}").alias(f"{prefix}_{name}")
        for block, prefix in blocks.items()
        for name in RECORD_FIELDS
    ]


def performance_columns(blocks: Sequence[str] = PERFORMANCE_BLOCKS) -> list[Column]:
    return [
        F.col(f"runner.{block}.{path}").alias(f"{block}_{suffix}")
        for block in blocks
        for suffix, path in PERFORMANCE_FIELDS.items()
    ]


def of_day(stated: Column, day: Column) -> Column:
    """Whether a document is of a meeting's day; one that does not say is."""
    return stated.isNull() | (stated == day)


def field_runners(meetings: DataFrame, fields: DataFrame) -> DataFrame:
    """Fields of the given meetings, by day and id, to one wide row per runner.

    A race whose prize is known and below ``BET_PRIZE`` is dropped; an unknown prize stays.
    """
    prize = F.coalesce(whole("race.prizeMoney"), F.lit(0))
    known = meetings.where(truthy(F.col("meetingId"), "").isNotNull()).select("date", "meetingId", "track")
    dated = fields if "date" in fields.columns else fields.withColumn("date", F.lit(None).cast("date"))
    # places count through all races of a meeting, so no two runners share one
    sizes = F.transform("races", lambda r: F.coalesce(F.array_size(r["runners"]), F.lit(0)))
    listed = dated.select(
        F.col("meetingId").alias("_meeting"), F.col("date").alias("_day"), sizes.alias("_sizes"),
        F.posexplode("races").alias("_place", "race"),
    )
    before = F.aggregate(F.slice("_sizes", F.lit(1), F.col("_place")), F.lit(0), lambda n, size: n + size)
    races = (
        listed.where((prize == 0) | (prize >= BET_PRIZE))
        .withColumn("_before", before)
        .join(dealt(known), (F.col("_meeting") == F.col("meetingId")) & of_day(F.col("_day"), F.col("date")))
    )
    runners = races.select("*", F.posexplode("race.runners").alias("_pos", "runner"))
    return runners.select(
        *[F.col(path).alias(name) for name, path in RUNNER_PATHS.items()],
        *record_columns(),
        *performance_columns(),
        (F.col("_before") + F.col("_pos")).alias("row_pos"),
    )


def rating_rows(ratings: DataFrame, meetings: DataFrame) -> DataFrame:
    """Rating items with the day, meeting and venue they belong to; padded run styles trimmed."""
    venues = meetings.select(
        F.col("date").alias("_day"), F.col("meetingId").alias("_meeting"), F.col("track.name").alias("ext_venue")
    )
    dated = ratings if "ext_date" in ratings.columns else ratings.withColumn("ext_date", F.lit(None).cast("date"))
    joined = dated.withColumn("runStyle", F.trim("runStyle")).join(
        venues, (F.col("ext_meeting_id") == F.col("_meeting")) & of_day(F.col("ext_date"), F.col("_day"))
    )
    return joined.withColumn("ext_date", F.col("_day")).drop("_day", "_meeting")
