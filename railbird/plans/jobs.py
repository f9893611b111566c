"""The three jobs: the daily run, the price refresh, and the second provider's ingest.

Each reads landed feeds and the tables in a store, and writes the tables it changes. None reads a
clock: the moment a job works at is a parameter.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railbird.functions.scalars import whole
from railbird.operators import flatten, merge, payload, prices, race, rules, tables
from railbird.operators.groups import attach, oversized, per_group
from railbird.operators.score import ScoreSpec
from railbird.sources import landing, schemas
from railbird.sources.store import NULL_PARTITION, Store, among

RUNNERS = f"{schemas.RUNNERS}, {schemas.RUNNER_EXTRAS}"
KEY = ["race_id"]
TASKS_A_DAY = 2  # that write what is published of a day


@dataclass(frozen=True)
class Feeds:
    """The landed feeds of the primary provider."""

    calendar: DataFrame
    detail: DataFrame
    caches: DataFrame
    forms: DataFrame
    stats: DataFrame
    results: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, root: str, names: dict[str, str] | None = None) -> Feeds:
        """One folder per feed under ``root``. ``names`` maps our field names to the feed's own."""
        ddl = {
            "calendar": schemas.CALENDAR,
            "detail": schemas.DETAIL,
            "caches": schemas.NET_RATINGS,
            "forms": schemas.FORM,
            "stats": schemas.STATS,
            "results": schemas.RESULTS,
        }
        # a feed may hold a document several times; the newest file tells which counts
        return cls(**{k: landing.read_feed(spark, f"{root}/{k}", d, names).drop("_file") for k, d in ddl.items()})


def _held(small: DataFrame) -> DataFrame:
    """A report of a few rows, worked out now."""
    return small.sparkSession.createDataFrame(small.collect(), small.schema)


def batch_number(as_of: dt.datetime) -> int:
    """Later runs have higher numbers."""
    return int(as_of.replace(tzinfo=as_of.tzinfo or dt.timezone.utc).timestamp())


def ingest(
    runners: DataFrame, feeds: Feeds, as_of: dt.datetime, first: dt.date, last: dt.date, again: bool = False
) -> DataFrame:
    """Runner rows of the days of a range that are not loaded yet, or of all its days with ``again``."""
    days = tables.days_to_load(runners, first, last, again=again)
    races = attach(flatten.calendar_races(feeds.calendar, first, last), days, ["date"], "left_semi")
    rows = flatten.runner_rows(races, feeds.detail, feeds.caches, feeds.forms, feeds.stats)
    rows = rows.withColumn("ingest_seq", F.lit(batch_number(as_of)).cast("bigint"))
    return per_group(rows, KEY, race.race_context, probe=flatten.detail_runners(feeds.detail))


def daily(
    store: Store,
    feeds: Feeds,
    as_of: dt.datetime,
    first: dt.date | None = None,
    last: dt.date | None = None,
    again: bool = False,
    since: dt.date | None = None,
    rule_book: rules.RuleBook | None = None,
    spec: ScoreSpec | None = None,
) -> dict[str, DataFrame]:
    """Results, ingest, ratings, snapshot, picks and race records, in this order.

    ``since`` limits the run to races from that day on, and to the table's partitions from it;
    without it every race is joined and judged again. Returns the reports of the run.
    """
    first, last = first or as_of.date(), last or as_of.date()
    runners = store.read("runners", RUNNERS)
    if since is not None:
        runners = runners.where(F.col("date") >= F.lit(since))

    # three statuses at most; kept apart, as the files it is counted from are replaced below
    eligible = merge.result_races(runners, as_of)
    statuses = _held(eligible.groupBy("status").agg(F.count("*").alias("races")))
    due = eligible.where(F.col("status") == "due")
    results = merge.only_races(flatten.result_rows(feeds.results), due)
    resulted = merge.apply_results(runners, results)

    new = ingest(runners, feeds, as_of, first, last, again)
    known = resulted
    if again:
        # the days read again lose their pending rows; a result is kept over a fresh row without one
        in_range = F.col("date").between(F.lit(first), F.lit(last)) & tables.is_pending()
        known = resulted.where(~F.coalesce(in_range, F.lit(False)))
    merged = tables.upsert(known, new, ["run_id"], tables.ROW_ORDER, prefer=F.col("resulted") == 1)

    ratings = store.read("ext_ratings", f"{schemas.RATINGS}, ingest_seq BIGINT, row_pos INT")
    joined = merge.join_ratings(merged, ratings)
    fitted = schemas.conform(joined, RUNNERS)
    table = store.overwrite_partitions("runners", fitted, "date", instead_of=runners)
    before, runners = runners, table if since is None else table.where(F.col("date") >= F.lit(since))
    # a race read again may have moved from one day to another
    days = None if since is None else days_of(before, runners)

    record_prices(store, runners, as_of)
    book = rule_book or rules.default_rules()
    counted = (oversized(runners.select(*KEY), KEY),)
    picked = judge(store, runners, book, counted, days)
    records = publish(store, runners, as_of, spec, book, counted=counted, days=days)
    order = [F.col(c).asc_nulls_last() for c in ("start_time", "race_id", "run_id")]
    return {
        "results": statuses,
        "ratings": merge.rating_match_stats(runners, ratings, runners),
        "summary": payload.pick_summary(picked, book, as_of.date()),
        "shown": payload.shown_picks(picked, order, as_of.date()),
        "counts": payload.payload_counts(records, picked, book.primary),
    }


def record_prices(store: Store, runners: DataFrame, as_of: dt.datetime) -> None:
    """Add the prices of now to the history and drop those that are too old; without new prices, nothing."""
    snapshot = prices.snapshot(runners, as_of).withColumn("snapshot_date", F.col("snapshot_time").cast("date"))
    if snapshot.isEmpty():
        return
    store.append("prices", snapshot, ["snapshot_date"])
    cull_prices(store, as_of)


def days_of(*tables_: DataFrame) -> list[dt.date | None]:
    """The days that any of the tables has rows of; None among them for rows without a day."""
    found = tables_[0].select("date")
    for more in tables_[1:]:
        found = found.union(more.select("date"))
    return [r["date"] for r in found.distinct().collect()]


def _on(df: DataFrame, days: Sequence[dt.date | None] | None) -> DataFrame:
    """The rows of some days, a condition on partitions; without days, all."""
    if days is None:
        return df
    text = dict(df.dtypes)["date"] == "string"
    return df.where(among("date", [None if d is None else str(d) for d in days] if text else days))


def judge(
    store: Store,
    runners: DataFrame,
    rule_book: rules.RuleBook | None = None,
    counted: tuple[DataFrame | None] | None = None,
    days: Sequence[dt.date | None] | None = None,
) -> DataFrame:
    """Pick anew for all given races; picks of other races stay, those of races that no longer qualify go.

    Picks are kept by day. ``days`` are those the given races are on, or were on when they were last judged; only these are
    read and written. Returns the pick table.
    """
    fresh = per_group(runners, KEY, lambda df, g: rules.picks(df, g, rule_book), runners.select(*KEY), counted=counted)
    earlier = _on(store.read("picks", schemas.PICKS), days)
    kept = tables.remove_evaluated(earlier, runners)
    merged = tables.upsert(kept, schemas.conform(fresh, schemas.PICKS), ["race_id", "run_id", "model"])
    return store.overwrite_partitions("picks", merged, "date", instead_of=earlier)


def publish(
    store: Store,
    runners: DataFrame,
    as_of: dt.datetime,
    spec: ScoreSpec | None = None,
    book: rules.RuleBook | None = None,
    tie: Sequence[str] = tables.ROW_ORDER,
    priced: DataFrame | None = None,
    counted: tuple[DataFrame | None] | None = None,
    days: Sequence[dt.date | None] | None = None,
) -> DataFrame:
    """Write what is published: race records in race order, picks by race, the models, and the day's prices.

    Records and picks are kept by day, in race order within a day (``payload.RACE_ORDER``, from file to file). ``days`` are
    those the given races are on, or were on when they were published last; only these are read and written. Records and
    picks of races not given stay as they are. Prices are the open and the latest one of the local day of each runner given,
    or of each run in ``priced``; those of other runs stay. Returns the race records.
    """
    picked = _on(store.read("picks", schemas.PICKS), days).join(runners.select(*KEY).distinct(), KEY, "left_semi")
    by_race = per_group(picked, KEY, payload.picks_by_race).join(picked.groupBy(*KEY).agg(F.max("date").alias("date")), KEY)
    _republish(store, "race_picks", by_race, runners, days, ("race_id", "part"), picked)
    store.replace("models", (book or rules.default_rules()).meta(store.spark))
    today = prices.local_date(as_of)
    runs = (runners if priced is None else priced).select("run_id").distinct()
    opened = prices.open_recent(store.read("prices", f"{schemas.PRICE_HISTORY}, snapshot_date DATE"), day=today)
    told = prices.attach_prices(runs, opened, today).where(F.col("price_points").isNotNull()).withColumn("local_date", F.lit(today))
    earlier = store.latest("day_prices")
    if earlier is not None:
        earlier = earlier.where(F.col("local_date") == F.lit(today))
        told = attach(earlier, runs, ["run_id"], "left_anti").unionByName(told)
    store.put_partitions("day_prices", told, "local_date", instead_of=earlier)
    records = per_group(runners, KEY, lambda df, g: payload.race_payload(df, g, spec, tie), runners.select(*KEY), counted=counted)
    _republish(store, "races", records, runners, days, payload.RACE_ORDER, runners)
    return store.read("races")


def _as_text(df: DataFrame) -> DataFrame:
    """Races are published under a text, whatever they are worked out under."""
    return df.withColumn("race_id", F.col("race_id").cast("string"))


def _places(rows: DataFrame) -> DataFrame:
    """About where what is published of some rows lies in the order: a row per race and part, from a few of their columns."""
    known = {c: F.col(c) if c in rows.columns else F.lit("") for c in ("start_time", "venue", "race")}
    own = F.struct(
        F.col("date").cast("string").alias("date"),
        *[F.coalesce(known[c], F.lit("")).alias(c) for c in ("start_time", "venue")],
        F.coalesce(whole(known["race"]), F.lit(0)).alias("race"),
    )
    races = rows.where(F.col("race_id").isNotNull()).groupBy(*KEY).agg(F.min(own).alias("_own"), F.count("*").alias("_n"))
    parts = F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / payload.MAX_RUNNERS).cast("int"))
    return _as_text(races.select("race_id", "_own.*", F.explode(parts).alias("part")))


def _republish(
    store: Store,
    name: str,
    fresh: DataFrame,
    races: DataFrame,
    days: Sequence[dt.date | None] | None,
    order: Sequence[str],
    source: DataFrame,
) -> None:
    """Put fresh rows, worked out from those of ``source``, in the place of those of the given races, on some days of a table."""
    earlier, fresh, places = store.latest(name), _as_text(fresh), _places(source)
    if earlier is not None:
        earlier = _on(earlier, days)
        fresh = tables.remove_evaluated(earlier, _as_text(races.select(*KEY))).unionByName(fresh)
    kinds = dict(fresh.dtypes)
    keys = ["date", *order]
    places = places.select(*[F.col(c).cast(kinds[c]).alias(c) for c in keys])
    if earlier is not None:
        places = places.unionByName(earlier.select(*[F.col(c).cast(kinds[c]).alias(c) for c in keys]))
    tasks = None if days is None else TASKS_A_DAY * max(1, len(days))
    store.put_partitions(name, fresh, "date", instead_of=earlier, order=order, tasks=tasks, places=places)


def published_days(store: Store) -> list[str]:
    """The days with race records, in order, as the newest snapshot lists them; nothing else is read."""
    return [f.removeprefix("date=") for f in store.snapshot("races").folders]


def refresh(
    store: Store,
    detail: DataFrame,
    as_of: dt.datetime,
    lookahead_hours: float = merge.LOOKAHEAD_HOURS,
    dry_run: bool = False,
    records: bool = True,
    keep_picks: bool = False,
    spec: ScoreSpec | None = None,
) -> DataFrame:
    """New prices for races about to start; only the days of those races are written.

    ``detail`` is the race detail as it stands now. Returns the count of updates and of prices that
    moved; with ``dry_run`` nothing is written.
    """
    runners = store.read("runners", RUNNERS)
    # only the partitions of these days are read, and that of races without a day
    near = merge.upcoming_races(runners.where(merge.days_in_window(as_of, lookahead_hours)), as_of, lookahead_hours)
    current = detail.withColumn("race_id", F.col("raceId").cast("string"))
    updates = flatten.live_prices(merge.only_races(current, near))
    # races that start within hours lie on a few days
    days = days_of(merge.only_races(runners.where(merge.days_in_window(as_of, lookahead_hours)), near))
    touched = _on(runners, days)
    stats = merge.price_stats(touched, updates)
    if dry_run or not days:
        return stats
    stats = _held(stats)
    store.put_partitions("runners", merge.apply_prices(touched, updates), "date")
    runners = store.read("runners", RUNNERS)
    record_prices(store, runners, as_of)
    # prices of other days did not move, so their picks and records stay
    touched = _on(runners, days)
    if keep_picks:
        judge(store, touched, days=days)
    if records:
        publish(store, touched, as_of, spec, days=days)
    return stats


def cull_prices(store: Store, as_of: dt.datetime) -> DataFrame:
    """Drop the prices that are too old: whole days, and the older part of the first day kept. The table as it is then."""
    ddl, by = f"{schemas.PRICE_HISTORY}, snapshot_date DATE", "snapshot_date"
    limit = as_of - dt.timedelta(days=prices.KEEP_DAYS)
    kept_days = [f.removeprefix(f"{by}=") for f in store.snapshot("prices").folders]
    store.drop_partitions("prices", by, [d for d in kept_days if d < str(limit.date()) and d != NULL_PARTITION])
    edge = store.read("prices", ddl).where(F.col(by) == F.lit(limit.date()))
    if not edge.where(F.col("snapshot_time") < F.lit(limit)).isEmpty():
        recent = tables.retain(edge, "snapshot_time", as_of, prices.KEEP_DAYS)
        store.put_partitions("prices", recent, by, instead_of=edge)
    return store.read("prices", ddl)


# what the jobs write
TABLES = (
    "runners", "prices", "picks", "races", "race_picks", "models", "day_prices", "ext_meetings", "ext_runners", "ext_ratings",
    "ext_sectionals",
)


def clean(store: Store, as_of: dt.datetime, keep: int = 10, names: Sequence[str] = TABLES) -> dict[str, int]:
    """Remove what only snapshots before the last ``keep`` of each table consist of; how many folders went, by table.

    A daily job that refreshes follow every five minutes is to keep as many as a reader may lag behind.
    """
    return {name: store.vacuum(name, as_of, keep) for name in names}


@dataclass(frozen=True)
class ProviderFeeds:
    """The landed feeds of the second provider."""

    meetings: DataFrame
    fields: DataFrame
    ratings: DataFrame
    sectionals: DataFrame | None = None


def provider_ingest(
    store: Store,
    feeds: ProviderFeeds,
    as_of: dt.datetime,
    first: dt.date | None = None,
    last: dt.date | None = None,
) -> dict[str, int]:
    """Add the meetings, runners and ratings of a range of days that the tables do not have yet.

    Existing rows are never changed, so only new rows are written. Returns how many per table.
    """
    first, last = first or as_of.date(), last or as_of.date()
    number = F.lit(batch_number(as_of)).cast("bigint")
    meetings = flatten.bet_meetings(feeds.meetings.where(F.col("date").between(F.lit(first), F.lit(last))))
    incoming = {
        "ext_meetings": (flatten.meeting_rows(meetings).withColumn("row_pos", F.lit(0)), ["date", "meeting_id"]),
        "ext_runners": (flatten.field_runners(meetings, feeds.fields), ["ext_date", "ext_meeting_id", "race_id", "runner_id"]),
        "ext_ratings": (flatten.rating_rows(feeds.ratings, meetings), ["ext_date", "ext_meeting_id", "raceId", "runnerId"]),
    }
    if feeds.sectionals is not None:
        incoming["ext_sectionals"] = (feeds.sectionals, ["ext_date", "ext_meeting_id", "runner_id"])
    added = {}
    for name, (rows, keys) in incoming.items():
        rows = rows.withColumn("ingest_seq", number)
        types = dict(rows.dtypes)
        existing = store.read(name, ", ".join(f"`{k}` {types[k]}" for k in keys))
        day = keys[0]
        if day in existing.columns:
            # tables are partitioned by day, so only the days of the range are read
            existing = existing.where(F.col(day).between(F.lit(first), F.lit(last)))
        fresh = tables.new_rows(existing, rows, keys).withColumn("batch", number)
        store.append(name, fresh, [day])
        written = store.read(name, f"{day} {types[day]}, batch BIGINT")
        added[name] = written.where(F.col(day).between(F.lit(first), F.lit(last)) & (F.col("batch") == number)).count()
    return added

