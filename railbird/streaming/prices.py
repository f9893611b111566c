"""Price updates as streams: the current price per run, snapshots, and open and latest price per day.

Late updates are taken for one day; state older than that is dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from railbird.functions.scalars import null_if_nan
from railbird.operators.groups import attach
from railbird.operators.merge import JUST_RUN, LOOKAHEAD_HOURS
from railbird.operators.prices import hourly
from railbird.operators.tables import keep_last
from railbird.sources.schemas import PRICE_HISTORY
from railbird.sources.store import Store, folder_of

LATE = "1 day"
BUCKET_ROWS = 1_000_000  # of current prices
NEWEST = ("snapshot_time", "fixed_win_price")

HOURS = (
    "hour TIMESTAMP, run_id STRING, open_price DOUBLE, open_time TIMESTAMP, recent_price DOUBLE, "
    "recent_time TIMESTAMP, n BIGINT, day DATE"
)
CURRENT = f"{PRICE_HISTORY}, bucket INT"


def read_updates(spark: SparkSession, path: str, files: str = "*", per_trigger: int | None = None) -> DataFrame:
    """Price points from files as they land, in the price-history schema."""
    reader = spark.readStream.schema(PRICE_HISTORY).option("pathGlobFilter", files)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def usable(updates: DataFrame) -> DataFrame:
    return updates.where((null_if_nan("fixed_win_price") > 1) & F.col("run_id").isNotNull() & F.col("snapshot_time").isNotNull())


def without_repeats(updates: DataFrame, late: str = LATE) -> DataFrame:
    """One update per run and time, among those at most ``late`` apart in arrival."""
    return updates.withWatermark("snapshot_time", late).dropDuplicatesWithinWatermark(["run_id", "snapshot_time"])


def gate(updates: DataFrame, races: DataFrame, lookahead_hours: float = LOOKAHEAD_HOURS) -> DataFrame:
    """Updates made while their race was near: ``races`` is a table of (race_id, start).

    Near is from ``lookahead_hours`` before the start to half an hour after it, by the update's time.
    """
    starts = races.select("race_id", "start")
    time = F.col("snapshot_time")
    near = F.col("start").between(
        time - F.expr(f"INTERVAL {int(JUST_RUN.total_seconds())} SECONDS"),
        time + F.expr(f"INTERVAL {int(lookahead_hours * 3600)} SECONDS"),
    )
    return updates.join(starts, "race_id").where(near).drop("start")


def bucket_of(run: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(buckets)).cast("int")


def bucket_folder(bucket: int) -> str:
    return folder_of("bucket", bucket)


def to_current(
    updates: DataFrame, store: Store, checkpoint: str, name: str = "current_prices", bucket_rows: int = BUCKET_ROWS
) -> StreamingQuery:
    """Keep the newest price of each run in a table; ``current_prices`` reads it.

    A batch writes its runs' newest prices and no others, one leaf for each bucket of runs. Where a bucket's latest leaves
    have no more rows together than are added, they are merged into the new one, so leaves shrink at least by half from one to
    the next: a price is rewritten as often as the logarithm of its bucket's rows. When buckets come to hold more than
    ``bucket_rows`` rows, the whole table is dealt to four times as many. The newest time wins, and a batch that is run again
    is not added again.
    """

    def apply(batch: DataFrame, number: int) -> None:
        table = Store(batch.sparkSession, store.root)
        now = table.snapshot(name)
        if now.marks.get(checkpoint, -1) >= number:
            return
        buckets, held = now.properties.get("buckets", 1), sum(leaf.rows or 0 for leaf in now.leaves)
        newest = keep_last(batch, ["run_id"], NEWEST)
        merged, grown = [], buckets
        counted = _by_bucket(newest, buckets)
        while held + sum(counted.values()) > bucket_rows * grown:
            grown *= 4
        if grown > buckets:
            merged = list(now.leaves)
        else:
            for folder, rows in counted.items():
                for leaf in reversed([x for x in now.leaves if x.folder == folder]):
                    if (leaf.rows or 0) > rows:
                        break
                    merged.append(leaf)
                    rows += leaf.rows or 0
        if merged:
            newest = keep_last(table.rows_of(name, now, merged).drop("bucket").unionByName(newest), ["run_id"], NEWEST)
        dealt = newest.withColumn("bucket", bucket_of("run_id", grown)).persist()
        try:
            table.merge_into(
                name, dealt, "bucket", _by_bucket(dealt, grown), merged, (checkpoint, number), {"buckets": grown}
            )
        finally:
            dealt.unpersist()

    return _start(usable(updates), checkpoint, foreach=apply)


def _by_bucket(df: DataFrame, buckets: int) -> dict[str, int]:
    """The rows of each bucket's folder; as many as there are buckets."""
    counts = df.groupBy(bucket_of("run_id", buckets).alias("bucket")).agg(F.count("*").alias("n")).collect()
    return {bucket_folder(r["bucket"]): r["n"] for r in counts}


def current_prices(store: Store, name: str = "current_prices") -> DataFrame:
    """The newest price of each run: the latest over the leaves of its bucket."""
    return keep_last(store.read(name, CURRENT), ["bucket", "run_id"], NEWEST)


def to_history(updates: DataFrame, store: Store, checkpoint: str, name: str = "prices") -> StreamingQuery:
    """Append snapshots, by UTC day, to a table that batch jobs may append to and cull as well.

    Each batch is one commit that records its number, so one that is run again is not added again.
    """
    dated = usable(updates).withColumn("snapshot_date", F.col("snapshot_time").cast("date"))

    def add(batch: DataFrame, number: int) -> None:
        Store(batch.sparkSession, store.root).append(name, batch, ["snapshot_date"], mark=(checkpoint, number))

    return _start(dated, checkpoint, foreach=add)


def to_hours(
    updates: DataFrame, store: Store, checkpoint: str, name: str = "price_hours", late: str = LATE
) -> StreamingQuery:
    """Keep open and latest price per run and hour in a table, by UTC day.

    The window is what lets Spark drop old state; local days come from the table with
    ``days_from_hours``. A batch brings the whole of each hour it touched, so the newest row wins.
    """
    hours = hourly(updates.withWatermark("snapshot_time", late))

    def apply(batch: DataFrame, _: int) -> None:
        table = Store(batch.sparkSession, store.root)
        fresh = batch.withColumn("day", F.col("hour").cast("date"))
        # the days themselves and not all between them: one wrong clock must not rewrite the table
        days = [r["day"] for r in fresh.select("day").distinct().collect()]
        old = table.read(name, HOURS).where(F.col("day").isin(days))
        kept = attach(old, fresh.select("run_id", "hour"), ["run_id", "hour"], "left_anti")
        table.put_partitions(name, kept.unionByName(fresh), "day")

    return _start(hours, checkpoint, mode="update", foreach=apply)


def _start(
    df: DataFrame, checkpoint: str, foreach: Callable[[DataFrame, int], None], mode: str = "append"
) -> StreamingQuery:
    def run(batch: DataFrame, number: int) -> None:
        # the batch is read more than once, and must not run its stateful plan each time
        held = batch.persist()
        try:
            if not held.isEmpty():
                foreach(held, number)
        finally:
            held.unpersist()

    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.foreachBatch(run).trigger(availableNow=True).start()
