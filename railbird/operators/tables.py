"""Table maintenance: deterministic de-duplication, insert-only append, upsert, removal, retention."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railbird.functions.scalars import as_column
from railbird.operators.groups import attach

# Position of a row: the batch it came in, then its place in that batch.
ROW_ORDER = ("ingest_seq", "row_pos")


def newest_first(order: Sequence[str | Column]) -> list[Column]:
    return [as_column(c).desc_nulls_last() for c in order]


def oldest_first(order: Sequence[str | Column]) -> list[Column]:
    return [as_column(c).asc_nulls_first() for c in order]


def _one_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    # The filter on row_number lets Spark keep one row per key before the shuffle as well.
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_kept", F.row_number().over(w)).where(F.col("_kept") == 1).drop("_kept")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = ROW_ORDER) -> DataFrame:
    """One row per key: the last in ``order``."""
    return _one_per_key(df, keys, newest_first(order))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = ROW_ORDER) -> DataFrame:
    return _one_per_key(df, keys, oldest_first(order))


def new_rows(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = ROW_ORDER
) -> DataFrame:
    """Incoming rows whose key the table does not have yet; the first of each key in the batch.

    A NULL key part matches NULL.
    """
    return attach(keep_first(incoming, keys, order), existing.select(*keys), keys, "left_anti")


def insert_only(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = ROW_ORDER
) -> DataFrame:
    """The table with ``new_rows`` added; columns are the existing ones, then any new ones."""
    return existing.unionByName(new_rows(existing, incoming, keys, order), allowMissingColumns=True)


def upsert(
    existing: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column] = (),
    prefer: Column | None = None,
) -> DataFrame:
    """The table with incoming rows added or replacing rows of the same key.

    Among rows of one key those for which ``prefer`` holds win, then incoming over existing, then
    the last in ``order``.
    """
    both = existing.withColumn("_incoming", F.lit(0)).unionByName(
        incoming.withColumn("_incoming", F.lit(1)), allowMissingColumns=True
    )
    first = [] if prefer is None else [F.coalesce(prefer, F.lit(False)).desc()]
    ranked = [*first, F.col("_incoming").desc(), *newest_first(order)]
    return _one_per_key(both, keys, ranked).drop("_incoming")


def remove_evaluated(existing: DataFrame, evaluated: DataFrame, keys: Sequence[str] = ("race_id",)) -> DataFrame:
    """Rows of groups that were not evaluated in this run."""
    return attach(existing, evaluated.select(*keys).distinct(), list(keys), "left_anti")


def retain(df: DataFrame, time: str, as_of: dt.datetime, days: int = 7) -> DataFrame:
    return df.where(F.col(time) >= F.lit(as_of - dt.timedelta(days=days)))


def is_pending(resulted: str = "resulted") -> Column:
    """No result yet; an unknown flag counts as pending."""
    return F.coalesce(F.col(resulted), F.lit(0)) != 1


def drop_pending(runners: DataFrame, day: dt.date, date: str = "date", resulted: str = "resulted") -> DataFrame:
    """The table without the pending rows of one day, which is about to be read again."""
    return runners.where(~(F.col(date).eqNullSafe(F.lit(day)) & is_pending(resulted)))


def days_to_load(
    runners: DataFrame, first: dt.date, last: dt.date, date: str = "date", again: bool = False
) -> DataFrame:
    """The days of a range that still need loading, oldest first; all of them with ``again``."""
    spark = runners.sparkSession
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 day"))).alias(date)
    )
    if not again:
        days = attach(days, runners.select(date).distinct(), [date], "left_anti")
    return days.orderBy(date)
