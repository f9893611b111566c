"""The registered queries: each a function of (spark, sf_dir), most with the same query as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from railbird.operators.groups import Groups, InTask, per_group
from railbird.plans import star

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def over_races(spark: SparkSession, sf_dir: str, work: Callable[[DataFrame, Groups], DataFrame]) -> DataFrame:
    """Run a within-race operator over the star schema's races.

    Oversized races are set apart on the lines, before these are joined to anything; sizes come from
    the key column alone.
    """
    lines = star.lines(spark, sf_dir)
    # told by the ends of the files
    rows = lines.count()
    return per_group(
        lines,
        ["race_id"],
        lambda some, groups: work(star.runners_of(spark, sf_dir, some, rows if isinstance(groups, InTask) else None), groups),
        probe=lines.select("race_id"),
    )


def rounded(expression: str, digits: int) -> str:
    """SQL that rounds as Python does: text formatting works on the exact binary value."""
    return f"(CAST(format('{{:.{digits}f}}', CAST({expression} AS DOUBLE)) AS DOUBLE) + 0.0)"


def with_runners(*ctes: str, select: str) -> str:
    return "WITH " + ", ".join([star.RUNNERS_SQL, *ctes]) + " " + select


def load_all() -> None:
    from railbird.plans import (  # noqa: F401
        feed_queries,
        history_queries,
        job_queries,
        race_queries,
        stream_queries,
        table_queries,
    )
