"""The racing notions read off the star-schema tables.

An order is a race and a line of it a runner; the lines of a part are that runner's past runs; the
values of a user's events are its prices. The expressions below are plain SQL that Spark and
DuckDB read alike, so that both sides of a check start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railbird.operators.groups import together

# Position of a line within its order; the three together are unique there.
TIE = ("ln", "pk", "sk")

RUNNER = {
    "race_id": "l_orderkey",
    "run_id": "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)",
    "ln": "l_linenumber",
    "pk": "l_partkey",
    "sk": "l_suppkey",
    "date": "CAST(o_orderdate AS DATE)",
    "venue": "o_orderstatus",
    "state": "CAST(NULL AS STRING)",
    "race": "CAST(o_custkey % 12 + 1 AS INT)",
    "race_name": "concat('Race ', o_custkey)",
    "start_time": "concat(lpad(CAST(o_custkey % 24 AS STRING), 2, '0'), ':', lpad(CAST(o_custkey % 60 AS STRING), 2, '0'))",
    "distance": "CAST(1000 + o_custkey % 5 * 400 AS INT)",
    "prize_money": "o_totalprice",
    "going": "o_orderpriority",
    "track_grading": "CAST(NULL AS STRING)",
    "rail_position": "o_orderstatus",
    "race_shape_early": "CAST(NULL AS DOUBLE)",
    "race_shape_mid": "CAST(NULL AS DOUBLE)",
    "race_shape_late": "CAST(NULL AS DOUBLE)",
    "horse": "p_name",
    "jockey": "p_brand",
    "trainer": "p_type",
    "tab_number": "CAST(nullif(l_suppkey % 15, 0) AS INT)",
    "barrier": "l_linenumber - 1",
    "runs_with_wpr": "CAST(l_quantity AS INT) - 1",
    "wpr_nett": "l_quantity",
    "wpr_last1": "CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_tax END",
    "wpr_avg_last3": "p_retailprice",
    "wpr_dist": "nullif(l_discount, 0)",
    "wpr_dist_n": "CAST(l_suppkey % 4 AS INT)",
    "wpr_going": "CASE WHEN l_linestatus = 'F' THEN l_extendedprice END",
    "jockey_win_pct_90d": "l_extendedprice / l_quantity",
    "trainer_win_pct_365d": "CAST(p_size AS DOUBLE)",
    "jockey_rating": "l_quantity / 3",
    "trainer_rating": "l_tax * 7",
    "rating": "l_extendedprice",
    "rating_price": "l_extendedprice / 8000",
    "speed_rating": "CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_quantity * 2 END",
    "wpr_trend": "CASE WHEN l_discount = 0 THEN NULL ELSE l_tax - l_discount END",
    "wpr_peak_rank_1yr": "CAST(p_size % 10 AS INT)",
    "wpr_consistency": "nullif(l_tax, 0)",
    "wpr_rank": "CAST(NULL AS INT)",
    "avg_800m_pos": "CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_quantity % 10 + 1 END",
    "avg_settled_pos": "CASE WHEN l_tax < 0.03 THEN NULL ELSE l_quantity % 12 END",
    "avg_400m_pos": "l_quantity % 9",
    "early_speed_score": "l_discount - l_tax",
    "mid_speed_score": "l_quantity % 7 - l_discount",
    "late_speed_score": "CASE WHEN l_returnflag = 'R' AND l_tax < 0.04 THEN NULL ELSE l_discount * l_quantity END",
    "total_speed_score": "l_tax * l_quantity",
    "weight_trend": "l_tax - 0.04",
    "wins_at_dist": "CAST(l_suppkey % 3 AS INT)",
    "starts_at_dist": "CAST(l_suppkey % 6 AS INT)",
    "places_at_dist": "CAST(l_suppkey % 4 AS INT)",
    "form_string": "CASE WHEN l_returnflag = 'R' THEN '' ELSE concat(l_linenumber, '-x') END",
    "weight_carried": "50 + l_quantity / 10",
    "jt_combo_win_pct": "CASE WHEN l_linestatus = 'F' THEN l_tax * 250 END",
    "jt_combo_rides": "CAST(l_quantity AS INT)",
    "fixed_win_price": "l_extendedprice / 10000",
    "starting_price_sp": "CASE WHEN l_linestatus = 'F' THEN l_extendedprice / 9000 END",
    "price_top": "CASE WHEN l_linestatus = 'F' THEN l_extendedprice / 7000 END",
    "finish_position": "CASE WHEN l_linestatus = 'F' THEN l_linenumber END",
    "won": "CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END END",
    "placed": "CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_linenumber <= 3 THEN 1 ELSE 0 END END",
    "resulted": "CASE WHEN l_linestatus = 'F' THEN 1 WHEN l_returnflag = 'N' THEN 0 END",
    "ext_ai_rank": "CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(l_suppkey % 5 AS INT) END",
    "ext_ai_price": "l_extendedprice / 11000",
    "ext_ai_score": "l_quantity * 1.5",
    "ext_class_rank": "CAST(l_partkey % 4 AS INT)",
    "ext_tac_class_rank": "CAST(l_partkey % 6 AS INT)",
    "ext_time_rank": "CAST(l_partkey % 7 AS INT)",
    "ext_early_time_rank": "CAST(l_partkey % 8 AS INT)",
    "ext_last600_rank": "CASE WHEN l_linestatus = 'F' THEN CAST(l_suppkey % 3 + 1 AS INT) END",
    "ext_last400_rank": "CAST(l_suppkey % 7 AS INT)",
    "ext_last200_rank": "CAST(l_suppkey % 8 AS INT)",
    "ext_run_style": "l_returnflag",
    "ext_class_change": "l_tax - l_discount",
}

RUNNER_FROM = "lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey"

# A past run of a part: its lines, the latest shipped first. Values are binary fractions, so that
# their sums are exact in any order.
RUN = {
    "run_id": "l_partkey",
    "ok": "l_orderkey",
    "ln": "l_linenumber",
    "sk": "l_suppkey",
    "shipped": "CAST(l_shipdate AS DATE)",
    "date": "CAST(CAST(l_shipdate AS DATE) AS STRING)",
    "formNumber": "CAST(l_orderkey % 100 AS INT)",
    "wpr": "CASE WHEN l_returnflag = 'R' AND l_tax = 0 THEN 0.0 WHEN l_returnflag = 'A' AND l_tax = 0 THEN NULL ELSE l_quantity END",
    "isBarrierTrial": "CASE WHEN l_discount = 0.1 THEN true WHEN l_discount = 0 THEN NULL ELSE false END",
    "distance": "CAST(nullif(l_suppkey % 12, 0) * 200 AS INT)",
    "going": "CASE WHEN l_returnflag = 'A' THEN 'Good 4' WHEN l_returnflag = 'N' THEN 'SOFT 5' WHEN l_tax > 0.04 THEN 'Heavy 8' WHEN l_tax > 0.02 THEN 'dirt' END",
    "positionFinish": "CAST(CASE WHEN l_tax = 0.05 THEN NULL ELSE l_quantity % 12 END AS INT)",
    "positionSettled": "CAST(CASE WHEN l_tax < 0.02 THEN NULL ELSE l_quantity % 11 END AS INT)",
    "position800m": "CAST(CASE WHEN l_tax > 0.06 THEN NULL ELSE l_quantity % 8 END AS INT)",
    "position400m": "CAST(l_quantity % 9 AS INT)",
    "margin800m": "CASE WHEN l_discount = 0.02 THEN NULL ELSE l_quantity / 4 END",
    "margin400m": "CASE WHEN l_discount = 0.03 THEN NULL ELSE l_quantity % 7 / 8 END",
    "marginFinish": "CASE WHEN l_discount = 0.04 THEN NULL ELSE l_quantity % 5 / 2 END",
    "raceShapeEarly": "CASE WHEN l_tax = 0.01 THEN NULL ELSE l_linenumber / 8.0e0 END",
    "raceShapeMid": "l_suppkey % 5 / 4.0e0",
    "raceShapeLate": "l_suppkey % 9 / 16.0e0 - 0.25e0",
    "weightCarried": "CASE WHEN l_linenumber = 2 THEN NULL ELSE 50 + l_quantity / 8 END",
}

# The runner today: the part, on a day, over a distance and on a surface that follow from it.
TARGET = {
    "run_id": "p_partkey",
    "race_date": "CAST(CASE WHEN p_size = 7 THEN NULL WHEN p_size < 25 THEN '1999-06-01' ELSE '2001-01-01' END AS DATE)",
    "race_distance": "CAST(CASE WHEN p_size = 9 THEN NULL ELSE p_size % 12 * 200 END AS INT)",
    "race_going": "CASE WHEN p_size % 3 = 0 THEN 'good 4' WHEN p_size % 3 = 1 THEN 'Soft 5' END",
    "peak_form_number": "CAST(p_partkey % 100 AS INT)",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(expressions: dict[str, str]) -> list:
    return [F.expr(e).alias(name) for name, e in expressions.items()]


def sql_columns(expressions: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {name}" for name, e in expressions.items())


def _read(prefix: str) -> list[str]:
    """The columns of a table that runners are worked out from."""
    return sorted({c for e in RUNNER.values() for c in re.findall(rf"\b{prefix}_\w+", e)})


READ_OF_ORDER, READ_OF_PART = ["o_orderkey", *_read("o")], ["p_partkey", *_read("p")]
READ_OF_LINE = [c for c in _read("l") if c != "l_orderkey"]  # which is the race


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines as they are, under their race."""
    return table(spark, sf_dir, "lineitem").withColumn("race_id", F.col("l_orderkey"))


def runners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runners_of(spark, sf_dir, lines(spark, sf_dir))


def runners_of(spark: SparkSession, sf_dir: str, some: DataFrame, rows: int | None = None) -> DataFrame:
    """Lines with their order's and part's columns.

    Orders come last and by the race's own key, so that what ranks within races finds them together already. Where there are
    at most ``rows`` lines, none of a race too large for a task, a race's runners lie in one partition of a bounded size.
    """
    # what moves are the columns as they lie in the tables; the many worked out from them take several times the bytes
    entered = some.select("race_id", *READ_OF_LINE)
    orders = table(spark, sf_dir, "orders").select(*READ_OF_ORDER)
    parts = table(spark, sf_dir, "part").select(*READ_OF_PART)
    named = entered.join(parts, F.col("p_partkey") == F.col("l_partkey"))
    if rows is not None:
        named = together(named, ["race_id"], rows)
    joined = named.join(orders, F.col("o_orderkey") == F.col("race_id"))
    joined = joined.withColumn("l_orderkey", F.col("race_id"))
    return joined.select("race_id", *columns({name: e for name, e in RUNNER.items() if name != "race_id"}))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*columns(RUN))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(*columns(TARGET))


RUNNERS_SQL = f"runners AS (SELECT {sql_columns(RUNNER)} FROM {RUNNER_FROM})"
RUNS_SQL = f"runs AS (SELECT {sql_columns(RUN)} FROM lineitem)"
TARGETS_SQL = f"targets AS (SELECT {sql_columns(TARGET)} FROM part)"
