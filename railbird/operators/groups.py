"""Ranks and totals within groups, whatever the size of a group.

Nearly every group (a race) fits in one task, and a window over the group's key is the plan to
have. A group with more rows than one task should sort is ranked in slices instead: rows are
range-partitioned by the ranking order, each slice is numbered by itself, and the sizes of the
slices before it are added. Totals of such groups are aggregated before the shuffle and joined back.

``per_group`` finds the oversized groups and runs an operator once with each strategy.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_ROWS_CONF = "spark.railbird.maxGroupRows"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LOCAL_DIR_CONF = "spark.railbird.localCheckpointDir"  # in local mode, where spark.checkpoint.dir is unset
DEFAULT_MAX_ROWS = 2_000_000
TASK_ROWS = 250_000  # so that a dozen entries of each row are sorted in a task's memory


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and for tables that cut lineage.

    That is ``spark.checkpoint.dir``. In local mode, where it is unset, ``spark.railbird.localCheckpointDir`` names it, or
    ``railbird-checkpoints`` in the system's folder for temporary files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(spark.conf.get(LOCAL_DIR_CONF, f"{tempfile.gettempdir()}/railbird-checkpoints"))
    return context.getCheckpointDir()


@contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Actions on what is built inside remove their shuffle files when they end.

    Else these lie on the disks until the driver happens to collect its garbage, those of all steps of a job beside each other.
    """
    before = spark.conf.get(CLEANUP_CONF, "false")
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_CONF, before)


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that later stages read one fixed result."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def attach(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join ``other`` on null-safe ``keys``, keeping one copy of them."""
    renamed = other.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        *[c for c in other.columns if c not in keys],
    )
    on = reduce(lambda a, b: a & b, [df[k].eqNullSafe(renamed[f"_k{i}"]) for i, k in enumerate(keys)])
    return df.join(renamed, on, how).drop(*[f"_k{i}" for i in range(len(keys))])


def _rejoin(df: DataFrame, summed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bring per-key values back to the rows they were worked out from; every row has a match.

    The keys are compared as one struct, in which NULLs are equal. With a condition per key, Spark
    would derive filters from each pair of a chain of such joins.
    """
    left = F.struct(*[df[k].alias(f"k{i}") for i, k in enumerate(keys)])
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    right = summed.select(key.alias("_key"), *[c for c in summed.columns if c not in keys])
    return df.join(right, left == right["_key"]).drop("_key")


def _ends_null(value: Column, descending: bool) -> Column:
    return value.desc_nulls_last() if descending else value.asc_nulls_last()


class InTask:
    """Each group is sorted and summed by the task that holds it."""

    def __init__(self, keys: Sequence[str]):
        self.keys = list(keys)

    def _window(self):
        return Window.partitionBy(*self.keys)

    def numbers(self, df: DataFrame, orders: Mapping[str, Sequence[Column]]) -> DataFrame:
        """Number the rows of a group 1..n in each order. Orders must be total."""
        w = self._window()
        return df.withColumns({name: F.row_number().over(w.orderBy(*order)) for name, order in orders.items()})

    def competitions(self, df: DataFrame, values: Mapping[str, tuple[Column, bool]]) -> DataFrame:
        """Rank by each value (descending if so marked): equals share the best place, NULLs the last."""
        w = self._window()
        return df.withColumns({name: F.rank().over(w.orderBy(_ends_null(*by))) for name, by in values.items()})

    def totals(self, df: DataFrame, **totals: Column) -> DataFrame:
        """Add aggregates of the whole group to each of its rows."""
        w = self._window()
        return df.withColumns({name: c.over(w) for name, c in totals.items()})

    def chunk(self, df: DataFrame, name: str, order: Sequence[Column], size: int) -> DataFrame:
        """Number the pieces of ``size`` rows that a nested record of the group is cut into."""
        place = F.row_number().over(self._window().orderBy(*order))
        return df.withColumn(name, F.floor((place - 1) / size).cast("int"))


class Spread:
    """Each group is cut into slices that many tasks work on."""

    def __init__(self, keys: Sequence[str]):
        self.keys = list(keys)

    def _before(self, df: DataFrame, name: str, order: Sequence[Column], weight: Column) -> DataFrame:
        """Add the sum of ``weight`` over the group's rows that come earlier in ``order``."""
        sliced = durable(
            df.withColumn("_weight", weight)
            .repartitionByRange(*[F.col(k) for k in self.keys], *order)
            .withColumn("_slice", F.spark_partition_id())
        )
        by_slice = [*self.keys, "_slice"]
        # a group has at most as many slices as the shuffle has partitions
        earlier = Window.partitionBy(*self.keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        starts = (
            sliced.groupBy(*by_slice)
            .agg(F.sum("_weight").alias("_sum"))
            .select(*by_slice, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
        )
        inside = Window.partitionBy(*by_slice).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        local = sliced.withColumn("_local", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
        return (
            _rejoin(local, starts, by_slice)
            .withColumn(name, (F.col("_start") + F.col("_local")).cast("int"))
            .drop("_weight", "_slice", "_start", "_local")
        )

    def numbers(self, df: DataFrame, orders: Mapping[str, Sequence[Column]]) -> DataFrame:
        for name, order in orders.items():
            df = self._before(df, name, order, F.lit(1)).withColumn(name, F.col(name) + 1)
        return df

    def competitions(self, df: DataFrame, values: Mapping[str, tuple[Column, bool]]) -> DataFrame:
        # read once per value and once more for the join, so it must not be worked out anew each time
        df = durable(df.withColumns({f"_value_{name}": value for name, (value, _) in values.items()}))
        out = df.drop(*values)
        for name, (_, descending) in values.items():
            value = f"_value_{name}"
            # equal values are counted before the shuffle, so a common one weighs no more than a rare one
            distinct = df.groupBy(*self.keys, value).agg(F.count("*").alias("_n"))
            ranked = self._before(distinct, name, [_ends_null(F.col(value), descending)], F.col("_n")).select(
                *self.keys, value, (F.col(name) + 1).alias(name)
            )
            out = _rejoin(out, ranked, [*self.keys, value])
        return out.drop(*[f"_value_{name}" for name in values])

    def totals(self, df: DataFrame, **totals: Column) -> DataFrame:
        df = durable(df)
        summed = df.groupBy(*self.keys).agg(*[c.alias(name) for name, c in totals.items()])
        return _rejoin(df.drop(*totals), summed, self.keys)

    def chunk(self, df: DataFrame, name: str, order: Sequence[Column], size: int) -> DataFrame:
        return self.numbers(df, {name: order}).withColumn(name, F.floor((F.col(name) - 1) / size).cast("int"))


Groups = InTask | Spread


def together(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """``df`` with the rows of a group in one partition, and at most about ``TASK_ROWS`` of so many rows in each.

    Tables of no more such partitions than there are cores stay as they are. Else the number is fixed, as Spark would join
    partitions by their bytes in the shuffle, a fraction of what sorts of rows and of their entries take in memory.
    """
    spark, tasks = df.sparkSession, -(-rows // TASK_ROWS)
    if tasks <= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def max_group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(MAX_ROWS_CONF, str(DEFAULT_MAX_ROWS)))


def oversized(df: DataFrame, keys: Sequence[str], max_rows: int | None = None) -> DataFrame | None:
    """The keys of the groups too big for one task, or None where there are none.

    One map-side combined count over the key columns. At most rows/``max_rows`` keys come out.
    """
    limit = max_group_rows(df.sparkSession) if max_rows is None else max_rows
    with own_shuffles(df.sparkSession):
        found = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select(*keys)
        if found.isEmpty():
            return None
    return durable(found)


def per_group(
    df: DataFrame,
    keys: Sequence[str],
    work: Callable[[DataFrame, Groups], DataFrame],
    probe: DataFrame | None = None,
    max_rows: int | None = None,
    counted: tuple[DataFrame | None] | None = None,
) -> DataFrame:
    """Run ``work`` over the groups of ``df``, the oversized ones apart from the rest.

    ``probe`` is a cheaper table with the same keys and at least as many rows per key (the scan
    that ``df`` was derived from); group sizes are counted on it. ``counted`` holds what ``oversized`` found, if it was asked
    before.
    """
    keys = list(keys)
    big = counted[0] if counted else oversized(df if probe is None else probe, keys, max_rows)
    if big is None:
        return work(df, InTask(keys))
    rest = attach(df, big, keys, "left_anti")
    apart = attach(df, big, keys, "left_semi")
    return work(rest, InTask(keys)).unionByName(work(apart, Spread(keys)))
